"""Temporal graphs as relations."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TemporalGraph:
    """Snapshots over ``steps`` time steps of an ``n`` by ``m`` graph.

    ``edges`` (t, u, v, w) is unique per cell; an absent cell is 0.  The other
    relations are optional: nodes (idx, node_id, community), times (t, label),
    truth (t, u, v, p), attack and masks (t, u, v), heldout (t, u, v, w).
    """

    name: str
    edges: DataFrame
    n: int
    steps: int
    m: int | None = None
    nodes: DataFrame | None = None
    times: DataFrame | None = None
    truth: DataFrame | None = None
    attack: DataFrame | None = None
    masks: DataFrame | None = None
    heldout: DataFrame | None = None
    attack_kind: str | None = None

    @property
    def columns(self) -> int:
        return self.n if self.m is None else self.m

    @property
    def spark(self):
        return self.edges.sparkSession

    def with_(self, **changes) -> TemporalGraph:
        return replace(self, **changes)

    def grid(self, limit_bytes: float = 8e9) -> DataFrame:
        """Every cell (t, u, v), built from ranges; refused beyond ``limit_bytes`` of dense doubles."""
        guard_dense(self.n, self.steps, limit_bytes, self.columns)
        cells = self.spark.range(self.steps * self.n * self.columns)
        i = F.col("id")
        per = self.n * self.columns
        return cells.select(F.floor(i / per).cast("int").alias("t"), F.floor(F.pmod(i, F.lit(per)) / self.columns).cast("int").alias("u"), F.pmod(i, F.lit(self.columns)).cast("int").alias("v"))

    def dense(self) -> DataFrame:
        """All cells with their weights, 0 where there is no edge."""
        return self.grid().join(self.edges, ["t", "u", "v"], "left").select("t", "u", "v", F.coalesce("w", F.lit(0.0)).alias("w"))


def guard_dense(n: int, steps: int, limit_bytes: float = 8e9, m: int | None = None) -> None:
    """Refuse operations over all cells when their dense size is beyond the limit."""
    if steps * n * (m or n) * 8 > limit_bytes:
        raise MemoryError(f"{steps} steps of {n} x {m or n} cells exceed {limit_bytes:.3g} bytes")


def summed(edges: DataFrame) -> DataFrame:
    """Duplicates of a cell are added up."""
    return edges.groupBy("t", "u", "v").agg(F.sum("w").alias("w"))
