"""A compressed temporal graph: factor tables, sparse residuals, bounds; queried without decompression."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import calibrated_bound, dot, small
from ..graph import guard_dense
from .quantiles import quantiles

SCHEMA_VERSION = 1
#: Fixed sizes of the byte accounting: a COO entry, a CSR entry, a CSR row pointer.
COO_BYTES, CSR_BYTES, POINTER_BYTES = 20, 12, 4


@dataclass(frozen=True)
class FactorStore:
    """score(u, v, t) = sum_j lambda_j L[u,j] R[v,j] W[t,j], plus the residual where one is stored.

    ``left`` (u, f), ``right`` (v, f), ``temporal`` (t, f) hold arrays of
    ``rank`` doubles; ``residuals`` (t, u, v, value), duplicates summed;
    ``node_bounds`` (u, mu, src_scale, tgt_scale).
    """

    left: DataFrame
    right: DataFrame
    temporal: DataFrame
    lambdas: tuple[float, ...]
    n: int
    m: int
    steps: int
    residuals: DataFrame | None = None
    node_bounds: DataFrame | None = None
    bound_sigma_max: float | None = None
    bound_constant: float = 1.0
    entrywise_bound_scale: float | None = None
    diagnostics: dict[str, Any] = field(default_factory=dict)
    residual_format: str = "temporal_coo"

    def __post_init__(self) -> None:
        if not self.lambdas:
            raise ValueError("a store has at least one component")
        if self.bound_constant < 0:
            raise ValueError("bound_constant must not be negative")

    @property
    def rank(self) -> int:
        return len(self.lambdas)

    @property
    def spark(self):
        return self.left.sparkSession

    @property
    def has_residuals(self) -> bool:
        return self.residuals is not None and not self.residuals.isEmpty()

    def with_(self, **changes) -> FactorStore:
        return replace(self, **changes)

    def check_range(self, u: int | None = None, v: int | None = None, t: int | None = None) -> None:
        for name, value, size in (("u", u, self.n), ("v", v, self.m), ("t", t, self.steps)):
            if value is not None and not 0 <= value < size:
                raise IndexError(f"{name}={value} is outside 0..{size - 1}")

    # Scores

    def weighted_temporal(self) -> DataFrame:
        """(t, s) with lambda folded in."""
        return self.temporal.select("t", F.array(*[F.get("f", F.lit(j)) * F.lit(float(x)) for j, x in enumerate(self.lambdas)]).alias("s"))

    def with_base(self, cells: DataFrame, out: str = "base") -> DataFrame:
        """``cells`` (u, v, t, ...) with the factor score; factor tables are broadcast only if small."""
        joined = cells.join(small(self.left.select("u", F.col("f").alias("__l")), self.n, self.rank), "u")
        joined = joined.join(small(self.right.select("v", F.col("f").alias("__r")), self.m, self.rank), "v")
        joined = joined.join(small(self.weighted_temporal().withColumnRenamed("s", "__s"), self.steps, self.rank), "t")
        return joined.withColumn(out, dot(F.col("__l"), F.col("__r"), F.col("__s"), rank=self.rank)).drop("__l", "__r", "__s")

    def summed_residuals(self) -> DataFrame:
        return self.residuals.groupBy("t", "u", "v").agg(F.sum("value").alias("value"))

    def with_residual(self, cells: DataFrame, out: str = "residual") -> DataFrame:
        """``cells`` with their stored residual, 0 where none is."""
        if self.residuals is None:
            return cells.withColumn(out, F.lit(0.0))
        found = self.summed_residuals().withColumnRenamed("value", "__value")
        return cells.join(found, ["t", "u", "v"], "left").withColumn(out, F.coalesce("__value", F.lit(0.0))).drop("__value")

    def score(self, cells: DataFrame, include_residual: bool = True, out: str = "score") -> DataFrame:
        """``cells`` (u, v, t, ...) with their score; cells out of range are left out."""
        base = self.with_base(cells, out)
        if not include_residual or self.residuals is None:
            return base
        return self.with_residual(base, "__res").withColumn(out, F.col(out) + F.col("__res")).drop("__res")

    def link_score(self, u: int, v: int, t: int, include_residual: bool = True) -> float:
        self.check_range(u, v, t)
        one = self.spark.range(1).select(F.lit(u).alias("u"), F.lit(v).alias("v"), F.lit(t).alias("t"))
        return self.score(one, include_residual).first()["score"]

    def cells(self, t: int | None = None) -> DataFrame:
        guard_dense(self.n, self.steps if t is None else 1, m=self.m)
        size = self.n * self.m
        i = F.col("id")
        grid = self.spark.range((self.steps if t is None else 1) * size)
        step = F.floor(i / size).cast("int") if t is None else F.lit(t)
        return grid.select(step.alias("t"), F.floor(F.pmod(i, F.lit(size)) / self.m).cast("int").alias("u"), F.pmod(i, F.lit(self.m)).cast("int").alias("v"))

    def dense_snapshot(self, t: int, include_residual: bool = True) -> DataFrame:
        self.check_range(t=t)
        return self.score(self.cells(t), include_residual)

    def residual_snapshot(self, t: int) -> DataFrame:
        self.check_range(t=t)
        return self._residuals().where(F.col("t") == t)

    def residual_row(self, t: int, u: int) -> DataFrame:
        self.check_range(u=u, t=t)
        return self._residuals().where((F.col("t") == t) & (F.col("u") == u))

    def residual_value(self, t: int, u: int, v: int) -> float:
        self.check_range(u, v, t)
        return self._residuals().where((F.col("t") == t) & (F.col("u") == u) & (F.col("v") == v)).agg(F.coalesce(F.sum("value"), F.lit(0.0))).first()[0]

    def _residuals(self) -> DataFrame:
        if self.residuals is None:
            return self.spark.createDataFrame([], "t int, u int, v int, value double")
        return self.residuals

    # Bounds

    def precompute_bounds(self, edges: DataFrame, constant: float = 1.0) -> FactorStore:
        """Bound parameters from the snapshots: uncentred deviations with residuals, signed row sums."""
        if constant < 0:
            raise ValueError("the bound constant must not be negative")
        if self.n != self.m:
            raise ValueError("bounds need a square graph")
        scored = self.score(self.cells().join(edges, ["t", "u", "v"], "left").withColumn("w", F.coalesce("w", F.lit(0.0))))
        spread = quantiles(scored, F.abs(F.col("w") - F.col("score")), {"s": 0.5}, self.steps * self.n * self.m, ["t"])
        sigma = spread.agg(F.max("s") / 0.6745).first()[0]
        return self.with_(node_bounds=node_degrees(edges, self.n, self.steps, absolute=False), bound_sigma_max=float(sigma), bound_constant=constant)

    @property
    def theoretical(self) -> bool:
        return self.bound_sigma_max is not None and self.node_bounds is not None

    def theory(self) -> Column:
        """Bound of a cell from ``__mu_u`` and ``__mu_v``."""
        if not self.theoretical:
            raise ValueError("bound parameters have not been computed")
        if self.n != self.m:
            raise ValueError("bounds need a square graph")
        scale = self.bound_constant * self.bound_sigma_max * math.sqrt(self.rank * max(math.log(max(self.n, 1)), 0.0)) / math.sqrt(self.n * self.steps)
        return F.lit(scale) * (1 / F.sqrt("__mu_u") + 1 / F.sqrt("__mu_v"))

    def with_bound(self, cells: DataFrame, factor: float = 1.0, out: str = "bound") -> DataFrame:
        """``cells`` with the calibrated bound, null if nothing is known.  ``factor`` scales theoretical bounds only."""
        if self.node_bounds is not None and (self.theoretical or self.entrywise_bound_scale is not None):
            nodes = small(self.node_bounds, self.n, 4)
            cells = cells.join(nodes.select("u", F.col("mu").alias("__mu_u"), F.col("src_scale").alias("__src")), "u")
            cells = cells.join(nodes.select(F.col("u").alias("v"), F.col("mu").alias("__mu_v"), F.col("tgt_scale").alias("__tgt")), "v")
            degree = F.lit(self.entrywise_bound_scale) * 0.5 * (F.col("__src") + F.col("__tgt")) if self.entrywise_bound_scale is not None else None
            value = calibrated_bound(self.theory() if self.theoretical else None, degree, None, factor)
            return cells.withColumn(out, value).drop("__mu_u", "__src", "__mu_v", "__tgt")
        return cells.withColumn(out, calibrated_bound(None, None, self.diagnostics.get("estimated_threshold"), factor))

    def error_bound(self, cells: DataFrame, include_residual: bool = True, factor: float = 1.0, out: str = "bound") -> DataFrame:
        """Bound of the estimate with or without the residual: skipping a residual adds its size (also scaled by a theory's factor)."""
        bounded = self.with_bound(cells, factor, out)
        if include_residual or self.residuals is None:
            return bounded
        by = factor if self.theoretical else 1.0
        return self.with_residual(bounded, "__res").withColumn(out, F.col(out) + F.lit(by) * F.abs("__res")).drop("__res")

    # Bytes

    def residual_nnz(self) -> int:
        return 0 if self.residuals is None else self.residuals.count()

    def factor_bytes(self, dtype_bytes: int = 8) -> int:
        return (self.n + self.m + self.steps + 1) * self.rank * dtype_bytes

    def residual_bytes(self) -> int:
        return residual_bytes(self.residual_nnz(), self.steps, self.n, self.residual_format)

    def metadata_bytes(self) -> int:
        """Bound tables and diagnostics as JSON."""
        import json

        nodes = 0 if self.node_bounds is None else self.n * 3 * 8
        return nodes + len(json.dumps(self.diagnostics, default=str))

    def compressed_bytes(self, dtype_bytes: int = 8, metadata: bool = True) -> int:
        return self.factor_bytes(dtype_bytes) + self.residual_bytes() + (self.metadata_bytes() if metadata else 0)

    def raw_dense_bytes(self) -> int:
        return self.steps * self.n * self.m * 8

    def ratios(self, raw_nnz: int, dtype_bytes: int = 8, metadata: bool = True) -> dict[str, float]:
        size = self.compressed_bytes(dtype_bytes, metadata)
        sparse = raw_sparse_bytes(raw_nnz, self.steps, self.n)
        return {"compression_ratio": self.raw_dense_bytes() / max(size, 1), "compressed_vs_raw_dense_ratio": size / max(self.raw_dense_bytes(), 1), "compressed_vs_raw_sparse_ratio": size / max(sparse, 1)}


def node_degrees(edges: DataFrame, n: int, steps: int, absolute: bool = True) -> DataFrame:
    """(u, mu, src_scale, tgt_scale): mean weight of a node's row per cell, floored at 1/n, and its inverse root."""
    w = F.abs("w") if absolute else F.col("w")
    sums = edges.groupBy("u").agg(F.sum(w).alias("s"))
    every = edges.sparkSession.range(n).select(F.col("id").cast("int").alias("u"))
    mu = F.greatest(F.coalesce("s", F.lit(0.0)) / F.lit(float(n * steps)), F.lit(1.0 / n))
    return every.join(sums, "u", "left").select("u", mu.alias("mu"), (1 / F.sqrt(mu)).alias("src_scale"), (1 / F.sqrt(mu)).alias("tgt_scale"))


def residual_bytes(nnz: int, steps: int, n: int, kind: str) -> int:
    if kind == "temporal_coo":
        return COO_BYTES * nnz
    if kind == "csr":
        return CSR_BYTES * nnz + POINTER_BYTES * (n + 1) * steps if nnz else 0
    raise ValueError("the residual format is csr, temporal_coo or auto")


def raw_sparse_bytes(nnz: int, steps: int, n: int) -> int:
    return CSR_BYTES * nnz + POINTER_BYTES * (n + 1) * steps


def choose_format(nnz: int, steps: int, n: int, kind: str) -> str:
    """The smaller layout for ``auto`` (ties to COO); any other name must be one of the two."""
    if kind == "auto":
        return "temporal_coo" if residual_bytes(nnz, steps, n, "temporal_coo") <= CSR_BYTES * nnz + POINTER_BYTES * (n + 1) * steps else "csr"
    residual_bytes(0, steps, n, kind)
    return kind
