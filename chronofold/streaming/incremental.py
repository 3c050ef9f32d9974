"""Edges as a stream: windows become steps, and each new step is projected on the factors of a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.linalg import temporal_projection
from ..operators.store import FactorStore


def snapshots(stream: DataFrame, window: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """(start, u, v, w): tumbling windows of events (ts, u, v, w), duplicates summed, late ones dropped after ``lateness``."""
    grouped = stream.withWatermark("ts", lateness).groupBy(F.window("ts", window), "u", "v").agg(F.sum("w").alias("w"))
    return grouped.select(F.col("window.start").alias("start"), "u", "v", "w")


def project_step(store: FactorStore, edges: DataFrame) -> DataFrame:
    """(start, f): the temporal factor of each window in a batch of closed windows; L and R stay as they are."""
    starts = edges.select("start").distinct()
    index = {r.start: i for i, r in enumerate(starts.orderBy("start").collect())}  # windows of one trigger
    if not index:
        return edges.sparkSession.createDataFrame([], "start timestamp, f array<double>")
    numbers = edges.sparkSession.createDataFrame([(s, i) for s, i in index.items()], "start timestamp, t int")
    numbered = edges.join(F.broadcast(numbers), "start")
    found = temporal_projection(numbered, store.left, store.right, store.n, store.m, len(index), store.rank, list(store.lambdas))
    return found.join(F.broadcast(numbers), "t").select("start", "f")


def maintain(stream: DataFrame, store: FactorStore, path: str, checkpoint: str, threshold: float | None = None, window: str = "1 day", lateness: str = "1 hour", available_now: bool = True) -> StreamingQuery:
    """Append to ``path``/temporal the factor of every closed window, to ``path``/residuals its residuals at or above ``threshold``.

    Batches are written under their number, so a retried batch replaces itself.
    """
    closed = snapshots(stream, window, lateness)

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            steps = project_step(store, batch)
            steps.write.mode("overwrite").parquet(f"{path}/temporal/batch={number}")
            if threshold is not None:
                lam = F.array(*[F.lit(float(x)) for x in store.lambdas])
                cells = batch.join(steps.select("start", F.zip_with("f", lam, lambda a, b: a * b).alias("s")), "start")
                cells = cells.join(store.left.select("u", F.col("f").alias("l")), "u").join(store.right.select("v", F.col("f").alias("r")), "v")
                from ..functions.expressions import dot

                value = F.col("w") - dot(F.col("l"), F.col("r"), F.col("s"), rank=store.rank)
                cells.select("start", "u", "v", value.alias("value")).where(F.abs("value") >= threshold).write.mode("overwrite").parquet(f"{path}/residuals/batch={number}")
        finally:
            batch.unpersist()

    writer = closed.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
