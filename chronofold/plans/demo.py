"""Stores over the driver's tables whose factors SQL can state, so that every query has an oracle.

``block_store``: one component per pair of regions; its score is the mean trade
between two regions in a year.  ``rank_one_store``: the leading singular pair of
the mean trade snapshot by power iteration.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import TemporalGraph
from ..operators.linalg import factor_frame, temporal_projection, to_array
from ..operators.residuals import kept_residuals, residual_cells, threshold_row
from ..operators.store import FactorStore
from ..operators.transforms import mean_snapshot
from ..sources.edges import trade_graph

#: Quantile of the absolute residuals from which the demonstration store keeps them.
QUANTILE = 0.98


def block_factors(graph: TemporalGraph) -> tuple[DataFrame, DataFrame, int]:
    """Left and right factor tables of the region pairs: entry 1/sqrt(size) where the node is of the region."""
    regions = {r.idx: r.community for r in graph.nodes.collect()}  # nations
    names = sorted(set(regions.values()))
    size = {p: sum(r == p for r in regions.values()) for p in names}
    k = len(names)
    left, right = np.zeros((graph.n, k * k)), np.zeros((graph.n, k * k))
    for i, region in regions.items():
        for j in range(k * k):
            p, q = names[j // k], names[j % k]
            left[i, j] = (region == p) / math.sqrt(size[p])
            right[i, j] = (region == q) / math.sqrt(size[q])
    spark = graph.spark
    return factor_frame(spark, left, "u"), factor_frame(spark, right, "v"), k * k


def block_store(spark: SparkSession, sf_dir: str, residuals: bool = True, graph: TemporalGraph | None = None) -> tuple[TemporalGraph, FactorStore]:
    graph = graph or trade_graph(spark, sf_dir)
    graph = graph.with_(edges=graph.edges.cache())
    left, right, rank = block_factors(graph)
    temporal = temporal_projection(graph.edges, left, right, graph.n, graph.n, graph.steps, rank)
    temporal = factor_frame(spark, np.array([r.f for r in temporal.orderBy("t").collect()]), "t")  # one row per year
    store = FactorStore(left, right, temporal, (1.0,) * rank, graph.n, graph.n, graph.steps)
    if residuals:
        cells = residual_cells(graph.edges, store)
        threshold = threshold_row(cells, graph.steps * graph.n**2, "quantile", q=QUANTILE).first()[0]
        store = store.with_(residuals=kept_residuals(cells, threshold).cache(), diagnostics={"estimated_threshold": threshold})
    return graph, store


def rank_one_store(spark: SparkSession, sf_dir: str, iterations: int = 12) -> tuple[TemporalGraph, FactorStore]:
    """Power iteration on the mean snapshot from the constant vector."""
    graph = trade_graph(spark, sf_dir)
    a = to_array(mean_snapshot(graph.edges, graph.steps), graph.n, graph.n)
    v = np.full(graph.n, 1 / math.sqrt(graph.n))
    for _ in range(iterations):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    image = a @ v
    value = float(np.linalg.norm(image))
    left, right = factor_frame(spark, (image / value)[:, None], "u"), factor_frame(spark, v[:, None], "v")
    temporal = temporal_projection(graph.edges, left, right, graph.n, graph.n, graph.steps, 1, [value])
    return graph, FactorStore(left, right, temporal, (value,), graph.n, graph.n, graph.steps)


def requests(graph: TemporalGraph) -> DataFrame:
    """One link request (qid, u, v, t) per pair of nations, years in turn."""
    n = graph.n
    i = F.col("id")
    return graph.spark.range(n * n).select(i.alias("qid"), F.floor(i / n).cast("int").alias("u"), F.pmod(i, F.lit(n)).cast("int").alias("v"), F.pmod(F.floor(i / n) + F.pmod(i, F.lit(n)), F.lit(graph.steps)).cast("int").alias("t"))


def top_requests(graph: TemporalGraph, k: int = 3) -> DataFrame:
    """One request (qid, u, t, k) per nation for its last year."""
    return graph.spark.range(graph.n).select(F.col("id").alias("qid"), F.col("id").cast("int").alias("u"), F.lit(graph.steps - 1).alias("t"), F.lit(k).alias("k"))


def trend_requests(graph: TemporalGraph) -> DataFrame:
    """One request (qid, u, v, t1, t2) per nation: trade with the next nation over years 1 to 4."""
    n = graph.n
    return graph.spark.range(n).select(F.col("id").alias("qid"), F.col("id").cast("int").alias("u"), F.pmod(F.col("id") + 1, F.lit(n)).cast("int").alias("v"), F.lit(1).alias("t1"), F.lit(min(4, graph.steps - 1)).alias("t2"))
