"""Synthetic temporal graphs with planted structure, drawn on the executors.

Random numbers are seeded hashes of the cell, so a recomputed partition draws
the same graph.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.expressions import dot
from ..graph import TemporalGraph, guard_dense
from ..operators.linalg import factor_frame

ATTACKS = ("random_flip", "targeted_cross_community", "sparse_outlier_edges", "sparse_spike", "signed_spike", "block_sparse_spike")


def uniform(seed: int, *keys: Column | str) -> Column:
    """Uniform in (0, 1) by hash of the keys."""
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[F.col(k) if isinstance(k, str) else k for k in keys]), 11)
    return (h.cast("double") + 0.5) / float(1 << 53)


def normal(seed: int, *keys: Column | str) -> Column:
    """Standard normal by Box and Muller."""
    return F.sqrt(-2 * F.log(uniform(seed, *keys))) * F.cos(2 * math.pi * uniform(seed + 7_919, *keys))


def _cells(spark: SparkSession, n: int, steps: int) -> DataFrame:
    guard_dense(n, steps)
    i = F.col("id")
    return spark.range(steps * n * n).select(F.floor(i / (n * n)).cast("int").alias("t"), F.floor(F.pmod(i, F.lit(n * n)) / n).cast("int").alias("u"), F.pmod(i, F.lit(n)).cast("int").alias("v"))


def _graph(spark: SparkSession, name: str, cells: DataFrame, n: int, steps: int, labels: list[int] | None = None, **more) -> TemporalGraph:
    """A graph from cells (t, u, v, p, w): truth p, edges where w is not 0."""
    nodes = spark.createDataFrame([(i, i, labels[i] if labels else None) for i in range(n)], "idx int, node_id long, community int")
    times = spark.range(steps).select(F.col("id").cast("int").alias("t"), F.col("id").cast("string").alias("label"))
    return TemporalGraph(name, cells.where(F.col("w") != 0).select("t", "u", "v", "w"), n, steps, nodes=nodes, times=times, truth=cells.where(F.col("p") != 0).select("t", "u", "v", "p"), **more)


def low_rank(spark: SparkSession, n: int = 24, steps: int = 4, rank: int = 3, noise: float = 0.02, seed: int = 0) -> TemporalGraph:
    """Normal factors, temporal factors near 1, falling weights, and noise on every cell."""
    rng = np.random.default_rng(seed)
    left, right, time = rng.normal(size=(n, rank)), rng.normal(size=(n, rank)), rng.normal(1, 0.15, (steps, rank)) * np.linspace(1, 0.35, rank)
    frame = lambda m, k, f: F.broadcast(factor_frame(spark, m, k).withColumnRenamed("f", f))
    cells = _cells(spark, n, steps).join(frame(left, "u", "l"), "u").join(frame(right, "v", "r"), "v").join(frame(time, "t", "s"), "t")
    cells = cells.select("t", "u", "v", dot(F.col("l"), F.col("r"), F.col("s"), rank=rank).alias("p"))
    return _graph(spark, "low_rank", cells.withColumn("w", F.col("p") + noise * normal(seed, "t", "u", "v")), n, steps)


def _labels(n: int, k: int, seed: int) -> list[int]:
    return np.random.default_rng(seed).permutation(np.arange(n) % k).tolist()


def _sbm_cells(spark: SparkSession, n: int, steps: int, k: int, p_in: float, p_out: float, jitter: float, seed: int) -> tuple[DataFrame, list[int]]:
    """Cells with the communities of their ends and the probability p, jittered per step and block pair."""
    labels = _labels(n, k, seed)
    of = F.array(*[F.lit(x) for x in labels])
    cells = _cells(spark, n, steps).withColumns({"a": F.get(of, F.col("u")), "b": F.get(of, F.col("v"))}) if n <= 4096 else _cells(spark, n, steps).join(_side(spark, labels, "u", "a"), "u").join(_side(spark, labels, "v", "b"), "v")
    base = F.when(F.col("a") == F.col("b"), p_in).otherwise(p_out)
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), base * (1 + jitter * normal(seed + 1, "t", "a", "b"))))
    return cells.withColumn("p", F.when(F.col("u") == F.col("v"), 0.0).otherwise(p)), labels


def _side(spark: SparkSession, labels: list[int], key: str, name: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(labels)), f"{key} int, {name} int")


def _pair(directed: bool) -> tuple[Column, Column]:
    """Keys of a draw: the cell, or its unordered pair."""
    return (F.col("u"), F.col("v")) if directed else (F.least("u", "v"), F.greatest("u", "v"))


def sbm(spark: SparkSession, n: int = 300, steps: int = 20, communities: int = 5, p_in: float = 0.30, p_out: float = 0.05, jitter: float = 0.08, directed: bool = False, seed: int = 0) -> TemporalGraph:
    """Stochastic block model: each cell an edge of weight 1 with its block's probability; no loops."""
    cells, labels = _sbm_cells(spark, n, steps, communities, p_in, p_out, jitter, seed)
    if not directed:
        cells = cells.withColumn("p", F.when(F.col("u") == F.col("v"), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.col("a") == F.col("b"), p_in).otherwise(p_out) * (1 + jitter * normal(seed + 1, F.col("t"), F.least("a", "b"), F.greatest("a", "b")))))))
    w = (uniform(seed + 2, F.col("t"), *_pair(directed)) < F.col("p")).cast("double")
    return _graph(spark, "sbm", cells.withColumn("w", w), n, steps, labels)


def theory_sbm(spark: SparkSession, n: int = 300, steps: int = 20, communities: int = 5, p_in: float = 0.30, p_out: float = 0.05, sigma: float = 0.1, noise: str = "iid", hetero_fraction: float = 0.1, hetero_multiplier: float = 3.0, directed: bool = False, seed: int = 0) -> TemporalGraph:
    """Block probabilities plus Gaussian noise: ``iid``, or larger at random entries or along random nodes' rows and columns."""
    if noise not in ("iid", "heteroskedastic_entry", "heteroskedastic_node"):
        raise ValueError("noise is iid, heteroskedastic_entry or heteroskedastic_node")
    cells, labels = _sbm_cells(spark, n, steps, communities, p_in, p_out, 0.0, seed)

    def error(u: str, v: str) -> Column:
        large = F.lit(1.0)
        if noise == "heteroskedastic_entry":
            large = F.when(uniform(seed + 3, u, v) < hetero_fraction, hetero_multiplier).otherwise(1.0)
        if noise == "heteroskedastic_node":
            for side in (u, v):
                large = large * F.when(uniform(seed + 3, side) < hetero_fraction, hetero_multiplier).otherwise(1.0)
        return sigma * large * normal(seed + 4, "t", u, v)

    e = error("u", "v") if directed else (error("u", "v") + error("v", "u")) / 2  # the average with the transpose
    return _graph(spark, f"theory_{noise}", cells.withColumn("w", F.when(F.col("u") == F.col("v"), 0.0).otherwise(F.col("p") + e)), n, steps, labels)


def correlated_sbm(spark: SparkSession, n: int = 300, steps: int = 20, communities: int = 5, p_in: float = 0.30, p_out: float = 0.05, sigma: float = 0.1, alpha: float = 0.5, seed: int = 0) -> TemporalGraph:
    """Block probabilities plus first-order autoregressive noise per cell, in closed form over the earlier draws."""
    if not 0 <= alpha < 1:
        raise ValueError("alpha must lie in [0, 1)")
    cells, labels = _sbm_cells(spark, n, steps, communities, p_in, p_out, 0.0, seed)
    draws = F.sequence(F.lit(0), F.col("t"))
    h = F.aggregate(draws, F.lit(0.0), lambda acc, k: acc * alpha + sigma * normal(seed + 5, k, F.col("u"), F.col("v")))
    return _graph(spark, "correlated_sbm", cells.withColumn("w", F.when(F.col("u") == F.col("v"), 0.0).otherwise(F.col("p") + h)), n, steps, labels)


def spiked(spark: SparkSession, n: int = 200, steps: int = 10, rank: int = 3, snr: float = 2.0, sigma: float = 1.0, noise: str = "iid", seed: int = 0) -> TemporalGraph:
    """Symmetric spikes on an orthonormal basis over noise; spike sizes fall geometrically to a quarter."""
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, rank)))[0]
    top = snr * sigma * math.sqrt(n)
    scaled = basis * np.geomspace(top, top / 4, rank)
    frame = lambda m, k, f: F.broadcast(factor_frame(spark, m, k).withColumnRenamed("f", f))
    cells = _cells(spark, n, steps).join(frame(scaled, "u", "l"), "u").join(frame(basis, "v", "r"), "v")
    p = F.when(F.col("u") == F.col("v"), 0.0).otherwise(dot(F.col("l"), F.col("r"), rank=rank))
    std = sigma * (F.when(uniform(seed + 3, "u", "v") < 0.1, 3.0).otherwise(1.0) if noise != "iid" else F.lit(1.0))
    cells = cells.select("t", "u", "v", p.alias("p"))
    return _graph(spark, "spiked", cells.withColumn("w", F.when(F.col("u") == F.col("v"), 0.0).otherwise(F.col("p") + std * normal(seed + 4, "t", "u", "v"))), n, steps, [0] * n)


def attack_cells(graph: TemporalGraph, kind: str, fraction: float, seed: int, directed: bool = True) -> DataFrame:
    """(t, u, v): per step ``round(fraction * pairs)`` distinct off-diagonal cells of those that the kind allows.

    ``targeted_cross_community`` takes only pairs across communities,
    ``block_sparse_spike`` one random block of nodes (all pairs, if too small).
    """
    if kind not in ATTACKS:
        raise ValueError(f"attack kind is one of {', '.join(ATTACKS)}")
    n, spark = graph.n, graph.spark
    i = F.col("id")
    pairs = spark.range(n * n).select(F.floor(i / n).cast("int").alias("u"), F.pmod(i, F.lit(n)).cast("int").alias("v"))
    pairs = pairs.where(F.col("u") != F.col("v")) if directed else pairs.where(F.col("u") < F.col("v"))
    total = n * (n - 1) // (1 if directed else 2)
    wanted = int(round(fraction * total))
    if kind == "targeted_cross_community":
        if graph.nodes is None or graph.nodes.where("community is not null").isEmpty():
            raise ValueError("this attack needs communities")
        side = lambda k: graph.nodes.select(F.col("idx").alias(k), F.col("community").alias(f"c{k}"))
        pairs = pairs.join(F.broadcast(side("u")), "u").join(F.broadcast(side("v")), "v").where("cu <> cv").select("u", "v")
    if kind == "block_sparse_spike":
        width = max(2, int(math.ceil(math.sqrt(2 * wanted))))
        if width < n and width * (width - 1) >= wanted:
            block = np.random.default_rng(seed).choice(n, width, replace=False).tolist()
            pairs = pairs.where(F.col("u").isin(block) & F.col("v").isin(block))
    drawn = pairs.crossJoin(spark.range(graph.steps).select(F.col("id").cast("int").alias("t")))  # steps are few
    order = Window.partitionBy("t").orderBy("x", "u", "v")
    return drawn.withColumn("x", F.xxhash64(F.lit(seed), "t", "u", "v")).withColumn("k", F.row_number().over(order)).where(F.col("k") <= wanted).select("t", "u", "v")


def inject(graph: TemporalGraph, kind: str = "sparse_spike", fraction: float = 0.02, magnitude: float = 4.0, seed: int = 10_000, directed: bool = True) -> TemporalGraph:
    """The graph with corrupted cells: flipped, set to 1 or to the magnitude, or raised by plus or minus it."""
    hit = attack_cells(graph, kind, fraction, seed, directed)
    if not directed:
        hit = hit.union(hit.select("t", F.col("v").alias("u"), F.col("u").alias("v")))
    w = F.coalesce("w", F.lit(0.0))
    sign = F.when(uniform(seed + 1, F.col("t"), *_pair(directed)) < 0.5, -1.0).otherwise(1.0)
    value = {"random_flip": 1 - w, "targeted_cross_community": F.lit(1.0), "sparse_outlier_edges": F.lit(float(magnitude)), "sparse_spike": w + magnitude, "signed_spike": w + sign * magnitude, "block_sparse_spike": w + magnitude}[kind]
    marked = graph.edges.join(hit.withColumn("hit", F.lit(True)), ["t", "u", "v"], "full").select("t", "u", "v", F.when(F.col("hit"), value).otherwise(w).alias("w"))
    return graph.with_(edges=marked.where(F.col("w") != 0), attack=hit, masks=hit, attack_kind=kind)


def attacked_sbm(spark: SparkSession, kind: str = "sparse_spike", fraction: float = 0.02, magnitude: float = 4.0, outlier_weight: float = 3.0, seed: int = 0, directed: bool = False, **options) -> TemporalGraph:
    """A block model under attack; outlier edges have their own weight."""
    graph = sbm(spark, seed=seed, directed=directed, **options)
    return inject(graph, kind, fraction, outlier_weight if kind == "sparse_outlier_edges" else magnitude, seed + 10_000, directed)


def targeted_additions(graph: TemporalGraph, epsilon: float, seed: int = 0) -> TemporalGraph:
    """Weight 1 on a share of the missing entries across communities of each step."""
    side = lambda k: graph.nodes.select(F.col("idx").alias(k), F.col("community").alias(f"c{k}"))
    absent = graph.grid().join(F.broadcast(side("u")), "u").join(F.broadcast(side("v")), "v").where("cu <> cv").join(graph.edges, ["t", "u", "v"], "left_anti")
    share = absent.groupBy("t").agg(F.round(F.count(F.lit(1)) * epsilon).alias("m"))
    order = Window.partitionBy("t").orderBy("x", "u", "v")
    added = absent.withColumn("x", F.xxhash64(F.lit(seed), "t", "u", "v")).withColumn("k", F.row_number().over(order)).join(F.broadcast(share), "t").where("k <= m").select("t", "u", "v")
    return graph.with_(edges=graph.edges.unionByName(added.withColumn("w", F.lit(1.0))), attack=added, attack_kind="targeted")


def fake_nodes(graph: TemporalGraph, delta: float, links: int = 5, seed: int = 0) -> TemporalGraph:
    """``max(1, round(delta n))`` fake nodes, each tied both ways to up to ``links`` nodes of one random community per step."""
    count = max(1, int(round(delta * graph.n)))
    spark = graph.spark
    groups = [r.community for r in graph.nodes.select("community").distinct().orderBy("community").collect()]  # one per community
    fakes = spark.range(count * graph.steps).select((F.floor(F.col("id") / graph.steps) + graph.n).cast("int").alias("u"), F.pmod("id", F.lit(graph.steps)).cast("int").alias("t"))
    pick = F.get(F.array(*[F.lit(g) for g in groups]), F.floor(uniform(seed, "u", "t") * len(groups)).cast("int"))
    near = fakes.withColumn("community", pick).join(graph.nodes.select("community", F.col("idx").alias("v")), "community")
    order = Window.partitionBy("u", "t").orderBy("x", "v")
    ties = near.withColumn("x", F.xxhash64(F.lit(seed), "u", "v", "t")).withColumn("k", F.row_number().over(order)).where(F.col("k") <= links).select("t", "u", "v", F.lit(1.0).alias("w"))
    both = ties.union(ties.select("t", F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    nodes = graph.nodes.unionByName(spark.range(count).select((F.col("id") + graph.n).cast("int").alias("idx"), (F.col("id") + graph.n).alias("node_id"), F.lit(None).cast("int").alias("community")))
    return graph.with_(edges=graph.edges.unionByName(both), nodes=nodes, n=graph.n + count, attack=both.select("t", "u", "v"), attack_kind="injection")
