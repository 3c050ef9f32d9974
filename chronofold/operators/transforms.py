"""Snapshot transforms: means, symmetric parts, unfoldings, stitches, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.expressions import harmless_hash
from ..graph import TemporalGraph


def mean_snapshot(edges: DataFrame, steps: int) -> DataFrame:
    """(u, v, w): the mean over all ``steps``, empty cells counting as 0."""
    return edges.groupBy("u", "v").agg((F.sum("w") / F.lit(float(steps))).alias("w"))


def symmetric(matrix: DataFrame) -> DataFrame:
    """Half the sum of a matrix (u, v, w) and its transpose."""
    both = matrix.select("u", "v", "w").union(matrix.select("v", "u", "w"))
    return both.groupBy("u", "v").agg((F.sum("w") / 2).alias("w"))


def nonzero(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("w") != 0).select("t", "u", "v", "w")


def source_gram(edges: DataFrame) -> DataFrame:
    """Gram matrix (a, b, g) of the source unfolding, n x (n * steps), which is never built."""
    x = edges.select("t", "v", F.col("u").alias("a"), F.col("w").alias("x"))
    y = edges.select("t", "v", F.col("u").alias("b"), F.col("w").alias("y"))
    return x.join(y, ["t", "v"]).groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("g"))


def target_gram(edges: DataFrame) -> DataFrame:
    return source_gram(edges.select("t", F.col("v").alias("u"), F.col("u").alias("v"), "w"))


def random_halves(steps: int, seed: int) -> list[int]:
    """Part (1 or 2) of each step: a seeded permutation's first half, at least one step, is part 1."""
    import numpy as np

    order = np.random.default_rng(seed).permutation(steps)
    first = set(order[: max(1, steps // 2)].tolist())
    return [1 if t in first else 2 for t in range(steps)]


def split_means(edges: DataFrame, parts: list[int]) -> DataFrame:
    """(u, v, m1, m2): the means of the two groups of steps."""
    n1, n2 = parts.count(1), parts.count(2)
    part = F.get(F.array(*[F.lit(p) for p in parts]), F.col("t"))
    mean = lambda p, n: F.sum(F.when(part == p, F.col("w")).otherwise(0.0)) / F.lit(float(max(1, n)))
    return edges.groupBy("u", "v").agg(mean(1, n1).alias("m1"), mean(2, n2).alias("m2"))


def stitch(edges: DataFrame, parts: list[int]) -> DataFrame:
    """Triangular stitch: above the diagonal the first half's mean, below it the second's, on it their average."""
    means = split_means(edges, parts)
    value = F.when(F.col("u") < F.col("v"), F.col("m1")).when(F.col("u") > F.col("v"), F.col("m2")).otherwise((F.col("m1") + F.col("m2")) / 2)
    return means.select("u", "v", value.alias("w"))


def blend(first: DataFrame, second: DataFrame, weight: float) -> DataFrame:
    """(1 - weight) * first + weight * second, cells of either."""
    b = min(max(weight, 0.0), 1.0)
    x, y = first.withColumnRenamed("w", "x"), second.withColumnRenamed("w", "y")
    return x.join(y, ["u", "v"], "full").select("u", "v", (F.coalesce("x", F.lit(0.0)) * (1 - b) + F.coalesce("y", F.lit(0.0)) * b).alias("w"))


def stitch_report(edges: DataFrame, parts: list[int]) -> DataFrame:
    """One row: largest errors of the stitch against its sources by triangle, its asymmetry, off-diagonal correlation of the halves."""
    if len(parts) < 2:
        raise ValueError("a split needs at least two steps")
    means = split_means(edges, parts)
    s = stitch(edges, parts).withColumnRenamed("w", "s")
    both = means.join(s, ["u", "v"])
    err = lambda cond, source: F.coalesce(F.max(F.when(cond, F.abs(F.col("s") - source))), F.lit(0.0))
    lower, upper, diag = F.col("u") > F.col("v"), F.col("u") < F.col("v"), F.col("u") == F.col("v")
    mean = (F.col("m1") + F.col("m2")) / 2
    part = both.agg(err(upper, F.col("m1")).alias("upper_error"), err(lower, F.col("m2")).alias("lower_error"), err(diag, mean).alias("diagonal_error"), F.corr(F.when(~diag, F.col("m1")), F.when(~diag, F.col("m2"))).alias("half_correlation"))
    return part.join(relative_asymmetry(s.withColumnRenamed("s", "w")))


def relative_asymmetry(matrix: DataFrame) -> DataFrame:
    """One row ``asymmetry``: norm of the antisymmetric difference over the norm, 0 for an empty matrix."""
    a = matrix.select("u", "v", "w")
    both = a.select("u", "v", "w", F.lit(0.0).alias("x")).union(a.select("v", "u", F.lit(0.0), F.col("w")))
    cells = both.groupBy("u", "v").agg(F.sum("w").alias("w"), F.sum("x").alias("x"))
    ratio = F.sqrt(F.sum(F.pow(F.col("w") - F.col("x"), 2))) / F.sqrt(F.sum(F.col("w") * F.col("w")))
    return cells.agg(F.coalesce(F.when(F.sum(F.col("w") * F.col("w")) > 0, ratio), F.lit(0.0)).alias("asymmetry"))


def heldout_split(graph: TemporalGraph, fraction: float, seed: int = 0) -> TemporalGraph:
    """Nonzero entries whose hash falls below ``fraction`` leave the training edges."""
    if not 0 <= fraction <= 1:
        raise ValueError("fraction must lie in [0, 1]")
    cells = nonzero(graph.edges).withColumn("__h", harmless_hash(F.col("t"), F.col("u"), F.col("v"), F.lit(seed)))
    return graph.with_(edges=cells.where(F.col("__h") >= fraction).drop("__h"), heldout=cells.where(F.col("__h") < fraction).drop("__h"))


#: Cells of a step up to which its empty cells are listed; larger steps are listed too when over half full.
LISTED_CELLS = 1_000_000


def empty_cells(graph: TemporalGraph, steps: list[int]) -> DataFrame:
    """(t, u, v) of all cells without a nonzero weight in the given steps, from ranges."""
    per = graph.n * graph.columns
    cells = graph.spark.range(per).select(F.floor(F.col("id") / graph.columns).cast("int").alias("u"), F.pmod("id", F.lit(graph.columns)).cast("int").alias("v"))
    every = cells.select(F.explode(F.array(*[F.lit(t) for t in steps]).cast("array<int>")).alias("t"), "u", "v")
    return every.join(nonzero(graph.edges), ["t", "u", "v"], "left_anti")


def negative_samples(graph: TemporalGraph, positives: DataFrame, per_positive: int, seed: int = 0) -> DataFrame:
    """(qid, t, u, v): for each positive ``per_positive`` distinct empty cells of its step, or all if there are fewer.

    In small or nearly full steps the empty cells are listed in hash order and
    each positive takes a run of them from a random place on.  In large sparse
    steps, where a random cell is empty at least every other time, cells are
    drawn until far more tries were made than are wanted.
    """
    if per_positive < 1:
        raise ValueError("per_positive must be positive")
    per = graph.n * graph.columns
    filled = {r.t: r.n for r in nonzero(graph.edges).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per step
    listed = [t for t in range(graph.steps) if per <= LISTED_CELLS or 2 * filled.get(t, 0) > per]
    drawn_from = [t for t in range(graph.steps) if t not in set(listed)]
    parts = []
    if listed:
        order = Window.partitionBy("t").orderBy(F.xxhash64("t", "u", "v", F.lit(seed)), "u", "v")
        cells = empty_cells(graph, listed).withColumn("place", F.row_number().over(order) - 1)
        sizes = graph.spark.createDataFrame([(t, per - filled.get(t, 0)) for t in listed], "t int, size long").where("size > 0")
        asked = positives.select("qid", "t").join(F.broadcast(sizes), "t")  # one row per step
        start = F.pmod(F.xxhash64("qid", F.lit(seed)), F.col("size"))
        runs = asked.select("qid", "t", "size", start.alias("start"), F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(per_positive).cast("long"), "size") - 1)).alias("k"))
        picks = runs.select("qid", "t", F.pmod(F.col("start") + F.col("k"), F.col("size")).cast("int").alias("place"))
        parts.append(picks.join(cells, ["t", "place"]).select("qid", "t", "u", "v"))
    if drawn_from:
        tries = 16 * per_positive + 64
        sparse = positives.select("qid", "t").where(F.col("t").isin(drawn_from))
        tried = sparse.select("qid", "t", F.explode(F.sequence(F.lit(1), F.lit(tries))).alias("k"))
        draw = lambda salt, size: F.pmod(F.xxhash64(F.col("qid"), F.col("k"), F.lit(seed), F.lit(salt)), F.lit(size)).cast("int")
        cells = tried.select("qid", "t", "k", draw(1, graph.n).alias("u"), draw(2, graph.columns).alias("v")).groupBy("qid", "t", "u", "v").agg(F.min("k").alias("k"))
        empty = cells.join(nonzero(graph.edges), ["t", "u", "v"], "left_anti")
        first = Window.partitionBy("qid").orderBy("k")
        parts.append(empty.withColumn("r", F.row_number().over(first)).where(F.col("r") <= per_positive).select("qid", "t", "u", "v"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def workload(graph: TemporalGraph, kind: str, size: int, seed: int = 0, k: int = 10, window: int = 6) -> DataFrame:
    """Uniform requests: link (qid, u, v, t), top (qid, u, t, k), community (qid, t), trend (qid, u, v, t1, t2 clipped)."""
    ids = graph.spark.range(size).withColumnRenamed("id", "qid")
    draw = lambda salt, n: F.pmod(F.xxhash64(F.col("qid"), F.lit(seed), F.lit(salt)), F.lit(n)).cast("int")
    u, v, t = draw(1, graph.n).alias("u"), draw(2, graph.columns).alias("v"), draw(3, graph.steps)
    if kind == "link":
        return ids.select("qid", u, v, t.alias("t"))
    if kind == "top":
        return ids.select("qid", u, t.alias("t"), F.lit(k).alias("k"))
    if kind == "community":
        return ids.select("qid", t.alias("t"))
    if kind == "trend":
        return ids.select("qid", u, v, t.alias("t1"), F.least(t + window - 1, F.lit(graph.steps - 1)).alias("t2"))
    raise ValueError("kind is link, top, community or trend")


