"""Communities of a step by k-means on factor embeddings."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import FactorStore


def embedding(store: FactorStore, t: int) -> DataFrame:
    """(u, x): left and right rows, each component weighted by the root of |lambda * W[t]|."""
    store.check_range(t=t)
    weights = store.temporal.where(F.col("t") == t).first()["f"]
    scale = [abs(x * y) ** 0.5 for x, y in zip(store.lambdas, weights, strict=True)]
    both = store.left.select("u", F.col("f").alias("l")).join(store.right.select(F.col("v").alias("u"), F.col("f").alias("r")), "u")
    columns = [F.get(c, F.lit(j)) * F.lit(float(s)) for c in ("l", "r") for j, s in enumerate(scale)]
    return both.select("u", array_to_vector(F.array(*columns)).alias("x"))


def kmeans(points: DataFrame, k: int, seed: int = 0, starts: int = 10) -> DataFrame:
    """(u, label): the clustering of least cost over several seeded starts."""
    points = points.cache()
    try:
        best = min((KMeans(k=k, seed=seed + i, featuresCol="x", maxIter=50).fit(points) for i in range(starts)), key=lambda m: m.summary.trainingCost)
        return best.transform(points).select("u", F.col("prediction").alias("label"))
    finally:
        points.unpersist()


def community(store: FactorStore, t: int, k: int | None = None, seed: int = 0, starts: int = 10) -> DataFrame:
    """(t, u, label) with k communities (the rank, by default; at most n)."""
    k = min(k or store.rank, store.n)
    if k < 2:
        return store.left.select(F.lit(t).alias("t"), "u", F.lit(0).alias("label"))
    return kmeans(embedding(store, t), k, seed, starts).select(F.lit(t).alias("t"), "u", "label")


def left_community(store: FactorStore, k: int, seed: int = 0) -> DataFrame:
    """Communities of the left factors alone."""
    return kmeans(store.left.select("u", array_to_vector("f").alias("x")), k, seed)
