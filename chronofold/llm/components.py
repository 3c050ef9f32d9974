"""Connected components of an edge table by contraction, with no edge or label on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def connected(edges: DataFrame, work: Workspace, name: str = "cc") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is one node of the component.

    Every round hooks each node to the smallest node near it, jumps once more,
    and contracts the edges, so the rounds are logarithmic.  Each round ends in
    written tables; counts alone come to the driver.
    """
    spark = edges.sparkSession
    pairs = work.table(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}_edges0")
    roots = work.table(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root")), f"{name}_roots0")
    step = 0
    while not pairs.isEmpty():
        step += 1
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select("b", "a"))
        hook = work.table(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p")), f"{name}_hook{step}")
        twice = hook.select(F.col("u").alias("p"), F.col("p").alias("q"))
        jump = work.table(hook.join(twice, "p", "left").select("u", F.coalesce("q", "p").alias("p")), f"{name}_jump{step}")
        at = lambda side, to: jump.select(F.col("u").alias(side), F.col("p").alias(to))
        moved = pairs.join(at("a", "x"), "a").join(at("b", "y"), "b").where("x <> y")
        pairs = work.table(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"{name}_edges{step}")
        roots = work.table(roots.join(at("root", "next"), "root", "left").select("node", F.coalesce("next", "root").alias("root")), f"{name}_roots{step}")
        work.drop(*(f"{name}_{t}{step - 1}" for t in ("edges", "roots", "hook", "jump")))
    return spark.read.schema(roots.schema).parquet(work.path(f"{name}_roots{step}"))
