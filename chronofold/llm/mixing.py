"""Mixing sources to tempered weights, in DataFrame operations.

Source shares p become weights p^a / sum p^a.  The exponent a is bisected until
the weights meet a target entropy, or the most repeated source stays within a
repetition limit.  The weights are realised as whole passes over a source plus
one part pass over a prefix of a permutation of its blocks, cut to budget.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import Workspace

#: Blocks per source; rows of the block table up to which it is broadcast (beyond it is joined by a shuffle on source and block).
BLOCKS, BROADCAST_ROWS = 256, 200_000
#: Points tried at once while bisecting, and rounds: each round divides the interval by POINTS + 1.
POINTS, ROUNDS = 15, 8


def token_count(text: Column) -> Column:
    """White-space-separated words; none for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


class Mixture:
    """Tempered weights of the sources of ``docs`` (doc_id, text, source), and the blocks that realise them.

    ``target_entropy`` is a share of the largest possible entropy (log of the
    number of sources); ``max_repetition`` limits how often the most repeated
    source is passed, relative to the least.  Given both, the exponent is the
    larger of the two.  ``budget`` is in tokens; without one it is the least
    that passes every source once, so no document is lost.  Sources without
    tokens are passed once.  A null source is a source of its own.
    """

    def __init__(self, docs: DataFrame, target_entropy: float | None = None, max_repetition: float | None = 2.0, budget: float | None = None, blocks: int = BLOCKS, seed: int = 17):
        if (target_entropy is not None and not 0 <= target_entropy <= 1) or (max_repetition is not None and max_repetition < 1) or blocks < 1:
            raise ValueError("target_entropy is a share, max_repetition at least 1, blocks positive")
        self.spark, self.blocks, self.seed = docs.sparkSession, blocks, seed
        work = self.work = Workspace(self.spark, "mixing")
        rows = docs.select(*self.keys(), token_count(F.col("text")).alias("n"))
        rows = work.table(rows, "rows")
        self.by_block = work.table(rows.groupBy("key", "block").agg(F.sum("n").alias("n")), "by_block")
        totals = work.table(self.by_block.groupBy("key").agg(F.sum("n").alias("total")), "totals")
        corpus, sources = totals.where("total > 0").agg(F.coalesce(F.sum("total"), F.lit(0)), F.count(F.lit(1))).first()
        self.shares = totals.where("total > 0").select("key", "total", (F.col("total") / F.lit(max(1, corpus))).alias("p"))
        self.exponent = self._exponent(sources, target_entropy, max_repetition) if sources > 1 else 1.0
        z = self.shares.agg(F.sum(F.pow("p", F.lit(self.exponent)))).first()[0] or 1.0
        weighted = self.shares.withColumn("weight", F.pow("p", F.lit(self.exponent)) / F.lit(z))
        self.budget = float(budget) if budget is not None else float(weighted.agg(F.max(F.col("total") / F.col("weight"))).first()[0] or 0.0)
        want = F.col("weight") * F.lit(self.budget)
        passes = F.floor(want / F.col("total") + F.lit(1e-9))
        weighted = weighted.select("key", "total", "weight", passes.alias("passes"), F.greatest(want - passes * F.col("total"), F.lit(0.0)).alias("rest"))
        bare = totals.where("total = 0").select("key", "total", F.lit(0.0).alias("weight"), F.lit(1).cast("long").alias("passes"), F.lit(0.0).alias("rest"))
        self.weights = work.table(weighted.unionByName(bare), "weights")
        self.plan = self._plan(rows)
        work.drop("rows")

    def keys(self) -> tuple[Column, Column, Column]:
        key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null")).alias("key")
        h = F.xxhash64(F.lit(self.seed), F.col("doc_id"))
        return key, F.pmod(h, F.lit(self.blocks)).cast("int").alias("block"), h.alias("h")

    def _exponent(self, sources: int, entropy: float | None, repetition: float | None) -> float:
        """Sectioning search; every round is one aggregate over the sources, whatever their number."""
        ask = lambda exps: self.shares.agg(*[x for i, a in enumerate(exps) for x in (F.sum(F.pow("p", F.lit(a))).alias(f"z{i}"), F.sum(F.pow("p", F.lit(a)) * F.log("p")).alias(f"s{i}"))], F.min("p").alias("low"), F.max("p").alias("high")).first()

        def least(good) -> float:
            """The least exponent in [0, 1] that is good, if larger ones stay so; 1 if none is."""
            low, high = 0.0, 1.0
            for _ in range(ROUNDS):
                exps = [low + (high - low) * i / (POINTS + 1) for i in range(POINTS + 2)]
                r = ask(exps)
                ok = next((i for i, a in enumerate(exps) if good(a, r[f"z{i}"], r[f"s{i}"], r["low"], r["high"])), None)
                if ok is None:
                    return 1.0
                if ok == 0:
                    return exps[0]
                low, high = exps[ok - 1], exps[ok]
            return high

        found = []
        if entropy is not None:
            goal = entropy * math.log(sources) + 1e-12
            found.append(least(lambda a, z, s, low, high: math.log(z) - a * s / z <= goal))
        if repetition is not None:
            found.append(least(lambda a, z, s, low, high: (1 - a) * math.log(high / low) <= math.log(repetition) + 1e-12))
        return max(found, default=1.0)

    def _plan(self, rows: DataFrame) -> DataFrame:
        """key, block, weight, passes, whole (in the part pass), cut (largest hash of the part pass within the block)."""
        order = Window.partitionBy("key").orderBy("turn", "block").rowsBetween(Window.unboundedPreceding, 0)
        turns = self.by_block.join(self.weights, "key").withColumn("turn", F.xxhash64(F.lit(self.seed), "key", "block"))
        turns = turns.withColumn("upto", F.sum("n").over(order)).withColumn("left", F.col("rest") - (F.col("upto") - F.col("n")))
        turns = self.work.table(turns.select("key", "block", "n", "weight", "passes", "left", ((F.col("n") > 0) & (F.col("n") <= F.col("left"))).alias("whole")), "turns")
        edge = turns.where((F.col("left") > 0) & ~F.col("whole") & (F.col("n") > 0)).select("key", "block", "left")
        within = Window.partitionBy("key", "block").orderBy("h")
        cut = rows.join(edge, ["key", "block"]).withColumn("upto", F.sum("n").over(within)).where(F.col("upto") <= F.col("left")).groupBy("key", "block").agg(F.max("h").alias("cut"))
        return self.work.table(turns.join(cut, ["key", "block"], "left").select("key", "block", "weight", "passes", "whole", "cut"), "plan")

    def with_copies(self, docs: DataFrame) -> DataFrame:
        """``docs`` as struct ``row``, with key, block, weight and ``copies``."""
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
        plan = F.broadcast(self.plan) if self.plan.count() <= BROADCAST_ROWS else self.plan
        placed = docs.select(row, *self.keys()).join(plan, ["key", "block"])
        part = F.col("whole") | F.coalesce(F.col("h") <= F.col("cut"), F.lit(False))
        return placed.select("row", "key", "block", "weight", (F.col("passes") + part.cast("long")).alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the rows of ``docs`` as often as their source is passed, columns as they are.

    Repeated rows and rows of a null doc_id share their place in the
    permutation; an empty table gives an empty result.
    """
    placed = Mixture(docs, **options).with_copies(docs)
    often = placed.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return often.select(*[F.col(f"row.`{c}`") for c in docs.columns])


def mixture_plan(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, n_tokens, weight, block, copies for every row of ``docs``."""
    placed = Mixture(docs, **options).with_copies(docs.select("doc_id", "text", "source"))
    return placed.select("row.doc_id", "row.source", token_count(F.col("row.text")).alias("n_tokens"), F.round("weight", 9).alias("weight"), "block", "copies")
