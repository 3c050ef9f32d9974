"""Sharding by weighted rendezvous hashing, in DataFrame operations only.

Every record key draws one exponential variate per shard, seeded by (key,
shard) and divided by the shard's weight; the shard with the smallest draw
wins.  A further shard only adds one more draw per key, so records either stay
or move to the new shard, and an added share ``w/(W+w)`` of them moves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import Workspace

#: Hash cells per shard within which slots are numbered; bounds the broadcast of cell offsets to shards * CELLS rows.
CELLS = 256


def _draw(keys: Sequence[str], shard: Column, weight: Column) -> Column:
    h = F.shiftrightunsigned(F.xxhash64(*[F.col(k) for k in keys], shard), 11)
    return -F.log((h.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))) / weight


def _best(keys: Sequence[str], weights: Sequence[float]) -> Column:
    w = F.array(*[F.lit(float(x)) for x in weights])
    shards = F.array(*[F.lit(i) for i, x in enumerate(weights) if x > 0])
    draws = F.transform(shards, lambda s: F.struct(_draw(keys, s, F.get(w, s)).alias("draw"), s.alias("shard")))
    return F.array_min(draws)


def assign(df: DataFrame, keys: Sequence[str], weights: Sequence[float], grown_weight: float = 1.0, shard_col: str = "shard", grown_col: str = "grown_shard") -> DataFrame:
    """Add ``shard_col`` and ``grown_col`` (the shard once one more of ``grown_weight`` exists).

    A null key is a key like any other (all its rows share a shard); equal
    draws go to the smaller shard; a shard of weight 0 gets nothing.  Rows are
    neither dropped nor merged.
    """
    if not any(x > 0 for x in weights) or any(x < 0 for x in weights):
        raise ValueError("weights must be non-negative and not all zero")
    new = F.lit(len(weights))
    draw = _draw(keys, new, F.lit(float(grown_weight))) if grown_weight > 0 else F.lit(float("inf"))
    out = df.withColumn("__best", _best(keys, weights))
    return out.withColumns({shard_col: F.col("__best.shard"), grown_col: F.when(draw < F.col("__best.draw"), new).otherwise(F.col("__best.shard"))}).drop("__best")


def number_slots(df: DataFrame, order: Sequence[str], work: Workspace, shards: int, shard_col: str = "shard", cells: int = CELLS) -> DataFrame:
    """Add ``slot``: gapless from 0 within each shard.

    Rows are numbered within (shard, hash cell) and shifted by the sizes of the
    cells before, so no task sorts a whole shard.  The shifts are at most
    ``shards * cells`` rows, hence the broadcast.
    """
    df = work.table(df.withColumn("__cell", F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(cells)).cast("int")), "sharded")
    before = Window.partitionBy(shard_col).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    sizes = df.groupBy(shard_col, "__cell").agg(F.count(F.lit(1)).alias("__n"))
    starts = sizes.select(shard_col, "__cell", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy(shard_col, "__cell").orderBy(*order)
    ranked = df.withColumn("__rank", F.row_number().over(within) - 1)
    return ranked.join(F.broadcast(starts), [shard_col, "__cell"]).withColumn("slot", (F.col("__start") + F.col("__rank")).cast("long")).drop("__cell", "__rank", "__start")


def shard_documents(docs: DataFrame, shards: int = 40, weights: Sequence[float] | None = None) -> DataFrame:
    """Digest of a sharded document table: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``key``: doc_id and the shard count alone decide.  Size is the
    text's UTF-8 bytes plus 16; a null text counts no bytes and the checksum of
    the empty string.  A null doc_id is one key.  Other columns of ``docs`` are
    not read, whatever their names.  An empty table gives an empty result.
    """
    weights = list(weights) if weights is not None else [1.0] * shards
    if len(weights) != shards:
        raise ValueError("one weight per shard")
    raw = F.coalesce(F.encode(F.col("text"), "UTF-8"), F.lit(b""))
    rows = docs.select(F.col("doc_id"), (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.lit("key").alias("law"))
    work = Workspace(docs.sparkSession, "rendezvous")
    out = number_slots(assign(rows, ["doc_id"], weights), ["doc_id", "size", "text_crc32"], work, shards)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
