"""A training corpus from documents, stage by stage.

Every stage reads all that the one before it kept, written as Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronofold.llm import decontaminate, jaccard_join, langid, mixing, rendezvous
from chronofold.llm.common import Workspace, scratch

#: Languages that the corpus keeps; None: every one that the labels teach.
LANGUAGES: list[str] | None = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents in none of LANGUAGES go (no letter, told from no random letters, or another language); unlabelled ones get theirs."""
    return langid.keep_identified(docs, LANGUAGES)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each linked group of rows that of the smallest id stays; ids shared or missing link nothing."""
    return jaccard_join.keep_representatives(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a benchmark item, or a segment of one, go."""
    return decontaminate.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: small sources are repeated up to twice; every document stays at least once."""
    return mixing.mix(docs, max_repetition=2.0)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sharding: each row's shard and slot by rendezvous hashing of its doc_id."""
    return rendezvous.shard_documents(docs)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", decontaminate_benchmark),
    ("mixing sources", mix_sources),
    ("sharding", shard),
]

#: The hashes that decide shards and mixtures have no SQL form; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        with scratch():  # a stage's own tables go when its result is written
            docs = work.table(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            work.drop(f"stage{k - 1}")
    return docs
