"""The corpus pipeline against its stages run by hand and a brute-force version."""

import random

import corpus_pipeline
from chronofold.llm import decontaminate, queries
from pyspark.sql import functions as F

from .test_operators import brute_components, brute_leaks


def test_pipeline(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(90).withColumn("extra", F.lit(1))
    rng = random.Random(6)
    noise = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(80))  # letters in no language
    extra = spark.createDataFrame([(9000, None, "en", "s", 0, 1), (9001, "12 34", "en", "s", 5, 1), (9002, noise, None, "s", 5, 1)], source.schema)
    source.union(extra).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(str(tmp_path / "benchmark.parquet")).collect()]
    at = docs
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        at = stage(spark, at, str(tmp_path))
        if k < 4:
            assert at.columns == docs.columns
        at.write.parquet(str(tmp_path / f"stage{k}"))
        at = spark.read.parquet(str(tmp_path / f"stage{k}"))
        kept.append(sorted(r.doc_id for r in at.select("doc_id").collect()))
    told = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t) and i != 9002]
    assert kept[0] == sorted(i for i, _ in told)
    parts = brute_components(told)
    single = [(i, t) for i, t in told if parts[i][1] == i]
    assert kept[1] == sorted(i for i, _ in single)
    exact = [(i, t) for i, t in items if t]
    short = [(i, t) for i, t in single if len(t) < 4000]
    leaks = {i for i, _ in brute_leaks(short, exact)}
    assert leaks == {i for i, _ in short} - set(kept[2])
    assert set(kept[3]) == set(kept[2]) and kept[4] == kept[3] and len(kept[3]) <= 2 * len(kept[2]) + 1
    assert kept[4] == sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert decontaminate.EDITS < 0.1 and set(queries.ORACLE) <= set(queries.QUERIES)
