import math
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from chronofold.operators import index
from chronofold.operators.index import ExactIndex

SF = "/root/testdata/sf0.01"
INF, NAN = math.inf, math.nan


def brute(rows, asked):
    """Scores summed in order; null after all others, NaN before them; ties at nine digits to the smaller id, a missing one first."""
    out = []
    for qid, q, exclude, k in asked:
        found = []
        for v, f in rows:
            if exclude is not None and (v is None or v == exclude):
                continue
            score = None if f is None or q is None or None in (*f[: len(q)], *q) or len(f) < len(q) else 0.0
            if score is not None:
                for a, b in zip(f, q):
                    score += a * b
            order = (2,) if score is None else (0,) if math.isnan(score) else (1, -round(score, 9))
            found.append((order, v is not None, v or 0, score))
        found.sort(key=lambda r: r[:3])
        out += [(qid, rank, v if there else None, "nan" if s is not None and math.isnan(s) else s) for rank, (_, there, v, s) in enumerate(found[:k], 1)]
    return out


def found(spark, rows, asked, rank):
    vectors = spark.createDataFrame(rows, "v int, f array<double>").repartition(3)
    got = ExactIndex(vectors, rank).search(spark.createDataFrame(asked, "qid int, q array<double>, exclude int, k int")).collect()
    return sorted((r.qid, r["rank"], r.v, "nan" if r.score is not None and math.isnan(r.score) else r.score) for r in got)


@pytest.mark.parametrize("block,cells", [(index.BLOCK, index.CELLS), (40, 60)])
def test_odd_rows_and_requests_are_ranked_as_by_brute_force(spark, monkeypatch, block, cells):
    monkeypatch.setattr(index, "BLOCK", block)
    monkeypatch.setattr(index, "CELLS", cells)
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-3, 4, 3).astype(float).tolist()) for i in range(120)]  # many equal scores
    rows += [(200 + i, [1.0, 2.0, 3.0 - i * 2e-10]) for i in range(20)]  # equal at nine digits only, the smaller id has the larger score
    rows += [(300 - i, [1.0, 2.0, 3.0 - i * 2e-10]) for i in range(20)]  # and the smaller score
    rows += [(400, None), (401, None), (402, [1.0, None, 2.0]), (403, [1.0, 2.0]), (404, [INF, 0.0, 1.0]), (405, [NAN, 0.0, 0.0]), (406, [1e308, 1e308, 1e308]), (407, [-INF, 1.0, 1.0]), (None, [3.0, 3.0, 3.0])]
    rows += [(5, [3.0, 3.0, 3.0])]  # a shared id
    asked = [(i, rng.integers(-3, 4, 3).astype(float).tolist(), i if i % 2 else None, 1 + i % 7) for i in range(30)]
    asked += [(50, [1.0, 2.0, 3.0], None, 12), (51, [1.0, 2.0, 3.0], 300, 12), (52, None, 0, 6), (53, [1.0, None, 1.0], None, 6), (54, [INF, 1.0, 1.0], None, 6), (55, [1e308, 1.0, 1.0], None, 6), (56, [0.0, 0.0, 0.0], 2, 200), (57, [1.0, 1.0, 1.0], None, 0)]
    assert found(spark, rows, asked, 3) == sorted(brute(rows, asked))


def test_no_rows_and_no_requests(spark):
    asked = [(1, [1.0], None, 3)]
    assert found(spark, [], asked, 1) == [] == found(spark, [(1, [1.0])], [], 1)


def test_neighbours_of_embeddings_match_the_sql_on_more_rows(spark, tmp_path):
    con = duckdb.connect()
    copies = f"SELECT (vec_id + 100000 * i)::BIGINT AS vec_id, list_transform(embedding, lambda x: (x * (1 + (i * 7919 + vec_id * 31) % 101 / 1000))::FLOAT) AS embedding, label FROM read_parquet('{SF}/embeddings.parquet'), range(32) t(i)"
    con.execute(f"COPY ({copies}) TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)")
    began = time.time()
    got = sorted(tuple(r) for r in entry.queries()["mips_embeddings"](spark, str(tmp_path)).collect())
    took = time.time() - began
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet')")
    want = sorted(con.execute(entry.oracle_sql()["mips_embeddings"]).fetchall())
    assert len(want) == 5 * con.execute("SELECT count(*) FROM embeddings WHERE vec_id % 20 = 0").fetchone()[0]
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want], abs=2e-6)
    assert took < 60  # one sorted row per pair took minutes


def test_a_task_gives_few_rows_per_request(spark):
    rows = spark.range(4000).select(F.col("id").alias("v"), F.array(F.lit(1.0), F.col("id") % 2 + F.lit(0.0)).alias("f"))  # two vectors, 2000 times each
    asked = spark.range(50).select(F.col("id").alias("qid"), F.array(F.lit(1.0), F.lit(1.0)).alias("q"), F.col("id").alias("exclude"), F.lit(3).alias("k"))
    exact = ExactIndex(rows, 2)
    assert exact._scored(asked, 3).count() <= 50 * 3 * spark.sparkContext.defaultParallelism
    got = {q: [r.v for r in exact.search(asked).where(F.col("qid") == q).orderBy("rank").collect()] for q in (1, 2)}
    assert got == {1: [3, 5, 7], 2: [1, 3, 5]}
