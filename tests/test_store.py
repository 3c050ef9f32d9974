"""Stores and queries on hand-made graphs, against plain NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofold.operators.linalg import factor_frame
from chronofold.operators.store import FactorStore, choose_format, residual_bytes
from chronofold.plans import sqlapi
from chronofold.plans.engine import QueryEngine
from chronofold.sources.bundles import load_store, save_store

L = np.array([[1.0, 2.0], [3.0, -1.0], [0.5, 4.0]])
R = np.array([[2.0, 1.0], [1.0, 1.0], [-1.0, 3.0]])
W = np.array([[1.0, 0.5], [2.0, -1.0]])
LAM = (2.0, 0.5)
RES = [(1, 0, 2, 5.0), (1, 0, 2, 1.0), (0, 2, 1, -3.0)]


def dense(residual=True):
    out = np.einsum("j,uj,vj,tj->tuv", LAM, L, R, W)
    if residual:
        for t, u, v, x in RES:
            out[t, u, v] += x
    return out


@pytest.fixture(scope="module")
def store(spark):
    res = spark.createDataFrame(RES, "t int, u int, v int, value double")
    return FactorStore(factor_frame(spark, L, "u"), factor_frame(spark, R, "v"), factor_frame(spark, W, "t"), LAM, 3, 3, 2, residuals=res)


def test_link_scores(store):
    for residual in (True, False):
        got = {(r.t, r.u, r.v): r.score for r in store.score(store.cells(), residual).collect()}
        want = dense(residual)
        assert len(got) == 18 and all(abs(want[k] - x) < 1e-9 for k, x in got.items())
    assert store.link_score(0, 2, 1) == pytest.approx(dense()[1, 0, 2])
    assert store.residual_value(1, 0, 2) == 6.0 and store.residual_value(0, 0, 0) == 0.0
    for bad in ((-1, 0, 0), (3, 0, 0), (0, 3, 0), (0, 0, 2)):
        with pytest.raises(IndexError):
            store.link_score(*bad)


def test_top_neighbors(store):
    engine = QueryEngine(store)
    for residual in (True, False):
        for t in (0, 1):
            for u in range(3):
                row = dense(residual)[t, u]
                want = sorted((v for v in range(3) if v != u), key=lambda v: (-round(row[v], 9), v))
                for index in (False, True):
                    got = engine.top_neighbor(u, t, 5, residual, use_index=index)
                    assert [v for v, _ in got] == want and np.allclose([s for _, s in got], row[want])
    assert engine.top_neighbor(0, 0, 0) == []
    with pytest.raises(ValueError):
        engine.index("tree")
    assert len(engine.top_neighbor(0, 0, 3, exclude_self=False)) == 3


def test_ties_go_to_the_smaller_id(spark):
    ones = factor_frame(spark, np.ones((4, 1)), "u")
    s = FactorStore(ones, ones.withColumnRenamed("u", "v"), factor_frame(spark, np.ones((1, 1)), "t"), (1.0,), 4, 4, 1)
    assert [v for v, _ in QueryEngine(s).top_neighbor(2, 0, 3)] == [0, 1, 3]


def test_plan_paths(store, spark):
    engine = QueryEngine(store)
    assert engine.top_neighbor_optimized(0, 1, 2, 10.0).path == "factor_only_scan"
    engine.index("exact")
    assert engine.top_neighbor_optimized(0, 1, 2, 10.0).path == "indexed_exact_factor_only"
    plan = engine.top_neighbor_optimized(0, 1, 2, 5.9)
    assert plan.path == "indexed_exact_residual" and plan.estimated_error_bound == 0.0 and plan.satisfied_error_tolerance
    assert engine.top_neighbor_optimized(0, 1, 2, 5.9, prefer_index=None).path == "factor_residual_scan"
    assert engine.top_neighbor_optimized(0, 1, 2, 5.9, prefer_index="ann").path == "indexed_ann_residual"
    raw = spark.createDataFrame([(1, 0, 1, 2.0)], "t int, u int, v int, w double")
    plan = QueryEngine(store, raw).top_neighbor_optimized(0, 1, 1, 1.0)
    assert plan.path == "raw_fallback" and plan.neighbors == [(1, 2.0)]


def test_anomalies_are_strict(store, spark):
    engine = QueryEngine(store)
    assert engine.anomaly_detect(0, 3.0).count() == 0 and engine.anomaly_detect(0, 2.99).count() == 1
    assert QueryEngine(store.with_(residuals=None)).anomaly_detect(0, 0.0).count() == 0
    asked = spark.createDataFrame([(0, 0, 2.0), (1, 1, 4.0)], "qid long, t int, threshold double")
    assert {(r.qid, r.value) for r in engine.anomalies(asked).collect()} == {(0, -3.0), (1, 5.0)}


def test_trend(store):
    engine = QueryEngine(store)
    assert engine.temporal_trend(0, 2, 0, 1) == pytest.approx(dense()[:, 0, 2].tolist())
    assert engine.temporal_trend_cached(0, 2, 0, 1) == engine.temporal_trend_cached(0, 2, 0, 1)
    assert engine.cache_stats()["trend_hits"] == 1
    engine.clear_caches()
    assert engine.cache_stats()["trends"] == 0
    with pytest.raises(ValueError):
        engine.temporal_trend(0, 0, 1, 0)


def test_bounds(store, spark):
    edges = spark.createDataFrame([(t, u, v, float(dense()[t, u, v]) + 0.1 * (u - v)) for t in range(2) for u in range(3) for v in range(3)], "t int, u int, v int, w double")
    s = store.precompute_bounds(edges, 2.0)
    w = np.array([[[dense()[t, u, v] + 0.1 * (u - v) for v in range(3)] for u in range(3)] for t in range(2)])
    sigma = max(np.median(np.abs(w[t] - dense()[t])) / 0.6745 for t in range(2))
    mu = np.maximum(w.sum(2).mean(0) / 3, 1 / 3)
    want = 2.0 * sigma * np.sqrt(2 * np.log(3)) / np.sqrt(6) * (mu[:, None] ** -0.5 + mu[None, :] ** -0.5)
    got = {(r.u, r.v): r.bound for r in s.with_bound(s.cells(0)).collect()}
    assert all(got[u, v] == pytest.approx(want[u, v]) for u in range(3) for v in range(3))
    with_out = {(r.t, r.u, r.v): r.bound for r in s.error_bound(s.cells(), include_residual=False).collect()}
    assert with_out[1, 0, 2] == pytest.approx(want[0, 2] + 6.0)
    r = QueryEngine(s).link_prob_optimized(0, 2, 1, float(want[0, 2]) + 0.1)
    assert r.used_residual and r.satisfied_error_tolerance and r.value == pytest.approx(dense()[1, 0, 2])
    r = QueryEngine(s).link_prob_optimized(0, 0, 1, float(want[0, 0]) + 0.1)
    assert not r.used_residual and r.to_dict()["method"] == "factor_only"
    assert QueryEngine(store).link_prob_result(0, 0, 0).error_bound is None
    with pytest.raises(ValueError):
        store.precompute_bounds(edges, -1.0)
    with pytest.raises(ValueError):
        store.with_(m=4).precompute_bounds(edges)


def test_bytes():
    assert residual_bytes(10, 2, 3, "temporal_coo") == 200 and residual_bytes(10, 2, 3, "csr") == 152
    assert choose_format(10, 2, 3, "auto") == "csr" and choose_format(4, 2, 3, "auto") == "temporal_coo"
    with pytest.raises(ValueError):
        choose_format(1, 1, 1, "zip")


def test_save_and_load(store, spark, tmp_path):
    save_store(store, str(tmp_path / "s"))
    back = load_store(spark, str(tmp_path / "s"))
    assert back.lambdas == LAM and back.residual_nnz() == 3
    key = lambda r: (r.t, r.u, r.v)
    a, b = (sorted(x.score(x.cells()).select("t", "u", "v", F.round("score", 9).alias("score")).collect(), key=key) for x in (store, back))
    assert a == b
    meta = next((tmp_path / "s" / "meta").glob("part-*"))
    meta.write_text(meta.read_text().replace('"schema_version": 1', '"schema_version": 2'))
    for crc in (tmp_path / "s" / "meta").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(ValueError, match="newer"):
        load_store(spark, str(tmp_path / "s"))


def test_sql_functions(store, spark):
    sqlapi.register(store, "tst")
    assert spark.sql("SELECT score FROM tst_link(0, 2, 1)").first()[0] == pytest.approx(dense()[1, 0, 2])
    assert [r.v for r in spark.sql("SELECT * FROM tst_top(0, 1, 2) ORDER BY rank").collect()] == [v for v, _ in QueryEngine(store).top_neighbor(0, 1, 2)]
    assert [r.score for r in spark.sql("SELECT * FROM tst_trend(0, 2, 0, 1) ORDER BY t").collect()] == pytest.approx(dense()[:, 0, 2].tolist())
    assert spark.sql("SELECT * FROM tst_anomalies(1, 4.0)").count() == 1
