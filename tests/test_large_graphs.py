"""Compressors on relations against the same ones on arrays, automatic relevance, negatives, and access paths."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofold.operators import compress as C
from chronofold.operators import kernels as K
from chronofold.operators import linalg, metrics, transforms
from chronofold.operators.compress import CompressionConfig, compress, config_from
from chronofold.operators.index import ProjectionIndex
from chronofold.plans.engine import QueryEngine
from chronofold.sources import bundles

from .test_compress import graph_of, low_rank_tensor, scores


@pytest.fixture(scope="module")
def noisy(spark):
    rng = np.random.default_rng(7)
    tensor = low_rank_tensor(24, 5, 3) + 0.05 * rng.normal(size=(5, 24, 24))
    return tensor, graph_of(spark, tensor)


@pytest.mark.parametrize("name,options", [("direct_svd", {}), ("sym_svd", {}), ("tensor_unfolding_svd", {}), ("cp_als", {"tensor_iterations": 4}), ("robust_asym", {"robust_iterations": 2, "residual_threshold_mode": "quantile"}), ("robust_asym", {"tensor_blend": 0.0, "residual_threshold": 0.2}), ("nmf", {})])
def test_relations_and_arrays_agree(monkeypatch, noisy, name, options):
    _, graph = noisy
    config = CompressionConfig(rank=3, **options)
    dense = compress(name, graph, config)
    monkeypatch.setattr(C, "DRIVER_CELLS", 24 * 24)
    if name == "robust_asym":
        monkeypatch.setattr(C, "DRIVER_CELLS", 100)
    tables = compress(name, graph, config)
    a, b = scores(dense), scores(tables)
    assert tables.rank == dense.rank and np.linalg.norm(a - b) < 1e-5 * np.linalg.norm(a)
    if name == "robust_asym":
        assert tables.residual_nnz() == dense.residual_nnz() > 0


def test_subspace_iteration_with_a_low_rank_part(spark):
    rng = np.random.default_rng(2)
    sparse = np.where(rng.random((30, 20)) < 0.2, rng.normal(size=(30, 20)), 0.0)
    u, v, c = np.linalg.qr(rng.normal(size=(30, 2)))[0], np.linalg.qr(rng.normal(size=(20, 2)))[0], np.array([9.0, 5.0])
    cells = spark.createDataFrame([(int(i), int(j), float(sparse[i, j])) for i, j in zip(*np.nonzero(sparse), strict=True)], "u int, v int, w double")
    table = lambda m: linalg.factor_frame(spark, m, "i")
    left, values, right = linalg.subspace_svd(cells, 30, 20, 3, low=(table(u), c, table(v)))
    want = np.linalg.svd(sparse + (u * c) @ v.T)
    assert np.allclose(values, want[1][:3], rtol=1e-6)
    got = np.array([r.f for r in left.orderBy("u").collect()]) * values @ np.array([r.f for r in right.orderBy("v").collect()]).T
    assert np.allclose(got, (want[0][:, :3] * want[1][:3]) @ want[2][:3], atol=2e-3)  # vectors settle later than values
    assert linalg.uv_gap(u, u) == 0 and linalg.uv_gap(u, -u) == pytest.approx(2)


@pytest.mark.parametrize("rank,noise", [(3, 0.0), (5, 0.0), (3, 0.02), (5, 0.02)])
def test_relevance_finds_the_rank_with_a_rising_bound(rank, noise):
    rng = np.random.default_rng(rank)
    tensor = low_rank_tensor(60, 8, rank, seed=rank) + noise * rng.normal(size=(8, 60, 60))
    left, _, right = K.truncated_svd(tensor.mean(0), 12)
    keep, found = K.ard_selection(tensor, left, right, floor=1e-8)
    assert keep.tolist() == list(range(rank)) and found["converged"]
    bounds = [h["bound"] for h in found["history"]]
    assert all(b >= a - 1e-9 * abs(a) for a, b in zip(bounds, bounds[1:], strict=False))
    first = K.ard_selection(tensor, left, right, iterations=1, tol=1e-15)[1]
    assert not first["converged"]
    with pytest.raises(RuntimeError):
        K.ard_selection(tensor, left, right, iterations=1, tol=1e-15, strict=True)
    K.ard_selection(tensor, left, right, iterations=1, tol=1e-15, least=12, strict=True)  # nothing to choose


def test_refined_directions_fit_no_worse():
    tensor = low_rank_tensor(20, 4, 2) + 0.01 * np.random.default_rng(0).normal(size=(4, 20, 20))
    left, values, right = K.truncated_svd(tensor.mean(0), 1)
    fit = lambda l_, r_: np.linalg.norm(tensor - np.einsum("uj,vj,tj->tuv", l_, r_, K.project(tensor, l_, r_)))
    a, b = K.refine_directions(tensor, left, right, K.project(tensor, left, right))
    assert np.linalg.norm(a) == pytest.approx(1) and fit(a, b) <= fit(left, right) + 1e-9


@pytest.mark.parametrize("cells", [10**6, 10])
def test_negatives_are_complete(monkeypatch, spark, cells):
    monkeypatch.setattr(transforms, "LISTED_CELLS", cells)
    rng = np.random.default_rng(1)
    tensor = np.stack([(rng.random((9, 9)) < p).astype(float) for p in (0.1, 0.45, 0.9, 1.0)])
    tensor[2].flat[:79] = 1.0  # two empty cells at most
    graph = graph_of(spark, tensor)
    asked = [(q, q % 4) for q in range(200)]
    got = {}
    for r in transforms.negative_samples(graph, spark.createDataFrame(asked, "qid long, t int"), 5, seed=3).collect():
        assert tensor[r.t, r.u, r.v] == 0 and r.t == r.qid % 4
        got.setdefault(r.qid, set()).add((r.u, r.v))
    for q, t in asked:
        assert len(got.get(q, ())) == min(5, int((tensor[t] == 0).sum()))
    spread = {c for q, s in got.items() if q % 4 == 0 for c in s}
    assert len(spread) > 0.6 * (tensor[0] == 0).sum()


def test_paths_follow_the_built_index(spark):
    tensor = low_rank_tensor(70, 2, 2)
    store = compress("direct_svd", graph_of(spark, tensor), CompressionConfig(rank=2))
    engine = QueryEngine(store)
    asked = spark.createDataFrame([(0, 1, 0, 3), (1, 2, 1, 64), (2, 3, 0, 65)], "qid long, u int, t int, k int")
    paths = lambda **o: {r.qid: r.path for r in engine.neighbors_optimized(asked, 1.0, **o).select("qid", "path").distinct().collect()}
    assert set(paths().values()) == {"factor_only_scan"}  # no index was built
    engine.index("ann", multiplier=30)
    assert paths() == {0: "indexed_ann_factor_only", 1: "indexed_ann_factor_only", 2: "factor_only_scan"}
    engine.index("exact")
    assert paths() == {0: "indexed_exact_factor_only", 1: "indexed_exact_factor_only", 2: "factor_only_scan"}
    assert set(paths(prefer_index=None).values()) == {"factor_only_scan"}
    plan = engine.neighbors_optimized(asked, 1.0)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
    found = metrics.recall_at_k(engine.indexed_neighbors(asked, mode="ann"), engine.top_neighbors(asked), 65).first()
    assert found.recall >= 0.9


def test_old_keys_and_metadata(tmp_path):
    config = config_from({"thinking_tensor_blend": 0.5, "thinking_tensor_rank": 3})
    assert (config.tensor_blend, config.tensor_rank) == (0.5, 3)
    bundles.write_outputs(str(tmp_path), {"a": 1.0}, {"b": 2})
    import json

    meta = json.loads((tmp_path / "run_metadata.json").read_text())
    assert meta["packages"]["pyspark"] and {"commit", "branch", "changed"} <= set(meta["git"])


def test_projected_candidates_reach_the_exact_neighbours(spark):
    rng = np.random.default_rng(11)
    rank, n = 12, 300
    x = rng.normal(size=(n, rank)) * 0.6 ** np.arange(rank)
    q = rng.normal(size=(40, rank))
    vectors = linalg.factor_frame(spark, x, "v")
    queries = linalg.factor_frame(spark, q, "qid").select("qid", F.col("f").alias("q"), F.lit(None).cast("int").alias("exclude"), F.lit(5).alias("k"))
    found = {}
    for r in ProjectionIndex(vectors, rank).search(queries).collect():
        found.setdefault(r.qid, set()).add(r.v)
    want = [set(np.argsort(-(x @ y))[:5].tolist()) for y in q]
    assert np.mean([len(found[i] & w) / 5 for i, w in enumerate(want)]) >= 0.9
    assert ProjectionIndex(vectors, rank, projection="gaussian").search(queries).count() == 200
    with pytest.raises(ValueError):
        ProjectionIndex(vectors, rank, projection="none")
