"""Compressors, kernels, thresholds and generators, against NumPy and planted truth."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofold.graph import TemporalGraph, guard_dense
from chronofold.operators import kernels as K
from chronofold.operators import linalg, metrics, residuals, transforms
from chronofold.operators.community import left_community
from chronofold.operators.compress import COMPRESSORS, CompressionConfig, available_compressors, compress, config_from, dense_threshold
from chronofold.operators.linalg import factor_frame
from chronofold.operators.store import FactorStore
from chronofold.plans.engine import QueryEngine
from chronofold.sources import generators as G


def graph_of(spark, tensor):
    rows = [(int(t), int(u), int(v), float(tensor[t, u, v])) for t, u, v in zip(*np.nonzero(tensor), strict=True)]
    return TemporalGraph("made", spark.createDataFrame(rows, "t int, u int, v int, w double"), tensor.shape[1], tensor.shape[0], tensor.shape[2])


def low_rank_tensor(n=40, steps=5, rank=3, seed=1):
    rng = np.random.default_rng(seed)
    left, right, time = rng.normal(size=(n, rank)), rng.normal(size=(n, rank)), rng.normal(1, 0.15, (steps, rank))
    return np.einsum("uj,vj,tj->tuv", left, right, time * np.linspace(1, 0.35, rank))


def scores(store):
    out = np.zeros((store.steps, store.n, store.m))
    for r in store.score(store.cells(), False).collect():
        out[r.t, r.u, r.v] = r.score
    return out


@pytest.fixture(scope="module")
def exact(spark):
    tensor = low_rank_tensor(20, 4)
    return tensor, graph_of(spark, tensor)


@pytest.mark.parametrize("name", sorted(set(COMPRESSORS) - {"nmf"}))
def test_every_compressor_reconstructs_low_rank(name, exact):
    tensor, graph = exact
    config = CompressionConfig(rank=3, tensor_iterations=50, residual_threshold=1e9)
    store = compress(name, graph, config)
    error = np.linalg.norm(scores(store) - tensor) / np.linalg.norm(tensor)
    limit = {"sym_svd": 1.0, "rpca_svd": 0.95, "cp_als": 0.02}.get(name, 0.45)
    assert store.rank <= 3 and error < limit, error


def test_nmf_separates_blocks(spark):
    tensor = np.zeros((2, 6, 6))
    tensor[:, :3, :3], tensor[:, 3:, 3:] = 1.0, 2.0
    store = compress("nmf", graph_of(spark, tensor), CompressionConfig(rank=2))
    assert np.allclose(scores(store) > 1e-6, tensor > 0) and (np.array(store.lambdas) > 0).all()


def test_direct_svd_is_numpy_svd(exact):
    tensor, graph = exact
    store = compress("direct_svd", graph, CompressionConfig(rank=2))
    u, s, vt = np.linalg.svd(tensor.mean(0))
    u, v = u[:, :2], vt[:2].T
    want = np.einsum("uj,tj,vj->tuv", u, K.project(tensor, u, v), v)
    assert np.allclose(scores(store), want) and np.allclose(store.lambdas, s[:2])


def test_distributed_svd(spark, exact):
    tensor, graph = exact
    left, values, right = linalg.subspace_svd(transforms.mean_snapshot(graph.edges, 4), 20, 20, 3, iterations=25)
    assert np.allclose(values, np.linalg.svd(tensor.mean(0))[1][:3], rtol=1e-4)
    x, y = (np.array([r.f for r in d.orderBy(k).collect()]) for d, k in ((left, "u"), (right, "v")))
    assert np.allclose((x * values) @ y.T, tensor.mean(0), atol=1e-3 * np.abs(tensor).max())


def test_ard_finds_the_planted_rank(spark):
    tensor = low_rank_tensor()
    graph = graph_of(spark, tensor)
    fixed = compress("robust_asym", graph, CompressionConfig(rank=3, residual_threshold=1e9))
    chosen = compress("robust_asym", graph, CompressionConfig(rank=6, rank_selection_mode="ard", ard_max_rank=6, ard_prior_alpha=0.01, ard_prior_beta=1.0, residual_threshold=1e9))
    assert chosen.rank == 3
    error = [np.linalg.norm(scores(s) - tensor) for s in (fixed, chosen)]
    assert error[1] <= 1.05 * error[0]


def test_storage_gate_drops_residuals(spark):
    tensor = np.ones((2, 20, 20))
    graph = graph_of(spark, tensor)
    store = compress("direct_svd", graph, CompressionConfig(rank=1))
    full = store.with_(residuals=graph.edges.select("t", "u", "v", F.lit(10.0).alias("value")))
    report = residuals.storage_gate(full, 800, 1.0, "drop_residual")
    found = report.diagnostics["storage_gate"]
    assert report.residuals is None and found["ratio_before"] > 1 >= found["ratio_after"]
    assert (found["accepted_before"], found["residual_dropped"], found["accepted_after"]) == (False, True, True)
    with pytest.raises(ValueError):
        residuals.storage_gate(full, 800, 1.0, "raise")
    with pytest.raises(ValueError):
        residuals.storage_gate(full, 800, 1.0, "shrink")


def test_thresholds_agree(spark):
    rng = np.random.default_rng(0)
    e = rng.normal(size=(3, 6, 6)) ** 3
    cells = spark.createDataFrame([(t, u, v, float(e[t, u, v])) for t in range(3) for u in range(6) for v in range(6)], "t int, u int, v int, e double")
    for mode in ("quantile", "mad", "hybrid"):
        for multiplier in (2.0, 45.0):
            config = CompressionConfig(residual_threshold_mode=mode, residual_mad_multiplier=multiplier, residual_quantile=0.9, residual_threshold_scale=1.5)
            got = residuals.threshold_row(cells, e.size, mode, q=0.9, multiplier=multiplier, scale=1.5).first()[0]
            assert got == pytest.approx(dense_threshold(np.abs(e), config))
    zero = cells.withColumn("e", F.lit(2.0))
    assert residuals.threshold_row(zero, e.size, "mad").first()[0] == 3.0  # no spread: nothing is kept
    assert residuals.kept_residuals(cells.withColumn("e", F.lit(2.0)), 2.0).count() == 108
    assert residuals.kept_residuals(cells.withColumn("e", F.lit(2.0)), 2.0, strict=True).count() == 0


def test_validation(spark, exact):
    _, graph = exact
    assert available_compressors(False) == ["direct_svd", "robust_asym", "sym_svd", "tensor_unfolding_svd"]
    with pytest.raises(ValueError, match="direct_svd"):
        compress("zip", graph)
    with pytest.raises(KeyError):
        config_from({}, no_such=1)
    with pytest.warns(UserWarning):
        assert config_from({"rank": 3, "residual_percentile": 0.9}).rank == 3
    for bad in ({"rank_pruning_mode": "x"}, {"asym_split_mode": "x"}, {"tensor_rank_energy": 0.0}):
        with pytest.raises(ValueError):
            compress("direct_svd", graph, CompressionConfig(**bad))
    with pytest.raises(ValueError):
        compress("direct_svd", graph, CompressionConfig(rank_selection_mode="x"))
    with pytest.raises(ValueError):
        compress("robust_asym", graph.with_(steps=1))
    with pytest.raises(ValueError):
        compress("sym_svd", graph.with_(m=7))
    with pytest.raises(MemoryError):
        guard_dense(100_000, 10)


def test_kernels():
    rng = np.random.default_rng(3)
    low = rng.normal(size=(30, 2)) @ rng.normal(size=(2, 30))
    spikes = np.where(rng.random((30, 30)) < 0.05, 10.0, 0.0)
    got, sparse, _ = K.robust_pca(low + spikes, 500, 1e-7)
    assert np.abs(got - low).max() < 1e-3 and np.abs(sparse - spikes).max() < 1e-3
    w, h = K.nmf(np.abs(low), 6)
    assert (w >= 0).all() and (h >= 0).all() and np.linalg.norm(w @ h - np.abs(low)) < 0.5 * np.linalg.norm(low)
    tensor = low_rank_tensor(12, 4)
    assert np.allclose(K.tucker_hooi(tensor, (3, 3, 3), 30), tensor)
    assert K.digamma(1.0) == pytest.approx(-0.5772156649015329) and K.digamma(0.5) == pytest.approx(-1.9635100260214235)


def test_pruning(exact):
    _, graph = exact
    store = compress("direct_svd", graph, CompressionConfig(rank=6, rank_pruning_mode="ard_like", rank_pruning_threshold=0.05))
    assert store.rank == 3 and store.diagnostics["pruning_history"] == [3]
    a, b = np.eye(4)[:, :2], np.eye(4)[:, 2:]
    assert linalg.subspace_distance(a, a[:, ::-1]) == pytest.approx(0) and linalg.subspace_distance(a, b) == pytest.approx(1)


def test_sbm_and_communities(spark):
    graph = G.sbm(spark, n=36, steps=3, communities=3, p_in=0.9, p_out=0.05, seed=2)
    flipped = graph.edges.select("t", F.col("v").alias("u"), F.col("u").alias("v"), "w")
    assert graph.edges.exceptAll(flipped).count() == 0 and graph.edges.where("u = v").count() == 0
    store = compress("sym_svd", graph, CompressionConfig(rank=3))
    engine = QueryEngine(store)
    labels = engine.community_cached(1, 3).join(graph.nodes, F.col("u") == F.col("idx")).select(F.col("community").alias("truth"), F.col("label").alias("found"))
    got = metrics.clustering_scores(labels).first()
    assert got.nmi > 0.9 and got.ari > 0.9
    engine.community_batch([1, 1], 3)
    assert engine.cache_stats()["community_hits"] == 2
    assert left_community(store, 3).select("label").distinct().count() == 3


@pytest.mark.parametrize("kind", G.ATTACKS)
def test_attacks(spark, kind):
    base = G.sbm(spark, n=20, steps=2, communities=2, seed=1)
    hit = G.inject(base, kind, 0.05, 4.0)
    cells = {(r.t, r.u, r.v) for r in hit.attack.collect()}
    before = {(r.t, r.u, r.v): r.w for r in base.edges.collect()}
    after = {(r.t, r.u, r.v): r.w for r in hit.edges.collect()}
    assert len(cells) == 2 * round(0.05 * 380) and all(u != v for _, u, v in cells)
    assert {k for k in set(before) | set(after) if before.get(k, 0) != after.get(k, 0)} <= cells
    if kind == "targeted_cross_community":
        side = {r.idx: r.community for r in base.nodes.collect()}
        assert all(side[u] != side[v] and after[t, u, v] == 1.0 for t, u, v in cells)
    if kind == "sparse_spike":
        assert all(after[k] == before.get(k, 0) + 4.0 for k in cells)
    with pytest.raises(ValueError):
        G.inject(base, "none")


def test_other_generators(spark):
    g = G.low_rank(spark, noise=0.0)
    truth = {(r.t, r.u, r.v): r.p for r in g.truth.collect()}
    assert all(abs(truth[r.t, r.u, r.v] - r.w) < 1e-12 for r in g.edges.collect())
    for noise in ("iid", "heteroskedastic_entry", "heteroskedastic_node"):
        h = G.theory_sbm(spark, n=16, steps=2, communities=2, noise=noise)
        assert h.edges.exceptAll(h.edges.select("t", F.col("v").alias("u"), F.col("u").alias("v"), "w")).count() == 0
    c = G.correlated_sbm(spark, n=30, steps=6, communities=2, alpha=0.9, sigma=1.0)
    e = c.edges.join(c.truth, ["t", "u", "v"], "left").select("t", "u", "v", (F.col("w") - F.coalesce("p", F.lit(0.0))).alias("e"))
    pair = e.alias("x").join(e.alias("y"), (F.col("x.t") == 4) & (F.col("y.t") == 5) & (F.col("x.u") == F.col("y.u")) & (F.col("x.v") == F.col("y.v")))
    assert pair.agg(F.corr("x.e", "y.e")).first()[0] > 0.5
    with pytest.raises(ValueError):
        G.correlated_sbm(spark, alpha=1.0)
    s = G.spiked(spark, n=12, steps=2)
    assert s.truth.where("u = v").count() == 0
    base = G.sbm(spark, n=20, steps=2, communities=2)
    more = G.targeted_additions(base, 0.1)
    assert more.edges.count() == base.edges.count() + more.attack.count() and more.attack.count() > 0
    fake = G.fake_nodes(base, 0.1)
    assert fake.n == 22 and fake.attack.where("u >= 20").count() == 2 * 2 * 5


def test_metrics_on_nothing(spark, exact):
    _, graph = exact
    store = compress("direct_svd", graph, CompressionConfig(rank=2))
    row = metrics.observed_errors(store, graph.edges.limit(0)).first()
    assert row.edges == 0 and row.rmse is None
    none = spark.createDataFrame([], "t int, u int, v int")
    assert metrics.precision_recall(none, none).first().f1 == 0.0
    report = metrics.storage_report(store, graph.edges.count())
    assert report["factor_bytes"] == (20 + 20 + 4 + 1) * 2 * 8 and "float32_compression_ratio" in report
    assert metrics.throughput(2.0, 4) == {"ms_per_query": 500.0, "queries_per_second": 2.0}
    with pytest.raises(ValueError):
        transforms.stitch_report(graph.edges, [1])
    with pytest.raises(ValueError):
        transforms.heldout_split(graph, 1.5)
    for kind in ("link", "top", "community", "trend"):
        assert transforms.workload(graph, kind, 7).count() == 7
    assert isinstance(store, FactorStore) and factor_frame(spark, np.eye(2), "u").count() == 2


def test_relational_robust_matches_driver(spark, exact, monkeypatch):
    from chronofold.operators import compress as C

    _, graph = exact
    config = CompressionConfig(rank=3, tensor_blend=0.0, residual_threshold_mode="quantile", robust_iterations=1)
    a = scores(compress("robust_asym", graph, config))
    monkeypatch.setattr(C, "DRIVER_CELLS", 100)
    b = scores(compress("robust_asym", graph, config))
    assert np.abs(a - b).max() < 1e-3 * np.abs(a).max()
