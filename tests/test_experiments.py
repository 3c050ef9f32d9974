"""Each experiment program on a small graph."""

from chronofold.operators import metrics as M
from chronofold.operators.compress import CompressionConfig
from chronofold.plans import experiments as X
from chronofold.sources import generators as G

QUICK = CompressionConfig(rank=3, residual_threshold_mode="quantile", residual_quantile=0.98)


def sbm(spark, seed=0, n=18):
    return G.sbm(spark, n=n, steps=3, communities=3, p_in=0.9, p_out=0.05, seed=seed)


def test_sweeps(spark):
    records = X.theory_sweep([("n12", lambda s: sbm(spark, s, 12)), ("n24", lambda s: sbm(spark, s, 24))], ["direct_svd"], QUICK, [0])
    slope = M.power_law_slope(X.frame(spark, records), "n", "mean_error").first()
    assert len(records) == 2 and slope.points == 2 and slope.slope is not None
    records = X.storage_sweep(sbm(spark), ["direct_svd", "robust_asym"], [1, 3], QUICK, heldout=0.1)
    assert len(records) == 4 and records[-1]["residual_nnz"] > 0 and all(r["ratio"] > 0 for r in records)
    records = X.attack_sweep(sbm(spark), lambda g, x, s: G.targeted_additions(g, x, s), [0.0, 0.2], ["sym_svd"], QUICK, [1], 3)
    assert records[0]["nmi"] > 0.8 and records[1]["max_error"] > 0


def test_query_benchmark(spark):
    graph = G.inject(sbm(spark), "sparse_spike", 0.02)
    records = X.query_benchmark(graph, ["robust_asym"], QUICK, links=20, tops=5, trends=5, k=3)
    assert [r["query"] for r in records] == ["links", "top", "trends", "anomalies", "community"]
    by = {r["query"]: r for r in records}
    assert by["links"]["rmse"] < 1 and 0 < by["top"]["recall"] <= 1 and by["anomalies"]["f1"] > 0.3 and all(r["queries_per_second"] > 0 for r in records)


def test_robustness_resumes(spark, tmp_path):
    args = (spark, lambda s: sbm(spark, s), ["sparse_spike"], [0.02], ["robust_asym"], QUICK)
    first = X.residual_robustness(*args, [0], str(tmp_path / "r"))
    assert first.first().f1_mean > 0.3
    again = X.residual_robustness(*args, [0, 1], str(tmp_path / "r"))
    assert again.first().f1_std is not None


def test_rank_diagnostic(spark):
    records = X.rank_diagnostic(lambda r, s: G.low_rank(spark, n=40, steps=5, rank=r, noise=0.0, seed=s), [3], 6, CompressionConfig(residual_threshold=1e9, ard_prior_beta=1.0), [1])
    assert [r["effective_rank"] for r in records] == [3, 6, 3]
    assert {r.method: r.accuracy for r in M.rank_accuracy(X.frame(spark, records)).collect()} == {"fixed_exact": 1.0, "fixed_over": 0.0, "ard": 1.0}
