"""Quantiles of both ways against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofold.operators import metrics, quantiles, residuals
from chronofold.operators.compress import CompressionConfig, dense_threshold

WANTED = {"least": 0.0, "low": 0.013, "mid": 0.5, "near": 0.50001, "high": 0.98, "most": 1.0}


@pytest.fixture(scope="module", params=["spread", "tied", "few"])
def values(request):
    rng = np.random.default_rng(3)
    drawn = {"spread": rng.normal(size=90_000) ** 3, "tied": np.where(rng.random(90_000) < 0.7, 0.0, rng.integers(-5, 50, 90_000)), "few": rng.normal(size=3)}[request.param]
    return np.asarray(drawn, float), rng.integers(0, 3, len(drawn))


def table(spark, values):
    import pandas as pd

    numbers, groups = values
    return spark.createDataFrame(pd.DataFrame({"t": groups.astype(np.int32), "e": numbers})).repartition(5)


@pytest.mark.parametrize("limit", [quantiles.EXACT_CELLS, 0])
def test_quantiles_are_exact_at_every_size(spark, monkeypatch, values, limit):
    monkeypatch.setattr(quantiles, "EXACT_CELLS", limit)
    numbers, groups = values
    rows = table(spark, values)
    got = quantiles.quantiles(rows, F.col("e"), WANTED, len(numbers)).collect()
    assert len(got) == 1
    for name, q in WANTED.items():
        assert got[0][name] == pytest.approx(np.quantile(numbers, q), rel=1e-9, abs=1e-12)
    by = quantiles.quantiles(rows, F.col("e"), WANTED, len(numbers), ["t"]).collect()
    assert sorted(r.t for r in by) == sorted(set(groups.tolist()))
    for r in by:
        for name, q in WANTED.items():
            assert r[name] == pytest.approx(np.quantile(numbers[groups == r.t], q), rel=1e-9, abs=1e-12)


@pytest.mark.parametrize("limit", [quantiles.EXACT_CELLS, 0])
def test_nothing_and_nulls(spark, monkeypatch, limit):
    monkeypatch.setattr(quantiles, "EXACT_CELLS", limit)
    none = spark.createDataFrame([], "t int, e double")
    assert [r.mid for r in quantiles.quantiles(none, F.col("e"), {"mid": 0.5}, 1).collect()] == [None]
    assert quantiles.quantiles(none, F.col("e"), {"mid": 0.5}, 1, ["t"]).collect() == []
    some = spark.createDataFrame([(0, 1.0), (0, None), (0, 4.0)], "t int, e double")
    assert quantiles.quantiles(some, F.col("e"), {"mid": 0.5}, 3).first().mid == 2.5


def test_thresholds_and_reports_agree_at_every_size(spark, monkeypatch, values):
    numbers, _ = values
    cells = table(spark, values)
    bounded = cells.withColumn("e", F.abs("e")).withColumn("bound", F.col("e") * 2 + 1)
    count = 1 + quantiles.EXACT_CELLS
    for mode in ("quantile", "hybrid"):
        config = CompressionConfig(residual_threshold_mode=mode, residual_mad_multiplier=2.0, residual_quantile=0.9)
        for n in (0, count):
            got = residuals.threshold_row(cells, n, mode, q=0.9, multiplier=2.0).first()[0]
            assert got == pytest.approx(dense_threshold(np.abs(numbers), config), rel=1e-9)
    sigma = [residuals.centred_sigma(cells, n).first()[0] for n in (0, count)]
    assert sigma[0] == pytest.approx(sigma[1], rel=1e-9)
    for report in (metrics.entrywise_errors, metrics.bound_report):
        few, many = (report(bounded, count=n).first().asDict() for n in (0, count))
        assert few == pytest.approx(many, rel=1e-9)
