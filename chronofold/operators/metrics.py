"""Quality of stores and query results, as aggregates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import EXACT_CELLS, quantiles
from .store import FactorStore, raw_sparse_bytes


def _squared(c: Column) -> Column:
    return c * c


def scored_cells(store: FactorStore, reference: DataFrame, include_residual: bool = False) -> DataFrame:
    """(t, u, v, x, score, e) over all cells, against ``reference`` (t, u, v, x); absent cells are 0."""
    cells = store.cells().join(reference, ["t", "u", "v"], "left").withColumn("x", F.coalesce("x", F.lit(0.0)))
    return store.score(cells, include_residual).withColumn("e", F.abs(F.col("score") - F.col("x")))


def relative_frobenius(cells: DataFrame) -> DataFrame:
    """One row ``relative_frobenius``, from scored cells."""
    return cells.agg(F.sqrt(F.sum(_squared(F.col("e"))) / F.greatest(F.sum(_squared(F.col("x"))), F.lit(1e-12))).alias("relative_frobenius"))


def _with_quantiles(cells: DataFrame, sizes: list[Column], wanted: dict[str, tuple[Column, float]], count: int) -> DataFrame:
    """One row of aggregates and quantiles, in one pass where the cells are few."""
    if count <= EXACT_CELLS:
        return cells.agg(*sizes, *[F.percentile(c, F.lit(q)).alias(name) for name, (c, q) in wanted.items()])
    row = cells.agg(*sizes)
    for name, (c, q) in wanted.items():
        row = row.crossJoin(quantiles(cells, c, {name: q}, count))  # one row each
    return row


def entrywise_errors(cells: DataFrame, percentiles: Iterable[float] = (50.0, 90.0, 99.0), count: int = 0) -> DataFrame:
    """One row: largest, mean and percentile absolute errors, from scored cells; ``count``: how many, if there are many."""
    sizes = [F.max("e").alias("max_error"), F.avg("e").alias("mean_error")]
    return _with_quantiles(cells, sizes, {f"p{p:g}": (F.col("e"), p / 100) for p in percentiles}, count)


def observed_errors(store: FactorStore, edges: DataFrame, include_residual: bool = False) -> DataFrame:
    """One row: count, rmse and mae over given edges (t, u, v, w); null errors if there are none."""
    d = F.col("score") - F.col("w")
    return store.score(edges, include_residual).agg(F.count(F.lit(1)).alias("edges"), F.sqrt(F.avg(_squared(d))).alias("rmse"), F.avg(F.abs(d)).alias("mae"))


def bound_report(cells: DataFrame, slack: float = 1e-12, count: int = 0) -> DataFrame:
    """One row over cells with ``e`` and ``bound``: coverage, violations, and sizes and ratios of bounds and errors."""
    b, e = F.col("bound"), F.col("e")
    ok = e <= b + slack
    sizes = [
        F.avg(ok.cast("double")).alias("coverage"), F.sum((~ok).cast("long")).alias("violations"), F.count(F.lit(1)).alias("cells"), F.max(F.greatest(e - b, F.lit(0.0))).alias("max_violation"),
        F.avg(b).alias("mean_bound"), F.max(b).alias("max_bound"), F.avg(e).alias("mean_error"), F.max(e).alias("max_error"),
    ]
    return _with_quantiles(cells, sizes, {"median_bound": (b, 0.5), "median_error": (e, 0.5)}, count)


def bound_tightness(cells: DataFrame) -> DataFrame:
    """One row ``tightness``: mean error over mean bound."""
    return cells.agg((F.avg("e") / F.greatest(F.avg("bound"), F.lit(1e-12))).alias("tightness"))


def residual_sparsity(store: FactorStore) -> DataFrame:
    cells = store.steps * store.n * store.m
    return store._residuals().agg(F.count(F.lit(1)).alias("nnz"), (F.count(F.lit(1)) / F.lit(float(max(cells, 1)))).alias("density"), (1 - F.count(F.lit(1)) / F.lit(float(max(cells, 1)))).alias("sparsity"))


def precision_recall(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: counts, precision, recall and F1 of predicted cells (t, u, v); 0 where nothing can be divided."""
    keys = ["t", "u", "v"]
    both = predicted.select(*keys).distinct().withColumn("p", F.lit(1)).join(truth.select(*keys).distinct().withColumn("q", F.lit(1)), keys, "full")
    counts = both.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("predicted"), F.coalesce(F.sum("q"), F.lit(0)).alias("actual"), F.coalesce(F.sum(F.col("p") * F.col("q")), F.lit(0)).alias("hits"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    pr = counts.withColumns({"precision": ratio(F.col("hits"), F.col("predicted")), "recall": ratio(F.col("hits"), F.col("actual"))})
    return pr.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def clustering_scores(labels: DataFrame, truth: str = "truth", found: str = "found") -> DataFrame:
    """One row: normalised mutual information (arithmetic mean) and adjusted Rand index of two labelings."""
    joint = labels.groupBy(F.col(truth).alias("a"), F.col(found).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    size = lambda k: joint.groupBy(k).agg(F.sum("n").alias("m"))
    pairs = lambda c: c * (c - 1) / 2
    total = joint.agg(F.sum("n").alias("total"))
    a, b = (size(k).agg(F.sum(F.col("m") * F.log(F.col("m").cast("double"))).alias(f"log_{k}"), F.sum(pairs(F.col("m"))).alias(f"pairs_{k}")) for k in ("a", "b"))
    j = joint.agg(F.sum(F.col("n") * F.log(F.col("n").cast("double"))).alias("log_ab"), F.sum(pairs(F.col("n"))).alias("pairs_ab"))
    row = total.crossJoin(a).crossJoin(b).crossJoin(j)  # one row each
    n = F.col("total").cast("double")
    ha, hb = F.log(n) - F.col("log_a") / n, F.log(n) - F.col("log_b") / n
    mi = F.log(n) + (F.col("log_ab") - F.col("log_a") - F.col("log_b")) / n
    expected = F.col("pairs_a") * F.col("pairs_b") / pairs(n)
    best = (F.col("pairs_a") + F.col("pairs_b")) / 2
    return row.select(F.when(ha + hb < 1e-12, 1.0).otherwise(mi / ((ha + hb) / 2)).alias("nmi"), F.when(F.abs(best - expected) < 1e-12, 1.0).otherwise((F.col("pairs_ab") - expected) / (best - expected)).alias("ari"))


def storage_report(store: FactorStore, raw_nnz: int, dtype_bytes: int = 8) -> dict[str, float]:
    """Bytes and ratios; with 4-byte factors as well."""
    out = {
        "factor_bytes": store.factor_bytes(dtype_bytes), "residual_bytes": store.residual_bytes(), "residual_nnz": store.residual_nnz(), "metadata_bytes": store.metadata_bytes(),
        "compressed_bytes": store.compressed_bytes(dtype_bytes), "raw_dense_bytes": store.raw_dense_bytes(), "raw_sparse_bytes": raw_sparse_bytes(raw_nnz, store.steps, store.n),
        **store.ratios(raw_nnz, dtype_bytes), "float32_factor_bytes": store.factor_bytes(4), "float32_compressed_bytes": store.compressed_bytes(4),
    }
    return out | {f"float32_{k}": v for k, v in store.ratios(raw_nnz, 4).items() if k != "compressed_vs_raw_dense_ratio"}


def ranking_report(scores: DataFrame, hits: Iterable[int] = (1, 3, 10)) -> DataFrame:
    """One row over (qid, positive, negative) pairs of scores: mean reciprocal rank, mean rank, hits@k.

    A positive's rank is one more than its negatives that score at least as high.
    """
    per = scores.groupBy("qid").agg((F.count_if(F.col("negative") >= F.col("positive")) + 1).alias("rank"))
    return per.agg(F.avg(1 / F.col("rank")).alias("mrr"), F.avg("rank").alias("mean_rank"), *[F.avg((F.col("rank") <= k).cast("double")).alias(f"hits_{k}") for k in hits])


def recall_at_k(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: mean overlap of found and true (qid, v) lists and its share of k."""
    hit = truth.select("qid", "v").join(found.select("qid", "v").withColumn("hit", F.lit(1)), ["qid", "v"], "left")
    per = hit.groupBy("qid").agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("overlap"), F.count(F.lit(1)).alias("wanted"))
    return per.agg(F.avg("overlap").alias("mean_overlap"), F.avg(F.col("overlap") / F.least("wanted", F.lit(k))).alias("recall"))


def improvement(store: FactorStore, cells: DataFrame) -> DataFrame:
    """One row over cells (t, u, v, w): rmse and mae with and without residuals, and the relative gain in rmse."""
    scored = store.with_residual(store.with_base(cells, "base"))
    a, b = F.col("base") - F.col("w"), F.col("base") + F.col("residual") - F.col("w")
    out = scored.agg(F.sqrt(F.avg(_squared(a))).alias("rmse_factor"), F.sqrt(F.avg(_squared(b))).alias("rmse_residual"), F.avg(F.abs(a)).alias("mae_factor"), F.avg(F.abs(b)).alias("mae_residual"))
    return out.withColumn("relative_improvement", F.when(F.col("rmse_factor") > 0, (F.col("rmse_factor") - F.col("rmse_residual")) / F.col("rmse_factor")).otherwise(0.0))


def group_summary(rows: DataFrame, by: list[str], values: list[str], ddof: int = 1) -> DataFrame:
    """Mean and standard deviation of each value by group."""
    std = F.stddev_samp if ddof else F.stddev_pop
    return rows.groupBy(*by).agg(*[x for v in values for x in (F.avg(v).alias(f"{v}_mean"), std(v).alias(f"{v}_std"))])


def power_law_slope(rows: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Slope of log y on log x over positive pairs; null with fewer than two."""
    good = rows.where((F.col(x) > 0) & (F.col(y) > 0))
    grouped = good.groupBy(*by) if by else good.groupBy()
    return grouped.agg(F.regr_slope(F.log(F.col(y).cast("double")), F.log(F.col(x).cast("double"))).alias("slope"), F.count(F.lit(1)).alias("points"))


def best_latency(rows: DataFrame) -> DataFrame:
    """Per query the method of least latency; rows without a latency do not compete, ties go to the first name."""
    good = rows.where(F.col("latency").isNotNull() & ~F.isnan("latency"))
    return good.groupBy("query").agg(F.min(F.struct("latency", "method")).alias("b")).select("query", "b.method", "b.latency")


def rank_accuracy(rows: DataFrame) -> DataFrame:
    return rows.groupBy("method").agg(F.avg((F.col("effective_rank") == F.col("true_rank")).cast("double")).alias("accuracy"))


def theory_curves(n: Column, steps: Column) -> tuple[Column, Column]:
    """sqrt(ln n / (n T)) and 1 / sqrt(T)."""
    return F.sqrt(F.log(n.cast("double")) / (n * steps)), 1 / F.sqrt(steps.cast("double"))


def throughput(seconds: float, requests: int) -> dict[str, float]:
    return {"ms_per_query": 1000 * seconds / max(requests, 1), "queries_per_second": requests / max(seconds, 1e-12)}
