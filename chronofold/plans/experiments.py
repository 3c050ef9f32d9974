"""Experiment programs: sweeps over generators, compressors and attacks, one record per run."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import TemporalGraph
from ..operators import metrics as M
from ..operators.community import left_community
from ..operators.compress import CompressionConfig, compress
from ..operators.store import FactorStore
from ..operators.transforms import heldout_split, workload
from ..sources import generators as G
from ..sources.bundles import append_records, pending
from .engine import QueryEngine

Record = dict[str, Any]


def frame(spark: SparkSession, records: list[Record]) -> DataFrame:
    """Records of driver-side runs as a DataFrame."""
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame(records))


def fit(name: str, graph: TemporalGraph, config: CompressionConfig) -> tuple[FactorStore, float]:
    began = time.perf_counter()
    store = compress(name, graph, config)
    return store, time.perf_counter() - began


def truth_errors(store: FactorStore, graph: TemporalGraph) -> Record:
    """Largest and mean entrywise error and relative Frobenius error against the planted truth."""
    reference = graph.truth.withColumnRenamed("p", "x") if graph.truth is not None else graph.edges.withColumnRenamed("w", "x")
    cells = M.scored_cells(store, reference)
    row = M.entrywise_errors(cells, ()).crossJoin(M.relative_frobenius(cells)).first()
    return {"max_error": row.max_error, "mean_error": row.mean_error, "relative_frobenius": row.relative_frobenius}


def community_nmi(store: FactorStore, graph: TemporalGraph, k: int, left_only: bool = True) -> float:
    """Agreement of the store's communities with the planted ones; nodes without one are left out."""
    found = left_community(store, k) if left_only else QueryEngine(store).community(store.steps - 1, k)
    pairs = found.join(graph.nodes.where("community is not null").select(F.col("idx").alias("u"), F.col("community").alias("truth")), "u")
    return M.clustering_scores(pairs.withColumnRenamed("label", "found")).first().nmi


def theory_sweep(settings: Iterable[tuple[str, Callable[[int], TemporalGraph]]], methods: Iterable[str], config: CompressionConfig, seeds: Iterable[int]) -> list[Record]:
    """Errors and seconds of each method on each named setting (a function of the seed)."""
    out = []
    for name, make in settings:
        for seed in seeds:
            graph = make(seed)
            for method in methods:
                store, seconds = fit(method, graph, config)
                out.append({"setting": name, "seed": seed, "method": method, "n": graph.n, "steps": graph.steps, "seconds": seconds, **truth_errors(store, graph)})
    return out


def storage_sweep(graph: TemporalGraph, methods: Iterable[str], ranks: Iterable[int], config: CompressionConfig, heldout: float = 0.0) -> list[Record]:
    """Errors against bytes by rank; with ``heldout`` the errors are of entries left out, with and without residuals."""
    split = heldout_split(graph, heldout) if heldout else graph
    nnz = split.edges.where("w <> 0").count()
    out = []
    for rank in ranks:
        for method in methods:
            from dataclasses import replace

            store, seconds = fit(method, split, replace(config, rank=rank))
            edges = split.heldout if heldout else split.edges
            plain, full = (M.observed_errors(store, edges, r).first() for r in (False, True))
            report = M.storage_report(store, nnz)
            gate = store.diagnostics.get("storage_gate", {})
            out.append({"rank": rank, "method": method, "seconds": seconds, "rmse_factor": plain.rmse, "rmse_residual": full.rmse, "residual_nnz": report["residual_nnz"], "ratio": report["compressed_vs_raw_sparse_ratio"], "accepted": gate.get("accepted_after", True)})
    return out


def query_benchmark(graph: TemporalGraph, methods: Iterable[str], config: CompressionConfig, links: int = 5000, tops: int = 1000, trends: int = 1000, k: int = 10, threshold: float = 0.0) -> list[Record]:
    """Latency, throughput and quality of each query on each method's store; raw rows are the reference."""
    out = []
    for method in methods:
        store, built = fit(method, graph, config)
        engine = QueryEngine(store, raw=graph.edges)

        def run(query: str, size: int, found: DataFrame, quality: Callable[[DataFrame], Record]) -> None:
            began = time.perf_counter()
            found = found.cache()
            found.count()
            row = M.throughput(time.perf_counter() - began, size)
            out.append({"method": method, "query": query, "build_seconds": built, **row, **quality(found)})  # noqa: B023
            found.unpersist()

        def against_raw(found: DataFrame) -> Record:
            d = F.col("score") - F.coalesce("w", F.lit(0.0))
            return {"rmse": found.join(graph.edges, ["t", "u", "v"], "left").agg(F.sqrt(F.avg(d * d))).first()[0]}

        asked = workload(graph, "top", tops, k=k)
        run("links", links, engine.links(workload(graph, "link", links)), against_raw)
        run("top", tops, engine.top_neighbors(asked), lambda f: {"recall": M.recall_at_k(f, engine.raw_neighbors(asked), k).first().recall})  # noqa: B023
        run("trends", trends, engine.trends(workload(graph, "trend", trends)), against_raw)
        steps = graph.spark.range(graph.steps).select(F.col("id").alias("qid"), F.col("id").cast("int").alias("t"), F.lit(float(threshold)).alias("threshold"))
        truth = graph.attack if graph.attack is not None else graph.edges.limit(0)
        run("anomalies", graph.steps, engine.anomalies(steps), lambda f: {"f1": M.precision_recall(f, truth).first().f1})  # noqa: B023
        if graph.nodes is not None and not graph.nodes.where("community is not null").isEmpty():
            groups = graph.nodes.select("community").distinct().count()
            began = time.perf_counter()
            nmi = community_nmi(store, graph, groups, left_only=False)
            out.append({"method": method, "query": "community", "build_seconds": built, **M.throughput(time.perf_counter() - began, 1), "nmi": nmi})
    return out


def attack_sweep(base: TemporalGraph, attack: Callable[[TemporalGraph, float, int], TemporalGraph], levels: Iterable[float], methods: Iterable[str], config: CompressionConfig, seeds: Iterable[int], communities: int) -> list[Record]:
    """Largest error against the clean truth and community agreement under growing attack."""
    out = []
    for level in levels:
        for seed in seeds:
            graph = attack(base, level, seed) if level > 0 else base
            for method in methods:
                store, seconds = fit(method, graph, config)
                out.append({"level": level, "seed": seed, "method": method, "seconds": seconds, "max_error": truth_errors(store, graph)["max_error"], "nmi": community_nmi(store, graph, communities)})
    return out


def residual_robustness(spark: SparkSession, make: Callable[[int], TemporalGraph], kinds: Iterable[str], fractions: Iterable[float], methods: Iterable[str], config: CompressionConfig, seeds: Iterable[int], path: str, magnitude: float = 4.0) -> DataFrame:
    """Residual precision and recall, and gains on attacked cells; runs already recorded at ``path`` are skipped."""
    grid = spark.createDataFrame([(k, float(f), m, s) for k in kinds for f in fractions for m in methods for s in seeds], "kind string, fraction double, method string, seed int")
    for r in pending(spark, grid, path, ["kind", "fraction", "method", "seed"]).orderBy("kind", "fraction", "seed", "method").collect():  # one row per run
        graph = G.inject(make(r.seed), r.kind, r.fraction, magnitude, r.seed + 10_000)
        store, seconds = fit(r.method, graph, config)
        pr = M.precision_recall(store._residuals(), graph.attack).first()
        attacked = graph.attack.join(graph.edges, ["t", "u", "v"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
        gain = M.improvement(store, attacked).first()
        record = {"kind": r.kind, "fraction": r.fraction, "method": r.method, "seed": r.seed, "seconds": seconds, "precision": pr.precision, "recall": pr.recall, "f1": pr.f1, "rmse_factor": gain.rmse_factor, "rmse_residual": gain.rmse_residual, "relative_improvement": gain.relative_improvement}
        append_records(frame(spark, [record]), path)
    rows = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return M.group_summary(rows, ["kind", "fraction", "method"], ["f1", "relative_improvement"])


def rank_diagnostic(make: Callable[[int, int], TemporalGraph], ranks: Iterable[int], max_rank: int, config: CompressionConfig, seeds: Iterable[int]) -> list[Record]:
    """Effective rank and error of the true rank, the largest rank, and automatic selection."""
    from dataclasses import replace

    out = []
    for true in ranks:
        for seed in seeds:
            graph = make(true, seed)
            options = {"fixed_exact": replace(config, rank=true), "fixed_over": replace(config, rank=max_rank), "ard": replace(config, rank=max_rank, rank_selection_mode="ard", ard_max_rank=max_rank)}
            for method, c in options.items():
                store, seconds = fit("robust_asym", graph, c)
                out.append({"true_rank": true, "seed": seed, "method": method, "effective_rank": store.rank, "seconds": seconds, **truth_errors(store, graph)})
    return out
