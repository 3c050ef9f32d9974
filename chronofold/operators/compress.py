"""Compressors: from snapshots to a factor store, by name."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields, replace
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import TemporalGraph
from . import kernels as K
from .linalg import DRIVER_CELLS, clipped_rank, cross_gram, factor_frame, gram, kept, prepare_checkpoints, scaled, strength_prune, subspace_svd, temporal_projection, to_array, to_tensor, turned
from .residuals import formatted, kept_residuals, residual_cells, storage_gate, threshold_row, with_bound_metadata
from .store import FactorStore
from .transforms import mean_snapshot, random_halves, stitch, symmetric


@dataclass(frozen=True)
class CompressionConfig:
    """Options of all compressors; the values are the defaults."""

    rank: int = 8
    rank_selection_mode: str = "fixed"
    random_seed: int = 0
    residual_threshold: float | None = None
    residual_threshold_mode: str = "mad"
    residual_quantile: float = 0.98
    residual_mad_multiplier: float = 45.0
    residual_hybrid_tail_quantile: float = 0.95
    residual_hybrid_tail_ratio: float = 2.0
    residual_threshold_scale: float = 1.0
    residual_storage_format: str = "csr"
    entrywise_bound_coverage: float = 1.0
    robust_iterations: int = 1
    robust_convergence_tol: float = 1e-6
    tensor_iterations: int = 10
    tensor_ridge: float = 1e-6
    tensor_rank_energy: float = 1.0
    tensor_min_rank: int = 1
    rpca_iterations: int = 100
    rpca_tol: float = 1e-6
    rank_pruning_mode: str = "none"
    rank_pruning_threshold: float = 0.01
    rank_pruning_min_rank: int = 1
    rank_pruning_iterations: int = 1
    asym_split_seed: int | None = None
    asym_split_mode: str = "random"
    asym_diagonal_mode: str = "average"
    max_sparse_ratio: float | None = None
    storage_gate_action: str = "diagnostic"
    factor_storage_dtype_bytes: int | None = None
    ard_max_rank: int | None = None
    ard_prior_alpha: float = 0.01
    ard_prior_beta: float = 0.01
    ard_max_iterations: int = 100
    ard_tolerance: float = 1e-6
    ard_min_effective_ratio: float = 0.05
    ard_min_rank: int = 1
    ard_noise_floor: float = 1e-8
    ard_fail_on_nonconvergence: bool = False
    tensor_blend: float = 0.35
    tensor_rank: int | None = None

    def validate(self) -> None:
        if self.rank_pruning_mode not in ("none", "ard_like"):
            raise ValueError("rank_pruning_mode is none or ard_like")
        if self.asym_split_mode != "random" or self.asym_diagonal_mode != "average":
            raise ValueError("asym_split_mode is random, asym_diagonal_mode average")
        if not 0 < self.tensor_rank_energy <= 1:
            raise ValueError("tensor_rank_energy must lie in (0, 1]")


#: Keys of existing configuration files, and the options they set.
KEYS = {"thinking_tensor_blend": "tensor_blend", "thinking_tensor_rank": "tensor_rank"}


def config_from(mapping: Mapping[str, Any], **overrides: Any) -> CompressionConfig:
    """Configuration from a mapping, whose unknown keys are reported and ignored; unknown overrides are errors."""
    known = {f.name for f in fields(CompressionConfig)}
    mapping = {KEYS.get(k, k): v for k, v in mapping.items()}
    if strange := sorted(set(overrides) - known):
        raise KeyError(f"unknown options: {', '.join(strange)}")
    if ignored := sorted(set(mapping) - known):
        warnings.warn(f"ignored options: {', '.join(ignored)}", stacklevel=2)
    return replace(CompressionConfig(), **{k: v for k, v in mapping.items() if k in known}, **overrides)


def _checked(graph: TemporalGraph, square: bool = False, least: int = 1) -> None:
    if graph.steps < least:
        raise ValueError(f"at least {least} snapshots are needed")
    if square and graph.n != graph.columns:
        raise ValueError("snapshots must be square")


def _store(graph: TemporalGraph, left, values, right, temporal, config: CompressionConfig, **diagnostics) -> FactorStore:
    """A store from driver arrays or factor tables."""
    spark = graph.spark
    left = left if isinstance(left, DataFrame) else factor_frame(spark, left, "u")
    right = right if isinstance(right, DataFrame) else factor_frame(spark, right, "v")
    lambdas = tuple(float(x) for x in values)
    if temporal is None:
        temporal = temporal_projection(graph.edges, left, right, graph.n, graph.columns, graph.steps, len(lambdas), list(lambdas))
        temporal = factor_frame(spark, np.array([r.f for r in temporal.orderBy("t").collect()]), "t")  # one short row per step
    elif not isinstance(temporal, DataFrame):
        temporal = factor_frame(spark, temporal, "t")
    return FactorStore(left, right, temporal, lambdas, graph.n, graph.columns, graph.steps, diagnostics=diagnostics)


def prune_like_ard(store: FactorStore, graph: TemporalGraph, config: CompressionConfig) -> FactorStore:
    """Drop weak components and fit the temporal factor again, some times over."""
    history = []
    for _ in range(config.rank_pruning_iterations if config.rank_pruning_mode == "ard_like" else 0):
        table = store.spark.createDataFrame([(j, x) for j, x in enumerate(store.lambdas)], "j int, lambda double")
        keep = sorted(r.j for r in strength_prune(store.temporal, table, config.rank_pruning_threshold, config.rank_pruning_min_rank).collect())
        history.append(len(keep))
        if len(keep) == store.rank:
            break
        left, right = kept(store.left, "u", keep), kept(store.right, "v", keep)
        store = _store(graph, left, [store.lambdas[j] for j in keep], right, None, config, **store.diagnostics)
    return store.with_(diagnostics={**store.diagnostics, "pruning_history": history}) if history else store


def _from_mean(graph: TemporalGraph, config: CompressionConfig, both_ways: bool = False) -> FactorStore:
    """SVD of the mean snapshot (or its symmetric part); optionally residuals strictly above a fixed threshold.

    Graphs of few cells are read once and projected where they are
    factorised; of larger ones the driver holds the mean at most.
    """
    n, m = graph.n, graph.columns
    rank = clipped_rank(config.rank_selection_mode, config.rank, n, config.ard_max_rank)
    temporal = None
    if _dense_enough(graph):
        tensor = to_tensor(graph.edges, graph.steps, n, m)
        mean = tensor.mean(0)
        left, values, right = K.truncated_svd((mean + mean.T) / 2 if both_ways else mean, rank)
        temporal = K.project(tensor, left, right) / np.where(np.abs(values) > 1e-12, values, 1.0)
    else:
        mean = mean_snapshot(graph.edges, graph.steps)
        mean = symmetric(mean) if both_ways else mean
        if n * m <= DRIVER_CELLS:
            left, values, right = K.truncated_svd(to_array(mean, n, m), rank)
        else:
            left, values, right = subspace_svd(mean, n, m, rank, seed=config.random_seed)
    store = prune_like_ard(_store(graph, left, values, right, temporal, config), graph, config)
    if config.residual_threshold is not None:
        store = store.with_(residuals=kept_residuals(residual_cells(graph.edges, store), config.residual_threshold, strict=True))
    return store


def direct_svd(graph: TemporalGraph, config: CompressionConfig) -> FactorStore:
    _checked(graph)
    return _from_mean(graph, config)


def sym_svd(graph: TemporalGraph, config: CompressionConfig) -> FactorStore:
    _checked(graph, square=True)
    return _from_mean(graph, config, both_ways=True)


def _energy_kept(values: np.ndarray, config: CompressionConfig) -> np.ndarray:
    """Indexes, in order, of the largest values that hold the wanted share of energy."""
    order = np.argsort(-values, kind="stable")
    share = np.cumsum(np.square(values[order])) / max(float(np.square(values).sum()), 1e-300)
    count = max(int(np.searchsorted(share, config.tensor_rank_energy - 1e-15)) + 1, config.tensor_min_rank)
    return np.sort(order[:count])


def _normalised(graph: TemporalGraph, left: np.ndarray, right: np.ndarray, temporal: np.ndarray, config: CompressionConfig, **diagnostics) -> FactorStore:
    """Unit columns, products of norms as lambdas, then energy pruning with the order kept."""
    norms = [np.maximum(np.linalg.norm(x, axis=0), 1e-12) for x in (left, right, temporal)]
    values = norms[0] * norms[1] * norms[2]
    keep = _energy_kept(values, config)
    return _store(graph, (left / norms[0])[:, keep], values[keep], (right / norms[1])[:, keep], (temporal / norms[2])[:, keep], config, **diagnostics)


def _unfolding_factors(tensor: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    left, right = K.leading_rows(tensor, rank), K.leading_rows(tensor, rank, targets=True)
    return left, right, K.project(tensor, left, right)


def unfolding_rows(edges: DataFrame, n: int, m: int, steps: int, rank: int, targets: bool = False, seed: int = 0) -> DataFrame:
    """(u, f) or (v, f): leading left singular vectors of an unfolding, from its nonzeros; neither it nor a Gram matrix is built."""
    if targets:
        flat = edges.select(F.col("v").alias("u"), (F.col("t").cast("long") * n + F.col("u")).alias("v"), "w")
        return subspace_svd(flat, m, n * steps, rank, seed=seed)[0].withColumnRenamed("u", "v")
    flat = edges.select("u", (F.col("t").cast("long") * m + F.col("v")).alias("v"), "w")
    return subspace_svd(flat, n, m * steps, rank, seed=seed)[0]


def _normalised_tables(graph: TemporalGraph, left: DataFrame, right: DataFrame, temporal: np.ndarray, config: CompressionConfig, **diagnostics) -> FactorStore:
    """:func:`_normalised` for factor tables: norms by one aggregate each."""
    rank = temporal.shape[1]
    norms = [np.sqrt(np.maximum(np.diag(gram(left, "u", rank)), 1e-24)), np.sqrt(np.maximum(np.diag(gram(right, "v", rank)), 1e-24)), np.maximum(np.linalg.norm(temporal, axis=0), 1e-12)]
    values = norms[0] * norms[1] * norms[2]
    keep = _energy_kept(values, config)
    left, right = kept(scaled(left, "u", (1 / norms[0]).tolist()), "u", keep), kept(scaled(right, "v", (1 / norms[1]).tolist()), "v", keep)
    return _store(graph, left, values[keep], right, (temporal / norms[2])[:, keep], config, **diagnostics)


def _projected(graph: TemporalGraph, left: DataFrame, right: DataFrame, rank: int) -> np.ndarray:
    rows = temporal_projection(graph.edges, left, right, graph.n, graph.columns, graph.steps, rank)
    return np.array([r.f for r in rows.orderBy("t").collect()])  # one short row per step


def _dense_enough(graph: TemporalGraph) -> bool:
    return graph.steps * graph.n * graph.columns <= DRIVER_CELLS


def tensor_unfolding_svd(graph: TemporalGraph, config: CompressionConfig) -> FactorStore:
    _checked(graph)
    if not _dense_enough(graph):
        n, m, rank = graph.n, graph.columns, min(config.rank, graph.n, graph.columns)
        left, right = (unfolding_rows(graph.edges, n, m, graph.steps, rank, side, config.random_seed).checkpoint() for side in (False, True))
        return _normalised_tables(graph, left, right, _projected(graph, left, right, rank), config)
    tensor = to_tensor(graph.edges, graph.steps, graph.n, graph.columns)
    return _normalised(graph, *_unfolding_factors(tensor, min(config.rank, graph.n, graph.columns)), config)


def _cp_tables(graph: TemporalGraph, config: CompressionConfig, tol: float = 1e-8) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Alternating least squares on relations: each factor from one join of the edges with the other two and one sum per row."""
    n, m, rank, steps = graph.n, graph.columns, min(config.rank, graph.n, graph.columns), graph.steps
    prepare_checkpoints(graph.spark)
    left, right = (unfolding_rows(graph.edges, n, m, steps, rank, side, config.random_seed).checkpoint() for side in (False, True))
    temporal = _projected(graph, left, right, rank)
    energy = float(graph.edges.agg(F.coalesce(F.sum(F.col("w") * F.col("w")), F.lit(0.0))).first()[0])
    ridge = config.tensor_ridge * np.eye(rank)

    def solved(key: str, other: str, table: DataFrame, size: int, against: np.ndarray) -> DataFrame:
        weights = factor_frame(graph.spark, temporal, "t").select("t", F.col("f").alias("s"))
        joined = graph.edges.join(F.broadcast(weights), "t").join(table.withColumnRenamed("f", "l"), other)
        sums = joined.groupBy(F.col(key).cast("long").alias("i")).agg(*[F.sum(F.col("w") * F.get("s", F.lit(j)) * F.get("l", F.lit(j))).alias(f"g{j}") for j in range(rank)])
        found = turned(sums.select("i", F.array(*[F.col(f"g{j}") for j in range(rank)]).alias("f")), np.linalg.inv(against + ridge))
        every = graph.spark.range(size).select(F.col("id").alias("i")).join(found, "i", "left")
        return every.select(F.col("i").cast("int").alias(key), F.coalesce("f", F.array(*[F.lit(0.0)] * rank)).alias("f")).checkpoint()

    last = np.inf
    for _ in range(config.tensor_iterations):
        cross = _projected(graph, left, right, rank)
        both = gram(left, "u", rank) * gram(right, "v", rank)
        temporal = np.linalg.solve(both + ridge, cross.T).T
        error = np.sqrt(max(energy - 2 * float((temporal * cross).sum()) + float(((temporal.T @ temporal) * both).sum()), 0.0) / max(energy, 1e-24))
        if abs(last - error) < tol:
            break
        last = error
        left = solved("u", "v", right, n, (temporal.T @ temporal) * gram(right, "v", rank))
        right = solved("v", "u", left, m, (temporal.T @ temporal) * gram(left, "u", rank))
    return left, right, temporal


def cp_als(graph: TemporalGraph, config: CompressionConfig) -> FactorStore:
    _checked(graph)
    if not _dense_enough(graph):
        return _normalised_tables(graph, *_cp_tables(graph, config), config)
    tensor = to_tensor(graph.edges, graph.steps, graph.n, graph.columns)
    temporal, left, right = K.cp_als(tensor, config.rank, config.tensor_iterations, config.tensor_ridge, seed=config.random_seed)
    return _normalised(graph, left, right, temporal, config)


def tucker(graph: TemporalGraph, config: CompressionConfig) -> FactorStore:
    _checked(graph)
    tensor = to_tensor(graph.edges, graph.steps, graph.n, graph.columns)
    fitted = K.tucker_hooi(tensor, (config.rank, config.rank, config.rank), config.tensor_iterations)
    return _normalised(graph, *_unfolding_factors(fitted, min(config.rank, graph.n, graph.columns)), config)


def rpca_svd(graph: TemporalGraph, config: CompressionConfig) -> FactorStore:
    _checked(graph)
    mean = to_array(mean_snapshot(graph.edges, graph.steps), graph.n, graph.columns)
    low, sparse, used = K.robust_pca(mean, config.rpca_iterations, config.rpca_tol)
    left, values, right = K.truncated_svd(low, min(config.rank, *low.shape))
    return _store(graph, left, values, right, None, config, rpca_iterations=used, rpca_sparse_nnz=int((np.abs(sparse) > 1e-12).sum()))


def nmf(graph: TemporalGraph, config: CompressionConfig) -> FactorStore:
    _checked(graph)
    mean = to_array(mean_snapshot(graph.edges, graph.steps), graph.n, graph.columns)
    w, h = K.nmf(mean + abs(min(float(mean.min(initial=0)), 0.0)), min(config.rank, *mean.shape))
    if not _dense_enough(graph):
        left, right = factor_frame(graph.spark, w, "u"), factor_frame(graph.spark, h.T, "v")
        return _normalised_tables(graph, left, right, _projected(graph, left, right, w.shape[1]), config)
    return _normalised(graph, w, h.T, K.project(to_tensor(graph.edges, graph.steps, graph.n, graph.columns), w, h.T), config)


def tensor_basis(tensor: np.ndarray, rank: int) -> np.ndarray:
    """Rank-limited mean snapshot along the source unfolding: sum_j c_j u_j v_j', v_j from the mean snapshot."""
    u = K.leading_rows(tensor, rank)
    mean = tensor.mean(0)
    v = mean.T @ u
    norms = np.linalg.norm(v, axis=0)
    v = np.divide(v, norms, out=np.zeros_like(v), where=norms > 1e-12)
    return (u * np.einsum("uj,uv,vj->j", u, mean, v)) @ v.T


def robust_asym(graph: TemporalGraph, config: CompressionConfig) -> FactorStore:
    """Robust asymmetric compression.

    Rounds of: subtract the sparse part, stitch the means of a random
    bipartition of the steps triangle by triangle, blend with the unfolding
    basis, factorise, project the steps, and take as sparse part the residuals
    at or above the threshold.  Then bounds, residual layout and storage gate.
    Graphs of up to ``DRIVER_CELLS`` cells run as arrays on the driver; larger
    ones as relations, with a fixed rank.
    """
    _checked(graph, square=True, least=2)
    parts = random_halves(graph.steps, config.random_seed if config.asym_split_seed is None else config.asym_split_seed)
    if graph.steps * graph.n * graph.n > DRIVER_CELLS:
        return _robust_relational(graph, config, parts)
    tensor = to_tensor(graph.edges, graph.steps, graph.n, graph.n)
    one, two = np.array(parts) == 1, np.array(parts) == 2
    sparse, last, history, threshold = np.zeros_like(tensor), None, [], 0.0
    beta = min(max(config.tensor_blend, 0.0), 1.0)
    rank = clipped_rank(config.rank_selection_mode, config.rank, graph.n, config.ard_max_rank)
    ard: dict = {}
    for _ in range(max(1, config.robust_iterations)):
        clean = tensor - sparse if history else tensor
        m1, m2 = clean[one].mean(0), clean[two].mean(0)
        basis = np.triu(m1, 1) + np.tril(m2, -1) + np.diag((np.diag(m1) + np.diag(m2)) / 2)
        if beta:
            basis = (1 - beta) * basis + beta * tensor_basis(clean, config.tensor_rank or config.rank)
        left, values, right = K.truncated_svd(basis, rank)
        if config.rank_selection_mode == "ard":
            keep, ard = K.ard_selection(clean, left, right, config.ard_prior_alpha, config.ard_prior_beta, config.ard_max_iterations, config.ard_tolerance, config.ard_min_effective_ratio, config.ard_min_rank, config.ard_noise_floor, config.ard_fail_on_nonconvergence)
            left, values, right = left[:, keep], values[keep], right[:, keep]
        scale = np.where(np.abs(values) > 1e-12, values, 1.0)
        temporal = K.project(clean, left, right) / scale
        low = np.stack([(left * w) @ right.T for w in temporal * values])
        error = tensor - low
        threshold = dense_threshold(np.abs(error), config)
        sparse = np.where(np.abs(error) >= threshold, error, 0.0)
        change = np.inf if last is None else float(np.linalg.norm(low - last) / max(np.linalg.norm(last), 1e-12))
        history.append({"threshold": threshold, "nnz": int(np.count_nonzero(sparse)), "change": change})
        if change <= config.robust_convergence_tol:
            break
        last = low
    diagnostics = {"history": history, "estimated_threshold": threshold, "effective_rank": len(values)} | ({"ard": ard} if ard else {})
    store = _store(graph, left, values, right, temporal, config, **diagnostics)
    at = np.nonzero(sparse)
    import pandas as pd

    entries = pd.DataFrame({"t": at[0].astype(np.int32), "u": at[1].astype(np.int32), "v": at[2].astype(np.int32), "value": sparse[at]})
    residuals = graph.spark.createDataFrame(entries, "t int, u int, v int, value double") if len(entries) else None
    store = prune_like_ard(store, graph, config).with_(residuals=residuals)
    sigma = max(float(np.median(np.abs(e - np.median(e)))) / 0.6745 for e in tensor - low)
    constant = min(max(config.entrywise_bound_coverage, 0.5), 5.0)
    mu = np.maximum(np.abs(tensor).sum(2).mean(0) / graph.n, 1 / graph.n)
    bounds = pd.DataFrame({"u": np.arange(graph.n, dtype=np.int32), "mu": mu, "src_scale": mu**-0.5, "tgt_scale": mu**-0.5})
    store = store.with_(node_bounds=graph.spark.createDataFrame(bounds, "u int, mu double, src_scale double, tgt_scale double"), bound_sigma_max=sigma, bound_constant=1.0 if constant <= 0.5 else constant)
    return storage_gate(formatted(store, config.residual_storage_format), int(np.count_nonzero(tensor)), config.max_sparse_ratio, config.storage_gate_action, config.factor_storage_dtype_bytes)


def dense_threshold(a: np.ndarray, config: CompressionConfig) -> float:
    """The rules of :func:`residuals.threshold_row` on an array of absolute residuals."""
    if config.residual_threshold is not None:
        return config.residual_threshold * config.residual_threshold_scale
    mode = config.residual_threshold_mode
    if mode not in ("quantile", "mad", "hybrid"):
        raise ValueError("residual_threshold_mode is quantile, mad or hybrid")
    cap = float(np.quantile(a, config.residual_quantile)) if mode != "mad" else 0.0
    if mode == "quantile":
        return cap * config.residual_threshold_scale
    mid = float(np.median(a))
    sigma = 1.4826 * float(np.median(np.abs(a - mid)))
    value = float(a.max()) + 1 if sigma <= 1e-12 else mid + config.residual_mad_multiplier * sigma
    if mode == "hybrid" and value > cap > config.residual_hybrid_tail_ratio * max(float(np.quantile(a, config.residual_hybrid_tail_quantile)), 1e-12):
        value = cap
    return value * config.residual_threshold_scale


def _blended(clean: DataFrame, n: int, steps: int, config: CompressionConfig, beta: float) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """The unfolding basis of :func:`tensor_basis` times beta, as tables (i, f) of U and V and numbers c."""
    rank = min(config.tensor_rank or config.rank, n)
    u = unfolding_rows(clean, n, n, steps, rank, seed=config.random_seed).withColumnRenamed("u", "i").checkpoint()
    image = mean_snapshot(clean, steps).join(u.withColumnRenamed("i", "u"), "u").groupBy(F.col("v").alias("i"))
    image = image.agg(*[F.sum(F.col("w") * F.get("f", F.lit(j))).alias(f"y{j}") for j in range(rank)])
    image = image.select("i", F.array(*[F.col(f"y{j}") for j in range(rank)]).alias("f")).checkpoint()
    norms = np.sqrt(np.maximum(np.diag(gram(image, "i", rank)), 0.0))
    live = norms > 1e-12
    v = turned(image, np.diag(np.where(live, 1 / np.where(live, norms, 1.0), 0.0)))
    return u, beta * norms, v  # u' mean v = |mean' u| for v = mean' u / |mean' u|


def _moved(new: FactorStore, old: FactorStore) -> float:
    """Norm of the change of the low-rank part over that of the old one, by Gram matrices."""
    a, b = new.rank, old.rank
    side = lambda s, k: getattr(s, k).withColumnRenamed("u" if k == "left" else "v", "i")
    weights = [np.array([r.f for r in s.temporal.orderBy("t").collect()]) * np.array(s.lambdas) for s in (new, old)]

    def inner(x: FactorStore, y: FactorStore, p: int, q: int, wx: np.ndarray, wy: np.ndarray) -> float:
        return float(((wx.T @ wy) * cross_gram(side(x, "left"), side(y, "left"), p, q) * cross_gram(side(x, "right"), side(y, "right"), p, q)).sum())

    own, before = inner(new, new, a, a, weights[0], weights[0]), inner(old, old, b, b, weights[1], weights[1])
    return float(np.sqrt(max(own + before - 2 * inner(new, old, a, b, *weights), 0.0)) / max(np.sqrt(max(before, 0.0)), 1e-12))


def _robust_relational(graph: TemporalGraph, config: CompressionConfig, parts: list[int]) -> FactorStore:
    prepare_checkpoints(graph.spark)
    beta = min(max(config.tensor_blend, 0.0), 1.0)
    if config.rank_selection_mode != "fixed":
        raise MemoryError("rank selection needs a graph within the driver's cells")
    edges, store, threshold, last = graph.edges, None, None, None
    for _ in range(max(1, config.robust_iterations)):
        clean = edges
        if store is not None:
            removed = store.residuals.select("t", "u", "v", (-F.col("value")).alias("w"))
            clean = edges.unionByName(removed).groupBy("t", "u", "v").agg(F.sum("w").alias("w")).checkpoint()
        stitched, low = stitch(clean, parts), None
        if beta:
            stitched = stitched.withColumn("w", F.col("w") * F.lit(1 - beta))
            low = _blended(clean, graph.n, graph.steps, config, beta)
        left, values, right = subspace_svd(stitched.checkpoint(), graph.n, graph.n, config.rank, seed=config.random_seed, low=low)
        store = _store(graph.with_(edges=clean), left.checkpoint(), values, right.checkpoint(), None, config)
        cells = residual_cells(edges, store)
        options = {"mode": config.residual_threshold_mode, "fixed": config.residual_threshold, "q": config.residual_quantile, "multiplier": config.residual_mad_multiplier, "tail_q": config.residual_hybrid_tail_quantile, "tail_ratio": config.residual_hybrid_tail_ratio, "scale": config.residual_threshold_scale}
        threshold = threshold_row(cells, graph.steps * graph.n * graph.n, **options).first()[0]
        change = None if last is None else _moved(store, last)
        store = store.with_(residuals=kept_residuals(cells, threshold).checkpoint(), diagnostics={"estimated_threshold": threshold, "change": change})
        if change is not None and change <= config.robust_convergence_tol:
            break
        last = store
    store = with_bound_metadata(prune_like_ard(store, graph, config).with_(residuals=store.residuals), edges, residual_cells(edges, store), config.entrywise_bound_coverage)
    return storage_gate(formatted(store, config.residual_storage_format), edges.where("w <> 0").count(), config.max_sparse_ratio, config.storage_gate_action, config.factor_storage_dtype_bytes)


COMPRESSORS: dict[str, Callable[[TemporalGraph, CompressionConfig], FactorStore]] = {
    "robust_asym": robust_asym, "sym_svd": sym_svd, "direct_svd": direct_svd, "tensor_unfolding_svd": tensor_unfolding_svd, "cp_als": cp_als,
    "tucker_als": tucker, "tucker_hosvd": tucker, "rpca_svd": rpca_svd, "nmf": nmf,
}
PROTOTYPES = ("cp_als", "tucker_als", "tucker_hosvd", "nmf", "rpca_svd")


def available_compressors(include_prototypes: bool = True) -> list[str]:
    return sorted(k for k in COMPRESSORS if include_prototypes or k not in PROTOTYPES)


def compress(name: str, graph: TemporalGraph, config: CompressionConfig | None = None) -> FactorStore:
    """Fit the named compressor to a graph."""
    if name not in COMPRESSORS:
        raise ValueError(f"unknown compressor {name!r}; available: {', '.join(sorted(COMPRESSORS))}")
    config = config or CompressionConfig()
    config.validate()
    return COMPRESSORS[name](graph, config)


__all__ = ["COMPRESSORS", "CompressionConfig", "available_compressors", "compress", "config_from"]
