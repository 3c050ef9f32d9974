"""Residual thresholds, bound metadata and the storage gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import quantiles
from .store import CSR_BYTES, POINTER_BYTES, FactorStore, choose_format, node_degrees


def residual_cells(edges: DataFrame, store: FactorStore) -> DataFrame:
    """(t, u, v, w, e) over all cells: weight and residual of the factor score."""
    cells = store.cells().join(edges, ["t", "u", "v"], "left").select("t", "u", "v", F.coalesce("w", F.lit(0.0)).alias("w"))
    return store.with_base(cells, "base").select("t", "u", "v", "w", (F.col("w") - F.col("base")).alias("e"))


def threshold_row(cells: DataFrame, count: int, mode: str = "mad", fixed: float | None = None, q: float = 0.98, multiplier: float = 45.0, tail_q: float = 0.95, tail_ratio: float = 2.0, scale: float = 1.0) -> DataFrame:
    """One row ``threshold`` over the absolute residuals ``e`` of all ``count`` cells.

    ``fixed``: that value; ``quantile``: linear-interpolated quantile; ``mad``:
    median + multiplier * 1.4826 * MAD, or the largest plus 1 when the MAD is
    about 0; ``hybrid``: the quantile where it caps a larger MAD threshold and
    clearly exceeds the tail, else the MAD threshold.  All times ``scale``.
    """
    if fixed is not None:
        return cells.sparkSession.range(1).select((F.lit(float(fixed)) * scale).alias("threshold"))
    if mode not in ("quantile", "mad", "hybrid"):
        raise ValueError("residual_threshold_mode is quantile, mad or hybrid")
    a = cells.select(F.abs("e").alias("a"))
    if mode == "quantile":
        return quantiles(a, F.col("a"), {"q": q}, count).select((F.col("q") * scale).alias("threshold"))
    base = F.broadcast(quantiles(a, F.col("a"), {"q": q, "tail": tail_q, "mid": 0.5, "top": 1.0}, count))  # one row
    spread = quantiles(a.crossJoin(base), F.abs(F.col("a") - F.col("mid")), {"mad": 0.5}, count, ["q", "tail", "mid", "top"])
    sigma = F.col("mad") * 1.4826
    by_mad = F.when(sigma <= 1e-12, F.col("top") + 1).otherwise(F.col("mid") + multiplier * sigma)
    if mode == "hybrid":
        by_mad = F.when((by_mad > F.col("q")) & (F.col("q") > tail_ratio * F.greatest("tail", F.lit(1e-12))), F.col("q")).otherwise(by_mad)
    return spread.select((by_mad * scale).alias("threshold"))


def kept_residuals(cells: DataFrame, threshold: float, strict: bool = False) -> DataFrame:
    """(t, u, v, value) with |residual| at least the threshold (above it, if ``strict``)."""
    keep = F.abs("e") > threshold if strict else F.abs("e") >= threshold
    return cells.where(keep & (F.col("e") != 0)).select("t", "u", "v", F.col("e").alias("value"))


def centred_sigma(cells: DataFrame, count: int) -> DataFrame:
    """One row ``sigma``: the largest over steps of the MAD of the residuals, over 0.6745."""
    mid = F.broadcast(quantiles(cells, F.col("e"), {"mid": 0.5}, count, ["t"]))
    spread = quantiles(cells.join(mid, "t"), F.abs(F.col("e") - F.col("mid")), {"s": 0.5}, count, ["t"])
    return spread.agg((F.max("s") / 0.6745).alias("sigma"))


def with_bound_metadata(store: FactorStore, edges: DataFrame, cells: DataFrame, coverage: float = 1.0) -> FactorStore:
    """Centred deviation, absolute row means, and the coverage constant clipped to [0.5, 5] (1 at or below 0.5)."""
    constant = min(max(coverage, 0.5), 5.0)
    sigma = centred_sigma(cells, store.steps * store.n * store.m).first()[0]
    return store.with_(node_bounds=node_degrees(edges, store.n, store.steps), bound_sigma_max=float(sigma or 0.0), bound_constant=1.0 if constant <= 0.5 else constant)


def storage_gate(store: FactorStore, raw_nnz: int, max_ratio: float | None, action: str = "diagnostic", dtype_bytes: int | None = None) -> FactorStore:
    """Compare compressed with raw sparse bytes; ``drop_residual`` or ``raise`` when over ``max_ratio``."""
    if action not in ("diagnostic", "drop_residual", "raise"):
        raise ValueError("storage_gate_action is diagnostic, drop_residual or raise")
    raw = max(1, CSR_BYTES * raw_nnz + POINTER_BYTES * (store.n + 1) * store.steps)
    before = store.compressed_bytes(dtype_bytes or 8, metadata=False) / raw
    report = {"max_sparse_ratio": max_ratio, "storage_gate_action": action, "ratio_before": before, "accepted_before": max_ratio is None or before <= max_ratio, "residual_dropped": False}
    if not report["accepted_before"]:
        if action == "raise":
            raise ValueError(f"compressed store is {before:.3f} of the raw sparse size; the limit is {max_ratio}")
        if action == "drop_residual" and store.residuals is not None:
            store, report["residual_dropped"] = store.with_(residuals=None), True
    after = store.compressed_bytes(dtype_bytes or 8, metadata=False) / raw
    report |= {"ratio_after": after, "accepted_after": max_ratio is None or after <= max_ratio}
    return store.with_(diagnostics={**store.diagnostics, "storage_gate": report})


def formatted(store: FactorStore, kind: str) -> FactorStore:
    return store.with_(residual_format=choose_format(store.residual_nnz(), store.steps, store.n, kind))
