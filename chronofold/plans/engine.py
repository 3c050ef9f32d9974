"""Queries on a factor store: link scores, top neighbours, trends, anomalies, communities.

Every query takes a DataFrame of requests; the scalar calls wrap one request.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import small
from ..operators import community as communities
from ..operators.index import ExactIndex, ProjectionIndex, most_of, ranked
from ..operators.store import FactorStore

RESULT_SCHEMA_VERSION = 1
RESULT_FIELDS = ("estimate", "bound", "used_residual", "method", "satisfied_error_tolerance")


@dataclass(frozen=True)
class BoundedResult:
    """Value of a query with what is known of its error."""

    value: float
    error_bound: float | None = None
    used_residual: bool | None = None
    satisfied_error_tolerance: bool | None = None
    method: str = "unknown"

    def to_dict(self) -> dict[str, Any]:
        return dict(zip(RESULT_FIELDS, (self.value, self.error_bound, self.used_residual, self.method, self.satisfied_error_tolerance), strict=True))


@dataclass(frozen=True)
class NeighborPlan:
    """Top neighbours with the access path that found them."""

    neighbors: list[tuple[int, float]]
    path: str
    estimated_error_bound: float | None = None
    satisfied_error_tolerance: bool | None = None


class QueryEngine:
    """Plans and runs queries; ``raw`` (t, u, v, w) snapshots allow exact fallback on small graphs."""

    RAW_NODES, INDEX_K = 512, 64

    def __init__(self, store: FactorStore, raw: DataFrame | None = None, bound_factor: float = 1.0):
        self.store, self.raw, self.bound_factor = store, raw, bound_factor
        self.has_residuals = store.has_residuals
        self._indexes: dict[str, ExactIndex] = {}
        self._communities: dict[tuple, DataFrame] = {}
        self._trends: dict[tuple, list[tuple[int, float]]] = {}
        self._hits = {"community_hits": 0, "community_misses": 0, "trend_hits": 0, "trend_misses": 0}

    @classmethod
    def from_config(cls, store: FactorStore, config: dict[str, Any], raw: DataFrame | None = None) -> QueryEngine:
        return cls(store, raw, float(config.get("query", {}).get("bound_C", 1.0)))

    def _one(self, **columns: Any) -> DataFrame:
        return self.store.spark.range(1).select(F.lit(0).cast("long").alias("qid"), *[F.lit(v).alias(k) for k, v in columns.items()])

    # Links

    def links(self, requests: DataFrame, include_residual: bool = True) -> DataFrame:
        """``requests`` (u, v, t, ...) with ``score``."""
        return self.store.score(requests, include_residual)

    def links_with_error(self, requests: DataFrame, include_residual: bool = True) -> DataFrame:
        """``requests`` with the fields of a bounded result."""
        scored = self.store.score(requests, include_residual, "estimate")
        bounded = self.store.error_bound(scored, include_residual, self.bound_factor)
        used = include_residual and self.has_residuals
        return bounded.withColumns({"used_residual": F.lit(used), "method": F.lit("factor_residual" if used else "factor_only"), "satisfied_error_tolerance": F.lit(None).cast("boolean")})

    def links_optimized(self, requests: DataFrame, tolerance: float | str) -> DataFrame:
        """Factor-only where its bound keeps the tolerance (number or column), else with the residual, in one plan."""
        tol = F.col(tolerance) if isinstance(tolerance, str) else F.lit(float(tolerance))
        rows = self.store.with_bound(self.store.with_base(requests, "__base"), self.bound_factor, "__cb")
        rows = self.store.with_residual(rows, "__res")
        by = self.bound_factor if self.store.theoretical else 1.0
        skip = F.col("__cb") + F.lit(by) * F.abs("__res")
        cheap = F.coalesce(skip <= tol, F.lit(False))
        used = ~cheap & F.lit(self.has_residuals)
        return rows.withColumns({
            "estimate": F.when(used, F.col("__base") + F.col("__res")).otherwise(F.col("__base")),
            "bound": F.when(used, F.col("__cb")).otherwise(skip),
            "used_residual": used,
            "method": F.when(used, "factor_residual").otherwise("factor_only"),
            "satisfied_error_tolerance": F.coalesce(F.when(used, F.col("__cb")).otherwise(skip) <= tol, F.lit(False)),
        }).drop("__base", "__cb", "__res")

    def link_prob(self, u: int, v: int, t: int, include_residual: bool = True) -> float:
        return self.store.link_score(u, v, t, include_residual)

    def _bounded(self, rows: DataFrame) -> list[BoundedResult]:
        return [BoundedResult(r.estimate, r.bound, r.used_residual, r.satisfied_error_tolerance, r.method) for r in rows.orderBy("t").collect()]

    def link_prob_result(self, u: int, v: int, t: int, include_residual: bool = True) -> BoundedResult:
        self.store.check_range(u, v, t)
        return self._bounded(self.links_with_error(self._one(u=u, v=v, t=t), include_residual))[0]

    def link_prob_optimized(self, u: int, v: int, t: int, tolerance: float) -> BoundedResult:
        self.store.check_range(u, v, t)
        return self._bounded(self.links_optimized(self._one(u=u, v=v, t=t), tolerance))[0]

    # Top neighbours

    def top_neighbors(self, requests: DataFrame, include_residual: bool = False, exclude_self: bool = True) -> DataFrame:
        """(qid, rank, v, score) for ``requests`` (qid, u, t, k) by scoring every v; self is never returned if excluded."""
        s = self.store
        q = requests.join(small(s.left.select("u", F.col("f").alias("__l")), s.n, s.rank), "u").join(F.broadcast(s.weighted_temporal()), "t")
        q = q.select("qid", "u", "t", "k", F.zip_with("__l", "s", lambda a, b: a * b).alias("q"), (F.col("u") if exclude_self else F.lit(None).cast("int")).alias("exclude"))
        if not include_residual or s.residuals is None:
            return ExactIndex(s.right, s.rank).search(q)
        from ..functions.expressions import dot

        cells = q.crossJoin(small(s.right, s.m, s.rank)).where(F.col("exclude").isNull() | (F.col("v") != F.col("exclude")))
        scored = s.with_residual(cells.withColumn("base", dot(F.col("f"), F.col("q"), rank=s.rank))).withColumn("score", F.col("base") + F.col("residual"))
        return ranked(scored, "k", most=most_of(requests)).select("qid", "rank", "v", "score")

    def index(self, mode: str = "exact", **options: Any) -> ExactIndex:
        if mode not in ("exact", "ann"):
            raise ValueError("index mode is exact or ann")
        if mode not in self._indexes:
            kind = ExactIndex if mode == "exact" else ProjectionIndex
            self._indexes[mode] = kind(self.store.right, self.store.rank, **options)
        return self._indexes[mode]

    def indexed_neighbors(self, requests: DataFrame, include_residual: bool = False, exclude_self: bool = True, mode: str = "exact") -> DataFrame:
        """Index candidates, as many more as the row has residuals, joined by the residual columns and scored again.

        With the exact index this equals the scan: a row without residual among
        the winners is within the first k plus residuals by factor score.
        """
        s = self.store
        q = requests.join(small(s.left.select("u", F.col("f").alias("__l")), s.n, s.rank), "u").join(F.broadcast(s.weighted_temporal()), "t")
        q = q.select("qid", "u", "t", "k", F.zip_with("__l", "s", lambda a, b: a * b).alias("q"), (F.col("u") if exclude_self else F.lit(None).cast("int")).alias("exclude"))
        if not include_residual or s.residuals is None:
            return self.index(mode).search(q)
        rows = s.summed_residuals()
        nnz = rows.groupBy("t", "u").agg(F.count(F.lit(1)).alias("nnz"))
        wide = q.join(nnz, ["t", "u"], "left").withColumn("kk", F.col("k") + F.coalesce("nnz", F.lit(0)) + 1)
        near = self.index(mode).search(wide.select("qid", "q", F.col("kk").cast("int").alias("k"), "exclude")).select("qid", "v")
        own = q.join(rows, ["t", "u"]).where(F.col("exclude").isNull() | (F.col("v") != F.col("exclude"))).select("qid", "v")
        pool = near.union(own).distinct().join(requests, "qid")
        return ranked(s.score(pool, True), "k", most=most_of(requests)).select("qid", "rank", "v", "score")

    def raw_neighbors(self, requests: DataFrame, exclude_self: bool = True) -> DataFrame:
        """Top neighbours of the raw snapshot rows, absent cells as 0."""
        every = self.store.right.select("v")
        cells = requests.crossJoin(small(every, self.store.m, 1))
        cells = cells.where(F.col("v") != F.col("u")) if exclude_self else cells
        scored = cells.join(self.raw, ["t", "u", "v"], "left").withColumn("score", F.coalesce("w", F.lit(0.0)))
        return ranked(scored, "k", most=most_of(requests)).select("qid", "rank", "v", "score")

    def residual_row_max(self, requests: DataFrame) -> DataFrame:
        """(qid, residual_max): the largest absolute residual in each request's row."""
        if self.store.residuals is None:
            return requests.select("qid", F.lit(0.0).alias("residual_max"))
        top = self.store.summed_residuals().groupBy("t", "u").agg(F.max(F.abs("value")).alias("m"))
        return requests.join(top, ["t", "u"], "left").select("qid", F.coalesce("m", F.lit(0.0)).alias("residual_max"))

    def neighbors_optimized(self, requests: DataFrame, tolerance: float, exclude_self: bool = True, prefer_index: bool | str | None = True, allow_raw: bool = True) -> DataFrame:
        """(qid, rank, v, score, path, bound, satisfied): access path by tolerance, size and index.

        Raw rows win if given and the graph is small.  Otherwise residuals are
        used for the requests whose row has one beyond the tolerance; requests
        are split by that, so only these meet the residuals.  Requests of up to
        ``INDEX_K`` neighbours go to an index, the exact one before the projected
        one, if one has been built (:meth:`index`), or to the named one, which is
        built; all others, and all with ``prefer_index`` false, are scans.
        """
        if allow_raw and self.raw is not None and self.store.n <= self.RAW_NODES:
            return self.raw_neighbors(requests, exclude_self).select("qid", "rank", "v", "score", F.lit("raw_fallback").alias("path"), F.lit(0.0).alias("bound"), F.lit(True).alias("satisfied"))
        marked = requests.join(self.residual_row_max(requests), "qid")
        with_res, without = marked.where(F.col("residual_max") > tolerance), marked.where(F.col("residual_max") <= tolerance)
        built = next((m for m in ("exact", "ann") if m in self._indexes), None)
        mode = prefer_index if isinstance(prefer_index, str) else built if prefer_index else None
        far_too = mode is None or most_of(requests) > self.INDEX_K
        parts = []
        for rows, residual in ((with_res, True), (without, False)):
            found = None
            if mode is not None:
                near = self.indexed_neighbors(rows.where(F.col("k") <= self.INDEX_K), residual, exclude_self, mode)
                found = near.withColumn("path", F.lit(f"indexed_{mode}_{'residual' if residual else 'factor_only'}"))
            if far_too:
                far = rows if mode is None else rows.where(F.col("k") > self.INDEX_K)
                scan = self.top_neighbors(far, residual, exclude_self).withColumn("path", F.lit("factor_residual_scan" if residual else "factor_only_scan"))
                found = scan if found is None else found.unionByName(scan)
            bound = F.lit(0.0) if residual else F.col("residual_max")
            parts.append(found.join(rows.select("qid", "residual_max"), "qid").select("qid", "rank", "v", "score", "path", bound.alias("bound"), F.lit(True).alias("satisfied")))
        return parts[0].unionByName(parts[1])

    def top_neighbor(self, u: int, t: int, k: int, include_residual: bool = False, exclude_self: bool = True, use_index: bool = False, index_mode: str = "exact") -> list[tuple[int, float]]:
        if k <= 0:
            return []
        self.store.check_range(u=u, t=t)
        one = self._one(u=u, t=t, k=k)
        found = self.indexed_neighbors(one, include_residual, exclude_self, index_mode) if use_index else self.top_neighbors(one, include_residual, exclude_self)
        return [(r.v, r.score) for r in found.orderBy("rank").collect()]

    def top_neighbor_optimized(self, u: int, t: int, k: int, tolerance: float, **options: Any) -> NeighborPlan:
        if k <= 0:
            return NeighborPlan([], "empty", 0.0, True)
        self.store.check_range(u=u, t=t)
        rows = self.neighbors_optimized(self._one(u=u, t=t, k=k), tolerance, **options).orderBy("rank").collect()
        first = rows[0] if rows else None
        return NeighborPlan([(r.v, r.score) for r in rows], first.path if first else "empty", first.bound if first else 0.0, first.satisfied if first else True)

    # Communities

    def community(self, t: int, k: int | None = None, seed: int = 0) -> DataFrame:
        return communities.community(self.store, t, k, seed)

    def community_cached(self, t: int, k: int | None = None, seed: int = 0) -> DataFrame:
        key = (t, k or self.store.rank, seed)
        self._hits["community_hits" if key in self._communities else "community_misses"] += 1
        if key not in self._communities:
            self._communities[key] = self.community(t, k, seed).cache()
        return self._communities[key]

    def community_batch(self, steps: list[int], k: int | None = None, seed: int = 0) -> DataFrame:
        found = [self.community_cached(t, k, seed) for t in steps]
        out = found[0]
        for f in found[1:]:
            out = out.union(f)
        return out

    # Trends

    @staticmethod
    def expand(requests: DataFrame) -> DataFrame:
        """Requests (qid, u, v, t1, t2), one row per step of the inclusive window."""
        return requests.withColumn("t", F.explode(F.sequence("t1", "t2")))

    def _window(self, requests: DataFrame) -> DataFrame:
        if requests.where("t1 > t2").limit(1).count():
            raise ValueError("a window must not end before it starts")
        return self.expand(requests)

    def trends(self, requests: DataFrame, include_residual: bool = True) -> DataFrame:
        return self.store.score(self._window(requests), include_residual)

    def trends_with_error(self, requests: DataFrame, include_residual: bool = True) -> DataFrame:
        return self.links_with_error(self._window(requests), include_residual)

    def trends_optimized(self, requests: DataFrame, tolerance: float) -> DataFrame:
        return self.links_optimized(self._window(requests), tolerance)

    def temporal_trend(self, u: int, v: int, t1: int, t2: int, include_residual: bool = True) -> list[float]:
        if t1 > t2:
            raise ValueError("a window must not end before it starts")
        self.store.check_range(u, v, t1)
        self.store.check_range(t=t2)
        return [r.score for r in self.trends(self._one(u=u, v=v, t1=t1, t2=t2), include_residual).orderBy("t").collect()]

    def temporal_trend_cached(self, u: int, v: int, t1: int, t2: int, include_residual: bool = True) -> list[float]:
        key = (u, v, t1, t2, include_residual)
        self._hits["trend_hits" if key in self._trends else "trend_misses"] += 1
        if key not in self._trends:
            self._trends[key] = self.temporal_trend(u, v, t1, t2, include_residual)
        return self._trends[key]

    def temporal_trend_result(self, u: int, v: int, t1: int, t2: int, tolerance: float | None = None) -> list[BoundedResult]:
        if t1 > t2:
            raise ValueError("a window must not end before it starts")
        self.store.check_range(u, v, t1)
        self.store.check_range(t=t2)
        one = self._one(u=u, v=v, t1=t1, t2=t2)
        return self._bounded(self.trends_with_error(one) if tolerance is None else self.trends_optimized(one, tolerance))

    # Anomalies

    def anomalies(self, requests: DataFrame) -> DataFrame:
        """Residual entries beyond each request's threshold, for ``requests`` (qid, t, threshold)."""
        if self.store.residuals is None:
            return requests.select("qid", "t", F.lit(0).alias("u"), F.lit(0).alias("v"), F.lit(0.0).alias("value")).limit(0)
        found = self.store.residuals.join(F.broadcast(requests) if requests.count() <= 100_000 else requests, "t")
        return found.where(F.abs("value") > F.col("threshold")).select("qid", "t", "u", "v", "value")

    def anomaly_detect(self, t: int, threshold: float) -> DataFrame:
        """(t, u, v, value) with |value| above the threshold."""
        self.store.check_range(t=t)
        return self.store.residual_snapshot(t).where(F.abs("value") > threshold)

    # Caches

    def cache_stats(self) -> dict[str, int]:
        return {**self._hits, "communities": len(self._communities), "trends": len(self._trends), "indexes": len(self._indexes)}

    def clear_caches(self) -> None:
        for df in self._communities.values():
            df.unpersist()
        self._communities.clear()
        self._trends.clear()
        self._indexes.clear()
        self._hits = dict.fromkeys(self._hits, 0)
