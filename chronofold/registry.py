"""All registered queries of the engine and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .functions.expressions import small
from .operators import linalg as L
from .operators import metrics as M
from .operators import residuals as R
from .operators import transforms as T
from .operators.compress import CompressionConfig, compress
from .operators.store import raw_sparse_bytes, residual_bytes
from .plans import demo
from .plans.engine import QueryEngine
from .sources import edges as E
from .sources import generators as G

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# Common table expressions of the oracles.
TRADE = """edges AS (SELECT (year(o_orderdate) - 1995)::INTEGER AS t, c_nationkey AS u, s_nationkey AS v, sum(l_extendedprice * (1 - l_discount)) / 1e6 AS w
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3),
dims AS (SELECT (SELECT count(*) FROM nation) AS n, (SELECT max(t) + 1 FROM edges) AS steps)"""
GRID = """grid AS (SELECT s.t::INTEGER AS t, a.n_nationkey AS u, b.n_nationkey AS v, a.n_regionkey AS p, b.n_regionkey AS q, coalesce(e.w, 0.0) AS w
  FROM (SELECT unnest(range((SELECT steps FROM dims))) AS t) s CROSS JOIN nation a CROSS JOIN nation b LEFT JOIN edges e ON e.t = s.t AND e.u = a.n_nationkey AND e.v = b.n_nationkey)"""
BLOCK = """cells AS (SELECT t, u, v, w, avg(w) OVER (PARTITION BY t, p, q) AS base FROM grid),
err AS (SELECT *, w - base AS e FROM cells),
thr AS (SELECT quantile_cont(abs(e), 0.98) AS thr FROM err),
res AS (SELECT t, u, v, e AS value FROM err, thr WHERE abs(e) >= thr AND e <> 0),
scored AS (SELECT c.*, coalesce(r.value, 0.0) AS residual, c.base + coalesce(r.value, 0.0) AS score FROM cells c LEFT JOIN res r USING (t, u, v))"""
REQ = "req AS (SELECT i AS qid, (i // n)::INTEGER AS u, (i % n)::INTEGER AS v, ((i // n + i % n) % steps)::INTEGER AS t FROM dims, (SELECT unnest(range(n * n)) AS i FROM dims))"
TOP = "topreq AS (SELECT i AS qid, i::INTEGER AS u, (steps - 1)::INTEGER AS t, 3 AS k FROM dims, (SELECT unnest(range(n)) AS i FROM dims))"
TREND = "trend AS (SELECT i AS qid, i::INTEGER AS u, ((i + 1) % n)::INTEGER AS v, t::INTEGER AS t FROM dims, (SELECT unnest(range(n)) AS i FROM dims), (SELECT unnest(range(1, 5)) AS t))"
MU = """mu AS (SELECT n_nationkey AS u, greatest(coalesce(s, 0.0) / (n * steps), 1.0 / n) AS mu FROM nation CROSS JOIN dims LEFT JOIN (SELECT u, sum({w}) AS s FROM edges GROUP BY u) x ON x.u = n_nationkey)"""
#: Bound of a cell from its ends' mu, with {sigma} from a CTE ``sig`` and rank 25.
THEORY = "sig.sigma * sqrt(25 * ln(n)) / sqrt(n * steps) * (1 / sqrt(a.mu) + 1 / sqrt(b.mu))"
SIGMA_UNCENTRED = "sig AS (SELECT max(s) AS sigma FROM (SELECT t, median(abs(w - score)) / 0.6745 AS s FROM scored GROUP BY t))"


def _with(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that must give the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


BASE = _with(TRADE, GRID, BLOCK)


# Sources and graphs


@query(_with(TRADE) + "SELECT t, u, v, round(w, 4) AS w FROM edges")
def edges_trade(spark, sf_dir):
    return E.trade_edges(spark, sf_dir).select("t", "u", "v", _r("w", 4))


@query("""SELECT (year(o_orderdate) - 1995)::INTEGER AS t, c_nationkey AS u, s_nationkey AS v, sum(CASE l_returnflag WHEN 'R' THEN -1.0 WHEN 'A' THEN 1.0 ELSE 0.0 END)::DOUBLE AS w
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3""")
def edges_trade_signed(spark, sf_dir):
    return E.trade_edges(spark, sf_dir, signed=True)


@query("""SELECT ((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1)::INTEGER AS t, o_custkey AS u, l_suppkey AS v, round(sum(l_quantity) / 10, 4) AS w
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3""")
def edges_purchase(spark, sf_dir):
    return E.purchase_edges(spark, sf_dir).select("t", "u", "v", _r("w", 4))


HANDOFF = """h AS (SELECT user_id AS source, lead(user_id) OVER (PARTITION BY ts::DATE ORDER BY ts, event_id) AS target, ts::DATE AS day, event_id AS pos FROM events),
rows AS (SELECT * FROM h WHERE target IS NOT NULL AND source <> target)"""
DEGREE = """ends AS (SELECT source AS node_id, pos, 0 AS side FROM rows UNION ALL SELECT target, pos, 1 FROM rows),
deg AS (SELECT node_id, count(*) AS degree, min(pos * 2 + side) AS first FROM ends GROUP BY node_id),
top AS (SELECT node_id, degree, row_number() OVER (ORDER BY degree DESC, first) - 1 AS idx FROM deg)"""


@query(_with(HANDOFF, DEGREE) + "SELECT node_id, idx::INTEGER AS idx, degree FROM top WHERE idx < 300")
def degree_top_nodes(spark, sf_dir):
    """The default of 300 nodes."""
    return E.select_nodes(E.handoff_rows(spark, sf_dir), 300)


def _trust_rows(spark, sf_dir):
    return E.handoff_rows(spark, sf_dir).select("source", "target", F.lit(10.0).alias("rating"), F.unix_timestamp(F.col("day").cast("timestamp")).cast("double").alias("time"), "pos")


@query(_with(HANDOFF, DEGREE, "kept AS (SELECT node_id, idx FROM top WHERE idx < 300)", "lab AS (SELECT a.idx AS u, b.idx AS v, strftime(day, '%Y-%m') AS label FROM rows JOIN kept a ON a.node_id = source JOIN kept b ON b.node_id = target)")
       + "SELECT (dense_rank() OVER (ORDER BY label) - 1)::INTEGER AS t, u::INTEGER AS u, v::INTEGER AS v, count(*)::DOUBLE AS w FROM lab GROUP BY label, u, v")
def trust_graph_edges(spark, sf_dir):
    """The default of 300 nodes."""
    return E.trust_graph(_trust_rows(spark, sf_dir)).edges


@query("""WITH r AS (SELECT o_custkey AS source, o_orderkey AS target, year(o_orderdate) AS y, o_orderkey % 5 = 0 AS none, (o_orderkey % 3)::DOUBLE AS wt, o_orderkey AS pos FROM orders),
ends AS (SELECT source AS id, 0 AS side, pos FROM r UNION ALL SELECT target, 1, pos FROM r),
deg AS (SELECT id, count(*) AS degree, min(side * 1000000000000 + pos) AS first FROM ends GROUP BY id),
top AS (SELECT id, row_number() OVER (ORDER BY degree DESC, first) - 1 AS idx FROM deg), kept AS (SELECT id, idx FROM top WHERE idx < 1000),
e AS (SELECT y, a.idx AS u, b.idx AS v, CASE WHEN none THEN 1.0 ELSE wt END AS w FROM r JOIN kept a ON a.id = source JOIN kept b ON b.id = target)
SELECT (dense_rank() OVER (ORDER BY y) - 1)::INTEGER AS t, u::INTEGER AS u, v::INTEGER AS v, sum(w)::DOUBLE AS w FROM e GROUP BY y, u, v""")
def yearly_graph_edges(spark, sf_dir):
    """All years and the default of 1000 nodes."""
    key = F.col("o_orderkey")
    rows = E.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source"), key.alias("target"), F.year("o_orderdate").alias("year"), F.when(key % 5 != 0, (key % 3).cast("double")).alias("weight"), key.alias("pos"))
    last = rows.agg(F.max(F.greatest("source", "target"))).first()[0]
    return E.yearly_graph(rows, (last or 0) + 1).edges


@query("SELECT (dense_rank() OVER (ORDER BY label) - 1)::INTEGER AS t, label FROM (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS label FROM orders)")
def time_bins(spark, sf_dir):
    label = E.table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("label")).distinct()
    return label.select((F.row_number().over(Window.orderBy("label")) - 1).alias("t"), "label")


# Transforms


@query(_with(TRADE) + "SELECT u, v, round(sum(w) / (SELECT steps FROM dims), 6) AS w FROM edges GROUP BY u, v")
def mean_snapshot(spark, sf_dir):
    g = E.trade_graph(spark, sf_dir)
    return T.mean_snapshot(g.edges, g.steps).select("u", "v", _r("w"))


@query(_with(TRADE) + "SELECT u, v, round(sum(w) / 2, 6) AS w FROM (SELECT u, v, sum(w) / (SELECT steps FROM dims) AS w FROM edges GROUP BY 1, 2 UNION ALL SELECT v, u, sum(w) / (SELECT steps FROM dims) FROM edges GROUP BY 1, 2) GROUP BY u, v")
def symmetric_mean(spark, sf_dir):
    g = E.trade_graph(spark, sf_dir)
    return T.symmetric(T.mean_snapshot(g.edges, g.steps)).select("u", "v", _r("w"))


@query(_with(TRADE, GRID) + "SELECT t, u, v, round(w, 4) AS w FROM grid")
def dense_cells(spark, sf_dir):
    return E.trade_graph(spark, sf_dir).dense().select("t", "u", "v", _r("w", 4))


@query("""WITH e AS (SELECT (year(o_orderdate) - 1995)::INTEGER AS t, c_nationkey AS u, s_nationkey AS v, sum(CASE l_returnflag WHEN 'R' THEN -1.0 WHEN 'A' THEN 1.0 ELSE 0.0 END)::DOUBLE AS w
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3) SELECT * FROM e WHERE w <> 0""")
def nonzero_entries(spark, sf_dir):
    return T.nonzero(E.trade_edges(spark, sf_dir, signed=True))


@query(_with(TRADE) + "SELECT a.u AS a, b.u AS b, round(sum(a.w * b.w), 4) AS g FROM edges a JOIN edges b ON a.t = b.t AND a.v = b.v GROUP BY 1, 2")
def source_gram(spark, sf_dir):
    return T.source_gram(E.trade_edges(spark, sf_dir)).select("a", "b", _r("g", 4))


STITCH = """m AS (SELECT u, v, sum(CASE WHEN t % 2 = 0 THEN w ELSE 0 END) / (SELECT count(*) FROM range(steps) r(i) WHERE i % 2 = 0) AS m1, sum(CASE WHEN t % 2 = 1 THEN w ELSE 0 END) / (SELECT count(*) FROM range(steps) r(i) WHERE i % 2 = 1) AS m2 FROM edges, dims GROUP BY u, v, steps),
st AS (SELECT *, CASE WHEN u < v THEN m1 WHEN u > v THEN m2 ELSE (m1 + m2) / 2 END AS w FROM m)"""
STITCH = STITCH.replace("(SELECT count(*) FROM range(steps) r(i) WHERE i % 2 = 0)", "((steps + 1) // 2)").replace("(SELECT count(*) FROM range(steps) r(i) WHERE i % 2 = 1)", "(steps // 2)")


def _halves(g):
    return [1 if t % 2 == 0 else 2 for t in range(g.steps)]


@query(_with(TRADE, STITCH) + "SELECT u, v, round(w, 6) AS w FROM st")
def split_stitch(spark, sf_dir):
    g = E.trade_graph(spark, sf_dir)
    return T.stitch(g.edges, _halves(g)).select("u", "v", _r("w"))


@query(_with(TRADE, STITCH) + """SELECT round(max(CASE WHEN u < v THEN abs(w - m1) END), 6) AS upper_error, round(max(CASE WHEN u > v THEN abs(w - m2) END), 6) AS lower_error,
  round(max(CASE WHEN u = v THEN abs(w - (m1 + m2) / 2) END), 6) AS diagonal_error, round(corr(m1, m2) FILTER (u <> v), 6) AS half_correlation,
  round((SELECT sqrt(sum((coalesce(a.w, 0) - coalesce(b.w, 0)) ** 2)) FROM st a FULL JOIN st b ON a.u = b.v AND a.v = b.u) / sqrt(sum(w * w)), 6) AS asymmetry FROM st""")
def split_report(spark, sf_dir):
    g = E.trade_graph(spark, sf_dir)
    row = T.stitch_report(g.edges, _halves(g))
    return row.select(*[_r(c) for c in row.columns])


@query(_with(TRADE, "m AS (SELECT u, v, sum(w) AS w FROM edges GROUP BY u, v)") + "SELECT round((SELECT sqrt(sum((coalesce(a.w, 0) - coalesce(b.w, 0)) ** 2)) FROM m a FULL JOIN m b ON a.u = b.v AND a.v = b.u) / (SELECT sqrt(sum(w * w)) FROM m), 6) AS asymmetry")
def asymmetry_norm(spark, sf_dir):
    g = E.trade_graph(spark, sf_dir)
    return T.relative_asymmetry(T.mean_snapshot(g.edges, g.steps)).select(_r("asymmetry"))


HASHED = "((t * 7919 + u * 104729 + v * 1299709 + 3 * 15485863) * 48271 + 11) % 1000003 / 1000003.0"


@query(_with(TRADE) + f"SELECT t, u, v, round(w, 4) AS w, {HASHED} < 0.1 AS heldout FROM (SELECT t::BIGINT AS t, u::BIGINT AS u, v::BIGINT AS v, w FROM edges WHERE w <> 0)")
def heldout_split(spark, sf_dir):
    g = T.heldout_split(E.trade_graph(spark, sf_dir), 0.1, seed=3)
    both = g.edges.withColumn("heldout", F.lit(False)).unionByName(g.heldout.withColumn("heldout", F.lit(True)))
    return both.select(F.col("t").cast("long").alias("t"), F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), _r("w", 4), "heldout")


# Factors

POWER = _with(TRADE, """m AS (SELECT n_nationkey AS u, b.nk AS v, coalesce(w, 0) AS w FROM nation CROSS JOIN (SELECT n_nationkey AS nk FROM nation) b LEFT JOIN (SELECT u, v, sum(w) / (SELECT steps FROM dims) AS w FROM edges GROUP BY u, v) x ON x.u = n_nationkey AND x.v = b.nk)""",
              "rowsof AS (SELECT u, array_agg(w ORDER BY v) AS r FROM m GROUP BY u)", "gram AS (SELECT a.v AS i, array_agg(a.g ORDER BY a.k) AS r FROM (SELECT x.v AS v, y.v AS k, sum(x.w * y.w) AS g FROM m x JOIN m y ON x.u = y.u GROUP BY 1, 2) a GROUP BY a.v)",
              "gm AS (SELECT array_agg(r ORDER BY i) AS g FROM gram)",
              "it(k, x) AS (SELECT 0, list_transform(range(n), lambda i: 1 / sqrt(n)) FROM dims UNION ALL SELECT k + 1, list_transform(y, lambda a: a / sqrt(list_dot_product(y, y))) FROM (SELECT k, list_transform(g, lambda r: list_dot_product(r, x)) AS y FROM it, gm WHERE k < 12))",
              "vec AS (SELECT x FROM it WHERE k = 12)", "img AS (SELECT u, list_dot_product(r, x) AS y FROM rowsof, vec)", "lam AS (SELECT sqrt(sum(y * y)) AS l FROM img)", recursive=True)


@query(POWER + "SELECT u, round(y / l, 6) AS left_x, round(x[u + 1], 6) AS right_x, round(l, 4) AS value FROM img, lam, vec")
def rank_one_factors(spark, sf_dir):
    _, s = demo.rank_one_store(spark, sf_dir)
    first = lambda df, k, out: df.select(F.col(k).alias("u"), F.round(F.get("f", F.lit(0)), 6).alias(out))
    return first(s.left, "u", "left_x").join(first(s.right, "v", "right_x"), "u").withColumn("value", F.round(F.lit(s.lambdas[0]), 4))


@query(POWER + "SELECT t, e.u, e.v, round(g / l * l * (a.y / l) * x[e.v + 1], 5) AS score FROM (SELECT t, sum(w * (y / l) * x[v + 1]) AS g FROM edges JOIN img USING (u), lam, vec GROUP BY t) w, (SELECT DISTINCT u, v FROM edges) e JOIN img a USING (u), lam, vec")
def rank_one_scores(spark, sf_dir):
    g, s = demo.rank_one_store(spark, sf_dir)
    pairs = g.edges.select("u", "v").distinct()
    cells = pairs.crossJoin(g.times.select("t"))
    return s.score(cells).select("t", "u", "v", _r("score", 5))


@query(_with(TRADE, GRID) + "SELECT t, (p * 5 + q)::INTEGER AS j, round(sum(w) / sqrt(count(DISTINCT u) * count(DISTINCT v)), 5) AS x FROM grid GROUP BY t, p, q")
def temporal_projection(spark, sf_dir):
    _, s = demo.block_store(spark, sf_dir, residuals=False)
    return L.long_form(s.temporal, "t").select("t", "j", _r("x", 5))


@query(_with(TRADE, GRID, BLOCK) + "SELECT round(sum(w * w), 4) AS data_energy, round(sum(base * base), 4) AS model_energy, round(sum(e * e), 4) AS residual_energy, count(*) AS cells FROM err")
def residual_energy(spark, sf_dir):
    g, s = demo.block_store(spark, sf_dir, residuals=False)
    row = L.residual_energy(g.edges, s.left, s.right, s.temporal, list(s.lambdas), s.n, s.m)
    return row.select(_r("data_energy", 4), _r("model_energy", 4), _r("residual_energy", 4), "cells")


NORMS = """lam AS (SELECT (p * 5 + q)::INTEGER AS j, greatest(sqrt(sum(x * x)), 1e-12) AS value, sqrt(avg(x * x)) AS rms FROM (SELECT t, p, q, sum(w) / sqrt(count(DISTINCT u) * count(DISTINCT v)) AS x FROM grid GROUP BY t, p, q) GROUP BY p, q)"""


def _leading(name: str, pairs: str) -> list[str]:
    """CTEs of the leading eigenvector ``name`` (i, x) of the symmetric matrix that ``pairs`` (i, k, g) holds, by power iteration."""
    return [
        f"{name}_rows AS (SELECT a.n_nationkey AS i, array_agg(coalesce(p.g, 0.0) ORDER BY b.n_nationkey) AS r FROM nation a CROSS JOIN nation b LEFT JOIN ({pairs}) p ON p.i = a.n_nationkey AND p.k = b.n_nationkey GROUP BY 1)",
        f"{name}_mat AS (SELECT array_agg(r ORDER BY i) AS g FROM {name}_rows)",
        f"""{name}_it(k, x) AS (SELECT 0, list_transform(range(n), lambda i: 1 / sqrt(n)) FROM dims UNION ALL
  SELECT k + 1, list_transform(y, lambda a: a / sqrt(list_dot_product(y, y))) FROM (SELECT k, list_transform(g, lambda r: list_dot_product(r, x)) AS y FROM {name}_it, {name}_mat WHERE k < 30))""",
        f"{name} AS (SELECT unnest(x) AS x, unnest(range(len(x))) AS i FROM {name}_it WHERE k = 30)",
    ]


MEAN = "mean AS (SELECT u, v, sum(w) / (SELECT steps FROM dims) AS w FROM edges GROUP BY u, v)"
SYM = "sym AS (SELECT u, v, sum(w) / 2 AS w FROM (SELECT u, v, w FROM mean UNION ALL SELECT v, u, w FROM mean) GROUP BY u, v)"
GRAM = "SELECT a.{x} AS i, b.{x} AS k, sum(a.w * b.w) AS g FROM {m} a JOIN {m} b ON a.{y} = b.{y}{and_t} GROUP BY 1, 2"
RANK_ONE = """SELECT s.t, l.i::INTEGER AS u, r.i::INTEGER AS v, round(g * l.x * r.x, 5) AS score
FROM (SELECT t, sum(w * l.x * r.x) AS g FROM edges JOIN l ON l.i = u JOIN r ON r.i = v GROUP BY t) s CROSS JOIN l CROSS JOIN r"""


def _rank_one(matrix: str, *ctes: str, each_step: bool = False) -> str:
    and_t = " AND a.t = b.t" if each_step else ""
    sides = [_leading(k, GRAM.format(x=x, y=y, m=matrix, and_t=and_t)) for k, x, y in (("l", "u", "v"), ("r", "v", "u"))]
    return _with(TRADE, *ctes, *sides[0], *sides[1], recursive=True) + RANK_ONE


def _scores_of(name: str, digits: int) -> Query:
    """Scores of all cells by the store that the named compressor builds with one component."""

    def f(spark, sf_dir):
        g = E.trade_graph(spark, sf_dir)
        store = compress(name, g, CompressionConfig(rank=1))
        return store.score(store.cells(), False).select("t", "u", "v", _r("score", digits))

    return f


for _name, _sql in (
    ("direct_svd", _rank_one("mean", MEAN)),
    ("sym_svd", _rank_one("sym", MEAN, SYM)),
    ("tensor_unfolding_svd", _rank_one("edges", each_step=True)),
    # Of a positive matrix the leading pair is positive, so one component is that of the SVD; its scale enters twice.
    ("nmf", _rank_one("mean", MEAN).replace("round(g * l.x * r.x, 5)", "round(g * l.x * r.x * (SELECT power(sum(w * l.x * r.x), 2) FROM mean JOIN l ON l.i = u JOIN r ON r.i = v), 2)")),
):
    QUERIES[f"{_name}_rank_one"] = _scores_of(_name, 2 if _name == "nmf" else 5)
    ORACLE[f"{_name}_rank_one"] = _sql


@query(_with(TRADE) + "SELECT a.v AS a, b.v AS b, round(sum(a.w * b.w), 4) AS g FROM edges a JOIN edges b ON a.t = b.t AND a.u = b.u GROUP BY 1, 2")
def target_gram(spark, sf_dir):
    return T.target_gram(E.trade_edges(spark, sf_dir)).select("a", "b", _r("g", 4))


@query(_with(TRADE, STITCH, MEAN) + "SELECT u, v, round(0.65 * st.w + 0.35 * mean.w, 6) AS w FROM st JOIN mean USING (u, v)")
def blended_basis(spark, sf_dir):
    g = E.trade_graph(spark, sf_dir)
    return T.blend(T.stitch(g.edges, _halves(g)), T.mean_snapshot(g.edges, g.steps), 0.35).select("u", "v", _r("w"))


@query(_with(TRADE, GRID, NORMS) + "SELECT j, round(value, 5) AS norm FROM lam")
def component_norms(spark, sf_dir):
    _, s = demo.block_store(spark, sf_dir, residuals=False)
    return L.component_norms(s.temporal, "t").select("j", _r("norm", 5))


@query(_with(TRADE, GRID, NORMS) + "SELECT j, round(value, 5) AS value FROM (SELECT *, coalesce(sum(value * value) OVER (ORDER BY value * value DESC, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(value * value) OVER () AS cum FROM lam) WHERE cum < 0.8")
def energy_prune(spark, sf_dir):
    _, s = demo.block_store(spark, sf_dir, residuals=False)
    lam = L.component_norms(s.temporal, "t").select("j", F.col("norm").alias("lambda"))
    return L.energy_prune(lam, 0.8).select("j", F.round("lambda", 5).alias("value"))


@query(_with(TRADE, GRID, NORMS) + "SELECT j, round(rms, 5) AS strength FROM (SELECT *, max(rms) OVER () AS top FROM lam) WHERE rms >= 0.7 * top")
def strength_prune(spark, sf_dir):
    _, s = demo.block_store(spark, sf_dir, residuals=False)
    ones = spark.range(s.rank).select(F.col("id").cast("int").alias("j"), F.lit(1.0).alias("lambda"))
    return L.strength_prune(s.temporal, ones, 0.7).select("j", _r("strength", 5))


# Residuals, bounds, storage


def _threshold(mode: str, **options):
    def f(spark, sf_dir):
        g, s = demo.block_store(spark, sf_dir, residuals=False)
        return R.threshold_row(R.residual_cells(g.edges, s), g.steps * g.n**2, mode, **options).select(_r("threshold"))

    return f


MAD = "q AS (SELECT quantile_cont(abs(e), 0.98) AS q, quantile_cont(abs(e), 0.95) AS tail, median(abs(e)) AS mid, max(abs(e)) AS top FROM err), s AS (SELECT 1.4826 * median(abs(abs(e) - mid)) AS sigma FROM err, q)"
for _name, _mode, _mult, _sql in (
    ("threshold_quantile", "quantile", 45.0, "SELECT round(q, 6) AS threshold FROM q"),
    ("threshold_mad", "mad", 3.0, "SELECT round(CASE WHEN sigma <= 1e-12 THEN top + 1 ELSE mid + 3 * sigma END, 6) AS threshold FROM q, s"),
    ("threshold_hybrid", "hybrid", 45.0, "SELECT round(CASE WHEN q < mid + 45 * sigma AND q > 1.2 * greatest(tail, 1e-12) THEN q ELSE mid + 45 * sigma END, 6) AS threshold FROM q, s"),
):
    QUERIES[_name] = _threshold(_mode, multiplier=_mult, tail_ratio=1.2)
    ORACLE[_name] = _with(TRADE, GRID, BLOCK, MAD) + _sql


@query(BASE + "SELECT t, u, v, round(value, 6) AS value FROM res")
def residual_entries(spark, sf_dir):
    _, s = demo.block_store(spark, sf_dir)
    return s.residuals.select("t", "u", "v", _r("value"))


@query(_with(TRADE, GRID, BLOCK, MU.format(w="abs(w)"), "sig AS (SELECT max(s) AS sigma FROM (SELECT t, median(abs(e - mid)) / 0.6745 AS s FROM (SELECT *, median(e) OVER (PARTITION BY t) AS mid FROM err) GROUP BY t))") + "SELECT u, round(mu, 6) AS mu, round(1 / sqrt(mu), 6) AS src_scale, round(sigma, 6) AS sigma FROM mu, sig")
def bound_metadata(spark, sf_dir):
    g, s = demo.block_store(spark, sf_dir)
    s = R.with_bound_metadata(s, g.edges, R.residual_cells(g.edges, s))
    return s.node_bounds.select("u", _r("mu"), _r("src_scale"), F.round(F.lit(s.bound_sigma_max), 6).alias("sigma"))


BOUNDED = _with(TRADE, GRID, BLOCK, MU.format(w="w"), SIGMA_UNCENTRED)


def _bounded_store(spark, sf_dir):
    g, s = demo.block_store(spark, sf_dir)
    return g, s.precompute_bounds(g.edges)


@query(BOUNDED + "SELECT u, round(mu, 6) AS mu, round(sigma, 6) AS sigma FROM mu, sig")
def bound_params(spark, sf_dir):
    _, s = _bounded_store(spark, sf_dir)
    return s.node_bounds.select("u", _r("mu"), F.round(F.lit(s.bound_sigma_max), 6).alias("sigma"))


@query(BOUNDED + f"SELECT a.u AS u, b.u AS v, round({THEORY}, 6) AS bound FROM mu a CROSS JOIN mu b, sig, dims")
def entrywise_bound(spark, sf_dir):
    _, s = _bounded_store(spark, sf_dir)
    return s.with_bound(s.cells(0)).select("u", "v", _r("bound"))


@query(BOUNDED + f"SELECT r.t, r.u, r.v, round({THEORY} + abs(r.residual), 6) AS bound FROM scored r JOIN mu a ON a.u = r.u JOIN mu b ON b.u = r.v, sig, dims WHERE r.t = 2")
def bound_matrix(spark, sf_dir):
    _, s = _bounded_store(spark, sf_dir)
    return s.error_bound(s.cells(2), include_residual=False).select("t", "u", "v", _r("bound"))


def _longs(spark, values: dict[str, float], digits: int = 6) -> DataFrame:
    return spark.range(1).select(*[F.round(F.lit(float(v)), digits).alias(k) for k, v in values.items()])


SIZES = "k AS (SELECT count(*)::DOUBLE AS nnz FROM res), e AS (SELECT count(*)::DOUBLE AS edges FROM edges)"


@query(_with(TRADE, GRID, BLOCK, SIZES) + """SELECT ((n + n + steps + 1) * 25 * 8)::DOUBLE AS factor_bytes, ((n + n + steps + 1) * 25 * 4)::DOUBLE AS float32_factor_bytes, 20 * nnz AS coo_bytes, 12 * nnz + 4 * (n + 1) * steps AS csr_bytes,
  (steps * n * n * 8)::DOUBLE AS raw_dense_bytes, 12 * edges + 4 * (n + 1) * steps AS raw_sparse_bytes FROM dims, k, e""")
def storage_bytes(spark, sf_dir):
    g, s = demo.block_store(spark, sf_dir)
    nnz = s.residual_nnz()
    return _longs(spark, {"factor_bytes": s.factor_bytes(), "float32_factor_bytes": s.factor_bytes(4), "coo_bytes": residual_bytes(nnz, s.steps, s.n, "temporal_coo"), "csr_bytes": residual_bytes(nnz, s.steps, s.n, "csr"), "raw_dense_bytes": s.raw_dense_bytes(), "raw_sparse_bytes": raw_sparse_bytes(g.edges.count(), s.steps, s.n)})


@query(_with(TRADE, GRID, BLOCK, SIZES, "z AS (SELECT (n + n + steps + 1) * 25 * 8.0 + 20 * nnz AS c, steps * n * n * 8.0 AS d, 12 * edges + 4 * (n + 1) * steps AS s FROM dims, k, e)") + "SELECT round(d / c, 6) AS compression_ratio, round(c / d, 6) AS compressed_vs_raw_dense_ratio, round(c / s, 6) AS compressed_vs_raw_sparse_ratio FROM z")
def storage_ratios(spark, sf_dir):
    g, s = demo.block_store(spark, sf_dir)
    return _longs(spark, s.ratios(g.edges.count(), metadata=False))


@query(_with(TRADE, GRID, BLOCK, SIZES, "z AS (SELECT (n + n + steps + 1) * 25 * 8.0 AS f, 20 * nnz AS r, 12 * edges + 4 * (n + 1) * steps AS s FROM dims, k, e)") + "SELECT round((f + r) / s, 6) AS ratio_before, round(CASE WHEN (f + r) / s > 0.2 THEN f / s ELSE (f + r) / s END, 6) AS ratio_after, (f + r) / s <= 0.2 AS accepted_before, (f + r) / s > 0.2 AS residual_dropped FROM z")
def storage_gate(spark, sf_dir):
    g, s = demo.block_store(spark, sf_dir)
    report = R.storage_gate(s, g.edges.count(), 0.2, "drop_residual").diagnostics["storage_gate"]
    return spark.range(1).select(F.round(F.lit(report["ratio_before"]), 6).alias("ratio_before"), F.round(F.lit(report["ratio_after"]), 6).alias("ratio_after"), F.lit(report["accepted_before"]).alias("accepted_before"), F.lit(report["residual_dropped"]).alias("residual_dropped"))


# Link, neighbour, trend and anomaly queries


@query(_with(TRADE, GRID, BLOCK, REQ) + "SELECT qid, round(base, 6) AS base, round(score, 6) AS score FROM req JOIN scored USING (t, u, v)")
def link_scores(spark, sf_dir):
    g, s = demo.block_store(spark, sf_dir)
    return s.with_residual(s.with_base(demo.requests(g))).select("qid", _r("base"), F.round(F.col("base") + F.col("residual"), 6).alias("score"))


@query(BASE + "SELECT u, v, round(score, 6) AS score FROM scored WHERE t = 3")
def dense_snapshot(spark, sf_dir):
    _, s = demo.block_store(spark, sf_dir)
    return s.dense_snapshot(3).select("u", "v", _r("score"))


@query(BASE + "SELECT v, round(value, 6) AS value FROM res WHERE t = 2 AND u = (SELECT min(u) FROM res WHERE t = 2)")
def residual_row(spark, sf_dir):
    _, s = demo.block_store(spark, sf_dir)
    first = s.residual_snapshot(2).agg(F.min("u")).first()[0]
    return s.residual_row(2, first or 0).select("v", _r("value"))


@query(BOUNDED.rstrip() + ",\n" + REQ + f"\nSELECT qid, round(score, 6) AS estimate, round(2 * ({THEORY}), 6) AS bound, TRUE AS used_residual, 'factor_residual' AS method FROM req r JOIN scored USING (t, u, v) JOIN mu a ON a.u = r.u JOIN mu b ON b.u = r.v, sig, dims")
def link_prob_bounded(spark, sf_dir):
    g, s = _bounded_store(spark, sf_dir)
    return QueryEngine(s, bound_factor=2.0).links_with_error(demo.requests(g)).select("qid", _r("estimate"), _r("bound"), "used_residual", "method")


OPTIMIZED = """b AS (SELECT r.*, base, residual, {theory} AS cb FROM {req} r JOIN scored USING (t, u, v) JOIN mu a ON a.u = r.u JOIN mu b ON b.u = r.v, sig, dims),
tol AS (SELECT median(cb) AS tol FROM (SELECT {theory} AS cb FROM mu a CROSS JOIN mu b, sig, dims)),
o AS (SELECT *, cb + abs(residual) > tol AS used FROM b, tol)""".replace("{theory}", THEORY)
OUT = "round(CASE WHEN used THEN base + residual ELSE base END, 6) AS estimate, round(CASE WHEN used THEN cb ELSE cb + abs(residual) END, 6) AS bound, used AS used_residual, CASE WHEN used THEN cb <= tol ELSE TRUE END AS satisfied_error_tolerance FROM o"


def _tolerance(s) -> float:
    return s.with_bound(s.cells(0)).agg(F.median("bound")).first()[0]


@query(BOUNDED.rstrip() + ",\n" + REQ + ",\n" + OPTIMIZED.format(req="req") + "\nSELECT qid, " + OUT)
def link_prob_optimized(spark, sf_dir):
    g, s = _bounded_store(spark, sf_dir)
    return QueryEngine(s).links_optimized(demo.requests(g), _tolerance(s)).select("qid", _r("estimate"), _r("bound"), "used_residual", "satisfied_error_tolerance")


def _top(score: str, source: str = "scored") -> str:
    return f"SELECT qid, rank::INTEGER AS rank, v, round(s, 6) AS score FROM (SELECT qid, k, s.v, {score} AS s, row_number() OVER (PARTITION BY qid ORDER BY round({score}, 9) DESC, s.v) AS rank FROM topreq r JOIN {source} s ON s.t = r.t AND s.u = r.u AND s.v <> r.u) WHERE rank <= k"


def _neighbors(found: DataFrame) -> DataFrame:
    return found.select("qid", "rank", "v", _r("score"))


@query(_with(TRADE, GRID, BLOCK, TOP) + _top("s.base"))
def top_neighbor_scan(spark, sf_dir):
    g, s = demo.block_store(spark, sf_dir)
    return _neighbors(QueryEngine(s).top_neighbors(demo.top_requests(g)))


@query(_with(TRADE, GRID, BLOCK, TOP) + _top("s.score"))
def top_neighbor_residual(spark, sf_dir):
    g, s = demo.block_store(spark, sf_dir)
    return _neighbors(QueryEngine(s).top_neighbors(demo.top_requests(g), include_residual=True))


@query(_with(TRADE, GRID, BLOCK, TOP) + _top("s.score"))
def top_neighbor_indexed_rerank(spark, sf_dir):
    g, s = demo.block_store(spark, sf_dir)
    return _neighbors(QueryEngine(s).indexed_neighbors(demo.top_requests(g), include_residual=True))


@query(_with(TRADE, GRID, BLOCK, TOP) + _top("s.w", "grid"))
def top_neighbor_raw(spark, sf_dir):
    g, s = demo.block_store(spark, sf_dir, residuals=False)
    return _neighbors(QueryEngine(s, raw=g.edges).raw_neighbors(demo.top_requests(g)))


@query(_with(TRADE, GRID, BLOCK, TOP, "big AS (SELECT qid, coalesce(max(abs(value)), 0.0) AS m FROM topreq r LEFT JOIN res e ON e.t = r.t AND e.u = r.u GROUP BY qid)", "tl AS (SELECT thr * 1.5 AS tol FROM thr)",
             "pick AS (SELECT s.t, s.u, s.v, m, m > tol AS used, CASE WHEN m > tol THEN s.score ELSE s.base END AS x FROM scored s JOIN topreq r ON r.t = s.t AND r.u = s.u JOIN big USING (qid), tl)")
       + "SELECT qid, rank::INTEGER AS rank, v, round(x, 6) AS score, CASE WHEN used THEN 'indexed_exact_residual' ELSE 'indexed_exact_factor_only' END AS path, round(CASE WHEN used THEN 0.0 ELSE m END, 6) AS bound FROM (SELECT qid, k, s.v, x, used, m, row_number() OVER (PARTITION BY qid ORDER BY round(x, 9) DESC, s.v) AS rank FROM topreq r JOIN pick s ON s.t = r.t AND s.u = r.u AND s.v <> r.u) WHERE rank <= k")
def top_neighbor_plan(spark, sf_dir):
    g, s = demo.block_store(spark, sf_dir)
    engine = QueryEngine(s)
    engine.index("exact")
    found = engine.neighbors_optimized(demo.top_requests(g), 1.5 * s.diagnostics["estimated_threshold"])
    return found.select("qid", "rank", "v", _r("score"), "path", _r("bound"))


@query(_with(TRADE, GRID, BLOCK, TREND) + "SELECT qid, t, round(score, 6) AS score FROM trend JOIN scored USING (t, u, v)")
def temporal_trend(spark, sf_dir):
    g, s = demo.block_store(spark, sf_dir)
    return QueryEngine(s).trends(demo.trend_requests(g)).select("qid", "t", _r("score"))


@query(BOUNDED.rstrip() + ",\n" + TREND + f"\nSELECT qid, r.t, round(score, 6) AS estimate, round({THEORY}, 6) AS bound FROM trend r JOIN scored USING (t, u, v) JOIN mu a ON a.u = r.u JOIN mu b ON b.u = r.v, sig, dims")
def temporal_trend_bounded(spark, sf_dir):
    g, s = _bounded_store(spark, sf_dir)
    return QueryEngine(s).trends_with_error(demo.trend_requests(g)).select("qid", "t", _r("estimate"), _r("bound"))


@query(BOUNDED.rstrip() + ",\n" + TREND + ",\n" + OPTIMIZED.format(req="trend") + "\nSELECT qid, t, " + OUT)
def temporal_trend_optimized(spark, sf_dir):
    g, s = _bounded_store(spark, sf_dir)
    return QueryEngine(s).trends_optimized(demo.trend_requests(g), _tolerance(s)).select("qid", "t", _r("estimate"), _r("bound"), "used_residual", "satisfied_error_tolerance")


@query(BASE + "SELECT u, v, round(value, 6) AS value FROM res, thr WHERE t = 1 AND abs(value) > thr * 1.2")
def anomaly_detect(spark, sf_dir):
    _, s = demo.block_store(spark, sf_dir)
    return QueryEngine(s).anomaly_detect(1, 1.2 * s.diagnostics["estimated_threshold"]).select("u", "v", _r("value"))


@query(BASE + "SELECT t::BIGINT AS qid, t, u, v, round(value, 6) AS value FROM res, thr WHERE abs(value) > thr * (1 + t / 10.0)")
def anomaly_detect_batch(spark, sf_dir):
    g, s = demo.block_store(spark, sf_dir)
    asked = g.times.select(F.col("t").cast("long").alias("qid"), "t", (F.lit(s.diagnostics["estimated_threshold"]) * (1 + F.col("t") / 10)).alias("threshold"))
    return QueryEngine(s).anomalies(asked).select("qid", "t", "u", "v", _r("value"))


@query(_with(TRADE, GRID, BLOCK, TOP) + "SELECT qid, round(coalesce(max(abs(value)), 0.0), 6) AS residual_max FROM topreq r LEFT JOIN res e ON e.t = r.t AND e.u = r.u GROUP BY qid")
def residual_row_max(spark, sf_dir):
    g, s = demo.block_store(spark, sf_dir)
    return QueryEngine(s).residual_row_max(demo.top_requests(g)).select("qid", _r("residual_max"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 20 = 0),
p AS (SELECT q.vec_id AS qid, v.vec_id AS v, list_dot_product(q.e, v.e) AS s FROM q JOIN v ON q.vec_id <> v.vec_id),
r AS (SELECT qid, v, s, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, v) AS rank FROM p) SELECT qid, rank::INTEGER AS rank, v, round(s, 6) AS score FROM r WHERE rank <= 5""")
def mips_embeddings(spark, sf_dir):
    from .operators.index import ExactIndex

    rows = E.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("v"), F.transform("embedding", lambda x: x.cast("double")).alias("f"))
    asked = rows.where(F.col("v") % 20 == 0).select(F.col("v").alias("qid"), F.col("f").alias("q"), F.col("v").alias("exclude"), F.lit(5).alias("k"))
    return _neighbors(ExactIndex(rows, 64).search(asked))


# Evaluation


def _cells_of(spark, sf_dir, include_residual: bool = False):
    g, s = demo.block_store(spark, sf_dir)
    return g, s, M.scored_cells(s, g.edges.withColumnRenamed("w", "x"), include_residual)


@query(BASE + "SELECT round(sqrt(sum((base - w) ** 2) / sum(w * w)), 6) AS factor_only, round(sqrt(sum((score - w) ** 2) / sum(w * w)), 6) AS with_residual FROM scored")
def frobenius_error(spark, sf_dir):
    parts = [M.relative_frobenius(_cells_of(spark, sf_dir, r)[2]).select(F.round("relative_frobenius", 6).alias(n)) for n, r in (("factor_only", False), ("with_residual", True))]
    return parts[0].crossJoin(parts[1])


@query(BASE + "SELECT count(*) AS edges, round(sqrt(avg((base - w) ** 2)), 6) AS rmse, round(avg(abs(base - w)), 6) AS mae FROM cells JOIN edges USING (t, u, v, w)")
def observed_edge_errors(spark, sf_dir):
    g, s = demo.block_store(spark, sf_dir)
    return M.observed_errors(s, g.edges).select("edges", _r("rmse"), _r("mae"))


@query(BASE + "SELECT round(max(abs(base - w)), 6) AS max_error, round(avg(abs(base - w)), 6) AS mean_error, round(quantile_cont(abs(base - w), 0.5), 6) AS p50, round(quantile_cont(abs(base - w), 0.9), 6) AS p90, round(quantile_cont(abs(base - w), 0.99), 6) AS p99 FROM scored")
def entrywise_errors(spark, sf_dir):
    row = M.entrywise_errors(_cells_of(spark, sf_dir)[2])
    return row.select(*[_r(c) for c in row.columns])


@query(BOUNDED.rstrip() + f",\nx AS (SELECT abs(r.score - r.w) AS e, {THEORY} AS bound FROM scored r JOIN mu a ON a.u = r.u JOIN mu b ON b.u = r.v, sig, dims)\n" + """SELECT round(avg((e <= bound + 1e-12)::INT), 6) AS coverage, sum((e > bound + 1e-12)::INT)::BIGINT AS violations, count(*) AS cells, round(max(greatest(e - bound, 0)), 6) AS max_violation,
  round(avg(bound), 6) AS mean_bound, round(max(bound), 6) AS max_bound, round(median(bound), 6) AS median_bound, round(avg(e), 6) AS mean_error, round(max(e), 6) AS max_error, round(median(e), 6) AS median_error FROM x""")
def bound_report(spark, sf_dir):
    g, s = _bounded_store(spark, sf_dir)
    row = M.bound_report(s.error_bound(M.scored_cells(s, g.edges.withColumnRenamed("w", "x"), True)))
    return row.select(*[c if c in ("violations", "cells") else _r(c) for c in row.columns])


@query(BOUNDED.rstrip() + f",\nx AS (SELECT abs(r.score - r.w) AS e, {THEORY} AS bound FROM scored r JOIN mu a ON a.u = r.u JOIN mu b ON b.u = r.v, sig, dims)\nSELECT round(avg(e) / avg(bound), 6) AS tightness FROM x")
def bound_tightness(spark, sf_dir):
    g, s = _bounded_store(spark, sf_dir)
    return M.bound_tightness(s.error_bound(M.scored_cells(s, g.edges.withColumnRenamed("w", "x"), True))).select(_r("tightness"))


@query(BASE + "SELECT count(*) AS nnz, round(count(*) / (SELECT count(*)::DOUBLE FROM grid), 6) AS density, round(1 - count(*) / (SELECT count(*)::DOUBLE FROM grid), 6) AS sparsity FROM res")
def residual_sparsity(spark, sf_dir):
    return M.residual_sparsity(demo.block_store(spark, sf_dir)[1]).select("nnz", _r("density"), _r("sparsity"))


@query(BASE.rstrip() + ",\ntruth AS (SELECT t, u, v FROM grid WHERE (t + u + v) % 11 = 0), c AS (SELECT count(*)::DOUBLE AS h FROM res JOIN truth USING (t, u, v)), pr AS (SELECT (SELECT count(*) FROM res) AS predicted, (SELECT count(*) FROM truth) AS actual, h::BIGINT AS hits, h / (SELECT count(*) FROM res) AS p, h / (SELECT count(*) FROM truth) AS r FROM c)\nSELECT predicted, actual, hits, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM pr")
def anomaly_scores(spark, sf_dir):
    g, s = demo.block_store(spark, sf_dir)
    row = M.precision_recall(s.residuals, s.cells().where((F.col("t") + F.col("u") + F.col("v")) % 11 == 0))
    return row.select("predicted", "actual", "hits", _r("precision"), _r("recall"), _r("f1"))


@query("""WITH l AS (SELECT n_regionkey AS a, n_nationkey % 4 AS b FROM nation), j AS (SELECT a, b, count(*)::DOUBLE AS n FROM l GROUP BY a, b), x AS (SELECT a, sum(n) AS m FROM j GROUP BY a), y AS (SELECT b, sum(n) AS m FROM j GROUP BY b),
t AS (SELECT sum(n) AS n, sum(n * ln(n)) AS lab, sum(n * (n - 1) / 2) AS pab FROM j), s AS (SELECT (SELECT sum(m * ln(m)) FROM x) AS la, (SELECT sum(m * ln(m)) FROM y) AS lb, (SELECT sum(m * (m - 1) / 2) FROM x) AS pa, (SELECT sum(m * (m - 1) / 2) FROM y) AS pb)
SELECT round((ln(n) + (lab - la - lb) / n) / ((2 * ln(n) - la / n - lb / n) / 2), 6) AS nmi, round((pab - pa * pb / (n * (n - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (n * (n - 1) / 2)), 6) AS ari FROM t, s""")
def clustering_scores(spark, sf_dir):
    labels = E.table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("truth"), (F.col("n_nationkey") % 4).alias("found"))
    return M.clustering_scores(labels).select(_r("nmi"), _r("ari"))


def _ranked_against(s, requests):
    """qid, positive, negative: the base score of each request beside that of every other target."""
    asked = s.with_base(requests, "positive")
    others = s.with_base(asked.select("qid", "u", "t", F.round("positive", 9).alias("positive"), F.col("v").alias("own")).join(small(s.right.select("v"), s.m, 1), F.col("v") != F.col("own")), "negative")
    return others.select("qid", "positive", F.round("negative", 9).alias("negative"))


@query(_with(TRADE, GRID, BLOCK, REQ, "p AS (SELECT qid, t, u, v, base AS positive FROM req JOIN scored USING (t, u, v))", "z AS (SELECT qid, positive, s.base AS negative FROM p JOIN scored s ON s.t = p.t AND s.u = p.u AND s.v <> p.v)", "k AS (SELECT qid, 1 + count(*) FILTER (round(negative, 9) >= round(positive, 9)) AS rank FROM z GROUP BY qid)")
       + "SELECT count(*) AS requests, round(avg(1.0 / rank), 6) AS mrr, round(avg(rank), 6) AS mean_rank, round(avg((rank <= 1)::INT), 6) AS hits_1, round(avg((rank <= 3)::INT), 6) AS hits_3, round(avg((rank <= 10)::INT), 6) AS hits_10 FROM k")
def ranking_report(spark, sf_dir):
    g, s = demo.block_store(spark, sf_dir)
    others = _ranked_against(s, demo.requests(g))
    asked = others.agg(F.count_distinct("qid").alias("requests"))
    row = M.ranking_report(others.select("qid", "positive", "negative"))
    return asked.crossJoin(row.select(*[_r(c) for c in row.columns]))


@query(_with(TRADE, GRID, BLOCK, TOP, "f AS (" + _top("s.base") + ")", "r AS (" + _top("s.w", "grid") + ")", "o AS (SELECT r.qid, count(f.v) AS overlap, count(*) AS wanted FROM r LEFT JOIN f ON f.qid = r.qid AND f.v = r.v GROUP BY r.qid)") + "SELECT round(avg(overlap), 6) AS mean_overlap, round(avg(overlap / least(wanted, 3)), 6) AS recall FROM o")
def recall_at_k(spark, sf_dir):
    g, s = demo.block_store(spark, sf_dir)
    engine = QueryEngine(s, raw=g.edges)
    return M.recall_at_k(engine.top_neighbors(demo.top_requests(g)), engine.raw_neighbors(demo.top_requests(g)), 3).select(_r("mean_overlap"), _r("recall"))


@query(BASE.rstrip() + ",\na AS (SELECT sqrt(avg((base - w) ** 2)) AS rf, sqrt(avg((score - w) ** 2)) AS rr, avg(abs(base - w)) AS mf, avg(abs(score - w)) AS mr FROM scored JOIN res USING (t, u, v))\nSELECT round(rf, 6) AS rmse_factor, round(rr, 6) AS rmse_residual, round(mf, 6) AS mae_factor, round(mr, 6) AS mae_residual, round((rf - rr) / rf, 6) AS relative_improvement FROM a")
def attack_improvement(spark, sf_dir):
    g, s = demo.block_store(spark, sf_dir)
    row = M.improvement(s, s.cells().join(g.edges, ["t", "u", "v"], "left").withColumn("w", F.coalesce("w", F.lit(0.0))).join(s.residuals.select("t", "u", "v"), ["t", "u", "v"], "left_semi"))
    return row.select(*[_r(c) for c in row.columns])


@query("SELECT l_returnflag AS kind, l_linestatus AS method, round(avg(l_quantity), 6) AS l_quantity_mean, round(stddev_samp(l_quantity), 6) AS l_quantity_std, round(avg(l_discount), 6) AS l_discount_mean, round(stddev_samp(l_discount), 6) AS l_discount_std FROM lineitem GROUP BY 1, 2")
def group_summary(spark, sf_dir):
    rows = E.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("method"), "l_quantity", "l_discount")
    out = M.group_summary(rows, ["kind", "method"], ["l_quantity", "l_discount"])
    return out.select("kind", "method", *[_r(c) for c in out.columns[2:]])


@query("WITH s AS (SELECT o_custkey % 7 AS g, count(*) AS x, sum(o_totalprice) AS y FROM orders GROUP BY o_custkey) SELECT g, round(regr_slope(ln(y), ln(x)), 5) AS slope, count(*) AS points FROM s WHERE x > 0 AND y > 0 GROUP BY g")
def power_law_slope(spark, sf_dir):
    rows = E.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("x"), F.sum("o_totalprice").alias("y")).withColumn("g", F.col("o_custkey") % 7)
    return M.power_law_slope(rows, "x", "y", ["g"]).select("g", _r("slope", 5), "points")


@query("SELECT l_shipmode AS query, min_by(l_linestatus, (l, l_linestatus)) AS method, min(l) AS latency FROM (SELECT l_returnflag AS l_shipmode, l_linestatus, avg(l_quantity) AS l0, round(avg(l_quantity), 6) AS l FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def best_latency(spark, sf_dir):
    rows = E.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("query"), F.col("l_linestatus").alias("method")).agg(F.round(F.avg("l_quantity"), 6).alias("latency"))
    return M.best_latency(rows)


@query("SELECT event_type AS method, round(avg((user_id % 5 = event_id % 5)::INT), 6) AS accuracy FROM events GROUP BY 1")
def rank_accuracy(spark, sf_dir):
    rows = E.table(spark, sf_dir, "events").select(F.col("event_type").alias("method"), (F.col("user_id") % 5).alias("effective_rank"), (F.col("event_id") % 5).alias("true_rank"))
    return M.rank_accuracy(rows).select("method", _r("accuracy"))


# Queries without an SQL form: the tests hold them against brute force or planted truth


@query()
def negative_samples(spark, sf_dir):
    g = E.trade_graph(spark, sf_dir)
    return T.negative_samples(g, demo.requests(g), 3)


@query(_with(TRADE, GRID, REQ, "free AS (SELECT t, count(*) AS n FROM grid WHERE w = 0 GROUP BY t)") + "SELECT qid, r.t, least(3, n)::BIGINT AS samples, least(3, n)::BIGINT AS empty_cells FROM req r JOIN free f ON f.t = r.t")
def negative_sample_counts(spark, sf_dir):
    """Each request's distinct negatives, and how many of them are empty cells of its step."""
    g = E.trade_graph(spark, sf_dir)
    drawn = T.negative_samples(g, demo.requests(g), 3).join(T.nonzero(g.edges), ["t", "u", "v"], "left")
    return drawn.groupBy("qid", "t").agg(F.count_distinct("u", "v").alias("samples"), F.count_if(F.col("w").isNull()).alias("empty_cells"))


@query("SELECT (SELECT count(*) FROM nation) AS requests, TRUE AS enough")
def ann_recall(spark, sf_dir):
    """Whether the projected index finds at least nine in ten of the exact neighbours."""
    g, s = demo.block_store(spark, sf_dir)
    engine, asked = QueryEngine(s), demo.top_requests(g, 5)
    row = M.recall_at_k(engine.indexed_neighbors(asked, mode="ann"), engine.indexed_neighbors(asked), 5)
    return asked.agg(F.count(F.lit(1)).alias("requests")).crossJoin(row.select((F.col("recall") >= 0.9).alias("enough")))  # one row each


@query()
def robust_asym_build(spark, sf_dir):
    g = E.trade_graph(spark, sf_dir)
    s = compress("robust_asym", g, CompressionConfig(rank=4, robust_iterations=2, residual_threshold_mode="quantile"))
    return M.observed_errors(s, g.edges, True).withColumn("nnz", F.lit(s.residual_nnz()))


def _errors_of(name: str) -> Query:
    def f(spark, sf_dir):
        g = E.trade_graph(spark, sf_dir)
        return M.observed_errors(compress(name, g, CompressionConfig(rank=4)), g.edges).withColumn("method", F.lit(name))

    return f


for _name in ("direct_svd", "sym_svd", "tensor_unfolding_svd", "cp_als", "tucker_als", "rpca_svd", "nmf"):
    QUERIES[f"build_{_name}"] = _errors_of(_name)


@query()
def ard_rank(spark, sf_dir):
    g = E.trade_graph(spark, sf_dir)
    s = compress("robust_asym", g, CompressionConfig(rank=6, rank_selection_mode="ard"))
    return spark.range(1).select(F.lit(s.rank).alias("effective_rank"))


@query()
def ann_top_neighbors(spark, sf_dir):
    g, s = demo.block_store(spark, sf_dir)
    return _neighbors(QueryEngine(s).indexed_neighbors(demo.top_requests(g), mode="ann"))


@query()
def community_labels(spark, sf_dir):
    g, s = demo.block_store(spark, sf_dir)
    return QueryEngine(s).community(g.steps - 1, 5)


@query()
def attacked_graph(spark, sf_dir):
    return G.attacked_sbm(spark, n=40, steps=4, communities=3, kind="sparse_spike", fraction=0.02).edges


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top three supplier nations of each customer nation in the last year, from the compressed trade graph."""
    return top_neighbor_residual(spark, sf_dir)


__all__ = ["ORACLE", "QUERIES", "flagship"]
