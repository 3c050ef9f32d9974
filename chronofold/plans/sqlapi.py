"""Stores as SQL: temporary views of the tables and table functions for single requests."""

from __future__ import annotations

from ..operators.store import FactorStore


def register(store: FactorStore, prefix: str = "tg") -> list[str]:
    """Views <prefix>_left, _right, _temporal, _residuals and functions over them; returns the names.

    ``<prefix>_link(u, v, t)``, ``<prefix>_top(u, t, k)``, ``<prefix>_trend(u, v,
    t1, t2)`` and ``<prefix>_anomalies(t, threshold)`` are table functions for
    literal arguments.
    """
    spark = store.spark
    views = {"left": store.left, "right": store.right, "temporal": store.weighted_temporal(), "residuals": store._residuals()}
    for name, df in views.items():
        df.createOrReplaceTempView(f"{prefix}_{name}")
    score = "aggregate(zip_with(zip_with(l.f, r.f, (a, b) -> a * b), w.s, (a, b) -> a * b), 0D, (a, x) -> a + x)"
    res = f"coalesce((SELECT sum(value) FROM {prefix}_residuals e WHERE e.t = w.t AND e.u = l.u AND e.v = r.v), 0D)"
    body = f"FROM {prefix}_left l, {prefix}_right r, {prefix}_temporal w"
    functions = {
        f"{prefix}_link": ("qu INT, qv INT, qt INT", "score DOUBLE", f"SELECT {score} + {res} {body} WHERE l.u = qu AND r.v = qv AND w.t = qt"),
        f"{prefix}_trend": ("qu INT, qv INT, t1 INT, t2 INT", "t INT, score DOUBLE", f"SELECT w.t, {score} + {res} {body} WHERE l.u = qu AND r.v = qv AND w.t BETWEEN t1 AND t2"),
        f"{prefix}_top": ("qu INT, qt INT, k INT", "rank INT, v INT, score DOUBLE", f"SELECT rank, v, score FROM (SELECT row_number() OVER (ORDER BY round(s, 9) DESC, v) AS rank, v, s AS score FROM (SELECT r.v AS v, {score} AS s {body} WHERE l.u = qu AND w.t = qt AND r.v <> qu)) WHERE rank <= k"),
        f"{prefix}_anomalies": ("qt INT, threshold DOUBLE", "u INT, v INT, value DOUBLE", f"SELECT u, v, value FROM {prefix}_residuals WHERE t = qt AND abs(value) > threshold"),
    }
    for name, (arguments, columns, sql) in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS TABLE({columns}) RETURN {sql}")
    return [f"{prefix}_{v}" for v in views] + list(functions)
