import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"


def oracle(name):
    con = duckdb.connect()
    for table in ("nation", "customer", "supplier", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    return con.execute(entry.oracle_sql()[name]).fetchall()


def same(spark, name):
    got = sorted(tuple(r) for r in entry.queries()[name](spark, SF).collect())
    want = sorted(oracle(name))
    assert len(got) == len(want) > 0
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, abs=2e-6)
    return got


def test_every_link_request_is_ranked(spark):
    rows = same(spark, "ranking_report")
    assert len(rows) == 1 and rows[0][0] == 25 * 25


@pytest.mark.parametrize("name,least", [("degree_top_nodes", 41), ("trust_graph_edges", 1), ("yearly_graph_edges", 1)])
def test_graphs_with_their_default_sizes(spark, name, least):
    rows = same(spark, name)
    assert len(rows) >= least
    if name == "trust_graph_edges":
        assert max(max(r[1], r[2]) for r in rows) >= 60
    if name == "yearly_graph_edges":
        assert max(r[1] for r in rows) >= 50 and len({r[0] for r in rows}) > 4
