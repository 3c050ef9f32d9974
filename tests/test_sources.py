"""Loaders, bundles, streaming, the registry."""

import gzip

import numpy as np
import pytest
import yaml
from pyspark.sql import functions as F

import __spark_entry__ as entry
from chronofold.operators.linalg import factor_frame
from chronofold.operators.store import FactorStore
from chronofold.sources.bundles import append_records, load_config, pending, write_outputs
from chronofold.sources.edges import load_trust, yearly_graph
from chronofold.streaming.incremental import maintain

from .conftest import SF

ROWS = "5,7,10,1388534400.9\n7,9,-5,1388534401\n5,7,2,1388534402\n1,9,4,1391212800\n8,8,1,1391212801\n"


@pytest.mark.parametrize("packed", [False, True])
def test_trust_loader(spark, tmp_path, packed):
    path = tmp_path / ("t.csv.gz" if packed else "t.csv")
    path.write_bytes(gzip.compress(ROWS.encode()) if packed else ROWS.encode())
    g = load_trust(spark, str(path), max_nodes=3)
    # Degrees: 7 has 3, then 5, 9 and 8 have 2; 5 and 9 are seen first.
    assert [(r.node_id, r.idx) for r in g.nodes.orderBy("idx").collect()] == [(7, 0), (5, 1), (9, 2)]
    assert [tuple(r) for r in g.edges.orderBy("t", "u", "v").collect()] == [(0, 0, 2, -0.5), (0, 1, 0, 1.2)]
    assert [r.label for r in g.times.collect()] == ["2014-01"] and g.n == 3


def test_yearly_graph(spark):
    rows = spark.createDataFrame([(0, 1, 2000, None, 0), (0, 1, 2000, 2.0, 1), (1, 2, 2003, 1.5, 2), (2, 3, 1990, 1.0, 3)], "source long, target long, year int, weight double, pos long")
    g = yearly_graph(rows, 5, None, 2000, 2003)
    assert g.n == 5 and g.steps == 2
    assert [tuple(r) for r in g.edges.orderBy("t").collect()] == [(0, 0, 1, 3.0), (1, 1, 2, 1.5)]
    assert yearly_graph(rows, 5, 2).n == 2


def test_config(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text(yaml.safe_dump({"a": {"b": 1}, "c": "x"}))
    assert load_config(str(path), ["a.b=2.5", "c=y"]) == {"a": {"b": 2.5}, "c": "y"}
    with pytest.raises(KeyError):
        load_config(str(path), ["a.z=1"])
    with pytest.raises(ValueError):
        load_config(str(path), ["a.b"])
    write_outputs(str(tmp_path / "out"), {"rmse": 0.5}, {"a": 1})
    assert {p.name for p in (tmp_path / "out").iterdir()} == {"metrics.json", "summary.md", "resolved_config.yaml", "run_metadata.json"}


def test_resume(spark, tmp_path):
    grid = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "method string, seed int")
    path = str(tmp_path / "records")
    assert pending(spark, grid, path, ["method", "seed"]).count() == 3
    append_records(grid.where("seed = 1"), path)
    assert [tuple(r) for r in pending(spark, grid, path, ["method", "seed"]).collect()] == [("a", 2)]


def test_streaming(spark, tmp_path):
    rng = np.random.default_rng(0)
    left, right = np.linalg.qr(rng.normal(size=(4, 2)))[0], np.linalg.qr(rng.normal(size=(4, 2)))[0]
    store = FactorStore(factor_frame(spark, left, "u"), factor_frame(spark, right, "v"), factor_frame(spark, np.ones((1, 2)), "t"), (1.0, 1.0), 4, 4, 1)
    a = rng.normal(size=(2, 4, 4))
    rows = [(f"2024-01-0{d + 1} 0{h}:00:00", int(u), int(v), float(a[d, u, v]) / 2) for d in range(2) for h in (1, 2) for u in range(4) for v in range(4)]
    rows.append(("2024-01-09 00:00:00", 0, 0, 1.0))  # closes the windows before it
    events = spark.createDataFrame(rows, "ts string, u int, v int, w double").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    maintain(stream, store, str(tmp_path / "out"), str(tmp_path / "cp"), threshold=0.5).awaitTermination(60)
    found = spark.read.parquet(str(tmp_path / "out/temporal")).orderBy("start").collect()
    want = np.einsum("tuv,uj,vj->tj", a, left, right)
    assert np.allclose([r.f for r in found], want)
    error = a - np.einsum("uj,tj,vj->tuv", left, want, right)
    assert spark.read.parquet(str(tmp_path / "out/residuals")).count() == int((np.abs(error) >= 0.5).sum())


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["qid", "rank", "v", "score"] and out.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda x: "null" if x is None else f"{x:.8g}" if isinstance(x, float) else str(x).lower() if isinstance(x, bool) else str(x)
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(__import__("chronofold.registry", fromlist=["ORACLE"]).ORACLE))
def test_against_sql(spark, name):
    import duckdb

    from chronofold import registry

    con = duckdb.connect()
    for table in "region nation customer supplier part orders lineitem events embeddings".split():
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    found = registry.QUERIES[name](spark, SF)
    names, got = found.columns, [tuple(r) for r in found.collect()]
    want = con.execute(registry.ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(names) == sorted(columns)
    assert _rows(names, got) == _rows(columns, want.fetchall())
