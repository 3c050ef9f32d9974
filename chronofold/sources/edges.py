"""Edge sources: trust lists, yearly graphs, and the graphs of the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..graph import TemporalGraph, summed

TRUST_SCHEMA = "source BIGINT, target BIGINT, rating DOUBLE, time DOUBLE"


def select_nodes(rows: DataFrame, max_nodes: int | None, sources_first: bool = False) -> DataFrame:
    """(node_id, idx, degree): the ``max_nodes`` nodes of highest degree, counting both ends of every row.

    ``rows`` has source, target and pos (place in the input).  Equal degrees go
    by first appearance: row by row, or all sources before all targets.  Only
    the kept nodes are ranked in one place.
    """
    if sources_first:
        ends = (F.struct(F.lit(0).alias("side"), F.col("pos").alias("pos")), F.struct(F.lit(1).alias("side"), F.col("pos").alias("pos")))
    else:
        ends = (F.struct(F.col("pos").alias("side"), F.lit(0).cast("long").alias("pos")), F.struct(F.col("pos").alias("side"), F.lit(1).cast("long").alias("pos")))
    seen = rows.select(F.col("source").alias("node_id"), ends[0].alias("first")).union(rows.select(F.col("target"), ends[1]))
    degree = seen.groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"), F.min("first").alias("first"))
    if max_nodes is not None:
        degree = degree.orderBy(F.desc("degree"), "first").limit(max_nodes)
    order = Window.orderBy(F.desc("degree"), "first")
    return degree.select("node_id", (F.row_number().over(order) - 1).alias("idx"), "degree")


def _indexed(rows: DataFrame, nodes: DataFrame, label: Column) -> tuple[DataFrame, DataFrame]:
    """Edges over kept nodes and the time bins that they fill."""
    u = nodes.select(F.col("node_id").alias("source"), F.col("idx").alias("u"))
    v = nodes.select(F.col("node_id").alias("target"), F.col("idx").alias("v"))
    kept = rows.join(u, "source").join(v, "target").select("u", "v", "w", label.alias("label"))
    times = kept.select("label").distinct().select((F.row_number().over(Window.orderBy("label")) - 1).alias("t"), "label")
    edges = summed(kept.join(F.broadcast(times), "label").select("t", "u", "v", "w"))
    return edges, times


def trust_graph(rows: DataFrame, max_nodes: int = 300, normalize: bool = True, name: str = "trust") -> TemporalGraph:
    """Temporal graph of (source, target, rating, time, pos): top nodes by degree, monthly UTC bins, ratings by ten."""
    rows = rows.withColumn("w", F.col("rating") / (10.0 if normalize else 1.0))
    nodes = select_nodes(rows, max_nodes)
    month = F.date_format(F.timestamp_seconds(F.col("time").cast("long")), "yyyy-MM")
    edges, times = _indexed(rows, nodes, month)
    return TemporalGraph(name, edges, nodes.count(), times.count(), nodes=nodes.select("idx", "node_id", F.lit(None).cast("int").alias("community")), times=times)


def load_trust(spark: SparkSession, path: str, **options) -> TemporalGraph:
    """A trust list from CSV without header, gzipped or not (by suffix); one file keeps the order of its rows."""
    rows = spark.read.csv(path, schema=TRUST_SCHEMA, mode="FAILFAST").withColumn("pos", F.monotonically_increasing_id())
    return trust_graph(rows, **options)


def yearly_graph(rows: DataFrame, num_nodes: int, max_nodes: int | None = 1000, min_year: int | None = None, max_year: int | None = None, name: str = "collaboration") -> TemporalGraph:
    """Temporal graph of (source, target, year, weight?, pos) with one step per year present.

    Years are limited inclusively; a missing weight is 1; without ``max_nodes``,
    or with as many as there are, every node id is kept, isolated ones too.
    """
    if "weight" not in rows.columns:
        rows = rows.withColumn("weight", F.lit(1.0))
    if min_year is not None:
        rows = rows.where(F.col("year") >= min_year)
    if max_year is not None:
        rows = rows.where(F.col("year") <= max_year)
    rows = rows.withColumn("w", F.coalesce(F.col("weight").cast("double"), F.lit(1.0)))
    spark = rows.sparkSession
    if max_nodes is None or max_nodes >= num_nodes:
        nodes, n = spark.range(num_nodes).select(F.col("id").alias("node_id"), F.col("id").cast("int").alias("idx")), num_nodes
    else:
        nodes = select_nodes(rows, max_nodes, sources_first=True)
        n = nodes.count()
    edges, times = _indexed(rows, nodes, F.col("year").cast("string"))
    return TemporalGraph(name, edges, n, times.count(), nodes=nodes.select("idx", "node_id", F.lit(None).cast("int").alias("community")), times=times)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _trade_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount", "l_returnflag", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return line.join(orders, line.l_orderkey == orders.o_orderkey)


def trade_edges(spark: SparkSession, sf_dir: str, signed: bool = False) -> DataFrame:
    """Customer nation to supplier nation by order year: revenue in millions, or returns as -1 and accepted lines as +1."""
    rows = _trade_rows(spark, sf_dir)
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("int").alias("u"))
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("int").alias("v"))
    value = F.sum(F.when(F.col("l_returnflag") == "R", -1.0).when(F.col("l_returnflag") == "A", 1.0).otherwise(0.0)) if signed else F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / 1e6
    return rows.join(customer, "o_custkey").join(supplier, "l_suppkey").groupBy((F.year("o_orderdate") - 1995).alias("t"), "u", "v").agg(value.alias("w"))


def trade_graph(spark: SparkSession, sf_dir: str, signed: bool = False) -> TemporalGraph:
    """The trade between nations, with regions as communities."""
    edges = trade_edges(spark, sf_dir, signed)
    nation = table(spark, sf_dir, "nation")
    nodes = nation.select(F.col("n_nationkey").cast("int").alias("idx"), F.col("n_nationkey").cast("long").alias("node_id"), F.col("n_regionkey").cast("int").alias("community"))
    n, steps = nodes.count(), edges.agg(F.max("t") + 1).first()[0] or 0
    times = spark.range(steps).select(F.col("id").cast("int").alias("t"), (F.col("id") + 1995).cast("string").alias("label"))
    return TemporalGraph("trade", edges, n, steps, nodes=nodes, times=times)


def purchase_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer to supplier by order month (months since January 1995): quantity by ten."""
    month = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1
    return _trade_rows(spark, sf_dir).groupBy(month.alias("t"), F.col("o_custkey").alias("u"), F.col("l_suppkey").alias("v")).agg((F.sum("l_quantity") / 10).alias("w"))


def handoff_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User to next user within a day: source, target, day, pos (the event)."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", F.to_date("ts").alias("day"))
    following = Window.partitionBy("day").orderBy("ts", "event_id")
    rows = events.select(F.col("user_id").alias("source"), F.lead("user_id").over(following).alias("target"), "day", F.col("event_id").alias("pos"))
    return rows.where(F.col("target").isNotNull() & (F.col("source") != F.col("target")))
