"""Exact quantiles of relations of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Rows up to which one aggregate holds all values; beyond, sketches of this accuracy say where to look.
EXACT_CELLS, ACCURACY = 5_000_000, 20_000


def quantiles(rows: DataFrame, value: Column, wanted: Mapping[str, float], count: int, by: Sequence[str] = ()) -> DataFrame:
    """One row per group ``by`` (one row without): the ``wanted`` quantiles of ``value``, linearly interpolated.

    ``count``, how many rows there are about, decides the way and not the
    result: a single aggregate, or two passes.  The first of these sketches a
    bracket around every wanted rank, the second counts what lies before each
    bracket and the distinct values within, a few ten-thousandths of all rows.
    No rows give nulls; null values are left out.
    """
    x = rows.select(*by, value.alias("x")).where("x is not null")
    if count <= EXACT_CELLS:
        return x.groupBy(*by).agg(*[F.percentile("x", F.lit(q)).alias(name) for name, q in wanted.items()])
    slack, places = 3 / ACCURACY, list(wanted.values())
    ends = [max(0.0, q - slack) for q in places] + [min(1.0, q + slack) for q in places]
    sketch = x.groupBy(*by).agg(F.count("x").alias("all"), F.min("x").alias("least"), F.max("x").alias("most"), F.percentile_approx("x", ends, ACCURACY).alias("ends"))
    # In a small group a bracket may end between the two values that a quantile lies between: all of it is looked at.
    small, k = F.col("all") < ACCURACY, len(places)
    low = [F.when(small, F.col("least")).otherwise(F.get("ends", F.lit(i))) for i in range(k)]
    high = [F.when(small, F.col("most")).otherwise(F.get("ends", F.lit(i + k))) for i in range(k)]
    sketch = F.broadcast(sketch.select(*by, "all", F.array(*low, *high).alias("ends")))
    low, high = [F.get("ends", F.lit(i)) for i in range(k)], [F.get("ends", F.lit(i + k)) for i in range(k)]
    within = F.lit(False)
    for a, b in zip(low, high, strict=True):
        within = within | F.col("x").between(a, b)
    ahead = F.array_min(F.array(*[F.when(F.col("x") < a, a) for a in low]))
    # A value outside counts for the start of the next bracket; one beyond all brackets counts for nothing.
    both = x.join(sketch, list(by)) if by else x.crossJoin(sketch)  # one sketch row per group
    placed = both.select(*by, "all", (~within).alias("passed"), F.when(within, F.col("x")).otherwise(ahead).alias("x"))
    counted = placed.where("x is not null").groupBy(*by, "all", "x", "passed").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*by).orderBy("x", F.desc("passed")).rowsBetween(Window.unboundedPreceding, 0)
    stop = counted.withColumn("stop", F.sum("n").over(order))

    def at(rank: Column) -> Column:
        here = ~F.col("passed") & (rank >= F.col("stop") - F.col("n")) & (rank < F.col("stop"))
        return F.max(F.when(here, F.col("x")))

    found = []
    for name, q in wanted.items():
        place = F.lit(float(q)) * (F.col("all") - 1)
        share = F.max(place - F.floor(place))
        below, above = at(F.floor(place)), at(F.ceil(place))
        missed = F.when(F.max("all") > 0, F.raise_error(F.lit(f"the sketch misses quantile {name}")).cast("double"))
        found.append(F.coalesce(below + share * (above - below), missed).alias(name))
    return stop.groupBy(*by).agg(*found)
