"""Column expressions shared by operators: dot products, bounds, guarded broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranks up to which a dot product is written out term by term, so it stays in generated code.
UNROLL = 64
#: Bytes of a factor table up to which it is broadcast.
BROADCAST_BYTES = 64 << 20


def dot(*vectors: Column, rank: int) -> Column:
    """Sum over j of the product of the j-th entries."""
    if rank <= UNROLL:
        total = F.lit(0.0)
        for j in range(rank):
            term = F.get(vectors[0], F.lit(j))
            for v in vectors[1:]:
                term = term * F.get(v, F.lit(j))
            total = total + term
        return total
    product = vectors[0]
    for v in vectors[1:]:
        product = F.zip_with(product, v, lambda a, b: a * b)
    return F.aggregate(product, F.lit(0.0), lambda a, x: a + x)


def small(df: DataFrame, rows: int, width: int) -> DataFrame:
    """``df`` marked for broadcast if ``rows`` of ``width`` doubles are small enough; a shuffle join otherwise."""
    return F.broadcast(df) if rows * (width + 4) * 8 <= BROADCAST_BYTES else df


def calibrated_bound(theory: Column | None, degree: Column | None, threshold: float | None, factor: float) -> Column:
    """Theoretical bound if known (times ``factor``), else degree-aware bound, else the residual threshold, else null."""
    if theory is not None:
        return theory * F.lit(float(factor))
    if degree is not None:
        return degree
    return F.lit(threshold).cast("double")


def harmless_hash(*columns: Column, modulus: int = 1_000_003) -> Column:
    """Arithmetic hash of small integers in [0, 1), the same in any SQL engine."""
    weights = (7919, 104729, 1299709, 15485863)
    total = F.lit(0).cast("long")
    for c, w in zip(columns, weights, strict=False):
        total = total + c.cast("long") * F.lit(w)
    return F.pmod(total * F.lit(48271) + F.lit(11), F.lit(modulus)) / F.lit(float(modulus))
