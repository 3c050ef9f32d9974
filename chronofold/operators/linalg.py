"""Factor algebra on relations: projections, energies, normalisation, pruning, distributed leading vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.expressions import dot, small

#: Cells of a matrix up to which it is factorised on the driver; beyond, by distributed subspace iteration.
DRIVER_CELLS = 16_000_000


def factor_frame(spark: SparkSession, matrix: np.ndarray, key: str) -> DataFrame:
    """(key, f) rows of a factor matrix."""
    import pandas as pd

    rows = pd.DataFrame({key: np.arange(len(matrix), dtype=np.int32), "f": [list(map(float, x)) for x in matrix]})
    return spark.createDataFrame(rows, f"{key} int, f array<double>")


def to_array(matrix: DataFrame, n: int, m: int) -> np.ndarray:
    """Dense array of (u, v, w) on the driver; refused beyond ``DRIVER_CELLS``."""
    if n * m > DRIVER_CELLS:
        raise MemoryError(f"{n} x {m} cells are too many for the driver")
    out = np.zeros((n, m))
    found = matrix.select("u", "v", "w").toArrow()
    np.add.at(out, (found["u"].to_numpy(), found["v"].to_numpy()), found["w"].to_numpy())
    return out


def to_tensor(edges: DataFrame, steps: int, n: int, m: int) -> np.ndarray:
    if steps * n * m > DRIVER_CELLS:
        raise MemoryError(f"{steps} x {n} x {m} cells are too many for the driver")
    out = np.zeros((steps, n, m))
    found = edges.select("t", "u", "v", "w").toArrow()
    np.add.at(out, (found["t"].to_numpy(), found["u"].to_numpy(), found["v"].to_numpy()), found["w"].to_numpy())
    return out


def long_form(factor: DataFrame, key: str, value: str = "x") -> DataFrame:
    return factor.select(key, F.posexplode("f").alias("j", value))


def temporal_projection(edges: DataFrame, left: DataFrame, right: DataFrame, n: int, m: int, steps: int, rank: int, lambdas: list[float] | None = None) -> DataFrame:
    """(t, f) with f[j] = left_j' A_t right_j, divided by lambda_j unless that is about 0.

    One pass over the edges: factor rows join as arrays (broadcast if small),
    the r products are summed per step; steps without edges are zeros.
    """
    joined = edges.join(small(left.select("u", F.col("f").alias("l")), n, rank), "u").join(small(right.select("v", F.col("f").alias("r")), m, rank), "v")
    scale = [1.0] * rank if lambdas is None else [1.0 if abs(x) <= 1e-12 else x for x in lambdas]
    sums = joined.groupBy("t").agg(*[F.sum(F.col("w") * F.get("l", F.lit(j)) * F.get("r", F.lit(j))).alias(f"g{j}") for j in range(rank)])
    every = edges.sparkSession.range(steps).select(F.col("id").cast("int").alias("t"))
    filled = every.join(sums, "t", "left")
    return filled.select("t", F.array(*[F.coalesce(F.col(f"g{j}"), F.lit(0.0)) / scale[j] for j in range(rank)]).alias("f"))


def gram(factor: DataFrame, key: str, rank: int) -> np.ndarray:
    """rank x rank Gram matrix of a factor table by one aggregate."""
    pairs = [(a, b) for a in range(rank) for b in range(a, rank)]
    if rank <= 24:
        row = factor.agg(*[F.sum(F.get("f", F.lit(a)) * F.get("f", F.lit(b))).alias(f"g{a}_{b}") for a, b in pairs]).first()
        found = {(a, b): row[f"g{a}_{b}"] or 0.0 for a, b in pairs}
    else:
        x = factor.select(F.posexplode("f").alias("a", "x"), "f").select("a", "x", F.posexplode("f").alias("b", "y"))
        found = {(r.a, r.b): r.g for r in x.groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("g")).collect()}
    out = np.zeros((rank, rank))
    for (a, b), g in found.items():
        out[a, b] = out[b, a] = g
    return out


def residual_energy(edges: DataFrame, left: DataFrame, right: DataFrame, temporal: DataFrame, lambdas: list[float], n: int, m: int) -> DataFrame:
    """One row: energy of the snapshots, of the model, of the residual, and the cell count, never densified."""
    rank = len(lambdas)
    gl, gr = gram(left, "u", rank), gram(right, "v", rank)
    both = gl * gr
    weights = [F.get("f", F.lit(j)) * F.lit(float(lambdas[j])) for j in range(rank)]
    own = F.lit(0.0)
    for a in range(rank):
        inner = F.lit(0.0)
        for b in range(rank):
            if both[a, b]:
                inner = inner + weights[b] * F.lit(float(both[a, b]))
        own = own + weights[a] * inner
    model = temporal.agg(F.coalesce(F.sum(own), F.lit(0.0)).alias("model"), F.count(F.lit(1)).alias("steps"))
    scored = edges.join(small(left.select("u", F.col("f").alias("l")), n, rank), "u").join(small(right.select("v", F.col("f").alias("r")), m, rank), "v").join(F.broadcast(temporal.select("t", F.transform("f", lambda x, j: x * F.get(F.array(*[F.lit(float(y)) for y in lambdas]), j)).alias("s"))), "t")
    score = dot(F.col("l"), F.col("r"), F.col("s"), rank=rank)
    data = scored.agg(F.coalesce(F.sum(F.col("w") * F.col("w")), F.lit(0.0)).alias("data"), F.coalesce(F.sum(F.col("w") * score), F.lit(0.0)).alias("cross"))
    return data.crossJoin(model).select(F.col("data").alias("data_energy"), F.col("model").alias("model_energy"), F.greatest(F.col("data") + F.col("model") - 2 * F.col("cross"), F.lit(0.0)).alias("residual_energy"), (F.col("steps") * n * m).alias("cells"))


def component_norms(factor: DataFrame, key: str) -> DataFrame:
    """(j, norm), floored at 1e-12."""
    return long_form(factor, key).groupBy("j").agg(F.greatest(F.sqrt(F.sum(F.col("x") * F.col("x"))), F.lit(1e-12)).alias("norm"))


def scaled(factor: DataFrame, key: str, by: list[float]) -> DataFrame:
    """Columns of a factor table times ``by``."""
    return factor.select(key, F.array(*[F.get("f", F.lit(j)) * F.lit(float(x)) for j, x in enumerate(by)]).alias("f"))


def kept(factor: DataFrame, key: str, columns: list[int]) -> DataFrame:
    return factor.select(key, F.array(*[F.get("f", F.lit(int(j))) for j in columns]).alias("f"))


def energy_prune(lambdas: DataFrame, target: float, least: int = 1) -> DataFrame:
    """(j, lambda) kept: the largest by lambda^2 up to the target share of energy, at least ``least``.

    ``lambdas`` has one row per component.
    """
    if not 0 < target <= 1:
        raise ValueError("the energy target must lie in (0, 1]")
    order = Window.orderBy(F.desc(F.col("lambda") * F.col("lambda")), "j")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum(F.col("lambda") * F.col("lambda")).over(Window.partitionBy())
    ranked = lambdas.select("j", "lambda", F.row_number().over(order).alias("k"), (F.coalesce(F.sum(F.col("lambda") * F.col("lambda")).over(before), F.lit(0.0)) / F.greatest(total, F.lit(1e-300))).alias("cum"))
    return ranked.where((F.col("cum") < target - 1e-15) | (F.col("k") <= least)).select("j", "lambda")


def component_strengths(temporal: DataFrame, lambdas: DataFrame) -> DataFrame:
    """(j, strength): |lambda| times the root mean square of the component over the steps."""
    rms = long_form(temporal, "t").groupBy("j").agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"))
    return rms.join(lambdas, "j").select("j", (F.abs("lambda") * F.col("rms")).alias("strength"))


def strength_prune(temporal: DataFrame, lambdas: DataFrame, threshold: float, least: int = 1) -> DataFrame:
    """(j, strength) of the components at or above ``threshold`` times the strongest, at least ``least``."""
    s = component_strengths(temporal, lambdas)
    top = F.max("strength").over(Window.partitionBy())
    k = F.row_number().over(Window.orderBy(F.desc("strength"), "j"))
    return s.withColumn("top", top).withColumn("k", k).where((F.col("strength") >= threshold * F.col("top")) | (F.col("k") <= least)).select("j", "strength")


def clipped_rank(mode: str, rank: int, n: int, ard_max_rank: int | None = None) -> int:
    if mode not in ("fixed", "ard"):
        raise ValueError("rank_selection_mode is fixed or ard")
    return max(1, min(n, rank if mode == "fixed" else (ard_max_rank or rank)))


def subspace_distance(a: np.ndarray, b: np.ndarray) -> float:
    """Frobenius distance of the projectors over sqrt(2 r); 0 for equal spans."""
    qa, qb = np.linalg.qr(a)[0], np.linalg.qr(b)[0]
    r = max(qa.shape[1], 1)
    return float(np.linalg.norm(qa @ qa.T - qb @ qb.T) / np.sqrt(2 * r))


def uv_gap(left: np.ndarray, right: np.ndarray) -> float:
    """Norm of the difference of the two factors over the norm of the left one."""
    return float(np.linalg.norm(left - right) / max(np.linalg.norm(left), 1e-12))


def _apply(matrix: DataFrame, vectors: DataFrame, rank: int, rows: int, transpose: bool) -> DataFrame:
    """A x (or A' x) for ``rank`` vectors held as (i, f): a join and one sum."""
    a, b = ("v", "u") if transpose else ("u", "v")
    joined = matrix.join(small(vectors.select(F.col("i").alias(b), "f"), rows, rank), b)
    sums = joined.groupBy(F.col(a).alias("i")).agg(*[F.sum(F.col("w") * F.get("f", F.lit(j))).alias(f"y{j}") for j in range(rank)])
    return sums.select("i", F.array(*[F.col(f"y{j}") for j in range(rank)]).alias("f"))


def cross_gram(first: DataFrame, second: DataFrame, a: int, b: int) -> np.ndarray:
    """first' second of two factor tables (i, f) of ranks a and b: one join and a x b sums."""
    both = first.select("i", F.col("f").alias("x")).join(second.select("i", F.col("f").alias("y")), "i")
    row = both.agg(*[F.coalesce(F.sum(F.get("x", F.lit(p)) * F.get("y", F.lit(q))), F.lit(0.0)).alias(f"g{p}_{q}") for p in range(a) for q in range(b)]).first()
    return np.array(row, float).reshape(a, b)


def turned(factor: DataFrame, by: np.ndarray) -> DataFrame:
    """Factor table (i, f) times a small matrix."""
    return factor.select("i", F.array(*[sum((F.get("f", F.lit(a)) * F.lit(float(by[a, j])) for a in range(by.shape[0])), F.lit(0.0)) for j in range(by.shape[1])]).alias("f"))


def prepare_checkpoints(spark: SparkSession) -> None:
    """A folder for checkpoints: the one the session names; a temporary one only where a single machine runs all."""
    if spark.sparkContext.getCheckpointDir() is None and not spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        import tempfile

        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="chronofold-"))


def subspace_svd(matrix: DataFrame, n: int, m: int, rank: int, iterations: int = 60, tol: float = 1e-10, seed: int = 0, low: tuple[DataFrame, np.ndarray, DataFrame] | None = None) -> tuple[DataFrame, list[float], DataFrame]:
    """Leading singular triplets of a large sparse matrix (u, v, w) by subspace iteration on relations.

    ``low`` adds a matrix of low rank, U diag(c) V', given as tables (i, f) of U
    and V and the numbers c.  Only rank x rank matrices reach the driver; each
    half step is one join and one sum over the nonzeros, written by
    ``checkpoint`` to cut lineage.  It ends when the squared singular values move
    by no more than ``tol`` of the largest.
    """
    spark = matrix.sparkSession
    prepare_checkpoints(spark)
    r = min(rank, n, m)
    v = spark.range(m).select(F.col("id").alias("i"), F.array(*[(F.pmod(F.xxhash64("id", F.lit(seed), F.lit(j)), F.lit(2_000_003)) / 1_000_001.5 - 1) for j in range(r)]).alias("f"))

    def apply(x: DataFrame, size: int, transpose: bool) -> DataFrame:
        y = _apply(matrix, x, r, size, transpose).select(F.col("i").cast("long").alias("i"), "f")
        if low is None:
            return y.checkpoint()
        left, weights, right = (low[2], low[1], low[0]) if transpose else low
        k = len(weights)
        added = turned(left, weights[:, None] * cross_gram(right, x, k, r)).select(F.col("i").cast("long").alias("i"), F.col("f").alias("g"))
        both = y.join(added, "i", "full")
        part = lambda c, j: F.coalesce(F.get(c, F.lit(j)), F.lit(0.0))
        return both.select("i", F.array(*[part("f", j) + part("g", j) for j in range(r)]).alias("f")).checkpoint()

    def orthonormal(x: DataFrame) -> tuple[DataFrame, np.ndarray]:
        values, vectors = np.linalg.eigh(gram(x, "i", r))
        # Directions of no weight, as in a matrix of smaller rank, become zeros.
        live = values > 1e-13 * max(values.max(initial=0), 1e-300)
        return turned(x, vectors * np.where(live, 1 / np.sqrt(np.where(live, values, 1.0)), 0.0)), values

    v, _ = orthonormal(v)
    last = np.zeros(r)
    for _ in range(iterations):
        u, _ = orthonormal(apply(v, m, False))
        v, values = orthonormal(apply(u, n, True))
        if np.abs(values - last).max(initial=0) <= tol * max(values.max(initial=0), 1e-300):
            break
        last = values
    image = apply(v, m, False)
    values, vectors = np.linalg.eigh(gram(image, "i", r))
    order = np.argsort(-values)
    sigma, turn = np.sqrt(np.maximum(values[order], 0)), vectors[:, order]
    live = sigma > 1e-7 * max(sigma.max(initial=0), 1e-300)
    left, right = turned(image, turn * np.where(live, 1 / np.where(live, sigma, 1.0), 0.0)), turned(v, turn)
    pad = lambda x, size, key: spark.range(size).select(F.col("id").alias(key)).join(x.withColumnRenamed("i", key), key, "left").select(F.col(key).cast("int").alias(key), F.coalesce("f", F.array(*[F.lit(0.0)] * r)).alias("f"))
    return pad(left, n, "u"), sigma.tolist(), pad(right, m, "v")
