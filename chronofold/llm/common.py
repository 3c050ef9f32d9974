"""Shared plumbing of the operators: the shared folder and skew-safe joins."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .files import filed
from .workers import tidy

#: Rows and bytes of an Arrow batch while results of Python kernels are written: whole texts make large rows.
BATCH_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20}

_LOCAL: dict[str, str] = {}
_OPEN: list[Workspace] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that setting is absent a single-machine session (``local[...]``) gets
    a folder of its own, removed at exit; on a cluster its absence is an error,
    because a machine-local folder would lose files.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="chronofold-")
        atexit.register(shutil.rmtree, _LOCAL["dir"], ignore_errors=True)
    return f"file://{_LOCAL['dir']}"


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within, Arrow batches keep to BATCH_LIMITS: the one rule for all kernels, held wherever their results are written."""
    usual = {k: spark.conf.get(k, None) for k in BATCH_LIMITS}
    for k, limit in BATCH_LIMITS.items():
        now = int(usual[k].rstrip("bB")) if usual[k] and usual[k].rstrip("bB").lstrip("-").isdigit() else -1
        spark.conf.set(k, str(min(now, limit) if now > 0 else limit))
    try:
        yield
    finally:
        for k, value in usual.items():
            spark.conf.unset(k) if value is None else spark.conf.set(k, value)


class Workspace:
    """Tables and files of one operator call, below the shared folder.

    A written table cuts lineage: later stages reread it, so a lost executor
    never forces more than the current stage to run again.  Workspaces live as
    long as results may be read from them: until the :func:`scratch` block they
    were made in ends, else until the driver program ends.

    ``by_workers``: in a local folder the Python workers write the tables.
    Spark's writer has each executor launch ``chmod`` three times for a file
    there, and until such a child runs its own program it counts as a second
    JVM of the same size.
    """

    def __init__(self, spark: SparkSession, name: str, by_workers: bool = False):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.local = self._local() if by_workers else None
        if not _OPEN:
            atexit.register(_remove, _OPEN)
        _OPEN.append(self)

    def _hadoop(self, path: str):
        """(Hadoop's path, its file system)"""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _local(self) -> str | None:
        """The folder as this machine's programs name it, if it is local."""
        at, fs = self._hadoop(self.root)
        return fs.makeQualified(at).toUri().getPath() if fs.getUri().getScheme() == "file" else None

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str, kernel=None, kind: str = "") -> DataFrame:
        """``df``, or what a batch kernel makes of it (columns ``kind``), written and read again."""
        made = df if kernel is None else df.mapInArrow(tidy(kernel), kind)
        with small_batches(self.spark):
            if self.local:
                self._filed(df, name, kernel, to_arrow_schema(made.schema))
            else:
                made.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(made.schema).parquet(self.path(name))

    def _filed(self, df: DataFrame, name: str, kernel, schema: pa.Schema) -> None:
        """Every attempt writes a file of its own aside; those of the attempts that count are moved to the table."""
        folder = f"{self.local}/{name}"
        aside = f"{folder}.attempts"
        self.drop(name)
        os.makedirs(folder)
        os.makedirs(aside)
        for row in df.mapInArrow(tidy(filed(kernel, aside, schema)), "file string").collect():  # a name per task
            os.replace(f"{aside}/{row.file}", f"{folder}/{row.file}")
        shutil.rmtree(aside, ignore_errors=True)

    def drop(self, *names: str) -> None:
        """Remove tables that no later step reads (they count as disk)."""
        for name in names:
            path, fs = self._hadoop(self.path(name))
            fs.delete(path, True)

    def close(self) -> None:
        """Remove all of it."""
        self.drop("")


def _remove(spaces: list[Workspace]) -> None:
    while spaces:
        try:
            spaces.pop().close()
        except Exception:  # the session, or the gateway to it, has ended: nothing can be removed from here
            return


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Workspaces made within are removed at the end, so write what has to stay elsewhere before."""
    before = list(_OPEN)
    try:
        yield
    finally:
        made = [w for w in _OPEN if w not in before]
        _OPEN[:] = before
        _remove(made)


def heavy_keys(df: DataFrame, keys: Sequence[str], fraction: float = 1 / 1000) -> DataFrame:
    """Keys that hold at least ``fraction`` of the rows (so at most ``1/fraction`` keys),
    with ``key_rows``; the counting pre-aggregates on the map side."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("key_rows"))
    total = df.count()
    return counts.where(F.col("key_rows") >= F.lit(max(2.0, total * fraction)))


def lookup_join(left: DataFrame, table: DataFrame, keys: Sequence[str], heavy: DataFrame) -> DataFrame:
    """Left join of ``left`` with ``table`` (one row per key) that no hot key can skew.

    ``heavy`` (from :func:`heavy_keys`, a bounded number of keys) splits the
    left rows: rows of hot keys meet a broadcast of just those table rows, all
    other rows are shuffled as usual.  Keys must not be null.
    """
    keys = list(keys)
    mark = F.broadcast(heavy.select(*keys).withColumn("__hot", F.lit(True)))
    tagged = left.join(mark, keys, "left")
    hot_table = F.broadcast(table.join(F.broadcast(heavy.select(*keys)), keys, "left_semi"))
    hot = tagged.where("__hot").drop("__hot").join(hot_table, keys, "left")
    cold = tagged.where("__hot is null").drop("__hot").join(table, keys, "left")
    return hot.unionByName(cold)
