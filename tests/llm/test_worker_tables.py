"""Tables that Python workers write, so that no executor launches processes for them."""

import pytest
from pyspark.sql import functions as F

from chronofold.llm import jaccard_join
from chronofold.llm.common import Workspace


def written_by_spark(spark) -> int:
    """Bytes written through Hadoop's local file system, which launches chmod three times for a file of a task."""
    stats = spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics()
    return sum(s.getBytesWritten() for s in stats if s.getScheme() == "file")


def test_join_writes_no_file_through_spark(spark):
    texts = ["a b c d e f g h i j k l m n o p q r s t u v w x", "a b c d e f g h i j k l m n o p q r s t u v w y", "other words that nobody else has here", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = written_by_spark(spark)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3}
    assert written_by_spark(spark) == before


def test_tables_come_back_whole(spark, tmp_path):
    work = Workspace(spark, "types", by_workers=True)
    assert work.local
    n = F.col("id")
    rows = spark.range(20_000, numPartitions=3).select("id", (n % 100).cast("byte").alias("b"), (n % 7).cast("int").alias("i"), F.when(n % 3 > 0, n).alias("hole"), F.array(n, n + 1).alias("list"), F.encode(n.cast("string"), "UTF-8").alias("map"), (n % 2 == 0).alias("flag"))
    got = work.table(rows, "t")
    assert got.schema.simpleString() == rows.schema.simpleString()
    assert sorted(got.collect()) == sorted(rows.collect())
    again = work.table(rows.where("id < 5"), "t")  # a table of the same name takes its place
    assert again.count() == 5
    empty = work.table(rows.where("id < 0"), "none")
    assert empty.count() == 0 and empty.columns == rows.columns
    work.close()


def test_failed_attempts_leave_no_rows(spark):
    work = Workspace(spark, "failing", by_workers=True)

    def fails(batches):
        for batch in batches:
            yield batch
        raise ValueError("on purpose")

    with pytest.raises(Exception, match="on purpose"):
        work.table(spark.range(10), "t", fails, "id long")
    assert spark.read.schema("id long").parquet(work.path("t")).count() == 0
    work.close()
