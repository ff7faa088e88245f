"""Database tables by counted ranges of ids, on the in-memory database that comes with Spark."""

import uuid

import pytest
from pyspark.sql import functions as F

from vocspark.sources import io

DRIVER = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}


@pytest.fixture
def url():
    return f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"


def _sizes(df):
    return [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]


def test_skewed_and_null_ids(spark, url):
    """A third of the rows in a narrow range far away, one id that repeats, nulls and negative ids: all are read, once."""
    ids = [*range(-50, 400), *range(10**15, 10**15 + 300), *[777] * 90, *[10**17], *[None] * 40]
    rows = spark.createDataFrame([(i, f"t{n}") for n, i in enumerate(ids)], "id long, text string")
    rows.write.jdbc(url, "messages", properties=DRIVER)
    ranges = io.jdbc_ranges(spark, url, "messages", "id", 60, DRIVER)
    counts = [sum(a <= i < b for i in ids if i is not None) for a, b in ranges]
    assert sum(counts) == len(ids) - 40 and all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    assert max(n for n, (a, b) in zip(counts, ranges, strict=True) if not a <= 777 < b) <= 60
    assert [n for n, (a, b) in zip(counts, ranges, strict=True) if a <= 777 < b] == [90]
    assert all(x + y > 60 for x, y in zip(counts, counts[1:], strict=False))
    read = io.read_jdbc_measured(spark, url, "messages", "id", 60, DRIVER)
    assert sorted(r["text"] for r in read.collect()) == sorted(f"t{n}" for n in range(len(ids)))
    assert sorted(_sizes(read)) == sorted([*counts, 40]) and read.rdd.getNumPartitions() == len(ranges) + 1


def test_rows_after_the_count_and_empty_tables(spark, url):
    empty = spark.createDataFrame([], "id long, text string")
    empty.write.jdbc(url, "messages", properties=DRIVER)
    assert io.jdbc_ranges(spark, url, "messages", "id", 10, DRIVER) == []
    late = io.read_jdbc_measured(spark, url, "messages", "id", 10, DRIVER)
    assert late.count() == 0
    spark.createDataFrame([(5, "a"), (None, "b")], empty.schema).write.mode("append").jdbc(url, "messages", properties=DRIVER)
    assert sorted(r["text"] for r in late.collect()) == ["a", "b"]
    again = io.read_jdbc_measured(spark, url, "messages", "id", 10, DRIVER)
    spark.createDataFrame([(i, "c") for i in (-(10**6), 10**6)], empty.schema).write.mode("append").jdbc(url, "messages", properties=DRIVER)
    assert again.count() == 4
    assert again.where("id > 0").select("text").count() == 2


def test_equal_ranges(spark, url):
    spark.range(100).write.jdbc(url, "t", properties=DRIVER)
    read = io.read_jdbc(spark, url, "t", "id", 0, 100, 4, DRIVER)
    assert read.rdd.getNumPartitions() == 4 and read.count() == 100
