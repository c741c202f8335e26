"""Numbers in an order, given by many tasks."""

import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from citeloom.operators import ordering


def sizes(held):
    return [r["n"] for r in held.groupBy(F.shiftright("_at", ordering.PARTITION_BITS)).agg(F.count("*").alias("n")).collect()]


def skewed(spark, n):
    """Nine tenths of the rows in one group, which has three dates; many small groups."""
    group = F.when(F.col("id") % 10 < 9, "large").otherwise(F.concat(F.lit("g"), (F.col("id") % 97).cast("string")))
    return spark.range(n).select(F.col("id").alias("pos"), group.alias("category"), (F.xxhash64("id") % 3).cast("string").alias("date"))


def test_a_large_group_takes_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        held = ordering.in_ranges(skewed(spark, 200_000), ["category"], [F.desc("date"), "pos"])
        found = sizes(held)
        assert len(found) == 8 and max(found) < 2 * statistics.median(found)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("most", [0, 100_000])
def test_equals_a_window(spark, monkeypatch, most):
    monkeypatch.setattr(ordering, "BROADCAST_RANGES", most)
    rows = skewed(spark, 20_000).withColumn("category", F.nullif("category", F.lit("g3")))
    got = ordering.numbered(rows, [F.desc("date"), "pos"], "rn", ["category"])
    want = rows.withColumn("rn", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("date"), "pos")).cast("long"))
    assert got.columns == want.columns and got.exceptAll(want).isEmpty() and got.count() == 20_000


def test_overall_and_edges(spark):
    rows = spark.createDataFrame([(3, "a"), (1, "b"), (2, None)], "pos long, x string")
    assert sorted(ordering.numbered(rows, ["pos"]).collect()) == [(1, "b", 1), (2, None, 2), (3, "a", 3)]
    assert ordering.numbered(rows.limit(0), ["pos"]).isEmpty()
    same = ordering.numbered(spark.range(100).select(F.lit("k").alias("k"), F.lit(1).alias("v")), ["v"], keys=["k"])
    assert sorted(r["rn"] for r in same.collect()) == list(range(1, 101))
