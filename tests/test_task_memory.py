"""What one task sorts stays bounded: rows are not sorted for maxima, and slices of a hot signal are dealt to many tasks."""

import pytest
from pyspark.sql import functions as F

from tracetide.operators import changelog
from tracetide.operators.changelog import ChangeLog
from tracetide.streaming import live


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_clock_moves_without_sorting_all_rows(spark):
    new = spark.createDataFrame([("f", 1, t, n, str(n)) for n, t in enumerate([3, 5, 4, 6, 2])], "file string, signal int, time bigint, seq bigint, value string")
    new = new.withColumn("seq", F.struct(F.lit(live.NOW).alias("kind"), F.lit(0).cast("bigint").alias("epoch"), F.struct("time", "seq").alias("seq")))
    new = new.withColumn("seq", F.struct("seq.kind", "seq.epoch", F.struct(F.col("seq.seq.seq").alias("seq")).alias("seq")))
    clock = spark.createDataFrame([("f", 4, True)], "file string, latest bigint, accepted boolean")
    steps = live.in_order(new, clock)
    kept = live.on_time(steps)
    assert sorted(r.value for r in kept.collect()) == ["1", "3"]
    moved = live.moved_clock(clock, steps, kept)
    assert [tuple(r) for r in moved.collect()] == [("f", 6, False)]
    assert "SortAggregate" not in plan(moved) and "SortAggregate" not in plan(kept)


@pytest.mark.parametrize("rows", [2000, 6000])
def test_tasks_grow_with_the_slices_of_a_hot_signal(spark, monkeypatch, rows):
    monkeypatch.setattr(changelog, "HOT_ROWS", 100)
    monkeypatch.setattr(changelog, "COUNTED_BYTES", 0)
    log = ChangeLog(spark.range(rows).select(F.lit(1).alias("signal"), F.col("id").alias("time"), F.col("id").alias("seq"), (F.col("id") % 3 % 2).alias("value")))
    cut = log.slotted(log.df)
    assert cut.select("slot").distinct().count() == rows // 100
    assert cut.rdd.getNumPartitions() >= rows // 100 * 4
    assert max(r.n for r in cut.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()) <= 800
    assert log.dedup().df.count() == rows - (rows - 1) // 3


def test_large_orders_get_more_ranges(spark, monkeypatch):
    monkeypatch.setattr(changelog, "RANGE_BYTES", 1000)
    rows = spark.range(4000).select(F.lit("f").alias("file"), F.col("id").alias("seq"), (F.col("id") - F.when(F.col("id") % 10 == 9, 5).otherwise(0)).alias("time"))
    found = changelog.placed(rows, within=["file"])
    assert found.select("__part").distinct().count() > 20
    assert sorted(r.seq for r in changelog.accepted(found, within=["file"]).collect()) == [n for n in range(4000) if n % 10 != 9]
