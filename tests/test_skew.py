"""Hot keys: the same results, and no task that holds a whole hot key."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rollscore.operators import trace
from rollscore.plans import skew
from rollscore.plans.skew import attach, attach_aggregates, with_counts


def rows_with_hot_key(spark, n=3000):
    """A third of all rows belong to key 0."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("key"), "id", (F.col("id") % 7).alias("value")
    )


@pytest.mark.parametrize("split_rows", [1_000_000, 100, 1])
def test_aggregates_equal_a_window(spark, split_rows):
    rows = rows_with_hot_key(spark)
    got = attach_aggregates(rows, ["key"], split_rows, total=F.sum("value"), top=F.max("id"))
    window = Window.partitionBy("key")
    wanted = rows.withColumn("total", F.sum("value").over(window)).withColumn("top", F.max("id").over(window))
    assert got.columns == wanted.columns
    assert got.exceptAll(wanted).count() == 0 and wanted.exceptAll(got).count() == 0


def placed(df):
    """With each row's task; the filters of a test are not pushed below this."""
    return df.withColumn("p", F.spark_partition_id())


def test_hot_rows_spread_over_tasks(spark):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = rows_with_hot_key(spark)
        joined = attach_aggregates(rows, ["key"], 100, total=F.sum("value"))
        hot = placed(joined).where("key = 0").groupBy("p").count().collect()
        share = max(r["count"] for r in hot) / sum(r["count"] for r in hot)
        assert len(hot) == 8 and share < 0.25
        plain = attach_aggregates(rows, ["key"], 1_000_000, total=F.sum("value"))
        assert len(placed(plain).where("key = 0").groupBy("p").agg(F.sum("total")).collect()) == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_keys_without_stats_stay(spark):
    rows = rows_with_hot_key(spark)
    values = rows.where("key < 10").select("key").distinct().withColumn("extra", F.col("key") * 2)
    got = attach(rows, with_counts(values, rows, ["key"]), ["key"], 100)
    assert got.count() == 3000
    assert got.where((F.col("key") >= 10) & F.col("extra").isNotNull()).count() == 0
    assert got.where((F.col("key") < 10) & F.col("extra").isNull()).count() == 0


@pytest.mark.parametrize("max_k", [None, 9])
def test_selection_in_a_hot_group(spark, max_k):
    """Split ranking equals ranking the whole group, for a group with most of the rows."""
    scores = spark.range(5000).select(
        F.when(F.col("id") < 4000, 0).otherwise(F.col("id") % 5).alias("seq_id"), F.lit(0).alias("step"),
        F.col("id").alias("pos"), ((F.col("id") * 37) % 101).cast("double").alias("confidence"),
        (F.col("id") % 4 != 0).alias("is_masked"), F.lit(4500).alias("block_end"),
    ).withColumn("k", F.col("seq_id") * 2 + 1)
    got = trace.select_unmask(scores, max_k=max_k)
    window = Window.partitionBy("seq_id", "step").orderBy(F.desc("confidence"), "pos")
    wanted = (
        scores.where("is_masked and pos < block_end").withColumn("r", F.row_number().over(window)).where("r <= k").drop("r")
    )
    assert got.count() == wanted.count() == 1 + 3 + 5 + 7 + 9
    assert got.exceptAll(wanted).count() == 0


def test_null_keys_match_each_other(spark):
    rows = rows_with_hot_key(spark).withColumn("key", F.when(F.col("key") > 3, F.col("key")))
    for split_rows in (1_000_000, 5):
        got = attach_aggregates(rows, ["key"], split_rows, n=F.count(F.lit(1)))
        assert got.where("key is null").select("n").distinct().collect()[0].n == rows.where("key is null").count()


def test_more_large_keys_than_are_broadcast(spark, monkeypatch):
    """What is matched by broadcast has a fixed size; the other large keys still get their values."""
    monkeypatch.setattr(skew, "HOT_KEYS", 3)
    rows = rows_with_hot_key(spark)
    got = attach_aggregates(rows, ["key"], 10, total=F.sum("value"))
    window = Window.partitionBy("key")
    wanted = rows.withColumn("total", F.sum("value").over(window))
    assert got.exceptAll(wanted).count() == 0 and got.count() == 3000
    hot = rows.groupBy("key").count().where("count > 10").count()
    assert hot > 3
