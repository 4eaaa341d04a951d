"""Packed joins, block sums, attached batches and tasks of bounded size: the same rows as the plain forms."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rollscore.operators import joins, position, trace
from rollscore.plans import skew
from rollscore.plans.packed import left_join
from workload import fixtures

SCORES = "seq_id bigint, segment bigint, pos bigint, unmask_step bigint, own_score double, confidence double"


def equal(got, wanted):
    return got.exceptAll(wanted).count() == 0 and wanted.exceptAll(got).count() == 0


def test_left_join_equals_a_join(spark):
    """Repeated, missing and NULL positions, and chunks of one key that lie apart."""
    left = spark.createDataFrame([(1, 0, 1), (1, 0, 2), (1, 9000, 3), (1, None, 4), (None, 0, 5), (2, 5, 6)], "key bigint, pos bigint, a int")
    right = spark.createDataFrame([(1, 0, "x"), (1, 0, "y"), (1, 9000, None), (1, None, "n"), (None, 0, "k"), (3, 5, "z")], "key bigint, pos bigint, b string")
    got = left_join(left, ["key"], "pos", [(right, "pos")])
    assert equal(got, left.join(right, ["key", "pos"], "left").select("key", "pos", "a", "b"))


def test_selection_audit_keeps_repeated_rows(spark):
    scores = spark.createDataFrame([(1, 0, p, p / 8, True, 8, 2) for p in range(4)], "seq_id bigint, step bigint, pos bigint, confidence double, is_masked boolean, block_end bigint, k bigint")
    traj = spark.createDataFrame([(1, 3, 0), (1, 3, 0), (1, 0, 0), (1, 0, 0), (1, 1, 1)], "seq_id bigint, pos bigint, unmask_step bigint")
    found = trace.audit_selection(scores, traj, max_k=2)
    assert sorted(map(tuple, found.collect())) == [(1, 0, 0, "not_selected"), (1, 0, 0, "not_selected"), (1, 0, 2, "not_revealed")]


@pytest.mark.parametrize("scope", position.SCOPES)
def test_blocks_pack_rows_once(spark, scope):
    rows = [(s, g, p, (p * 5 + s) % 9 - 1, p / 4, (p * 3 % 7) / 4) for s in (1, 2) for g in (0, 1) for p in [*range(20), 3, 3]]
    scores = spark.createDataFrame(rows, SCORES)
    got = position.bradley_terry_logps(scores, 8, 2, scope, chunk=7, blocks=True)
    wanted = position.bradley_terry_logps(scores, 8, 2, scope, chunk=7)
    assert equal(got.withColumn("pos_logp", F.round("pos_logp", 9)), wanted.withColumn("pos_logp", F.round("pos_logp", 9)))


def test_few_keys_are_broadcast(spark, monkeypatch):
    rows = spark.range(300).select(F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("key"), "id")
    stats = rows.groupBy("key").agg(F.count(F.lit(1)).alias(skew.ROW_COUNT), F.sum("id").alias("total"))
    wanted = skew.attach(rows, stats, ["key"])
    got = skew.attach_few(rows, stats, ["key"])
    assert equal(got, wanted) and got.rdd.getNumPartitions() == rows.rdd.getNumPartitions()
    monkeypatch.setattr(skew, "HOT_KEYS", 3)
    assert equal(skew.attach_few(rows, stats, ["key"]), wanted)


def test_interval_sums_equal_grouped_pairs(spark):
    points = spark.createDataFrame([(i, i * 7 % 40) for i in range(60)] + [(99, None)], "id bigint, at bigint")
    intervals = spark.createDataFrame(
        [(i, i if i % 5 else None, i + i % 9 - 1 if i % 7 else None) for i in range(-5, 50)] + [(99, 200, None)], "name bigint, low bigint, high bigint"
    )
    wanted = joins.interval_join(points, intervals, "at", "low", "high").groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.max("at").alias("last"), F.sum("id").alias("ids")
    )
    got = joins.interval_sums(points, intervals, "at", "low", "high", {"ids": "id"})
    assert got.count() == 56 and equal(got.where("n > 0").select(*wanted.columns), wanted)


def test_a_larger_table_has_more_tasks(spark, tmp_path, monkeypatch):
    spark.range(100).selectExpr("id doc_id", "'a' text", "'s' source", "1 n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setitem(fixtures.TASK_ROWS, "documents", 5)
    assert fixtures.read(spark, str(tmp_path), "documents").rdd.getNumPartitions() == 20
