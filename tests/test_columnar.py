"""Rows that are packed column by column before a shuffle: the same rows, a fraction of the bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rollscore.operators import losses, position, trace
from rollscore.plans import columnar, jobs
from rollscore.recipe import Recipe
from workload import fixtures

KINDS = {"pos": "bigint", "step": "int", "x": "double", "y": "float", "ok": "boolean", "w": "smallint", "wide": "bigint"}


def equal(got, wanted):
    return got.exceptAll(wanted).count() == 0 and wanted.exceptAll(got).count() == 0


def shuffled_bytes(df):
    """Bytes that the exchanges of ``df``'s plan wrote, each counted once."""
    df.collect()
    found = {}

    def visit(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return visit(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return visit(node.plan())
        if kind == "ReusedExchangeExec":
            return visit(node.child())
        if kind == "ShuffleExchangeExec":
            found[node.id()] = node.metrics().apply("shuffleBytesWritten").value()
        children = node.children()
        for i in range(children.size()):
            visit(children.apply(i))

    visit(df._jdf.queryExecution().executedPlan())
    return sum(found.values())


@pytest.mark.parametrize("rows", [1, columnar.FEW, 700, 5000])
def test_packing_keeps_every_value(rows):
    """NULL, NaN, signed zeros, random bits and the ends of the range, in groups of one row and of many."""
    rng = np.random.default_rng(rows)
    x = rng.random(rows)
    x[::5], x[1::7], x[2::9] = np.nan, -0.0, np.inf
    wide = rng.integers(-2**63, 2**63 - 1, rows)
    wide[:1] = -2**63
    batch = pa.record_batch({
        "key": pa.array([None if i % 3 == 0 else "ab"[i // 600 % 2] for i in range(rows)]),
        "pos": pa.array(np.arange(rows) % 450, mask=rng.random(rows) < 0.1), "step": pa.array(rng.integers(0, 16, rows).astype("i4")),
        "x": pa.array(x, mask=rng.random(rows) < 0.2), "y": pa.array((rng.integers(0, 9, rows) / 8).astype("f4")),
        "ok": pa.array(rng.random(rows) < 0.5, mask=rng.random(rows) < 0.3), "w": pa.array(rng.integers(-2**15, 2**15, rows).astype("i2")),
        "wide": pa.array(wide),
    })
    halves = [batch.slice(0, rows // 2), batch.slice(rows // 2)]
    packed = pa.Table.from_batches(list(columnar.packed_batches(halves, ["key"], "pos", KINDS))).combine_chunks().to_batches()[0]
    lists = pa.ListArray.from_arrays(
        pa.array(range(len(packed) + 1), pa.int32()), pa.StructArray.from_arrays([packed.column("_n"), packed.column("_data")], ["_n", "_data"])
    )
    parent, values = columnar.unpack(lists, KINDS)
    got = zip(packed.column("key").take(pa.array(parent)).to_pylist(), *(values[n].to_pylist() for n in KINDS), strict=True)
    assert sorted(map(repr, got)) == sorted(map(repr, zip(*(batch.column(n).to_pylist() for n in ["key", *KINDS]), strict=True)))


def tokens(spark):
    return spark.range(60_000).select(
        F.floor(F.col("id") / 6000).cast("bigint").alias("batch_id"), F.floor(F.col("id") / 600).cast("bigint").alias("seq_id"),
        (F.col("id") % 600).alias("pos"), (-(F.col("id") * 37 % 101) / 16).alias("new_logp"), (-(F.col("id") * 53 % 103) / 16).alias("old_logp"),
    )


def test_aligned_tokens_write_little(spark):
    """60,000 tokens with an advantage and an old value; as rows and arrays they took more than 20 bytes each."""
    keys = ["batch_id", "seq_id", "pos"]
    advantages = spark.range(99).select(F.floor(F.col("id") / 10).cast("bigint").alias("batch_id"), F.col("id").alias("seq_id"), F.lit(1.5).alias("advantage"))
    new = losses.attach_advantages(tokens(spark).select(*keys, "new_logp"), advantages)
    aligned = losses.align(new, tokens(spark).where("pos % 23 > 0").select(*keys, "old_logp"), packed=True)
    assert shuffled_bytes(aligned) < 60_000 * 6
    assert aligned.count() == 60_000 and aligned.where("advantage is null").count() == 600


def test_attached_advantages_match_null_and_repeated_keys(spark):
    rows = spark.createDataFrame([(1, 1, 0, 0.5), (1, 1, 0, 0.5), (1, None, 3, None), (None, 2, None, 1.0), (2, 2, 1, 2.0)], "batch_id bigint, seq_id bigint, pos bigint, new_logp double")
    values = spark.createDataFrame([(1, 1, 9.0), (1, 1, 8.0), (1, None, 7.0), (None, 2, None)], "batch_id bigint, seq_id bigint, advantage double")
    for split_rows in (1_000_000, 1):
        got = losses.attach_advantages(rows, values, split_rows=split_rows)
        text = losses.attach_advantages(rows.withColumn("name", F.lit("x")), values, split_rows=split_rows).drop("name")
        assert equal(got, text) and got.columns == text.columns and got.count() == 7


@pytest.mark.parametrize("scope", position.SCOPES)
def test_blocks_write_little(spark, scope):
    """L3: a token that only competes is moved with its confidence alone."""
    each = tokens(spark).withColumn("segment", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))))
    scores = each.select(
        "seq_id", "segment", "pos", ((F.col("pos") * 5 + F.col("seq_id")) % 9 - 1).alias("unmask_step"),
        F.col("new_logp").alias("own_score"), F.col("old_logp").alias("confidence"),
    )
    got = position.bradley_terry_logps(scores, 8, 2, scope, blocks=True)
    assert shuffled_bytes(got) < 120_000 * 4
    few = scores.where("seq_id < 3")
    wanted = position.bradley_terry_logps(few, 8, 2, scope)
    assert equal(got.where("seq_id < 3").withColumn("pos_logp", F.round("pos_logp", 8)), wanted.withColumn("pos_logp", F.round("pos_logp", 8)))


def test_spread_files_are_read_as_they_are(spark, tmp_path):
    columns = spark.range(2000).selectExpr("id doc_id", "'a' text", "'s' source", "1 n_chars")
    columns.repartition(16).write.parquet(f"{tmp_path}/many/documents.parquet")
    columns.coalesce(1).write.parquet(f"{tmp_path}/one/documents.parquet")
    plans = {
        (folder, dealt): fixtures.read(spark, f"{tmp_path}/{folder}", "documents", dealt)._jdf.queryExecution().executedPlan().toString()
        for folder in ("many", "one") for dealt in (True, False)
    }
    assert {k for k, plan in plans.items() if "Exchange" not in plan} == {("many", False)}


def test_schedule_audit_tells_nameless_blocks_apart(spark):
    """What a sequence, block or step that is NULL expects meets nothing."""
    rows = [(1, 0, 0), (1, 1, 1), (1, 2, 1), (1, 3, None), (1, 4, 5), (1, 5, -1), (None, 0, 0), (None, 1, 1), (2, None, 0), (2, 9000, 4500), (2, 9001, 4501)]
    traj = spark.createDataFrame(rows, "seq_id bigint, pos bigint, unmask_step bigint")
    found = sorted((tuple(r) for r in trace.audit_schedule(traj, 4, 2).collect()), key=repr)
    assert found == sorted([
        (1, 0, 0, 2, 1, "wrong_count"), (1, 0, None, 0, 1, "wrong_count"),
        (1, 1, 2, 1, 0, "wrong_count"), (1, 1, 3, 1, 0, "wrong_count"), (1, 1, 5, 0, 1, "outside_block"), (1, 1, -1, 0, 1, "never_revealed"),
        (None, 0, 0, 1, 0, "wrong_count"), (None, 0, 1, 1, 0, "wrong_count"), (None, 0, 0, 0, 1, "wrong_count"), (None, 0, 1, 0, 1, "wrong_count"),
        (2, None, None, 1, 0, "wrong_count"), (2, None, 0, 0, 1, "wrong_count"),
    ], key=repr)


def test_selection_audit_orders_as_before(spark):
    """Ties, NaN, NULL and infinite confidences, NULL keys, steps far apart, steps without an open row."""
    values = [0.5, 0.5, float("nan"), None, float("inf"), -1.0, float("-inf"), 0.25]
    rows = [(s, t, p, values[(p * 3 + (t or 0)) % 8], (p + (t or 0)) % 4 > 0, 40, 1 + (t or 0) % 3) for s in (1, 2, None) for t in (0, 1, 300, 5000, None) for p in range(20)]
    rows += [(1, 9, p, 0.5, False, 40, 2) for p in range(3)] + [(1, 10, 50, 0.5, True, 40, 2), (1, 11, None, 0.5, True, 40, 2), (1, 12, 1, 0.5, None, None, None)]
    scores = spark.createDataFrame(rows, "seq_id bigint, step bigint, pos bigint, confidence double, is_masked boolean, block_end bigint, k bigint")
    traj = spark.createDataFrame(
        [(s, p, (0, 1, 300, 9, 10, 11, 12, 5000, 77, -1)[p % 10]) for s in (1, 2, 3, None) for p in [*range(20), 4, 4]] + [(1, None, 0), (1, 3, None)],
        "seq_id bigint, pos bigint, unmask_step bigint",
    )
    for max_k in (None, 2, 3):
        wanted = trace._audited_by_step(scores, traj, ("seq_id",), max_k, F.col("pos"))
        got = trace.audit_selection(scores, traj, max_k=max_k)
        assert equal(got, wanted) and got.dtypes == wanted.dtypes and got.count() >= 40


def test_trace_audit_writes_little(spark):
    """Per token two logged scores and a revealed position; as rows and arrays they took more than 100 bytes."""
    traj = spark.range(40_000).select(
        F.floor(F.col("id") / 400).cast("bigint").alias("seq_id"), (F.col("id") % 400).alias("pos"),
        (F.floor(F.col("id") % 400 / 32) * 4 + F.col("id") % 400 % 32 % 4).cast("bigint").alias("unmask_step"),
    )
    each = traj.withColumn("step", F.explode(F.array("unmask_step", F.col("unmask_step") - 1))).where("step >= 0")
    scores = each.select("seq_id", "step", "pos", ((F.col("pos") * 37 + F.col("step") * 5) % 101 / 101).alias("confidence"))
    recipe = Recipe(max_completion_length=64, block_length=32, diffusion_steps=8, stochastic_position_selection=True, position_sampling_temperature=0.5, seed=17)
    assert shuffled_bytes(jobs.audit_trace(traj, recipe, scores)) < 40_000 * 30
