"""Losses against plain loops over the definitions, on the grid of options."""

from __future__ import annotations

import itertools
import math
import statistics

import pytest
from pyspark.sql import functions as F

from rollscore.operators import losses
from rollscore.operators.losses import Loss
from rollscore.plans import jobs
from rollscore.recipe import Recipe
from rollscore.sources import sinks

SCHEMA = (
    "batch_id int, seq_id int, pos int, new_logp double, old_logp double, ref_logp double, advantage double, "
    "is_valid boolean, is_sampled boolean"
)


def tokens():
    """Two sequences of four tokens, the last one's final token past its end; a third without valid tokens."""
    rows = []
    for seq, advantage in ((0, 1.0), (1, -0.5), (2, 2.0)):
        for pos in range(4):
            old = -0.3 - 0.1 * pos - 0.05 * seq
            new = old + 0.06 * (pos - 1.4) * (1 if seq else -1)
            valid = seq == 0 or (seq == 1 and pos < 3)
            rows.append((0, seq, pos, new, old, new + 0.02, advantage, valid, pos in (1, 2)))
    return rows


def frame(spark, sampled=True, rows=None):
    table = spark.createDataFrame(rows or tokens(), SCHEMA)
    return table if sampled else table.drop("is_sampled")


def expected(kind, averaging, sampled, low, high, rows):
    """The loss value by loops."""
    counted = [r for r in rows if r[7] and (r[8] or not sampled)]
    clip = lambda x: min(max(x, 1 - low), 1 + high)
    sequences = sorted({r[1] for r in rows})
    if kind in ("gspo", "gspo_token"):
        value, valid, per_token = {}, {}, {}
        for s in sequences:
            mine = [r for r in counted if r[1] == s]
            ratio = math.exp(sum(r[3] - r[4] for r in mine) / max(len(mine), 1))
            a = next(r[6] for r in rows if r[1] == s)
            value[s] = min(ratio * a, clip(ratio) * a)
            valid[s] = any(r[7] for r in rows if r[1] == s)
            per_token[s] = -value[s] * len(mine)
        if kind == "gspo":
            ok = [s for s in sequences if valid[s]]
            return -sum(value[s] for s in ok) / len(ok) if ok else 0.0
        total = sum(per_token.values())
    else:
        def one(r):
            ratio = math.exp(r[3] - r[4])
            return -r[6] * r[3] if kind == "reinforce" else -min(ratio * r[6], clip(ratio) * r[6])

        total = sum(one(r) for r in counted)
    if averaging == "sequence_level":
        return total / len(sequences)
    return total / len(counted) if counted else 0.0


@pytest.mark.parametrize(
    ("kind", "averaging", "sampled"),
    list(itertools.product(losses.LOSS_TYPES, losses.AVERAGING_MODES, (False, True))),
)
def test_loss_values(spark, kind, averaging, sampled):
    low, high = (0.04, 0.04) if kind == "grpo" else (0.04, 0.05)
    loss = Loss(kind, averaging, 0.04, 0.04, 0.05)
    row = losses.policy_loss(frame(spark, sampled), loss).first()
    assert row.loss == pytest.approx(expected(kind, averaging, sampled, low, high, tokens()))
    if sampled:
        assert row.sampled_tokens_ratio == 0.5


def test_loss_does_not_depend_on_partitioning(spark):
    table = frame(spark)
    for kind in losses.LOSS_TYPES:
        a = losses.policy_loss(table, Loss(kind)).first().asDict()
        b = losses.policy_loss(table.repartition(5), Loss(kind)).first().asDict()
        assert a == pytest.approx(b)


def test_token_statistics(spark):
    row = losses.policy_loss(frame(spark, False), Loss("dapo", clip_eps_low=0.04, clip_eps_high=0.05)).first()
    ratios = [math.exp(r[3] - r[4]) for r in tokens() if r[7]]
    assert row.total_tokens == 7
    assert row.ratio_mean == pytest.approx(statistics.fmean(ratios))
    assert (row.ratio_max, row.ratio_min) == pytest.approx((max(ratios), min(ratios)))
    assert row.clipfrac_low == pytest.approx(sum(r < 0.96 for r in ratios) / 7)
    assert row.clipfrac_total == pytest.approx(sum(r < 0.96 or r > 1.05 for r in ratios) / 7)


def test_nothing_counted(spark):
    """Without valid tokens losses are 0 and ratio statistics look at all tokens."""
    rows = [(*r[:7], False, r[8]) for r in tokens()]
    for kind in losses.LOSS_TYPES:
        assert losses.policy_loss(frame(spark, True, rows), Loss(kind)).first().loss == 0.0
    row = losses.policy_loss(frame(spark, True, rows), Loss("grpo", clip_eps=0.04)).first()
    ratios = [math.exp(r[3] - r[4]) for r in rows]
    assert row.clipfrac == 0.0 and row.ratio_mean == pytest.approx(statistics.fmean(ratios))


def test_single_sequence_has_zero_deviation(spark):
    table = frame(spark).where("seq_id = 0")
    for sampled in (False, True):
        rows = table if sampled else table.drop("is_sampled")
        assert losses.policy_loss(rows, Loss("gspo")).first().ratio_std == 0.0
    assert losses.policy_loss(table, Loss("gspo")).first().sampling_rate == 1.0


def test_clip_mask_hand_over(spark):
    loss = Loss("dapo", clip_eps_low=0.04, clip_eps_high=0.05)
    table = losses.clip_mask(frame(spark, False), loss)
    rows = table.collect()
    kept = [r for r in rows if r.is_valid and not r.token_clipped]
    assert 0 < len(kept) < 7
    wanted = sum(-math.exp(r.new_logp - r.old_logp) * r.advantage for r in kept) / 7
    row = losses.policy_loss(table, loss, skip_clipped="token_clipped").first()
    assert row.loss == pytest.approx(wanted)
    assert row.token_clip_masked_frac == pytest.approx(sum(r.token_clipped for r in rows) / 12)
    with pytest.raises(ValueError):
        losses.clip_mask(table, Loss("gspo"))


def test_kl(spark):
    k = math.exp(0.02) - 0.02 - 1
    assert losses.kl(frame(spark)).first().kl == pytest.approx(k)
    none = [(*r[:7], False, r[8]) for r in tokens()]
    assert losses.kl(frame(spark, True, none)).first().kl == 0.0


@pytest.mark.parametrize(("position", "sampled", "iterations", "beta"), list(itertools.product((False, True), (False, True), (1, 2), (0.0, 0.04))))
def test_total_loss_grid(spark, position, sampled, iterations, beta):
    """Position loss, sampling, one or two iterations, and KL, in all combinations."""
    loss = Loss("gspo", clip_eps_low=0.0003, clip_eps_high=0.0004)
    table = frame(spark, sampled)
    keys = ["batch_id", "seq_id", "pos"]
    rest = [c for c in table.columns if c not in ("new_logp", "old_logp", "ref_logp")]
    old = table.select(*keys, "old_logp") if iterations > 1 else None
    aligned = losses.align(table.select(*rest, "new_logp"), old, table.select(*keys, "ref_logp"))
    token = losses.policy_loss(aligned, loss)
    pos = losses.policy_loss(aligned, loss) if position else None
    row = losses.total_loss(token, pos, losses.kl(aligned), 0.5, beta).first()
    rows = tokens() if iterations > 1 else [(*r[:4], r[3], *r[5:]) for r in tokens()]
    base = expected("gspo", "token_level", sampled, 0.0003, 0.0004, rows)
    wanted = base * (1.5 if position else 1.0) + beta * (math.exp(0.02) - 0.02 - 1)
    assert row.total_loss == pytest.approx(wanted)


@pytest.mark.parametrize("split_rows", [1_000_000, 2])
def test_advantages_are_attached(spark, split_rows):
    table = frame(spark)
    per_sequence = table.groupBy("batch_id", "seq_id").agg(F.max("advantage").alias("advantage"))
    joined = losses.attach_advantages(table.drop("advantage"), per_sequence, split_rows=split_rows)
    assert sorted((r.seq_id, r.pos, r.advantage) for r in joined.collect()) == sorted((r[1], r[2], r[6]) for r in tokens())
    row = jobs.policy_metrics(table.drop("advantage"), per_sequence, Loss("grpo")).first()
    assert row.loss == pytest.approx(expected("grpo", "token_level", True, 0.2, 0.2, tokens()))


def test_update_metrics(spark):
    """One long table per update with everything the recipe asks for."""
    rows = frame(spark).withColumns({"new_pos_logp": F.col("new_logp") * 0.5, "old_pos_logp": F.col("old_logp") * 0.5})
    settings = dict(loss_type="dapo", position_loss_type="grpo", clip_eps_low=0.04, clip_eps_high=0.05, position_clip_eps=0.04,
                    use_stepmerge=True, use_position_likelihood=True, num_iterations=2, beta=0.04)
    metrics = {}
    for skip in (False, True):
        recipe = Recipe(position_mask_token_clipped=skip, **settings)
        metrics[skip] = {r.name: r.value for r in jobs.update_metrics(rows, recipe).collect()}
    plain, masked = metrics[False], metrics[True]
    assert plain["policy/loss"] == pytest.approx(expected("dapo", "token_level", True, 0.04, 0.05, tokens()))
    assert plain["kl"] == pytest.approx(math.exp(0.02) - 0.02 - 1)
    assert plain["total_loss"] == pytest.approx(plain["policy_loss"] + plain["position_loss"] + 0.04 * plain["kl"])
    assert "position/token_clip_masked_frac" in masked and "position/token_clip_masked_frac" not in plain
    assert plain["advantage_mean"] == pytest.approx(2.5 / 3) and plain["token_coverage"] == pytest.approx(4 / 7)


@pytest.mark.parametrize("missing", ["new_logp", "old_logp", "ref_logp", "advantage", "new_pos_logp", "old_pos_logp"])
def test_update_metrics_refuse_tokens_without_a_partner(spark, missing):
    """A lost partner row is an error, not a smaller loss; a column that no metric reads may lack values."""
    rows = frame(spark).withColumns({"new_pos_logp": F.col("new_logp") * 0.5, "old_pos_logp": F.col("old_logp") * 0.5})
    rows = rows.withColumn(missing, F.when(F.col("seq_id") * 4 + F.col("pos") != 1, F.col(missing)))
    settings = dict(loss_type="dapo", position_loss_type="grpo", use_stepmerge=True, use_position_likelihood=True, num_iterations=2)
    with pytest.raises(Exception, match=f"A token has no {missing}"):
        jobs.update_metrics(rows, Recipe(beta=0.04, **settings)).collect()
    if missing == "ref_logp":
        assert jobs.update_metrics(rows, Recipe(beta=0.0, **settings)).count() > 0
    if missing == "old_logp":
        assert losses.update_values(rows, Loss("reinforce")).count() == 1


def test_bucketed_tables_join_without_a_shuffle(spark):
    """Token tables stored by token are aligned in place."""
    keys = ["batch_id", "seq_id", "pos"]
    table = frame(spark)
    for column in ("new_logp", "old_logp", "ref_logp"):
        sinks.write_token_table(table.select(*keys, column), f"tokens_{column}", 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        aligned = losses.align(*[spark.table(f"tokens_{c}") for c in ("new_logp", "old_logp", "ref_logp")])
        assert aligned.count() == 12
        plan = aligned._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_unknown_names():
    with pytest.raises(ValueError):
        Loss("ppo")
    with pytest.raises(ValueError):
        Loss("grpo", "per_batch")
