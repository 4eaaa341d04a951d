"""Position likelihood against loops over all pairs, and logit expressions against loops."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollscore.functions import logits
from rollscore.operators import kernel, likelihood, position, segments
from rollscore.plans import jobs
from rollscore.recipe import Recipe

STEPS, SEGMENTS, WIDTH = 16, 4, 4


def score_rows(length=40, spread=1.0, seed=3):
    draw = random.Random(seed)
    rows = []
    for seq in range(3):
        steps = [draw.choice([-1, *range(STEPS)]) for _ in range(length)]
        for segment in range(SEGMENTS):
            for pos in range(length):
                rows.append((seq, segment, pos, steps[pos], draw.uniform(-3, 3) * spread, draw.uniform(-3, 3) * spread))
    return rows


SCHEMA = "seq_id int, segment int, pos int, unmask_step int, own_score double, confidence double"


def log_sum_exp(values):
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def by_pairs(rows, method, scope, tau):
    result = {}
    for seq, segment, pos, step, own, _ in rows:
        start, end = segment * WIDTH, (segment + 1) * WIDTH
        if not start < step <= end:
            result[seq, segment, pos] = 0.0
            continue
        limit = end if scope == "segment" else step
        rivals = [r[5] / tau for r in rows if r[0] == seq and r[1] == segment and r[3] > limit and r[2] != pos]
        if method == "softmax":
            result[seq, segment, pos] = own / tau - log_sum_exp([own / tau, *rivals])
        else:
            result[seq, segment, pos] = sum(-math.log1p(math.exp(-(own / tau - r))) for r in rivals)
    return result


@pytest.mark.parametrize("method", position.METHODS)
@pytest.mark.parametrize("scope", position.SCOPES)
@pytest.mark.parametrize("tau", [1.0, 0.5])
def test_against_all_pairs(spark, method, scope, tau):
    rows = score_rows()
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {(r.seq_id, r.segment, r.pos): r.pos_logp for r in position.position_logps(frame, STEPS, SEGMENTS, method, scope, tau).collect()}
    assert got == pytest.approx(by_pairs(rows, method, scope, tau))


@pytest.mark.parametrize("scope", position.SCOPES)
def test_scores_far_apart(spark, scope):
    """Scores that differ by thousands neither overflow nor vanish."""
    rows = score_rows(spread=2000.0, seed=5)
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {(r.seq_id, r.segment, r.pos): r.pos_logp for r in position.softmax_logps(frame, STEPS, SEGMENTS, scope).collect()}
    assert got == pytest.approx(by_pairs(rows, "softmax", scope, 1.0))


@pytest.mark.parametrize("scope", position.SCOPES)
def test_hot_sequences_and_small_chunks(spark, scope):
    rows = score_rows()
    frame = spark.createDataFrame(rows, SCHEMA)
    soft = {(r.seq_id, r.segment, r.pos): r.pos_logp for r in position.softmax_logps(frame, STEPS, SEGMENTS, scope, split_rows=2).collect()}
    assert soft == pytest.approx(by_pairs(rows, "softmax", scope, 1.0))
    for blocks in (False, True):
        found = position.bradley_terry_logps(frame, STEPS, SEGMENTS, scope, chunk=7, blocks=blocks).collect()
        pairs = {(r.seq_id, r.segment, r.pos): r.pos_logp for r in found}
        assert pairs == pytest.approx(by_pairs(rows, "bradley_terry", scope, 1.0))


def test_nothing_revealed_gives_zero(spark):
    frame = spark.createDataFrame([(0, 0, p, -1, 1.0, 2.0) for p in range(4)], SCHEMA)
    for method in position.METHODS:
        rows = position.position_logps(frame, STEPS, SEGMENTS, method, "position").collect()
        assert [r.pos_logp for r in rows] == [0.0] * 4


def test_unknown_names(spark):
    frame = spark.createDataFrame([(0, 0, 0, 1, 1.0, 2.0)], SCHEMA)
    for options in ({"method": "x"}, {"scope": "x"}, {"tau": 0.0}):
        with pytest.raises(ValueError):
            position.position_logps(frame, STEPS, SEGMENTS, **options)
    for method, source in (("x", "max"), ("margin", "gt"), ("max_logit", "x")):
        with pytest.raises(ValueError):
            logits.own_score(F.col("l"), F.col("t"), method, source)
    with pytest.raises(ValueError):
        logits.remask_confidence(F.col("l"), F.col("t"), "x", F.lit(0.5))


VALUES = [[1.0, 3.0, -2.0, 3.0], [1000.0, 999.0, 0.0, -1000.0], [0.5, 0.25, 0.125, 0.0]]


def test_logit_expressions(spark):
    frame = spark.createDataFrame([(i, v, i % 4) for i, v in enumerate(VALUES)], "i int, logits array<float>, target int")
    l, t = F.col("logits"), F.col("target")
    rows = frame.select(
        "i", logits.token_logp(l, t).alias("logp"), logits.argmax_token(l).alias("best"),
        *[logits.confidence(l, m).alias(m) for m in logits.CONFIDENCE_METHODS],
    ).collect()
    for r in rows:
        v = VALUES[r.i]
        z = log_sum_exp(v)
        p = sorted((math.exp(x - z) for x in v), reverse=True)
        assert r.logp == pytest.approx(v[r.i % 4] - z)
        assert r.best == v.index(max(v)) and r.max_logit == max(v)
        assert r.top_prob == pytest.approx(p[0]) and r.margin == pytest.approx(p[0] - p[1])
        assert r.neg_entropy == pytest.approx(sum(math.exp(x - z) * (x - z) for x in v))


def test_guidance_and_noise(spark):
    frame = spark.createDataFrame([([1.0, 2.0], [0.5, 3.0])], "c array<double>, u array<double>")
    assert frame.select(logits.cfg_combine(F.col("c"), F.col("u"), 2.0).alias("x")).first().x == [2.0, 0.0]
    assert frame.select(logits.cfg_combine(F.col("c"), F.col("u"), 0.0).alias("x")).first().x == [1.0, 2.0]
    assert frame.select(logits.gumbel_scores(F.col("c"), 0.0, 1, []).alias("x")).first().x == [1.0, 2.0]
    row = frame.select(
        logits.decoupled_noise(F.lit(0.5), 0.7, F.lit(0.25)).alias("d"),
        logits.stochastic_noise(F.lit(float("-inf")), 0.7, F.lit(0.25)).alias("s"),
        logits.decoupled_noise(F.lit(0.5), 0.0, F.lit(0.25)).alias("z"),
    ).first()
    gumbel = -math.log(-math.log(0.25 + 1e-8) + 1e-8)
    assert row.d == pytest.approx(math.log(0.5 + 1e-8) + 0.7 * gumbel)
    assert row.s == float("-inf") and row.z == 0.5


def test_gumbel_draws_follow_the_softmax(spark):
    """At temperature 1 tokens are drawn with their probabilities."""
    frame = spark.range(20000).withColumn("logits", F.array(F.lit(0.0), F.lit(1.0), F.lit(2.0)))
    noisy = logits.gumbel_scores(F.col("logits"), 1.0, 9, [F.col("id")])
    counts = {r.t: r["count"] for r in frame.select(logits.argmax_token(noisy).alias("t")).groupBy("t").count().collect()}
    z = sum(math.exp(x) for x in (0, 1, 2))
    for token in range(3):
        assert counts[token] / 20000 == pytest.approx(math.exp(token) / z, abs=0.02)


def toy_logits(spark):
    """Two sequences of four tokens over a vocabulary of eight, scored in both segments."""
    draw = random.Random(7)
    ids, steps = [[3, 4, 5, 6], [6, 5, 4, 3]], [[0, 1, 2, 3], [0, 2, 1, 3]]
    rows = [
        (s, n, p, ids[s][p], steps[s][p], [draw.uniform(-2, 2) for _ in range(8)])
        for s in range(2) for n in range(2) for p in range(4)
    ]
    return rows, spark.createDataFrame(
        rows, "seq_id int, segment int, pos int, token_id int, unmask_step int, logits array<double>"
    )


def test_token_and_position_likelihood_jobs(spark):
    rows, frame = toy_logits(spark)
    traj = frame.select("seq_id", "pos", "token_id", "unmask_step").distinct()
    recipe = Recipe(
        max_completion_length=4, block_length=2, diffusion_steps=4, use_stepmerge=True, num_stepmerge_blocks=2,
        use_position_likelihood=True, position_likelihood_method="softmax", position_likelihood_scope="segment",
    )
    token = {(r.seq_id, r.pos): r.logp for r in jobs.token_likelihood(frame, traj, recipe).collect()}
    pos = {(r.seq_id, r.pos): r.pos_logp for r in jobs.position_likelihood(frame, traj, recipe).collect()}
    assert len(token) == len(pos) == 8
    for seq, segment, p, target, step, values in rows:
        if not segment * 2 < step <= segment * 2 + 2:
            continue
        assert token[seq, p] == pytest.approx(values[target] - log_sum_exp(values))
        rivals = [max(r[5]) for r in rows if r[0] == seq and r[1] == segment and r[4] > segment * 2 + 2]
        assert pos[seq, p] == pytest.approx(values[target] - log_sum_exp([values[target], *rivals]))
    assert token[0, 0] == 0.0 and pos[1, 0] == 0.0
    # Drawn segments keep their values; tokens of the others are unknown, those outside all stay 0.
    batch, own = F.floor(F.col("seq_id") / 2).cast("bigint"), {(r[0], r[2]): r[1] for r in rows if r[1] * 2 < r[4] <= r[1] * 2 + 2}
    drawn = spark.createDataFrame([(0, 0, 1), (0, 1, 1)], "batch_id bigint, iter int, segment bigint")
    some = jobs.position_likelihood(frame.withColumn("batch_id", batch), traj, recipe, drawn).collect()
    assert {(r.seq_id, r.pos): r.pos_logp for r in some} == {
        k: 0.0 if k not in own else pos[k] if own[k] == 1 else None for k in pos
    }
    bare = frame.drop("token_id", "unmask_step")
    joined = likelihood.with_targets(bare, traj)
    assert joined.count() == 16
    assert segments.active_segments(segments.assign_segment(frame.drop("segment"), 4, 2), ("seq_id",)).count() == 4
    repeated = likelihood.repeat_iterations(jobs.token_likelihood(frame, traj, recipe), 3)
    assert repeated.count() == 24


@pytest.mark.parametrize("method", position.METHODS)
@pytest.mark.parametrize("scope", position.SCOPES)
def test_closed_competitors_weigh_nothing(spark, method, scope):
    """Minus infinity is a competitor that is never chosen, for one step, all later steps, or with others beside it."""
    rows = [r[:5] + ((-math.inf if r[2] % 3 == 0 or r[0] == 1 else r[5]),) for r in score_rows()]
    open_rows = [r for r in rows if r[5] > -math.inf]
    got = {
        (r.seq_id, r.segment, r.pos): r.pos_logp
        for r in position.position_logps(spark.createDataFrame(rows, SCHEMA), STEPS, SEGMENTS, method, scope, 0.5).collect()
    }
    for seq, segment, pos, step, own, _ in rows:
        limit = (segment + 1) * WIDTH if scope == "segment" else step
        rivals = [r[5] / 0.5 for r in open_rows if r[0] == seq and r[1] == segment and r[3] > limit and r[2] != pos]
        here = segment * WIDTH < step <= (segment + 1) * WIDTH
        if not here or not rivals:
            expected = 0.0
        elif method == "softmax":
            expected = own / 0.5 - log_sum_exp([own / 0.5, *rivals])
        else:
            expected = sum(-math.log1p(math.exp(-(own / 0.5 - r))) for r in rivals)
        assert got[seq, segment, pos] == pytest.approx(expected, abs=1e-9)


def test_a_missing_confidence_is_not_taken_for_no_competitor(spark):
    rows = [(0, 0, 0, 1, 1.0, 0.0), (0, 0, 1, 3, 1.0, None), (0, 0, 2, 4, 1.0, 0.5)]
    got = {r.pos: r.pos_logp for r in position.softmax_logps(spark.createDataFrame(rows, SCHEMA), STEPS, SEGMENTS, "position").collect()}
    assert got[0] is None and got[1] == pytest.approx(1 - log_sum_exp([1.0, 0.5])) and got[2] == 0.0


@pytest.mark.parametrize("spread", [1.0, 30.0, 500.0])
@pytest.mark.parametrize("steps", [1, 5, 4000])
def test_kernel(monkeypatch, spread, steps):
    """Blocks with and without masks and tails against the sum over all pairs."""
    monkeypatch.setattr(kernel, "TARGETS", 16)
    monkeypatch.setattr(kernel, "RIVALS", 32)
    rng = np.random.default_rng(steps)
    threshold, step = rng.integers(0, steps, 300).astype(float), rng.integers(0, steps + 1, 500).astype(float)
    own, confidence = rng.normal(size=300) * spread, rng.normal(size=500) * spread
    confidence[::7] = -np.inf
    d = own[:, None] - confidence[None, :]
    expected = ((np.minimum(d, 0) - np.log1p(np.exp(-np.abs(d)))) * (step[None, :] > threshold[:, None])).sum(axis=1)
    assert np.allclose(kernel.log_sigmoid_sums(threshold, own, step, confidence), expected, rtol=1e-12, atol=1e-11)
    assert len(kernel.log_sigmoid_sums(threshold[:0], own[:0], step, confidence)) == 0
    assert not kernel.log_sigmoid_sums(threshold, own, step[:0], confidence[:0]).any()


def test_blocks_keep_nulls(spark):
    rows = [(0, 0, 0, 1, 1.0, 0.0), (0, 0, 1, 3, None, 0.25), (0, 0, 2, 4, 1.0, 0.5), (1, 0, 0, 1, 1.0, 0.0), (1, 0, 1, 2, 1.0, None)]
    for blocks in (False, True):
        found = position.bradley_terry_logps(spark.createDataFrame(rows, SCHEMA), STEPS, SEGMENTS, "position", blocks=blocks)
        got = {(r.seq_id, r.pos): r.pos_logp for r in found.collect()}
        assert got[0, 0] == pytest.approx(-math.log1p(math.exp(-0.75)) - math.log1p(math.exp(-0.5)))
        assert got[0, 2] == 0.0 and got[1, 1] == 0.0


def test_sums_do_not_depend_on_the_order_of_competitors_and_are_right_to_the_last_digits():
    draw = np.random.default_rng(3)
    step, confidence = draw.integers(0, 16, 4096).astype(float), draw.normal(size=4096)
    own, threshold = draw.normal(size=300), draw.integers(0, 16, 300).astype(float)
    found = kernel.log_sigmoid_sums(threshold, own, step, confidence)
    turned = draw.permutation(len(step))
    assert (found == kernel.log_sigmoid_sums(threshold, own, step[turned], confidence[turned])).all()
    for limit, score, total in zip(threshold, own, found, strict=True):
        d = score - confidence[step > limit]
        assert abs(total - math.fsum(np.minimum(d, 0) - np.log1p(np.exp(-np.abs(d))))) <= math.ulp(total)


def test_sums_over_other_chunks_do_not_depend_on_their_order():
    pos, sums = np.arange(200.0), np.random.default_rng(4).normal(size=(6, 200))
    one, other = (kernel._by_position(pos, sums[0], np.tile(pos, 5), far.ravel()) for far in (sums[1:], sums[:0:-1]))
    assert (one == other).all()
