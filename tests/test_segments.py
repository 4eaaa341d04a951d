from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rollscore.functions import tokens
from rollscore.operators import prompts, segments, trace
from rollscore.operators.schedule import mask_seeds, rollout_schedule, step_grid
from rollscore.plans import jobs
from rollscore.recipe import Recipe


def toy(spark):
    """Two completions of four tokens: T=4 steps, N=2 segments, tokens 3..6 and 6..3."""
    ids, steps = [[3, 4, 5, 6], [6, 5, 4, 3]], [[0, 1, 2, 3], [0, 2, 1, 3]]
    return spark.createDataFrame(
        [(0, s, p, ids[s][p], steps[s][p]) for s in range(2) for p in range(4)],
        "batch_id int, seq_id int, pos int, token_id int, unmask_step int",
    )


def test_step_zero_belongs_to_no_segment(spark):
    got = {(r.seq_id, r.pos): r.segment for r in segments.assign_segment(toy(spark), 4, 2).collect()}
    assert [got[0, p] for p in range(4)] == [None, 0, 0, 1]
    assert [got[1, p] for p in range(4)] == [None, 0, 0, 1]


@pytest.mark.parametrize(("steps", "count"), [(128, 32), (16, 4), (10, 3), (5, 5)])
def test_segments_partition_the_steps(spark, steps, count):
    frame = spark.range(-1, steps + 2).select(F.col("id").alias("step"))
    got = {r.step: r.s for r in frame.select("step", segments.segment_of(F.col("step"), steps, count).alias("s")).collect()}
    width = steps // count
    for step, found in got.items():
        inside = [n for n in range(count) if n * width < step <= (n + 1) * width]
        assert ([found] if found is not None else []) == inside
    with pytest.raises(ValueError):
        segments.segment_of(F.col("step"), 4, 5)


@pytest.mark.parametrize("split_rows", [1_000_000, 2])
def test_eos_mask(spark, split_rows):
    got = segments.eos_mask(toy(spark), 5, split_rows=split_rows)
    valid = {(r.seq_id, r.pos): r.is_valid for r in got.collect()}
    assert [valid[0, p] for p in range(4)] == [True, True, True, False]
    assert [valid[1, p] for p in range(4)] == [True, True, False, False]
    assert all(r.is_valid for r in segments.eos_mask(toy(spark), 99, split_rows=split_rows).collect())


@pytest.mark.parametrize("split_rows", [1_000_000, 2])
def test_segment_inputs_show_the_state_at_the_start(spark, split_rows):
    table = segments.assign_segment(toy(spark), 4, 2)
    rows = segments.segment_inputs(table, 4, 2, 0, split_rows=split_rows).collect()
    seen = {(r.segment, r.seq_id, r.pos): (r.input_id, r.is_target) for r in rows}
    assert len(seen) == 16
    assert [seen[0, 0, p] for p in range(4)] == [(3, False), (0, True), (0, True), (0, False)]
    assert [seen[1, 1, p] for p in range(4)] == [(6, False), (5, False), (4, False), (0, True)]


@pytest.mark.parametrize("block", [1, 3, 4096])
@pytest.mark.parametrize("split_rows", [1_000_000, 2])
def test_packed_inputs_equal_segment_inputs(spark, block, split_rows):
    """Prompt tokens, tokens never revealed, repeated ones and a batch without segments."""
    rows = [(b, s, p, 10 * s + p, (p * 5 + s) % 7 - 1) for b, s in ((0, 0), (0, 1), (1, 2)) for p in range(9)]
    rows += [(0, 0, 9, 5, None), (0, 0, 3, 3, 2), (2, 3, 0, 1, 0), (2, 3, 1, 1, -1), (None, 4, 0, None, 3), (1, 2, 9, 7, 99)]
    traj = spark.createDataFrame(rows, "batch_id long, seq_id long, pos long, token_id long, unmask_step long")
    expected = segments.segment_inputs(segments.assign_segment(traj, 6, 3), 6, 3, 0)
    packed = segments.pack_tokens(traj, block=block)
    assert packed.selectExpr("max(size(positions))").first()[0] <= block + 1  # One position is there twice.
    got = segments.unpack_inputs(segments.packed_inputs(packed, 6, 3, 0, split_rows=split_rows))
    assert got.columns == expected.columns

    def ordered(df):
        return sorted(df.collect(), key=str)

    assert ordered(got) == ordered(expected) and got.count() > 40
    assert segments.packed_inputs(packed.limit(0), 6, 3, 0).collect() == []


def batches(spark):
    """Batch 0 has candidates 0..3, batch 1 only segment 2, batch 2 none."""
    rows = [(0, s, p, 1, p * 4 + 1) for s in range(3) for p in range(4)]
    rows += [(1, 10, 0, 1, 9), (1, 10, 1, 1, 0)] + [(2, 20, 0, 1, 0), (2, 20, 1, 1, -1)]
    frame = spark.createDataFrame(rows, "batch_id long, seq_id long, pos long, token_id long, unmask_step long")
    return segments.assign_segment(frame, 16, 4).withColumn("is_valid", F.lit(True))


def test_sampling_rules(spark):
    drawn = segments.sample_segments(batches(spark), 2, 4, 3, F.col("batch_id")).collect()
    got = {(r.batch_id, r.iter): r.segments for r in drawn}
    assert len(got) == 9
    for i in range(3):
        assert len(got[0, i]) == 2 and got[0, i] == sorted(got[0, i])
        assert got[1, i] == [2]
        assert len(got[2, i]) == 2
    again = segments.sample_segments(batches(spark).repartition(7), 2, 4, 3, F.col("batch_id")).collect()
    assert {(r.batch_id, r.iter): r.segments for r in again} == got
    with pytest.raises(ValueError):
        segments.sample_segments(batches(spark), 5, 4, 3)


@pytest.mark.parametrize("split_rows", [1_000_000, 2])
def test_sample_mask_and_coverage(spark, split_rows):
    table = batches(spark)
    drawn = segments.sample_segments(table, 2, 4, 3, F.col("batch_id"))
    chosen = {(r.batch_id, r.iter): set(r.segments) for r in drawn.collect()}
    masked = segments.sample_mask(table, drawn, split_rows=split_rows)
    rows = masked.collect()
    assert len(rows) == table.count() * 3
    assert all(r.is_sampled == (r.segment in chosen[r.batch_id, r.iter]) for r in rows)
    cover = {(r.batch_id, r.iter): r for r in segments.sample_coverage(masked).collect()}
    assert cover[0, 0].token_coverage == 0.5 and cover[1, 0].sampled_tokens_ratio == 0.5


def test_recipe_sized_segments_are_uniform(spark):
    """Each of 32 segments is drawn about equally often when 12 are drawn."""
    rows = spark.range(400 * 32).select(
        F.floor(F.col("id") / 32).alias("batch_id"), F.col("id").alias("seq_id"), F.lit(0).alias("pos"),
        ((F.col("id") % 32) * 4 + 1).alias("unmask_step"), F.lit(True).alias("is_valid"),
    )
    drawn = segments.sample_segments(segments.assign_segment(rows, 128, 32), 12, 32, 2, F.col("batch_id"))
    counts = [r["count"] for r in segments.sampled_segments(drawn).groupBy("segment").count().collect()]
    assert len(counts) == 32 and sum(counts) == 800 * 12
    assert min(counts) > 200 and max(counts) < 400


def test_packed_arrays(spark):
    row = spark.createDataFrame([([1, 2, 3, 4, 5],), ([],)], "ids array<int>")
    def of(c):
        return [r.x for r in row.select(c.alias("x")).collect()]

    ids = F.col("ids")
    assert of(tokens.truncate_left(ids, 2)) == [[4, 5], []]
    assert of(tokens.truncate_left(ids, 9)) == [[1, 2, 3, 4, 5], []]
    assert of(tokens.truncate_left(ids, None)) == [[1, 2, 3, 4, 5], []]
    assert of(tokens.pad_left(ids, 0, F.lit(6))) == [[0, 1, 2, 3, 4, 5], [0] * 6]
    assert of(tokens.attention_mask(ids, F.lit(6))) == [[0, 1, 1, 1, 1, 1], [0] * 6]
    assert of(tokens.split_prompt(ids, 2)) == [[1, 2], []]
    assert of(tokens.split_completion(ids, 2)) == [[3, 4, 5], []]


@pytest.mark.parametrize("split_rows", [1_000_000, 1])
def test_pad_batches(spark, split_rows):
    frame = spark.createDataFrame([(0, [1]), (0, [1, 2, 3]), (1, [7])], "batch int, ids array<int>")
    rows = prompts.pad_batches(frame, "ids", "batch", 0, split_rows).collect()
    assert sorted((r.batch, r.ids, r.attention_mask) for r in rows) == [
        (0, [0, 0, 1], [0, 0, 1]), (0, [1, 2, 3], [1, 1, 1]), (1, [7], [1]),
    ]


def test_prompt_mask_rate_and_repeatability(spark):
    frame = spark.range(20000).withColumn("is_prompt", F.col("id") % 2 == 0)
    masked = frame.withColumn("x", tokens.random_prompt_mask(F.col("id"), F.col("is_prompt"), 5, [F.col("id")], 0.15, -9))
    rows = masked.collect()
    assert all(r.x == -9 for r in rows if not r.is_prompt)
    share = sum(r.x == -9 for r in rows if r.is_prompt) / 10000
    assert 0.13 < share < 0.17
    again = frame.repartition(13).withColumn(
        "x", tokens.random_prompt_mask(F.col("id"), F.col("is_prompt"), 5, [F.col("id")], 0.15, -9)
    )
    assert masked.exceptAll(again).count() == 0


def test_quota(spark):
    frame = spark.createDataFrame([(n,) for n in range(0, 40)], "n_masked int")
    rows = trace.transfer_quota(frame, 6).collect()
    for n in range(40):
        wanted = [n // 6 + (i < n % 6) for i in range(6)]
        assert [r.quota for r in sorted((r for r in rows if r.n_masked == n), key=lambda r: r.step)] == wanted


def test_audit(spark):
    def audit(steps):
        frame = spark.createDataFrame([(0, p, s) for p, s in enumerate(steps)], "seq_id int, pos int, unmask_step int")
        return sorted((r.block, r.step, r.expected, r.actual, r.problem) for r in trace.audit_schedule(frame, 4, 2).collect())

    assert audit([0, 0, 1, 1, 3, 2, 3, 2]) == []
    assert audit([0, 0, 0, 1, 2, 2, 3, 3]) == [(0, 0, 2, 3, "wrong_count"), (0, 1, 2, 1, "wrong_count")]
    assert audit([0, 0, 1, -1, 2, 2, 3, 3]) == [(0, -1, 0, 1, "never_revealed"), (0, 1, 2, 1, "wrong_count")]
    assert audit([0, 0, 1, 2, 2, 2, 3, 3]) == [(0, 1, 2, 1, "wrong_count"), (0, 2, 0, 1, "outside_block")]


def test_audit_trace_job(spark):
    """Schedule and selection are checked together."""
    traj = spark.createDataFrame([(0, p, s) for p, s in enumerate([0, 0, 1, 1])], "seq_id int, pos int, unmask_step int")
    scores = spark.createDataFrame(
        [(0, 0, p, c, True, 4, 2) for p, c in enumerate([0.9, 0.1, 0.8, 0.2])],
        "seq_id int, step int, pos int, confidence double, is_masked boolean, block_end int, k int",
    )
    recipe = Recipe(max_completion_length=4, block_length=4, diffusion_steps=2)
    assert jobs.audit_trace(traj, recipe).count() == 0
    found = sorted((r.step, r.pos, r.problem) for r in jobs.audit_trace(traj, recipe, scores).collect())
    assert found == [(0, 1, "not_selected"), (0, 2, "not_revealed")]


def test_segment_and_lineage_jobs(spark):
    recipe = Recipe(max_completion_length=4, block_length=2, diffusion_steps=4, use_stepmerge=True, num_stepmerge_blocks=2,
                    stepmerge_sample_k_blocks=1, num_iterations=3, gradient_accumulation_steps=4)
    table = jobs.segment_trajectories(toy(spark), recipe, eos_id=99)
    assert table.count() == 24 and {"is_valid", "segment", "is_sampled", "iter"} <= set(table.columns)
    runs = spark.createDataFrame([(0, 0, 5)], "run int, first_step long, last_step long")
    assert jobs.rollout_lineage(step_grid(runs, 4), recipe).where("is_refreshed").count() == 8
    questions = spark.createDataFrame([(i, f"q{i}", "#### 3") for i in range(5)], "example_index long, question string, answer string")
    template = {"before": "<", "between": ">", "after": "", "header": "|"}
    rows = {r.example_index: r for r in jobs.build_eval_prompts(questions, "gsm8k", template, 2, 2, True).collect()}
    assert rows[4]["rank"] == 0 and rows[4].batch == 1 and rows[4].ground_truth == "3.0"
    assert rows[1].prompt_input.startswith("<user>q1\n\n") and rows[1].prompt_input.endswith("|<reasoning>")


@pytest.mark.parametrize("split_rows", [1_000_000, 3])
def test_rollout_schedule(spark, split_rows):
    """Starts 0, 96 and 100 with four slots and twelve iterations: refilled on schedule and after a resume."""
    runs = spark.createDataFrame([(s, s, (s // 12 + 1) * 12) for s in (0, 96, 100)], "run int, first_step long, last_step long")
    log = step_grid(runs, 4).select("run", "step", "slot")
    rows = rollout_schedule(log, 4, 12, split_rows=split_rows).collect()
    for start in (0, 96, 100):
        mine = [r for r in rows if r.run == start]
        assert sum(r.is_refreshed for r in mine) == 8
        held = {}
        for r in sorted(mine, key=lambda r: (r.step, r.slot)):
            if r.step == start or r.step % 12 == 0:
                held[r.slot] = r.step
            assert r.rollout_step == held[r.slot]
            assert r.is_refreshed == (held[r.slot] == r.step)
            assert r.counter == r.step * 4 + r.slot + 1 and r.iteration == r.counter % 12
    assert {r.iteration for r in rows if r.slot == 0} == {1, 5, 9}


def test_mask_seeds(spark):
    steps = spark.range(200).withColumnRenamed("id", "step")
    drawn = [r.mask_seed for r in mask_seeds(steps, 3, True, 1).collect()]
    assert len(drawn) == 600 and min(drawn) >= 0 and max(drawn) < 4096 and len(set(drawn)) > 400
    assert {r.mask_seed for r in mask_seeds(steps, 3, False).collect()} == {42}


def test_shards_cover_exactly(spark):
    for size in range(12):
        frame = spark.range(size).withColumnRenamed("id", "example_index")
        for workers in (1, 2, 3, 7):
            got = [r.example_index for rank in range(workers) for r in prompts.shard(frame, rank, workers).collect()]
            assert sorted(got) == list(range(size))
    for rank, world in ((0, 0), (3, 3), (-1, 2)):
        with pytest.raises(ValueError):
            prompts.shard(spark.range(1).withColumnRenamed("id", "example_index"), rank, world)


def test_shuffle_is_a_seeded_permutation(spark):
    frame = spark.range(500).withColumnRenamed("id", "example_index")
    order = [r.example_index for r in prompts.shuffle(frame, 3).collect()]
    assert sorted(order) == list(range(500)) and order != list(range(500))
    assert [r.example_index for r in prompts.shuffle(frame.repartition(9), 3).collect()] == order
    assert [r.example_index for r in prompts.shuffle(frame, 4).collect()] != order
    placed = sorted((r.position, r.example_index) for r in prompts.shuffled_positions(frame, 3).collect())
    assert [i for _, i in placed] == order and [p for p, _ in placed] == list(range(500))
