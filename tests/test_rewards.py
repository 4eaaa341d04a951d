from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rollscore.functions.rewards import REWARDS, TASK_REWARDS, boxed_format, python_reward
from rollscore.operators import advantages, rewards
from rollscore.plans import jobs


def reward(spark, name, completion, answer=None, **options):
    row = spark.createDataFrame([(completion, answer)], "completion string, answer string")
    cols = {"completion": F.col("completion"), "answer": F.col("answer")}
    return row.select(REWARDS[name](cols, **options).alias("r")).first().r


STRICT = "<reasoning>\nw\n</reasoning>\n<answer>\n4\n</answer>\n"


@pytest.mark.parametrize(
    ("name", "completion", "answer", "wanted"),
    [
        ("correct_answer", "<answer>42</answer>", "42", 2.0),
        ("correct_answer", "<answer>7</answer>", "8", 0.0),
        ("correct_answer", "<answer>1,000</answer>", "1000", 0.0),
        ("correct_answer", "<answer>1</answer>", None, 0.0),
        ("integer_answer", "<answer>42</answer>", None, 0.5),
        ("integer_answer", "<answer>-3</answer>", None, 0.0),
        ("integer_answer", "<answer>3.0</answer>", None, 0.0),
        ("integer_answer", "<answer></answer>", None, 0.0),
        ("integer_answer", "<answer>\u0663\u00b2\u2460</answer>", None, 0.5),
        ("integer_answer", "<answer>\u00bd</answer>", None, 0.0),
        ("strict_format", STRICT, None, 0.5),
        ("strict_format", STRICT + "\n", None, 0.5),
        ("strict_format", STRICT + "\n\n", None, 0.0),
        ("strict_format", STRICT[:-1], None, 0.0),
        ("strict_format", STRICT.replace("\nw\n", "\nw\rw\n"), None, 0.5),
        ("strict_format", STRICT.replace("\nw\n", "\nw\nw\n"), None, 0.0),
        ("strict_format", "x" + STRICT, None, 0.0),
        ("soft_format", "<reasoning>w</reasoning>\u00a0\n<answer>4</answer> tail", None, 0.5),
        ("soft_format", STRICT, None, 0.0),
        ("soft_format", " <reasoning>w</reasoning><answer>4</answer>", None, 0.0),
        ("tag_count", STRICT, None, 0.5),
        ("tag_count", STRICT[:-1], None, 0.125 * 4 - 0.001 * len(STRICT[:-1]) + 0.001),
        ("tag_count", "", None, 0.0),
        ("tag_count", "\n</answer>", None, 0.126),
        ("tag_count", "\n<answer>\n", None, 0.125 - 0.010),
        ("tag_count", "\n</answer>\n</answer>\n\n<answer>\n1", None, 0.125 - 0.001 * len("</answer>\n\n<answer>\n1")),
        ("correct_math", r"<answer>\boxed{\frac{1}{2}}</answer>", r"\boxed{0.5}", 2.0),
        ("correct_math", r"\boxed{1", r"\boxed{1}", 0.0),
        ("correct_math", "5", "so 5", 0.0),
        ("correct_math", "5", "5", 2.0),
        ("correct_math", r"\boxed{5}", r"\boxed{5", None),
        ("boxed_format", r"<answer>\boxed{5}</answer>", None, 0.75),
        ("boxed_format", r"\boxed{5}", None, 0.25),
        ("boxed_format", "<answer>\boxed</answer>", None, 1.0),
        ("boxed_format", "<answer>1<answer>\boxed</answer>", None, 0.75),
        ("boxed_format", "\boxed", None, 0.5),
    ],
)
def test_reward_values(spark, name, completion, answer, wanted):
    got = reward(spark, name, completion, answer)
    assert got == wanted if wanted is None else got == pytest.approx(wanted, abs=1e-9)


def test_boxed_format_without_compat(spark):
    assert reward(spark, "boxed_format", r"<answer>\boxed{5}</answer>", compat=False) == 1.0
    row = spark.createDataFrame([(r"\boxed{5}",)], "completion string")
    assert row.select(boxed_format({"completion": F.col("completion")}, compat=False).alias("r")).first().r == 0.5


def completions(spark):
    return spark.createDataFrame(
        [(0, g, s, f"<answer>{s}</answer>", str(g)) for g in range(3) for s in range(4)],
        "step int, group_id int, sample_id int, completion string, answer string",
    )


def test_reward_table_is_long_and_keeps_null(spark):
    funcs = {
        "half": lambda cols: F.when(F.col("sample_id") > 1, F.lit(0.5)),
        "broken": lambda cols: F.lit(float("nan")),
    }
    rows = rewards.reward_table(completions(spark), funcs)
    assert rows.columns == ["step", "group_id", "sample_id", "func", "reward"]
    got = {(r.group_id, r.sample_id, r.func): r.reward for r in rows.collect()}
    assert len(got) == 24
    assert got[0, 0, "half"] is None and got[0, 2, "half"] == 0.5 and got[0, 2, "broken"] is None
    assert rewards.all_null_rewards(rows).count() == 6
    totals = {(r.group_id, r.sample_id): r.reward for r in rewards.total_reward(rows, {"half": 2.0}).collect()}
    assert totals[0, 0] == 0.0 and totals[0, 3] == 1.0


def test_task_sets_and_unknown_names(spark):
    for names in TASK_REWARDS.values():
        assert rewards.reward_table(completions(spark), names).count() == 12 * len(names)
    with pytest.raises(ValueError, match="Unknown reward"):
        rewards.reward_table(completions(spark), ["nothing"])


def test_python_reward_may_return_none(spark):
    def scorer(texts, golds):
        return [None if g == "0" else float(len(t)) for t, g in zip(texts, golds)]

    table = rewards.reward_table(completions(spark), {"user": python_reward(scorer, ["completion", "answer"])})
    got = {(r.group_id, r.sample_id): r.reward for r in table.collect()}
    assert got[0, 1] is None and got[1, 1] == 18.0


def test_model_rewards_join_the_long_table(spark):
    """A user's model scores batches in Python; rows it cannot score get NULL."""
    def score(batches):
        for batch in batches:
            yield batch.assign(reward=[None if s == 0 else s / 2 for s in batch.sample_id])[["step", "group_id", "sample_id", "reward"]]

    scored = rewards.model_rewards(completions(spark), "model", score)
    both = rewards.reward_table(completions(spark), ["integer_answer"]).unionByName(scored)
    got = {(r.group_id, r.sample_id): r.reward for r in both.where("func = 'model'").collect()}
    assert both.count() == 24 and got[1, 0] is None and got[1, 3] == 1.5


def test_advantage_and_rollout_metric_jobs(spark):
    rows = rewards.reward_table(completions(spark), TASK_REWARDS["gsm8k"])
    per_sample, metrics = jobs.advantages(rows)
    assert per_sample.count() == 12 and metrics.first().n_samples == 12
    traj = spark.createDataFrame([(0, 1, True), (0, 1, False), (0, 2, True)], "step int, seq_id int, is_valid boolean")
    got = {r.name: r.value for r in jobs.rollout_metrics(rows, traj).collect()}
    assert got["completion_length"] == 1.0 and got["rewards/integer_answer"] == 0.5
    assert {"reward", "reward_std", "zero_std_ratio", "rewards/correct_answer"} <= set(got)


def test_gold_is_repeated_per_group(spark):
    gold = spark.createDataFrame([(0, "g0"), (1, "g1")], "group_id int, gold string")
    for split in (1_000_000, 2):
        rows = rewards.attach_gold(completions(spark), gold, split_rows=split).collect()
        assert len(rows) == 12
        assert all(r.gold == (f"g{r.group_id}" if r.group_id < 2 else None) for r in rows)


def test_double_gold_is_refused(spark):
    gold = spark.createDataFrame([(0, "g0"), (1, "g1"), (1, "other"), (7, "x"), (7, "x")], "group_id int, gold string")
    assert [tuple(r) for r in rewards.double_gold(gold).orderBy("group_id").collect()] == [(1, 2), (7, 2)]
    with pytest.raises(Exception, match="Several gold rows for group_id 1"):
        rewards.attach_gold(completions(spark), gold).collect()
    # Prompts without completions may have any gold.
    assert rewards.attach_gold(completions(spark), gold.where("group_id <> 1")).count() == 12


def totals_frame(spark):
    return spark.createDataFrame(
        [(0, g, s, float((g * 7 + s * 3) % 5)) for g in range(5) for s in range(4)] + [(1, 9, s, 1.5) for s in range(4)],
        "step int, group_id int, sample_id int, reward double",
    )


@pytest.mark.parametrize("split_rows", [1_000_000, 2])
def test_advantage_invariants(spark, split_rows):
    """RLOO and GRPO sum to 0 per group, and differ by G/(G-1), with and without hot groups."""
    totals = totals_frame(spark)
    rloo = {(r.group_id, r.sample_id): r for r in advantages.advantages(totals, "rloo", split_rows=split_rows).collect()}
    grpo = {(r.group_id, r.sample_id): r for r in advantages.advantages(totals, "grpo", split_rows=split_rows).collect()}
    assert len(rloo) == len(grpo) == 24
    for group in range(5):
        assert sum(rloo[group, s].advantage for s in range(4)) == pytest.approx(0)
    for key, row in grpo.items():
        assert rloo[key].advantage == pytest.approx(row.advantage * 4 / 3)
        assert row.group_size == 4
    none = advantages.advantages(totals, "none").collect()
    assert all(r.advantage == r.reward for r in none)
    with pytest.raises(ValueError, match="estimator"):
        advantages.advantages(totals, "ppo")


def test_reward_and_advantage_stats(spark):
    stats = {r.step: r for r in advantages.reward_stats(totals_frame(spark)).collect()}
    assert stats[1].reward_mean == 1.5 and stats[1].reward_std == 0.0 and stats[1].zero_std_ratio == 1.0
    assert stats[0].zero_std_ratio == 0.0 and stats[0].n_samples == 20
    single = spark.createDataFrame([(0, 1.0)], "step int, advantage double")
    row = advantages.advantage_stats(single).first()
    assert row.advantage_mean == 1.0 and row.advantage_std == 0.0
