"""Long reward table and its per-sample totals."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollscore.functions.rewards import Reward, resolve
from rollscore.plans.skew import SPLIT_ROWS, attach, with_counts

SAMPLE_KEYS = ("step", "group_id", "sample_id")
GROUP_KEYS = ("step", "group_id")


def attach_gold(
    completions: DataFrame, gold: DataFrame, key: str = "group_id", split_rows: int = SPLIT_ROWS
) -> DataFrame:
    """Repeat each prompt's gold columns on its completions.

    Every completion stays, once. One whose prompt has no gold has NULLs, which no reward takes for a
    match; ``without_gold`` counts them. A prompt that has completions and several gold rows is an
    error: either could be meant. ``double_gold`` lists such prompts.
    """
    values = [c for c in gold.columns if c != key]
    several = F.concat(F.lit(f"Several gold rows for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("NULL")))
    alone = [
        F.when(F.count(F.lit(1)) == 1, F.first(c)).otherwise(F.raise_error(several).cast(gold.schema[c].dataType)).alias(c)
        for c in values
    ]
    stats = with_counts(gold.groupBy(key).agg(*alone), completions, [key])
    return attach(completions, stats, [key], split_rows).drop("n_rows")


def without_gold(completions: DataFrame, gold: DataFrame, key: str = "group_id") -> DataFrame:
    """Prompts that have completions and no gold, with the number of completions."""
    counts = completions.groupBy(key).agg(F.count(F.lit(1)).alias("n_completions"))
    return counts.join(gold.select(key), key, "left_anti")


def double_gold(gold: DataFrame, key: str = "group_id") -> DataFrame:
    """Prompts with more than one gold row, and how many they have."""
    return gold.groupBy(key).agg(F.count(F.lit(1)).alias("n_gold")).where(F.col("n_gold") > 1)


def reward_table(
    completions: DataFrame, funcs: Sequence[str] | dict[str, Reward], keys: Sequence[str] = SAMPLE_KEYS
) -> DataFrame:
    """one row per sample and reward function. NULL where a function does not apply.

    All functions are computed in one pass and unpivoted in place: no shuffle.
    """
    rewards = resolve(list(funcs) if not isinstance(funcs, dict) else funcs)
    cols = {name: F.col(name) for name in completions.columns}
    wide = completions.select(
        *keys, *[_clean(reward(cols)).alias(name) for name, reward in rewards.items()]
    )
    return wide.unpivot(list(keys), list(rewards), "func", "reward")


def model_rewards(
    completions: DataFrame, func: str, score: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
    keys: Sequence[str] = SAMPLE_KEYS,
) -> DataFrame:
    """long rewards of a user's model, to be united with ``reward_table``'s.

    ``score`` gets Arrow-sized batches of a task's rows, so that it can load its model once per
    task, and yields the key columns with ``reward``.
    """
    types = dict(completions.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "reward double"])
    scored = completions.mapInPandas(score, schema)
    return scored.select(*keys, F.lit(func).alias("func"), _clean(F.col("reward")).alias("reward"))


def _clean(reward: Column) -> Column:
    """NaN and NULL both mean that the function does not apply."""
    as_double = reward.cast("double")
    return F.when(~F.isnan(as_double), as_double)


def weight_of(weights: dict[str, float]) -> Column:
    """The weight of a row's function; functions without a weight count once."""
    if not weights:
        return F.lit(1.0)
    pairs = F.create_map(*[F.lit(x) for name, w in weights.items() for x in (name, float(w))])
    return F.coalesce(F.try_element_at(pairs, F.col("func")), F.lit(1.0))


def total_reward(
    rewards: DataFrame, weights: dict[str, float] | None = None, keys: Sequence[str] = SAMPLE_KEYS
) -> DataFrame:
    """A1: weighted sum per sample, skipping NULL; 0 where every function is NULL."""
    weighted = weight_of(weights or {}) * F.col("reward")
    return rewards.groupBy(*keys).agg(F.coalesce(F.sum(weighted), F.lit(0.0)).alias("reward"))


def all_null_rewards(rewards: DataFrame, keys: Sequence[str] = SAMPLE_KEYS) -> DataFrame:
    """A2: samples for which no function gave a reward."""
    counted = rewards.groupBy(*keys).agg(F.count("reward").alias("n_given"), F.count(F.lit(1)).alias("n_funcs"))
    return counted.where(F.col("n_given") == 0).select(*keys, "n_funcs")


def mean_reward_per_func(rewards: DataFrame, by: Sequence[str] = ("step",)) -> DataFrame:
    """A3: mean over the samples a function applied to."""
    return rewards.groupBy(*by, "func").agg(
        F.avg("reward").alias("mean_reward"), F.count("reward").alias("n_scored")
    )
