"""Evaluation runs: completeness, scores and summaries.

``ranks`` has one row per worker file: ``run, dataset, rank, world_size, dataset_size, config``
and its metrics. ``generations`` has one row per saved example: ``run, rank, example_index,
question, generations, ground_truth``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollscore.functions.answers import extract_gsm_prediction, extract_math_prediction
from rollscore.functions.mathnorm import is_close, is_equiv
from rollscore.functions.ranges import each_below
from rollscore.functions.text import to_float

DATASETS = ("gsm8k", "math")
RUN = ("run",)


def _correct_number(prediction: Column, gold: Column) -> Column:
    """Equal as doubles. NaN and a missing gold equal nothing."""
    return F.coalesce((prediction == gold) & ~F.isnan(prediction), F.lit(False))


def score_generations(generations: DataFrame, dataset: str) -> DataFrame:
    """Add ``extracted_answer`` and ``is_correct``; every row stays."""
    text, gold = F.col("generations"), F.col("ground_truth")
    if dataset == "gsm8k":
        scored = generations.withColumn("extracted_answer", extract_gsm_prediction(text))
        number = gold.cast("double") if dict(generations.dtypes)["ground_truth"] != "string" else to_float(gold)
        return scored.withColumn("is_correct", _correct_number(F.col("extracted_answer"), number))
    if dataset == "math":
        scored = generations.withColumn("extracted_answer", extract_math_prediction(text))
        answer = F.col("extracted_answer")
        # A gold column of numbers is compared as numbers, one of texts by their normal form.
        same = is_equiv if dict(generations.dtypes)["ground_truth"] == "string" else is_close
        return scored.withColumn("is_correct", answer.isNotNull() & same(answer, gold))
    raise ValueError(f"Unknown dataset: {dataset}")


def accuracy(scored: DataFrame, by: Sequence[str] = RUN) -> DataFrame:
    """A10: correct, total and their ratio; unparsed answers count as wrong."""
    correct = F.sum(F.col("is_correct").cast("bigint"))
    total = F.count(F.lit(1))
    return scored.groupBy(*by).agg(
        correct.alias("correct"), total.alias("total"), (correct / total).alias("accuracy")
    )


def missing_ranks(ranks: DataFrame, by: Sequence[str] = RUN) -> DataFrame:
    """Ranks that a run should have and has not."""
    sizes = ranks.groupBy(*by).agg(F.max("world_size").alias("world_size"))
    expected = sizes.where(F.col("world_size") > 0).select(
        *by, each_below(F.col("world_size")).alias("rank")
    )
    seen = ranks.select(*by, F.col("rank").cast("bigint").alias("rank"))
    return expected.join(seen, [*by, "rank"], "left_anti")


def duplicate_examples(generations: DataFrame, by: Sequence[str] = RUN) -> DataFrame:
    """Example indices that occur more than once in a run."""
    counted = generations.groupBy(*by, "example_index").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") > 1)


def _mixed(*names: str) -> Column:
    """Whether any of the columns takes several values; needs no distinct aggregate."""
    differs = F.lit(False)
    for name in names:
        value = F.coalesce(F.col(name).cast("string"), F.lit(""))
        differs = differs | (F.min(value) != F.max(value))
    return differs


def validate_runs(
    ranks: DataFrame, generations: DataFrame, dataset: str | None = None, by: Sequence[str] = RUN
) -> DataFrame:
    """One row per run with what was found and the first ``problem``, or NULL.

    Scored generations (with ``is_correct``) also give ``correct``, in the same pass.
    Ranks and examples are counted per (run, rank) and (run, example) before the run's totals,
    so a run of any size is spread over all tasks. Indices are exactly ``0..size-1`` iff rows,
    distinct indices and size agree and the extremes are 0 and ``size-1``.
    """
    by = list(by)
    per_rank = ranks.groupBy(*by, "rank").agg(
        F.count(F.lit(1)).alias("n"),
        _mixed("dataset", "world_size", "dataset_size", "config").alias("mixed"),
        *[F.min(c).alias(f"{c}_min") for c in ("dataset", "world_size", "dataset_size", "config")],
    )
    in_range = (F.col("rank") >= 0) & (F.col("rank") < F.col("world_size_min"))
    # A file that names no dataset is of the wrong one.
    other = F.col("dataset_min").isNull() if dataset is None else F.coalesce(F.col("dataset_min") != dataset, F.lit(True))
    files = per_rank.groupBy(*by).agg(
        F.sum("n").alias("n_files"),
        F.count(F.lit(1)).alias("n_ranks"),
        F.sum(F.when(F.coalesce(in_range, F.lit(False)), 0).otherwise(1)).alias("n_bad_ranks"),
        F.max("world_size_min").alias("world_size"),
        F.max("dataset_size_min").alias("dataset_size"),
        F.min("dataset_min").alias("dataset"),
        F.max(other).alias("is_wrong_dataset"),
        F.max(F.col("config_min").isNull()).alias("has_no_config"),
        (F.max("mixed") | _mixed("dataset_min", "world_size_min", "dataset_size_min", "config_min")).alias("is_mixed"),
    )
    scored = "is_correct" in generations.columns
    right = [F.sum(F.col("is_correct").cast("bigint")).alias("n_correct")] if scored else []
    examples = (
        generations.groupBy(*by, "example_index")
        .agg(F.count(F.lit(1)).alias("n"), *right)
        .groupBy(*by)
        .agg(
            F.sum("n").alias("n_rows"),
            F.count("example_index").alias("n_examples"),
            F.min("example_index").alias("first_index"),
            F.max("example_index").alias("last_index"),
            *[F.sum("n_correct").alias("correct")][:len(right)],
        )
    )
    joined = files.join(examples, by, "left")
    rows = F.coalesce("n_rows", F.lit(0))
    size = F.col("dataset_size")
    complete = (
        (rows == size)
        & (F.coalesce("n_examples", F.lit(0)) == size)
        & ((size == 0) | ((F.col("first_index") == 0) & (F.col("last_index") == size - 1)))
    )
    problem = (
        F.when(F.col("is_wrong_dataset"), "wrong dataset")
        .when(F.col("is_mixed"), "mixed configurations")
        .when(F.col("has_no_config"), "missing configuration")
        .when((F.col("n_files") != F.col("n_ranks")) | (F.col("n_bad_ranks") > 0), "duplicate or invalid rank")
        .when(F.col("n_ranks") != F.col("world_size"), "missing ranks")
        .when(~F.coalesce(complete, F.lit(False)), "incomplete or duplicate examples")
        .when(rows == 0, "empty dataset")
    )
    return joined.select(
        *by, "dataset", "n_files", "n_ranks", "world_size", "dataset_size",
        rows.cast("bigint").alias("n_rows"), F.coalesce("n_examples", F.lit(0)).cast("bigint").alias("n_examples"),
        *(["correct"] if scored else []), problem.alias("problem"),
    )


def run_summary(ranks: DataFrame, by: Sequence[str] = RUN) -> DataFrame:
    """Rows, longest wall time and throughput of each run."""
    longest, rows = F.max("wall_time_seconds"), F.sum("total_processed")
    return ranks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_files"),
        rows.alias("n_rows"),
        longest.alias("wall_time_seconds"),
        F.try_divide(rows, longest).alias("rows_per_second"),
    )
