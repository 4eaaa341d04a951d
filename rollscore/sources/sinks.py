"""Result writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCORE_COLUMNS = ("dataset", "correct", "total", "accuracy")


def write_scores(scores: DataFrame, path: str, by: Sequence[str] = ("run",)) -> None:
    """One row per run."""
    scores.select(*by, *SCORE_COLUMNS).write.mode("errorifexists").json(path)


def write_items(scored: DataFrame, path: str) -> None:
    """K5: scored items in the order of their index."""
    scored.orderBy("run", "example_index").write.mode("errorifexists").parquet(path)


def completion_log(rows: DataFrame, every: int) -> DataFrame:
    """Prompts, completions and rewards of the steps to be logged."""
    if every < 1:
        raise ValueError(f"Logging interval must be positive, not {every}")
    return rows.where(F.col("step") % every == 0).select("step", "prompt", "completion", "reward")


def _batch_folder(path: str, batch: int) -> str:
    return f"{path}/batch={int(batch)}"


def write_completion_log(rows: DataFrame, path: str, every: int, batch: int | None = None) -> None:
    """With ``batch`` the rows replace what that batch has written before, and nothing else.

    Without it they are appended. A log is written one way or the other: with batches it has the
    further column ``batch``.
    """
    # A step's rows come together before they are written, in as many files as their size asks for.
    writer = completion_log(rows, every).hint("rebalance", "step").write.partitionBy("step")
    if batch is None:
        writer.mode("append").parquet(path)
    else:
        writer.mode("overwrite").parquet(_batch_folder(path, batch))


def metric_log(metrics: DataFrame, by: Sequence[str] = ("step",), prefix: str = "") -> DataFrame:
    """One row per numeric metric. Other columns are no metrics; NULL values are not logged."""
    numeric = [
        f.name for f in metrics.schema.fields if f.name not in by and isinstance(f.dataType, T.NumericType)
    ]
    doubles = metrics.select(*by, *[F.col(f"`{c}`").cast("double").alias(prefix + c) for c in numeric])
    long = doubles.unpivot(list(by), [F.col(f"`{prefix}{c}`") for c in numeric], "name", "value")
    return long.where(F.col("value").isNotNull())


def write_token_table(
    df: DataFrame, table: str, buckets: int, keys: Sequence[str] = ("batch_id", "seq_id", "pos")
) -> None:
    """Store per-token values bucketed by token, so that joining several such tables shuffles nothing.

    Token keys are unique, so the buckets are even whatever the sequences' lengths.
    """
    df.write.mode("errorifexists").bucketBy(buckets, *keys).sortBy(*keys).format("parquet").saveAsTable(table)


def write_metrics(
    metrics: DataFrame, path: str, by: Sequence[str] = ("step",), prefix: str = "", batch: int | None = None
) -> None:
    """With ``batch`` the rows replace what that batch has written before, else they are appended."""
    log = metric_log(metrics, by, prefix)
    if batch is None:
        log.write.mode("append").parquet(path)
    else:
        log.write.mode("overwrite").parquet(_batch_folder(path, batch))
