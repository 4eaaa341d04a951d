"""An append-only store of model rewards: each distinct text is scored once.

A store is a folder with one subfolder per reward function, of rows ``text_key, reward``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollscore.operators.rewards import model_rewards
from rollscore.plans.skew import ROW_COUNT, SPLIT_ROWS, attach

KEY = "text_key"
SCHEMA = f"{KEY} binary, reward double"


def text_key(columns: Sequence[str]) -> Column:
    """SHA-256 over the columns a reward depends on. NULL and an empty text differ."""
    values = F.to_json(F.struct(*[F.col(c) for c in columns]), {"ignoreNullFields": "false"})
    return F.unhex(F.sha2(values, 256))


def stored_rewards(spark: SparkSession, path: str, func: str) -> DataFrame:
    """One row per text scored so far. If two jobs scored a text at once, the smaller reward holds."""
    folder = _folder(path, func)
    spark.createDataFrame([], SCHEMA).write.mode("ignore").parquet(folder)
    return spark.read.schema(SCHEMA).parquet(folder).groupBy(KEY).agg(F.min("reward").alias("reward"))


def score_once(
    rows: DataFrame, func: str, columns: Sequence[str],
    score: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], path: str, split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """Add ``reward`` to ``rows``; only texts that the store under ``path`` lacks are scored.

    ``score`` gets frames of ``text_key`` and ``columns``, one row per distinct text, and yields
    ``text_key`` with ``reward`` (NULL or NaN where the function does not apply; such a text counts
    as scored). New rewards are appended in one commit, so a batch that failed or is repeated finds
    what was committed and scores only the rest. Every row stays, repeated ones too. Texts travel to
    the model once each; what goes back to the rows is a key and a number, also where one text
    holds most rows.
    """
    clash = [c for c in (KEY, "reward", ROW_COUNT) if c in rows.columns]
    if clash:
        raise ValueError(f"Columns that the store adds itself: {clash}")
    spark = rows.sparkSession
    keyed = rows.withColumn(KEY, text_key(columns))
    known = stored_rewards(spark, path, func)
    texts = keyed.groupBy(KEY).agg(*[F.first(c).alias(c) for c in columns])
    new = texts.join(known, KEY, "left_anti")
    scored = model_rewards(new, func, score, [KEY]).select(KEY, "reward")
    scored.write.mode("append").parquet(_folder(path, func))
    counts = keyed.groupBy(KEY).agg(F.count(F.lit(1)).alias(ROW_COUNT))
    values = counts.join(stored_rewards(spark, path, func), KEY, "left")
    return attach(keyed, values, [KEY], split_rows).drop(KEY, ROW_COUNT)


def _folder(path: str, func: str) -> str:
    return f"{path}/{quote(func, safe='')}"
