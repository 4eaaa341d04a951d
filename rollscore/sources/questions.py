"""Question sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollscore.functions.answers import BOX, FRAMED_BOX, extract_hash_answer, last_boxed, remove_boxed
from rollscore.schemas import QUESTIONS
from rollscore.session import cut_lineage

PLACE_BITS = 33  # Fixed value: monotonically_increasing_id keeps the place within a partition in these bits.


def read_questions(spark: SparkSession, path: str, kind: str, fmt: str = "json") -> DataFrame:
    """Questions of one task with the given schema; no inference pass over the files."""
    if kind not in QUESTIONS:
        raise ValueError(f"Unknown dataset: {kind}")
    return spark.read.schema(QUESTIONS[kind]).format(fmt).load(path)


def checked_questions(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Every line of JSON question files, with ``reason``: NULL, or why it is rejected.

    The reasons, the first that holds: ``malformed line`` (not JSON, or a value of another type;
    ``line`` then holds it, else NULL), ``no index``, ``no question``, ``no gold``, and by task
    ``no final answer`` (no ``####``) or ``no readable box``. Nothing is dropped; blank lines are no lines.
    """
    if kind not in QUESTIONS:
        raise ValueError(f"Unknown dataset: {kind}")
    schema = T.StructType([*QUESTIONS[kind].fields, T.StructField("line", T.StringType())])
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", "line").json(path)
    question, gold = ("question", "answer") if kind == "gsm8k" else ("problem", "solution")
    reason = (
        F.when(F.col("line").isNotNull(), "malformed line")
        .when(F.col("example_index").isNull(), "no index")
        .when(F.col(question).isNull(), "no question")
        .when(F.col(gold).isNull(), "no gold")
        .when(*_unreadable(F.col(gold), kind))
    )
    return rows.withColumn("reason", reason)


def _unreadable(gold: Column, kind: str) -> tuple[Column, str]:
    if kind == "gsm8k":
        return extract_hash_answer(gold).isNull(), "no final answer"
    boxed = gold.contains(BOX) | gold.contains(FRAMED_BOX)
    return ~boxed | remove_boxed(last_boxed(gold)).isNull(), "no readable box"


def quarantine(checked: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Write ``checked_questions``' rows once and give the accepted and the rejected ones.

    Both lie under ``path`` as one partition each, so the files are read and checked once, and
    accepted and rejected rows together are the lines read.
    """
    status = F.when(F.col("reason").isNull(), "accepted").otherwise("rejected")
    checked.withColumn("status", status).write.mode("errorifexists").partitionBy("status").parquet(path)
    stored = checked.sparkSession.read.schema(
        T.StructType([*checked.schema.fields, T.StructField("status", T.StringType())])
    ).parquet(path)
    kept, refused = (stored.where(F.col("status") == s).drop("status") for s in ("accepted", "rejected"))
    return kept.drop("line", "reason"), refused


def with_dense_index(df: DataFrame, order_by: Sequence[str], name: str = "example_index") -> DataFrame:
    """Number rows 0, 1, .. in the order of unique columns, in two passes.

    The rows are range-partitioned, sorted and checkpointed once, so that both passes read the
    same partitions, also after a task is run again. A row's id then holds its partition and its
    place in it. Only one count per partition is brought together; no row is shuffled again.
    """
    keys = list(order_by)
    stored = cut_lineage(df.repartitionByRange(*keys).sortWithinPartitions(*keys))
    ranged = stored.withColumn("_id", F.monotonically_increasing_id()).withColumns(
        {"_part": F.shiftright("_id", PLACE_BITS), "_place": F.col("_id").bitwiseAND((1 << PLACE_BITS) - 1)}
    )
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        ranged.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + F.col("_place"))
        .drop("_id", "_part", "_place", "_before")
    )
