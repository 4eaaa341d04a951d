"""Question tables to prompts, shards, shuffles and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollscore.functions.answers import extract_hash_answer, extract_hash_number
from rollscore.functions.prompts import REASONING_START, apply_chat_template, eval_prompt, train_prompt
from rollscore.functions.sampling import digest
from rollscore.functions.tokens import attention_mask, pad_left
from rollscore.plans.skew import SPLIT_ROWS, attach_aggregates

RANGE_DIGITS, GROUP_DIGITS = 5, 2


def train_prompts(questions: DataFrame, kind: str) -> DataFrame:
    """Questions with ``prompt`` messages and the gold ``answer``."""
    if kind == "gsm8k":
        return questions.select(
            "example_index",
            train_prompt(kind, F.col("question")).alias("prompt"),
            extract_hash_answer(F.col("answer")).alias("answer"),
        )
    return questions.select(
        "example_index",
        train_prompt(kind, F.col("problem")).alias("prompt"),
        F.col("solution").alias("answer"),
    )


def eval_prompts(questions: DataFrame, kind: str, template: dict[str, str], add_reasoning: bool = False) -> DataFrame:
    """Rendered evaluation prompts with the gold answer as text and as number."""
    question = F.col("question" if kind == "gsm8k" else "problem")
    text = apply_chat_template(eval_prompt(kind, question), **template)
    if add_reasoning:
        text = F.concat(text, F.lit(REASONING_START))
    gold = extract_hash_number(F.col("answer")).cast("string") if kind == "gsm8k" else F.col("answer")
    return questions.select(
        "example_index", question.alias("question"), text.alias("prompt_input"), gold.alias("ground_truth")
    )


def pad_batches(
    prompts: DataFrame, ids: str, batch: str, pad: int, split_rows: int = SPLIT_ROWS
) -> DataFrame:
    """Pad each batch on the left to its longest member, with the attention mask."""
    wide = attach_aggregates(prompts, [batch], split_rows, _width=F.max(F.size(ids)))
    return wide.withColumns(
        {
            "attention_mask": attention_mask(F.col(ids), F.col("_width")),
            ids: pad_left(F.col(ids), pad, F.col("_width")),
        }
    ).drop("_width")


def check_shard(rank: int, world_size: int) -> None:
    if world_size < 1 or not 0 <= rank < world_size:
        raise ValueError(f"Invalid rank {rank} of {world_size}")


def shard(df: DataFrame, rank: int, world_size: int, index: str = "example_index") -> DataFrame:
    """The rows of one worker; every row belongs to exactly one."""
    check_shard(rank, world_size)
    return df.where(shard_of(F.col(index), world_size) == rank)


def shard_of(index: Column, world_size: int) -> Column:
    return F.pmod(index, F.lit(world_size))


def batch_of(index: Column, size: int, world_size: int = 1) -> Column:
    """Number of the consecutive fixed-size batch, within the index's shard."""
    if size < 1:
        raise ValueError(f"Batch size must be positive, not {size}")
    return F.floor(F.floor(index / F.lit(world_size)) / F.lit(size)).cast("bigint")


def shuffle(df: DataFrame, seed: int, index: str = "example_index") -> DataFrame:
    """Seeded permutation; the order depends on seed and index only."""
    return df.orderBy(digest(seed, F.col(index)), F.col(index))


def shuffled_positions(df: DataFrame, seed: int, index: str = "example_index") -> DataFrame:
    """0-based ``position`` of each row in the seeded permutation, without a global sort.

    The digests are uniform, so their first five hex digits cut the rows into a million even
    ranges. Rows are numbered within their range. The ranges' offsets come from at most a million
    counts - a fixed bound, whatever the data - summed within their first two digits, then over
    those 256 groups.
    """
    keyed = df.withColumn("_digest", digest(seed, F.col(index))).withColumn(
        "_range", F.substring("_digest", 1, RANGE_DIGITS)
    )
    counts = keyed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_group", F.substring("_range", 1, GROUP_DIGITS))
    in_group = Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    up_to = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = counts.groupBy("_group").agg(F.sum("_n").alias("_size"))
    groups = groups.select("_group", F.coalesce(F.sum("_size").over(up_to), F.lit(0)).alias("_start"))
    offsets = counts.join(F.broadcast(groups), "_group").select(
        "_range", (F.col("_start") + F.coalesce(F.sum("_n").over(in_group), F.lit(0))).alias("_before")
    )
    within = Window.partitionBy("_range").orderBy("_digest", index)
    return (
        keyed.join(F.broadcast(offsets), "_range")
        .withColumn("position", F.col("_before") + F.row_number().over(within) - 1)
        .drop("_digest", "_range", "_before")
    )
