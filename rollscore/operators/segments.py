"""Decode trajectories cut into step segments.

A trajectory table has one row per completion token:
``batch_id, seq_id, pos, token_id, unmask_step``; a step of -1 means never revealed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollscore.functions.ranges import below, each_below
from rollscore.functions.sampling import digest
from rollscore.functions.tokens import is_hidden, mask_state
from rollscore.functions.text import let
from rollscore.plans.skew import ROW_COUNT, SPLIT_ROWS, attach_aggregates, attach_few

#: Positions of a packed row: bounds its size, never changes a result.
PACKED = 4096


def segment_width(steps: int, segments: int) -> int:
    if segments < 1 or steps < segments:
        raise ValueError(f"Cannot cut {steps} steps into {segments} segments")
    return steps // segments


def segment_of(unmask_step: Column, steps: int, segments: int) -> Column:
    """Segment ``n`` holds the steps in ``(n*w, (n+1)*w]``; NULL outside all of them.

    Equal widths turn the interval join into a division. Steps start at 0, so step 0 belongs
    to no segment.
    """
    width = segment_width(steps, segments)
    inside = (unmask_step >= 1) & (unmask_step <= width * segments)
    return F.when(inside, F.floor((unmask_step - 1) / F.lit(width)).cast("bigint"))


def assign_segment(traj: DataFrame, steps: int, segments: int) -> DataFrame:
    return traj.withColumn("segment", segment_of(F.col("unmask_step"), steps, segments))


def eos_mask(
    traj: DataFrame, eos_id: int, keys: Sequence[str] = ("seq_id",), split_rows: int = SPLIT_ROWS
) -> DataFrame:
    """``is_valid`` up to and including a sequence's first end token; all valid without one."""
    first_eos = F.min(F.when(F.col("token_id") == eos_id, F.col("pos")))
    marked = attach_aggregates(traj, keys, split_rows, many=True, _eos=first_eos)
    return marked.withColumn("is_valid", F.coalesce(F.col("pos") <= F.col("_eos"), F.lit(True))).drop("_eos")


def active_segments(segmented: DataFrame, by: Sequence[str] = ("batch_id",)) -> DataFrame:
    """The segments of a batch in which any sequence reveals a token."""
    return segmented.where(F.col("segment").isNotNull()).select(*by, "segment").distinct()


def _segments_found(segmented: DataFrame, segment: Column, by: Sequence[str]) -> DataFrame:
    """Row count and set of segments per batch, from one row per (batch, segment)."""
    per_segment = segmented.groupBy(*by, segment.alias("_one")).agg(F.count(F.lit(1)).alias("_n"))
    return per_segment.groupBy(*by).agg(F.sum("_n").alias(ROW_COUNT), F.array_sort(F.collect_set("_one")).alias("_found"))


def segment_inputs(
    segmented: DataFrame, steps: int, segments: int, mask_id: int, by: Sequence[str] = ("batch_id",),
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """For each active segment of a batch, every sequence as it stood when the segment began.

    One row per (segment, token) for an external model to score; ``is_target`` marks tokens
    revealed in the segment. The active segments, at most ``segments`` per batch, travel to the
    tokens as one array.
    """
    width = segment_width(steps, segments)
    marked = attach_few(segmented, _segments_found(segmented, F.col("segment"), by), by, split_rows)
    each = marked.withColumnRenamed("segment", "_own").withColumn("segment", F.explode("_found"))
    start = F.col("segment") * width
    return each.select(
        *by, "segment", "seq_id", "pos",
        mask_state(F.col("token_id"), F.col("unmask_step"), start, mask_id).alias("input_id"),
        F.coalesce(is_hidden(F.col("unmask_step"), start), F.lit(False)).alias("is_hidden"),
        F.coalesce(F.col("_own") == F.col("segment"), F.lit(False)).alias("is_target"),
        "token_id",
    )


def pack_tokens(traj: DataFrame, by: Sequence[str] = ("batch_id",), block: int = PACKED) -> DataFrame:
    """T3, stored: one row per ``block`` positions of a sequence, its tokens in the order of their reveal.

    Prompt tokens (NULL step) come first, then those never revealed (-1). The state at any step
    follows from this row, so a sequence is stored and shuffled once, not once per segment.
    """
    part = F.floor(F.col("pos") / F.lit(block)).cast("bigint")
    entries = F.sort_array(F.collect_list(F.struct("unmask_step", "pos", "token_id")))
    packed = traj.groupBy(*by, "seq_id", part.alias("part")).agg(entries.alias("_entries"))
    return packed.select(*by, "seq_id", "part", *[
        F.col("_entries")[c].alias(name)
        for c, name in (("unmask_step", "unmask_steps"), ("pos", "positions"), ("token_id", "token_ids"))
    ])


def packed_inputs(
    packed: DataFrame, steps: int, segments: int, mask_id: int, by: Sequence[str] = ("batch_id",),
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """T3 from packed rows: per active segment of a batch and packed row, arrays of the state.

    One row per (segment, packed row) with ``positions, input_ids, is_hidden, is_target, token_ids``,
    in one order. States are rebuilt after the last shuffle. ``unpack_inputs`` gives ``segment_inputs``' rows.
    """
    width = segment_width(steps, segments)
    found = F.array_distinct(F.transform("unmask_steps", lambda s: segment_of(s, steps, segments)))
    ones = packed.select(*by, F.explode_outer(found).alias("_own"))
    each = attach_few(packed, _segments_found(ones, F.col("_own"), by), by, split_rows).withColumn("segment", F.explode("_found"))
    start, own = F.col("segment") * width, F.col("unmask_steps")
    return each.select(
        *by, "segment", "seq_id", "part", "positions",
        F.zip_with("token_ids", own, lambda t, s: mask_state(t, s, start, mask_id)).alias("input_ids"),
        F.transform(own, lambda s: F.coalesce(is_hidden(s, start), F.lit(False))).alias("is_hidden"),
        F.transform(own, lambda s: F.coalesce(segment_of(s, steps, segments) == F.col("segment"), F.lit(False))).alias("is_target"),
        "token_ids",
    )


def unpack_inputs(inputs: DataFrame, by: Sequence[str] = ("batch_id",)) -> DataFrame:
    """``segment_inputs``' rows from ``packed_inputs``': one per (segment, token), nothing is shuffled."""
    names = {"positions": "pos", "input_ids": "input_id", "is_hidden": "is_hidden", "is_target": "is_target", "token_ids": "token_id"}
    tokens = inputs.select(*by, "segment", "seq_id", F.explode(F.arrays_zip(*names)).alias("_token"))
    return tokens.select(*by, "segment", "seq_id", *[F.col("_token")[c].alias(name) for c, name in names.items()])


def sample_segments(
    segmented: DataFrame, k: int, segments: int, iterations: int, step: Column | None = None,
    by: Sequence[str] = ("batch_id",),
) -> DataFrame:
    """K4: per batch and iteration, ``k`` segments drawn from those with a valid revealed token.

    With at most ``k`` candidates all are taken; without any, ``k`` of all segments. A draw
    depends on ``step * iterations + iter`` and the segment only. The candidates of a batch are
    at most ``segments`` numbers, so the draw is made inside one row. Keeps the batch's row count.
    """
    if not 0 < k <= segments:
        raise ValueError(f"Cannot sample {k} of {segments} segments")
    step = F.lit(0) if step is None else step
    candidates = _segments_found(segmented, F.when(F.col("is_valid"), F.col("segment")), by)
    pool = F.when(F.size("_found") > 0, F.col("_found")).otherwise(below(segments))
    seed = step.cast("bigint") * iterations + F.col("iter")

    def draw(candidates: Column) -> Column:
        ordered = F.array_sort(F.transform(
            candidates, lambda s: F.struct(digest(seed, s).alias("order"), s.alias("segment"))
        ))
        return F.array_sort(F.slice(ordered, 1, k)["segment"])

    return candidates.withColumn("iter", each_below(iterations)).select(
        *by, "iter", let(pool, draw).alias("segments"), ROW_COUNT
    )


def sampled_segments(samples: DataFrame, by: Sequence[str] = ("batch_id",)) -> DataFrame:
    """K4 in long form: one row per drawn segment."""
    return samples.select(*by, "iter", F.explode("segments").alias("segment"))


def sample_mask(
    segmented: DataFrame, samples: DataFrame, by: Sequence[str] = ("batch_id",), split_rows: int = SPLIT_ROWS
) -> DataFrame:
    """Per iteration, whether a token lies in one of the drawn segments."""
    per_batch = samples.groupBy(*by).agg(
        F.first(ROW_COUNT).alias(ROW_COUNT),
        F.collect_list(F.struct("iter", "segments")).alias("_draws"),
    )
    joined = attach_few(segmented, per_batch, by, split_rows).drop(ROW_COUNT)
    each = joined.withColumn("_draw", F.explode("_draws"))
    hit = F.array_contains(F.col("_draw")["segments"], F.col("segment"))
    return each.select(
        *segmented.columns, F.col("_draw")["iter"].alias("iter"), F.coalesce(hit, F.lit(False)).alias("is_sampled")
    )


def sample_coverage(masked: DataFrame, by: Sequence[str] = ("batch_id", "iter")) -> DataFrame:
    """Sampled share of the valid tokens, and of all tokens."""
    valid, sampled = F.col("is_valid").cast("bigint"), F.col("is_sampled").cast("bigint")
    return masked.groupBy(*by).agg(
        F.try_divide(F.sum(valid * sampled).cast("double"), F.sum(valid)).alias("token_coverage"),
        F.avg(sampled).alias("sampled_tokens_ratio"),
    )
