"""Token log-probabilities from logged logits.

A logits table has one row per (segment, sequence, position) with the model's array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollscore.functions.logits import cfg_combine, confidence, own_score, token_logp
from rollscore.functions.ranges import each_below
from rollscore.operators.segments import segment_of

TOKEN_KEYS = ("seq_id", "pos")


def segment_token_logps(logits: DataFrame, steps: int, segments: int) -> DataFrame:
    """T4: log-probability of each token in the segment that reveals it.

    ``logits`` carries ``token_id`` and ``unmask_step``, so other rows are dropped in the scan,
    before any array is looked at, and no array is ever shuffled.
    """
    own = segment_of(F.col("unmask_step"), steps, segments) == F.col("segment")
    return logits.where(own).select(
        "seq_id", "segment", "pos", token_logp(F.col("logits"), F.col("token_id")).alias("logp")
    )


def plain_token_logps(logits: DataFrame, traj: DataFrame, keys: Sequence[str] = TOKEN_KEYS) -> DataFrame:
    """T4 without segments: the log-probability of every token, per logged pass.

    ``logits`` carries ``token_id``, and ``iter`` if there was a pass per iteration. Arrays are
    reduced in the scan. Every token of ``traj`` stays; one without logits has NULL.
    """
    passes = ["iter"] if "iter" in logits.columns else []
    value = token_logp(F.col("logits"), F.col("token_id")).alias("logp")
    scored = logits.select(*keys, *passes, value)
    return traj.join(scored, list(keys), "left")


def sampled_logits(logits: DataFrame, samples: DataFrame, by: Sequence[str] = ("batch_id",)) -> DataFrame:
    """The logits of segments that some iteration has drawn, cut before an array is looked at.

    There are at most ``segments`` rows per batch on the right, so they are matched by their real
    size: by broadcast where that is small, else by a join that reads no other segment's arrays.
    """
    drawn = samples.select(*by, "segment").distinct()
    return logits.join(drawn, [*by, "segment"], "left_semi")


def with_targets(
    logits: DataFrame, traj: DataFrame, keys: Sequence[str] = TOKEN_KEYS, cut: tuple[int, int] | None = None
) -> DataFrame:
    """Add ``token_id`` and ``unmask_step`` to logits that were logged without them.

    Logits without a token keep NULL. With ``cut`` (steps, segments) only each token's own segment
    is joined, as token scores need no other: both sides are cut to the keys that can meet. The
    arrays do go through this join; log targets beside the logits, or bucket both tables, to avoid it.
    """
    targets = traj.select(*keys, "token_id", "unmask_step")
    if cut is None:
        return logits.join(targets, list(keys), "left")
    owned = targets.withColumn("segment", segment_of(F.col("unmask_step"), *cut)).where(F.col("segment").isNotNull())
    return logits.join(owned, [*keys, "segment"], "inner")


def combine_passes(
    conditional: DataFrame, unconditional: DataFrame, scale: float,
    keys: Sequence[str] = ("seq_id", "segment", "pos"),
) -> DataFrame:
    """Guided logits from two logged passes; the second is not read without a scale.

    A row without its second pass keeps its place with NULL logits.
    """
    if scale == 0:
        return conditional
    other = unconditional.select(*keys, F.col("logits").alias("_other"))
    both = conditional.join(other, list(keys), "left")
    return both.withColumn("logits", cfg_combine(F.col("logits"), F.col("_other"), scale)).drop("_other")


def merge_segment_logps(
    traj: DataFrame, logps: DataFrame, steps: int, segments: int, keys: Sequence[str] = TOKEN_KEYS,
    value: str = "logp",
) -> DataFrame:
    """Mean over the segments that scored a token; 0 for tokens that lie in no segment.

    A token inside a segment whose score is missing has NULL: it is not known, and not certain.
    """
    merged = logps.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    joined = traj.join(merged, list(keys), "left")
    outside = segment_of(F.col("unmask_step"), steps, segments).isNull()
    return joined.withColumn(value, F.when(outside, F.lit(0.0)).otherwise(F.col("_mean"))).drop("_mean")


def repeat_iterations(logps: DataFrame, iterations: int) -> DataFrame:
    """T4: the same values for each iteration of a rollout."""
    return logps.withColumn("iter", each_below(iterations))


def position_scores(logits: DataFrame, method: str = "max_logit", source: str = "gt") -> DataFrame:
    """Reduce each array to the two scores that position likelihood needs."""
    own: Column = own_score(F.col("logits"), F.col("token_id"), method, source)
    kept = [c for c in logits.columns if c != "logits"]
    return logits.select(
        *kept, own.alias("own_score"), confidence(F.col("logits"), method).alias("confidence")
    )
