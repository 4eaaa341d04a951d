"""Position likelihood: was each token revealed at the right time?

A score table has one row per (sequence, segment, position) with ``unmask_step``, the token's
``own_score`` and its ``confidence`` as a competitor. A token competes with the tokens revealed
strictly later than its threshold: its segment's last step (scope ``segment``) or its own step
(scope ``position``).
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from rollscore.functions.text import let
from rollscore.operators.kernel import Pairs, chunk_softmax, chunk_sums, far_sums
from rollscore.operators.scan import later_log_sums, log_sums
from rollscore.operators.segments import segment_of, segment_width
from rollscore.plans.columnar import gather, kinds_of, parts
from rollscore.plans.skew import ROW_COUNT, SPLIT_ROWS, attach
from rollscore.session import cut_lineage

METHODS = ("bradley_terry", "softmax")
SCOPES = ("segment", "position")
SEGMENT_KEYS = ["seq_id", "segment"]
# Exponents are taken relative to multiples of this, so that no maximum has to be known first.
EXP_RANGE = 512.0
CHUNK = 4096
#: Up to so many keys of two numbers are broadcast.
BROADCAST_KEYS = 500_000


def _threshold(scope: str, steps: int, segments: int) -> Column:
    width = segment_width(steps, segments)
    if scope == "segment":
        return ((F.col("segment") + 1) * width).cast("bigint")
    if scope == "position":
        return F.col("unmask_step").cast("bigint")
    raise ValueError(f"Unknown competition scope: {scope}")


def _revealed_here(steps: int, segments: int) -> Column:
    return F.coalesce(segment_of(F.col("unmask_step"), steps, segments) == F.col("segment"), F.lit(False))


def later_parts(scores: DataFrame, steps: int, segments: int, tau: float) -> DataFrame:
    """Per (sequence, segment), one array entry per later step and exponent range.

    ``total`` sums ``exp(c/tau - base)``. The sums are combined map-side and stay in range
    without a first pass for the maximum. Steps after the last segment are later than every
    threshold, so they share one entry. What is left per key is one entry per step and distinct
    exponent range, however many tokens the key holds. A competitor of minus infinity adds 0.
    """
    scaled = F.col("confidence") / F.lit(float(tau))
    base = F.when(F.abs(scaled) == float("inf"), F.lit(0.0)).otherwise(
        (F.floor(scaled / F.lit(EXP_RANGE)) * F.lit(EXP_RANGE)).cast("double")
    )
    width = segment_width(steps, segments)
    return (
        scores.where(F.col("unmask_step") > F.col("segment") * width)
        .select(
            *SEGMENT_KEYS,
            F.least(F.col("unmask_step"), F.lit(segments * width + 1)).cast("bigint").alias("step"),
            base.alias("base"),
            scaled.alias("scaled"),
        )
        .groupBy(*SEGMENT_KEYS, "step", "base")
        .agg(F.sum(F.exp(F.col("scaled") - F.col("base"))).alias("total"), F.count(F.lit(1)).alias("n"))
        .groupBy(*SEGMENT_KEYS)
        .agg(F.collect_list(F.struct("step", "base", "total", "n")).alias("_parts"))
    )


def _logsumexp(parts: Column) -> Column:
    """Log-sum-exp over parts, shifted by their own maximum; minus infinity for none."""

    def shifted(values: Column) -> Column:
        return let(F.array_max(values), lambda top: top + F.ln(
            F.aggregate(values, F.lit(0.0), lambda total, v: total + F.exp(v - top))
        ))

    # A total of 0 comes from competitors of minus infinity only; NULL stays NULL.
    logs = F.transform(
        F.filter(parts, lambda p: F.coalesce(p["total"] > 0, F.lit(True))), lambda p: p["base"] + F.ln(p["total"])
    )
    return let(logs, lambda values: F.when(F.size(values) > 0, shifted(values)).otherwise(F.lit(float("-inf"))))


def future_logsumexp(
    scores: DataFrame, steps: int, segments: int, scope: str, tau: float
) -> DataFrame:
    """``others``, the competitors' log-sum-exp per (sequence, segment, threshold).

    A segment has one threshold, its last step, or one per step in it. ``n_rows`` counts the
    tokens that use a threshold.
    """
    last = (F.col("segment") + 1) * segment_width(steps, segments)
    here = F.filter("_parts", lambda p: p["step"] <= last)
    if scope == "segment":
        thresholds = F.when(F.size(here) > 0, F.array(last.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
        users = here["n"]
    else:
        thresholds = F.array_distinct(here["step"])
        users = F.transform(F.filter("_parts", lambda p: p["step"] == F.col("_threshold")), lambda p: p["n"])
    each = later_parts(scores, steps, segments, tau).withColumn("_threshold", F.explode(thresholds))
    return each.select(
        *SEGMENT_KEYS,
        "_threshold",
        F.aggregate(users, F.lit(0).cast("bigint"), lambda total, n: total + n).alias(ROW_COUNT),
        _logsumexp(F.filter("_parts", lambda p: p["step"] > F.col("_threshold"))).alias("_others"),
    )


def scanned_logsumexp(scores: DataFrame, steps: int, segments: int, scope: str, tau: float) -> DataFrame:
    """What ``future_logsumexp`` returns, in memory that grows neither with a key's steps nor with 1 / tau."""
    width = segment_width(steps, segments)
    last = (F.col("segment") + 1) * width
    value = F.col("confidence") / F.lit(float(tau))
    rivals = scores.where(F.col("unmask_step") > F.col("segment") * width)
    here = F.col("unmask_step") <= last
    if scope == "segment":
        later = log_sums(rivals.where(~here), SEGMENT_KEYS, value).withColumnsRenamed({"n": "_n", **{k: f"_{k}" for k in SEGMENT_KEYS}})
        users = rivals.where(here).groupBy(*SEGMENT_KEYS).agg(F.count(F.lit(1)).alias(ROW_COUNT))
        met = users.join(later, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in SEGMENT_KEYS]), "left")
        others = F.when(F.col("_n").isNull(), F.lit(float("-inf"))).when(~F.isnan("log_sum"), F.col("log_sum"))
        return met.select(*SEGMENT_KEYS, last.cast("bigint").alias("_threshold"), ROW_COUNT, others.alias("_others"))
    _threshold(scope, steps, segments)
    found = later_log_sums(
        rivals.withColumn("_threshold", F.least(F.col("unmask_step"), last + 1).cast("bigint")), SEGMENT_KEYS, "_threshold", value
    )
    return found.where(F.col("_threshold") <= last).select(
        *SEGMENT_KEYS, "_threshold", F.col("n").alias(ROW_COUNT), F.col("others").alias("_others")
    )


def softmax_logps(
    scores: DataFrame, steps: int, segments: int, scope: str = "segment", tau: float = 1.0,
    split_rows: int = SPLIT_ROWS, scan: bool = False,
) -> DataFrame:
    """L4: ``own/tau`` less the log-sum-exp of it and its competitors; 0 without competitors.

    Competitors of minus infinity, as closed positions have, weigh nothing. NULL scores give NULL. ``scan`` is for thousands
    of steps or very small ``tau``: see ``scan_logps``.
    """
    if scan:
        return scan_logps(scores, steps, segments, scope, tau, split_rows)
    here = _revealed_here(steps, segments)
    # Tokens not revealed here have no competitors and stay where they are.
    revealed = _less_others(scores, future_logsumexp(scores, steps, segments, scope, tau), steps, segments, scope, tau, split_rows)
    return revealed.unionByName(scores.where(~here).withColumn("pos_logp", F.lit(0.0)))


def _less_others(
    scores: DataFrame, others: DataFrame, steps: int, segments: int, scope: str, tau: float, split_rows: int
) -> DataFrame:
    """The tokens of ``scores`` revealed here, with ``pos_logp`` from their competitors' log-sum-exp."""
    joined = attach(
        scores.where(_revealed_here(steps, segments)).withColumn("_threshold", _threshold(scope, steps, segments)), others,
        [*SEGMENT_KEYS, "_threshold"], split_rows, many=True,
    )
    own = F.col("own_score") / F.lit(float(tau))
    top = F.greatest(own, F.col("_others"))
    together = top + F.ln(F.exp(own - top) + F.exp(F.col("_others") - top))
    alone = F.col(ROW_COUNT).isNull() | (F.col("_others") == float("-inf"))
    return joined.select(*scores.columns, F.when(alone, F.lit(0.0)).otherwise(own - together).alias("pos_logp"))


def scan_logps(
    scores: DataFrame, steps: int, segments: int, scope: str = "segment", tau: float = 1.0, split_rows: int = SPLIT_ROWS,
    chunk: int = CHUNK,
) -> DataFrame:
    """L4: what ``softmax_logps`` returns, in memory that grows neither with a key's steps nor with 1 / tau.

    A key whose tokens lie in one chunk of positions is packed into one row and scanned there (``kernel``), with no other
    shuffle. Only longer keys, and those that are NULL, go through ``scanned_logsumexp`` and a join.
    """
    part = F.coalesce(F.floor(F.col("pos") / F.lit(chunk)).cast("bigint"), F.lit(-1).cast("bigint"))
    names = [*SEGMENT_KEYS, "_part"]
    width, here = segment_width(steps, segments), _revealed_here(steps, segments)
    _threshold(scope, steps, segments)
    known = reduce(and_, [F.col(k).isNotNull() for k in SEGMENT_KEYS])
    rivals = scores.withColumn("_part", part).where(known & (F.col("unmask_step") > F.col("segment") * width))
    spans = rivals.groupBy(*SEGMENT_KEYS).agg(F.min("_part").alias("_first"), F.max("_part").alias("_last"))
    longer = cut_lineage(spans.where("_first < _last").select(*SEGMENT_KEYS))
    if longer.count() <= BROADCAST_KEYS:
        longer = F.broadcast(longer)
    row = F.struct(*[c for c in scores.columns if c not in SEGMENT_KEYS])
    packed = rivals.groupBy(*names).agg(F.collect_list(row).alias("_rows")).join(longer, SEGMENT_KEYS, "left_anti")
    pairs, columns = Pairs(width, segments, scope == "segment", float(tau)), list(scores.columns)
    found = StructType([*scores.schema.fields, StructField("pos_logp", DoubleType())])
    short = packed.mapInArrow(lambda batches: chunk_softmax(batches, columns, SEGMENT_KEYS, pairs), found)
    rest = scores.join(longer, SEGMENT_KEYS, "left_semi").unionByName(scores.where(~known))
    others = scanned_logsumexp(rest, steps, segments, scope, tau)
    revealed = short.unionByName(_less_others(rest, others, steps, segments, scope, tau, split_rows))
    return revealed.unionByName(scores.where(~here).withColumn("pos_logp", F.lit(0.0)))


def _log_sigmoid(x: Column) -> Column:
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


def bradley_terry_logps(
    scores: DataFrame, steps: int, segments: int, scope: str = "segment", tau: float = 1.0, chunk: int = CHUNK,
    blocks: bool = False,
) -> DataFrame:
    """L3: sum over the competitors of log-sigmoid of the score difference; 0 without competitors.

    Every pair counts and none can be merged, so tokens and competitors are packed into chunks
    of ``chunk`` positions and the pairs are summed inside one row per pair of chunks. A
    completion shorter than ``chunk`` is one such row. The pairs of a longer one are joined by
    competitor chunk, so that they spread over as many tasks as it has chunks. Competitors are
    grouped by step: a target passes over the steps up to its threshold, not over their tokens,
    and chunks without a later step are not joined at all. ``blocks`` is for long completions: see ``block_logps``.
    """
    if blocks:
        return block_logps(scores, steps, segments, scope, tau, chunk)
    threshold = _threshold(scope, steps, segments)
    part = F.floor(F.col("pos") / F.lit(chunk)).cast("bigint")
    targets = (
        scores.where(_revealed_here(steps, segments))
        .select(*SEGMENT_KEYS, part.alias("_part"), "pos", threshold.alias("_threshold"), "own_score")
        .groupBy(*SEGMENT_KEYS, "_part")
        .agg(
            F.collect_list(F.struct("pos", "_threshold", "own_score")).alias("_targets"),
            F.min("_threshold").alias("_earliest"),
        )
    )
    rivals = (
        scores.where(F.col("unmask_step") > F.col("segment") * segment_width(steps, segments))
        .select(*SEGMENT_KEYS, part.alias("_rival_part"), F.col("unmask_step").alias("_step"), "confidence")
        .groupBy(*SEGMENT_KEYS, "_rival_part", "_step")
        .agg(F.collect_list("confidence").alias("_confidences"))
        .groupBy(*SEGMENT_KEYS, "_rival_part")
        .agg(F.collect_list(F.struct("_step", "_confidences")).alias("_rivals"), F.max("_step").alias("_latest"))
    )

    def against_all(target: Column) -> Column:
        def against(total: Column, confidences: Column) -> Column:
            return F.aggregate(
                confidences, total, lambda acc, c: acc + _log_sigmoid((target["own_score"] - c) / F.lit(float(tau)))
            )

        later = F.filter("_rivals", lambda r: r["_step"] > target["_threshold"])
        total = F.aggregate(later, F.lit(0.0), lambda acc, r: against(acc, r["_confidences"]))
        return F.struct(target["pos"].alias("pos"), total.alias("part_sum"))

    # The latest step of each chunk, a few numbers per key, tells which chunks a chunk of targets meets.
    chunks = rivals.groupBy(*SEGMENT_KEYS).agg(F.collect_list(F.struct("_rival_part", "_latest")).alias("_chunks"))
    met = F.filter("_chunks", lambda c: c["_latest"] > F.col("_earliest"))
    each = targets.join(chunks, SEGMENT_KEYS, "inner").withColumn("_rival_part", F.explode(met["_rival_part"]))
    met = each.join(rivals.drop("_latest"), [*SEGMENT_KEYS, "_rival_part"], "inner")
    each = met.select(*SEGMENT_KEYS, F.explode(F.transform("_targets", against_all)).alias("_one")).select(*SEGMENT_KEYS, "_one.*")
    summed = each.groupBy(*SEGMENT_KEYS, "pos").agg(F.sum("part_sum").alias("_sum"))
    joined = scores.join(summed, [*SEGMENT_KEYS, "pos"], "left")
    return joined.select(*scores.columns, F.coalesce("_sum", F.lit(0.0)).alias("pos_logp"))


def block_logps(
    scores: DataFrame, steps: int, segments: int, scope: str = "segment", tau: float = 1.0, chunk: int = CHUNK
) -> DataFrame:
    """L3: what ``bradley_terry_logps`` returns, in dense blocks of doubles (``kernel``) instead of an expression.

    A key's tokens are packed into chunks once, as a token may be target and competitor. The pairs inside a chunk need no
    other shuffle; chunks that lie apart meet by the few numbers that say which steps they hold, so only longer
    keys are moved again. Tokens not revealed in the segment are not moved at all, but for the confidences of those that compete.
    """
    part = F.floor(F.col("pos") / F.lit(chunk)).cast("bigint")
    names = [*SEGMENT_KEYS, "_part"]
    placed = reduce(and_, [F.col(n).isNotNull() for n in names])
    here = _revealed_here(steps, segments) & reduce(and_, [c.isNotNull() for c in (*map(F.col, SEGMENT_KEYS), part)])
    width = segment_width(steps, segments)
    threshold = F.when(here, _threshold(scope, steps, segments))
    # One plan for all that read the packed rows, so that they are shuffled once.
    rivals = scores.withColumn("_part", part).where(placed & (F.col("unmask_step") > F.col("segment") * width))
    kinds = kinds_of(scores, SEGMENT_KEYS)
    if kinds is None:
        row = F.struct(*[c for c in scores.columns if c not in SEGMENT_KEYS])
        packed = rivals.groupBy(*names).agg(F.collect_list(row).alias("_rows"))
    else:
        # Of a token that only competes its confidence counts, and that its step is later than the segment.
        after = (F.col("segment") + 1) * width + 1
        step = F.when(here | ~F.col("segment").between(0, segments - 1), F.col("unmask_step")).otherwise(after).cast(kinds["unmask_step"])
        slim = rivals.select(*names, *[
            F.col(c) if c == "confidence" else step.alias(c) if c == "unmask_step" else F.when(here, F.col(c)).alias(c) for c in kinds
        ])
        # Said once more for the optimizer, which would else add it for some readers only and pack twice.
        packed = gather(parts(slim, names, "pos", kinds).where(placed), names, "_rows")
    spans = rivals.groupBy(*names).agg(F.min(threshold).alias("_earliest"), F.max("unmask_step").alias("_latest"))
    rival_spans = spans.select(*SEGMENT_KEYS, F.col("_part").alias("_rival_part"), F.col("_latest").alias("_rival_latest"))
    apart = spans.join(rival_spans, SEGMENT_KEYS).where(
        (F.col("_part") != F.col("_rival_part")) & (F.col("_rival_latest") > F.col("_earliest"))
    ).select(*SEGMENT_KEYS, "_part", "_rival_part")
    against = packed.select(*SEGMENT_KEYS, F.col("_part").alias("_rival_part"), F.col("_rows").alias("_rivals"))
    met = apart.join(packed, names).join(against, [*SEGMENT_KEYS, "_rival_part"]).select(*names, "_rows", "_rivals")
    pairs = Pairs(width, segments, scope == "segment", float(tau))
    typed = [f"{n} {met.schema[n].dataType.simpleString()}" for n in names]
    far = met.mapInArrow(
        lambda batches: far_sums(batches, names, pairs, kinds), ", ".join([*typed, "_far array<struct<pos:double,sum:double>>"])
    ).groupBy(*names).agg(F.flatten(F.collect_list("_far")).alias("_far"))
    found = StructType([*scores.schema.fields, StructField("pos_logp", DoubleType())])
    columns = list(scores.columns)
    revealed = packed.join(far, names, "left").mapInArrow(
        lambda batches: chunk_sums(batches, columns, SEGMENT_KEYS, pairs, kinds), found
    )
    return revealed.unionByName(scores.where(~here).withColumn("pos_logp", F.lit(0.0)))


def position_logps(
    scores: DataFrame, steps: int, segments: int, method: str = "bradley_terry", scope: str = "position",
    tau: float = 1.0, scan: bool = False, blocks: bool = False,
) -> DataFrame:
    """Position log-probability of every scored row; 0 for tokens not revealed in the segment.

    ``scan`` and ``blocks`` choose another plan for the same values: see ``softmax_logps`` and ``bradley_terry_logps``.
    """
    if method not in METHODS:
        raise ValueError(f"Unknown position likelihood method: {method}")
    if scope not in SCOPES:
        raise ValueError(f"Unknown competition scope: {scope}")
    if tau <= 0:
        raise ValueError("Position scoring temperature must be positive")
    if method == "softmax":
        return softmax_logps(scores, steps, segments, scope, tau, scan=scan)
    return bradley_terry_logps(scores, steps, segments, scope, tau, blocks=blocks)
