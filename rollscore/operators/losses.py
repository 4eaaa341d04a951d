"""Policy-loss values, importance ratios, clipping and KL from logged log-probabilities.

The aligned table has one row per token: the ``by`` columns that name an update, ``seq_id``,
``pos``, ``new_logp``, ``old_logp``, ``advantage``, ``is_valid`` and, if segments were sampled,
``is_sampled``. Every loss first sums each sequence (combined map-side), then each update, so a
sequence or update of any size is spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from rollscore.plans.columnar import kinds_of, parts, whole_rows
from rollscore.plans.packed import left_join
from rollscore.plans.skew import SPLIT_ROWS, attach, with_counts

LOSS_TYPES = ("reinforce", "grpo", "dapo", "gspo", "gspo_token")
TOKEN_LOSSES, CLIPPING_LOSSES = ("reinforce", "grpo", "dapo"), ("grpo", "dapo")
AVERAGING_MODES = ("token_level", "sequence_level")
UPDATE = ("batch_id",)


@dataclass(frozen=True)
class Loss:
    """Which loss to compute, how to average it and where to clip."""

    loss_type: str = "grpo"
    averaging_mode: str = "token_level"
    clip_eps: float = 0.2
    clip_eps_low: float = 0.2
    clip_eps_high: float = 0.28

    def __post_init__(self) -> None:
        if self.loss_type not in LOSS_TYPES:
            raise ValueError(f"Unknown loss type: {self.loss_type}")
        if self.averaging_mode not in AVERAGING_MODES:
            raise ValueError(f"Unknown averaging mode: {self.averaging_mode}")

    @property
    def low(self) -> float:
        return 1 - (self.clip_eps if self.loss_type == "grpo" else self.clip_eps_low)

    @property
    def high(self) -> float:
        return 1 + (self.clip_eps if self.loss_type == "grpo" else self.clip_eps_high)

    def clip(self, ratio: Column) -> Column:
        return F.least(F.greatest(ratio, F.lit(self.low)), F.lit(self.high))

    def is_clipped(self, ratio: Column) -> Column:
        return (ratio < self.low) | (ratio > self.high)


def align(
    new: DataFrame, old: DataFrame | None = None, ref: DataFrame | None = None,
    keys: Sequence[str] = ("batch_id", "seq_id", "pos"), packed: bool = False,
) -> DataFrame:
    """New, old and reference log-probabilities side by side; old is new if not logged.

    Every token of ``new`` stays; a value that was not logged is NULL. ``unmatched`` counts those,
    ``require`` refuses them. Keys are unique per token, so the joins shuffle evenly; tables stored
    with ``write_token_table`` are joined without a shuffle. Attach advantages to ``new`` before
    aligning: its rows are then counted and joined before the wider table exists. Tables of any other storage
    are joined with a fraction of the shuffle by ``packed``: as arrays per chunk of the last key, a number.
    """
    keys = list(keys)
    if packed:
        logged = [(table, keys[-1]) for table in (old, ref) if table is not None]
        aligned = left_join(new, keys[:-1], keys[-1], logged) if logged else new
        return aligned.withColumn("old_logp", F.col("new_logp")) if old is None else aligned
    aligned = new if old is None else new.join(old, keys, "left")
    if old is None:
        aligned = aligned.withColumn("old_logp", F.col("new_logp"))
    return aligned if ref is None else aligned.join(ref, keys, "left")


def unmatched(
    aligned: DataFrame, columns: Sequence[str] = ("old_logp", "advantage"), by: Sequence[str] = UPDATE
) -> DataFrame:
    """Per update, the tokens and how many of them lack each of the columns."""
    missing = [F.count_if(F.col(c).isNull()).alias(f"no_{c}") for c in columns]
    return aligned.groupBy(*by).agg(F.count(F.lit(1)).alias("n_tokens"), *missing)


def require(aligned: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same rows; a NULL in one of the columns fails the job that reads it."""
    return aligned.withColumns({
        c: F.coalesce(F.col(c), F.raise_error(F.lit(f"A token has no {c}")).cast("double")) for c in columns
    })


def attach_advantages(
    logps: DataFrame, advantages: DataFrame, keys: Sequence[str] = ("batch_id", "seq_id"),
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """Repeat each sequence's advantage on its tokens. Tokens of fixed width are packed before they are shuffled."""
    stats = with_counts(advantages.select(*keys, "advantage"), logps, keys)
    kinds = kinds_of(logps, keys)
    if kinds is None or "pos" not in kinds or "advantage" in kinds:
        return attach(logps, stats, keys, split_rows, many=True).drop("n_rows")
    schema = StructType([*logps.schema, StructField("advantage", stats.schema["advantage"].dataType)])
    return whole_rows(attach(parts(logps, keys, "pos", kinds), stats, keys, split_rows, many=True), schema, kinds)


def _counted(aligned: DataFrame) -> Column:
    """Tokens the loss looks at: valid ones and, if segments were sampled, sampled ones."""
    if "is_sampled" in aligned.columns:
        return F.col("is_valid") & F.col("is_sampled")
    return F.col("is_valid")


def _token_terms(loss: Loss, new: Column, old: Column, counted: Column, skip: Column | None) -> tuple[Column, Column]:
    """Importance ratio and loss of a token; the loss is 0 where the token does not count."""
    ratio, advantage = F.exp(new - old), F.col("advantage")
    if loss.loss_type == "reinforce":
        value = -advantage * new
    elif skip is not None:
        value = -ratio * advantage
        counted = counted & ~skip
    else:
        value = -F.least(ratio * advantage, loss.clip(ratio) * advantage)
    return ratio, F.when(counted, value).otherwise(F.lit(0.0))


def token_losses(aligned: DataFrame, loss: Loss, skip_clipped: str | None = None) -> DataFrame:
    """Per-token ``ratio``, ``is_clipped``, ``is_counted`` and ``token_loss``.

    ``skip_clipped`` names a boolean column of tokens that another loss clipped: those drop out
    and the others use their ratio as it is.
    """
    if loss.loss_type not in TOKEN_LOSSES:
        raise ValueError(f"{loss.loss_type} has no loss per token")
    counted = _counted(aligned)
    skip = None if skip_clipped is None else F.col(skip_clipped)
    ratio, value = _token_terms(loss, F.col("new_logp"), F.col("old_logp"), counted, skip)
    return aligned.withColumns(
        {"is_counted": counted, "ratio": ratio, "is_clipped": loss.is_clipped(ratio), "token_loss": value}
    )


def _share(condition: Column) -> Column:
    return F.sum(condition.cast("bigint"))


@dataclass
class Parts:
    """An aggregate in three steps: sums per sequence, columns of a sequence, values per update."""

    sums: dict[str, Column]
    derived: list[dict[str, Column]]
    result: dict[str, Column]


def _common_parts(table: DataFrame) -> Parts:
    """What all losses share: numbers of tokens."""
    sums = {
        "n_tokens": F.count(F.lit(1)), "n_valid": _share(F.col("is_valid")), "n_counted": _share(F.col("is_counted")),
    }
    if "is_sampled" in table.columns:
        sums["n_sampled"] = _share(F.col("is_sampled"))
    return Parts(sums, [], {})


def _aggregate(table: DataFrame, by: Sequence[str], parts: Sequence[Parts]) -> DataFrame:
    """Sequences first, then updates: two shuffles however many parts there are."""
    sums = {name: value for part in parts for name, value in part.sums.items()}
    rows = table.groupBy(*by, "seq_id").agg(*[value.alias(name) for name, value in sums.items()])
    for step in range(max(len(part.derived) for part in parts)):
        rows = rows.withColumns({n: c for part in parts if step < len(part.derived) for n, c in part.derived[step].items()})
    result = {name: value for part in parts for name, value in part.result.items()}
    return rows.groupBy(*by).agg(*[value.alias(name) for name, value in result.items()])


def _averaged(loss: Loss, total: Column) -> Column:
    """Per counted token, or per sequence. Nothing counted gives 0."""
    if loss.averaging_mode == "token_level":
        return F.coalesce(F.try_divide(F.sum(total), F.sum("n_counted")), F.lit(0.0))
    return F.avg(total)


def _sampled_ratio(sampled: bool, p: str) -> dict[str, Column]:
    return {f"{p}sampled_tokens_ratio": F.sum("n_sampled") / F.sum("n_tokens")} if sampled else {}


def _token_parts(loss: Loss, sampled: bool, p: str, new: str, old: str, skip: str | None) -> Parts:
    counted = F.col("is_counted")
    ratio, value = _token_terms(loss, F.col(new), F.col(old), counted, None if skip is None else F.col(skip))
    kept = F.when(counted, ratio)
    low, high = ratio < loss.low, ratio > loss.high
    sums = {f"{p}loss_sum": F.sum(value)}
    result = {f"{p}loss": _averaged(loss, F.col(f"{p}loss_sum")), f"{p}total_tokens": F.sum("n_counted"), **_sampled_ratio(sampled, p)}
    if loss.loss_type == "reinforce":
        return Parts(sums, [], result)
    sums |= {f"{p}{name}": column for name, column in {
        "ratio_sum": F.sum(ratio), "ratio_max": F.max(ratio), "ratio_min": F.min(ratio),
        "kept_sum": F.sum(kept), "kept_max": F.max(kept), "kept_min": F.min(kept),
        "n_low": _share(low), "n_high": _share(high),
        "kept_low": _share(low & counted), "kept_high": _share(high & counted),
    }.items()}
    # Statistics look at counted tokens, and at all of them if none is counted.
    result |= {
        f"{p}ratio_mean": F.coalesce(
            F.try_divide(F.sum(f"{p}kept_sum"), F.sum("n_counted")), F.sum(f"{p}ratio_sum") / F.sum("n_tokens")
        ),
        f"{p}ratio_max": F.coalesce(F.max(f"{p}kept_max"), F.max(f"{p}ratio_max")),
        f"{p}ratio_min": F.coalesce(F.min(f"{p}kept_min"), F.min(f"{p}ratio_min")),
    }

    def share(kept: str, everything: str) -> Column:
        return F.coalesce(F.try_divide(F.sum(f"{p}{kept}"), F.sum("n_counted")), F.sum(f"{p}{everything}") / F.sum("n_tokens"))

    if loss.loss_type == "grpo":
        result[f"{p}clipfrac"] = F.coalesce(
            F.try_divide(F.sum(f"{p}kept_low") + F.sum(f"{p}kept_high"), F.sum("n_counted")), F.lit(0.0)
        )
    else:
        result[f"{p}clipfrac_low"] = share("kept_low", "n_low")
        result[f"{p}clipfrac_high"] = share("kept_high", "n_high")
        result[f"{p}clipfrac_total"] = share("kept_low", "n_low") + share("kept_high", "n_high")
    if skip is not None:
        sums[f"{p}n_skipped"] = _share(F.col(skip))
        result[f"{p}token_clip_masked_frac"] = F.sum(f"{p}n_skipped") / F.sum("n_tokens")
    return Parts(sums, [], result)


def _ratio_parts(loss: Loss, p: str, new: str, old: str) -> Parts:
    """The length-normalised importance ratio of a sequence, clipped and not."""
    difference = F.when(F.col("is_counted"), F.col(new) - F.col(old))
    ratio, clipped, advantage = F.col(f"{p}ratio"), F.col(f"{p}clipped_ratio"), F.col(f"{p}advantage")
    return Parts(
        {f"{p}diff_sum": F.coalesce(F.sum(difference), F.lit(0.0)), f"{p}advantage": F.max("advantage")},
        [
            {f"{p}length": F.greatest(F.col("n_counted"), F.lit(1)).cast("double")},
            {f"{p}ratio": F.exp(F.col(f"{p}diff_sum") / F.col(f"{p}length"))},
            {f"{p}clipped_ratio": loss.clip(ratio)},
            {f"{p}surrogate": F.least(ratio * advantage, clipped * advantage)},
        ],
        {},
    )


def sequence_ratios(aligned: DataFrame, loss: Loss, by: Sequence[str] = UPDATE) -> DataFrame:
    """Per sequence, the length-normalised importance ratio, clipped and not."""
    table = aligned.withColumn("is_counted", _counted(aligned))
    parts = _ratio_parts(loss, "", "new_logp", "old_logp")
    sums = _common_parts(table).sums | parts.sums
    rows = table.groupBy(*by, "seq_id").agg(*[c.alias(name) for name, c in sums.items()])
    for columns in parts.derived:
        rows = rows.withColumns(columns)
    return rows


def _sequence_parts(loss: Loss, sampled: bool, p: str, new: str, old: str) -> Parts:
    """The sampled form reports a sampling rate, which is 1 by construction."""
    parts = _ratio_parts(loss, p, new, old)
    valid, ratio = F.col("n_valid") > 0, F.col(f"{p}ratio")
    clipped = (ratio != F.col(f"{p}clipped_ratio")).cast("bigint")
    parts.result |= {
        f"{p}loss": F.coalesce(
            F.try_divide(-F.sum(F.when(valid, F.col(f"{p}surrogate"))), F.sum(valid.cast("bigint"))), F.lit(0.0)
        ),
        f"{p}ratio_mean": F.avg(ratio),
        f"{p}ratio_std": F.coalesce(F.stddev_samp(ratio), F.lit(0.0)),
        f"{p}ratio_max": F.max(ratio),
        f"{p}ratio_min": F.min(ratio),
        f"{p}clipped_fraction": F.avg(clipped),
        f"{p}avg_sequence_length": F.avg(f"{p}length"),
        f"{p}valid_sequences": F.sum(valid.cast("bigint")),
        **_sampled_ratio(sampled, p),
    }
    if sampled:
        parts.result[f"{p}sampling_rate"] = F.avg(F.col(f"{p}length") / F.greatest(F.col("n_counted"), F.lit(1)))
    return parts


def _sequence_token_parts(loss: Loss, sampled: bool, p: str, new: str, old: str) -> Parts:
    """Each token carries its sequence's ratio, so the token sums follow from token counts."""
    parts = _ratio_parts(loss, p, new, old)
    ratio = F.col(f"{p}ratio")
    clipped = F.when(ratio != F.col(f"{p}clipped_ratio"), F.col("n_tokens")).otherwise(F.lit(0))
    parts.result |= {
        f"{p}loss": _averaged(loss, -F.col(f"{p}surrogate") * F.col("n_counted")),
        f"{p}total_tokens": F.sum("n_counted"),
        f"{p}seq_ratio_mean": F.avg(ratio),
        f"{p}token_ratio_mean": F.sum(ratio * F.col("n_tokens")) / F.sum("n_tokens"),
        f"{p}clipped_fraction": F.sum(clipped) / F.sum("n_tokens"),
        f"{p}avg_sequence_length": F.avg(f"{p}length"),
        **_sampled_ratio(sampled, p),
    }
    return parts


def _loss_parts(
    loss: Loss, sampled: bool, p: str = "", new: str = "new_logp", old: str = "old_logp", skip: str | None = None
) -> Parts:
    if loss.loss_type == "gspo":
        return _sequence_parts(loss, sampled, p, new, old)
    if loss.loss_type == "gspo_token":
        return _sequence_token_parts(loss, sampled, p, new, old)
    return _token_parts(loss, sampled, p, new, old, skip)


def policy_loss(
    aligned: DataFrame, loss: Loss, by: Sequence[str] = UPDATE, skip_clipped: str | None = None
) -> DataFrame:
    """Loss value and statistics per update."""
    table = aligned.withColumn("is_counted", _counted(aligned))
    parts = _loss_parts(loss, "is_sampled" in aligned.columns, skip=skip_clipped)
    return _aggregate(table, by, [_common_parts(table), parts])


def _kl_parts() -> Parts:
    gap, counted = F.col("ref_logp") - F.col("new_logp"), F.col("is_counted")
    return Parts(
        {"kl_sum": F.sum(F.when(counted, F.exp(gap) - gap - 1))}, [],
        {"kl": F.coalesce(F.sum("kl_sum"), F.lit(0.0)) / F.greatest(F.sum("n_counted"), F.lit(1))},
    )


def _sequence_stats_parts(sampled: bool) -> Parts:
    """Spread of the sequences' advantages, and share of the valid tokens that were sampled."""
    value = F.col("max_advantage")
    parts = Parts(
        {"max_advantage": F.max("advantage")}, [],
        {"advantage_mean": F.avg(value), "advantage_std": F.coalesce(F.stddev_samp(value), F.lit(0.0))},
    )
    if sampled:
        parts.sums["n_covered"] = _share(F.col("is_valid") & F.col("is_sampled"))
        parts.result["token_coverage"] = F.try_divide(F.sum("n_covered").cast("double"), F.sum("n_valid"))
    return parts


def _needed(loss: Loss, new: str, old: str) -> list[str]:
    """The log-probabilities a loss reads."""
    return [new] if loss.loss_type == "reinforce" else [new, old]


def update_values(
    aligned: DataFrame, loss: Loss, position: Loss | None = None, skip_clipped: bool = False, with_kl: bool = False,
    position_weight: float = 1.0, kl_weight: float = 0.0, by: Sequence[str] = UPDATE,
) -> DataFrame:
    """A11-A21, A7, A8 in one pass over the tokens: one wide row per update.

    Columns of the token loss start with ``policy/``, those of the position loss (of
    ``new_pos_logp`` and ``old_pos_logp``) with ``position/``. A token without a value that one of them
    reads would stay in the counts and miss in the sums, so it fails the job; ``unmatched`` counts such tokens.
    """
    sampled = "is_sampled" in aligned.columns
    needed = ["advantage", *_needed(loss, "new_logp", "old_logp")]
    if position is not None:
        needed += _needed(position, "new_pos_logp", "old_pos_logp")
    if with_kl:
        needed.append("ref_logp")
    aligned = require(aligned, needed)
    table = aligned.withColumn("is_counted", _counted(aligned))
    parts = [_common_parts(table), _loss_parts(loss, sampled, "policy/"), _sequence_stats_parts(sampled)]
    total = {"policy_loss": F.col("`policy/loss`")}
    terms = F.col("`policy/loss`")
    if position is not None:
        skip = None
        if skip_clipped and loss.loss_type in CLIPPING_LOSSES:
            table = clip_mask(table, loss)
            skip = "token_clipped" if position.loss_type in CLIPPING_LOSSES else None
        parts.append(_loss_parts(position, sampled, "position/", "new_pos_logp", "old_pos_logp", skip))
        weighted = F.col("`position/loss`") * position_weight
        total |= {"position_loss": F.col("`position/loss`"), "weighted_position_loss": weighted}
        terms = terms + weighted
    if with_kl:
        parts.append(_kl_parts())
        terms = terms + F.col("kl") * kl_weight
    values = _aggregate(table, by, parts)
    return values.withColumns({**total, "total_loss": terms})


def clip_mask(aligned: DataFrame, loss: Loss, name: str = "token_clipped") -> DataFrame:
    """Mark the tokens a per-token loss clips, for a second loss to skip."""
    if loss.loss_type not in CLIPPING_LOSSES:
        raise ValueError(f"{loss.loss_type} hands no clip mask over")
    ratio = F.exp(F.col("new_logp") - F.col("old_logp"))
    return aligned.withColumn(name, loss.is_clipped(ratio))


def kl(aligned: DataFrame, by: Sequence[str] = UPDATE) -> DataFrame:
    """Mean of ``exp(d) - d - 1`` with ``d = ref - new`` over the counted tokens."""
    table = aligned.withColumn("is_counted", _counted(aligned))
    return _aggregate(table, by, [_common_parts(table), _kl_parts()])


def total_loss(
    token: DataFrame, position: DataFrame | None = None, divergence: DataFrame | None = None,
    position_weight: float = 1.0, kl_weight: float = 0.0, by: Sequence[str] = UPDATE,
) -> DataFrame:
    """Token loss plus weighted position loss plus weighted KL, one row per update."""
    keys = list(by)
    table = token.select(*keys, F.col("loss").alias("policy_loss"))
    total = F.col("policy_loss")
    if position is not None:
        table = table.join(position.select(*keys, F.col("loss").alias("position_loss")), keys, "inner")
        table = table.withColumn("weighted_position_loss", F.col("position_loss") * position_weight)
        total = total + F.col("weighted_position_loss")
    if divergence is not None and kl_weight != 0:
        table = table.join(divergence.select(*keys, "kl"), keys, "inner")
        total = total + F.col("kl") * kl_weight
    return table.withColumn("total_loss", total)
