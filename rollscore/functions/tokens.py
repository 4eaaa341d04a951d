"""Expressions on packed token arrays and on single tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollscore.functions.sampling import uniform

STILL_MASKED = -1


def truncate_left(ids: Column, length: int | None) -> Column:
    """P5: the last ``length`` ids; all of them without a length."""
    if length is None:
        return ids
    return F.slice(ids, F.greatest(F.size(ids) - length + 1, F.lit(1)), F.lit(length))


def pad_left(ids: Column, pad: int, width: Column) -> Column:
    """Ids filled up on the left to ``width``."""
    return F.concat(F.array_repeat(F.lit(pad).cast("int"), width - F.size(ids)), ids)


def attention_mask(ids: Column, width: Column) -> Column:
    """0 for padding, 1 for ids."""
    return F.concat(F.array_repeat(F.lit(0), width - F.size(ids)), F.array_repeat(F.lit(1), F.size(ids)))


def split_prompt(ids: Column, prompt_length: Column | int) -> Column:
    """The prompt part."""
    return F.slice(ids, F.lit(1), _column(prompt_length))


def split_completion(ids: Column, prompt_length: Column | int) -> Column:
    """The part after the prompt."""
    start = _column(prompt_length)
    return F.slice(ids, start + 1, F.greatest(F.size(ids) - start, F.lit(0)))


def _column(value: Column | int) -> Column:
    return F.lit(value) if isinstance(value, int) else value


def is_hidden(unmask_step: Column, at_step: Column | int) -> Column:
    """P10: a completion token is hidden at a step if it is revealed later or never."""
    return (unmask_step > at_step) | (unmask_step == STILL_MASKED)


def mask_state(token: Column, unmask_step: Column, at_step: Column | int, mask_id: int) -> Column:
    """P10: the token as the model sees it at a step. Prompt tokens have a NULL step and stay."""
    hidden = F.coalesce(is_hidden(unmask_step, at_step), F.lit(False))
    return F.when(hidden, F.lit(mask_id).cast("bigint")).otherwise(token.cast("bigint"))


def random_prompt_mask(
    token: Column, is_prompt: Column, seed: Column | int, key: list[Column], p: float, mask_id: int
) -> Column:
    """Prompt tokens are masked with probability ``p``, completion tokens always."""
    masked = ~is_prompt | (uniform(seed, *key) < p)
    return F.when(masked, F.lit(mask_id).cast("bigint")).otherwise(token.cast("bigint"))


def mask_probability(is_prompt: Column, p: float) -> Column:
    """The probability with which a token was masked."""
    return F.when(is_prompt, F.lit(float(p))).otherwise(F.lit(1.0))
