"""Expressions on logged logits: one array of vocabulary width per row.

Each array is reduced within its row; only the reduced columns should go through a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollscore.functions.sampling import digest, to_uniform
from rollscore.functions.text import let

CONFIDENCE_METHODS = ("max_logit", "top_prob", "neg_entropy", "margin")
CONFIDENCE_SOURCES = ("gt", "max")
REMASKING_MODES = ("low_confidence", "decoupled", "random")
NOISE_FLOOR = 1e-8  # Fixed value: keeps the logarithms of the position noise finite.


def as_doubles(logits: Column) -> Column:
    return logits.cast("array<double>")


def _sum_exp(logits: Column, shift: Column) -> Column:
    return F.aggregate(logits, F.lit(0.0), lambda total, x: total + F.exp(x - shift))


def log_sum_exp(logits: Column) -> Column:
    """``ln(sum(exp(x)))``, shifted by the maximum."""
    return let(
        as_doubles(logits),
        lambda l: let(F.array_max(l), lambda top: top + F.ln(_sum_exp(l, top))),
    )


def token_logp(logits: Column, target: Column) -> Column:
    """Log-softmax at the 0-based target."""
    return F.get(logits, target).cast("double") - log_sum_exp(logits)


def top_probability(logits: Column) -> Column:
    return F.exp(F.array_max(logits).cast("double") - log_sum_exp(logits))


def probability_of(logits: Column, token: Column) -> Column:
    return F.exp(token_logp(logits, token))


def confidence(logits: Column, method: str) -> Column:
    """How sure the model is of a position."""
    if method == "max_logit":
        return F.array_max(logits).cast("double")
    if method == "top_prob":
        return top_probability(logits)
    if method == "neg_entropy":
        return let(as_doubles(logits), lambda l: let(log_sum_exp(l), lambda z: F.aggregate(
            l, F.lit(0.0), lambda total, x: total + F.exp(x - z) * (x - z)
        )))
    if method == "margin":
        return let(as_doubles(logits), lambda l: let(log_sum_exp(l), lambda z: let(
            top_two(l), lambda two: F.exp(two["first"] - z) - F.exp(two["second"] - z)
        )))
    raise ValueError(f"Unknown confidence method: {method}")


def top_two(logits: Column) -> Column:
    """The two highest values in one pass, without sorting the vocabulary."""
    low = F.lit(float("-inf"))
    start = F.struct(low.alias("first"), low.alias("second"))
    return F.aggregate(
        logits,
        start,
        lambda best, x: F.struct(
            F.greatest(best["first"], x).alias("first"),
            F.greatest(best["second"], F.least(best["first"], x)).alias("second"),
        ),
    )


def own_score(logits: Column, target: Column, method: str, source: str) -> Column:
    """L1: score of a revealed token, by its target (``gt``) or like its competitors (``max``)."""
    if source == "max":
        return confidence(logits, method)
    if source != "gt":
        raise ValueError(f"Unknown confidence source: {source}")
    if method == "max_logit":
        return F.get(logits, target).cast("double")
    if method == "top_prob":
        return probability_of(logits, target)
    raise ValueError(f"confidence source 'gt' needs max_logit or top_prob, not {method}; use source 'max'")


def cfg_combine(conditional: Column, unconditional: Column, scale: float) -> Column:
    """Guided logits; the conditional ones as they are without a scale."""
    if scale == 0:
        return as_doubles(conditional)
    return F.zip_with(
        as_doubles(conditional), as_doubles(unconditional), lambda c, u: u + (scale + 1.0) * (c - u)
    )


def gumbel_scores(logits: Column, temperature: float, seed: Column | int, key: list[Column]) -> Column:
    """Noisy scores whose arg-max is a seeded categorical draw; logits at temperature 0."""
    if temperature == 0:
        return as_doubles(logits)
    row = digest(seed, *key)
    return let(row, lambda k: F.transform(
        as_doubles(logits),
        lambda x, i: F.exp(x) / F.pow(-F.ln(to_uniform(F.md5(F.concat_ws("|", k, i.cast("string"))))), F.lit(float(temperature))),
    ))


def argmax_token(scores: Column) -> Column:
    """K2: 0-based index of the highest score, the first of equals."""
    return let(scores, lambda s: F.array_position(s, F.array_max(s)) - 1)


def gumbel(u: Column) -> Column:
    return -F.ln(-F.ln(u + NOISE_FLOOR) + NOISE_FLOOR)


def decoupled_noise(conf: Column, temperature: float, u: Column) -> Column:
    """R12, decoupled form: noise on the log confidence; the confidence itself at temperature 0."""
    if temperature == 0:
        return conf
    return F.ln(conf + NOISE_FLOOR) + gumbel(u) * temperature


def stochastic_noise(conf: Column, temperature: float, u: Column) -> Column:
    """R12, stochastic form: noise on the confidence, on finite entries only."""
    if temperature == 0:
        return conf
    finite = conf > F.lit(float("-inf"))
    return F.when(finite, conf + gumbel(u) * temperature).otherwise(conf)


def remask_confidence(logits: Column, chosen: Column, mode: str, u: Column, temperature: float = 0.0) -> Column:
    """K3: score by which positions are picked for unmasking."""
    if mode == "low_confidence":
        return probability_of(logits, chosen)
    if mode == "decoupled":
        return decoupled_noise(top_probability(logits), temperature, u)
    if mode == "random":
        return u
    raise ValueError(f"Unknown remasking mode: {mode}")
