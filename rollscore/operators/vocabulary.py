"""Logits in chunks of the vocabulary: no row is wider than a chunk.

A chunk table has one row per (position, chunk): the position's keys, ``chunk`` (its number from 0)
and ``logits`` (``width`` values of the vocabulary, fewer in the last chunk). Each chunk is reduced
within its row to a state of a few numbers; only states are shuffled, and a position's states, one
per chunk of a fixed vocabulary, are merged in the order of the chunks. Two logged passes are guided
chunk by chunk with ``likelihood.combine_passes`` under keys that hold ``chunk``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollscore.functions.logits import as_doubles, top_two
from rollscore.functions.text import let
from rollscore.operators.segments import segment_of

LOW = float("-inf")
SCORES = ("logp", "max_logit", "top_prob", "neg_entropy", "margin", "token")


def split_logits(logits: DataFrame, width: int) -> DataFrame:
    """Cut whole arrays into rows of at most ``width`` values.

    A NULL or empty array becomes one row without a chunk number, so that its position is not lost.
    """
    if width < 1:
        raise ValueError(f"A chunk needs at least one value, not {width}")
    size = F.size("logits")
    numbers = F.when(size > 0, F.sequence(F.lit(0), F.floor((size - 1) / F.lit(width)).cast("int")))
    parts = F.transform(numbers, lambda n: F.struct(
        n.alias("chunk"), F.slice("logits", n * width + 1, F.lit(width)).alias("logits")
    ))
    kept = [c for c in logits.columns if c != "logits"]
    return logits.select(*kept, F.inline_outer(parts))


def _state(logits: Column, chunk: Column, target: Column, width: int) -> Column:
    """A chunk's maximum and runner-up, where the maximum is, and sums of ``exp(x - maximum)``."""
    start = chunk.cast("bigint") * width

    def sums(values: Column, two: Column) -> Column:
        finite = F.filter(values, lambda x: x > LOW)
        zero = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("weighted"))
        return F.aggregate(finite, zero, lambda s, x: F.struct(
            (s["total"] + F.exp(x - two["first"])).alias("total"),
            (s["weighted"] + F.exp(x - two["first"]) * (x - two["first"])).alias("weighted"),
        ))

    return let(as_doubles(logits), lambda values: let(top_two(values), lambda two: let(sums(values, two), lambda s: F.struct(
        chunk.cast("bigint").alias("chunk"),
        F.size(values).cast("bigint").alias("n"),
        two["first"].alias("first"),
        two["second"].alias("second"),
        (start + F.array_position(values, two["first"]) - 1).alias("best"),
        s["total"].alias("total"),
        s["weighted"].alias("weighted"),
        F.when((target >= start) & (target < start + F.size(values)), F.get(values, (target - start).cast("int"))).alias("target"),
    ))))


def _merged(a: Column, b: Column) -> Column:
    """The state of two neighbouring chunks together; ``a`` comes first and wins ties."""

    def together(top: Column) -> Column:
        # A part without a finite value has sums of 0, whatever they are scaled by.
        down = [F.when(s["first"] > LOW, s["first"] - top).otherwise(0.0) for s in (a, b)]
        return F.struct(
            b["chunk"].alias("chunk"),
            (a["n"] + b["n"]).alias("n"),
            top.alias("first"),
            F.greatest(a["second"], b["second"], F.least(a["first"], b["first"])).alias("second"),
            F.when(a["first"] >= b["first"], a["best"]).otherwise(b["best"]).alias("best"),
            (a["total"] * F.exp(down[0]) + b["total"] * F.exp(down[1])).alias("total"),
            (
                (a["weighted"] + a["total"] * down[0]) * F.exp(down[0]) + (b["weighted"] + b["total"] * down[1]) * F.exp(down[1])
            ).alias("weighted"),
            F.coalesce(a["target"], b["target"]).alias("target"),
        )

    return let(F.greatest(a["first"], b["first"]), together)


def chunk_scores(
    chunks: DataFrame, keys: Sequence[str], width: int, target: str | None = None, vocabulary: int | None = None
) -> DataFrame:
    """R8, R9, K2 of positions whose logits lie in chunks: ``keys`` and the columns ``SCORES``.

    ``target`` names the column of the 0-based target token, the same on all of a position's rows;
    without it ``logp`` is NULL. ``token`` is the first of equal maxima. A position has NULLs if a
    chunk is missing or repeated, has a NULL logit, or (with ``vocabulary``) if its logits are not
    as many, and if all its logits are minus infinity. Single logits of minus infinity weigh nothing.
    """
    wanted = F.lit(None).cast("bigint") if target is None else F.col(target).cast("bigint")
    usable = F.col("logits").isNotNull() & (F.size("logits") > 0) & ~F.exists("logits", lambda x: x.isNull())
    state = F.when(usable, _state(F.col("logits"), F.col("chunk"), wanted, width))
    states = chunks.select(*keys, state.alias("_state")).groupBy(*keys).agg(
        F.array_sort(F.collect_list("_state")).alias("_states"), F.count(F.lit(1)).alias("_rows")
    )
    numbers = F.transform("_states", lambda s: s["chunk"])
    whole = (F.size("_states") == F.col("_rows")) & (numbers == F.sequence(F.lit(0).cast("bigint"), F.col("_rows") - 1))
    # All chunks but the last are full, or places in the vocabulary would be off.
    whole &= F.forall(F.slice("_states", F.lit(1), F.greatest(F.size("_states") - 1, F.lit(0))), lambda s: s["n"] == width)
    first = F.get("_states", F.lit(0))
    rest = F.slice("_states", F.lit(2), F.greatest(F.size("_states") - 1, F.lit(0)))
    merged = states.select(*keys, F.when(whole, F.aggregate(rest, first, _merged)).alias("_all"))
    complete = F.col("_all.first") > LOW
    if vocabulary is not None:
        complete &= F.col("_all.n") == vocabulary
    s = F.when(complete, F.col("_all"))
    return merged.select(*keys, s.alias("_all")).select(
        *keys,
        (F.col("_all.target") - F.col("_all.first") - F.ln("_all.total")).alias("logp"),
        F.col("_all.first").alias("max_logit"),
        (1.0 / F.col("_all.total")).alias("top_prob"),
        (F.col("_all.weighted") / F.col("_all.total") - F.ln("_all.total")).alias("neg_entropy"),
        ((1.0 - F.exp(F.col("_all.second") - F.col("_all.first"))) / F.col("_all.total")).alias("margin"),
        F.col("_all.best").alias("token"),
    )


def segment_token_logps(
    chunks: DataFrame, steps: int, segments: int, width: int, vocabulary: int | None = None
) -> DataFrame:
    """T4 over chunks: each token's log-probability in the segment that reveals it.

    ``chunks`` carries ``token_id`` and ``unmask_step``; other segments' rows are dropped in the scan.
    """
    own = segment_of(F.col("unmask_step"), steps, segments) == F.col("segment")
    scores = chunk_scores(chunks.where(own), ["seq_id", "segment", "pos"], width, "token_id", vocabulary)
    return scores.select("seq_id", "segment", "pos", "logp")
