"""Joining per-key results back to their rows when one key may hold a large share of them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollscore.session import cut_lineage

ROW_COUNT = "n_rows"
SPLIT_ROWS = 1_000_000
SPREAD = 1 << 16
#: Keys matched by broadcast at most: the size of the broadcast does not depend on the data.
HOT_KEYS = 1024


def attach(
    rows: DataFrame, stats: DataFrame, keys: Sequence[str], split_rows: int = SPLIT_ROWS, many: bool = False
) -> DataFrame:
    """Left-join ``stats`` (one row per key, with the key's row count ``n_rows``) to ``rows``.

    The ``HOT_KEYS`` largest keys above ``split_rows`` rows are matched by broadcast; their rows
    go through the shuffle under a split number taken from the whole row instead of together, so
    rows equal in every column stay together. All other keys meet in an ordinary shuffle join,
    where adaptive execution splits what is still large. Without hot keys the broadcast side is
    empty and adaptive execution drops that join. The result is the same for any ``split_rows``.
    NULL keys match each other.

    ``stats`` is built by ``groupBy``, so it is combined before its own shuffle. Both uses
    have the same columns, which lets Spark run that shuffle once. ``many`` says that a key has many rows: a partition's
    ``stats`` then go into a hash table instead of all its rows into a sort.
    """
    keys = list(keys)
    values = [c for c in stats.columns if c not in keys]
    packed = F.struct(*[F.col(c) for c in values])
    names = [f"_key{i}" for i in range(len(keys))]
    renamed = [F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]
    # Rows of cold keys have split 0. It is computed from the count, not a literal, so that it
    # stays part of the shuffle key.
    split = F.least(F.lit(0), F.col(ROW_COUNT)).cast("bigint")
    largest = stats.where(F.col(ROW_COUNT) > split_rows).orderBy(F.desc(ROW_COUNT), *keys).limit(HOT_KEYS)
    hot = largest.select(*renamed, packed.alias("_hot"))
    cold = stats.select(*renamed, split.alias("_cold_split"), packed.alias("_cold"))
    scattered = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(SPREAD)) + 1
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)])
    spread = rows.join(F.broadcast(hot), same, "left").drop(*names).withColumn(
        "_split", F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(scattered).cast("bigint")
    )
    if many:
        cold = cold.hint("shuffle_hash")
    joined = spread.join(cold, same & (F.col("_split") == F.col("_cold_split")), "left")
    return joined.select(
        *[F.col(c) for c in rows.columns],
        *[F.coalesce(F.col("_hot")[c], F.col("_cold")[c]).alias(c) for c in values],
    )


def attach_few(rows: DataFrame, stats: DataFrame, keys: Sequence[str], split_rows: int = SPLIT_ROWS) -> DataFrame:
    """``attach`` for keys that are mostly few, as the batches of a run are.

    ``stats`` is computed first and kept. With ``HOT_KEYS`` keys at most it is broadcast whole: rows stay in the tasks that
    made them, so what is summed of them later is still combined there. More keys go through ``attach``.
    """
    kept = cut_lineage(stats)
    if len(kept.select(*keys).take(HOT_KEYS + 1)) > HOT_KEYS:
        return attach(rows, kept, keys, split_rows, many=True)
    values = [c for c in stats.columns if c not in keys]
    names = [f"_key{i}" for i in range(len(keys))]
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)])
    named = kept.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], *values)
    return rows.join(F.broadcast(named), same, "left").select(*rows.columns, *values)


def attach_aggregates(
    rows: DataFrame, keys: Sequence[str], split_rows: int = SPLIT_ROWS, many: bool = False, **aggregates: Column
) -> DataFrame:
    """Repeat group aggregates on each row, like a window without an order, but safe under skew."""
    stats = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(ROW_COUNT), *[c.alias(name) for name, c in aggregates.items()]
    )
    return attach(rows, stats, keys, split_rows, many).drop(ROW_COUNT)


def with_counts(values: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add to one-row-per-key ``values`` how many ``rows`` each key has, ready for ``attach``."""
    keys = list(keys)
    counts = rows.groupBy(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias(ROW_COUNT))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)])
    return values.join(counts, same, "inner").select(*values.columns, ROW_COUNT)
