"""Competitors' log-sum-exp for any number of steps and any temperature, by a scan over pieces.

A step's competitors are summed first, in a fixed number of values a step whatever their exponents; then each
step takes what all later steps of its key add up to. A key's steps lie in pieces of a range partitioning; a piece is
scanned from its latest step down, and starts from the sum of the pieces before it. Memory does not grow with a key.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollscore.plans.ordered import carry, inside, pieces

#: Width of the exponent ranges that are summed apart; exp of it is far above the precision of a double.
EXP_RANGE = 512.0
NOTHING = float("-inf")


def _log_add(a: Column, b: Column) -> Column:
    """log(exp(a) + exp(b)); minus infinity weighs nothing."""
    top, low = F.greatest(a, b), F.least(a, b)
    return F.when(low == NOTHING, top).otherwise(top + F.log1p(F.exp(low - top)))


def log_sums(rows: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """keys, log_sum, n: the log-sum-exp of ``value``, combined map-side; NaN if a value is NULL.

    Values are summed per range of exponents. Of a key's ranges only the highest and the one below it weigh anything; one of
    them is even and one is odd, so the highest of each kind is all that has to be kept.
    """
    number = F.floor(F.col("_v") / F.lit(EXP_RANGE))
    closed = F.abs(F.col("_v")) == float("inf")
    ranged = rows.withColumn("_v", value).withColumn("_range", F.when(closed, F.lit(0)).otherwise(number).cast("bigint"))
    parts = ranged.groupBy(*keys, "_range").agg(
        F.sum(F.exp(F.col("_v") - F.col("_range") * F.lit(EXP_RANGE))).alias("_total"), F.count(F.lit(1)).alias("_n"),
        F.max(F.col("_v").isNull()).alias("_lost"),
    )
    # Competitors of minus infinity alone leave a total of 0.
    one = F.when(F.col("_total") > 0, F.struct("_range", (F.col("_range") * F.lit(EXP_RANGE) + F.ln("_total")).alias("log")))
    even = F.pmod(F.col("_range"), F.lit(2)) == 0
    both = parts.groupBy(*keys).agg(
        F.max(F.when(even, one)).alias("_even"), F.max(F.when(~even, one)).alias("_odd"), F.sum("_n").alias("n"), F.max("_lost").alias("_lost"),
    )
    total = _log_add(F.coalesce(F.col("_even.log"), F.lit(NOTHING)), F.coalesce(F.col("_odd.log"), F.lit(NOTHING)))
    return both.select(*keys, F.when(F.col("_lost"), F.lit(float("nan"))).otherwise(total).alias("log_sum"), "n")


def _scanned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a piece with ``_so_far``: the log-sum-exp of the rows of their key up to them."""
    key, state = None, NOTHING
    for batch in batches:
        keys, total = batch.column("_key").to_numpy(), batch.column("log_sum").to_numpy(zero_copy_only=False).astype(float).copy()
        if not len(keys):
            continue
        with np.errstate(invalid="ignore"):
            if keys[0] == key:
                total[0] = np.logaddexp(total[0], state)
            group = np.cumsum(np.concatenate([[False], keys[1:] != keys[:-1]]))
            shift, longest = 1, int(np.bincount(group).max())
            while shift < longest:
                same = group[shift:] == group[:-shift]
                total[shift:] = np.where(same, np.logaddexp(total[shift:], total[:-shift]), total[shift:])
                shift *= 2
        key, state = keys[-1], total[-1]
        yield batch.append_column("_so_far", pa.array(total))


def later_log_sums(rows: DataFrame, keys: Sequence[str], step: str, value: Column) -> DataFrame:
    """keys, step, n, others: for each step of a key, the log-sum-exp of ``value`` over all later steps.

    ``n`` counts the rows of the step. ``others`` is minus infinity where no later step weighs anything, and NULL where a
    later value is NULL. NULL steps take no part.
    """
    keys = list(keys)
    sums = log_sums(rows.where(F.col(step).isNotNull()), [*keys, step], value)
    placed = pieces(sums, keys, [F.desc(step)]).withColumn("_key", F.xxhash64(*keys))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema]
    scanned = placed.mapInArrow(_scanned, ", ".join([*kinds, "_so_far double"]))
    told = carry(scanned, keys, {"_whole": F.max("_so_far")}, {"_earlier": F.collect_list("_whole")})
    # A key has no more earlier pieces than there are partitions.
    earlier = F.aggregate(F.coalesce("_earlier", F.array().cast("array<double>")), F.lit(NOTHING), _log_add)
    inclusive = _log_add(F.col("_so_far"), earlier)
    # What is later than a step is what its key's previous row includes.
    others = F.coalesce(F.lag(inclusive).over(inside(keys, [F.desc(step)])), earlier)
    return told.select(*keys, step, "n", F.when(~F.isnan(others), others).alias("others"))
