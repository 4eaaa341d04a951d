"""Which examples of a run are missing, repeated or outside its range, as intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollscore.plans.ordered import carry, inside, pieces

KINDS = ("missing", "repeated", "outside")


def _islands(rows: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """Longest runs of neighbouring indices: an index less its place among the key's rows is the same all along one."""
    order = [F.col("_index")]
    counted = carry(rows, keys, {"_n": F.count(F.lit(1))}, {"_earlier": F.sum("_n")})
    place = F.row_number().over(inside(keys, order)) + F.coalesce("_earlier", F.lit(0))
    return counted.withColumn("_island", F.col("_index") - place).groupBy(*keys, "_island").agg(
        F.lit(kind).alias("kind"), F.min("_index").alias("first_index"), F.max("_index").alias("last_index")
    ).drop("_island")


def index_gaps(
    rows: DataFrame, sizes: DataFrame, keys: Sequence[str] = ("run",), index: str = "example_index", size: str = "dataset_size"
) -> DataFrame:
    """keys, kind, first_index, last_index, n: the largest intervals of indices that are not there exactly once.

    A key of ``sizes`` should have each index from 0 to ``size`` - 1 once. ``kind`` tells indices that are ``missing``, that
    are there but ``repeated``, and that lie ``outside``. Keys that ``sizes`` does not know, and NULL sizes, expect nothing: all their
    indices are outside. A NULL index is no index. Keys are matched NULL to NULL; one row of ``sizes`` per key.

    Indices are counted first, so copies cost nothing later. A run is cut into ranges of its indices; intervals that go on
    from one range to the next are joined by carrying counts and last indices over, not by ordering a run in one task.
    """
    keys = list(keys)
    if sizes.columns != [*keys, size]:
        sizes = sizes.select(*keys, size)
    counted = rows.where(F.col(index).isNotNull()).groupBy(*keys, F.col(index).cast("bigint").alias("_index")).agg(
        F.count(F.lit(1)).alias("_copies")
    )
    placed = pieces(counted, keys, [F.col("_index")])
    expected = sizes.select(*[F.col(k).alias(f"_s{i}") for i, k in enumerate(keys)], F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("_size"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_s{i}"))
    known = placed.join(expected, same, "left").drop(*[f"_s{i}" for i in range(len(keys))])
    within = (F.col("_index") >= 0) & (F.col("_index") < F.coalesce("_size", F.lit(0)))
    good = known.where(within)
    repeated = _islands(good.where("_copies > 1").drop("_copies", "_size"), keys, "repeated")
    outside = _islands(known.where(~within).drop("_copies", "_size"), keys, "outside")

    # Missing: between an index and the one before it, before the first and after the last.
    told = carry(good, keys, {"_last": F.max("_index")}, {"_before": F.max("_last")})
    before = F.coalesce(F.lag("_index").over(inside(keys, [F.col("_index")])), F.col("_before"), F.lit(-1))
    between = told.select(*keys, (before + 1).alias("first_index"), (F.col("_index") - 1).alias("last_index"))
    last = good.groupBy(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)]).agg(F.max("_index").alias("_last"))
    match = F.lit(True)
    for i in range(len(keys)):
        match = match & F.col(f"_s{i}").eqNullSafe(F.col(f"_g{i}"))
    after = expected.join(last, match, "left").select(
        *[F.col(f"_s{i}").alias(k) for i, k in enumerate(keys)], (F.coalesce("_last", F.lit(-1)) + 1).alias("first_index"),
        (F.col("_size") - 1).alias("last_index"),
    )
    missing = between.unionByName(after).where("first_index <= last_index").withColumn("kind", F.lit("missing"))
    found = missing.unionByName(repeated).unionByName(outside)
    return found.select(*keys, "kind", "first_index", "last_index", (F.col("last_index") - F.col("first_index") + 1).alias("n"))
