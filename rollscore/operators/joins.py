"""Joins on order instead of equality: the latest row at or before another (J7), and rows inside intervals."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollscore.plans.ordered import PIECE, carry, inside, pieces
from rollscore.session import cut_lineage

HOWS = ("left", "inner")


def as_of(
    left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str, values: Sequence[str],
    ties: Sequence[str] = (), within: Column | None = None, allow_equal: bool = True, how: str = "left",
) -> DataFrame:
    """Each row of ``left`` with ``values`` of the latest row of ``right`` of its key, at or before its own time.

    With ``allow_equal`` false the other row is strictly earlier. Of several rows at one time the largest by ``ties`` counts,
    then by ``values``. ``within``, an interval or a number, limits how far back the other row lies. A left row without a
    partner has NULLs, or goes with ``how="inner"``; a NULL key or time has no partner, as in any join. Repeated left rows stay.
    ``values`` must not name a column of ``left``.

    Both sides are one range-partitioned table; a key is cut where it is large, and each piece starts from the last right
    row of the pieces before it. No pair of rows is formed, and no key is sorted in one task.
    """
    if how not in HOWS:
        raise ValueError(f"Unknown kind of as-of join: {how}")
    if set(values) & set(left.columns):
        raise ValueError(f"Columns of both sides: {sorted(set(values) & set(left.columns))}")
    keys = [f"_k{i}" for i in range(len(on))]
    own = F.struct(*[F.col(c) for c in left.columns])
    other = F.struct(F.col(right_time).alias("_time"), *[F.col(c) for c in ties], *[F.col(c).alias(f"_v{i}") for i, c in enumerate(values)])
    known = reduce(and_, [F.col(c).isNotNull() for c in (*on, right_time)])
    rights = right.where(known).select(
        *[F.col(k).alias(n) for k, n in zip(on, keys, strict=True)], F.col(right_time).alias("_t"),
        F.lit(0 if allow_equal else 1).alias("_side"), F.lit(None).cast(left.schema).alias("_left"), other.alias("_right"),
    )
    lefts = left.select(
        *[F.col(k).alias(n) for k, n in zip(on, keys, strict=True)], F.col(left_time).alias("_t"),
        F.lit(1 if allow_equal else 0).alias("_side"), own.alias("_left"),
        F.lit(None).cast(rights.schema["_right"].dataType).alias("_right"),
    )
    # Left rows of one time need no order; their digest spreads them over pieces.
    order = [F.col("_t"), F.col("_side"), F.col("_right"), F.xxhash64("_left")]
    placed = pieces(lefts.unionByName(rights), keys, order)
    told = carry(placed, keys, {"_last": F.max("_right")}, {"_before": F.last("_last", True)})
    latest = F.coalesce(F.last("_right", True).over(inside(keys, order)), F.col("_before"))
    met = told.withColumn("_latest", latest).where(F.col("_left").isNotNull())
    if within is not None:
        met = met.withColumn("_latest", F.when(F.col("_t") - within <= F.col("_latest._time"), F.col("_latest")))
    if how == "inner":
        met = met.where(F.col("_latest").isNotNull())
    return met.select("_left.*", *[F.col(f"_latest._v{i}").alias(c) for i, c in enumerate(values)])


#: Widths of bins are powers of this: an interval lies in two bins of its level at most.
LEVEL = 4


def _level(width: Column) -> Column:
    """The level whose bins are at least ``width`` wide."""
    exact = F.ceil(F.log(F.greatest(width, F.lit(1)).cast("double")) / F.log(F.lit(float(LEVEL)))).cast("int")
    # Logarithms round: a level too low is raised.
    return F.when(F.pow(F.lit(float(LEVEL)), exact) < width, exact + 1).otherwise(exact)


def _bin(value: Column, level: Column) -> Column:
    return F.floor(value.cast("double") / F.pow(F.lit(float(LEVEL)), level)).cast("bigint")


def interval_join(
    points: DataFrame, intervals: DataFrame, point: str, low: str, high: str, on: Sequence[str] = (),
    low_open: bool = True, high_open: bool = False, how: str = "inner",
) -> DataFrame:
    """Each row of ``points`` with every row of ``intervals`` it lies in; intervals may overlap and differ in width.

    Intervals are open below and closed above, as segments are, unless told otherwise. Ends are whole numbers; a NULL end is
    open without limit. A NULL point or key lies in no interval; with ``how="left"`` such rows, and points in no interval,
    have NULLs. ``low``, ``high`` and the other columns of ``intervals`` follow those of ``points``; names must differ.

    An interval goes to the level whose bins are at least as wide as itself, and there to the one or two bins it touches.
    A point goes to its bin of every level in use, of which there are 32 at most; so the join is on equality of bin, level
    and key, and what it compares in vain is bounded by the points beside an interval in its bins. Ends without limit are
    moved to the first and last point. Bins that hold very many rows are split by adaptive execution.
    """
    if how not in HOWS:
        raise ValueError(f"Unknown kind of interval join: {how}")
    others = [c for c in intervals.columns if c not in on]
    if set(others) & set(points.columns):
        raise ValueError(f"Columns of both sides: {sorted(set(others) & set(points.columns))}")
    extent = points.agg(F.min(point).cast("bigint").alias("first"), F.max(point).cast("bigint").alias("last")).first()
    first, last = (0, 0) if extent.first is None else extent
    # The whole numbers that lie in an interval, within reach of the points.
    start = F.greatest(F.coalesce(F.col(low).cast("bigint") + int(low_open), F.lit(first)), F.lit(first))
    end = F.least(F.coalesce(F.col(high).cast("bigint") - int(high_open), F.lit(last)), F.lit(last))
    held = reduce(and_, [F.col(k).isNotNull() for k in on], start <= end)
    keys = [f"_k{i}" for i in range(len(on))]
    placed = intervals.where(held).select(
        *[F.col(k).alias(n) for k, n in zip(on, keys, strict=True)], *[F.col(c) for c in others],
        start.alias("_start"), end.alias("_end"), _level(end - start + 1).alias("_level"),
    )
    touched = F.array_distinct(F.array(_bin(F.col("_start"), F.col("_level")), _bin(F.col("_end"), F.col("_level"))))
    placed = placed.withColumn("_bin", F.explode(touched))
    levels = sorted(r[0] for r in placed.select("_level").distinct().collect())
    numbered = points.withColumn("_row", F.struct(*points.columns)).select(
        "_row", *[F.col(k).alias(f"_p{i}") for i, k in enumerate(on)], F.col(point).cast("bigint").alias("_point")
    )
    each = numbered.withColumn("_at", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>"))).withColumn(
        "_in", _bin(F.col("_point"), F.col("_at"))
    )
    same = [F.col("_at") == F.col("_level"), F.col("_in") == F.col("_bin"), F.col("_point").between(F.col("_start"), F.col("_end"))]
    same += [F.col(f"_p{i}") == F.col(k) for i, k in enumerate(keys)]
    met = each.join(placed, reduce(and_, same)).select("_row.*", *others)
    if how == "inner":
        return met
    alone = numbered.join(
        met.select(F.struct(*points.columns).alias("_met")).distinct(), F.col("_row").eqNullSafe(F.col("_met")), "left_anti"
    )
    return met.unionByName(alone.select("_row.*", *[F.lit(None).cast(intervals.schema[c].dataType).alias(c) for c in others]))


def interval_sums(
    points: DataFrame, intervals: DataFrame, point: str, low: str, high: str, sums: dict[str, str],
    low_open: bool = True, high_open: bool = False,
) -> DataFrame:
    """J5, summed: each row of ``intervals`` with its number of ``points``, the first and the last of them, and sums over them.

    What grouping ``interval_join`` by interval gives, with ``n`` 0 for intervals without points. ``sums`` names sums of whole
    numbers and their columns. An interval's sums are the difference of two running sums, so no pair of point and interval is
    formed and the width of intervals costs nothing: equal points are summed first, then points and ends are one
    range-partitioned table, each piece of which starts from the sums of the pieces before it.
    """
    values = [f"_sum{i}" for i in range(len(sums))]
    taken = set(intervals.columns) & {"n", "first", "last", *sums}
    if taken:
        raise ValueError(f"Columns of both sides: {sorted(taken)}")
    at = F.col(point).cast("bigint")
    grouped = points.where(at.isNotNull()).groupBy(at.alias("_at")).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(F.col(c).cast("bigint")).alias(v) for v, c in zip(values, sums.values(), strict=True)],
    )
    # The last whole number before the interval, and its own last one; NULL without limit.
    numbered = intervals.withColumn("_row", F.monotonically_increasing_id())
    numbered = cut_lineage(numbered.withColumns({
        "_before": F.col(low).cast("bigint") - int(not low_open), "_until": F.col(high).cast("bigint") - int(high_open),
    }))
    ends = numbered.select(F.explode(F.array("_before", "_until")).alias("_at")).where("_at is not null").distinct()
    # Points come before ends of the same number.
    none = [F.lit(None).cast("bigint").alias(c) for c in ("_n", *values)]
    both = grouped.select("_at", "_n", *values, F.lit(0).alias("_end")).unionByName(ends.select("_at", *none, F.lit(1).alias("_end")))
    order = [F.col("_at"), F.col("_end")]
    placed = pieces(both, [], order)
    own_point = F.when(F.col("_end") == 0, F.col("_at"))
    totals = ["_n", *values]
    of_piece = {f"_all{c}": F.sum(c) for c in totals} | {"_top": F.max(own_point), "_bottom": F.min(own_point)}
    each = placed.groupBy(PIECE).agg(*[c.alias(name) for name, c in of_piece.items()])
    # One row per piece.
    earlier = Window.orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.orderBy(F.desc(PIECE)).rowsBetween(Window.unboundedPreceding, -1)
    told = each.select(
        F.col(PIECE).alias("_of"), *[F.sum(f"_all{c}").over(earlier).alias(f"_all{c}") for c in totals],
        F.max("_top").over(earlier).alias("_top"), F.min("_bottom").over(later).alias("_bottom"),
    )
    so_far = inside([], order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    to_come = inside([], [c.desc() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    running = placed.join(F.broadcast(told), F.col(PIECE) == F.col("_of")).select(
        "_at", "_end", *[(F.coalesce(F.sum(c).over(so_far), zero) + F.coalesce(f"_all{c}", zero)).alias(c) for c in totals],
        F.coalesce(F.max(own_point).over(so_far), F.col("_top")).alias("_top"),
        F.coalesce(F.min(own_point).over(to_come), F.col("_bottom")).alias("_bottom"),
    ).where("_end = 1")
    whole = grouped.agg(
        F.coalesce(F.sum("_n"), zero).alias("_whole_n"), *[F.coalesce(F.sum(v), zero).alias(f"_whole{v}") for v in values],
        F.min("_at").alias("_least"), F.max("_at").alias("_most"), F.least(F.count(F.lit(1)), zero).alias("_none"),
    )

    def side(letter: str) -> DataFrame:
        return running.select(*[F.col(c).alias(f"{letter}{c}") for c in ("_at", *totals, "_top", "_bottom")])

    met = (
        numbered.join(side("a"), F.col("_before") == F.col("a_at"), "left").join(side("b"), F.col("_until") == F.col("b_at"), "left")
        .join(F.broadcast(whole), F.least(F.col("_row"), zero) == F.col("_none"))  # one row, met by a key that is always 0
    )

    def between(c: str, total: str) -> Column:
        return F.when(F.col("_until").isNull(), F.col(total)).otherwise(F.col(f"b{c}")) - F.coalesce(f"a{c}", zero)

    # An interval that ends before it starts holds nothing.
    number = F.greatest(between("_n", "_whole_n"), zero)
    first = F.when(F.col("_before").isNull(), F.col("_least")).otherwise(F.col("a_bottom"))
    last = F.when(F.col("_until").isNull(), F.col("_most")).otherwise(F.col("b_top"))
    held = F.col("n") > 0
    return met.withColumn("n", number).select(
        *intervals.columns, "n", F.when(held, first).alias("first"), F.when(held, last).alias("last"),
        *[F.when(held, between(v, f"_whole{v}")).alias(name) for v, name in zip(values, sums, strict=True)],
    )
