"""Ordered passes over keys of any size.

A window over a key sorts all its rows in one task. Here rows are range-partitioned by key and order, so that a hot
key is cut into as many pieces as it needs; windows run inside the pieces, and what a piece needs from those before
it (a last value, a count, a sum) is carried over from one small row per piece.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from rollscore.session import cut_lineage

PIECE = "_piece"


def pieces(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``rows`` with the number of their piece: pieces rise along ``keys`` and ``order``, and hold rows in that order.

    Written to the checkpoint folder, as the bounds of the pieces have to be the same for all that reads them. Rows equal
    in ``keys`` and ``order`` are in one piece, so end ``order`` with something that tells them apart where many can be.
    """
    by = [*[F.col(k) for k in keys], *order]
    placed = rows.repartitionByRange(*by).withColumn(PIECE, F.spark_partition_id()).sortWithinPartitions(*by)
    return cut_lineage(placed)


def inside(keys: Sequence[str], order: Sequence[Column]) -> WindowSpec:
    """A window over a key's rows in one piece."""
    return Window.partitionBy(PIECE, *keys).orderBy(*order)


def carry(placed: DataFrame, keys: Sequence[str], of_piece: dict[str, Column], before: dict[str, Column]) -> DataFrame:
    """``placed`` with what the earlier pieces of a row's key say.

    ``of_piece`` aggregates a piece of a key to named values; ``before`` makes the carried columns of them, by
    aggregates that run over the key's earlier pieces (``F.last(.., True)``, ``F.sum``). They are NULL in a key's first piece.
    """
    keys = list(keys)
    earlier = Window.partitionBy(*keys).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    each = placed.groupBy(*keys, PIECE).agg(*[c.alias(name) for name, c in of_piece.items()])
    names = [f"_carry{i}" for i in range(len(keys))]
    told = each.select(
        *[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(PIECE).alias("_carry_piece"),
        *[c.over(earlier).alias(name) for name, c in before.items()],
    )
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)]
    joined = placed.join(told, reduce(and_, [*same, F.col(PIECE) == F.col("_carry_piece")]))
    return joined.drop(*names, "_carry_piece")
