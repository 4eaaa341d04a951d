"""Connected components of a graph given by its edges."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollscore.session import checkpoint_dir

MAX_ROUNDS = 100
#: Mixed into join keys, so that neither side of a join reuses the partitions of an aggregate: both
#: are then exchanged, and adaptive execution can split the rows of a hot key.
MIX = 0x5851F42D4C957F2D


def _follow(edges: DataFrame, lows: DataFrame, end: str) -> DataFrame:
    """``edges`` with ``low``: the smallest neighbour of the node in column ``end``, if it has one."""
    keyed = edges.withColumn("_k", F.col(end).bitwiseXOR(F.lit(MIX)))
    found = lows.select(F.col("node").bitwiseXOR(F.lit(MIX)).alias("_k"), "low")
    return keyed.join(found, "_k", "left").drop("_k")


def _lows(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("low"))


def _written(edges: DataFrame) -> DataFrame:
    """``edges`` as a table of its own: a checkpoint would hand estimated sizes on, whose digits double with each round."""
    path = f"{checkpoint_dir(edges.sparkSession)}/links-{uuid.uuid4()}"
    edges.write.parquet(path)
    return edges.sparkSession.read.parquet(path)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the smallest node reachable, for every node with an edge to another.

    Edges point from the larger node to the smaller. A round moves each edge to the smallest
    neighbour of its lower end, then each node's edges to its smallest neighbour, until nothing
    changes: a logarithmic number of rounds in the length of the longest path. Each round is written
    to the checkpoint folder. Null ends and loops are left out.
    """
    x, y = F.col(a).cast("bigint"), F.col(b).cast("bigint")
    now = edges.select(F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo"), (x != y).alias("_two"))
    now = _written(now.where("_two").select("hi", "lo").distinct())
    state = _state(now)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        jumped = _follow(now, _lows(now), "lo").select("hi", F.coalesce("low", "lo").alias("lo")).distinct()
        near = _follow(jumped, _lows(jumped), "hi")
        moved = near.select(
            F.when(F.col("lo") == F.col("low"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("low").alias("lo")
        )
        # A node with several neighbours keeps an edge to the smallest by the row of that neighbour.
        now = _written(moved.where("hi <> lo").distinct())
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"Components did not settle in {MAX_ROUNDS} rounds")
    own = now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return own.unionByName(roots)
