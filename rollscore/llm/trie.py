"""The prefix trie of conversations, from sorted shards of padded turn-id matrices.

A turn is a 128-bit id of its role and text, with its number of words; texts are not moved. Conversations are
range-partitioned and sorted by their ids, so that a node of the trie is a run of neighbouring rows, and the
sorted rows are cut into shards. In a shard:

* rows become a padded matrix of turn numbers, in panels of ``PANEL`` columns, sorted by lexsort;
* a column differs from the row before or not; these masks, OR-accumulated along the row, mark where nodes start;
* at every depth, reduceat over those starts sums what the rows of each node bring along.

Rows bring along sums that add up over any cut: whether they are the last of a sequence that nothing follows,
the nodes that start in them one level deeper, and the words that a shared prefix saves from here on. For that a
shard knows the row before it and the row after it. Nodes that cross the edge of a shard leave parts, which are
summed by the digest of their prefix; all others are complete where they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollscore.llm.batches import list_arrays
from rollscore.plans.skew import ROW_COUNT, attach
from rollscore.session import cut_lineage

#: Turns (and rows) in a shard, and columns of a matrix at a time.
SHARD_TURNS = 1 << 16
PANEL = 64
WORD = r"[^\x20\x09-\x0D]+"

SHARDED = "shard bigint, part bigint, number bigint, conv_id bigint, ids array<bigint>, words array<int>"
NODES = (
    "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
    "saved_words bigint, ends_sha256 binary, key binary, parent_key binary, shard bigint, ends binary"
)
NOTHING = hashlib.sha256(b"").digest()


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id, ids, words: each conversation's turns in order, two 64-bit numbers and a count of words a turn.

    ``turns`` has conv_id, turn, role and text. A null role or text is empty, a null turn comes first, and turns of one
    number are ordered by their ids. Rows without a conv_id take no part, repeated rows are turns of their own, and
    other columns are left out. A conversation is one row here, of some 20 bytes a turn: it has to fit in memory.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    compact = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.struct(
            F.col("turn").alias("turn"), F.xxhash64(F.lit(1), role, text).alias("high"), F.xxhash64(F.lit(2), role, text).alias("low"),
            F.regexp_count(text, F.lit(WORD)).cast("int").alias("words"),
        ).alias("t"),
    )
    ordered = compact.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return ordered.select(
        "conv_id", F.flatten(F.transform("t", lambda t: F.array(t["high"], t["low"]))).alias("ids"),
        F.transform("t", lambda t: t["words"]).alias("words"),
    )


def with_first_turns(own: DataFrame, other: Column, count: Column, most: int) -> DataFrame:
    """Each conversation's first ``count`` turns (``most`` at most) replaced by those of the conversation ``other``.

    All of them if it has fewer, none if there is no such conversation.
    """
    heads = own.select(
        F.col("conv_id").alias("_other"), F.slice("ids", 1, 2 * most).alias("_ids"), F.slice("words", 1, most).alias("_words")
    )
    asked = own.withColumn("_other", other).withColumn("_n", count.cast("int"))
    met = asked.join(heads, "_other", "left")

    def joined(head: str, tail: str, each: int) -> Column:
        n = F.col("_n") * each
        first = F.when(F.col(head).isNotNull(), F.slice(head, F.lit(1), n)).otherwise(F.slice(tail, F.lit(1), F.lit(0)))
        return F.concat(first, F.slice(tail, n + 1, F.greatest(F.size(tail) - n, F.lit(0)))).alias(tail)

    return met.select("conv_id", joined("_ids", "ids", 2), joined("_words", "words", 1))


def _shards(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows with the number of their shard: a new one after each ``size`` turns."""
    part, done, share, last = TaskContext.get().partitionId(), 0, -1, -1
    for batch in batches:
        if not batch.num_rows:
            continue
        turns = np.diff(batch.column("words").offsets.to_numpy()).astype(np.int64) + 1
        shares = (done + np.cumsum(turns) - turns) // size
        # Numbers have no gaps, though a long row can reach over several shares.
        number = last + np.cumsum(np.diff(shares, prepend=share) > 0)
        done, share, last = done + int(turns.sum()), shares[-1], number[-1]
        columns = [pa.array((part << 32) + number), pa.array(np.full(len(turns), part, np.int64)), pa.array(number)]
        yield pa.record_batch(
            columns + [batch.column(c) for c in ("conv_id", "ids", "words")], ["shard", "part", "number", "conv_id", "ids", "words"]
        )


def sharded(rows: DataFrame, size: int) -> DataFrame:
    """Conversations in the order of their ids, with shard numbers that rise along it; written once.

    Equal conversations follow each other by conv_id, so any number of them is spread over shards.
    """
    ordered = rows.select("conv_id", "ids", "words").repartitionByRange("ids", "conv_id").sortWithinPartitions("ids", "conv_id")
    return cut_lineage(ordered.mapInArrow(lambda batches: _shards(batches, size), SHARDED))


def neighbours(shards: DataFrame) -> DataFrame:
    """shard, side, ids: for each shard the row before it (side 0) and the row after it (side 1).

    The driver gets one row per partition, to know which are empty.
    """
    edges = shards.groupBy("shard", "part", "number").agg(
        F.min(F.struct("ids", "conv_id")).alias("low"), F.max(F.struct("ids", "conv_id")).alias("high")
    )
    parts = shards.groupBy("part").agg(F.max("number").alias("last")).orderBy("part").collect()
    links = [
        (here.part, here.last, before and (before.part << 32) + before.last, after and after.part << 32)
        for before, here, after in zip([None, *parts], parts, [*parts[1:], None])  # noqa: B905 - the first is one longer
    ]
    known = shards.sparkSession.createDataFrame(links, "part bigint, last bigint, before bigint, after bigint")
    placed = edges.join(known, "part").select(
        F.when(F.col("number") > 0, F.col("shard") - 1).otherwise(F.col("before")).alias("before"),
        F.when(F.col("number") < F.col("last"), F.col("shard") + 1).otherwise(F.col("after")).alias("after"), "low", "high",
    )
    told = [
        placed.select(F.col("after").alias("shard"), F.lit(0).alias("side"), "high.ids"),
        placed.select(F.col("before").alias("shard"), F.lit(1).alias("side"), "low.ids"),
    ]
    return told[0].unionByName(told[1]).where(F.col("shard").isNotNull())


def shared_turns(a: np.ndarray, b: np.ndarray) -> int:
    """How many first turns two rows of ids share."""
    n = min(len(a), len(b)) // 2
    differ = np.flatnonzero((a[:2 * n] != b[:2 * n]).reshape(n, 2).any(axis=1))
    return int(differ[0]) if len(differ) else n


class Shard:
    """The rows of a shard, sorted, with a start mark for each turn that begins a node."""

    def __init__(self, conv: np.ndarray, ids: list[np.ndarray], words: list[np.ndarray], before: np.ndarray | None) -> None:
        lengths = np.array([len(w) for w in words], np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        pairs = np.concatenate(ids).reshape(-1, 2) if len(ids) else np.empty((0, 2), np.int64)
        kind = np.dtype([("high", "<i8"), ("low", "<i8")])
        turns = np.unique(np.ascontiguousarray(pairs.astype("<i8")).view(kind).ravel(), return_inverse=True)[1]
        self.order = np.lexsort((conv,))
        marks = np.ones(len(turns), bool)  # by place in the rows as they came
        group = np.zeros(len(conv), np.int64)  # by row as it came: its prefix of the panels so far
        for first in range(0, max(1, int(lengths.max())), PANEL):
            # Rows that end just before the panel are padding all through, and come first in their group.
            at = np.flatnonzero(lengths[self.order] >= first)
            rows = self.order[at]
            width = min(PANEL, int(lengths.max()) - first)
            column = first + np.arange(width)
            inside = column[None, :] < lengths[rows, None]
            matrix = np.full(inside.shape, -1, np.int64)
            matrix[inside] = turns[(starts[rows, None] + column[None, :])[inside]]
            sort = np.lexsort((conv[rows], *matrix.T[::-1], group[rows]))
            rows, matrix, inside = rows[sort], matrix[sort], inside[sort]
            self.order[at] = rows
            change = np.ones(matrix.shape, bool)
            change[1:] = matrix[1:] != matrix[:-1]
            change[1:] |= (group[rows[1:]] != group[rows[:-1]])[:, None]
            change = np.logical_or.accumulate(change, axis=1)
            marks[(starts[rows, None] + column[None, :])[inside]] = change[inside]
            if width:
                group[rows] = np.cumsum(change[:, -1])
        order = self.order
        self.conv, self.lengths = conv[order], lengths[order]
        self.first, self.last = ids[order[0]], ids[order[-1]]
        self.base = np.concatenate([[0], np.cumsum(self.lengths)])
        moved = np.repeat(starts[:-1][order] - self.base[:-1], self.lengths) + np.arange(self.base[-1])
        self.marks, self.turns = marks[moved], turns[moved]
        flat = np.concatenate(words).astype(np.int64) if len(words) else np.empty(0, np.int64)
        self.shared = 0 if before is None else shared_turns(before, self.first)
        self.marks[:self.shared] = False
        #: Words from each place on that an earlier row has already, summed from the start of all rows.
        self.saved = np.concatenate([[0], np.cumsum(np.where(self.marks, 0, flat[moved]))])

    def leaves(self, after: np.ndarray | None) -> np.ndarray:
        """Rows whose sequence the next row neither repeats nor continues."""
        found = np.ones(len(self.conv), bool)
        longer = np.flatnonzero(self.lengths[1:] >= self.lengths[:-1])
        # The next row continues this one if the last turn of this one starts no node in the next.
        nothing = self.lengths[longer] == 0
        at = self.base[longer + 1] + self.lengths[longer] - 1
        found[longer] = ~(nothing | ~self.marks[np.where(nothing, 0, at)]) if len(self.marks) else ~nothing
        found[-1] = after is None or shared_turns(self.last, after) < self.lengths[-1]
        return found


def prefixes(ids: np.ndarray, most: int) -> list[bytes]:
    """Digests of the first 0 to ``most`` turns."""
    state, raw = xxhash.xxh3_128(), np.ascontiguousarray(ids).astype("<i8").tobytes()
    found = [state.digest()]
    for d in range(most):
        state.update(raw[16 * d:16 * d + 16])
        found.append(state.digest())
    return found


class Nodes:
    """Columns of ``NODES``, filled depth by depth."""

    def __init__(self) -> None:
        self.columns: list[list] = [[] for _ in range(12)]

    def add(self, *columns: list) -> None:
        for own, more in zip(self.columns, columns, strict=True):
            own.extend(more)

    def table(self) -> pa.Table:
        names = [c.split(" ")[0] for c in NODES.split(", ")]
        kinds = [pa.binary() if c.endswith("binary") else pa.int64() for c in NODES.split(", ")]
        return pa.table([pa.array(c, k) for c, k in zip(self.columns, kinds, strict=True)], names=names)


def _nodes(number: int, table: pa.Table, told: pa.Table) -> pa.Table:
    side = {s: row for s, row in zip(told.column("side").to_pylist(), list_arrays(told.column("ids").combine_chunks()), strict=True)}
    before, after = side.get(0), side.get(1)
    shard = Shard(
        table.column("conv_id").to_numpy(), list_arrays(table.column("ids").combine_chunks()),
        list_arrays(table.column("words").combine_chunks()), before,
    )
    conv, lengths, base = shard.conv, shard.lengths, shard.base
    leaf = shard.leaves(after)
    left = -1 if before is None else shard.shared  # nodes up to this depth began earlier
    right = -1 if after is None else shared_turns(shard.last, after)  # .. and go on
    left_keys, right_keys = prefixes(shard.first, max(left, 0)), prefixes(shard.last, max(right, 0))
    nodes = Nodes()
    rows = np.arange(len(conv))  # that reach the depth
    above, above_conv, above_open = np.zeros(len(conv), np.int64), [None], [None]
    for depth in range(int(lengths.max()) + 1):
        rows = rows[lengths[rows] >= depth]
        marks = shard.marks[base[rows] + depth - 1].copy() if depth else np.zeros(len(rows), bool)
        marks[0] = True
        begin = np.flatnonzero(marks)
        n = len(begin)
        longer = lengths[rows] > depth
        deeper = np.zeros(len(rows), np.int64)
        deeper[longer] = shard.marks[base[rows[longer]] + depth]
        saved = shard.saved[base[rows + 1]] - shard.saved[base[rows] + max(depth - 1, 0)]
        lows = np.minimum.reduceat(conv[rows], begin).tolist()
        keys: list[bytes | None] = [None] * n
        if depth <= left:
            keys[0] = left_keys[depth]
        if depth <= right:
            keys[-1] = right_keys[depth]
        which = np.cumsum(marks) - 1
        parents = above[rows[begin]].tolist()
        # Members that end here are the first rows of their node, in the order of their ids.
        at = np.flatnonzero(~longer)
        digests, ends = [NOTHING] * n, [b""] * n
        for own, members in zip(which[at][np.flatnonzero(np.diff(which[at], prepend=-1))].tolist(),
                                np.split(conv[rows[at]], np.flatnonzero(np.diff(which[at])) + 1), strict=True) if len(at) else ():
            joined = ",".join(map(str, members.tolist())).encode()
            digests[own] = hashlib.sha256(joined).digest()
            if keys[own] is not None:
                ends[own] = joined
        nodes.add(
            lows, [depth] * n, [above_conv[p] for p in parents], np.diff(np.append(begin, len(rows))).tolist(),
            np.add.reduceat(deeper, begin).tolist(), np.add.reduceat(leaf[rows].astype(np.int64), begin).tolist(),
            np.add.reduceat(saved, begin).tolist(), digests, keys, [above_open[p] for p in parents], [number] * n,
            [e if k is not None else None for e, k in zip(ends, keys, strict=True)],
        )
        above[rows] = which
        above_conv, above_open = lows, keys
    return nodes.table()


def _streamed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's chunks in their order; keys follow each other."""
    key, depth, state, empty = None, None, hashlib.sha256(), True

    def row() -> pa.RecordBatch:
        return pa.record_batch(
            [pa.array([depth], pa.int64()), pa.array([key], pa.binary()), pa.array([state.digest()], pa.binary())],
            ["depth", "key", "ends_sha256"],
        )

    for batch in batches:
        for d, k, chunk in zip(*(batch.column(c) for c in ("depth", "key", "ends")), strict=True):
            if (d.as_py(), k.as_py()) != (depth, key):
                if key is not None:
                    yield row()
                depth, key, state, empty = d.as_py(), k.as_py(), hashlib.sha256(), True
            if not empty:
                state.update(b",")
            state.update(chunk.as_buffer())
            empty = False
    if key is not None:
        yield row()


def prefix_trie(rows: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the trie over ``rows`` (conv_id, ids, words; see ``sequences``).

    conv_id and parent_conv_id are the smallest members of a node and of its parent (null for the root); depth, n_convs,
    n_children, n_leaves (childless nodes in the subtree, the top included); saved_words: words of each node's last turn
    times its members but one, summed over the subtree; ends_sha256: SHA-256 of the conv_ids that end at the node, in
    decimal, rising, joined by commas.

    A conv_id is one row of ``rows``. Conversations without turns are members of the root, which is there unless the table
    is empty; an empty table gives no rows. Equal sequences share all their nodes. One conversation is one row of its shard.

    A digest over very many ids is one stream by definition: chunks of ids, one per shard, go through one hash in order.
    """
    shards = sharded(rows, shard_turns)
    told = neighbours(shards)
    found = cut_lineage(shards.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(
        lambda key, table, sides: _nodes(key[0].as_py(), table, sides), NODES
    ))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_words", "ends_sha256"]

    # Nodes that cross shards: their parts are summed, their ids hashed in the order of the shards.
    parts = found.where(F.col("key").isNotNull())
    summed = parts.groupBy("depth", "key", "parent_key").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_words")]
    )
    chunks = parts.where(F.length("ends") > 0).select("depth", "key", "shard", "ends")
    chunks = chunks.repartition("depth", "key").sortWithinPartitions("depth", "key", "shard")
    digests = chunks.mapInArrow(_streamed, "depth bigint, key binary, ends_sha256 binary")
    crossing = cut_lineage(summed.join(digests, ["depth", "key"], "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING))
    ))

    # Parents that cross shards are looked up; one of them can have any share of the nodes as its children.
    whole = found.where(F.col("key").isNull()).select(*columns, "parent_key")
    known = whole.where(F.col("parent_key").isNull()).select(*columns)
    open_ = whole.where(F.col("parent_key").isNotNull()).unionByName(
        crossing.withColumn("parent_conv_id", F.lit(None).cast("bigint")).select(*columns, "parent_key")
    ).drop("parent_conv_id").withColumn("parent_depth", F.col("depth") - 1)
    children = open_.groupBy("parent_depth", "parent_key").agg(F.count(F.lit(1)).alias(ROW_COUNT))
    parents = crossing.select(
        F.col("depth").alias("parent_depth"), F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id")
    ).join(children, ["parent_depth", "parent_key"])
    looked_up = attach(open_, parents, ["parent_depth", "parent_key"]).select(*columns)
    return known.unionByName(looked_up).withColumn("ends_sha256", F.lower(F.hex("ends_sha256")))
