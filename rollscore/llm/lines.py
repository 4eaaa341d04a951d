"""Dropping lines that many documents share, by sharded minimal perfect hashes.

A line's key is a 128-bit hash. Blocks of documents send each distinct key once, with the number of
documents in the block that hold it, to the shard of its hash. A shard builds a minimal perfect hash over
its distinct keys; a key's slot indexes two flat arrays, a fingerprint and a saturating count. Blocks then
probe the arrays: a shard answers each block with those of its keys that are common. Lines are never joined
with lines, and a line that every document holds is one entry per block.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollscore.llm.words import Hashes

#: Texts of a block, and lines of a shard, on average: what one task holds at once.
BLOCK_BYTES = 1 << 23
SHARD_LINES = 1 << 17
#: Bits per key in each level of a perfect hash.
ROOM = 1.5
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))

QUESTIONS = "shard bigint, block bigint, keys binary, documents binary"
ANSWERS = "block bigint, keys binary"
KEPT = "doc_id bigint, n_lines bigint, n_dropped bigint, text string"


def _places(first: np.ndarray, second: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = (first ^ (second * MIX[2])) + np.uint64(level + 1) * MIX[0]
        mixed = (mixed ^ (mixed >> np.uint64(30))) * MIX[1]
        mixed = (mixed ^ (mixed >> np.uint64(27))) * MIX[2]
        return (mixed ^ (mixed >> np.uint64(31))) % np.uint64(size)


class Level:
    """Bits of the keys that are alone at their place, with the number of set bits before each word."""

    def __init__(self, places: np.ndarray, size: int, before: int) -> None:
        self.size = size
        words = np.zeros(-(-size // 64), np.uint64)
        alone = np.flatnonzero(np.bincount(places.astype(np.int64), minlength=size) == 1).astype(np.uint64)
        np.bitwise_or.at(words, (alone >> np.uint64(6)).astype(np.int64), np.uint64(1) << (alone & np.uint64(63)))
        self.words, self.count = words, len(alone)
        ends = np.cumsum(np.bitwise_count(words), dtype=np.int64)
        self.ranks = before + np.concatenate([[0], ends[:-1]]).astype(np.int64)

    def find(self, places: np.ndarray) -> np.ndarray:
        """Slots, or -1 where the bit is not set."""
        at, bit = (places >> np.uint64(6)).astype(np.int64), places & np.uint64(63)
        word = self.words[at]
        below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
        return np.where((word >> bit) & np.uint64(1) == 1, self.ranks[at] + below, -1)


class LineIndex:
    """Distinct 128-bit keys as slots of a minimal perfect hash, with a fingerprint and a count each.

    Keys alone at their place in a level's bits stay there; the others go on to the next, smaller level. A
    key's slot is the rank of its bit, so slots are dense. Counts stop at ``most``, in as few bytes as that
    needs. Keys outside the set are told by their fingerprint, the second half of the hash.
    """

    def __init__(self, first: np.ndarray, second: np.ndarray, counts: np.ndarray, most: int) -> None:
        self.levels: list[Level] = []
        left, placed = np.arange(len(first)), 0
        while len(left):
            size = max(64, int(ROOM * len(left)))
            places = _places(first[left], second[left], len(self.levels), size)
            level = Level(places, size, placed)
            self.levels.append(level)
            left, placed = left[level.find(places) < 0], placed + level.count
        slots = self.slots(first, second)
        self.fingerprints = np.empty(placed, np.uint64)
        self.fingerprints[slots] = second
        self.counts = np.empty(placed, np.min_scalar_type(most))
        self.counts[slots] = np.minimum(counts, most)

    def slots(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        found, left = np.full(len(first), -1, np.int64), np.arange(len(first))
        for number, level in enumerate(self.levels):
            if not len(left):
                break
            at = level.find(_places(first[left], second[left], number, level.size))
            found[left] = at
            left = left[at < 0]
        return found

    def probe(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Counts of keys; 0 for keys that are not in the set."""
        slots = self.slots(first, second)
        known = slots >= 0
        known[known] = self.fingerprints[slots[known]] == second[known]
        counts = np.zeros(len(first), np.int64)
        counts[known] = self.counts[slots[known]]
        return counts


def key_of(line: bytes) -> bytes:
    """The line without ASCII white space at its ends, ASCII capitals in lower case."""
    return line.strip().lower()


class Block:
    """Documents as lines, and a number for each distinct key."""

    def __init__(self, texts: Sequence[str | None], min_chars: int) -> None:
        self.lines = [(t or "").encode().split(b"\n") for t in texts]
        hashes = Hashes()
        sizes = [len(x) for x in self.lines]
        self.starts = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=self.starts[1:])
        self.number = np.fromiter(
            (hashes[key_of(line)] for line in chain.from_iterable(self.lines)), np.int64, self.starts[-1]
        )
        #: Numbers whose key is long enough to be dropped at all.
        self.counted = np.fromiter((len(k) >= min_chars and len(k.decode()) >= min_chars for k in hashes), bool, len(hashes))
        self.keys = np.frombuffer(b"".join(hashes.digests), "<u8").reshape(-1, 2)

    def documents(self) -> np.ndarray:
        """For each number, how many documents hold it."""
        doc = np.repeat(np.arange(len(self.lines)), np.diff(self.starts))
        pairs = np.unique(doc * max(1, len(self.keys)) + self.number)
        return np.bincount(pairs % max(1, len(self.keys)), minlength=len(self.keys))


def _ask(key: tuple, table: pa.Table, shards: int, min_chars: int) -> pa.Table:
    block = Block(table.column("text").to_pylist(), min_chars)
    asked = np.flatnonzero(block.counted)
    keys, documents = block.keys[asked], block.documents()[asked]
    shard = (keys[:, 0] >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
    order = np.argsort(shard, kind="stable")
    shard, keys, documents = shard[order], keys[order], documents[order].astype("<u4")
    starts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else np.empty(0, np.int64)
    cuts = list(zip(starts, np.append(starts, len(shard))[1:], strict=True))
    return pa.table({
        "shard": pa.array(shard[starts].astype(np.int64)), "block": pa.array([key[0].as_py()] * len(cuts), pa.int64()),
        "keys": pa.array([keys[a:b].tobytes() for a, b in cuts], pa.binary()),
        "documents": pa.array([documents[a:b].tobytes() for a, b in cuts], pa.binary()),
    })


def _answer(table: pa.Table, least: int) -> pa.Table:
    """Each block's keys that ``least`` documents hold."""
    asked = [np.frombuffer(x, "<u8").reshape(-1, 2) for x in table.column("keys").to_pylist()]
    keys = np.concatenate(asked)
    documents = np.concatenate([np.frombuffer(x, "<u4") for x in table.column("documents").to_pylist()]).astype(np.int64)
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    ordered = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], (ordered[1:] != ordered[:-1]).any(axis=1)]))
    index = LineIndex(ordered[starts, 0], ordered[starts, 1], np.add.reduceat(documents[order], starts), least)
    common = [own[index.probe(own[:, 0], own[:, 1]) >= least] for own in asked]
    told = [i for i, own in enumerate(common) if len(own)]
    return pa.table({
        "block": table.column("block").take(pa.array(told, pa.int64())),
        "keys": pa.array([common[i].tobytes() for i in told], pa.binary()),
    })


def _drop(table: pa.Table, answers: pa.Table, min_chars: int, carried: int) -> pa.Table:
    raw = table.column("text").to_pylist()
    block = Block(raw, min_chars)
    told = b"".join(answers.column("keys").to_pylist())
    kind = np.dtype([("a", "<u8"), ("b", "<u8")])
    common = np.isin(np.ascontiguousarray(block.keys).view(kind).ravel(), np.frombuffer(told, kind)) & block.counted
    gone = common[block.number]
    texts, dropped = [], []
    for text, lines, at in zip(raw, block.lines, block.starts[:-1], strict=True):
        mine = gone[at:at + len(lines)]
        dropped.append(int(mine.sum()))
        if dropped[-1] and text is not None:
            text = b"\n".join([line for line, g in zip(lines, mine.tolist(), strict=True) if not g]).decode()
        texts.append(text)
    return pa.table({
        "doc_id": table.column("doc_id"), "n_lines": pa.array(np.diff(block.starts)), "n_dropped": pa.array(dropped, pa.int64()),
        "text": pa.array(texts, pa.string()), **{f"c{i}": table.column(f"c{i}") for i in range(carried)},
    })


def drop_common_lines(docs: DataFrame, least: int = 10, min_chars: int = 1, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_lines, n_dropped, text: one row per row of ``docs`` (doc_id, text).

    Lines are parted by line feeds; a null or empty text is one empty line. Lines whose key (see ``key_of``) has
    ``min_chars`` code points at least and is found in ``least`` documents or more are dropped, in all documents and
    wherever they repeat; the others keep their form and order, joined by line feeds. A null text stays null. Each row
    is a document of its own, so rows that share a doc_id, or have none, count one by one, and a line repeated inside a
    row counts once. Columns named in ``carry`` follow as they are, others are left out. An empty table gives an empty one.

    Texts are shuffled once. Keys go to their shards as 128 bits and a count, once per block that holds them, and only
    the common ones come back. Rows equal in doc_id and text share a block.
    """
    if least < 1:
        raise ValueError("A common line is in one document at least")
    kept = [F.col(name).alias(f"c{i}") for i, name in enumerate(carry)]
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"), *kept)
    schema = "".join([KEPT, *(f", c{i} {docs.schema[name].dataType.simpleString()}" for i, name in enumerate(carry))])
    length = F.coalesce(F.octet_length("text"), F.lit(0))
    breaks = length - F.coalesce(F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))), F.lit(0))
    size, lines = rows.agg(F.coalesce(F.sum(length), F.lit(0)), F.coalesce(F.sum(breaks + 1), F.lit(0))).first()
    blocks, shards = 1 + size // BLOCK_BYTES, 1 + lines // SHARD_LINES
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    asked = rows.groupBy("block").applyInArrow(lambda key, table: _ask(key, table, shards, min_chars), QUESTIONS)
    common = asked.groupBy("shard").applyInArrow(lambda table: _answer(table, least), ANSWERS)
    left = rows.groupBy("block").cogroup(common.groupBy("block")).applyInArrow(
        lambda table, answers: _drop(table, answers, min_chars, len(carry)), schema
    )
    return left.withColumnsRenamed({f"c{i}": name for i, name in enumerate(carry)})
