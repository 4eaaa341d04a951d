"""Exact substring dedup by difference-cover anchors.

A difference cover modulo a period has, for any two positions, a shift below the period that brings both
to covered residues. So if two texts share a window of words, some anchor (a shorter run at a covered
position) inside it is aligned in both, and only runs at covered positions need to be hashed and compared.

1. Anchors: each block of documents asks, once per distinct anchor, whether another document has it.
2. Extension: windows around repeated anchors are hashed in full (128 bits) and asked for the smallest
   document they start in.
3. Words covered by a window that also starts in a smaller document go.

Questions travel as sorted arrays, one row per block of documents and bucket of hashes, and answers come back
as bits and numbers in the same order. A run that a third of all documents share is one entry per block, no
pairs are formed, and a bucket holds a fixed share of the distinct runs. Texts are shuffled once: all three
passes read the same exchange.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollscore.llm.words import lanes_of, runs, words_of

WINDOW = 13
#: Bytes of text in a block of documents, and behind a bucket of hashes.
BLOCK_BYTES, BUCKET_BYTES = 2 << 20, 8 << 20

KEPT = "doc_id bigint, n_words bigint, n_removed bigint, text string"
QUESTIONS = "block bigint, bucket bigint, first binary, second binary, owner binary"
ANSWERS = "block bigint, bucket bigint, kind int, bits binary, owner binary"


@lru_cache
def difference_cover(period: int) -> tuple[int, ...]:
    """A small set of residues whose differences are all residues; found greedily."""
    cover, missing = [0], set(range(1, period))
    while missing:
        def gain(r: int) -> int:
            return len({(r - c) % period for c in cover} & missing | {(c - r) % period for c in cover} & missing)

        best = max((r for r in range(1, period) if r not in cover), key=lambda r: (gain(r), -r))
        cover.append(best)
        missing -= {(a - b) % period for a in cover for b in cover}
    return tuple(sorted(cover))


def period_of(window: int) -> int:
    """Half the window: anchors are then as long as the shifts they must allow for."""
    return max(1, (window + 1) // 2)


class Block:
    """A block of documents as words, with its distinct anchors and windows in the order of their hashes."""

    def __init__(self, table: pa.Table, window: int) -> None:
        self.window, self.period = window, period_of(window)
        self.ids = table.column("doc_id").to_pylist()
        self.words = [words_of(t) for t in table.column("text").to_pylist()]
        self.lane, self.lane2, starts = lanes_of(self.words)
        self.starts, lengths = starts[:-1], np.diff(starts)
        self.doc = np.repeat(np.arange(len(lengths)), lengths)
        self.place = np.arange(starts[-1]) - self.starts[self.doc]
        self.left = lengths[self.doc] - self.place
        #: Rows without an id neither lend their words nor lose any.
        self.owner = np.array([0 if i is None else i for i in self.ids], np.int64)
        self.known = np.array([i is not None for i in self.ids], bool)[self.doc] if self.ids else np.zeros(0, bool)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of the anchors; their distinct hashes; which one each place has; which are in several documents."""
        length = self.window - self.period + 1
        cover = np.zeros(self.period, bool)
        cover[list(difference_cover(self.period))] = True
        at = np.flatnonzero(cover[self.place % self.period] & (self.left >= length) & self.known)
        hashes, which = np.unique(runs(self.lane, at, length), return_inverse=True)
        owner = self.owner[self.doc[at]]
        low, high = np.full(len(hashes), np.iinfo(np.int64).max), np.full(len(hashes), np.iinfo(np.int64).min)
        np.minimum.at(low, which, owner)
        np.maximum.at(high, which, owner)
        return at, hashes, which, low < high

    def windows(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the windows with a repeated anchor; their distinct hashes; which each has; its smallest owner."""
        at, _, which, _ = self.anchors()
        anchor = at[repeated[which]]
        steps = np.zeros(len(self.place) + 1, np.int64)
        np.add.at(steps, np.maximum(anchor - self.period + 1, self.starts[self.doc[anchor]]), 1)
        np.add.at(steps, anchor + 1, -1)
        start = np.flatnonzero((np.cumsum(steps)[:-1] > 0) & (self.left >= self.window))
        first, second = runs(self.lane, start, self.window), runs(self.lane2, start, self.window, 1)
        order = np.lexsort((second, first))
        first, second = first[order], second[order]
        new = np.ones(len(order), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        low = np.full(int(new.sum()), np.iinfo(np.int64).max)
        np.minimum.at(low, which, self.owner[self.doc[start]])
        return start, first[new], second[new], which, low

    def covered(self, start: np.ndarray) -> np.ndarray:
        steps = np.zeros(len(self.place) + 1, np.int64)
        np.add.at(steps, start, 1)
        np.add.at(steps, start + self.window, -1)
        return np.cumsum(steps)[:-1] > 0


def _ends(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where the buckets of sorted hashes end: equal ranges of the hash."""
    bucket = (hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    return np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))


def _questions(block: int, buckets: int, first: np.ndarray, second: np.ndarray | None, owner: np.ndarray) -> pa.Table:
    ends = _ends(first, buckets)
    full = [b for b in range(buckets) if ends[b] < ends[b + 1]]
    cut = lambda x: pa.array([x[ends[b]:ends[b + 1]].tobytes() for b in full], pa.binary())
    none = pa.array([b""] * len(full), pa.binary())
    return pa.table({
        "block": pa.array([block] * len(full), pa.int64()), "bucket": pa.array(full, pa.int64()), "first": cut(first),
        "second": none if second is None else cut(second), "owner": cut(owner),
    })


def _ask_anchors(key: tuple, table: pa.Table, window: int, buckets: int) -> pa.Table:
    _, hashes, _, several = Block(table, window).anchors()
    return _questions(key[0].as_py(), buckets, hashes, None, several)


def _join(column: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All arrays of a binary column end to end, and where each starts (and the last ends)."""
    parts = [np.frombuffer(x, kind) for x in column.to_pylist()]
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=starts[1:])
    return np.concatenate(parts) if parts else np.empty(0, kind), starts


def _answers(table: pa.Table, kind: int, bits: np.ndarray, owner: np.ndarray | None, starts: np.ndarray) -> pa.Table:
    cuts = list(zip(starts[:-1], starts[1:], strict=True))
    return pa.table({
        "block": table.column("block"), "bucket": table.column("bucket"), "kind": pa.array([kind] * len(cuts), pa.int32()),
        "bits": pa.array([np.packbits(bits[a:b]).tobytes() for a, b in cuts], pa.binary()),
        "owner": pa.array([b"" if owner is None else owner[a:b][bits[a:b]].tobytes() for a, b in cuts], pa.binary()),
    })


def _answer_anchors(key: tuple, table: pa.Table) -> pa.Table:
    """For each anchor asked about: is it in more than one document?"""
    hashes, starts = _join(table.column("first"), "<u8")
    several, _ = _join(table.column("owner"), "?")
    _, which, count = np.unique(hashes, return_inverse=True, return_counts=True)
    repeated = count > 1
    repeated[which[several]] = True
    return _answers(table, 0, repeated[which], None, starts)


def _answer_windows(key: tuple, table: pa.Table) -> pa.Table:
    """For each window asked about: the smallest document it starts in, if that is not the asker's own."""
    first, starts = _join(table.column("first"), "<u8")
    second, _ = _join(table.column("second"), "<u8")
    owner, _ = _join(table.column("owner"), "<i8")
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    low = np.minimum.reduceat(owner[order], np.flatnonzero(new)) if len(order) else owner
    smallest = np.empty(len(order), np.int64)
    smallest[order] = low[np.cumsum(new) - 1]
    return _answers(table, 1, smallest < owner, smallest, starts)


def _told(answers: pa.Table, kind: int, buckets: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Answers in the order of ``hashes``: bits, and the owners where they are set."""
    ends = _ends(hashes, buckets)
    bits, owners = np.zeros(len(hashes), bool), {}
    for bucket, which, packed, owner in zip(*(answers.column(c).to_pylist() for c in ("bucket", "kind", "bits", "owner")), strict=True):
        if which == kind:
            size = ends[bucket + 1] - ends[bucket]
            bits[ends[bucket]:ends[bucket + 1]] = np.unpackbits(np.frombuffer(packed, np.uint8), count=size)
            owners[bucket] = np.frombuffer(owner, "<i8")
    found = [owners[b] for b in sorted(owners)]
    return bits, np.concatenate(found) if found else np.empty(0, np.int64)


def _ask_windows(key: tuple, table: pa.Table, answers: pa.Table, window: int, buckets: int) -> pa.Table:
    block = Block(table, window)
    repeated, _ = _told(answers, 0, buckets, block.anchors()[1])
    _, first, second, _, low = block.windows(repeated)
    return _questions(key[0].as_py(), buckets, first, second, low)


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _cut(text: str, gone: np.ndarray) -> str:
    """The text without the words that go and the white space after them."""
    raw = text.encode()
    places = [m.start() for m in _WORD.finditer(raw)] + [len(raw)]
    change = np.flatnonzero(np.diff(np.concatenate([[True], gone, [True]]).astype(np.int8)))
    return b"".join(raw[places[a]:places[b]] for a, b in zip(change[::2], change[1::2], strict=True)).decode()


def _remove(table: pa.Table, answers: pa.Table, window: int, buckets: int, spaces: bool, carried: int) -> pa.Table:
    block = Block(table, window)
    repeated, _ = _told(answers, 0, buckets, block.anchors()[1])
    start, first, _, which, low = block.windows(repeated)
    smaller, owners = _told(answers, 1, buckets, first)
    low[smaller] = owners
    gone = block.covered(start[low[which] < block.owner[block.doc[start]]])
    texts, removed = [], []
    for words, at, text in zip(block.words, block.starts, table.column("text").to_pylist(), strict=True):
        mine = gone[at:at + len(words)]
        count = int(mine.sum())
        if spaces:
            texts.append(_cut(text, mine) if count else text)
        else:
            texts.append(b" ".join([w for w, g in zip(words, mine.tolist(), strict=True) if not g] if count else words).decode())
        removed.append(count)
    return pa.table({
        "doc_id": table.column("doc_id"), "n_words": pa.array([len(w) for w in block.words], pa.int64()),
        "n_removed": pa.array(removed, pa.int64()), "text": pa.array(texts, pa.string()),
        **{f"c{i}": table.column(f"c{i}") for i in range(carried)},
    })


def remove_repeats(docs: DataFrame, window: int = WINDOW, spaces: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, text: one row per row of ``docs`` (doc_id, text).

    Words are runs of anything but ASCII white space. A word goes if a window of ``window`` consecutive
    words of its document that covers it also starts in a document with a smaller doc_id; windows are those
    of the texts as they came. ``text`` joins the words that stay by one space, or with ``spaces`` keeps the white space around
    them, and null as null. A null or empty text has no words. Rows that share a doc_id do not count as each other's copies; rows without one lend and lose
    nothing. Columns named in ``carry`` follow as they are, others are left out. An empty table gives an empty one.
    """
    if window < 1:
        raise ValueError("A window has one word at least")
    kept = [F.col(name).alias(f"c{i}") for i, name in enumerate(carry)]
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"), *kept)
    schema = "".join([KEPT, *(f", c{i} {docs.schema[name].dataType.simpleString()}" for i, name in enumerate(carry))])
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks, buckets = 1 + size // BLOCK_BYTES, 1 + size // BUCKET_BYTES
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    asked = rows.groupBy("block").applyInArrow(lambda key, table: _ask_anchors(key, table, window, buckets), QUESTIONS)
    repeated = asked.groupBy("bucket").applyInArrow(_answer_anchors, ANSWERS)
    wide = rows.groupBy("block").cogroup(repeated.groupBy("block")).applyInArrow(
        lambda key, table, told: _ask_windows(key, table, told, window, buckets), QUESTIONS
    )
    smallest = wide.groupBy("bucket").applyInArrow(_answer_windows, ANSWERS)
    told = repeated.unionByName(smallest)
    left = rows.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(
        lambda table, answers: _remove(table, answers, window, buckets, spaces, len(carry)), schema
    )
    return left.withColumnsRenamed({f"c{i}": name for i, name in enumerate(carry)})
