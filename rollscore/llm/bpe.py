"""Byte-level BPE by ranks: encoding and decoding of whole texts.

A text is cut by the tokenizer's pattern. A pre-token that is itself in the vocabulary is found by a
minimal perfect hash and is one id. Any other is merged: a heap holds the candidate pairs of a linked
list over its bytes, lowest rank first and leftmost among equals, until no pair is in the vocabulary.

Both tiers run once per distinct word of a batch; a bounded cache keeps words over the batches of a
task. The vocabulary has a fixed size, so every task can hold it.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollscore.llm.batches import Recent, int_lists, list_arrays, slices

CACHED_WORDS = 250_000
PLACE = (1 << 40) - 1
KEYS_PER_BUCKET = 2
SPREAD, STIR, LOW = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, (1 << 64) - 1


def _slot(hashed: int, seed: int, size: int) -> int:
    mixed = (hashed ^ (seed * SPREAD & LOW)) * STIR & LOW
    return (mixed ^ (mixed >> 29)) % size


def _slots(hashes: np.ndarray, seeds: np.ndarray, size: int) -> np.ndarray:
    """``_slot`` over arrays."""
    mixed = (hashes ^ (seeds * np.uint64(SPREAD))) * np.uint64(STIR)
    return ((mixed ^ (mixed >> np.uint64(29))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash over ``keys``: each key has a slot of its own, and no slot is empty.

    Keys fall into buckets. Buckets of several keys, largest first, get the first seed that sends
    their keys to free slots; a bucket of one key names a remaining slot directly.
    """

    def __init__(self, keys: list[bytes]) -> None:
        self.size = len(keys)
        self.buckets = max(1, self.size // KEYS_PER_BUCKET)
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for place, hashed in enumerate(hashes):
            members[hashed % self.buckets].append(place)
        seeds, direct, at = [0] * self.buckets, [-1] * self.buckets, [-1] * self.size
        order = sorted(range(self.buckets), key=lambda b: -len(members[b]))
        for b in order:
            mine, seed = members[b], 0
            if len(mine) < 2:
                break
            while True:
                slots = {_slot(hashes[p], seed, self.size) for p in mine}
                if len(slots) == len(mine) and all(at[x] < 0 for x in slots):
                    break
                seed += 1
            seeds[b] = seed
            for p in mine:
                at[_slot(hashes[p], seed, self.size)] = p
        free = (x for x in range(self.size) if at[x] < 0)
        for b, slot in zip((b for b in order if len(members[b]) == 1), list(free), strict=True):
            direct[b], at[slot] = slot, members[b][0]
        self.seeds, self.direct, self.at = np.array(seeds, np.uint64), np.array(direct), np.array(at)
        self.keys = keys

    def find(self, words: list[bytes]) -> list[int]:
        """The place of each word in ``keys``, -1 for words that are not there."""
        if not words or not self.size:
            return [-1] * len(words)
        hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        slots = np.where(self.direct[bucket] >= 0, self.direct[bucket], _slots(hashes, self.seeds[bucket], self.size))
        places = self.at[slots].tolist()
        keys = self.keys
        return [p if keys[p] == w else -1 for p, w in zip(places, words, strict=True)]


class BytePairs:
    """A vocabulary of ranks with its two-tier lookup."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN) -> None:
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        keys = list(ranks)
        self.whole = PerfectHash(keys)
        self.packed = {k: rank.to_bytes(4, "little") for k, rank in ranks.items()}
        self.bytes_of = {i: k for k, i in ranks.items()}
        self.words, self.pieces = Recent(CACHED_WORDS), Recent(CACHED_WORDS)

    def merge(self, piece: bytes) -> bytes:
        """Ids of a piece: merge the pair of lowest rank, the leftmost of equals, while there is one."""
        get, size = self.ranks.get, len(piece)
        ends = list(range(1, size + 1))
        before = list(range(-1, size))
        # A heap entry is one number: rank, then where the pair starts, then where it ends.
        heap = [rank << 80 | i << 40 | i + 2 for i in range(size - 1) if (rank := get(piece[i:i + 2])) is not None]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            i, j = entry >> 40 & PLACE, entry & PLACE
            middle = ends[i]
            # Stale if the left part is gone, or if what follows it no longer ends there.
            if not middle or middle >= j or ends[middle] != j:
                continue
            ends[i], ends[middle] = j, 0
            before[j] = i
            if j < size and (rank := get(piece[i:ends[j]])) is not None:
                heappush(heap, rank << 80 | i << 40 | ends[j])
            left = before[i]
            if left >= 0 and (rank := get(piece[left:j])) is not None:
                heappush(heap, rank << 80 | left << 40 | j)
        packed, i = [], 0
        while i < size:
            packed.append(self.packed[piece[i:ends[i]]])
            i = ends[i]
        return b"".join(packed)

    def learn(self, words: Iterable[str]) -> None:
        """Encode words that are not cached yet, all together."""
        cut = {w: self.pattern.findall(w) for w in words}
        parts = set(chain.from_iterable(cut.values()))
        known = self.pieces.keep(parts)
        missing = [p for p in parts if p not in known]
        pieces = [p.encode() for p in missing]
        whole = list(self.packed.values())
        for part, piece, at in zip(missing, pieces, self.whole.find(pieces), strict=True):
            known[part] = whole[at] if at >= 0 else self.merge(piece)
        now = self.words.now
        for word, own in cut.items():
            now[word] = known[own[0]] if len(own) == 1 else b"".join([known[p] for p in own])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of whole texts; null is the empty text."""
        split = [words_of(t or "") for t in texts]
        words = set(chain.from_iterable(split))
        known = self.words.keep(words)
        self.learn(words.difference(known))
        get = known.__getitem__
        return [np.frombuffer(b"".join(map(get, words)), "<i4") for words in split]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


BLANKS = regex.compile(r"\s{2}")
#: Before the last blank of a run: the pattern joins that one with what follows, or leaves it alone.
STARTS = re.compile(r"(?=[ \t\n\r]\S)")


def words_of(text: str) -> list[str]:
    """Parts of a text that the pattern never joins: the last blank before a word starts a new part."""
    if not text:
        return []
    if BLANKS.search(text) or text[-1].isspace():
        return STARTS.split(text)
    first, *rest = text.split(" ")
    return [first, *[" " + w for w in rest]] if first else [" " + w for w in rest]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> BytePairs:
    with open(path, "rb") as lines:
        return BytePairs({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})


def encode_batches(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, ids)."""
    pairs = vocabulary(path)
    for batch in slices(batches):
        ids = pairs.encode(batch.column("text").to_pylist())
        yield pa.record_batch([batch.column("doc_id"), int_lists(ids)], ["doc_id", "ids"])


def decode_batches(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """(doc_id, ids) to (doc_id, ids, decoded): the bytes the ids stand for."""
    pairs = vocabulary(path)
    for batch in slices(batches):
        decoded = [None if x is None else pairs.decode(x.tolist()) for x in list_arrays(batch.column("ids"))]
        yield pa.record_batch(
            [batch.column("doc_id"), batch.column("ids"), pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"]
        )


def _id(docs: DataFrame, doc_id: str) -> Column:
    return docs[doc_id].cast("bigint").alias("doc_id")


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids of each whole text: doc_id, ids array<int>. One scan, no shuffle.

    A null text has no ids, like an empty one. Repeated rows give repeated rows, a null doc_id stays
    null, other columns are left out, and an empty table gives an empty one.
    """
    rows = docs.select(_id(docs, doc_id), docs[text].alias("text"))
    return rows.mapInArrow(lambda batches: encode_batches(batches, path), "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The bytes behind each row's ids: doc_id, decoded binary; null for null ids."""
    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(
        lambda batches: (b.select(["doc_id", "decoded"]) for b in decode_batches(batches, path)),
        "doc_id bigint, decoded binary",
    )


Batches = Iterable[pa.RecordBatch]


def round_trip(docs: DataFrame, path: str, then: Callable[[Batches], Batches], schema: str) -> DataFrame:
    """Encode, decode, and hand doc_id, ids and decoded bytes to ``then``, all in one pass of a task."""
    rows = docs.select(_id(docs, "doc_id"), F.col("text"))
    return rows.mapInArrow(lambda batches: then(decode_batches(encode_batches(batches, path), path)), schema)
