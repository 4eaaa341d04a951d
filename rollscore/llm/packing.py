"""Harmonic packing of tokenized documents into sequences of a fixed capacity.

A document longer than the capacity gives whole sequences first; what is left of it, or a shorter document, falls
into the class of the largest k of which k still fit, the lengths above capacity / (k + 1) up to capacity / k. A bin of class k
takes k of them, uncut: a fixed number, so that each task fills the bins of its own rows, with no shuffle and nothing
to agree on. The room a bin has left then is filled by the start of the next document, whose rest goes on to its own class.
So a document is cut once at most, besides its whole sequences. What is left in open bins when a task ends is
laid end to end into full sequences, and the last of it into sequences whose length is a power of two. No sequence
is padded then.

The capacity must be a power of two.
"""

from __future__ import annotations

import struct
import unicodedata
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from rollscore.llm.batches import Recent, int_lists, list_arrays, slices

CACHED_WORDS = 250_000
CLOSING = ".,!?;:"
FAR_SCRIPTS = "\u0590"
#: The tokenizer's own cut of a normalized word that holds no white space.
PRE_TOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+")
#: Sequence numbers of a task start at its partition number times this.
SEQUENCES_PER_TASK = 1 << 40

PIECES = "doc_id bigint, start bigint, length bigint, ids array<int>, doc_tokens bigint, sequence_id bigint, offset bigint"


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}i", *ids)


class WordTokens:
    """Ids by a tokenizer whose tokens never cross white space, found once per distinct word.

    The strings of special tokens in a text are those tokens, as the library has it.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.words, self.stems = Recent(CACHED_WORDS), Recent(CACHED_WORDS)

    def plain(self, word: str) -> bytes:
        # The model can be asked at once for the pre-tokens, of which letters alone are one. A capital sigma is left to
        # the tokenizer, as its lower case depends on its place, and so are letters of other scripts and special tokens.
        if word and max(word) < FAR_SCRIPTS and "Σ" not in word and "<|" not in word and word.isprintable():
            lower = unicodedata.normalize("NFC", word).lower()
            tokenize, ids = self.model.tokenize, []
            for part in (lower,) if lower.isalpha() else PRE_TOKENS.findall(lower):
                letters = part if part.isascii() else "".join(map(self.letters.__getitem__, part.encode()))
                ids += [t.id for t in tokenize(letters)]
            return packed(ids)
        return packed(self.tokenizer.encode(word, add_special_tokens=False).ids) if word else b""

    def learn(self, words: set[str], known: dict[str, bytes]) -> None:
        words = list(words)
        starts, ends = [], []
        for word in words:
            stem = word.rstrip(CLOSING)
            lower = stem.lower()
            # A word of letters and a run of closing marks are two pre-tokens.
            whole = not lower.isalpha() or "Σ" in stem
            starts.append(word if whole else lower)
            ends.append("" if whole else word[len(stem):])
        parts = set(starts).union(ends)
        ids = self.stems.keep(parts)
        for part in parts.difference(ids):
            ids[part] = self.plain(part)
        for word, start, end in zip(words, starts, ends, strict=True):
            known[word] = ids[start] + ids[end] if end else ids[start]

    def encode(self, texts: pa.Array | list[str | None]) -> list[np.ndarray]:
        """Ids of each text; Arrow splits and numbers the words, and each distinct one is looked up once."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = pc.list_flatten(split).dictionary_encode()
        words, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        distinct = set(words)
        known = self.words.keep(distinct)
        self.learn(distinct.difference(known), known)
        tokens = list(map(known.__getitem__, words))
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens)) // 4
        each = sizes[at]
        ends = np.concatenate([[0], np.cumsum(each)])
        # Where each id lies among those of the distinct words.
        place = np.repeat((np.cumsum(sizes) - sizes)[at] - ends[:-1], each) + np.arange(ends[-1])
        ids = np.frombuffer(b"".join(tokens), "<i4")[place]
        n_words = pc.fill_null(pc.list_value_length(split), 0).to_numpy()
        cuts = ends[np.concatenate([[0], np.cumsum(n_words, dtype=np.int64)])].tolist()
        return [ids[a:b] for a, b in pairwise(cuts)]


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


def tokenize_batches(batches: Iterable[pa.RecordBatch], path: str, end: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, ids), each closed by the id ``end``."""
    tokens = word_tokens(path)
    last = np.array([end], np.int32)
    for batch in slices(batches):
        ids = [np.concatenate([x, last]) for x in tokens.encode(batch.column("text"))]
        yield pa.record_batch([batch.column("doc_id"), int_lists(ids)], ["doc_id", "ids"])


class Bins:
    """One task's bins. ``full`` holds the pieces of closed ones: (piece, sequence, offset).

    A piece is (doc_id, start, length, ids, doc_tokens).
    """

    def __init__(self, capacity: int, first: int) -> None:
        self.capacity, self.next = capacity, first
        self.open: dict[int, list] = {}
        self.full: list[tuple] = []
        self.gap, self.filling = 0, []

    def close(self, pieces: list[tuple]) -> None:
        offset = 0
        for piece in pieces:
            self.full.append((*piece, self.next, offset))
            offset += piece[2]
        self.next += 1

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        """A document: whole sequences, then the room that waits, then its class."""
        total, capacity = len(ids), self.capacity
        start = total - total % capacity
        for at in range(0, start, capacity):
            self.close([(doc, at, capacity, ids[at:at + capacity], total)])
        left = total - start
        if left and self.gap:
            used = min(left, self.gap)
            self.filling.append((doc, start, used, ids[start:start + used].copy(), total))
            start, left, self.gap = start + used, left - used, self.gap - used
            if not self.gap:
                self.close(self.filling)
        if not left:
            return
        k = capacity // left
        bin_ = self.open.setdefault(k, [])
        bin_.append((doc, start, left, ids[start:].copy(), total))
        if len(bin_) == k:
            del self.open[k]
            room = capacity - sum(p[2] for p in bin_)
            if room:
                self.gap, self.filling = room, bin_  # nothing waits now: this document has filled what did
            else:
                self.close(bin_)

    def finish(self) -> None:
        """Lay what is left end to end: full sequences, then lengths that are falling powers of two."""
        rest = [*self.filling] if self.gap else []
        rest += [p for k in sorted(self.open) for p in self.open[k]]
        self.open, self.gap, self.filling = {}, 0, []
        left = sum(p[2] for p in rest)
        target, held, size = 0, [], 0
        for doc, start, length, ids, total in rest:
            while length:
                if not size:
                    target = min(self.capacity, 1 << (left.bit_length() - 1))
                used = min(length, target - size)
                held.append((doc, start, used, ids[:used], total))
                start, length, ids, size = start + used, length - used, ids[used:], size + used
                if size == target:
                    self.close(held)
                    left -= size
                    held, size = [], 0

    def take(self) -> list[tuple]:
        taken, self.full = self.full, []
        return taken


def _rows(pieces: list[tuple]) -> pa.RecordBatch:
    doc, start, length, ids, tokens, sequence, offset = zip(*pieces, strict=True)
    return pa.record_batch(
        [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), int_lists(list(ids)),
         pa.array(tokens, pa.int64()), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
        ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
    )


def pack_batches(batches: Iterable[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, ids) to placed pieces, filling the bins of this task only."""
    bins = Bins(capacity, TaskContext.get().partitionId() * SEQUENCES_PER_TASK)
    for batch in slices(batches):
        for doc, ids in zip(batch.column("doc_id").to_pylist(), list_arrays(batch.column("ids")), strict=True):
            bins.add(doc, ids)
        if bins.full:
            yield _rows(bins.take())
    bins.finish()
    if bins.full:
        yield _rows(bins.take())


def checksums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace each piece's ids by the CRC-32 of their little-endian unsigned 32-bit form."""
    for batch in batches:
        crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in list_arrays(batch.column("ids"))]
        at = batch.schema.get_field_index("ids")
        yield batch.set_column(at, "ids_crc32", pa.array(crc, pa.int64()))


Batches = Iterable[pa.RecordBatch]


def pack(
    docs: DataFrame, path: str, end: int = 2, capacity: int = 4096,
    then: Callable[[Batches], Batches] | None = None, schema: str = PIECES,
) -> DataFrame:
    """Tokenize ``docs`` (doc_id, text) and place every id in one sequence: one row per piece.

    Each row is a run of a document's ids: its start there, its length, its ids, the document's number
    of ids, the sequence and the offset in it. ``then`` may digest the rows within the same pass.

    A null or empty text has the closing id only. Repeated rows are packed as documents of their own, a
    null doc_id stays null, other columns are left out, and an empty table gives no rows. Sequence
    numbers follow the scan's partitions: unique, not dense.
    """
    if capacity & (capacity - 1) or capacity < 1:
        raise ValueError("The capacity must be a power of two")
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].alias("text"))
    digest = then or (lambda batches: batches)
    return rows.mapInArrow(
        lambda batches: digest(pack_batches(tokenize_batches(batches, path, end), capacity)), schema
    )
