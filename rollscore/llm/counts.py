"""Token counts of a unigram vocabulary without the tokens: count-only Viterbi.

An Aho-Corasick automaton lists the vocabulary's matches that end at each character. Dynamic programming
keeps, per character, the best score of a segmentation up to there and its number of pieces, nothing else.

Rules are those of the unigram tokenizer: blanks become the word mark, which also opens the text; among
equal scores the longest last piece wins; a character without a piece of its own costs the lowest score
less ten, and counts one piece per UTF-8 byte. No piece runs from another character into a word mark, so
the best path of a text is that of its words, each solved once per task while the bounded cache holds it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollscore.llm.batches import Recent, slices

CACHED_WORDS = 400_000
MARK = "▁"
UNKNOWN_PENALTY = 10.0

COUNTED = "doc_id bigint, n_tokens bigint, score double"

_WORDS = regex.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Unigram:
    """Pieces with scores."""

    def __init__(self, pieces: dict[str, float]) -> None:
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("A piece has a word mark after other characters")
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.words = Recent(CACHED_WORDS)

    def best(self, word: str) -> tuple[int, float]:
        """(pieces, score) of the best segmentation."""
        size = len(word)
        score, count = [0.0] * (size + 1), [0] * (size + 1)
        unknown, end = self.unknown, 0

        def close(at: int, found: float | None, pieces: int, single: bool) -> None:
            # A character without a piece of its own may always be taken as unknown, if that is better.
            if not single and (found is None or score[at - 1] + unknown > found):
                found = score[at - 1] + unknown
                pieces = count[at - 1] + len(word[at - 1].encode())
            score[at], count[at] = found, pieces

        best, pieces, single = None, 0, False
        matches = self.automaton.iter(word) if len(self.automaton) else ()
        for last, (length, value) in matches:  # by end, the longest first
            while end < last:
                close(end + 1, best, pieces, single)
                end, best, pieces, single = end + 1, None, 0, False
            start = last + 1 - length
            if length == 1:
                single = True
            total = score[start] + value
            if best is None or total > best:
                best, pieces = total, count[start] + 1
        while end < size:
            close(end + 1, best, pieces, single)
            end, best, pieces, single = end + 1, None, 0, False
        return count[size], score[size]

    def count(self, texts: list[str | None]) -> list[tuple[int, float]]:
        """(pieces, score) of each whole text."""
        split = [marked(t) if t else [] for t in texts]
        words = set(chain.from_iterable(split))
        known = self.words.keep(words)
        for word in words.difference(known):
            known[word] = self.best(word)
        get = known.__getitem__
        found = []
        for words in split:
            pieces, scores = zip(*map(get, words), strict=True) if words else ((), ())
            found.append((sum(pieces), float(sum(scores))))
        return found


def marked(text: str) -> list[str]:
    """Words of a text with their marks."""
    if "  " in text or MARK in text or text[-1] == " " or text[0] == " ":
        return _WORDS.findall(MARK + text.replace(" ", MARK))
    return [MARK + w for w in text.split(" ")]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Unigram:
    """The pieces of a file, without its control, unknown, unused and byte pieces."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [
        i for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))
    ]
    return Unigram({model.id_to_piece(i): model.get_score(i) for i in plain})


def _count(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    pieces = vocabulary(path)
    for batch in slices(batches):
        found = pieces.count(batch.column("text").to_pylist())
        number, score = zip(*found, strict=True) if found else ([], [])
        yield pa.record_batch(
            [batch.column("doc_id"), pa.array(number, pa.int64()), pa.array(score, pa.float64())],
            ["doc_id", "n_tokens", "score"],
        )


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, score: the best segmentation's number of pieces and score, one row per row.

    A null or empty text has 0 and 0. Repeated rows give repeated rows, a null doc_id stays null, other
    columns are left out, and an empty table gives an empty one.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(lambda batches: _count(batches, path), COUNTED)
