"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence has the probability sigmoid(bias + weights of its words), and
a document is toxic unless every sentence is clean (noisy-or). Only documents are labelled; the weights are
fitted to those labels, and the sentence scores then tell where the offence is.

Beside whole words their beginnings have weights, as one stem takes many endings of which a sample shows few. Both, the
units, are picked by how unevenly they fall on the two labels. Training takes a bounded sample of the
labelled documents; the picking and the counts of units run on Spark, the fit of at most ``WORDS`` weights on
the driver. Scoring is one scan.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Collection, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollscore.llm.batches import LONGEST_KEY, slices

#: Labelled documents used for the fit, on average.
SAMPLE = 12_000
#: Units that are picked at most; a unit is a word, or its first so many bytes.
WORDS, BEGINNINGS = 8192, range(3, 8)
#: A unit is picked if it is in so many documents of the sample, and this uneven (chi-squared).
LEAST_DOCUMENTS, LEAST_CHI = 5, 15.0
ROUNDS, RATE, DECAY = 400, 0.1, 1e-4

SCORED = "doc_id bigint, score double, sentence_number int, sentence string, sentence_score double"

_ENDS = b".!?\n\r\x0b\x0c"
#: ASCII marks end a sentence or a word; other bytes stand for themselves.
_MARKS = bytes(10 if b in _ENDS else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
CACHED_WORDS = 250_000
_SENTENCE = re.compile(r"[.!?\n\r\x0b\x0c]")


def is_held_out(doc_id: Column) -> Column:
    """Rows that labels are never learnt from: CRC-32 of the id as text divisible by five."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sentences(text: str | None) -> list[bytes]:
    """Lower-cased sentences with marks blanked out; some may be blank. They match ``_SENTENCE.split``."""
    return text.lower().encode().translate(_MARKS).split(b"\n") if text else []


def units(word: bytes) -> list[bytes]:
    """A word and its beginnings; their star is a mark, which no word contains."""
    return [word, *(word[:k] + b"*" for k in BEGINNINGS if k < len(word))]


class Known:
    """Finds the units of a table in words. Words are looked at once, as far as a bounded cache holds them."""

    def __init__(self, table: Collection[bytes]) -> None:
        self.table, self.without, self.having = frozenset(table), set(), {}

    def find(self, words: set[bytes]) -> dict[bytes, frozenset[bytes]]:
        """Those of ``words`` that have units in the table, with these."""
        if len(self.without) + len(self.having) > CACHED_WORDS:
            self.without, self.having = set(), {}
        found = {}
        for word in words - self.without:
            own = self.having.get(word)
            if own is None:
                own = self.table.intersection(units(word))
                if len(word) <= LONGEST_KEY:
                    if own:
                        self.having[word] = own
                    else:
                        self.without.add(word)
            if own:
                found[word] = own
        return found


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[bytes, float]
    known: Known = field(init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "known", Known(self.weights))

    def bag(self, text: str | None) -> tuple[float, int, float]:
        """(document score, number of the worst sentence from 0 or -1, its score)."""
        parts = sentences(text)
        if not parts:
            return 0.0, -1, 0.0
        weights = self.weights
        hit = self.known.find(set(b" ".join(parts).split()))
        clean, total, worst, at = 0, 0.0, -math.inf, -1
        for number, part in enumerate(parts):
            words = part.split()
            if not words:
                continue
            logit = self.bias
            if hit and (own := hit.keys() & words):
                logit += math.fsum(weights[u] for u in set().union(*(hit[w] for w in own)))
                total += _softplus(logit)
            else:
                clean += 1
            if logit > worst:
                worst, at = logit, number
        if at < 0:
            return 0.0, -1, 0.0
        total += clean * _softplus(self.bias)
        return -math.expm1(-total), at, _sigmoid(worst)


def _softplus(x: float) -> float:
    return x if x > 30 else math.log1p(math.exp(x))


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        all_, bad = Counter(), Counter()
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            words = set(chain.from_iterable(map(units, set(b" ".join(sentences(text)).split()))))
            all_.update(words)
            if toxic:
                bad.update(words)
        words = list(all_)
        yield pa.record_batch(
            [pa.array(words, pa.binary()), pa.array([all_[w] for w in words], pa.int64()),
             pa.array([bad[w] for w in words], pa.int64())], ["word", "n", "bad"],
        )


def pick_words(sample: DataFrame, n: int, bad: int) -> list[bytes]:
    """At most ``WORDS`` units of ``sample``, the most uneven first."""
    counts = sample.mapInArrow(_count_words, "word binary, n bigint, bad bigint")
    counts = counts.groupBy("word").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    off = F.col("bad") * F.lit(float(n)) - F.col("n") * F.lit(float(bad))
    chi = off * off * float(n) / (F.col("n") * (F.lit(float(n)) - F.col("n")) * float(bad) * float(n - bad))
    uneven = counts.where((F.col("n") >= LEAST_DOCUMENTS) & (F.col("n") < n)).withColumn("chi", chi)
    picked = uneven.where(F.col("chi") > LEAST_CHI).orderBy(F.desc("chi"), "word").limit(WORDS)
    return [bytes(r.word) for r in picked.collect()]


def _bags(batches: Iterable[pa.RecordBatch], place: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """Per document: label, number of sentences without a picked unit, and the others' units."""
    known = Known(place)
    for batch in slices(batches):
        rows = []
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            own = [known.find(set(s.split())) for s in sentences(text) if s.strip()]
            found = [sorted(place[u] for u in set().union(*hit.values())) for hit in own]
            rows.append((toxic, sum(not f for f in found), [f for f in found if f]))
        toxic, clean, found = zip(*rows, strict=True) if rows else ([], [], [])
        yield pa.record_batch(
            [pa.array(toxic, pa.int32()), pa.array(clean, pa.int64()), pa.array(found, pa.list_(pa.list_(pa.int32())))],
            ["toxic", "clean", "found"],
        )


def fit(bags: list[tuple[int, int, list[list[int]]]], words: int) -> tuple[float, np.ndarray]:
    """Bias and weights that minimise the documents' mean log loss (Adam, all bags at once)."""
    label = np.array([b[0] for b in bags], float)
    clean = np.array([b[1] for b in bags], float)
    doc = np.array([d for d, b in enumerate(bags) for _ in b[2]], np.int64)
    lists = [s for b in bags for s in b[2]]
    row = np.repeat(np.arange(len(lists)), [len(s) for s in lists]).astype(np.int64)
    word = np.array([w for s in lists for w in s], np.int64)
    parameters = np.full(words + 1, 1.0)
    parameters[-1] = -6.0
    first, second = np.zeros_like(parameters), np.zeros_like(parameters)
    for step in range(1, ROUNDS + 1):
        weights, bias = parameters[:-1], parameters[-1]
        logits = bias + np.bincount(row, weights[word], len(lists))
        total = np.bincount(doc, np.logaddexp(0, logits), len(bags)) + clean * np.logaddexp(0, bias)
        # d loss / d total: 1 for clean documents; toxic ones pull up, the more the less is found yet.
        pull = np.where(label > 0, -1 / np.expm1(np.clip(total, 1e-12, 700)), 1.0) / len(bags)
        at_sentence = pull[doc] / (1 + np.exp(-np.clip(logits, -700, 700)))
        slope = np.bincount(word, at_sentence[row], words) + DECAY * weights
        slope = np.append(slope, at_sentence.sum() + (pull * clean).sum() / (1 + np.exp(-bias)))
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        parameters -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return float(parameters[-1]), parameters[:-1]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic), without held-out rows.

    A document with several labels is toxic if one of them is; null ids and labels are left out. With
    no toxic document in the sample every score is near 0, with no clean one near 1.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~is_held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    share = min(1.0, sample / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)))
    # ``sample`` rows of two numbers: the size of this broadcast has a bound.
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id")
    rows = rows.select("text", "toxic")
    n, bad = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not bad or bad == n:
        return Model(20.0 if bad else -20.0, {})
    words = pick_words(rows, n, bad)
    place = {w: i for i, w in enumerate(words)}
    bags = rows.mapInArrow(lambda b: _bags(b, place), "toxic int, clean bigint, found array<array<int>>").collect()
    bias, weights = fit([(r.toxic, r.clean, r.found) for r in bags], len(words))
    return Model(bias, dict(zip(words, weights.tolist(), strict=True)))


def _score(batches: Iterable[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = batch.column("text").to_pylist()
        score, at, worst = zip(*map(model.bag, texts), strict=True) if texts else ([], [], [])
        sentence = [_SENTENCE.split(t.lower())[i].strip() if i >= 0 and s >= 0.5 else None
                    for t, i, s in zip(texts, at, score, strict=True)]
        yield pa.record_batch(
            [batch.column("doc_id"), pa.array(score, pa.float64()), pa.array(at, pa.int32()), pa.array(sentence, pa.string()),
             pa.array(worst, pa.float64())], ["doc_id", "score", "sentence_number", "sentence", "sentence_score"],
        )


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, sentence_number, sentence, sentence_score: one row per row of ``docs``.

    The worst sentence is the first of the highest score, numbered from 0 over the whole text; its text,
    lower-cased, is given where the document's score is 0.5 or more. A text without words, or null, has the
    score 0 and the number -1. Repeated rows give repeated rows, a null doc_id stays null, other columns are
    left out, and an empty table gives an empty one.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(lambda batches: _score(batches, model), SCORED)


def _clean(batches: Iterable[pa.RecordBatch], model: Model, text: str, limit: float) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        yield batch.filter(pa.array([model.bag(t)[0] < limit for t in batch.column(text).to_pylist()], pa.bool_()))


def keep_clean(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below ``limit``, as they are, with all their columns."""
    return docs.mapInArrow(lambda batches: _clean(batches, model, "text", limit), docs.schema)
