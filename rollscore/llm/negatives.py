"""Hard negatives: near misses of another label, by Strassen products of integer tiles.

Vectors become 64-bit integers. Anchor blocks meet candidate blocks, and a tile's scores are one matrix
product, multiplied by Strassen's recursion: seven half-size products instead of eight, odd sides padded by
zeros. All its steps are additions and products of 64-bit integers, so scores are exact.

1. Positives: candidates are dealt by label, so an anchor meets only the blocks of its own label. Each tile
   leaves a heap of the best k per anchor; heaps merge into the anchor's positives.
2. Windows: anchors, now with a score window per positive, meet all candidates. Each tile leaves a heap of the
   best few inside each window; those merge too.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollscore.llm.topk import best, weights
from rollscore.llm.vectors import finite, matrix
from rollscore.plans.skew import attach
from rollscore.session import cut_lineage

ANCHOR_BLOCK = 1024
CANDIDATE_BLOCK = 4096
#: Sides from which a product is no longer split.
LEAF = 8

POSITIVES = "anchor_id bigint, anchor_key bigint, positive_id bigint, score bigint"
NEGATIVES = "anchor_id bigint, anchor_key bigint, positive_score bigint, negative_id bigint, score bigint"


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b over 64-bit integers; sums wrap as they do in numpy, in every order alike."""
    (rows, inner), columns = a.shape, b.shape[1]
    if min(rows, inner, columns) <= leaf:
        return a @ b
    if rows % 2 or inner % 2 or columns % 2:
        a = np.pad(a, ((0, rows % 2), (0, inner % 2)))
        b = np.pad(b, ((0, inner % 2), (0, columns % 2)))
        return strassen(a, b, leaf)[:rows, :columns]
    r, i, c = rows // 2, inner // 2, columns // 2
    a11, a12, a21, a22 = a[:r, :i], a[:r, i:], a[r:, :i], a[r:, i:]
    b11, b12, b21, b22 = b[:i, :c], b[:i, c:], b[i:, :c], b[i:, c:]
    found = np.empty((rows, columns), np.int64)
    top_left, top_right, low_left, low_right = found[:r, :c], found[:r, c:], found[r:, :c], found[r:, c:]
    product = strassen(a11 + a22, b11 + b22, leaf)
    top_left[:], low_right[:] = product, product
    product = strassen(a21 + a22, b11, leaf)
    low_left[:] = product
    low_right -= product
    product = strassen(a11, b12 - b22, leaf)
    top_right[:] = product
    low_right += product
    product = strassen(a22, b21 - b11, leaf)
    top_left += product
    low_left += product
    product = strassen(a11 + a12, b22, leaf)
    top_left -= product
    top_right += product
    low_right += strassen(a21 - a11, b11 + b12, leaf)
    top_left += strassen(a12 - a22, b21 + b22, leaf)
    return found


class Tile:
    """A block of anchors and a block of candidates in the order of their ids, with all scores."""

    def __init__(self, anchors: pa.Table, candidates: pa.Table, scale: float) -> None:
        order = np.argsort(candidates.column("id").to_numpy(), kind="stable")
        self.ids = candidates.column("id").to_numpy()[order]
        self.labels = candidates.column("label").to_numpy()[order]
        self.anchor_ids = anchors.column("id").to_numpy()
        self.anchor_keys = anchors.column("key").to_numpy()
        self.anchor_labels = anchors.column("label").to_numpy()
        left = weights(matrix(anchors.column("vector").combine_chunks()), scale)
        right = weights(matrix(candidates.column("vector").combine_chunks()), scale)[order]
        width = min(left.shape[1], right.shape[1])  # what a shorter vector lacks is zero
        with np.errstate(over="ignore"):
            self.scores = strassen(left[:, :width], np.ascontiguousarray(right[:, :width].T))


def _table(columns: Iterable[list[np.ndarray]], names: list[str]) -> pa.Table:
    joined = [np.concatenate(c) if c else np.empty(0, np.int64) for c in columns]
    return pa.table([pa.array(c, pa.int64()) for c in joined], names=names)


def _positives(anchors: pa.Table, candidates: pa.Table, k: int, scale: float) -> pa.Table:
    found: list[list] = [[], [], [], []]
    if anchors.num_rows and candidates.num_rows:
        tile = Tile(anchors, candidates, scale)
        for i, own in enumerate(tile.anchor_ids):
            at = np.flatnonzero((tile.labels == tile.anchor_labels[i]) & (tile.ids != own))
            at = at[best(tile.scores[i, at], tile.ids[at], k)]
            for column, values in zip(found, (
                np.full(len(at), own), np.full(len(at), tile.anchor_keys[i]), tile.ids[at], tile.scores[i, at]
            ), strict=True):
                column.append(values)
    return _table(found, ["anchor_id", "anchor_key", "positive_id", "score"])


def bounds(positive: int, low: int, high: int) -> tuple[int, int]:
    """The smallest and largest score s with low * positive <= 100 * s <= high * positive."""
    return -(-low * positive // 100), high * positive // 100


def _negatives(anchors: pa.Table, candidates: pa.Table, k: int, low: int, high: int, scale: float) -> pa.Table:
    found: list[list] = [[], [], [], [], []]
    if anchors.num_rows and candidates.num_rows:
        tile = Tile(anchors, candidates, scale)
        for i, windows in enumerate(anchors.column("windows").to_pylist()):
            limits = [bounds(p, low, high) for p in windows]
            scores = tile.scores[i]
            # The windows together first: what lies outside all of them is looked at once.
            near = (scores >= min(a for a, _ in limits)) & (scores <= max(b for _, b in limits))
            near = np.flatnonzero(near & (tile.labels != tile.anchor_labels[i]))
            scores, ids = scores[near], tile.ids[near]
            for positive, (a, b) in zip(windows, limits, strict=True):
                at = np.flatnonzero((scores >= a) & (scores <= b))
                at = at[best(scores[at], ids[at], k)]
                for column, values in zip(found, (
                    np.full(len(at), tile.anchor_ids[i]), np.full(len(at), tile.anchor_keys[i]), np.full(len(at), positive),
                    ids[at], scores[at],
                ), strict=True):
                    column.append(values)
    return _table(found, ["anchor_id", "anchor_key", "positive_score", "negative_id", "score"])


def _parts(n: Column, size: int) -> Column:
    return F.ceil(n / F.lit(size)).cast("bigint")


def _each(parts: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    scale: float = 256.0, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A score is the inner product of floor(scale * x) over components, in 64-bit integers. An anchor's positives are
    the ``positives`` best other rows of its label, all if there are fewer; for each of them, the ``negatives`` best
    rows of other labels with low * positive_score <= 100 * score <= high * positive_score, ranked from 1. Higher scores
    come first, ties by smaller id. ``low`` and ``high`` are whole per cents; a negative positive score leaves no room
    between them, as 0 leaves the score 0 only.

    Rows without an id, label or vector, or with null or non-finite components, take no part; a shorter vector ends in
    zeros. A repeated candidate row counts as often as it is there; an anchor row (its id, label and vector) repeated is
    asked once; rows with the anchor's id are never its positives. Anchors with one id but other vectors or labels are
    asked each, and their rows follow each other under that id. Other columns are left out. An empty table gives no rows.

    Candidates of one label are dealt into parts of about ``CANDIDATE_BLOCK`` rows, so a label may hold any share of
    all rows. Work grows with anchors times rows, as every pair of different labels has to be scored once.
    """
    usable = vectors.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & finite(F.col(embedding)))
    own = [F.col(vec_id).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), F.col(embedding).alias("vector")]
    rows = usable.select(*own)
    anchors = usable.where(is_anchor).select(*own).withColumn("key", F.xxhash64("label", "vector")).dropDuplicates(["id", "key"])
    dealt = F.xxhash64("id", "vector")

    # Positives: blocks of labels. Rare labels share a bucket; a frequent one has parts of its own.
    n_rows, n_anchors = usable.agg(F.count(F.lit(1)), F.count_if(is_anchor)).first()
    blocks = 1 + n_rows // CANDIDATE_BLOCK
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"))
    asked = anchors.groupBy("label").agg(F.count(F.lit(1)).alias("n_anchors"))
    per_label = sizes.join(asked, "label").select(
        "label", "n_rows", _parts(F.col("n_rows"), CANDIDATE_BLOCK).alias("parts"),
        _parts(F.col("n_anchors"), ANCHOR_BLOCK).alias("turns"),
    )
    bucket = F.pmod(F.xxhash64("label"), F.lit(blocks)).alias("bucket")
    same = attach(rows, per_label, ["label"]).where(F.col("parts").isNotNull()).select(
        bucket, F.pmod(dealt, F.col("parts")).alias("part"), _each(F.col("turns")).alias("turn"), "id", "label", "vector"
    )
    asking = attach(anchors, per_label, ["label"]).select(
        bucket, _each(F.col("parts")).alias("part"), F.pmod(dealt, F.col("turns")).alias("turn"), "id", "label", "key", "vector"
    )
    place = ["bucket", "part", "turn"]
    heaps = asking.groupBy(*place).cogroup(same.groupBy(*place)).applyInArrow(
        lambda left, right: _positives(left, right, positives, scale), POSITIVES
    )
    order = Window.partitionBy("anchor_id", "anchor_key").orderBy(F.desc("score"), "positive_id")
    first = heaps.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    # Read twice: for the windows, and for the answer.
    first = cut_lineage(first.select("anchor_id", "anchor_key", "place", "positive_id", F.col("score").alias("positive_score")))

    # Windows: equal scores of positives ask the same, so each anchor has one window per distinct score.
    windows = first.groupBy("anchor_id", "anchor_key").agg(F.collect_set("positive_score").alias("windows"))
    turns = 1 + n_anchors // ANCHOR_BLOCK
    held = anchors.join(windows, (F.col("id") == F.col("anchor_id")) & (F.col("key") == F.col("anchor_key")))
    held = held.select(
        _each(F.lit(blocks)).alias("block"), F.pmod(dealt, F.lit(turns)).alias("turn"), "id", "label", "key", "vector", "windows"
    )
    all_rows = rows.select(F.pmod(dealt, F.lit(blocks)).alias("block"), _each(F.lit(turns)).alias("turn"), "id", "label", "vector")
    near = held.groupBy("block", "turn").cogroup(all_rows.groupBy("block", "turn")).applyInArrow(
        lambda left, right: _negatives(left, right, negatives, low, high, scale), NEGATIVES
    )
    order = Window.partitionBy("anchor_id", "anchor_key", "positive_score").orderBy(F.desc("score"), "negative_id")
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return first.join(ranked, ["anchor_id", "anchor_key", "positive_score"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score",
        F.col("score").alias("negative_score"),
    )
