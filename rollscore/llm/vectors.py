"""Near-duplicate embeddings by PCA-ordered, tiled comparison.

Vectors are scaled to length one and turned so that the leading dimensions carry most of the length
(principal axes of all vectors' second moments). Tiles hold neighbours along the first axis; two tiles
meet only if that axis leaves room for the threshold. Within a pair of tiles the products of the leading
dimensions are added first; the rest of a product is at most the product of the two remaining lengths, so
most pairs stop there. Pairs that are left get the cosine of the vectors as they came, in double precision.

Exact copies are compared once, with a count. A tile pair reports per vector its number of links and one
link into its group, so a group of near copies costs rows in proportion to its members, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollscore.llm.batches import list_arrays
from rollscore.llm.components import components
from rollscore.session import cut_lineage

TILE = 4096
STRIP = 512
LEADING = 16
#: Products may be off by this much after turning; pairs this near the threshold are computed anew.
SLACK = 1e-9
#: Share of a strip's pairs from which all are multiplied on, instead of one by one.
DENSE = 0.05

MATCHES = "id bigint, links bigint, root bigint"


def finite(vector: Column) -> Column:
    """True for a vector without null or non-finite components."""
    x = vector.cast("array<double>")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(good, F.lit(False))


def matrix(column: pa.ListArray, width: int = 0) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    rows = list_arrays(column)
    if rows and width and all(len(r) == width for r in rows):
        return np.concatenate(rows).reshape(-1, width).astype(float)
    found = np.zeros((len(rows), max([width, *map(len, rows)])))
    for i, row in enumerate(rows):
        found[i, :len(row)] = row
    return found


def _units(vectors: np.ndarray) -> np.ndarray:
    # Scaled by the largest component first: squares neither overflow nor vanish.
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _moments(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros((width, width))
    for batch in batches:
        units = _units(matrix(batch.column("vector"), width))
        total += units.T @ units
    yield pa.record_batch([pa.array(np.arange(width * width)), pa.array(total.ravel())], ["place", "value"])


def principal_axes(vectors: DataFrame, width: int) -> np.ndarray:
    """Axes of falling weight over all vectors; the driver gets width x width sums."""
    sums = vectors.mapInArrow(lambda b: _moments(b, width), "place bigint, value double")
    total = np.zeros(width * width)
    for row in sums.groupBy("place").agg(F.sum("value").alias("value")).collect():
        total[row.place] = row.value
    _, axes = np.linalg.eigh(total.reshape(width, width))
    return axes[:, ::-1].copy()


def _along(batches: Iterable[pa.RecordBatch], axis: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        along = _units(matrix(batch.column("vector"), len(axis))) @ axis
        yield batch.append_column("along", pa.array(along))


class Groups:
    """Groups of a tile pair's rows, joined strip by strip."""

    def __init__(self, size: int) -> None:
        self.root = np.arange(size)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            hi, lo = np.maximum(x, y)[apart], np.minimum(x, y)[apart]
            np.minimum.at(root, hi, lo)
            while (root[root] != root).any():
                root[:] = root[root]


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b)


def _compare(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float, same: bool) -> Iterator[tuple]:
    """Linked (row of a, row of b) index arrays, strip by strip; a is b if ``same``."""
    ua, ub = _units(a), _units(b)
    ta, tb = ua @ axes, ub @ axes
    rest_a = np.sqrt((ta[:, LEADING:] ** 2).sum(axis=1))
    rest_b = np.sqrt((tb[:, LEADING:] ** 2).sum(axis=1))
    for start in range(0, len(a), STRIP):
        end = min(start + STRIP, len(a))
        first = start if same else 0
        partial = ta[start:end, :LEADING] @ tb[first:, :LEADING].T
        open_ = partial + rest_a[start:end, None] * rest_b[None, first:] >= threshold - SLACK
        if open_.sum() > DENSE * open_.size:
            partial += ta[start:end, LEADING:] @ tb[first:, LEADING:].T
            open_ &= partial >= threshold - SLACK
        i, j = np.nonzero(open_)
        i, j = i + start, j + first
        if same:
            i, j = i[j > i], j[j > i]
        for at in range(0, len(i), 1 << 18):
            x, y = i[at:at + (1 << 18)], j[at:at + (1 << 18)]
            products = _cosines(ua[x], ub[y])
            linked, near = products >= threshold, np.abs(products - threshold) < SLACK
            if near.any():  # as defined: product over lengths
                p, q = a[x[near]], b[y[near]]
                with np.errstate(over="ignore", invalid="ignore"):
                    cosine = _cosines(p, q) / (np.sqrt(_cosines(p, p)) * np.sqrt(_cosines(q, q)))
                linked[near] = np.where(np.isfinite(cosine), cosine >= threshold, linked[near])
            yield x[linked], y[linked]


def _tile_pair(key: tuple, table: pa.Table, axes: np.ndarray, threshold: float) -> pa.Table:
    low, high = (k.as_py() for k in key)
    tiles = table.column("tile").to_numpy()
    ids, weights = table.column("id").to_numpy(), table.column("weight").to_numpy()
    vectors = matrix(table.column("vector").combine_chunks(), len(axes))
    same = low == high
    at_a = np.flatnonzero(tiles == low)
    at_b = at_a if same else np.flatnonzero(tiles == high)
    links, groups = np.zeros(len(ids), np.int64), Groups(len(ids))
    if len(at_a) and len(at_b):
        for i, j in _compare(vectors[at_a], vectors[at_b], axes, threshold, same):
            x, y = at_a[i], at_b[j]
            np.add.at(links, x, weights[y])
            np.add.at(links, y, weights[x])
            groups.join(x, y)
    hit = links > 0
    return pa.table({"id": ids[hit], "links": links[hit], "root": ids[groups.root[hit]]})


class Tiles:
    """Which tile a vector lies in, and which tiles a tile can have links to.

    Ranges of the first axis hold about ``size`` vectors each. A range with more, as many share a value,
    is dealt into parts by id. Tiles are numbered along the axis, so those within reach are neighbours.
    """

    def __init__(self, placed: DataFrame, count: int, size: int, reach: float) -> None:
        ranges = max(1, -(-count // size))
        ends = placed.approxQuantile("along", [k / ranges for k in range(1, ranges)], 0.2 / ranges) if ranges > 1 else []
        self.ends = np.unique(np.array(ends, float))
        found = placed.mapInArrow(self.ranges, "range int, along double").groupBy("range").agg(
            F.count(F.lit(1)).alias("n"), F.min("along").alias("low"), F.max("along").alias("high")
        ).orderBy("range").collect()
        number, parts = np.array([r.range for r in found], int), [-(-r.n // (2 * size)) for r in found]
        self.base, self.parts = np.zeros(len(self.ends) + 2, int), np.ones(len(self.ends) + 1, int)
        self.parts[number] = parts
        self.base[1:] = np.cumsum(self.parts)
        lows, highs = np.full(self.base[-1], np.inf), np.full(self.base[-1], -np.inf)
        for r in found:
            lows[self.base[r.range]:self.base[r.range + 1]] = r.low
            highs[self.base[r.range]:self.base[r.range + 1]] = r.high
        full = np.flatnonzero(highs >= lows)
        self.first, self.last = np.zeros(len(lows), int), np.full(len(lows), -1)
        self.first[full] = full[np.searchsorted(highs[full], lows[full] - reach, side="left")]
        self.last[full] = full[np.searchsorted(lows[full], highs[full] + reach, side="right") - 1]

    def ranges(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(self.ends, batch.column("along").to_numpy(), side="right")
            yield pa.record_batch([pa.array(at, pa.int32()), batch.column("along")], ["range", "along"])

    def deal(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with their tile and the first and last tile within reach."""
        for batch in batches:
            at = np.searchsorted(self.ends, batch.column("along").to_numpy(), side="right")
            tile = self.base[at] + batch.column("deal").to_numpy() % self.parts[at]
            kept = batch.select(["id", "weight", "vector"])
            for name, values in (("tile", tile), ("first", self.first[tile]), ("last", self.last[tile])):
                kept = kept.append_column(name, pa.array(values, pa.int64()))
            yield kept


def near_duplicates(
    rows: DataFrame, threshold: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding", tile: int = TILE
) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``rows``.

    Vectors link where their cosine reaches ``threshold``, which is above zero. ``n_links`` counts the
    other rows linked directly, ``component_id`` is the smallest vec_id reachable by links, ``kept`` marks
    the row that has it. Vectors that are null, empty, zero, or hold null or non-finite components link
    with nothing; so do rows without a vec_id, whose component_id and kept are null. Shorter vectors count
    as ending in zeros. Repeated rows link with each other; rows that share a vec_id are one vertex of
    the components. Other columns are left out. An empty table gives an empty one.
    """
    rows = rows.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).alias("vector"))
    usable = rows.where(
        F.col("vec_id").isNotNull() & finite(F.col("vector")) & F.exists("vector", lambda x: x != 0)
    )
    copies = usable.groupBy("vector").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("weight"))
    copies = cut_lineage(copies)
    count, width = copies.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    axes = principal_axes(copies.select("vector"), width)
    axis = axes[:, 0].copy()
    type_ = copies.schema["vector"].dataType.simpleString()
    placed = copies.select("vector", "id", "weight").mapInArrow(
        lambda batches: _along(batches, axis), f"vector {type_}, id bigint, weight bigint, along double"
    )
    placed = cut_lineage(placed.withColumn("deal", F.pmod(F.xxhash64("id", "vector"), F.lit(1 << 31))))
    reach = float(np.sqrt(2 - 2 * threshold)) + SLACK
    deal = Tiles(placed, count, tile, reach).deal
    dealt = placed.mapInArrow(
        deal, f"id bigint, weight bigint, vector {type_}, tile bigint, first bigint, last bigint"
    )
    met = dealt.withColumn("other", F.explode(F.sequence("first", "last"))).select(
        F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "id", "weight", "vector"
    )
    matches = cut_lineage(met.groupBy("low", "high").applyInArrow(
        lambda key, table: _tile_pair(key, table, axes, threshold), MATCHES
    ))
    links = matches.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(matches, "id", "root").select(F.col("node").alias("id"), "component")
    judged = copies.join(links, "id", "left").join(groups, "id", "left").select(
        "vector", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "id").alias("c")
    )
    keyed = rows.withColumn("_v", F.when(F.col("vec_id").isNotNull(), F.col("vector")))
    found = keyed.join(judged.select(F.col("vector").alias("_v"), "n", "c"), "_v", "left")
    component = F.coalesce("c", "vec_id")
    return found.select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        (F.col("vec_id") == component).alias("kept"),
    )
