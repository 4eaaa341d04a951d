"""Worker files of any size, read by many tasks.

A worker file is one JSON object, so a plain reader needs one task for it. Here a file is cut wherever the storage
likes, and three passes find its elements without any of them holding more than a chunk:

1. The text source cuts files into pieces that end with a closing brace, which makes every split start between two
   of them. Pieces are packed into chunks. A chunk does not know whether it starts inside a string, so it says what it
   does to the reader's state in either case: quotes change sides, and of its brackets some close what is open before and
   some stay open. Both follow from quote and bracket positions at once.
2. The chunks' effects, a few numbers each, are put together along each file: now every chunk knows how it starts.
3. Chunks emit the elements they hold, the ends of elements that reach over their edges, and what lies outside the
   elements. Ends are joined; what lies outside is the file's metadata.

No byte is read through anything but Spark's readers, and an element is the largest thing that is ever put together.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollscore.schemas import GENERATION, RANK_FILE
from rollscore.session import cut_lineage
from rollscore.sources.rank_files import NAME, rank_rows, run_of

#: Bytes of a chunk, about: pieces are not cut.
CHUNK = 1 << 20
#: The field whose elements are read apart. Fixed value: a field of worker files.
FIELD = "generations"
OPENS = re.compile(rb'"' + FIELD.encode() + rb'"\s*:\s*\Z')

CHUNKS = "path string, block bigint, number bigint, body binary"
EFFECTS = (
    "path string, block bigint, number bigint, quotes int, closes array<int>, left_open array<binary>"
)
STARTS = "path string, block bigint, number bigint, in_string boolean, depth int, in_field boolean"
FOUND = "path string, block bigint, number bigint, ordinal int, kind int, body string"
#: Kinds of what a chunk emits: a whole element, one that goes on, the rest of one (or its middle), and text outside elements.
WHOLE, BEGIN, REST, OUTSIDE = 0, 1, 2, 3


def _pack(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Pieces of (value, path, block), which follow each other in a block, to chunks of about ``size`` bytes."""
    at, number, held, length = None, 0, [], 0

    def chunk() -> pa.RecordBatch:
        columns = [pa.array([at[0]]), pa.array([at[1]], pa.int64()), pa.array([number], pa.int64()), pa.array([b"".join(held)], pa.binary())]
        return pa.record_batch(columns, ["path", "block", "number", "body"])

    for batch in batches:
        for value, path, block in zip(*(batch.column(c).to_pylist() for c in ("value", "path", "block")), strict=True):
            if (path, block) != at:
                if held:
                    yield chunk()
                at, number, held, length = (path, block), 0, [], 0
            # The source takes the closing brace away. The text after a file's last one gets one too many, which closes nothing.
            held.append(value.encode() + b"}")
            length += len(held[-1])
            if length >= size:
                yield chunk()
                number, held, length = number + 1, [], 0
    if held:
        yield chunk()


def chunks(pieces: DataFrame, size: int) -> DataFrame:
    return pieces.mapInArrow(lambda batches: _pack(batches, size), CHUNKS)


class Marks:
    """Unescaped quotes and, for a chunk that starts outside or inside a string, the brackets outside strings."""

    def __init__(self, body: bytes) -> None:
        raw = np.frombuffer(body, np.uint8)
        quotes = np.flatnonzero(raw == ord('"'))
        slashes = raw == ord("\\")
        if slashes.any():
            # A quote is escaped by an odd number of backslashes before it; chunks start after a brace, never after one.
            place = np.arange(len(raw))
            last_other = np.maximum.accumulate(np.where(slashes, -1, place))
            before = quotes - 1
            run = np.where(before >= 0, before - last_other[np.maximum(before, 0)], 0)
            quotes = quotes[run % 2 == 0]
        self.quotes = quotes
        opening, closing = (raw == ord("{")) | (raw == ord("[")), (raw == ord("}")) | (raw == ord("]"))
        self.at = np.flatnonzero(opening | closing)
        self.step = np.where(opening[self.at], 1, -1)
        self.inside = np.searchsorted(quotes, self.at) % 2  # of a string, if the chunk starts outside one
        self.body = body

    def brackets(self, in_string: bool) -> tuple[np.ndarray, np.ndarray]:
        """Places and steps of the brackets outside strings."""
        chosen = self.inside == int(in_string)
        return self.at[chosen], self.step[chosen]

    def opens_field(self, place: int) -> bool:
        return self.body[place:place + 1] == b"[" and OPENS.search(self.body, max(0, place - 200), place) is not None


def _effects(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        quotes, closes, left = [], [], []
        for body in batch.column("body").to_pylist():
            marks = Marks(body)
            quotes.append(len(marks.quotes) % 2)
            closed, opened = [], []
            for in_string in (False, True):
                at, step = marks.brackets(in_string)
                depth = np.cumsum(step)
                low = min(0, int(depth.min())) if len(depth) else 0
                closed.append(-low)
                # Brackets that stay open: the last ones to reach each depth from the lowest to the end.
                end = int(depth[-1]) if len(depth) else 0
                flags = []
                if end > low:
                    reached = np.flatnonzero(step == 1)
                    lows = np.minimum.accumulate(depth[::-1])[::-1]
                    kept = reached[depth[reached] <= lows[reached]]
                    flags = [marks.opens_field(int(p)) for p in at[kept]]
                opened.append(bytes(flags))
            closes.append(closed)
            left.append(opened)
        yield pa.record_batch(
            [batch.column("path"), batch.column("block"), batch.column("number"), pa.array(quotes, pa.int32()),
             pa.array(closes, pa.list_(pa.int32())), pa.array(left, pa.list_(pa.binary()))],
            ["path", "block", "number", "quotes", "closes", "left_open"],
        )


def _compose(table: pa.Table) -> pa.Table:
    """How each chunk of a file starts, from the effects of those before it."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["block"], r["number"]))
    in_string, stack, found = False, [], []
    for row in rows:
        found.append((in_string, len(stack), len(stack) > 1 and bool(stack[1])))
        case = int(in_string)
        closed = row["closes"][case]
        # What a broken file closes too much is closed by nothing.
        stack = stack[:max(0, len(stack) - closed)] + list(row["left_open"][case])
        in_string ^= bool(row["quotes"])
    strings, depths, fields = zip(*found, strict=True)
    return pa.table({
        "path": [r["path"] for r in rows], "block": pa.array([r["block"] for r in rows], pa.int64()),
        "number": pa.array([r["number"] for r in rows], pa.int64()), "in_string": list(strings),
        "depth": pa.array(depths, pa.int32()), "in_field": list(fields),
    })


def starts(packed: DataFrame) -> DataFrame:
    """One small row per chunk; a file's rows meet in one task, about a hundred bytes for each ``CHUNK`` of it."""
    return packed.mapInArrow(_effects, EFFECTS).groupBy("path").applyInArrow(_compose, STARTS)


def _cut(body: bytes, in_string: bool, depth: int, in_field: bool) -> Iterator[tuple[int, bytes]]:
    """What a chunk holds: (kind, bytes). Elements are objects two levels down, in the field's array."""
    marks = Marks(body)
    at, step = marks.brackets(in_string)
    after = depth + np.cumsum(step)
    # Only brackets that open or close an element, or the array itself, matter.
    turns = np.flatnonzero((after <= 3) & ((step == 1) | (after <= 2)))
    begun = 0 if depth > 2 and in_field else None
    first, outside, skip = begun is not None, 0, depth == 0 or in_field and depth > 1
    for i in turns.tolist():
        place, level, opens = int(at[i]), int(after[i]), step[i] == 1
        if opens and level == 1:
            outside, skip = place, False
        elif opens and level == 2:
            in_field = marks.opens_field(place)
            if in_field:
                yield OUTSIDE, body[outside:place + 1]
                skip = True
        elif opens and level == 3 and in_field:
            begun, first = place, False
        elif not opens and level == 2 and in_field and begun is not None:
            yield (REST if first else WHOLE), body[begun:place + 1]
            begun, first = None, False
        elif not opens and level == 1 and in_field:
            in_field, skip, outside = False, False, place
        elif not opens and level == 0:
            yield OUTSIDE, body[outside:place + 1]
            skip = True
    if begun is not None:
        yield (REST if first else BEGIN), body[begun:]
    if not skip:
        yield OUTSIDE, body[outside:]


def _find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["path", "block", "number", "body", "in_string", "depth", "in_field"]
    for batch in batches:
        for path, block, number, body, in_string, depth, in_field in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            kinds, bodies = [], []
            for kind, part in _cut(body, in_string, depth, in_field):
                kinds.append(kind)
                bodies.append(part.decode())
            n = len(kinds)
            yield pa.record_batch(
                [pa.array([path] * n, pa.string()), pa.array([block] * n, pa.int64()), pa.array([number] * n, pa.int64()),
                 pa.array(range(n), pa.int32()), pa.array(kinds, pa.int32()), pa.array(bodies, pa.string())],
                ["path", "block", "number", "ordinal", "kind", "body"],
            )


def element_rows(spark: SparkSession, path: str, name: str, size: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(path, body) of each element of the field in files called ``name`` under ``path``, and (path, body) of each file's rest.

    The rest is the file's object with an empty array in place of the elements.
    """
    options = {"recursiveFileLookup": True, "pathGlobFilter": name, "lineSep": "}"}
    pieces = spark.read.options(**options).text(path).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")
    )
    packed = chunks(pieces, size)
    place = ["path", "block", "number"]
    found = packed.join(cut_lineage(starts(packed)), place).mapInArrow(_find, FOUND)
    # All but whole elements is little: two ends a chunk, and the files' metadata.
    edges = cut_lineage(found.where(F.col("kind") != WHOLE))
    along = Window.partitionBy("path").orderBy("block", "number", "ordinal").rowsBetween(Window.unboundedPreceding, 0)
    ends = edges.where(F.col("kind") != OUTSIDE)
    owned = ends.withColumn("element", F.sum(F.when(F.col("kind") == BEGIN, 1).otherwise(0)).over(along))
    part = F.struct("block", "number", "ordinal", "body")

    def joined(rows: DataFrame, *keys: str) -> DataFrame:
        parts = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(part)).alias("parts"))
        return parts.select("path", F.array_join(F.transform("parts", lambda p: p["body"]), "").alias("body"))

    whole, rest = joined(owned, "path", "element"), joined(edges.where(F.col("kind") == OUTSIDE), "path")
    return found.where(F.col("kind") == WHOLE).select("path", "body").unionByName(whole), rest


def read_rank_ranges(
    spark: SparkSession, path: str, dataset: str, size: int = CHUNK, name: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """What ``read_rank_files`` returns - rank metadata and generations of all runs - with files read by many tasks.

    Use it where worker files are larger than one task should parse. A file that is not one JSON object gives a row of NULLs in the
    metadata, as there; elements that are no objects are left out.
    """
    elements, rest = element_rows(spark, path, name or NAME.format(dataset=dataset), size)
    whole = T.StructType([f for f in RANK_FILE.fields if f.name != FIELD])
    files = rest.select("path", F.from_json("body", whole).alias("_file")).select("path", "_file.*").withColumn("run", run_of(F.col("path"), path))
    files = cut_lineage(files)
    if files.isEmpty():
        raise ValueError(f"No {dataset} generation files in {path}")
    items = elements.select("path", F.from_json("body", GENERATION).alias("_item"))
    generations = items.join(files.select("path", "run", "rank"), "path").select("run", "rank", "_item.*")
    return rank_rows(files), generations
