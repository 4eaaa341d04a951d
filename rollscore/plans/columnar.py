"""Rows of a group as one short binary value, for shuffles of many narrow rows.

A task packs the rows it has of a group, column by column: whole numbers as differences or offsets of the width they need,
other values as numbers of a table where few differ and as planes of bytes where not, all of it compressed. No value is
changed, and rows that do not compress cost what they would cost as they are. A group of few rows is kept as fixed-width records.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

#: Rows that a task holds before it packs them, and rows unpacked at a time: bounds of memory, never change a result.
BUFFER = 1 << 18
#: Groups of fewer rows stay records.
FEW = 12
WIDTHS = {
    "tinyint": (np.dtype("i1"), pa.int8()), "smallint": (np.dtype("<i2"), pa.int16()), "int": (np.dtype("<i4"), pa.int32()),
    "bigint": (np.dtype("<i8"), pa.int64()), "float": (np.dtype("<f4"), pa.float32()), "double": (np.dtype("<f8"), pa.float64()),
    "boolean": (np.dtype("u1"), pa.bool_()),
}
PLANES, TABLE, OFFSETS, DIFFERENCES = range(4)
Kinds = dict[str, str]


def kinds_of(rows: DataFrame, by: Sequence[str]) -> Kinds | None:
    """The types of the columns beside ``by``; None if one of them is not of fixed width."""
    kinds = {name: kind for name, kind in rows.dtypes if name not in by}
    return kinds if all(kind in WIDTHS for kind in kinds.values()) else None


def _planes(values: np.ndarray) -> bytes:
    return values.view("u1").reshape(len(values), values.itemsize).T.tobytes()


def _narrow(values: np.ndarray) -> tuple[int, int, bytes] | None:
    """Least value, bytes a value and what is above the least value; None where the range is too wide."""
    low, high = int(values.min()), int(values.max())
    span = high - low
    if span >> 32:
        return None
    width = 0 if span == 0 else 1 if span < 1 << 8 else 2 if span < 1 << 16 else 4
    return low, width, b"" if width == 0 else _planes((values - low).astype(f"<u{width}"))


def _column(values: np.ndarray) -> bytes:
    if values.dtype.kind != "f":
        wide = values.astype("<i8")
        plain, steps = _narrow(wide), _narrow(np.diff(wide)) if len(wide) > 1 else None
        if steps is not None and (plain is None or steps[1] < plain[1]):
            return struct.pack("<BBqq", DIFFERENCES, steps[1], int(wide[0]), steps[0]) + steps[2]
        if plain is not None:
            return struct.pack("<BBq", OFFSETS, plain[1], plain[0]) + plain[2]
        return struct.pack("<B", PLANES) + _planes(values)
    bits = values.view(f"<i{values.itemsize}")
    different, at = np.unique(bits, return_inverse=True)
    if len(different) <= 256 and 2 * len(different) <= len(bits):
        return struct.pack("<BH", TABLE, len(different)) + _planes(different) + at.astype("u1").tobytes()
    return struct.pack("<B", PLANES) + _planes(values)


def _from_planes(data: memoryview, at: int, n: int, kind: np.dtype) -> tuple[np.ndarray, int]:
    end = at + n * kind.itemsize
    planes = np.frombuffer(data[at:end], "u1").reshape(kind.itemsize, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(n), end


def _read_column(data: memoryview, at: int, n: int, kind: np.dtype) -> tuple[np.ndarray, int]:
    code = data[at]
    if code == PLANES:
        return _from_planes(data, at + 1, n, kind)
    if code == TABLE:
        different, at = _from_planes(data, at + 3, struct.unpack_from("<H", data, at + 1)[0], kind)
        return different[np.frombuffer(data[at:at + n], "u1")], at + n
    if code == OFFSETS:
        width, low = struct.unpack_from("<Bq", data, at + 1)
        at += 10
        if width == 0:
            return np.full(n, low).astype(kind), at
        above, at = _from_planes(data, at, n, np.dtype(f"<u{width}"))
        return (above.astype("<i8") + low).astype(kind), at
    width, first, low = struct.unpack_from("<Bqq", data, at + 1)
    at += 18
    steps = np.full(n, low, "<i8")
    if width:
        above, at = _from_planes(data, at, n - 1, np.dtype(f"<u{width}"))
        steps[1:] += above
    steps[0] = first
    return np.cumsum(steps).astype(kind), at


def _layout(kinds: Kinds) -> np.dtype:
    return np.dtype([("_nulls", "u1", (-(-len(kinds) // 8),)), *((f"c{i}", WIDTHS[k][0]) for i, k in enumerate(kinds.values()))])


def _packed(records: np.ndarray, codec: pa.Codec) -> bytes:
    plain = records.tobytes()
    if len(records) < FEW:
        return plain
    parts = []
    for plane in np.ascontiguousarray(records["_nulls"].T):
        known = plane.any()
        parts.append(b"\1" + plane.tobytes() if known else b"\0")
    parts += [_column(np.ascontiguousarray(records[name])) for name in records.dtype.names[1:]]
    whole = b"".join(parts)
    short = struct.pack("<I", len(whole)) + codec.compress(whole, asbytes=True)
    return short if len(short) < len(plain) else plain


def _unpacked(data: bytes, n: int, layout: np.dtype, codec: pa.Codec) -> np.ndarray:
    whole = memoryview(codec.decompress(memoryview(data)[4:], struct.unpack_from("<I", data)[0], asbytes=True))
    records, at = np.empty(n, layout), 0
    for i in range(records["_nulls"].shape[1]):
        known, at = whole[at], at + 1
        records["_nulls"][:, i] = np.frombuffer(whole[at:at + n], "u1") if known else 0
        at += n * known
    for name in layout.names[1:]:
        records[name], at = _read_column(whole, at, n, layout[name])
    return records


def group_codes(table: pa.Table, by: Sequence[str]) -> list[np.ndarray]:
    """Each column of ``by`` as numbers that are equal where its values are; NULL equals NULL."""
    codes = []
    for name in by:
        column = table.column(name).combine_chunks()
        coded = column.dictionary_encode(null_encoding="encode")
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        codes.append(coded.indices.to_numpy(zero_copy_only=False))
    return codes


def _groups(table: pa.Table, by: Sequence[str], order: str) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a group side by side, by ``order`` where it is known, and where each group begins."""
    codes = group_codes(table, by)
    place = pc.fill_null(table.column(order), 0).to_numpy()
    at = np.lexsort((place, *codes))
    begins = np.zeros(len(at), bool)
    begins[:1] = True
    for code in codes:
        begins[1:] |= code[at[1:]] != code[at[:-1]]
    return at, np.flatnonzero(begins)


def _records(table: pa.Table, kinds: Kinds) -> np.ndarray:
    records = np.zeros(len(table), _layout(kinds))
    for i, (name, kind) in enumerate(kinds.items()):
        column = table.column(name).combine_chunks()
        if column.null_count:
            records["_nulls"][:, i // 8] |= column.is_null().to_numpy(zero_copy_only=False).astype("u1") << (i % 8)
            column = pc.fill_null(column, False if kind == "boolean" else 0)
        records[f"c{i}"] = column.to_numpy(zero_copy_only=False)
    return records


def held_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """A task's rows in tables of about ``BUFFER`` rows."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= BUFFER:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def packed_batches(batches: Iterable[pa.RecordBatch], by: list[str], order: str, kinds: Kinds) -> Iterator[pa.RecordBatch]:
    codec = pa.Codec("zstd", compression_level=3)
    for table in held_batches(batches):
        at, begins = _groups(table, by, order)
        records, ends = _records(table, kinds)[at], [*begins[1:], len(at)]
        data = pa.array([_packed(records[a:b], codec) for a, b in zip(begins, ends, strict=True)], pa.binary())
        firsts = pa.array(at[begins])
        keys = [table.column(name).combine_chunks().take(firsts) for name in by]
        yield pa.record_batch([*keys, pa.array(np.diff([*begins, len(at)]), pa.int32()), data], [*by, "_n", "_data"])


def packed_schema(rows: DataFrame, by: Sequence[str]) -> StructType:
    return StructType([*(rows.schema[name] for name in by), StructField("_n", IntegerType()), StructField("_data", BinaryType())])


def parts(rows: DataFrame, by: Sequence[str], order: str, kinds: Kinds) -> DataFrame:
    """One row per group of ``by`` and task buffer: ``by``, the number of rows ``_n`` and all other columns as ``_data``."""
    by = list(by)
    return rows.select(*by, *kinds).mapInArrow(lambda batches: packed_batches(batches, by, order, kinds), packed_schema(rows, by))


def gather(packed: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """One row per group of ``by``, with its parts as the array ``name``, which ``unpack`` reads."""
    return packed.groupBy(*by).agg(F.collect_list(F.struct("_n", "_data")).alias(name))


def unpack(column: pa.ListArray, kinds: Kinds) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """The columns of all packed rows of an array of parts, and the row each entry belongs to, in the order of the rows."""
    codec, layout = pa.Codec("zstd"), _layout(kinds)
    parent, values = pc.list_parent_indices(column).to_numpy(), pc.list_flatten(column)
    counts, data = values.field("_n").to_numpy(), values.field("_data").to_pylist()
    plain = [len(d) == n * layout.itemsize for d, n in zip(data, counts.tolist(), strict=True)]
    pieces = [np.frombuffer(b"".join([d for d, is_plain in zip(data, plain, strict=True) if is_plain]), layout)]
    pieces += [_unpacked(d, n, layout, codec) for d, n, is_plain in zip(data, counts.tolist(), plain, strict=True) if not is_plain]
    chosen = np.asarray(plain, bool)
    order = np.concatenate([np.flatnonzero(chosen), np.flatnonzero(~chosen)])
    rows, records = np.repeat(parent[order], counts[order]), np.concatenate(pieces)
    if len(rows) and (np.diff(rows) < 0).any():
        at = np.argsort(rows, kind="stable")
        rows, records = rows[at], records[at]
    columns = {}
    for i, (name, kind) in enumerate(kinds.items()):
        missing = (records["_nulls"][:, i // 8] >> (i % 8) & 1).astype(bool)
        value = np.ascontiguousarray(records[f"c{i}"])
        columns[name] = pa.array(value.astype(bool) if kind == "boolean" else value, WIDTHS[kind][1], mask=missing if missing.any() else None, from_pandas=False)
    return rows, columns


def whole_rows(packed: DataFrame, schema: StructType, kinds: Kinds) -> DataFrame:
    """The rows that ``parts`` packed, with the columns that its rows have been given since."""
    names = schema.names

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = pa.StructArray.from_arrays([batch.column("_n"), batch.column("_data")], ["_n", "_data"])
            one = pa.record_batch([*batch.columns, pa.ListArray.from_arrays(pa.array(range(len(batch) + 1), pa.int32()), part)], [*batch.schema.names, "_parts"])
            for piece in bounded([one], "_parts"):
                parent, values = unpack(piece.column("_parts"), kinds)
                at = pa.array(parent)
                yield pa.record_batch([values[n] if n in kinds else piece.column(n).take(at) for n in names], names)

    return packed.mapInArrow(rows, schema)


def bounded(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose arrays of parts hold about ``BUFFER`` rows at most."""
    for batch in batches:
        held = np.zeros(len(batch), "int64")
        for name in names:
            column = batch.column(name)
            counts = pc.list_flatten(column).field("_n").to_numpy(zero_copy_only=False)
            held += np.bincount(pc.list_parent_indices(column).to_numpy(), counts, len(batch)).astype("int64")
        piece = np.cumsum(held) // BUFFER
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(batch)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)
