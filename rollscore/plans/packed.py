"""Joins on position without a row per token in the shuffle.

Rows of a key are packed into arrays, one per ``PACKED`` positions, and meet there. Arrays repeat no key and need no sort, so
a shuffle of them is a fraction of one of rows; a key of any length is spread over as many tasks as it has chunks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rollscore.plans.columnar import Kinds, bounded, gather, kinds_of, parts, unpack

#: Positions of a chunk: bounds the size of a packed row, never changes a result.
PACKED = 4096
CHUNK = "_chunk"


def chunk_of(pos: Column) -> Column:
    return F.floor(pos / F.lit(PACKED)).cast("bigint")


def pack(rows: DataFrame, keys: Sequence[str], pos: str, name: str) -> tuple[DataFrame, Kinds | None]:
    """One row per key and chunk of ``pos``, with all other columns of its rows, and what ``flat`` needs to read them.

    Columns of fixed width are packed by ``columnar`` before they are shuffled; others are an array of structs.
    """
    by, others = [*keys, CHUNK], [c for c in rows.columns if c not in keys]
    placed, kinds = rows.select(*keys, chunk_of(F.col(pos)).alias(CHUNK), *others), kinds_of(rows, keys)
    if kinds is not None:
        return gather(parts(placed, by, pos, kinds), by, name), kinds
    return placed.groupBy(*by).agg(F.collect_list(F.struct(*others)).alias(name)), None


def flat(column: pa.ListArray, kinds: Kinds | None = None) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """The fields of an array column's entries, and the row each entry belongs to."""
    if kinds is not None:
        return unpack(column, kinds)
    values = pc.list_flatten(column)
    names = [field.name for field in values.type]
    return pc.list_parent_indices(column).to_numpy(), dict(zip(names, values.flatten(), strict=True))


def _numbers(values: pa.Array) -> pd.Series:
    return pd.Series(values.to_numpy(zero_copy_only=False))


def _joined(
    batches: Iterable[pa.RecordBatch], keys: list[str], on: list[str], names: list[str], kinds: dict[str, Kinds | None]
) -> Iterator[pa.RecordBatch]:
    for batch in bounded(batches, *(name for name, known in kinds.items() if known is not None)):
        parent, left = flat(batch.column("_left"), kinds["_left"])
        found = pd.DataFrame({"row": parent, "at": np.arange(len(parent))})
        taken: dict[str, tuple[str, pa.Array]] = {}
        for i, column in enumerate(on):
            rows, right = flat(batch.column(f"_right{i}"), kinds[f"_right{i}"])
            table = pd.DataFrame({"row": rows, "match": _numbers(right[column]), f"at{i}": np.arange(len(rows))})
            found["match"] = _numbers(left[column]).to_numpy()[found["at"]]
            # NULL matches nothing.
            found = found.merge(table[table["match"].notna()], on=["row", "match"], how="left")
            taken |= {n: (f"at{i}", v) for n, v in right.items() if n != column}
        at, row = pa.array(found["at"].to_numpy()), pa.array(found["row"].to_numpy())
        columns = []
        for name in names:
            if name in keys:
                columns.append(batch.column(name).take(row))
            elif name in left:
                columns.append(left[name].take(at))
            else:
                place, values = taken[name]
                where = found[place].to_numpy().astype(float)
                columns.append(values.take(pa.array(np.nan_to_num(where).astype("int64"), mask=np.isnan(where))))
        yield pa.record_batch(columns, names)


def left_join(left: DataFrame, keys: Sequence[str], pos: str, rights: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """``left`` with the columns of each of ``rights``, left-joined on ``keys`` and a column of numbers both sides have.

    ``rights`` gives tables, each with that column. Where it is ``pos``, both sides are packed by it. Another one's table is
    small beside ``left`` (a row per block of positions, say); its rows of a key go to all of the key's chunks. As in any
    join NULL matches nothing, and rows of ``left`` without a partner keep NULLs.
    """
    keys = list(keys)
    met, known = pack(left, keys, pos, "_left")
    kinds = {"_left": known}
    names, fields = list(left.columns), list(left.schema.fields)
    for i, (right, on) in enumerate(rights):
        others = [c for c in right.columns if c not in keys]
        if on == pos:
            packed, kinds[f"_right{i}"] = pack(right, keys, pos, f"_right{i}")
        else:
            kinds[f"_right{i}"] = None
            whole = right.groupBy(*keys).agg(F.collect_list(F.struct(*others)).alias(f"_right{i}"))
            packed = left.select(*keys, chunk_of(F.col(pos)).alias(CHUNK)).distinct().join(whole, keys)
        met = met.join(packed, [*keys, CHUNK], "left")
        names += [c for c in others if c != on]
        fields += [right.schema[c] for c in others if c != on]
    schema = StructType()
    for name, field in zip(names, fields, strict=True):
        schema.add(name, field.dataType, True)
    on = [column for _, column in rights]
    return met.mapInArrow(lambda batches: _joined(batches, keys, on, names, kinds), schema)
