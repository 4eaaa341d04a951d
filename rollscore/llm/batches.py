"""Small helpers for operators that work on Arrow batches inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

ROWS = 500


def slices(batches: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that what a task builds from one stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def int_lists(lists: list[np.ndarray], kind=np.int32) -> pa.ListArray:
    """Integer arrays as one Arrow list column."""
    offsets = np.zeros(len(lists) + 1, np.int32)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    values = np.concatenate(lists) if lists else np.empty(0, kind)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(kind, copy=False)))


def list_arrays(column: pa.ListArray) -> list[np.ndarray | None]:
    """An Arrow list column of numbers without inner nulls as numpy arrays; None for null."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    return [values[offsets[i]:offsets[i + 1]] if valid[i] else None for i in range(len(column))]


#: Longer keys are cached for one batch only.
LONGEST_KEY = 64


class Recent:
    """A bounded cache: what is in use now, and the generation before it.

    ``size`` keys a generation, each of at most ``LONGEST_KEY`` characters: whole texts without a blank are not held.
    """

    def __init__(self, size: int) -> None:
        self.size, self.now, self.old, self.long = size, {}, {}, []

    def keep(self, keys: set) -> dict:
        """The cached values, after those of ``keys`` have been moved to the present generation."""
        for key in self.long:
            self.now.pop(key, None)
        if len(self.now) > self.size:
            self.old, self.now = self.now, {}
        now, old = self.now, self.old
        new = keys.difference(now)  # with all long ones
        self.long = [key for key in new if len(key) > LONGEST_KEY]
        for key in new.intersection(old):
            now[key] = old[key]
        return now
