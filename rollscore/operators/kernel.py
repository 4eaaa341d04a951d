"""Sums of log-sigmoids over pairs, in dense blocks of doubles (L3).

Targets are sorted by threshold and competitors by step, so a block of both is either all later, all earlier, or mixed;
only mixed ones carry a mask. Where all differences of a block lie beyond ``TAIL``, log-sigmoid is linear or zero
to within exp(-TAIL), below the last digit of a double, and the block costs one product instead of one exponential a pair.

Competitors of a step are sorted and sums kept in extended precision until the end, so that the order in which a shuffle
brings the competitors does not decide the last digit.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from rollscore.plans.columnar import Kinds, bounded
from rollscore.plans.packed import flat

TARGETS, RIVALS = 256, 1024
#: exp(-40) is 4e-18 a pair.
TAIL = 40.0


def log_sigmoid_sums(threshold: np.ndarray, own: np.ndarray, step: np.ndarray, confidence: np.ndarray) -> np.ndarray:
    """For each target, the sum of log-sigmoid(own - confidence) over competitors with a step above its threshold.

    Scores are divided by the temperature already. A competitor of minus infinity adds 0; NaN gives NaN.
    """
    found = np.zeros(len(own))
    if not len(own) or not len(step):
        return found
    order, by_step = np.lexsort((own, threshold)), np.lexsort((confidence, step))
    step, confidence = step[by_step], confidence[by_step]
    with np.errstate(over="ignore", invalid="ignore"):
        for start in range(0, len(own), TARGETS):
            at = order[start:start + TARGETS]
            limit, score = threshold[at], own[at]
            total = np.zeros(len(at), np.longdouble)
            first = int(np.searchsorted(step, limit[0], "right"))
            whole = int(np.searchsorted(step, limit[-1], "right"))  # later than all targets from here on
            for a in range(first, len(step), RIVALS):
                b = min(a + RIVALS, len(step))
                rival = confidence[a:b]
                low, high = score.min() - rival.max(), score.max() - rival.min()
                if a >= whole and low >= TAIL:
                    continue
                if a >= whole and high <= -TAIL:
                    total += (b - a) * score.astype(np.longdouble) - rival.sum(dtype=np.longdouble)
                    continue
                d = score[:, None] - rival[None, :]
                value = np.minimum(d, 0.0) - np.log1p(np.exp(-np.abs(d)))
                if a < whole:
                    value = np.where(step[None, a:b] > limit[:, None], value, 0.0)
                total += value.sum(axis=1, dtype=np.longdouble)
            found[at] = total
    return found


def log_softmax(threshold: np.ndarray, own: np.ndarray, step: np.ndarray, confidence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Own score less the log-sum-exp of it and the competitors with a step above the threshold; 0 where they weigh nothing.

    Also whether one of these competitors is NaN. The running sum over the steps, from the latest down, is kept in extended
    precision, so scores may lie apart by any factor.
    """
    order = np.lexsort((confidence, -step))
    with np.errstate(all="ignore"):
        so_far = np.logaddexp.accumulate(confidence[order].astype(np.longdouble))
        others = np.concatenate([[-np.inf], so_far])[np.searchsorted(-step[order], -threshold, "left")]
        top = np.maximum(own, others)
        together = top + np.log(np.exp(own - top) + np.exp(others - top))
        return np.where(others == -np.inf, 0.0, own - together).astype(float), np.isnan(others)


@dataclass(frozen=True)
class Pairs:
    """Which rows of a chunk are targets, and from which step on others compete with them: see ``position``."""

    width: int
    segments: int
    by_segment: bool
    tau: float

    def targets(self, segment: int, rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each row is a target; the targets' thresholds and scores."""
        step = rows["unmask_step"]
        own = (step >= 1) & (step <= self.width * self.segments) & (np.floor((step - 1) / self.width) == segment)
        threshold = np.full(int(own.sum()), float((segment + 1) * self.width)) if self.by_segment else step[own]
        return own, threshold, rows["own_score"][own] / self.tau

    def sums(self, segment: int, targets: dict[str, np.ndarray], rivals: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Whether each row is a target, and the targets' sums."""
        own, threshold, scores = self.targets(segment, targets)
        return own, log_sigmoid_sums(threshold, scores, rivals["unmask_step"], rivals["confidence"] / self.tau)


def _chunks(column: pa.ListArray, *names: str, read: tuple[np.ndarray, dict[str, pa.Array]] | None = None) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """Per row of an array column, the number of entries before it and its own, by field; none for NULL. ``read`` is what ``flat`` gives of it."""
    parent, values = flat(column) if read is None else read
    lengths = np.bincount(parent, minlength=len(column))
    ends = np.cumsum(lengths)
    fields = {n: values[n].cast(pa.float64()).to_numpy(zero_copy_only=False) for n in names}
    for first, last in zip(ends - lengths, ends, strict=True):
        yield first, {n: v[first:last] for n, v in fields.items()}


def _by_position(pos: np.ndarray, sums: np.ndarray, far_pos: np.ndarray, far: np.ndarray) -> np.ndarray:
    """For each of ``pos`` all sums of that position, passing over NaN unless there is nothing else."""
    if not len(far) and len(np.unique(pos)) == len(pos):
        return sums
    _, at = np.unique(np.concatenate([pos, far_pos]), return_inverse=True)
    every = np.concatenate([sums, far])
    order = np.lexsort((every, at))  # the shuffle's order of the chunks must not count
    at, every, own = at[order], every[order], at[:len(pos)]
    total, known = np.bincount(at, np.nan_to_num(every)), np.bincount(at, ~np.isnan(every))
    return np.where(known > 0, total, np.nan)[own]


NUMBERS = ("pos", "unmask_step", "own_score", "confidence")


def chunk_sums(
    batches: Iterable[pa.RecordBatch], names: list[str], keys: list[str], pairs: Pairs, kinds: Kinds | None = None
) -> Iterator[pa.RecordBatch]:
    """Rows of (keys, _rows, _far) to one row per target: ``names`` and ``pos_logp``, NULL where a score is NULL.

    ``_rows`` are a chunk's targets and competitors, packed if ``kinds`` are given; ``_far`` gives sums over other chunks by
    position, if there are any.
    """
    for batch in batches if kinds is None else bounded(batches, "_rows"):
        parent, values = flat(batch.column("_rows"), kinds)
        chosen, found = [np.empty(0, "int64")], [np.empty(0)]
        each = _chunks(batch.column("_rows"), *NUMBERS, read=(parent, values))
        chunks = zip(batch.column(keys[-1]).to_pylist(), each, _chunks(batch.column("_far"), "pos", "sum"), strict=True)
        for segment, (first, rows), (_, far) in chunks:
            own, sums = pairs.sums(segment, rows, rows)
            chosen.append(np.flatnonzero(own) + first)
            found.append(_by_position(rows["pos"][own], sums, far["pos"], far["sum"]))
        at, total = pa.array(np.concatenate(chosen)), np.concatenate(found)
        row = pa.array(parent).take(at)
        columns = [batch.column(n).take(row) if n in keys else values[n].take(at) for n in names]
        yield pa.record_batch([*columns, pa.array(total, mask=np.isnan(total))], [*names, "pos_logp"])


def far_sums(batches: Iterable[pa.RecordBatch], names: list[str], pairs: Pairs, kinds: Kinds | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of (names, _rows, _rivals), chunks of one key, to (names, _far): a sum for each target by its position."""
    for batch in batches if kinds is None else bounded(batches, "_rows", "_rivals"):
        found, places = [np.empty(0)], [np.empty(0)]
        sides = [_chunks(batch.column(side), *NUMBERS, read=flat(batch.column(side), kinds)) for side in ("_rows", "_rivals")]
        chunks = zip(batch.column("segment").to_pylist(), *sides, strict=True)
        for segment, (_, targets), (_, rivals) in chunks:
            own, sums = pairs.sums(segment, targets, rivals)
            found.append(sums)
            places.append(targets["pos"][own])
        values = pa.StructArray.from_arrays([pa.array(np.concatenate(places)), pa.array(np.concatenate(found))], ["pos", "sum"])
        offsets = pa.array(np.cumsum([len(p) for p in places]), pa.int32())
        yield pa.record_batch([*(batch.column(n) for n in names), pa.ListArray.from_arrays(offsets, values)], [*names, "_far"])


def chunk_softmax(batches: Iterable[pa.RecordBatch], names: list[str], keys: list[str], pairs: Pairs) -> Iterator[pa.RecordBatch]:
    """Rows of (keys, _rows), a key's targets and competitors, to one row per target: ``names`` and ``pos_logp``.

    NULL where a later competitor's score, or a target's own beside competitors, is NULL.
    """
    for batch in batches:
        parent, values = flat(batch.column("_rows"))
        chosen, found, lost = [np.empty(0, "int64")], [np.empty(0)], [np.empty(0, bool)]
        chunks = zip(batch.column(keys[-1]).to_pylist(), _chunks(batch.column("_rows"), *NUMBERS[1:]), strict=True)
        for segment, (first, rows) in chunks:
            own, threshold, scores = pairs.targets(segment, rows)
            logps, unknown = log_softmax(threshold, scores, rows["unmask_step"], rows["confidence"] / pairs.tau)
            chosen.append(np.flatnonzero(own) + first)
            found.append(logps)
            lost.append(unknown)
        at, total = pa.array(np.concatenate(chosen)), np.concatenate(found)
        row = pa.array(parent).take(at)
        columns = [batch.column(n).take(row) if n in keys else values[n].take(at) for n in names]
        no_score = values["own_score"].take(at).is_null().to_numpy(zero_copy_only=False)
        mask = np.concatenate(lost) | (np.isnan(total) & no_score)
        yield pa.record_batch([*columns, pa.array(total, mask=mask)], [*names, "pos_logp"])
