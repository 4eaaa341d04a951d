"""Run progress as keyed state over a stream of worker files.

A file becomes one small row before anything is shuffled: its metadata, how many of its answers are right, and its
example indices as intervals. The state of a run is what its files add up to - interval sets of ranks and indices, a
few counts - so that a run of any size is a few hundred bytes, merged in any order, and nothing that landed before is
read again. An event is written when a run becomes complete, or can no longer become so.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rollscore.operators.runs import score_generations
from rollscore.sources.rank_files import stream_rank_files
from rollscore.streaming.score import ONCE

META = ("dataset", "world_size", "dataset_size", "config")
FILE = (
    "run string, path string, rank bigint, dataset string, world_size bigint, dataset_size bigint, config string, "
    "n_rows bigint, n_correct bigint, n_unknown bigint, spans array<bigint>"
)
EVENTS = (
    "run string, event string, problem string, n_files bigint, n_rows bigint, n_examples bigint, correct bigint, accuracy double"
)


def spans_of(indices: np.ndarray, step: int) -> list[list[int]]:
    """[residue, first, last] for each run of neighbours, ``step`` apart: a strided shard is one interval."""
    step = max(1, step)
    unique = np.unique(indices)
    residue, place = np.mod(unique, step), np.floor_divide(unique, step)
    order = np.lexsort((place, residue))
    residue, place = residue[order], place[order]
    starts = np.flatnonzero(np.concatenate([[True], (residue[1:] != residue[:-1]) | (place[1:] != place[:-1] + 1)])) if len(place) else []
    ends = [*starts[1:], len(place)]
    return [[int(residue[a]), int(place[a]), int(place[b - 1])] for a, b in zip(starts, ends[:len(starts)], strict=True)]


def merged(spans: Iterable[list[int]]) -> list[list[int]]:
    """The union of intervals; neighbours become one."""
    found: list[list[int]] = []
    for residue, first, last in sorted(map(list, spans)):
        if found and found[-1][0] == residue and first <= found[-1][2] + 1:
            found[-1][2] = max(found[-1][2], last)
        else:
            found.append([residue, first, last])
    return found


def size_of(spans: Iterable[list[int]]) -> int:
    return sum(last - first + 1 for _, first, last in spans)


def _files(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scored examples, those of a file one after another, to one row per file and batch."""
    fixed = ["run", "path", "rank", *META]
    for batch in batches:
        rows = batch.to_pandas()
        # A file without examples is one row of its metadata.
        found = []
        for _, own in rows.groupby("path", sort=False):
            real = own[own["is_item"].astype(bool)]
            known = real["example_index"].dropna().to_numpy(np.int64)
            step = own["world_size"].iloc[0]
            spans = spans_of(known, 1 if pd.isna(step) else int(step))
            values = [None if pd.isna(v := own[c].iloc[0]) else v for c in fixed]
            found.append([*values, len(real), int(real["is_correct"].sum()), len(real) - len(known), [x for s in spans for x in s]])
        names = [c.split(" ")[0] for c in FILE.split(", ")]
        kinds = [pa.string() if " string" in c else pa.list_(pa.int64()) if "array" in c else pa.int64() for c in FILE.split(", ")]
        columns = [pa.array([None if v is None else (int(v) if k == pa.int64() else v) for v in c], k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)]
        if found:
            yield pa.record_batch(columns, names)


class RunState:
    """What the files of a run add up to."""

    def __init__(self, text: str | None = None) -> None:
        self.data: dict[str, Any] = json.loads(text) if text else {
            "meta": None, "mixed": False, "paths": {}, "ranks": [], "n_ranks": 0, "bad_rank": False,
            "spans": [], "n_rows": 0, "n_correct": 0, "n_unknown": 0, "told": None,
        }

    def add(self, row: Any) -> None:
        """A part of a file: files of several Arrow batches come in several."""
        data = self.data
        meta = [None if pd.isna(v) else v for v in (getattr(row, c) for c in META)]
        meta = [int(v) if isinstance(v, (float, np.integer)) else v for v in meta]
        data["meta"], data["mixed"] = data["meta"] or meta, data["mixed"] or meta != (data["meta"] or meta)
        rank = None if pd.isna(row.rank) else int(row.rank)
        if row.path not in data["paths"]:
            data["paths"][row.path] = rank
            data["n_ranks"] += 1
            world = data["meta"][1]
            data["bad_rank"] |= rank is None or world is None or not 0 <= rank < world
            if rank is not None:
                data["ranks"] = merged([*data["ranks"], [0, rank, rank]])
        flat = [int(x) for x in row.spans]
        data["spans"] = merged([*data["spans"], *([flat[i], flat[i + 1], flat[i + 2]] for i in range(0, len(flat), 3))])
        for name in ("n_rows", "n_correct", "n_unknown"):
            data[name] += int(getattr(row, name))

    def status(self, dataset: str) -> tuple[str | None, str | None]:
        """(event, problem): complete, a problem that no further file can mend, or nothing yet."""
        data = self.data
        name, world, size, config = data["meta"]
        step = max(1, world or 1)
        examples = size_of(data["spans"])
        outside = any(r + step * a < 0 or size is None or r + step * b >= size for r, a, b in data["spans"])
        problems = (
            (name != dataset, "wrong dataset"), (data["mixed"], "mixed configurations"), (config is None, "missing configuration"),
            (data["bad_rank"] or size_of(data["ranks"]) != data["n_ranks"], "duplicate or invalid rank"),
            (outside or data["n_unknown"] > 0 or examples != data["n_rows"], "incomplete or duplicate examples"),
            (size == 0, "empty dataset"),
        )
        for wrong, problem in problems:
            if wrong:
                return "problem", problem
        return ("complete", None) if data["n_ranks"] == world and examples == size else (None, None)

    def compact(self) -> str:
        # Which path had which rank only matters while its parts may still come, within one batch.
        self.data["paths"] = {}
        return json.dumps(self.data)


def update(dataset: str):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = RunState(state.get[0] if state.exists else None)
        for frame in frames:
            for row in frame.itertuples(index=False):
                now.add(row)
        event, problem = now.status(dataset)
        data = now.data
        if event is not None and [event, problem] != data["told"]:
            data["told"] = [event, problem]
            correct, total = data["n_correct"], data["n_rows"]
            whole = event == "complete"
            yield pd.DataFrame({
                "run": [key[0]], "event": [event], "problem": [problem], "n_files": [data["n_ranks"]], "n_rows": [total],
                "n_examples": [size_of(data["spans"])], "correct": [correct], "accuracy": [correct / total if whole and total else None],
            })
        state.update((now.compact(),))

    return run


def stream_run_events(
    spark: SparkSession, path: str, dataset: str, out: str, checkpoint: str, trigger: dict = ONCE
) -> StreamingQuery:
    """Append an event to ``out`` when a run becomes complete or can no longer become so.

    Events: run, event (``complete`` or ``problem``), problem, n_files, n_rows, n_examples, correct, accuracy (of complete runs). Later files can
    add an event: a second file of one rank makes a complete run a problem. Each file is read once. After a failure the
    state store and the file sink make a repeated batch replace itself.
    """
    files = stream_rank_files(spark, path, dataset)
    kept = [F.col(c) for c in ("run", "path", "rank", "dataset", "world_size", "dataset_size")]
    items = files.select(*kept, F.to_json(F.parse_json("config")).alias("config"), F.explode_outer("generations").alias("_item"))
    flat = items.select("*", "_item.*").withColumn("is_item", F.col("_item").isNotNull()).drop("_item")
    scored = score_generations(flat, dataset)
    needed = ["run", "path", "rank", *META, "example_index", "is_correct", "is_item"]
    parts = scored.select(*needed).mapInArrow(_files, FILE)
    events = parts.groupBy("run").applyInPandasWithState(
        update(dataset), EVENTS, "state string", "append", GroupStateTimeout.NoTimeout
    )
    return (
        events.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(**trigger).start()
    )


def latest_events(spark: SparkSession, out: str) -> DataFrame:
    """Each run's last event: the one that saw most of its files."""
    order = Window.partitionBy("run").orderBy(F.desc("n_files"), F.desc("n_rows"), F.desc("event"))
    events = spark.read.schema(EVENTS).parquet(out)
    return events.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")
