"""Keyed state over worker files: intervals, restarts, copies, and events equal to the batch job's verdict."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest

from rollscore.streaming import progress


def elements(spans, step):
    return {r + step * q for r, a, b in spans for q in range(a, b + 1)}


@pytest.mark.parametrize("seed", range(5))
@pytest.mark.parametrize("step", [1, 4])
def test_spans(seed, step):
    rng = random.Random(seed)
    parts = [[rng.randrange(-9, 60) for _ in range(rng.randrange(30))] for _ in range(6)]
    spans = [progress.spans_of(np.array(p, np.int64), step) for p in parts]
    for part, own in zip(parts, spans, strict=True):
        assert elements(own, step) == set(part)
    rng.shuffle(spans)
    whole = progress.merged(x for own in spans for x in own)
    everything = {x for p in parts for x in p}
    assert elements(whole, step) == everything and progress.size_of(whole) == len(everything)
    assert len(progress.spans_of(np.arange(3, 4000, 4), 4)) == 1


def put(folder, run, rank, indices, world=2, size=10, dataset="gsm8k", config=None, name=None):
    items = [
        {"example_index": i, "question": "q", "prompt_input": "p", "generations": "\\boxed{%d}" % (i if i % 3 else 77), "ground_truth": float(i or 0)}
        for i in indices
    ]
    data = {"generations": items, "config": {"a": 1} if config is None else config, "dataset": dataset, "rank": rank, "world_size": world,
            "dataset_size": size, "metrics": {"total_processed": len(items), "wall_time_seconds": 1.0}}
    place = folder / run
    place.mkdir(parents=True, exist_ok=True)
    (place / f"gsm8k_rank{rank if name is None else name}_generations.json").write_text(json.dumps(data))


def run_stream(spark, folder):
    query = progress.stream_run_events(spark, str(folder / "in"), "gsm8k", str(folder / "out"), str(folder / "check"))
    query.awaitTermination()
    found = {}
    for row in spark.read.schema(progress.EVENTS).parquet(str(folder / "out")).collect():
        found.setdefault(row.run, []).append((row.event, row.problem, row.n_files, row.n_examples, row.correct))
    return {run: sorted(events) for run, events in found.items()}, query


def test_events_over_restarts(spark, tmp_path):
    landing = tmp_path / "in"
    put(landing, "whole", 0, range(0, 10, 2))
    put(landing, "twice", 0, [0, 2, 4, 6, 8, 8])
    put(landing, "other", 0, [0], dataset="math")
    put(landing, "far", 0, [0, 2, 12])
    put(landing, "empty", 0, [], world=1, size=0)
    first, query = run_stream(spark, tmp_path)
    assert first == {
        "twice": [("problem", "incomplete or duplicate examples", 1, 5, 4)], "other": [("problem", "wrong dataset", 1, 1, 0)],
        "far": [("problem", "incomplete or duplicate examples", 1, 3, 1)], "empty": [("problem", "empty dataset", 1, 0, 0)],
    }
    # A new query on the same checkpoint goes on from the state; what landed before is not read again.
    again, query = run_stream(spark, tmp_path)
    assert again == first
    put(landing, "whole", 1, range(1, 10, 2))
    put(landing, "late", 1, range(1, 10, 2))
    second, query = run_stream(spark, tmp_path)
    # Ten answers but those to 0, 3, 6 and 9.
    assert second == first | {"whole": [("complete", None, 2, 10, 6)]}
    assert sum(p["numInputRows"] for p in query.recentProgress) == 2
    row = progress.latest_events(spark, str(tmp_path / "out")).where("run = 'whole'").first()
    assert row.accuracy == 0.6 and row.n_rows == 10
    # A copy of a file under another name is a second file of its rank.
    put(landing, "whole", 1, range(1, 10, 2), name=5)
    put(landing, "late", 0, range(0, 10, 2), config={"a": 2})
    third, _ = run_stream(spark, tmp_path)
    assert third["whole"] == [("complete", None, 2, 10, 6), ("problem", "duplicate or invalid rank", 3, 10, 9)]
    assert third["late"] == [("problem", "mixed configurations", 2, 10, 6)]
    assert progress.latest_events(spark, str(tmp_path / "out")).where("run = 'whole'").first().event == "problem"


def test_a_replayed_batch_replaces_itself(spark, tmp_path):
    """The last commit is lost, as in a failure after the sink has written: the batch runs again, once."""
    landing = tmp_path / "in"
    put(landing, "a", 0, range(0, 10, 2))
    run_stream(spark, tmp_path)
    put(landing, "a", 1, range(1, 10, 2))
    done, _ = run_stream(spark, tmp_path)
    commits = sorted((tmp_path / "check" / "commits").iterdir(), key=lambda p: p.name)
    last = max((p for p in commits if p.name.isdigit()), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    again, _ = run_stream(spark, tmp_path)
    assert again == done == {"a": [("complete", None, 2, 10, 6)]}


def test_state_is_small():
    from types import SimpleNamespace

    state = progress.RunState()
    for rank in range(64):
        flat = [x for s in progress.spans_of(np.arange(rank, 640_000, 64), 64) for x in s]
        state.add(SimpleNamespace(path=f"p{rank}", rank=rank, dataset="gsm8k", world_size=64, dataset_size=640_000, config="{}",
                                  spans=flat, n_rows=10_000, n_correct=5, n_unknown=0))
        state = progress.RunState(state.compact())
    assert state.status("gsm8k") == ("complete", None) and len(state.compact()) < 2500
