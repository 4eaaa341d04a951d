"""Worker files read by ranges against a JSON library, with cuts at every place."""

from __future__ import annotations

import json
import random

import pyarrow as pa
import pytest

from rollscore.plans import jobs
from rollscore.sources import ranges
from rollscore.sources.rank_files import read_rank_files

ODD = [
    "", "plain", "}", "{", "]}[{", '"', '\\"', "\\", "\\\\", 'a\\\\"b}', "\n}\t{", "é}ü", '"generations": [', '{"generations": [{"x": 1}]}',
    "\\boxed{\\frac{1}{2}}", "}" * 30, '"}"', " ", "ends with \\",
]


def worker_file(rng, n, rank=0, world=2, size=100):
    items = [
        {"example_index": i, "question": rng.choice(ODD), "prompt_input": rng.choice(ODD) + rng.choice(ODD),
         "generations": "".join(rng.choices(ODD, k=rng.randrange(4))), "ground_truth": rng.choice([1.5, "x}", None])}
        for i in range(n)
    ]
    config = {"path": rng.choice(ODD), "nested": {"generations": [{"a": 1}], "b": [[], {}, [{"c": "]"}]]}}
    fields = [("generations", items), ("config", config), ("dataset", "gsm8k"), ("rank", rank), ("world_size", world), ("dataset_size", size),
              ("metrics", {"total_processed": n, "wall_time_seconds": 1.5})]
    rng.shuffle(fields)
    return dict(fields)


def write(folder, files, rng):
    for i, data in enumerate(files):
        text = json.dumps(data, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2]), separators=rng.choice([None, (",", ":")]))
        run = folder / f"run{i % 2}"
        run.mkdir(parents=True, exist_ok=True)
        (run / f"gsm8k_rank{i}_generations.json").write_text(rng.choice(["", " \n"]) + text + rng.choice(["", "\n", " \n\n"]), encoding="utf-8")


def rows(frame):
    return sorted(map(str, frame.collect()))


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("size, split", [(1, 64), (50, 300), (1 << 20, 128 << 20)])
def test_equals_the_plain_reader(spark, tmp_path, seed, size, split):
    rng = random.Random(seed)
    write(tmp_path, [worker_file(rng, n, i) for i, n in enumerate([25, 0, 1, 12])], rng)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        ranks, generations = ranges.read_rank_ranges(spark, str(tmp_path), "gsm8k", size)
        plain_ranks, plain = read_rank_files(spark, str(tmp_path), "gsm8k")
        assert ranks.columns == plain_ranks.columns and generations.columns == plain.columns
        assert rows(ranks) == rows(plain_ranks)
        assert rows(generations) == rows(plain) and generations.count() == 38
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def pieces_of(text):
    *whole, last = text.encode().split(b"}")
    return [p + b"}" for p in whole] + ([last + b"}"] if last else [])


@pytest.mark.parametrize("seed", range(20))
def test_every_cut(seed):
    """Each way to pack the pieces into two or three chunks gives the same elements and the same rest."""
    rng = random.Random(seed)
    data = worker_file(rng, 4)
    text = json.dumps(data, indent=rng.choice([None, 1])) + rng.choice(["", "\n"])
    pieces = pieces_of(text)
    expected = [json.loads(json.dumps(x)) for x in data["generations"]]
    for first in range(len(pieces) + 1):
        second = rng.randrange(first, len(pieces) + 1)
        packed = [b"".join(p) for p in (pieces[:first], pieces[first:second], pieces[second:]) if p]
        in_string, stack, elements, rest, going_on = False, [], [], b"", 0
        for body in packed:
            for kind, part in ranges._cut(body, in_string, len(stack), len(stack) > 1 and bool(stack[1])):
                if kind == ranges.OUTSIDE:
                    rest += part
                elif kind == ranges.REST:
                    elements[going_on] += part
                else:
                    going_on = len(elements)
                    elements.append(part)
            effect = next(ranges._effects([pa.record_batch({"path": ["p"], "block": [0], "number": [0], "body": [body]})])).to_pylist()[0]
            case = int(in_string)
            stack = stack[:max(0, len(stack) - effect["closes"][case])] + list(effect["left_open"][case])
            in_string ^= bool(effect["quotes"])
        assert sorted(json.loads(e)["example_index"] for e in elements) == [x["example_index"] for x in expected]
        assert json.loads(rest) == {**data, "generations": []}


def test_missing_files_and_jobs(spark, tmp_path):
    with pytest.raises(Exception, match="gsm8k"):
        ranges.read_rank_ranges(spark, str(tmp_path), "gsm8k")
    for rank in range(2):
        items = [{"example_index": i, "question": "q}", "prompt_input": "", "generations": "\\boxed{%d}" % i, "ground_truth": float(i)} for i in range(rank, 10, 2)]
        data = {"generations": items, "config": {"a": {"b": 1}}, "dataset": "gsm8k", "rank": rank, "world_size": 2, "dataset_size": 10,
                "metrics": {"total_processed": 5, "wall_time_seconds": 2.0}}
        (tmp_path / f"gsm8k_rank{rank}_generations.json").write_text(json.dumps(data))
    row = jobs.score_run(spark, str(tmp_path), "gsm8k", by_ranges=True).first()
    assert (row.correct, row.total, row.accuracy) == (10, 10, 1.0)
