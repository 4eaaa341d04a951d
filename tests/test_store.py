"""The reward store, checked questions and writers that replace what they own."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from rollscore.plans import jobs
from rollscore.sources import questions, sinks, store


def scorer(folder):
    """Length of the text; each batch with rows leaves a file that holds its texts."""

    def score(batches):
        import uuid

        for batch in batches:
            if len(batch):
                (folder / str(uuid.uuid4())).write_text(json.dumps(batch["text"].tolist()))
            yield batch[["text_key"]].assign(reward=batch["text"].str.len().astype("float64"))

    return score


def asked(folder):
    return sorted(str(t) for f in folder.iterdir() for t in json.loads(f.read_text()))


def test_each_text_is_scored_once(spark, tmp_path):
    calls = [tmp_path / f"calls{i}" for i in range(3)]
    for c in calls:
        c.mkdir()
    path = str(tmp_path / "store")
    texts = ["a", "bb", "a", None, "", "a", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = store.score_once(rows, "length/of", ["text"], scorer(calls[0]), path, split_rows=2)
    expected = {i: None if t is None else float(len(t)) for i, t in enumerate(texts)}
    assert {r.id: r.reward for r in got.collect()} == expected
    assert asked(calls[0]) == ["", "None", "a", "bb"]
    # The same batch again calls no model and adds nothing, though NULL is a text's reward.
    again = store.score_once(rows, "length/of", ["text"], scorer(calls[1]), path)
    assert {r.id: r.reward for r in again.collect()} == expected and asked(calls[1]) == []
    assert store.stored_rewards(spark, path, "length/of").count() == 4
    # A later batch scores what is new; another function has a store of its own.
    more = spark.createDataFrame([(0, "bb"), (1, "ccc")], "id int, text string")
    assert {r.reward for r in store.score_once(more, "length/of", ["text"], scorer(calls[2]), path).collect()} == {2.0, 3.0}
    assert asked(calls[2]) == ["ccc"]
    assert store.stored_rewards(spark, path, "other").count() == 0


def test_store_edges(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([(0, "a", "x")], "id int, text string, reward string")
    with pytest.raises(ValueError, match="reward"):
        store.score_once(rows, "f", ["text"], scorer(tmp_path), path)
    empty = rows.drop("reward").limit(0)
    assert store.score_once(empty, "f", ["text"], scorer(tmp_path), path).collect() == []
    keys = spark.createDataFrame([("a", "b"), ("ab", ""), ("ab", None), (None, "ab")], "x string, y string")
    assert keys.select(store.text_key(["x", "y"])).distinct().count() == 4


def test_checked_questions(spark, tmp_path):
    good = {"example_index": 1, "problem": "p", "solution": r"so \boxed{1}", "answer": "1"}
    lines = [
        json.dumps(good), json.dumps(good), "", json.dumps(good)[:-3], "null and void", json.dumps(good | {"example_index": "x"}),
        json.dumps(good | {"example_index": None}), json.dumps({k: v for k, v in good.items() if k != "problem"}),
        json.dumps(good | {"solution": None}), json.dumps(good | {"solution": "1"}), json.dumps(good | {"solution": r"\boxed{1"}),
        json.dumps(good | {"other": [1]}),
    ]
    (tmp_path / "q.json").write_text("\n".join(lines))
    checked = questions.checked_questions(spark, str(tmp_path / "q.json"), "math")
    kept, refused = questions.quarantine(checked, str(tmp_path / "out"))
    assert kept.columns == ["example_index", "problem", "solution", "answer"]
    assert kept.count() == 3 and kept.count() + refused.count() == len(lines) - 1
    reasons = refused.groupBy("reason").count().collect()
    assert {r.reason: r["count"] for r in reasons} == {
        "malformed line": 3, "no index": 1, "no question": 1, "no gold": 1, "no readable box": 2,
    }
    assert {r.line for r in refused.where("reason = 'malformed line'").collect()} == set(lines[3:6])
    (tmp_path / "g.json").write_text('{"example_index": 1, "question": "q", "answer": "w"}\n{"example_index": 2, "question": "q", "answer": "w #### 3"}')
    found = questions.checked_questions(spark, str(tmp_path / "g.json"), "gsm8k").collect()
    assert [(r.example_index, r.reason) for r in sorted(found, key=lambda r: r.example_index)] == [(1, "no final answer"), (2, None)]
    (tmp_path / "none.json").write_text("")
    kept, refused = questions.quarantine(questions.checked_questions(spark, str(tmp_path / "none.json"), "math"), str(tmp_path / "none"))
    assert kept.count() == refused.count() == 0
    with pytest.raises(ValueError):
        questions.checked_questions(spark, str(tmp_path / "q.json"), "x")


def test_a_batch_replaces_itself(spark, tmp_path):
    log, metrics = str(tmp_path / "log"), str(tmp_path / "metrics")
    rows = spark.range(10).select(F.col("id").alias("step"), F.lit("p").alias("prompt"), F.lit("c").alias("completion"), F.lit(1.0).alias("reward"))
    for upper in (10, 10, 5):  # the third run of the batch finds fewer steps
        sinks.write_completion_log(rows.where(F.col("step") < upper), log, 4, batch=0)
    sinks.write_completion_log(rows.where("step = 8"), log, 4, batch=1)
    assert sorted((r.batch, r.step) for r in spark.read.parquet(log).collect()) == [(0, 0), (0, 4), (1, 8)]
    values = spark.createDataFrame([(1, 0.5), (2, 1.5)], "step int, loss double")
    for batch in (0, 1, 1):
        sinks.write_metrics(values, metrics, batch=batch)
    assert sorted((r.batch, r.step, r.value) for r in spark.read.parquet(metrics).collect()) == [(b, s, v) for b in (0, 1) for s, v in ((1, 0.5), (2, 1.5))]
