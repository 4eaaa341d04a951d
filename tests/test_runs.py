"""Worker files: reading, validation, scoring, writing and streaming."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from rollscore.operators import runs
from rollscore.plans import jobs
from rollscore.sources import questions, rank_files, sinks
from rollscore.streaming import score as streaming

TEXTS = [r"<answer>\boxed{42}</answer>", "<answer>-3</answer>", "No answer"]
GOLD = [42.0, -3.0, 4.0]


def payload(rank, world, indices, size, dataset="gsm8k", config=None, texts=TEXTS, gold=GOLD):
    return {
        "generations": [
            {"example_index": i, "question": f"q{i}", "prompt_input": f"p{i}", "generations": texts[i % 3], "ground_truth": gold[i % 3]}
            for i in indices
        ],
        "config": config or {"steps": 64, "gen_length": 128}, "dataset": dataset, "rank": rank, "world_size": world,
        "dataset_size": size, "metrics": {"total_processed": len(indices), "wall_time_seconds": 1.5 + rank},
    }


def write(folder, *payloads, dataset="gsm8k"):
    folder.mkdir(exist_ok=True)
    for number, content in enumerate(payloads):
        name = f"{dataset}_rank{content['rank']}_generations.json" if number < 100 else str(number)
        target = folder / name
        if target.exists():
            target = folder / f"{dataset}_rank{content['rank']}_{number}_generations.json"
        target.write_text(json.dumps(content, indent=2))
    return str(folder)


def good(world=2, size=6):
    return [payload(r, world, list(range(r, size, world)), size) for r in range(world)]


def test_score_a_complete_run(spark, tmp_path):
    row = jobs.score_run(spark, write(tmp_path / "run_a", *good()), "gsm8k").first()
    assert (row.run, row.dataset, row.correct, row.total) == ("run_a", "gsm8k", 4, 6)
    assert row.accuracy == pytest.approx(4 / 6)


def test_score_math(spark, tmp_path):
    one = payload(0, 1, [0], 1, "math", texts=[r"\boxed{\frac{1}{2}}"] * 3, gold=["0.5"] * 3)
    row = jobs.score_run(spark, write(tmp_path / "run_m", one, dataset="math"), "math").first()
    assert (row.correct, row.total, row.accuracy) == (1, 1, 1.0)


def test_several_runs_in_folders(spark, tmp_path):
    write(tmp_path / "a", *good())
    write(tmp_path / "b", *good(3, 9))
    rows = {r.run: r for r in jobs.score_run(spark, str(tmp_path), "gsm8k").collect()}
    assert (rows["a"].total, rows["b"].total) == (6, 9)
    write(tmp_path / "c", *good(3, 9)[:2])
    with pytest.raises(ValueError, match="c: missing ranks"):
        jobs.score_run(spark, str(tmp_path), "gsm8k")
    ranks, generations = rank_files.read_rank_files(spark, str(tmp_path), "gsm8k")
    table = {r.run: r.problem for r in jobs.score_tables(ranks, generations, "gsm8k").collect()}
    assert table == {"a": None, "b": None, "c": "missing ranks"}


def test_equal_folder_names_are_different_runs(spark, tmp_path):
    for name in ("exp1", "exp2"):
        (tmp_path / name).mkdir()
        write(tmp_path / name / "eval run", *good())
    rows = jobs.score_run(spark, str(tmp_path), "gsm8k").collect()
    assert sorted(r.run.replace("%20", " ") for r in rows) == ["exp1/eval run", "exp2/eval run"]
    assert jobs.score_run(spark, str(tmp_path / "*"), "gsm8k").count() == 2
    assert jobs.score_run(spark, f"file://{tmp_path}/exp1/", "gsm8k").first().run.replace("%20", " ") == "eval run"


def test_all_bad_runs_are_told(spark, tmp_path):
    for number in range(25):
        write(tmp_path / f"r{number:02}", *good()[:1])
    with pytest.raises(ValueError, match="25 of the runs.*r00: missing ranks.*r19"):
        jobs.score_run(spark, str(tmp_path), "gsm8k")
    ranks, generations = rank_files.read_rank_files(spark, str(tmp_path), "gsm8k")
    assert jobs.run_problems(ranks, generations, "gsm8k").count() == 25


def test_converted_files_score_the_same(spark, tmp_path):
    write(tmp_path / "a", *good())
    rank_files.convert_rank_files(spark, str(tmp_path / "a"), "gsm8k", str(tmp_path / "lines"))
    row = jobs.score_tables(*rank_files.read_rank_output(spark, str(tmp_path / "lines")), "gsm8k").first()
    assert (row.run, row.correct, row.total) == ("a", 4, 6)


def test_settings_may_come_in_any_order(spark, tmp_path):
    files = good()
    files[1]["config"] = {"gen_length": 128, "steps": 64}
    assert jobs.score_run(spark, write(tmp_path / "run_o", *files), "gsm8k").count() == 1


def with_change(change):
    files = good()
    change(files)
    return files


BAD = {
    "wrong dataset": with_change(lambda f: [x.update(dataset="math") for x in f]),
    "mixed configurations": with_change(lambda f: f[1].update(config={"steps": 32})),
    "duplicate or invalid rank": with_change(lambda f: f[1].update(rank=0)),
    "duplicate or invalid rank ": with_change(lambda f: f[1].update(rank=2)),
    "wrong dataset ": with_change(lambda f: [x.pop("dataset") for x in f]),
    "missing configuration": with_change(lambda f: [x.pop("config") for x in f]),
    "missing ranks": good()[:1],
    "incomplete or duplicate examples": with_change(lambda f: f[1]["generations"].pop()),
    "incomplete or duplicate examples ": with_change(lambda f: f[1]["generations"][0].update(example_index=0)),
    "incomplete or duplicate examples  ": with_change(lambda f: f[1]["generations"].append(f[1]["generations"][0])),
    "empty dataset": [payload(0, 1, [], 0)],
}


@pytest.mark.parametrize("problem", BAD)
def test_bad_runs_are_refused(spark, tmp_path, problem):
    path = write(tmp_path / "bad", *BAD[problem])
    with pytest.raises(ValueError, match=problem.strip()):
        jobs.score_run(spark, path, "gsm8k")
    ranks, rows = rank_files.read_rank_files(spark, path, "gsm8k")
    row = jobs.score_tables(ranks, rows, "gsm8k").first()
    assert row.problem == problem.strip() and row.accuracy is None


def test_no_files(spark, tmp_path):
    write(tmp_path / "other", *good(), dataset="math")
    with pytest.raises(ValueError, match="No gsm8k"):
        rank_files.read_rank_files(spark, str(tmp_path / "other"), "gsm8k")


def test_missing_ranks_and_summary(spark, tmp_path):
    ranks, rows = rank_files.read_rank_files(spark, write(tmp_path / "run_s", *good(4, 9)[:3]), "gsm8k")
    assert [(r.run, r["rank"]) for r in runs.missing_ranks(ranks).collect()] == [("run_s", 3)]
    row = runs.run_summary(ranks).first()
    assert (row.n_files, row.n_rows, row.wall_time_seconds) == (3, 7, 3.5) and row.rows_per_second == 2.0
    assert runs.duplicate_examples(rows).count() == 0


def test_gold_equality_is_exact(spark):
    rows = spark.createDataFrame(
        [("<answer>nan</answer>", "nan"), ("<answer>4</answer>", None), ("<answer>4</answer>", "4.0000000001"), ("x", "4")],
        "generations string, ground_truth string",
    )
    assert [r.is_correct for r in runs.score_generations(rows, "gsm8k").collect()] == [False] * 4
    with pytest.raises(ValueError):
        runs.score_generations(rows, "x")


def test_rank_output_round_trip(spark, tmp_path):
    ranks, rows = rank_files.read_rank_files(spark, write(tmp_path / "run_w", *good()), "gsm8k")
    out = str(tmp_path / "out")
    rank_files.write_rank_output(rows, ranks.drop("path"), out)
    again_ranks, again = rank_files.read_rank_output(spark, out)
    assert again.select(*sorted(rows.columns)).exceptAll(rows.select(*sorted(rows.columns))).count() == 0
    row = jobs.score_tables(again_ranks, again, "gsm8k").first()
    assert (row.correct, row.total, row.problem) == (4, 6, None)
    with pytest.raises(Exception, match="already exists"):
        rank_files.write_rank_output(rows, ranks.drop("path"), out)


def test_sinks(spark, tmp_path):
    scores = jobs.score_run(spark, write(tmp_path / "run_k", *good()), "gsm8k")
    sinks.write_scores(scores, str(tmp_path / "scores"))
    assert spark.read.json(str(tmp_path / "scores")).first().correct == 4
    ranks, rows = rank_files.read_rank_files(spark, str(tmp_path / "run_k"), "gsm8k")
    sinks.write_items(runs.score_generations(rows, "gsm8k"), str(tmp_path / "items"))
    assert spark.read.parquet(str(tmp_path / "items")).count() == 6
    steps = spark.range(10).select(F.col("id").alias("step"), F.lit("p").alias("prompt"), F.lit("c").alias("completion"), F.lit(1.0).alias("reward"))
    sinks.write_completion_log(steps, str(tmp_path / "log"), 4)
    sinks.write_completion_log(steps, str(tmp_path / "log"), 4)
    assert sorted(r.step for r in spark.read.parquet(str(tmp_path / "log")).collect()) == [0, 0, 4, 4, 8, 8]
    with pytest.raises(ValueError):
        sinks.completion_log(steps, 0)
    metrics = spark.createDataFrame([(1, 0.5, 3, "grpo", None)], "step int, loss double, n int, loss_type string, kl double")
    sinks.write_metrics(metrics, str(tmp_path / "metrics"), prefix="policy/")
    got = {(r.name, r.value) for r in spark.read.parquet(str(tmp_path / "metrics")).collect()}
    assert got == {("policy/loss", 0.5), ("policy/n", 3.0)}


def test_questions(spark, tmp_path):
    (tmp_path / "q.json").write_text("\n".join(json.dumps({"example_index": i, "question": f"q{i}", "answer": f"w #### {i}"}) for i in range(5)))
    rows = questions.read_questions(spark, str(tmp_path / "q.json"), "gsm8k")
    built = {r.example_index: r for r in jobs.build_prompts(rows, "gsm8k").collect()}
    assert built[3].answer == "3" and built[3].prompt[0].content.endswith("\n\nq3")
    assert len(jobs.build_prompts(rows, "gsm8k", seed=1).collect()) == 5
    with pytest.raises(ValueError):
        questions.read_questions(spark, str(tmp_path / "q.json"), "x")


def test_dense_index(spark):
    rows = spark.range(1000).select(F.format_string("k%05d", F.col("id") * 7).alias("key")).repartition(13)
    got = sorted((r.key, r.example_index) for r in questions.with_dense_index(rows, ["key"]).collect())
    assert [i for _, i in got] == list(range(1000))


def test_stream_equals_batch(spark, tmp_path):
    """Files that land one after another give the same scored items as one batch read."""
    landing = tmp_path / "run_x"
    files = good(3, 12)
    write(landing, files[0])
    options = dict(dataset="gsm8k", out=str(tmp_path / "out"), checkpoint=str(tmp_path / "cp"))
    streaming.stream_score(spark, str(landing), **options).awaitTermination()
    assert spark.read.parquet(options["out"]).count() == 4
    write(landing, *files[1:])
    streaming.stream_score(spark, str(landing), **options).awaitTermination()
    streamed = spark.read.parquet(options["out"])
    _, rows = rank_files.read_rank_files(spark, str(landing), "gsm8k")
    batch = runs.score_generations(rows, "gsm8k")
    assert streamed.count() == 12
    assert streamed.select(*batch.columns).exceptAll(batch).count() == 0


def test_run_progress(spark, tmp_path):
    """A run is complete only once all its files are in; repeated examples are reported."""
    landing = tmp_path / "run_p"
    files = good(2, 6)
    options = dict(dataset="gsm8k", out=str(tmp_path / "state"), checkpoint=str(tmp_path / "cp"))

    def progress():
        streaming.stream_run_progress(spark, str(landing), **options).awaitTermination()
        return streaming.run_progress(spark, options["out"], "gsm8k").first()

    write(landing, files[0])
    row = progress()
    assert not row.is_complete and row.problem == "missing ranks" and (row.correct, row.total) == (2, 3)
    write(landing, files[1])
    row = progress()
    assert row.is_complete and row.problem is None and (row.correct, row.total) == (4, 6)
    write(landing, files[1])
    row = progress()
    assert not row.is_complete and row.problem == "duplicate or invalid rank" and row.total == 9


def test_numeric_gold_of_math(spark):
    rows = [(0, "\\boxed{0.5}", 0.5), (1, "\\boxed{0.5000000001}", 0.5), (2, "\\boxed{0.6}", 0.5), (3, "\\boxed{x}", 0.5), (4, "\\boxed{1}", None)]
    frame = spark.createDataFrame(rows, "example_index int, generations string, ground_truth double")
    scored = runs.score_generations(frame, "math").orderBy("example_index").collect()
    assert [r.is_correct for r in scored] == [True, True, False, False, False]
