"""Scores and run progress over a stream of worker files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rollscore.operators.runs import accuracy, score_generations, validate_runs
from rollscore.sources.rank_files import generation_rows, rank_rows, stream_rank_files

ITEMS = "items"
RANKS = "ranks"


# By default a stream works off what has landed and ends; pass for example
# ``{"processingTime": "1 minute"}`` to keep it running.
ONCE = {"availableNow": True}


def stream_score(
    spark: SparkSession, path: str, dataset: str, out: str, checkpoint: str, trigger: dict = ONCE
) -> StreamingQuery:
    """Score the generations of each worker file that lands, and append them to ``out``.

    The same expressions as in the batch job; no state, and the file sink commits each
    micro-batch exactly once.
    """
    items = score_generations(generation_rows(stream_rank_files(spark, path, dataset)), dataset)
    return (
        items.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**trigger)
        .start()
    )


def stream_run_progress(
    spark: SparkSession, path: str, dataset: str, out: str, checkpoint: str, trigger: dict = ONCE
) -> StreamingQuery:
    """Keep scored ids and rank metadata of all landed files under ``out``.

    Each micro-batch is written to a folder of its own number, so a batch that is run again
    after a failure replaces itself. Read the state with ``run_progress``.
    """

    def merge(files: DataFrame, batch: int) -> None:
        files.persist()  # both tables come from one parse of the files
        try:
            scored = score_generations(generation_rows(files), dataset)
            scored.select("run", "rank", "example_index", "is_correct").write.mode("overwrite").parquet(
                f"{out}/{ITEMS}/batch={batch}"
            )
            rank_rows(files).write.mode("overwrite").parquet(f"{out}/{RANKS}/batch={batch}")
        finally:
            files.unpersist()

    return (
        stream_rank_files(spark, path, dataset)
        .writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def run_progress(spark: SparkSession, out: str, dataset: str) -> DataFrame:
    """Per run, what has landed so far, the running score and whether it is complete.

    A run is complete only if it would pass validation. Repeated files or examples are
    reported as its ``problem``, not dropped.
    """
    items = spark.read.parquet(f"{out}/{ITEMS}").drop("batch")
    ranks = spark.read.parquet(f"{out}/{RANKS}").drop("batch")
    state = validate_runs(ranks, items, dataset)
    return state.join(accuracy(items), "run", "left").withColumn("is_complete", F.col("problem").isNull())
