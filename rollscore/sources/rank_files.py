"""Per-worker generation files.

A worker file is one JSON object holding all of a worker's generations. Our own output is
line-delimited, so that a worker of any size can be split when it is read again.
"""

from __future__ import annotations

import re
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollscore.schemas import RANK_FILE, RANK_META, RANK_ROW

ROWS = "rows"
RANKS = "ranks"
NAME = "{dataset}_rank*_generations.json"  # Fixed value: name of a worker's file.


def run_of(path: Column, root: str) -> Column:
    """A run is the folder its files are in, as seen from ``root``; the root itself has its own name.

    Where the root cannot be told, as it is a pattern, a run has the folder's whole path.
    """
    folder = F.regexp_replace(F.regexp_replace(path, "/[^/]*$", ""), "^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?/+", "/")
    base = quote(re.sub("^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?/+", "/", root).rstrip("/"), safe="/!$&'()*+,;=:@~")
    inside = F.substr(folder, F.lit(len(base) + 2))
    name = F.element_at(F.split(folder, "/"), -1)
    return F.when(folder == base, name).when(folder.startswith(base + "/"), inside).otherwise(folder)


def rank_rows(files: DataFrame) -> DataFrame:
    """One row of metadata per file."""
    # Parsed and rendered again, so that equal settings compare equal whatever their key order.
    config = F.to_json(F.parse_json("config"))
    return files.select(
        "run", "path", "dataset", "rank", "world_size", "dataset_size", config.alias("config"),
        F.col("metrics.total_processed").alias("total_processed"),
        F.col("metrics.wall_time_seconds").alias("wall_time_seconds"),
    )


def generation_rows(files: DataFrame) -> DataFrame:
    """One row per saved example."""
    return files.select("run", "rank", F.explode("generations").alias("_item")).select("run", "rank", "_item.*")


def _files(reader, path: str, dataset: str) -> DataFrame:
    options = {"multiLine": True, "recursiveFileLookup": True, "pathGlobFilter": NAME.format(dataset=dataset)}
    raw = reader.schema(RANK_FILE).options(**options)
    files = raw.json(path).select("*", F.col("_metadata.file_path").alias("path"))
    return files.withColumn("run", run_of(F.col("path"), path))


def read_rank_files(spark: SparkSession, path: str, dataset: str) -> tuple[DataFrame, DataFrame]:
    """Rank metadata (one row per file) and generations of all runs under ``path``.

    The two tables read the files separately, so each parses only the fields it needs.
    """
    files = _files(spark.read, path, dataset)
    if not files.select("path").take(1):
        raise ValueError(f"No {dataset} generation files in {path}")
    return rank_rows(files), generation_rows(files)


def stream_rank_files(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """The same files as a stream: one row per file, with ``run`` and ``path``."""
    return _files(spark.readStream, path, dataset)


def write_rank_output(generations: DataFrame, ranks: DataFrame, path: str) -> None:
    """S3: generations and rank metadata side by side. Existing output is never overwritten."""
    ranks.write.mode("errorifexists").json(f"{path}/{RANKS}")
    generations.hint("rebalance", "rank").write.mode("errorifexists").partitionBy("rank").json(f"{path}/{ROWS}")


def convert_rank_files(spark: SparkSession, path: str, dataset: str, out: str) -> None:
    """Rewrite worker files as lines. One task has to parse a worker file, whatever its size; do it once,
    and let all later scoring read lines, which any number of tasks can share."""
    ranks, generations = read_rank_files(spark, path, dataset)
    ranks.drop("path").write.mode("errorifexists").json(f"{out}/{RANKS}")
    generations.write.mode("errorifexists").json(f"{out}/{ROWS}")


def read_rank_output(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Read back what ``write_rank_output`` wrote: rank metadata and generations."""
    ranks = spark.read.schema(RANK_META).json(f"{path}/{RANKS}")
    rows = spark.read.schema(RANK_ROW).json(f"{path}/{ROWS}")
    return ranks, rows
