"""Schemas of the files the engine reads."""

from __future__ import annotations

from pyspark.sql import types as T

QUESTIONS = {
    "gsm8k": T.StructType(
        [
            T.StructField("example_index", T.LongType()),
            T.StructField("question", T.StringType()),
            T.StructField("answer", T.StringType()),
        ]
    ),
    "math": T.StructType(
        [
            T.StructField("example_index", T.LongType()),
            T.StructField("problem", T.StringType()),
            T.StructField("solution", T.StringType()),
            T.StructField("answer", T.StringType()),
        ]
    ),
}

# The gold is a number in one dataset and text in the other; text holds both.
GENERATION = T.StructType(
    [
        T.StructField("example_index", T.LongType()),
        T.StructField("question", T.StringType()),
        T.StructField("prompt_input", T.StringType()),
        T.StructField("generations", T.StringType()),
        T.StructField("ground_truth", T.StringType()),
    ]
)

METRICS = T.StructType(
    [
        T.StructField("total_processed", T.LongType()),
        T.StructField("wall_time_seconds", T.DoubleType()),
    ]
)

RANK_FILE = T.StructType(
    [
        T.StructField("generations", T.ArrayType(GENERATION)),
        T.StructField("config", T.StringType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("rank", T.LongType()),
        T.StructField("world_size", T.LongType()),
        T.StructField("dataset_size", T.LongType()),
        T.StructField("metrics", METRICS),
    ]
)

RANK_META = T.StructType(
    [
        T.StructField("run", T.StringType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("rank", T.LongType()),
        T.StructField("world_size", T.LongType()),
        T.StructField("dataset_size", T.LongType()),
        T.StructField("config", T.StringType()),
        *METRICS.fields,
    ]
)

RANK_ROW = T.StructType([T.StructField("run", T.StringType()), T.StructField("rank", T.LongType()), *GENERATION.fields])
