"""The corpus pipeline over documents: toxic documents, near duplicates and repeated passages go; the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollscore.llm import jaccard, packing, substring, toxicity
from rollscore.session import checkpoint_dir

#: Passages of so many words that a smaller document has too are cut.
PASSAGE = 50


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model of the labelled ones scores 0.5 or more go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.train(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.8 or more, the smallest doc_id stays."""
    groups = jaccard.jaccard_groups(docs, words=5, ratio=(80, 100))
    first = groups.where(F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))
    kept = first.select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, F.col("doc_id").cast("bigint").eqNullSafe(F.col("_kept")), "left_semi")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of ``PASSAGE`` words or more that also start in a smaller document are cut out."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    left = substring.remove_repeats(docs, window=PASSAGE, spaces=True, carry=others)
    length = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("bigint")
    return left.withColumn("n_chars", length).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids, placed in sequences of 4096."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end=2, capacity=4096)


STAGES = [
    ("toxicity", toxic_documents),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("packing", packed),
]

#: Training and tokenizing are beyond SQL; tests hold the stages against planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what lies between them is written to the shared folder."""
    folder = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{number}-{name}")
            docs = spark.read.parquet(f"{folder}/{number}-{name}")
    return docs
