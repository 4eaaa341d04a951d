"""One registered query per operator, over whole tables, with production parameters."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollscore.llm import bpe, counts, html, jaccard, lines, negatives, packing, substring, topk, toxicity, trie, urls, vectors
from rollscore.llm.batches import list_arrays

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring.remove_repeats(table(spark, sf_dir, "documents"), window=13)
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = packing.PIECES.replace("ids array<int>", "ids_crc32 bigint")
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), then=packing.checksums, schema=schema)


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(table(spark, sf_dir, "documents"), words=3, ratio=(90, 100))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", toxicity.is_held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "sentence_number", "sentence", "sentence_score",
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def op9_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages carry the id of their document in the path; a page is bad if that is toxic or of low quality."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    number = F.regexp_extract(urls.path_of(F.col("url")), "^/[^/]*/([0-9]+)", 1)
    of_page = pages.select("page_id", number.try_cast("bigint").alias("doc_id"))
    bad = F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(bad)
    outcomes = of_page.join(labels, "doc_id").select("page_id", "bad")
    return urls.judge(pages, outcomes, RULES)


class Decimals(dict):
    """The text of each number, made once."""

    def __missing__(self, number: int) -> str:
        self[number] = text = str(number)
        return text


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    text_of = Decimals()
    for batch in batches:
        ids = [x.tolist() for x in list_arrays(batch.column("ids"))]
        joined = [hashlib.sha256(",".join(map(text_of.__getitem__, x)).encode()).hexdigest() for x in ids]
        decoded = [hashlib.sha256(x.as_buffer()).hexdigest() for x in batch.column("decoded")]
        yield pa.record_batch(
            [batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array(joined), pa.array(decoded)],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), _digests,
        "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    )


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = lines.drop_common_lines(table(spark, sf_dir, "documents"), least=10, min_chars=1)
    kept = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return left.select("doc_id", "n_lines", "n_dropped", kept.alias("kept_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh vector counts under the label after its own."""
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation begins with up to three turns of the one that its number, rounded to twenties, names."""
    conv = F.col("conv_id")
    count = F.crc32(conv.cast("string").cast("binary")) % 4
    rebuilt = trie.with_first_turns(trie.sequences(table(spark, sf_dir, "conversations")), conv - conv % 20, count, 3)
    return trie.prefix_trie(rebuilt).withColumnRenamed("saved_words", "saved_tokens")


def queries() -> dict[str, Query]:
    found = (
        op1_substring_dedup, op2_packing, op3_embedding_dedup, op4_topk_search, op5_jaccard_join, op6_toxicity, op7_token_counts,
        op8_html_extraction, op9_url_reputation, op10_byte_bpe, op11_line_dedup,
        op12_hard_negatives, op13_prefix_trie,
    )
    return {q.__name__: q for q in found}
