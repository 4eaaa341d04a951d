"""Exact top-k by integer inner product, term at a time.

Vectors become integer weights; a component is a term. Query blocks meet candidate blocks. In a block
each term has its postings: the candidates with a weight there. A query's terms scatter their weighted
postings, one after another, into a dense array of scores, from which the best k are selected. The best
of all blocks are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollscore.llm.vectors import finite, matrix

QUERY_BLOCK = 4096
CANDIDATE_BLOCK = 4096

BEST = "query_id bigint, query_key bigint, vec_id bigint, score bigint"


def weights(vectors: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as 64-bit integers; larger values stop at the ends of their range."""
    with np.errstate(over="ignore"):
        scaled = np.floor(scale * vectors)
    found = np.clip(scaled, -(2.0**63), 2.0**63 - 1024).astype(np.int64)
    found[scaled >= 2.0**63] = 2**63 - 1
    return found


class Postings:
    """A candidate block by term: which candidates have a weight there, and the weights."""

    def __init__(self, block: np.ndarray) -> None:
        self.size = len(block)
        self.terms = []
        for column in block.T:
            at = np.flatnonzero(column)
            self.terms.append((None if len(at) == self.size else at, column[at]))

    def scores(self, query: np.ndarray) -> np.ndarray:
        scores = np.zeros(self.size, np.int64)
        for term in np.flatnonzero(query[:len(self.terms)]):
            at, values = self.terms[term]
            if at is None:
                scores += query[term] * values
            else:
                scores[at] += query[term] * values
        return scores


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids; ``ids`` rise."""
    if len(scores) > k:
        last = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= last)
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], ~scores[places]))][:k]


def _block(queries: pa.Table, candidates: pa.Table, k: int, scale: float) -> pa.Table:
    found: list[list] = [[], [], [], []]
    if queries.num_rows and candidates.num_rows:
        ids = candidates.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        postings = Postings(weights(matrix(candidates.column("vector").combine_chunks())[order], scale))
        asked = weights(matrix(queries.column("vector").combine_chunks()), scale)
        with np.errstate(over="ignore"):
            for query, key, own in zip(
                asked, queries.column("key").to_pylist(), queries.column("id").to_pylist(), strict=True
            ):
                scores, others = postings.scores(query), ids
                low, high = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
                if high > low:
                    scores, others = np.delete(scores, np.s_[low:high]), np.delete(ids, np.s_[low:high])
                at = best(scores, others, k)
                for column, values in zip(found, ([own] * len(at), [key] * len(at), others[at], scores[at]), strict=True):
                    column.extend(values)
    return pa.table(
        [pa.array(c, pa.int64()) for c in found], names=["query_id", "query_key", "vec_id", "score"]
    )


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0,
    vec_id: str = "vec_id", embedding: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` highest inner products over all other rows.

    Weights are floor(scale * x) of the double value; sums are 64-bit. Ties go to the smaller vec_id, and
    queries with fewer candidates get all. Rows whose vec_id or vector is null, or whose vector holds null
    or non-finite components, take no part; a shorter vector ends in zeros. A repeated candidate row
    counts as often as it is there, a repeated query row is asked once, and a candidate with the query's
    vec_id is never its answer. Other columns are left out. An empty table gives no rows.

    Every block of queries meets every block of candidates, so work grows with their product; blocks have
    a fixed size, and each leaves k rows per query.
    """
    usable = vectors.where(F.col(vec_id).isNotNull() & finite(F.col(embedding)))
    rows = usable.select(F.col(vec_id).cast("bigint").alias("id"), F.col(embedding).alias("vector"))
    asked = usable.where(is_query).select(F.col(vec_id).cast("bigint").alias("id"), F.col(embedding).alias("vector"))
    asked = asked.withColumn("key", F.xxhash64("vector")).dropDuplicates(["id", "key"])
    n_rows, n_asked = usable.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    blocks, parts = max(1, -(-n_rows // CANDIDATE_BLOCK)), max(1, -(-n_asked // QUERY_BLOCK))
    dealt = F.xxhash64("id", "vector")

    def each(n: int) -> Column:
        return F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))

    candidates = rows.select(
        F.pmod(dealt, F.lit(blocks)).alias("block"), F.explode(each(parts)).alias("part"), "id", "vector"
    )
    queries = asked.select(
        F.explode(each(blocks)).alias("block"), F.pmod(dealt, F.lit(parts)).alias("part"), "id", "key", "vector"
    )
    met = queries.groupBy("block", "part").cogroup(candidates.groupBy("block", "part")).applyInArrow(
        lambda left, right: _block(left, right, k, scale), BEST
    )
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
