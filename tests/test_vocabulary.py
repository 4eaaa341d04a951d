"""Logits in chunks against the whole arrays."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from rollscore.functions import logits as whole
from rollscore.operators import likelihood, vocabulary

ROWS = [
    (0, 3, [0.5, -1.0, 2.0, 2.0, 0.25, -3.0, 1.0]),
    (1, 0, [700.0, -700.0, 699.0, -40.0, 0.0, 1.0, 2.0]),
    (2, 6, [float(-x) for x in range(7)]),
    (3, 2, [-900.0, 900.0, 0.0, 0.0, 0.0, 900.0, 5.0]),
]


def table(spark, rows=ROWS):
    return spark.createDataFrame(rows, "id int, token_id bigint, logits array<double>")


def by_id(df):
    return {r.id: r for r in df.collect()}


@pytest.mark.parametrize("width", [1, 2, 3, 7, 50])
def test_chunks_equal_whole_arrays(spark, width):
    rows = table(spark)
    expected = by_id(rows.select(
        "id", whole.token_logp(F.col("logits"), F.col("token_id")).alias("logp"),
        whole.argmax_token(F.col("logits")).alias("token"),
        *[whole.confidence(F.col("logits"), m).alias(m) for m in whole.CONFIDENCE_METHODS],
    ))
    chunks = vocabulary.split_logits(rows, width)
    assert chunks.select(F.max(F.size("logits"))).first()[0] == min(width, 7)
    got = by_id(vocabulary.chunk_scores(chunks.repartition(5), ["id"], width, "token_id", 7))
    assert set(got) == set(expected)
    for key, row in got.items():
        for name in vocabulary.SCORES:
            assert row[name] == pytest.approx(expected[key][name], abs=1e-9), (key, name)


@pytest.mark.parametrize("width", [1, 3, 7])
def test_closed_logits_weigh_nothing(spark, width):
    low = float("-inf")
    rows = table(spark, [(0, 4, [low, low, low, 1.0, 2.0, low, low]), (1, 0, [low] * 7), (2, 0, [low] * 6 + [3.0])])
    got = by_id(vocabulary.chunk_scores(vocabulary.split_logits(rows, width), ["id"], width, "token_id"))
    z = math.log(math.exp(1) + math.exp(2))
    assert got[0].logp == pytest.approx(2 - z) and got[0].token == 4 and got[0].margin == pytest.approx((math.exp(2) - math.exp(1)) / math.exp(z))
    assert got[0].neg_entropy == pytest.approx(math.exp(1 - z) * (1 - z) + math.exp(2 - z) * (2 - z))
    assert all(got[1][name] is None for name in vocabulary.SCORES)
    assert got[2].logp == low and got[2].top_prob == 1.0 and got[2].margin == 1.0


def test_missing_repeated_and_null(spark):
    chunks = vocabulary.split_logits(table(spark), 3)
    lost = chunks.where((F.col("id") != 0) | (F.col("chunk") != 1)).unionByName(chunks.where("id = 1 and chunk = 2"))
    lost = lost.where((F.col("id") != 2) | (F.col("chunk") != 2))
    got = by_id(vocabulary.chunk_scores(lost, ["id"], 3, "token_id", 7))
    assert [got[i].logp is None for i in range(4)] == [True, True, True, False]
    assert by_id(vocabulary.chunk_scores(lost, ["id"], 3))[2].max_logit == 0.0  # the last one's absence shows only in the number
    empty = table(spark, [(0, 1, None), (1, 1, []), (2, 1, [1.0, None]), (3, 9, [1.0, 2.0]), (4, None, [1.0, 2.0]), (5, -1, [1.0, 2.0])])
    got = by_id(vocabulary.chunk_scores(vocabulary.split_logits(empty, 2), ["id"], 2, "token_id"))
    assert [got[i].max_logit for i in range(6)] == [None, None, None, 2.0, 2.0, 2.0]
    assert all(row.logp is None for row in got.values())
    assert vocabulary.chunk_scores(vocabulary.split_logits(empty.limit(0), 2), ["id"], 2).collect() == []
    with pytest.raises(ValueError):
        vocabulary.split_logits(empty, 0)


def test_guidance_by_chunk(spark):
    rows = table(spark)
    other = rows.withColumn("logits", F.transform("logits", lambda x: x * 0.5 - 1))
    both = by_id(likelihood.combine_passes(rows, other, 1.5, ["id"]).select("id", whole.token_logp(F.col("logits"), F.col("token_id")).alias("logp")))
    cut = [vocabulary.split_logits(t, 2) for t in (rows, other)]
    chunks = likelihood.combine_passes(*cut, 1.5, ["id", "chunk"])
    got = by_id(vocabulary.chunk_scores(chunks, ["id"], 2, "token_id"))
    assert all(got[i].logp == pytest.approx(both[i].logp) for i in both)
    # A chunk that the second pass lost leaves the position unknown.
    chunks = likelihood.combine_passes(cut[0], cut[1].where("id != 2 or chunk != 1"), 1.5, ["id", "chunk"])
    got = by_id(vocabulary.chunk_scores(chunks, ["id"], 2, "token_id"))
    assert got[2].logp is None and got[1].logp == pytest.approx(both[1].logp)


def test_segment_token_logps(spark):
    rows = spark.createDataFrame(
        [(0, s, p, p, p + 1, [float(s), 1.0, p * 0.5]) for s in range(2) for p in range(3)],
        "seq_id bigint, segment bigint, pos bigint, token_id bigint, unmask_step bigint, logits array<double>",
    )
    expected = {tuple(r)[:3]: r.logp for r in likelihood.segment_token_logps(rows, 4, 2).collect()}
    got = {tuple(r)[:3]: r.logp for r in vocabulary.segment_token_logps(vocabulary.split_logits(rows, 2), 4, 2, 2, 3).collect()}
    assert got == {k: pytest.approx(v) for k, v in expected.items()} and len(got) == 3
