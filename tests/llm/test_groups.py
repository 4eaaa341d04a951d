"""Shared lines, hard negatives and prefix tries against brute force, with the odd cases in them."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollscore.llm import lines, negatives, trie

DOCS = "doc_id bigint, text string"

# --- lines --------------------------------------------------------------------------------------


def by_counting(rows, least, min_chars):
    def key(line):
        return line.encode().strip().lower()

    texts = [(t or "").split("\n") for _, t in rows]
    held = Counter(k for t in texts for k in {key(x) for x in t})
    common = {k for k, n in held.items() if n >= least and len(k.decode()) >= min_chars}
    return sorted(
        ((i is not None, i or 0), len(t), sum(key(x) in common for x in t),
         raw if raw is None else "\n".join(x for x in t if key(x) not in common))
        for (i, raw), t in zip(rows, texts)
    )


ODD = [
    (1, None), (2, ""), (3, "\n"), (None, "a\nb"), (None, "A \n\tb"), (4, "x" * 100_000 + "\n" + "é\n" * 3000), (5, "É\né\nb"),
    (6, "a\na\na"), (6, "a\na\na"), (7, " a\n a\x0b\n\x1ca"), (8, "b\r\n"),
]


@pytest.mark.parametrize("least, min_chars", [(1, 1), (2, 1), (3, 0), (3, 2), (4, 1)])
@pytest.mark.parametrize("small", [False, True])
def test_lines(spark, monkeypatch, least, min_chars, small):
    rng = random.Random(least)
    rows = ODD + [(i, "\n".join(rng.choice("abcdefgh ") * rng.randrange(3) for _ in range(rng.randrange(6)))) for i in range(20, 60)]
    if small:
        monkeypatch.setattr(lines, "BLOCK_BYTES", 64)
        monkeypatch.setattr(lines, "SHARD_LINES", 16)
    found = lines.drop_common_lines(spark.createDataFrame(rows, DOCS), least, min_chars).collect()
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.n_lines, r.n_dropped, r.text) for r in found if r.text is not None) == [
        x for x in by_counting(rows, least, min_chars) if x[3] is not None
    ]
    assert [r.doc_id for r in found if r.text is None] == [1]


def test_lines_clashing_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(i, "same\nown%d" % i, i, "k") for i in range(12)], "doc_id int, text string, block int, c0 string")
    found = lines.drop_common_lines(docs, 10, carry=["block", "c0"])
    assert found.columns == ["doc_id", "n_lines", "n_dropped", "text", "block", "c0"]
    assert {(r.doc_id, r.text, r.block, r.c0) for r in found.collect()} == {(i, f"own{i}", i, "k") for i in range(12)}
    assert lines.drop_common_lines(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        lines.drop_common_lines(docs, 0)


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 5000])
def test_perfect_hash_is_minimal(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**64, (n, 2), np.uint64)
    keys[: n // 2, 0] = 7  # equal first halves
    counts = rng.integers(1, 500, n)
    index = lines.LineIndex(keys[:, 0], keys[:, 1], counts, 300)
    assert sorted(index.slots(keys[:, 0], keys[:, 1]).tolist()) == list(range(n))
    assert (index.probe(keys[:, 0], keys[:, 1]) == np.minimum(counts, 300)).all()
    others = rng.integers(0, 2**64, (1000, 2), np.uint64)
    assert not index.probe(others[:, 0], others[:, 1]).any()


# --- hard negatives -----------------------------------------------------------------------------


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 5, 7), (33, 17, 65), (64, 64, 64), (40, 3, 90), (0, 4, 5), (129, 64, 257)])
@pytest.mark.parametrize("leaf", [1, 4, 8])
def test_strassen(shape, leaf):
    rng = np.random.default_rng(sum(shape))
    a, b = (rng.integers(-2**62, 2**62, s) for s in (shape[:2], shape[1:]))
    assert (negatives.strassen(a, b, leaf) == a @ b).all()


def by_all_scores(rows, positives=5, lowest=50, highest=95, k=3):
    rows = [(i, v, label) for i, v, label in rows
            if None not in (i, v, label) and all(x is not None and np.isfinite(x) for x in v)]
    whole = [(i, [int(np.floor(256 * x)) for x in v], label) for i, v, label in rows]
    found = []
    for i, v, label in {(i, tuple(v), label) for i, v, label in whole if i % 5 == 0}:
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, other) for j, w, other in whole)
        first = [(j, -s) for s, j, other in scored if other == label and j != i][:positives]
        for j, score in first:
            near = [(n, -s) for s, n, other in scored if other != label and lowest * score <= -100 * s <= highest * score]
            found += [(i, j, rank, n, score, s) for rank, (n, s) in enumerate(near[:k], 1)]
    return sorted(found)


VECTORS = "vec_id bigint, embedding array<float>, label int"


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives(spark, monkeypatch, small):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.25, 0.5, 0.75, 1.0]) for _ in range(6)], rng.choice([1, 1, 1, 2, 3])) for i in range(160)]
    rows += [(200, [0.5, 0.5], 1), (205, [], 2), (210, [0.0] * 6, 2), (215, [1.0] * 6, 9), (220, [3.0] * 6, 1)]
    rows += [(10, [1.0] * 6, None), (None, [1.0] * 6, 1), (15, None, 1), (20, [None, 1.0], 1), (25, [float("nan")], 2), (30, [float("inf")], 2)]
    rows += rows[40:46] + rows[40:42]
    if small:
        monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 4)
        monkeypatch.setattr(negatives, "CANDIDATE_BLOCK", 16)
    found = negatives.hard_negatives(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 5 == 0)
    assert sorted(map(tuple, found.collect())) == by_all_scores(rows)


def test_hard_negatives_empty_and_clashing(spark):
    rows = spark.createDataFrame([(5, [1.0], 1, "a"), (6, [1.0], 1, "b"), (7, [0.75], 2, "c")], VECTORS + ", score string")
    found = negatives.hard_negatives(rows.withColumnRenamed("score", "part"), F.col("vec_id") % 5 == 0)
    assert [tuple(r) for r in found.collect()] == [(5, 6, 1, 7, 65536, 49152)]
    assert negatives.hard_negatives(rows.limit(0), F.col("vec_id") % 5 == 0).count() == 0


# --- prefix trie --------------------------------------------------------------------------------


def by_walking(turns, first=lambda c: (c, 0)):
    own = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(rows, key=lambda t: t[0])] for c, rows in own.items()}
    rebuilt = {}
    for c, rows in own.items():
        other, n = first(c)
        rebuilt[c] = tuple(own.get(other, [])[:n] + rows[n:])
    members = defaultdict(list)
    for c, rows in rebuilt.items():
        for d in range(len(rows) + 1):
            members[rows[:d]].append(c)
    children = Counter(node[:-1] for node in members if node)
    leaves, saved = Counter(), Counter()
    for node, held in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(held) - 1) * (len(node[-1][1].encode().split()) if node else 0)
    return sorted(
        (min(held), len(node), min(members[node[:-1]]) if node else -1, len(held), children[node], leaves[node], saved[node],
         hashlib.sha256(",".join(map(str, sorted(c for c in held if rebuilt[c] == node))).encode()).hexdigest())
        for node, held in members.items()
    )


def nodes_of(frame):
    return sorted(tuple(-1 if x is None else x for x in r) for r in frame.collect())


TURNS = "conv_id bigint, turn int, role string, text string"


def conversations(shape, rng):
    if shape == "random":
        return [(c, t, rng.choice("ab"), rng.choice(["x", "x y", ""])) for c in range(-30, 90) for t in range(rng.randrange(5))]
    if shape == "equal":  # one conversation is most of the table
        return [(c, t, "u", f"turn {t}") for c in range(150) for t in range(3)] + [(200, t, "u", f"turn {t}") for t in range(5)]
    if shape == "long":  # wider than several panels, sharing all but the end
        return [(c, t, "u", f"w{t}" if t < 190 + c else f"own {c}") for c in range(4) for t in range(150 + 30 * c)] + [(9, 0, "u", "w0")]
    return [
        (1, 2, "u", "later"), (1, None, None, None), (1, 1, "u", "a  b\tc"), (None, 0, "u", "x"), (2, 0, "u", "long " * 50_000),
        (3, 0, None, ""), (4, 0, "", None), (5, 7, "u", "a b"), (6, 1, "u", "same"), (6, 2, "u", "same"), (7, 0, "u", "same"),
    ]


@pytest.mark.parametrize("shape", ["random", "equal", "long", "odd"])
@pytest.mark.parametrize("size", [1, 7, 1 << 16])
@pytest.mark.parametrize("parts", ["true", "false"])
def test_trie(spark, monkeypatch, shape, size, parts):
    """In one partition, as small tables are, or in as many as there can be."""
    monkeypatch.setattr(trie, "PANEL", 16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", parts)
    turns = conversations(shape, random.Random(shape))
    rows = trie.sequences(spark.createDataFrame(turns, TURNS))
    try:
        assert nodes_of(trie.prefix_trie(rows, size)) == by_walking(turns)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_first_turns_of_another(spark):
    turns = conversations("random", random.Random(5)) + [(500, 0, "u", "alone"), (501, 0, "u", "gone")]
    rows = trie.sequences(spark.createDataFrame(turns, TURNS))
    other, n = F.col("conv_id") - F.col("conv_id") % 20, F.abs("conv_id") % 4
    rebuilt = trie.with_first_turns(rows, F.when(F.col("conv_id") < 500, other).otherwise(7777), n, 3)

    def first(c):
        return (c - int(np.fmod(c, 20)) if c < 500 else 7777), abs(c) % 4

    assert nodes_of(trie.prefix_trie(rebuilt, 16)) == by_walking(turns, first)


def test_trie_of_nothing(spark):
    rows = trie.sequences(spark.createDataFrame([], TURNS + ", ids int, words int"))
    assert trie.prefix_trie(rows).count() == 0
    one = spark.createDataFrame([(1, [], []), (2, [], [])], "conv_id bigint, ids array<bigint>, words array<int>")
    assert [r[:7] for r in nodes_of(trie.prefix_trie(one))] == [(1, 0, -1, 2, 0, 1, 0)]


def test_chunks_of_ids_are_one_hash():
    import pyarrow as pa

    batch = pa.record_batch({"depth": [1, 1, 2], "key": [b"a", b"a", b"a"], "ends": [b"1,2", b"3", b"4"]})
    found = pa.Table.from_batches(trie._streamed([batch.slice(0, 1), batch.slice(1, 2)])).to_pydict()
    assert found["depth"] == [1, 2]
    assert found["ends_sha256"] == [hashlib.sha256(x).digest() for x in (b"1,2,3", b"4")]
