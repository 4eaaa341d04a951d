"""Operators that compare rows, against brute force over small tables with the odd cases in them."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rollscore.llm import jaccard, substring, topk, vectors
from rollscore.llm.components import components
from rollscore.llm.queries import queries
from rollscore.llm.sql import oracle_sql
from workload.compare import connect, differences

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


#: The first and fifth are held against brute force below as well.
@pytest.mark.parametrize("name", oracle_sql())
def test_query_equals_sql(spark, name):
    assert differences(queries()[name](spark, SF), connect(SF), oracle_sql()[name]) == []


def test_one_query_per_operator():
    assert [name.split("_")[0] for name in queries()] == [f"op{n}" for n in range(1, 14)]


# --- components ---------------------------------------------------------------------------------


def by_search(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize("shape", ["path", "star", "random", "odd"])
def test_components(spark, shape):
    rng = random.Random(shape)
    if shape == "path":
        nodes = list(range(60))
        rng.shuffle(nodes)
        edges = list(zip(nodes, nodes[1:]))
    elif shape == "star":
        edges = [(500, i) for i in range(300)] + [(500, 0)]
    elif shape == "random":
        edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)]
    else:
        edges = [(1, 1), (None, 2), (3, None), (5, 4), (4, 5), (-7, 4)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == by_search(edges)


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# --- substring dedup ----------------------------------------------------------------------------


@pytest.mark.parametrize("period", range(1, 40))
def test_difference_cover(period):
    cover = substring.difference_cover(period)
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def passages(rows, window):
    """(doc_id, kept words, removed) by looking at every window."""
    words = [(d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, w in words:
        if d is not None:
            for s in range(len(w) - window + 1):
                key = tuple(w[s:s + window])
                first[key] = min(first.get(key, d), d)
    found = []
    for d, w in words:
        gone = set()
        for s in range(len(w) - window + 1):
            if d is not None and first[tuple(w[s:s + window])] < d:
                gone.update(range(s, s + window))
        found.append((d, [x for i, x in enumerate(w) if i not in gone], len(gone), len(w)))
    return found


def repeats(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)]
    shared = [rng.choices(words, k=rng.randint(5, 40)) for _ in range(6)]
    rows = []
    for doc in range(60):
        parts = [rng.choices(words, k=rng.randint(0, 12))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(shared), rng.choices(words, k=rng.randint(0, 9))]
        rows.append((doc, rng.choice([" ", "  ", "\n", "\t \x0b"]).join(w for p in parts for w in p)))
    long = " ".join(rng.choices(words, k=4000))
    rows += [(100, ""), (101, None), (None, rows[3][1]), (None, long), (102, long), (103, "x " + long), rows[5], (104, rows[5][1]), (105, "é\x1c \xa0 w1")]
    return rows


@pytest.mark.parametrize("window", [1, 5, 13])
def test_repeats_equal_all_windows(spark, window, monkeypatch):
    monkeypatch.setattr(substring, "BLOCK_BYTES", 9000)
    monkeypatch.setattr(substring, "BUCKET_BYTES", 20_000)
    rows = repeats(window)
    frame = spark.createDataFrame([(d, t, "a", 1) for d, t in rows], "doc_id bigint, text string, block string, c0 int")
    found = substring.remove_repeats(frame, window).collect()
    got = sorted(((r.doc_id, r.text, r.n_removed, r.n_words) for r in found), key=str)
    assert got == sorted(((d, b" ".join(k).decode(), g, n) for d, k, g, n in passages(rows, window)), key=str)


def test_white_space_and_columns_can_stay(spark):
    text = "a  b\nc d e f\t g"
    rows = [(1, "c d e f", "p"), (2, text, "q"), (3, None, "r")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, block string")
    found = substring.remove_repeats(frame, 4, spaces=True, carry=["block"]).collect()
    assert sorted((r.doc_id, r.text, r.block) for r in found) == [(1, "c d e f", "p"), (2, "a  b\ng", "q"), (3, None, "r")]
    assert substring.remove_repeats(frame.limit(0), 4).count() == 0
    with pytest.raises(ValueError):
        substring.remove_repeats(frame, 0)


# --- embeddings ---------------------------------------------------------------------------------


def vector_rows(seed, n=300, width=8):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(20, width))
    rows = []
    for i in range(n):
        kind = i % 6
        v = base[i % 20] + rng.normal(size=width) * (0.25 if kind else 0.0) if kind < 4 else rng.normal(size=width)
        rows.append((i, [float(x) for x in v * 10.0 ** rng.integers(-3, 4)]))
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * width, [None] + [1.0] * 7, [nan] * width, [inf] + [1.0] * 7, [1.0, 2.0], [1.0, 2.0, 0.0], [1e300] * width, [1e-300] * width]
    rows += [(n + i, v) for i, v in enumerate(odd)]
    return [*rows, rows[7], (None, rows[7][1]), (n + 50, rows[7][1]), (n + 51, [-x for x in rows[7][1]])]


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


@pytest.mark.parametrize("tile", [16, 4096])
def test_links_equal_all_cosines(spark, tile):
    rows = vector_rows(tile)
    width = 8
    members = [(i, v) for i, v in rows if i is not None and usable(v) and any(v)]
    units = np.array([np.array(v + [0.0] * (width - len(v))) / max(map(abs, v)) for _, v in members])
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    linked = units @ units.T >= 0.95
    np.fill_diagonal(linked, False)
    edges = [(members[a][0], members[b][0]) for a, b in np.argwhere(linked)]
    groups = by_search(edges)
    counts = {}
    for (i, v), row in zip(members, linked, strict=True):
        counts[i] = int(row.sum())
    frame = spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id bigint, embedding array<double>, links string, vector double")
    found = vectors.near_duplicates(frame, 0.95, tile=tile).collect()
    assert len(found) == len(rows)
    for r in found:
        component = groups.get(r.vec_id, r.vec_id)
        assert (r.n_links, r.component_id) == (counts.get(r.vec_id, 0), component), r
        assert r.kept == (None if r.vec_id is None else r.vec_id == component)


def test_no_vectors(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
    only = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id bigint, embedding array<float>")
    assert sorted(tuple(r) for r in vectors.near_duplicates(only).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]


@pytest.mark.parametrize("block", [32, 4096])
def test_top_k_equals_all_products(spark, block, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", block // 4)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", block)
    rows = [(i, v) for i, v in vector_rows(3) if v is None or all(x is None or not np.isfinite(x) or abs(x) < 1e6 for x in v)]
    known = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and usable(v)]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<double>, score int")
    found = {}
    for r in topk.top_k(frame, F.col("vec_id") % 7 == 0).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    asked = {i: w for i, w in known if i % 7 == 0 and i != 7}
    for i, w in asked.items():
        scores = sorted(((-sum(a * b for a, b in zip(w, c)), j) for j, c in known if j != i))
        assert sorted(found[i]) == [(n + 1, j, -s) for n, (s, j) in enumerate(scores[:5])]
    assert set(found) == set(asked) | {7}


def test_top_k_of_few(spark):
    frame = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [1e300])], "vec_id bigint, embedding array<double>")
    found = sorted((r["rank"], r.vec_id, r.score) for r in topk.top_k(frame.where("vec_id < 2"), F.col("vec_id") == 0).collect())
    assert found == [(1, 1, 256 * 512)]
    assert topk.top_k(frame, F.col("vec_id") == 0).count() == 2
    assert topk.top_k(frame.limit(0), F.col("vec_id") == 0).count() == 0


# --- Jaccard join -------------------------------------------------------------------------------


def shingles(text, n):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def by_all_pairs(rows, n, ratio):
    sets = [(d, shingles(t, n)) for d, t in rows]
    edges = []
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and ratio[1] * len(x & y) >= ratio[0] * len(x | y):
                edges.append((a, b))
    groups = by_search(edges)
    return sorted(((d, len(s), groups.get(d, d)) for d, s in sets), key=str)


def near_copies(seed, hot=60):
    rng = random.Random(seed)
    words = [f"{c}{i}" for c in "abC" for i in range(60)]
    common = [rng.choices(words, k=30) for _ in range(3)]
    bases = [rng.choices(words, k=rng.choice([4, 9, 20, 60, 200])) for _ in range(12)]
    texts = []
    for _ in range(160):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 9])):
            w[rng.randrange(len(w))] = rng.choice(words)
        if rng.random() < 0.3:
            w += rng.choice(common)
        texts.append(" ".join(w))
    hub = rng.choices(words, k=150)
    for i in range(hot):  # a drifting group: its ends are no copies of each other
        w = list(hub)
        for j in range(0, i, 3):
            w[(j * 7) % len(w)] = f"n{j}"
        texts.append(" ".join(w))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    return [*rows, (900, ""), (901, None), (902, " \n"), (None, texts[0]), (903, texts[0].upper()), (904, "One two"), (905, "one  TWO"), (906, "one"), (907, texts[0] + " tail")]


@pytest.mark.parametrize(("n", "ratio", "seed"), [(3, (90, 100), 1), (5, (80, 100), 2)])
def test_groups_equal_all_pairs(spark, n, ratio, seed):
    rows = near_copies(seed)
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id bigint, text string, token string, n int")
    found = jaccard.jaccard_groups(frame, n, ratio).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == by_all_pairs(rows, n, ratio)


def test_a_document_with_many_partners_is_many_small_batches():
    n = 2000
    columns = {"id": [7] * n + [8], "text": ["a b c d e"] * n + ["b c d"], "a": [*range(n), 0], "part": [0] * (n + 1)}
    made = list(jaccard._sets(pa.table(columns).to_batches(), 3))
    assert max(b.num_rows for b in made) <= 500 and [x for b in made for x in b.column("a").to_pylist()] == columns["a"]
    one, other = (s.tobytes() for s in jaccard.shingle_sets(["a b c d e", "b c d"], 3))
    assert [x for b in made for x in b.column("shingles").to_pylist()] == [one] * n + [other]


def test_rows_of_one_document_are_one_vertex(spark):
    def text(seed, changed=None):
        w = random.Random(seed).choices([f"w{i}" for i in range(500)], k=120)
        return " ".join(w if changed is None else [*w[:changed], "new", *w[changed + 1:]])

    rows = [(3, text(1)), (5, text(1)), (5, text(2)), (7, text(2, 60)), (8, text(2)), (9, text(3)), (10, text(3, 1)), (10, None)]
    rows += [(20, text(4)), (21, text(5)), (22, text(4)), (22, text(5)), (23, text(5, 40)), (24, text(6)), (24, text(7)), (25, text(7, 3))]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = jaccard.jaccard_groups(frame, 3, (90, 100)).collect()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str)
    assert got == by_all_pairs(rows, 3, (90, 100))
    assert {r.component_id for r in found if r.doc_id in (3, 5, 7, 8)} == {3}


def test_no_documents(spark):
    frame = spark.createDataFrame([], "doc_id bigint, text string")
    assert jaccard.jaccard_groups(frame).count() == 0
    assert jaccard.jaccard_groups(spark.createDataFrame([(1, None), (2, "a")], "doc_id bigint, text string")).count() == 2


def test_prefixes_grow_with_the_cost_of_candidates():
    rare, common = np.arange(100, dtype=np.uint64), np.arange(100, dtype=np.uint64) + np.uint64(1 << 45)
    counts = np.zeros(jaccard.CELLS, np.int64)
    counts[jaccard._cell(common)] = 100_000
    assert jaccard.prefix(rare, counts, counts.mean(), (90, 100))[1] == 1
    shingles_, matches = jaccard.prefix(common, counts, counts.mean(), (90, 100))
    assert matches == 11 and len(shingles_) == 11 + matches - 1


def test_signatures_differ_in_no_more_than_their_sets():
    rng = np.random.default_rng(4)
    for n, m, common in [(1, 1, 0), (3, 70, 2), (64, 65, 60), (200, 200, 200), (500, 1500, 490), (1000, 1030, 990)]:
        every = np.unique(rng.integers(0, 2**64, n + m, dtype=np.uint64))
        x, y = np.sort(every[:n]), np.sort(np.concatenate([every[:common], every[n:n + m - common]]))
        differ, cells = jaccard.least_difference(jaccard.signature(x), jaccard.signature(y))
        assert differ <= len(np.setxor1d(x, y)) and (len(np.setxor1d(x, y)) - differ) % 2 == 0
        assert cells >= min(n, m) and cells & (cells - 1) == 0


def test_documents_that_only_share_a_passage_are_not_verified(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    passages = [rng.choices(words, k=80) for _ in range(12)]
    texts = [passages[i] + passages[j] for i in range(12) for j in range(i)]  # every shingle is in eleven of them
    texts.append([*texts[5][:20], "new", *texts[5][21:]])
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    asked = []

    def verified(pairs, *others):
        asked.extend((r.a, r.b) for r in pairs.collect())
        return before(pairs, *others)

    before = jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", verified)
    found = jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, (90, 100)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == by_all_pairs(rows, 3, (90, 100))
    assert {tuple(sorted(p)) for p in asked} == {(5, 66)}


# --- the pipeline -------------------------------------------------------------------------------


def toxic_corpus(spark, tmp_path):
    """Clean, toxic, copied and overlapping documents, with labels for half of them."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    passage = " ".join(rng.choices(words, k=70))
    rows, labels = [], []
    for doc in range(500):
        sentences = [" ".join(rng.choices(words, k=9)) for _ in range(rng.randint(3, 12))]
        if doc % 10 == 3:
            sentences[rng.randrange(len(sentences))] += " vile scum"
        text = ". ".join(sentences) + "."
        if doc % 50 == 7:
            text += "\n" + passage
        rows.append((doc, text, "en", "s", len(text)))
        labels.append((doc, 1, int(doc % 10 == 3)))
    near = rows[0][1].split(" ")
    near[5] = "changed"
    rows += [(600, rows[1][1], "en", "s", 1), (601, " ".join(near), "en", "s", 2), (602, None, None, None, None), (603, "", "en", "s", 0), (None, "no id", "en", "s", 5)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return {r[0]: r for r in rows}, passage


def test_stages(spark, tmp_path):
    rows, passage = toxic_corpus(spark, tmp_path)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns and dict(after.dtypes) == dict(docs.dtypes)
        after.write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        seen[name] = {r.doc_id: r for r in docs.collect()}
    toxic = {d for d in range(500) if d % 10 == 3}
    assert set(rows) - set(seen["toxicity"]) == toxic
    assert set(seen["toxicity"]) - set(seen["near_duplicates"]) == {600, 601}
    assert set(seen["substring_dedup"]) == set(seen["near_duplicates"])
    first = min(d for d in seen["near_duplicates"] if d is not None and d % 50 == 7 and d < 500)
    for doc, row in seen["substring_dedup"].items():
        before = seen["near_duplicates"][doc]
        if doc is not None and doc < 500 and doc % 50 == 7 and doc != first:
            assert row.text == before.text.removesuffix(passage) and row.n_chars == len(row.text)
        else:
            assert row == before
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "substring_dedup", "packing"]
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == set(seen["substring_dedup"])
