"""Operators on single texts, against libraries and brute force."""

from __future__ import annotations

import base64
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from rollscore.llm import bpe, counts, html, packing, toxicity, urls
from rollscore.llm.queries import RULES, op2_packing, op10_byte_bpe

ALPHABET = [
    "a", "B", "é", "e\u0301", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", "\u2003", "\u3000", "'s", "'ll", "12", "²", "Ⅷ",
    "½", "中", "文", "🙂", "\u200b", "\u200d", "!", "...", "_", "ß", "Σ", "İ", "the", "ing", "tion", "\ufeff", "<|endoftext|>", "≠", ",", ",",
]


def texts(n: int, seed: int = 1) -> list[str | None]:
    rng = random.Random(seed)
    made = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 30))) for _ in range(n)]
    return [*made, None, "", " ", "\n", "a" * 20_000, "ab " * 5000, "word " * 3 + "\n\n end  "]


def byte_encoding() -> tiktoken.Encoding:
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def word_encoding() -> Tokenizer:
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_perfect_hash_has_a_place_for_each_key_and_none_for_others():
    keys = [str(i).encode() for i in range(5000)]
    found = bpe.PerfectHash(keys)
    assert found.find(keys) == list(range(5000))
    assert sorted(found.at.tolist()) == list(range(5000))
    assert found.find([b"x", b"", b"5000"]) == [-1, -1, -1]
    assert bpe.PerfectHash([]).find([b"x"]) == [-1]


def test_byte_pairs_equal_the_library_and_come_back():
    pairs, expected = bpe.vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), byte_encoding()
    sample = texts(3000)
    for text, ids in zip(sample, pairs.encode(sample), strict=True):
        assert ids.tolist() == expected.encode_ordinary(text or "")
        assert pairs.decode(ids.tolist()) == (text or "").encode()


def test_words_with_marks_are_cut_without_the_tokenizer(monkeypatch):
    tokens, expected = packing.WordTokens(public_tokenizers.path("word_bpe_49k.json")), word_encoding()
    words = ["größer***", "it's", "=='s", "a1²b", "x|y", "É'LL", "a\u0301b.c", "don't,!", "'S", "###"]
    wanted = [expected.encode(w, add_special_tokens=False).ids for w in words]
    monkeypatch.setattr(tokens, "tokenizer", None)
    assert [np.frombuffer(tokens.plain(w), "<i4").tolist() for w in words] == wanted


def test_word_tokens_of_arrow_texts():
    tokens, expected = packing.word_tokens(public_tokenizers.path("word_bpe_49k.json")), word_encoding()
    texts = ["one two\none", None, "", " ", "two, one."]
    rows = pa.chunked_array([["before"], texts]).combine_chunks().slice(1)
    assert [x.tolist() for x in tokens.encode(rows)] == [expected.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_word_tokens_equal_the_library():
    tokens, expected = packing.word_tokens(public_tokenizers.path("word_bpe_49k.json")), word_encoding()
    sample = texts(3000)
    for text, ids in zip(sample, tokens.encode(sample), strict=True):
        assert ids.tolist() == expected.encode(text or "", add_special_tokens=False).ids


def test_texts_with_paragraphs_are_cached_by_words():
    pairs, expected = bpe.BytePairs(bpe.vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).ranks), byte_encoding()
    rng = random.Random(4)
    blanks = [" ", " ", "  ", "\n\n", "\n", " \n", "\n ", "\t", "\r\n", "\x1c ", "\u2003 ", "   "]
    sample = ["".join(rng.choice(["the", "word", "12", "!", "é"]) + rng.choice(blanks) for _ in range(400)) for _ in range(50)]
    sample += ["x" * 100_000, "end \n\n", "\n\nstart", " \n ", "\x85 a"]
    for text, ids in zip(sample, pairs.encode(sample), strict=True):
        assert ids.tolist() == expected.encode_ordinary(text)
    pairs.encode(["after"])
    for cache in (pairs.words, pairs.pieces):
        assert sum(map(len, cache.now)) + sum(map(len, cache.old)) < 20_000


def test_special_tokens_are_those_of_the_library():
    tokens, expected = packing.word_tokens(public_tokenizers.path("word_bpe_49k.json")), word_encoding()
    sample = ["hello <|endoftext|> world", "a<|endoftext|>b<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|>.", "x.<|endoftext|>"]
    assert expected.encode(sample[0], add_special_tokens=False).ids[1] == 49407
    for text, ids in zip(sample, tokens.encode(sample), strict=True):
        assert ids.tolist() == expected.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("capacity", [1, 8, 64])
def test_bins(seed, capacity):
    """Whole sequences apart, a document is cut once at most until the task ends, and a class bin holds k of its class uncut."""
    rng = random.Random(seed)
    sizes = [rng.choice([rng.randrange(1, 4), rng.randrange(1, capacity + 1), rng.randrange(1, 5 * capacity)]) for _ in range(300)]
    bins = packing.Bins(capacity, 1000)
    for doc, size in enumerate(sizes):
        bins.add(doc, np.arange(size))
        assert sum(p[2] for pieces in bins.open.values() for p in pieces) <= 2 * capacity * len(bins.open)
    early = bins.take()
    cuts = {}
    for doc, _, length, *_ in early + [(*p, 0, 0) for held in (*bins.open.values(), bins.filling if bins.gap else []) for p in held]:
        cuts.setdefault(doc, []).append(length)
    assert all(sum(n < capacity for n in lengths) <= 2 for lengths in cuts.values())
    bins.finish()
    placed = early + bins.take()
    for doc, size in enumerate(sizes):
        own = sorted(p[1:4:2] + (p[2],) for p in ((p[0], p[1], p[2], tuple(p[3].tolist())) for p in placed) if p[0] == doc)
        assert [x for _, ids, _ in own for x in ids] == list(range(size))
    used = {}
    for *_, sequence, offset in ((*p[:3], *p[5:]) for p in placed):
        used.setdefault(sequence, []).append(offset)
    lengths = {s: sum(p[2] for p in placed if p[5] == s) for s in used}
    assert all(n <= capacity and n & (n - 1) == 0 for n in lengths.values())
    assert sum(n < capacity for n in lengths.values()) <= capacity.bit_length()


def _documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, start string, ids string, block string")


def _odd_rows():
    sample = texts(200, 5)
    rows = [(i, t, "x", "y", "z") for i, t in enumerate(sample)]
    return [*rows, *rows[:3], (None, "no id", None, None, None)]


def test_packing_places_every_id_once(spark):
    rows = _odd_rows()
    expected = word_encoding()
    whole = {}
    for doc, text, *_ in rows:
        whole.setdefault(doc, []).append([*expected.encode(text or "", add_special_tokens=False).ids, 2])
    pieces = packing.pack(_documents(spark, rows).repartition(3), public_tokenizers.path("word_bpe_49k.json")).collect()
    assert sum(p.length for p in pieces) == sum(len(x) for copies in whole.values() for x in copies)
    sequences = {}
    for p in pieces:
        assert p.ids == whole[p.doc_id][0][p.start:p.start + p.length] and p.doc_tokens == len(whole[p.doc_id][0])
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096 and at & (at - 1) == 0  # full, or a power of two: nothing is padded
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append((p.start, p.length))
    for doc, copies in whole.items():
        positions = sorted(x for s, n in by_doc[doc] for x in range(s, s + n))
        assert positions == sorted(list(range(len(copies[0]))) * len(copies))


def test_packing_refuses_other_capacities(spark):
    with pytest.raises(ValueError):
        packing.pack(_documents(spark, []), "", capacity=1000)


def test_packing_query_gives_checksums(spark):
    from __spark_entry__ import SMALL

    expected = word_encoding()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    found = op2_packing(spark, SMALL).collect()
    for p in found:
        ids = [*expected.encode(docs[p.doc_id], add_special_tokens=False).ids, 2][p.start:p.start + p.length]
        assert p.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encode_and_decode_tables(spark):
    path, expected = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), byte_encoding()
    rows = _odd_rows()
    docs = _documents(spark, rows)
    encoded = bpe.encode(docs, path)
    found = sorted(((r.doc_id, r.ids) for r in encoded.collect()), key=str)
    assert found == sorted(((d, expected.encode_ordinary(t or "")) for d, t, *_ in rows), key=str)
    decoded = bpe.decode(encoded, path).collect()
    assert sorted(((r.doc_id, bytes(r.decoded)) for r in decoded), key=str) == sorted(((d, (t or "").encode()) for d, t, *_ in rows), key=str)
    assert bpe.encode(docs.limit(0), path).count() == 0


def test_byte_bpe_query(spark):
    import hashlib

    from __spark_entry__ import SMALL

    expected = byte_encoding()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    found = op10_byte_bpe(spark, SMALL).collect()
    assert len(found) == len(docs)
    for r in found:
        ids = expected.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


# --- token counts -------------------------------------------------------------------------------


def _library(pieces: dict[str, float]) -> Tokenizer:
    bytes_ = [(f"<0x{b:02X}>", 0.0) for b in range(256)]
    vocab = [("<unk>", 0.0), *bytes_, *pieces.items()]
    return Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))


def _brute(pieces: dict[str, float], text: str) -> tuple[int, float]:
    marked = "▁" + text.replace(" ", "▁") if text else ""
    unknown = min(pieces.values()) - 10
    best = [(0.0, 0)] + [None] * len(marked)
    for end in range(1, len(marked) + 1):
        for start in range(end):
            piece = marked[start:end]
            if piece in pieces:
                option = (best[start][0] + pieces[piece], best[start][1] + 1)
            elif end - start == 1:
                option = (best[start][0] + unknown, best[start][1] + len(piece.encode()))
            else:
                continue
            if best[end] is None or option[0] > best[end][0]:
                best[end] = option
    return best[-1][1], best[-1][0]


def test_counts_equal_brute_force_with_ties():
    pieces = {"▁": -2.0, "a": -1.0, "b": -1.0, "ab": -2.0, "▁a": -3.0, "ba": -2.0, "aba": -3.0, "é": -4.0, "▁▁": -5.0}
    found = counts.Unigram(pieces)
    rng = random.Random(3)
    for _ in range(500):
        text = "".join(rng.choices(["a", "b", " ", "é", "z", "🙂", "▁"], k=rng.randint(0, 12)))
        assert found.count([text]) == [_brute(pieces, text)], text


def test_counts_equal_the_library():
    found = counts.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    pieces = {p: v[1] for p, v in found.automaton.items()}
    library = _library(pieces)
    from __spark_entry__ import SMALL
    import pyarrow.parquet as pq

    sample = [t for t in pq.read_table(f"{SMALL}/documents.parquet").column("text").to_pylist() if "<0x" not in t][:60]
    sample += [t for t in texts(300, 9) if t and "\n" not in t]
    for text, (number, _) in zip(sample, found.count(sample), strict=True):
        assert number == len(library.encode("▁" + text.replace(" ", "▁"), add_special_tokens=False).ids), text


def test_count_table(spark):
    rows = _odd_rows()
    path = public_tokenizers.path("piece_bpe_32k.model")
    found = counts.token_counts(_documents(spark, rows), path)
    assert found.count() == len(rows)
    assert {tuple(r) for r in found.where("doc_id in (200, 201)").collect()} == {(200, 0, 0.0), (201, 0, 0.0)}
    assert counts.token_counts(_documents(spark, []), path).count() == 0


def test_marks_inside_a_piece_are_refused():
    with pytest.raises(ValueError):
        counts.Unigram({"a▁b": -1.0})


# --- pages --------------------------------------------------------------------------------------

ARTICLE = "<h1>Head line</h1><p>First &amp; long enough paragraph of text<br>next line.</p><p>Second <b>bo</b>ld paragraph with words.</p>"
MAIN = "Head line First & long enough paragraph of text next line. Second bold paragraph with words."


@pytest.mark.parametrize(
    "page",
    [
        f"<html><body><nav><ul><li><a href=x>Menu</a></ul></nav><article>{ARTICLE}</article><footer>foot</footer></body></html>",
        f"<!DOCTYPE html><body><div class='ad'>Buy now, very long advert text that goes on and on for ever.</div><div id=content>{ARTICLE}</div>"
        "<div id='comments'><p>I disagree with all of this, and at some length too.</p></div>",
        f"<body><script>if (a < b) document.write('<p>no</p>')</script><main>{ARTICLE}<form><input value=x>Search</form></main><aside>side</aside>",
        f"<body><div class='cookie-notice'><p>We use cookies, a great many of them.</p></div><!-- <p>gone</p> --><article>{ARTICLE}",
    ],
)
def test_article_is_found(page):
    assert html.extract(page) == MAIN


WHOLE_ARTICLE = "<article><h1>Title</h1><p>" + "The first long paragraph of the text. " * 6 + "</p><p>And a second one, of some length too.</p></article>"
WHOLE_TEXT = "Title " + " ".join(["The first long paragraph of the text."] * 6) + " And a second one, of some length too."


@pytest.mark.parametrize("page", [
    "<head><title>x</title><body>{}",  # the end of a head may be left out, and so may its body
    "<html><head><meta charset=utf-8><style>p {{}}</style>{}",
    "<head><title>x</title></head>{}",
    "<header><h2>Site</h2><nav><li><a href=/>Home</a><main>{}</main>",
    "<nav><ul><li><a href=/>Home</a></ul><main>{}</main>",
    "<header><main>{}</main></header><footer>About us</footer>",
    "<aside>Menu {}</aside>",
    "<body><button>Open<div>{}</div>",
    "<body><dialog><p>Note</p></dialog>{}<menu><li>One</menu>",
])
def test_article_in_or_after_unclosed_parts(page):
    found = html.extract(page.format(WHOLE_ARTICLE))
    assert found == WHOLE_TEXT


@pytest.mark.parametrize("page", [
    f"<body><div class='layout has-sidebar'><main><article>{ARTICLE}</article></main><div class=sidebar>Side text</div></div>",
    f"<body><div class='no-menu'><div class='fixed-header'><article>{ARTICLE}</article></div></div>",
    f"<body><div class='menu overlay'><div id=search><article>{ARTICLE}</article></div></div><div class=menu>Home</div>",
    f"<body><div data-id='share' title='class=menu'>{ARTICLE}</div>",
    f"<body><div class='skip'>{ARTICLE}</div><div class='cookie-notice'><p>Cookies here.</p></div>",
    f"<body><form id=aspnetForm><div role=search>Find</div><article>{ARTICLE}</article></form>",
    f"<body><main><article>{ARTICLE}</article><article class='comment'><p>{'I do not agree. ' * 40}</p></article></main>",
    f"<body><article>{ARTICLE}<section id=comments><article class='comment-body'><p>No.</p></article></section></article>",
    f"<body><main><article>{ARTICLE}</article></main><div class='related-posts'><article><p>Another one.</p></article></div>",
    f"<body><div class=ad>{'Buy this now. ' * 40}</div><main><div class=promo>{'And that. ' * 40}</div><article>{ARTICLE}</article></main>",
    f"<body><main><div class=banner><p>Short.</p></div><div class=overlay>{ARTICLE}</div></main>",
    f"<body><article>{ARTICLE}<span class=share>Share</span> <a class='skipLink skip' href=x>Skip</a></article>",
])
def test_a_name_alone_takes_no_article(page):
    assert html.extract(page) == MAIN


LINKS = "<ul>" + "".join(f"<li><a href=/{i}>Link number {i}</a></li>" for i in range(12)) + "</ul>"
LONG = "<p>" + "A sentence that goes on for a while. " * 12 + "</p>"
LONG_TEXT = ("A sentence that goes on for a while. " * 12).strip()


@pytest.mark.parametrize(("page", "text"), [
    (f"<body><div>{LINKS}</div><div>{LONG * 3}</div><div>{LINKS}</div>", " ".join([LONG_TEXT] * 3)),
    (f"<body><div class=c1><div class=c2>{LINKS}</div><div class=c3><h1>Title</h1><div class=c4>{LONG * 2}</div></div></div>"
     "<div class=c5><div><span>(c) 2026</span></div></div>", " ".join(["Title", LONG_TEXT, LONG_TEXT])),
    (f"<body><table><tr><td>{LINKS}<td>{LONG * 2}<td>{LINKS}</table>", " ".join([LONG_TEXT] * 2)),
    # The threshold finds a second part; short lines and link lists between stay out.
    (f"<body><div>{LONG * 3}</div><div>{LINKS}</div><div><i>x</i></div><div>{LONG}</div>", " ".join([LONG_TEXT] * 4)),
])
def test_density_alone_finds_the_text(page, text):
    assert html.extract(page) == text


def test_an_article_is_one_piece_whatever_its_densities():
    inside = f"<h2>One</h2><section>{LONG * 3}</section><h2>Two</h2><section><p>Short.</p></section>"
    assert html.extract(f"<body><div>{LINKS}</div><article>{inside}</article>") == f"One {' '.join([LONG_TEXT] * 3)} Two Short."


@pytest.mark.parametrize("page", [None, "", "<", "<p", "</", "<!--", "<a href='x", "<script>never closed", "<div class=\"" * 50])
def test_broken_pages_do_not_fail(page):
    assert isinstance(html.extract(page), str)


def test_deep_and_long_pages():
    assert html.extract("<div>" * 20_000 + "words here" + "</div>" * 20_000) == "words here"
    assert len(html.extract("<body><article>" + "<p>" + "a b " * 100_000)) == 399_999


def test_pages_table(spark):
    rows = [(1, "u", f"<body><article>{ARTICLE}</article>", 1), (1, "u", f"<body><article>{ARTICLE}</article>", 1), (None, None, None, 2), (3, "v", "", 3)]
    found = html.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string, text int"))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(
        [(1, "u", MAIN, len(MAIN)), (1, "u", MAIN, len(MAIN)), (None, None, "", 0), (3, "v", "", 0)], key=str
    )


# --- urls ---------------------------------------------------------------------------------------


def test_urls(spark):
    rows = [
        (1, "http://a.example.net/en/1?x#y"), (2, "https://EXAMPLE.com/de/2"), (3, "http://x.example.com/de/../fr"), (4, "http://b.org/fr/"),
        (5, "http://net"), (6, "http://net/"), (7, None), (8, "no scheme"), (9, "x://É.Example.NET?en/"), (10, "http://notexample.net/en/"), (4, "http://b.org/fr/"),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    found = urls.judge(pages, spark.createDataFrame([], "page_id bigint, bad int"), RULES).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found}
    assert len(found) == len(rows)
    assert got[1] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert got[2] == ("example.com", "/de/2", "example.com/de/", "block")
    assert got[3][2] == "example.com/de/" and got[4][2:] == ("org/fr/", "allow")
    assert got[5] == ("net", "", None, "allow") and got[6] == ("net", "/", "net/", "block")
    assert got[7] == ("", "", None, "allow") == got[8]
    assert got[9] == ("É.example.net", "", None, "allow") and got[10][2:] == ("net/", "block")


def test_reputation_shrinks_small_hosts(spark):
    rows = [("bad.a.com", 1)] * 60 + [("bad.a.com", 0)] * 5 + [("one.b.com", 1)] + [(f"h{i}.c.com", int(i % 10 == 0)) for i in range(300)] + [("new.d.com", None)]
    found = {r.host: r for r in urls.reputations(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert found["bad.a.com"].verdict == "block" and found["bad.a.com"].mean > 0.6
    assert found["one.b.com"].verdict == "allow" and found["new.d.com"].n == 0
    assert 0 < found["h1.c.com"].mean < found["one.b.com"].mean < 1


# --- toxicity -----------------------------------------------------------------------------------


def test_model_finds_the_sentence(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for doc in range(600):
        parts = [" ".join(rng.choices(words, k=8)) for _ in range(rng.randint(1, 9))]
        toxic = int(doc % 4 == 0)
        if toxic:
            at = rng.randrange(len(parts))
            parts[at] += " " + rng.choice(["vile", "rotten", "nasty"])
        docs.append((doc, ". ".join(parts) + "."))
        labels.append((doc, toxic))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    model = toxicity.train(frame, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    odd = spark.createDataFrame([(None, None, 1.0), (7, "", 1.0), (8, "...", 1.0), (9, "You VILE thing. w1 w2", 1.0)], "doc_id bigint, text string, score double")
    for r in toxicity.score(frame, model).collect():
        assert (r.score >= 0.5) == (r.doc_id % 4 == 0)
        assert (r.sentence is not None) == (r.doc_id % 4 == 0)
        if r.sentence:
            assert {"vile", "rotten", "nasty"} & set(r.sentence.split())
    found = {r.doc_id: r for r in toxicity.score(odd, model).collect()}
    assert found[None].score == found[7].score == found[8].score == 0.0 and found[7].sentence_number == -1
    assert found[9].score > 0.5 and found[9].sentence == "you vile thing" and found[9].sentence_number == 0
    assert toxicity.keep_clean(odd, model).count() == 3


def test_model_finds_stems_with_endings_it_has_not_seen(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    endings = ["".join(x) for x in zip(rng.choices("aeiou", k=900), rng.choices("bcdfg", k=900), rng.choices("lmnrs", k=900), strict=True)]
    docs = [(i, " ".join([*rng.choices(words, k=30), *([rng.choice(["vilko", "rottu"]) + endings[i]] if i % 4 == 0 else [])])) for i in range(900)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)], "doc_id bigint, toxic int")
    model = toxicity.train(frame, labels)
    new = frame.where("doc_id >= 600").withColumn("text", F.regexp_replace("text", "(vilko|rottu)[a-z]+", "$1kjx"))
    assert all((r.score >= 0.5) == (r.doc_id % 4 == 0) for r in toxicity.score(new, model).collect())


@pytest.mark.parametrize(("label", "side"), [(0, False), (1, True)])
def test_one_label_only(spark, label, side):
    docs = spark.createDataFrame([(i, f"some text {i}.") for i in range(40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, label) for i in range(40)] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    assert {r.score >= 0.5 for r in toxicity.score(docs, model).collect()} == {side}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    from rollscore.llm.queries import op6_toxicity

    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in op6_toxicity(spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.95
