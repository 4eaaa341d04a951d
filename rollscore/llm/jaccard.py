"""N-gram Jaccard join by adaptive multi-match prefixes.

Shingles have one global order: by how often a fixed-size sketch of all documents has counted them, then by
hash. Two sets that reach the threshold share a shingle among the first few of each (the prefix); prefixes
longer by one share two, and so on. Each document takes the length whose estimated cost of candidates is
least, and a pair needs as many shared prefix shingles as the shorter-reaching of the two asks for, before
any whole set is looked at. Candidates come from the shortest prefixes; the longer ones only sift them.

A result names groups, so copies are not paired with each other:

* Documents with equal sets are one vertex from the start.
* Each prefix shingle first pairs its documents with one of them, its hub: the one whose prefix is shared
  most, so that edited copies meet their original. Rows grow with documents. Verified links make the first
  components.
* A verified document also leaves its difference from the hub: what it adds, then what it lacks. Two documents of
  one hub that link without both linking to it share part of their differences, at least about half of the smaller one
  (see ``_needed``). So within a shingle that very many near copies hold, a second match is asked for, on
  hub and difference, before a row of two documents exists; and what they share is counted in the differences alone.
* Documents that are far from the hub of a shingle, or cannot link to it by their prefixes or sizes, keep no difference from it.
  They meet the others of that shingle directly, if sizes, components and distances from the hub allow a link (the Jaccard
  distance obeys the triangle inequality).

Verification intersects the whole sets, built for the documents of sifted pairs only. Most pairs that share a prefix shingle share
a passage and no more: what tells them apart, before prefixes or sets are moved, is a parity signature of about a bit a shingle. As
many bits as two signatures differ in, their sets differ in at least so many shingles, so no link is lost by it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollscore.llm.batches import int_lists, slices
from rollscore.llm.components import MIX, components
from rollscore.llm.words import lanes_of, runs
from rollscore.session import cut_lineage

#: Cells of the sketch, and of a row that carries a part of it.
CELLS, CELLS_PER_ROW = 1 << 22, 1 << 14
#: How many looked-up shingles cost as much as one verification.
VERIFY_COST = 16
#: Up to so many rows of a few numbers are sent to the texts or prefixes; beyond, those are shuffled to them.
BROADCAST_ROWS = 500_000
#: A document keeps its difference from a hub if that is up to so many times what two linked sets can differ by.
NEAR = 4
#: Shingles verified against one hub in one group, about.
GROUP_SHINGLES = 500_000

#: Similarity as (numerator, denominator).
Ratio = tuple[int, int]


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes; A-Z count as a-z.

    A text with fewer words than a shingle is one shingle of all its words; one without words has none.
    """
    split = [t.encode().lower().split() if t else [] for t in texts]
    lane, _, starts = lanes_of(split)
    lengths = np.diff(starts)
    sets = []
    doc = np.repeat(np.arange(len(split)), lengths)
    place = np.arange(starts[-1]) - starts[:-1][doc]
    at = np.flatnonzero(lengths[doc] - place >= words)
    hashes, ends = runs(lane, at, words), np.searchsorted(doc[at], np.arange(len(split) + 1))
    for i, length in enumerate(lengths.tolist()):
        if length >= words:
            sets.append(np.unique(hashes[ends[i]:ends[i + 1]]))
        elif length:
            sets.append(runs(lane, starts[i:i + 1], length, 1) + np.uint64(length))
        else:
            sets.append(np.empty(0, np.uint64))
    return sets


def signature(shingles: np.ndarray) -> bytes:
    """Parities of the numbers of shingles in as many cells as there are shingles, or up to twice as many: a power of two."""
    cells = 1 << max(6, (len(shingles) - 1).bit_length())
    held = np.bincount((shingles & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return np.packbits((held & 1).astype(np.uint8), bitorder="little").tobytes()


def least_difference(one: bytes, other: bytes) -> tuple[int, int]:
    """(shingles that the sets of two signatures differ in at least, cells that were compared)."""
    x, y = sorted((np.frombuffer(s, "<u8") for s in (one, other)), key=len)
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum()), 64 * len(x)


def _alike(batches: Iterable[pa.RecordBatch], ratio: Ratio, times: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) whose sets can link, and those that seem to differ by up to ``times`` what linked sets can differ by.

    d shingles at random are expected to change so many parities of c cells: c / 2 (1 - exp(-2 d / c)).
    """
    for batch in slices(batches):
        columns = (batch.column(c).to_pylist() for c in ("s", "t", "a_n", "b_n"))
        alike = []
        for s, t, n, m in zip(*columns, strict=True):
            differ, cells = least_difference(s, t)
            most = (n + m) * (ratio[1] - ratio[0]) // (ratio[1] + ratio[0])
            alike.append(differ <= max(most, -cells / 2 * np.expm1(-2 * times * most / cells)))
        yield batch.select(["a", "b"]).filter(pa.array(alike, pa.bool_()))


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(42)).astype(np.int64)


def _sketch(batches: Iterable[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(CELLS, np.uint32)
    for batch in slices(batches):
        sets = shingle_sets(batch.column("text").to_pylist(), words)
        if sets:
            cells, times = np.unique(_cell(np.concatenate(sets)), return_counts=True)
            counts[cells] += times.astype(np.uint32)
    rows = [counts[i:i + CELLS_PER_ROW] for i in range(0, CELLS, CELLS_PER_ROW)]
    full = [i for i, r in enumerate(rows) if r.any()]
    yield pa.record_batch(
        [pa.array(full, pa.int32()), pa.array([_narrow(rows[i]) for i in full], pa.binary())], ["part", "counts"]
    )


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs; the length tells how many."""
    return counts.astype(np.min_scalar_type(counts.max()).newbyteorder("<")).tobytes()


def _add(table: pa.Table) -> pa.Table:
    counts = np.zeros(CELLS_PER_ROW, np.int64)
    for packed in table.column("counts").to_pylist():
        counts += np.frombuffer(packed, f"<u{len(packed) // CELLS_PER_ROW}").astype(np.int64)
    return pa.table({"part": table.column("part")[:1], "total": pa.array([counts.tobytes()], pa.binary())})


def shingle_counts(docs: DataFrame, words: int) -> np.ndarray:
    """How many documents' shingles fall into each of ``CELLS`` cells: a fixed size, over all documents."""
    parts = docs.mapInArrow(lambda b: _sketch(b, words), "part int, counts binary")
    counts = np.zeros(CELLS, np.float32)  # only their order counts, and about how large they are
    for row in parts.groupBy("part").applyInArrow(_add, "part int, total binary").collect():
        counts[row.part * CELLS_PER_ROW:(row.part + 1) * CELLS_PER_ROW] = np.frombuffer(row.total, "<i8")
    return counts


def shortest_match(size: int, ratio: Ratio) -> int:
    """The least overlap a set of ``size`` can have with one that reaches the threshold."""
    return -(-size * ratio[0] // ratio[1])


def prefix(shingles: np.ndarray, counts: np.ndarray, usual: float, ratio: Ratio) -> tuple[np.ndarray, int]:
    """(the first shingles in the global order, matches a partner must have among them).

    ``usual`` is the mean of ``counts``: what a cell holds of shingles that are not the one looked up.

    A set whose partners can only be equal sets has no prefix: equal sets are one vertex already.
    """
    size = len(shingles)
    if size * (ratio[1] - ratio[0]) < ratio[0]:
        return shingles[:0], 1
    common = counts[_cell(shingles)]
    first = size - shortest_match(size, ratio) + 1
    most = min(first, size - first + 1)
    reach = first + most - 1
    order = np.argsort(common, kind="stable")[:reach]
    # Candidates expected to share so many: each uses up as many of the occurrences.
    seen = np.cumsum(np.maximum(common[order] - usual, 0))[first - 1:reach]
    matches = np.arange(1, most + 1)
    best = int(np.argmin(seen + VERIFY_COST * seen / matches)) + 1
    return shingles[order[:first + best - 1]], best


def _describe(batches: Iterable[pa.RecordBatch], words: int, ratio: Ratio, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    usual = float(counts.mean())
    for batch in slices(batches):
        sets = shingle_sets(batch.column("text").to_pylist(), words)
        digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        prefixes = [prefix(s, counts, usual, ratio) for s in sets]
        yield pa.record_batch(
            [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()),
             int_lists([p.view(np.int64) for p, _ in prefixes], np.int64), pa.array([m for _, m in prefixes], pa.int32()),
             pa.array([signature(s) if len(p) else None for s, (p, _) in zip(sets, prefixes, strict=True)], pa.binary())],
            ["doc_id", "n", "digest", "prefix", "matches", "signature"],
        )


def _sets(batches: Iterable[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """The set of each row (id, a, part, text); rows of one text come one after another and share the work."""
    for batch in slices(batches):
        texts = batch.column("text").to_pylist()
        new = [not i or texts[i] != texts[i - 1] for i in range(len(texts))]
        sets = [s.tobytes() for s in shingle_sets([t for t, n in zip(texts, new, strict=True) if n], words)]
        packed = [sets[i] for i in np.cumsum(new, dtype=np.int64) - 1]
        yield pa.record_batch(
            [batch.column("a"), batch.column("part"), batch.column("id"), pa.array(packed, pa.binary())], ["a", "part", "id", "shingles"]
        )


def _overlaps(key: tuple, table: pa.Table, ratio: Ratio) -> pa.Table:
    """Intersection, union and difference of the hub's set and each of the group's others.

    A difference lists what the other adds to the hub, then what it lacks, each by hash: the same order for all others. It is null
    for others that are not near (see ``NEAR``).
    """
    hub = key[0].as_py()
    sets = [(i, np.frombuffer(x, "<u8")) for i, x in zip(table.column("id").to_pylist(), table.column("shingles").to_pylist(), strict=True)]
    found: list[tuple] = []
    for own in (s for i, s in sets if i == hub):
        for i, other in sets:
            if i != hub:
                added, lacks = np.setdiff1d(other, own, assume_unique=True), np.setdiff1d(own, other, assume_unique=True)
                both = len(other) - len(added)
                size, total = len(added) + len(lacks), len(own) + len(other)
                near = size * (ratio[1] + ratio[0]) <= NEAR * total * (ratio[1] - ratio[0])
                difference = np.concatenate([added, lacks]).view(np.int64).tolist() if near else None
                found.append((hub, i, both, both + size, difference))
    *columns, differences = list(zip(*found, strict=True)) if found else [[]] * 5
    columns = [*(pa.array(c, pa.int64()) for c in columns), pa.array(differences, pa.list_(pa.int64()))]
    return pa.table(columns, names=["a", "b", "both", "either", "difference"])


def _fit(n: str, m: str, ratio: Ratio) -> Column:
    """Sets of these sizes can reach the threshold."""
    return F.least(n, m) * ratio[1] >= F.greatest(n, m) * ratio[0]


def _small(rows: DataFrame) -> DataFrame:
    """``rows``, written, and marked for broadcast if there are few enough."""
    rows = cut_lineage(rows)
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _sides(pairs: DataFrame, vertices: DataFrame, left: dict[str, str], right: dict[str, str]) -> DataFrame:
    """``pairs`` (a, b) with columns of ``vertices`` for a and for b, named as the dictionaries say."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    involved = vertices.join(_small(ids), "id", "left_semi")
    for end, names in (("a", left), ("b", right)):
        pairs = pairs.join(involved.select(F.col("id").alias(end), *(F.col(c).alias(name) for c, name in names.items())), end)
    return pairs


def _sifted(pairs: DataFrame, vertices: DataFrame, ratio: Ratio, times: int = 1) -> DataFrame:
    """a, b, n of b: those of ``pairs`` that are alike by their signatures (see ``_alike``) and share as many prefix shingles as they must.

    Both prefixes are cut to the number of matches that the shorter-reaching one asks for.
    """
    both = _sides(pairs, vertices, {"signature": "s", "n": "a_n"}, {"signature": "t", "n": "b_n"})
    alike = cut_lineage(both.mapInArrow(lambda b: _alike(b, ratio, times), "a bigint, b bigint").distinct())
    both = _sides(alike, vertices, {"prefix": "p", "matches": "k"}, {"prefix": "q", "matches": "l", "n": "n"})
    needed = F.least("k", "l")
    shared = F.array_intersect(
        F.slice("p", F.lit(1), F.size("p") - F.col("k") + needed), F.slice("q", F.lit(1), F.size("q") - F.col("l") + needed)
    )
    return both.where(F.size(shared) >= needed).select("a", "b", "n").distinct()


def _verified(pairs: DataFrame, rows: DataFrame, words: int, ratio: Ratio) -> DataFrame:
    """a, b, both, either, difference (see ``_overlaps``) for ``pairs`` (a, b, n of b).

    Pairs meet in groups of one ``a`` and a bounded share of its partners.
    """
    parts = pairs.groupBy("a").agg((1 + F.floor(F.sum("n") / GROUP_SHINGLES)).cast("bigint").alias("parts"))
    parts = cut_lineage(parts)
    keyed = pairs.withColumn("_k", F.col("a").bitwiseXOR(F.lit(MIX)))
    others = keyed.join(parts.select(F.col("a").bitwiseXOR(F.lit(MIX)).alias("_k"), "parts"), "_k").select(
        F.col("b").alias("id"), "a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part")
    )
    hubs = parts.select(
        F.col("a").alias("id"), "a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part")
    )
    # One row per role: a document may have any number of them.
    roles = others.unionByName(hubs)
    sets = rows.withColumnRenamed("doc_id", "id").join(_small(roles), "id").mapInArrow(
        lambda b: _sets(b, words), "a bigint, part bigint, id bigint, shingles binary"
    )
    return sets.groupBy("a", "part").applyInArrow(
        lambda key, table: _overlaps(key, table, ratio), "a bigint, b bigint, both bigint, either bigint, difference array<bigint>"
    )


def _needed(size: Column, more: Column, ratio: Ratio) -> Column:
    """Half of ``size`` and of c times ``more``, rounded up; two sets of n and m shingles link if c (n + m) of them differ at most.

    Let x and y differ from their hub h in X and Y. They differ from each other in |X| + |Y| - 2 |X and Y|. If they link and
    x does not link to h, so that |X| > c (n_x + n_h), they share more than (|Y| + c (n_h - n_y)) / 2. In any case they share
    (|X| + |Y| - c (n_x + n_y)) / 2. If X and Y share nothing, links from both to h follow.
    """
    num, den = ratio[1] - ratio[0], ratio[1] + ratio[0]
    return F.greatest(F.ceil((size * den + more * num) / F.lit(2 * den) - 1e-9), F.lit(1))


def _second_match(placed: DataFrame, groups: DataFrame, ratio: Ratio) -> DataFrame:
    """Links (a, b) between documents of one hub that lie in different groups, by their differences from the hub.

    ``placed`` has hub, hub_n, id, n and difference. Documents apart from their hub's group look their whole
    difference up among the first part of the others', long enough to hold one of the matches they need.
    """
    own = placed.join(groups.select(F.col("node").alias("id"), F.col("component").alias("_own")), "id", "left")
    hubs = own.join(groups.select(F.col("node").alias("hub"), F.col("component").alias("_hubs")), "hub", "left")
    known = cut_lineage(hubs.select(
        "hub", "id", "difference", F.size("difference").alias("d"), F.coalesce("_own", "id").alias("group"), "n", "hub_n",
        (F.coalesce("_own", "id") != F.coalesce("_hubs", "hub")).alias("apart"),
    ))
    split = known.where("apart").select("hub").distinct()
    rows = known.withColumn("_k", F.col("hub").bitwiseXOR(F.lit(MIX))).join(
        split.select(F.col("hub").bitwiseXOR(F.lit(MIX)).alias("_k")), "_k", "left_semi"
    ).drop("_k")
    least = _needed(F.col("d"), F.col("hub_n") - F.col("n"), ratio)
    first = F.slice("difference", F.lit(1), (F.col("d") - least + 1).cast("int"))
    index = rows.where(least <= F.col("d")).select(
        "hub", F.col("id").alias("b"), F.col("d").alias("b_d"), F.col("n").alias("b_n"), F.col("group").alias("b_group"),
        F.posexplode(first).alias("b_at", "token"),
    )
    probe = rows.where("apart").select(
        "hub", F.col("id").alias("a"), F.col("d").alias("a_d"), F.col("n").alias("a_n"), F.col("group").alias("a_group"),
        F.posexplode("difference").alias("a_at", "token"),
    )
    asked = _needed(F.col("a_d") + F.col("b_d"), -(F.col("a_n") + F.col("b_n")), ratio)
    # The first shared element leaves room for the others that are needed.
    room = F.least(F.col("a_d") - F.col("a_at"), F.col("b_d") - F.col("b_at"))
    met = probe.join(index, ["hub", "token"]).where((F.col("a_group") != F.col("b_group")) & (room >= asked))
    pairs = cut_lineage(met.select("hub", "a", "b").distinct())
    left = known.select("hub", F.col("id").alias("a"), F.col("difference").alias("p"), F.col("n").alias("a_n"))
    right = known.select("hub", F.col("id").alias("b"), F.col("difference").alias("q"), F.col("n").alias("b_n"))
    both = pairs.join(left, ["hub", "a"]).join(right, ["hub", "b"])
    differ = F.size("p") + F.size("q") - 2 * F.size(F.array_intersect("p", "q"))
    total = F.col("a_n") + F.col("b_n")
    return both.where(differ * (ratio[0] + ratio[1]) <= total * (ratio[1] - ratio[0])).select("a", "b").distinct()


def jaccard_groups(docs: DataFrame, words: int = 5, ratio: Ratio = (80, 100)) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of ``docs`` (doc_id, text).

    Documents link when the Jaccard similarity of their sets of distinct ``words``-word shingles is at least
    ``ratio``; ``component_id`` is the smallest doc_id reachable by links. A-Z count as a-z, words are runs of
    anything but ASCII white space; with fewer words than a shingle the whole sequence is one. A null text,
    or one without words, has an empty set and links with nothing, and so does a row without a doc_id, whose
    component is null. Rows that share a doc_id are one vertex, whatever their texts. Other columns are left out. An empty table
    gives an empty one.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"))
    counts = shingle_counts(rows.select("text"), words)
    described = cut_lineage(rows.mapInArrow(
        lambda b: _describe(b, words, ratio, counts),
        "doc_id bigint, n bigint, digest binary, prefix array<bigint>, matches int, signature binary",
    ))
    usable = described.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    # Equal sets: one vertex, named by the smallest document.
    classes = cut_lineage(usable.groupBy("digest").agg(F.min("doc_id").alias("id")))
    other = usable.select("digest", "doc_id").join(classes, "digest").where("doc_id <> id").select("doc_id", "digest").distinct()
    # A document with several texts: its sets are linked by it, the empty one too.
    repeated = described.where("doc_id is not null").groupBy("doc_id").agg(
        (F.min("digest") < F.max("digest")).alias("_several")
    ).where("_several").select("doc_id")
    repeated = _small(repeated)
    same = usable.select("digest", "doc_id").join(repeated, "doc_id").join(classes, "digest").where("doc_id <> id")
    same = cut_lineage(same.select(F.col("doc_id").alias("a"), F.col("id").alias("b")).distinct())
    vertices = usable.where(F.size("prefix") > 0).join(_small(other), ["doc_id", "digest"], "left_anti").select(
        F.col("doc_id").alias("id"), "n", "prefix", "matches", "signature"
    )
    shortest = F.slice("prefix", F.lit(1), F.size("prefix") - F.col("matches") + 1)
    tokens = vertices.select("id", F.col("n").cast("int").alias("n"), F.explode(shortest).alias("token"))
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    # A shingle goes with its rows once, as it is or mixed.
    mixed, plain = F.col("token").bitwiseXOR(F.lit(MIX)).alias("_k"), F.col("_k").bitwiseXOR(F.lit(MIX)).alias("token")
    shared = cut_lineage(
        tokens.select(mixed, "id", "n").join(often.select(mixed, "members"), "_k").select(plain, "members", "id", "n")
    )
    # The hub of a shingle is the document that shares most: of a text and its edited copies, the text.
    weights = shared.groupBy("id").agg(F.sum("members").alias("weight"))
    weighted = shared.join(weights, "id")
    best = F.max(F.struct("weight", (-F.col("id")).alias("order"), "n")).alias("best")
    hubs = weighted.groupBy("token").agg(best).select(
        mixed, (-F.col("best.order")).alias("hub"), F.col("best.n").alias("hub_n")
    )
    shared = cut_lineage(shared.select(mixed, "members", "id", "n").join(hubs, "_k").select(plain, "members", "id", "n", "hub", "hub_n"))
    near = shared.where("hub <> id")
    pairs = near.where(_fit("n", "hub_n", ratio)).select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    pairs = cut_lineage(_sifted(cut_lineage(pairs), vertices, ratio, NEAR))
    reached = F.col("both") * ratio[1] >= F.col("either") * ratio[0]
    judged = cut_lineage(_verified(pairs, rows, words, ratio))
    links = judged.where(reached).select("a", "b").unionByName(same)
    groups = cut_lineage(components(links))

    # Pairs of different groups that share a shingle, other than with its hub: first those that differ from it by little.
    sizes = shared.select("hub", "hub_n", "id", "n").distinct()
    with_hub = sizes.join(judged.select(F.col("a").alias("hub"), F.col("b").alias("id"), "difference"), ["hub", "id"])
    with_hub = with_hub.where(F.col("difference").isNotNull())
    second = cut_lineage(_second_match(with_hub, groups, ratio))
    links = links.unionByName(second)

    # Then those with a document that keeps no difference from the hub.
    distance = (F.col("either") - F.col("both")) / F.col("either")
    placed = shared.where("members > 2").join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn(
        "group", F.coalesce("component", "id")
    ).drop("component")
    several = placed.groupBy("token").agg(F.min("group").alias("_low"), F.max("group").alias("_high")).where("_low < _high")
    placed = placed.where("hub <> id").withColumn("_k", mixed).join(several.select(mixed), "_k", "left_semi").drop("_k").join(
        judged.select(
            F.col("a").alias("hub"), F.col("b").alias("id"), F.col("difference").isNotNull().alias("near"), distance.alias("distance")
        ), ["hub", "id"], "left",
    ).withColumn("near", F.coalesce("near", F.lit(False)))
    placed = cut_lineage(placed)
    x, y = placed.where("not near").alias("x"), placed.alias("y")
    # Two of them are met once.
    once = F.col("y.near") | (F.col("x.id") < F.col("y.id"))
    slack = 1e-9 + (ratio[1] - ratio[0]) / ratio[1]
    apart = F.coalesce(F.abs(F.col("x.distance") - F.col("y.distance")) > slack, F.lit(False))
    met = x.join(y, F.col("x.token") == F.col("y.token")).where(
        once & ~apart & (F.col("x.group") != F.col("y.group")) & _fit("x.n", "y.n", ratio)
    )
    rest = met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    rest = cut_lineage(_sifted(cut_lineage(rest), vertices, ratio))
    if not rest.isEmpty():
        links = links.unionByName(_verified(rest, rows, words, ratio).where(reached).select("a", "b"))
    groups = cut_lineage(components(links))

    found = classes.join(groups.withColumnRenamed("node", "id"), "id", "left").select(
        "digest", F.coalesce("component", "id").alias("component")
    )
    keyed = described.withColumn("digest", F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("digest")))
    own = _small(repeated.join(groups, F.col("doc_id") == F.col("node")).select("doc_id", F.col("component").alias("_own")))
    return keyed.select("doc_id", "n", "digest").join(found, "digest", "left").join(own, "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "_own", "doc_id").alias("component_id")
    )
