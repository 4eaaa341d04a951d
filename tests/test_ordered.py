"""Operators over order - as-of and interval joins, gaps, suffix scans - against loops."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rollscore.operators import gaps, joins, position, scan
from rollscore.plans import ordered
from test_position import SCHEMA, SEGMENTS, STEPS, score_rows


@pytest.fixture(autouse=True)
def many_pieces(spark):
    """Small tables would otherwise be one piece."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plain(frame):
    return Counter(map(tuple, frame.collect()))


# --- as-of --------------------------------------------------------------------------------------

LEFT, RIGHT = "k int, t int, name string", "key int, at int, tie int, v string"


def by_looking_back(left, right, allow_equal, within):
    found = Counter()
    for k, t, name in left:
        earlier = [
            (at, tie if tie is not None else -1, v) for key, at, tie, v in right
            if None not in (k, t, key, at) and key == k and (at < t or allow_equal and at == t)
        ]
        best = max(earlier, default=None)
        if best and within is not None and best[0] < t - within:
            best = None
        found[k, t, name, *(best[::2] if best else (None, None))] += 1
    return found


def as_of_rows(shape):
    rng = random.Random(shape)
    keys = {"many": 40, "hot": 1, "odd": 3}[shape]
    left = [(rng.randrange(keys), rng.randrange(300), f"l{i % 50}") for i in range(400)]
    right = [(rng.randrange(keys), rng.randrange(300), rng.randrange(3), f"r{i}") for i in range(150 if shape != "hot" else 12)]
    if shape == "odd":
        left += [(None, 5, "a"), (1, None, "b"), (None, None, "c"), (99, 5, "d"), (1, -50, "e"), (1, 10, "twice"), (1, 10, "twice")]
        right += [(None, 1, 1, "x"), (1, None, 1, "y"), (2, 10, None, "z"), (77, 1, 1, "w")]
    return left, right


@pytest.mark.parametrize("shape", ["many", "hot", "odd"])
@pytest.mark.parametrize("allow_equal, within", [(True, None), (False, None), (True, 7)])
def test_as_of(spark, shape, allow_equal, within):
    left, right = as_of_rows(shape)
    found = joins.as_of(
        spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT).withColumnRenamed("key", "k2").withColumnRenamed("k2", "k"),
        ["k"], "t", "at", ["at", "v"], ["tie"], None if within is None else F.lit(within), allow_equal,
    )
    assert found.columns == ["k", "t", "name", "at", "v"]
    expected = by_looking_back(left, right, allow_equal, within)
    assert plain(found) == expected
    inner = joins.as_of(
        spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT).withColumnRenamed("key", "k"),
        ["k"], "t", "at", ["at", "v"], ["tie"], None if within is None else F.lit(within), allow_equal, "inner",
    )
    assert plain(inner) == Counter({row: n for row, n in expected.items() if row[3] is not None})


def test_as_of_nothing(spark):
    left, right = spark.createDataFrame([], LEFT), spark.createDataFrame([(1, 1, 1, "x")], RIGHT.replace("key", "k"))
    assert joins.as_of(left, right, ["k"], "t", "at", ["v"]).count() == 0
    one = spark.createDataFrame([(1, 5, "a")], LEFT)
    assert plain(joins.as_of(one, right.limit(0), ["k"], "t", "at", ["v"])) == {(1, 5, "a", None): 1}
    with pytest.raises(ValueError, match="both sides"):
        joins.as_of(one, right.withColumnRenamed("v", "name"), ["k"], "t", "at", ["name"])
    with pytest.raises(ValueError, match="Unknown kind"):
        joins.as_of(one, right, ["k"], "t", "at", ["v"], how="outer")


def test_a_hot_key_is_cut(spark):
    """One key over many pieces: most left rows find their partner in an earlier piece."""
    left = spark.range(20_000).select(F.lit(1).alias("k"), F.col("id").alias("t"))
    right = spark.createDataFrame([(1, 0, "first"), (1, 15_000, "second")], "k int, at long, v string")
    found = joins.as_of(left, right, ["k"], "t", "at", ["v"])
    assert {r.v: r["count"] for r in found.groupBy("v").count().collect()} == {"first": 15_000, "second": 5_000}


# --- intervals ----------------------------------------------------------------------------------

POINTS, INTERVALS = "k int, p long, name string", "k int, low long, high long, label string"


def by_all_pairs(points, intervals, low_open, high_open, keyed):
    found = Counter()
    for k, p, name in points:
        for key, low, high, label in intervals:
            if p is None or keyed and (k is None or k != key):
                continue
            above = low is None or (p > low if low_open else p >= low)
            below = high is None or (p < high if high_open else p <= high)
            if above and below:
                found[k, p, name, low, high, label] += 1
    return found


@pytest.mark.parametrize("low_open, high_open", [(True, False), (False, False), (False, True), (True, True)])
@pytest.mark.parametrize("keyed", [True, False])
def test_interval_join(spark, low_open, high_open, keyed):
    rng = random.Random(5)
    points = [(rng.choice([1, 2, None]), rng.choice([rng.randrange(-40, 400), rng.randrange(10**6)]), f"p{i}") for i in range(250)]
    points += [(1, None, "null"), (1, 7, "twice"), (1, 7, "twice"), (2, 2**40, "far up"), (2, -(2**40), "far down")]
    intervals = []
    for i in range(60):
        low = rng.randrange(-50, 400)
        intervals.append((rng.choice([1, 2, 3, None]), low, low + rng.choice([0, 1, 2, 15, 16, 17, 64, 5000, 10**6, -3]), f"i{i}"))
    intervals += [(1, None, 50, "down"), (2, 50, None, "up"), (1, None, None, "all"), (1, 6, 8, "same"), (1, 6, 8, "same")]
    left, right = spark.createDataFrame(points, POINTS), spark.createDataFrame(intervals, INTERVALS)
    on = ["k"] if keyed else []
    right = right if keyed else right.withColumnRenamed("k", "k2")
    found = joins.interval_join(left, right, "p", "low", "high", on, low_open, high_open)
    columns = [*POINTS.split(), "low", "high", "label"][::2]
    got = Counter((r.k, r.p, r.name, r.low, r.high, r.label) for r in found.collect())
    assert got == by_all_pairs(points, intervals, low_open, high_open, keyed), columns
    outer = joins.interval_join(left, right, "p", "low", "high", on, low_open, high_open, "left")
    alone = Counter(r.name for r in outer.where("label is null").collect())
    met = {row[2] for row in got}
    assert alone == Counter(name for _, _, name in points if name not in met)


def test_interval_join_is_by_equality(spark):
    points = spark.range(1000).select(F.col("id").alias("p"))
    intervals = spark.range(0, 1000, 10).select((F.col("id") - 1).alias("low"), (F.col("id") + 9).alias("high"))
    found = joins.interval_join(points, intervals, "p", "low", "high")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert found.count() == 1000
    assert joins.interval_join(points, intervals.limit(0), "p", "low", "high").count() == 0
    assert joins.interval_join(points.limit(0), intervals, "p", "low", "high").count() == 0


# --- gaps ---------------------------------------------------------------------------------------


def by_runs(rows, sizes):
    found = []
    for run in {r for r, _ in rows} | set(sizes):
        size = sizes.get(run) or 0
        counts = Counter(i for r, i in rows if r == run and i is not None)
        sets = {
            "missing": [i for i in range(size) if not counts[i]],
            "repeated": sorted(i for i, n in counts.items() if n > 1 and 0 <= i < size),
            "outside": sorted(i for i in counts if not 0 <= i < size),
        }
        for kind, indices in sets.items():
            for i in indices:
                if found and found[-1][:2] == [run, kind] and found[-1][3] == i - 1:
                    found[-1][3] = i
                else:
                    found.append([run, kind, i, i])
    return Counter((run, kind, a, b, b - a + 1) for run, kind, a, b in found)


def test_gaps(spark):
    rng = random.Random(9)
    rows = [("hot", i) for i in range(3000) if not 500 <= i < 1700 and i % 97] + [("hot", i) for i in range(1990, 2300)]
    rows += [("random", rng.randrange(-5, 60)) for _ in range(70)] + [("whole", i) for i in range(40)]
    rows += [("unknown", 3), ("unknown", 4), ("nosize", 0), (None, 1), ("hot", None), ("late", 99)]
    sizes = {"hot": 3100, "random": 50, "whole": 40, "empty": 7, "nothing": 0, "nosize": None, None: 2, "late": 100}
    frame = spark.createDataFrame(rows, "run string, example_index int")
    table = spark.createDataFrame(list(sizes.items()), "run string, dataset_size int")
    assert plain(gaps.index_gaps(frame, table)) == by_runs(rows, sizes)
    assert gaps.index_gaps(frame.limit(0), table.limit(0)).count() == 0


# --- scans --------------------------------------------------------------------------------------


@pytest.mark.parametrize("spread", [1.0, 3000.0])
def test_later_log_sums(spark, spread):
    rng = random.Random(2)
    rows = [(k, rng.randrange(400), rng.uniform(-1, 1) * spread) for k in (1, 1, 1, 2) for _ in range(900)]
    rows += [(3, 5, 1.0), (3, 5, -math.inf), (3, 4, -math.inf), (3, 3, None), (3, 2, 1.0), (None, 1, 2.0), (None, 2, 3.0), (1, None, 5.0)]
    rows += [(4, s, -math.inf) for s in range(3)]
    frame = spark.createDataFrame(rows, "k int, step int, v double")
    found = {(r.k, r.step): (r.n, r.others) for r in scan.later_log_sums(frame, ["k"], "step", F.col("v")).collect()}
    assert set(found) == {(k, s) for k, s, _ in rows if s is not None}
    for (k, step), (n, others) in found.items():
        assert n == sum(r[:2] == (k, step) for r in rows)
        later = [v for key, s, v in rows if key == k and s is not None and s > step]
        if None in later:
            assert others is None
        elif all(v == -math.inf for v in later):
            assert others == -math.inf
        else:
            top = max(later)
            assert others == pytest.approx(top + math.log(sum(math.exp(v - top) for v in later)), rel=1e-12, abs=1e-9)


def test_scan_over_batches_and_keys(monkeypatch):
    rng = np.random.default_rng(1)
    keys, values = np.sort(rng.integers(0, 9, 500)), rng.normal(size=500)
    batch = pa.record_batch({"_key": keys, "log_sum": values})
    expected = np.concatenate([np.logaddexp.accumulate(values[keys == k]) for k in np.unique(keys)])
    for size in (1, 7, 500):
        parts = [batch.slice(i, size) for i in range(0, 500, size)]
        got = np.concatenate([b.column("_so_far").to_numpy() for b in scan._scanned(parts)])
        assert np.allclose(got, expected, rtol=1e-13)


@pytest.mark.parametrize("scope", position.SCOPES)
@pytest.mark.parametrize("tau", [1.0, 0.001])
def test_scan_equals_arrays(spark, scope, tau):
    rows = score_rows(60, 3.0) + [(9, 0, p, 3 + p % 2, 1.0, -math.inf) for p in range(4)]
    frame = spark.createDataFrame(rows, SCHEMA)
    logps = [
        {(r.seq_id, r.segment, r.pos): r.pos_logp for r in position.position_logps(frame, STEPS, SEGMENTS, "softmax", scope, tau, scan=s).collect()}
        for s in (False, True)
    ]
    assert logps[0].keys() == logps[1].keys() and len(logps[0]) == len(rows)
    for key, value in logps[0].items():
        assert logps[1][key] == pytest.approx(value, rel=1e-12, abs=1e-9)


def test_pieces_keep_their_order(spark):
    frame = spark.range(5000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    placed = ordered.pieces(frame, ["k"], [F.col("v")])
    spans = placed.groupBy(ordered.PIECE).agg(F.min(F.struct("k", "v")).alias("a"), F.max(F.struct("k", "v")).alias("b")).orderBy(ordered.PIECE)
    ends = [(tuple(r.a), tuple(r.b)) for r in spans.collect()]
    assert all(x[1] < y[0] for x, y in zip(ends, ends[1:])) and len(ends) > 1


@pytest.mark.parametrize("scope", ["segment", "position"])
def test_only_longer_keys_are_scanned_over_pieces(spark, monkeypatch, scope):
    draw, odd = random.Random(8), [None, float("nan"), float("-inf"), 0.5]
    rows = [
        (seq, segment, pos if pos % 9 else None, draw.randrange(-1, 16), draw.choice([*odd, draw.uniform(-2, 2)]),
         draw.choice([*odd[-((seq or 0) % 3 + 1):], *(draw.uniform(-800, 800) for _ in range(30))]))
        for seq in (None, 1, 2, 3, 4, 5) for segment in range(4) for pos in range(1, 40 if seq == 4 else 8)
    ]
    frame = spark.createDataFrame(rows, "seq_id int, segment int, pos int, unmask_step int, own_score double, confidence double")
    seen = []
    monkeypatch.setattr(position, "scanned_logsumexp", lambda scores, *rest, f=position.scanned_logsumexp: seen.append(scores) or f(scores, *rest))

    def values(table):
        return sorted(repr((*r[:6], r.pos_logp if r.pos_logp is None else round(r.pos_logp, 9) + 0.0)) for r in table.collect())

    found = position.scan_logps(frame, 16, 4, scope, 0.01, chunk=64)
    assert values(found) == values(position.softmax_logps(frame, 16, 4, scope, 0.01))
    assert {r.seq_id for r in seen[0].select("seq_id").distinct().collect()} <= {None, *(r[0] for r in rows if r[2] is None)}
    position.scan_logps(frame.where("pos is not null"), 16, 4, scope, 0.01, chunk=16)
    assert {r.seq_id for r in seen[1].select("seq_id").distinct().collect()} == {None, 4}
    assert values(position.scan_logps(frame, 16, 4, scope, 0.01, chunk=4)) == values(found)
