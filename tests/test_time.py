"""Windows, sessions, as-of joins and range joins on nulls, ties, repeats, hot keys and empty tables."""

from __future__ import annotations

import datetime as dt
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from cliploom.operators import temporal
from cliploom.streaming import items, windows

START = dt.datetime(2024, 1, 1)
EVENTS = "key string, ts timestamp, value double"


def at(seconds):
    return None if seconds is None else START + dt.timedelta(seconds=seconds)


def events(spark, rows):
    return spark.createDataFrame([(k, at(s), v) for k, s, v in rows], EVENTS).repartition(5)


def plain_sessions(rows, gap):
    found = []
    for key in {k for k, _, _ in rows}:
        times = sorted((s, v) for k, s, v in rows if k == key and s is not None)
        for s, v in times:
            if found and found[-1][0] == key and s - found[-1][2] <= gap:
                found[-1][2:] = [s, found[-1][3] + 1, found[-1][4] + v]
            else:
                found.append([key, s, s, 1, v])
    return sorted((str(k), at(a), at(b), n, round(t, 6)) for k, a, b, n, t in found)


def got_sessions(found):
    return sorted((str(r.key), r.session_start, r.session_end, r.n, round(r.total, 6)) for r in found.collect())


ODD = [("a", 0, 1.0), ("a", 10, 1.0), ("a", 20.000001, 1.0), ("a", 20.000001, 2.0), (None, 5, 1.0), (None, 16, 1.0), ("b", None, 1.0), ("c", -3, 1.0)]


@pytest.mark.parametrize("split", [7, 60, 86_400])
def test_sessions_do_not_depend_on_the_split(spark, split):
    """A key with most rows, sessions over many spans, gaps of exactly the limit, and one of them a microsecond more."""
    rnd = random.Random(split)
    rows = ODD + [("hot", t, float(t % 7)) for t in sorted(rnd.choices(range(2_000), k=400))] + [("hot", 100, 1.0)] * 5
    rows += [("x", 3 * i, 1.0) for i in range(100)] + [("y", 11 * i, 1.0) for i in range(20)]
    found = windows.sessions(events(spark, rows), "key", "ts", 10, "value", split_seconds=split)
    assert got_sessions(found) == plain_sessions(rows, 10)


def test_sessions_of_nothing(spark):
    assert windows.sessions(events(spark, []), "key", "ts", 10, "value").collect() == []
    assert windows.sessions(events(spark, [("a", None, 1.0)]), "key", "ts", 10).collect() == []


def test_streamed_sessions_and_windows_survive_restarts(spark, tmp_path):
    rows = [("a", 0, 1.0), ("a", 8, 1.0), ("a", 30, 1.0), (None, 4, 2.0), ("b", None, 1.0)]
    later = [("a", 38, 1.0), ("a", 47, 1.0), ("b", 60, 1.0)]
    source = str(tmp_path / "in")
    steps = {
        "sessions": lambda r: windows.streamed_sessions(r, "key", "ts", 10, "value"),
        "windows": lambda r: windows.windowed(r, "ts", "20 seconds", by=["key"], value="value", delay="5 seconds"),
    }

    def run(name):
        stream = items.stream_table(spark, source, EVENTS)
        items.run_available(stream, str(tmp_path / name), str(tmp_path / f"{name}-state"), steps[name])
        return spark.read.parquet(str(tmp_path / name))

    late = [("a", 1, 1.0), ("c", 59, 1.0)]
    closing = windows.closing_row(events(spark, rows), "ts", F.lit(at(100_000)))
    for part in (events(spark, rows), events(spark, later), events(spark, late), closing):
        part.write.mode("append").parquet(source)
        for name in (*steps, *steps):  # the second time there is nothing to do
            run(name)
    found = {(r.key, r.window_start): (r.n, r.total) for r in run("windows").collect()}
    counted = {("a", 0): (2, 2.0), (None, 0): (1, 2.0), ("a", 20): (2, 2.0), ("a", 40): (1, 1.0), ("b", 60): (1, 1.0), ("c", 40): (1, 1.0)}
    assert found == {(k, at(s)): v for (k, s), v in counted.items()}
    arrived = windows.windowed(events(spark, [*rows, *later, *late]), "ts", "20 seconds", by=["key"])
    told = windows.late_rows(arrived, run("windows").drop("window_end"), ["window_start", "key"]).collect()
    assert {(r.key, r.window_start): r.late for r in told if r.late} == {("a", at(0)): 1}
    assert sum(r.n + r.late for r in told) == 9
    # The late row of "a" at 1 has passed; that of "c" at 59 has not, as no row was later than 60.
    in_time = [r for r in [*rows, *later, *late] if r != ("a", 1, 1.0)]
    assert got_sessions(run("sessions")) == [r for r in plain_sessions(in_time, 10)]


def test_sliding_windows_count_a_row_in_each(spark):
    found = windows.windowed(events(spark, [("a", 65, 2.0)]), "ts", "60 seconds", "20 seconds").collect()
    assert sorted((r.window_start, r.window_end, r.n) for r in found) == [(at(s), at(s + 60), 1) for s in (20, 40, 60)]


# --- as-of -----------------------------------------------------------------------


def plain_as_of(left, right):
    out = []
    for key, time, i in left:
        fits = [(t, -1 if n is None else n, n, v) for k, t, n, v in right if None not in (k, t, key, time) and k == key and t <= time]
        out.append((key, time, i, *(max(fits, key=lambda f: f[:2])[2:] if fits else (None, None))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [0, 1])
def test_as_of_join(spark, seed):
    """Ties on both sides, nulls everywhere, repeated rows, and a key with nearly all rows."""
    rnd = random.Random(seed)
    key = lambda: rnd.choice(["hot"] * 12 + ["a", "b", None])
    time = lambda: rnd.choice([None, *range(40)])
    left = [(key(), time(), i) for i in range(300)] + [("hot", 7, 1)] * 30 + [("never", 5, 2)]
    right = [(key(), time(), rnd.choice([None, *range(200)]), None) for _ in range(60)]
    right = [(k, t, n, None if n is None or n % 5 == 0 else f"v{n}") for k, t, n, _ in right] + [("a", 100, 1, "later")]
    ours = spark.createDataFrame(left, "key string, time int, i int").repartition(6)
    theirs = spark.createDataFrame(right, "key string, time int, n int, v string").repartition(3)
    got = temporal.as_of_join(ours, theirs, ["key"], "time", ["n", "v"], ["n"])
    assert got.columns == ["key", "time", "i", "n", "v"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_as_of(left, right)
    nothing = temporal.as_of_join(ours, theirs.limit(0), ["key"], "time", ["n"]).collect()
    assert len(nothing) == len(left) and {r.n for r in nothing} == {None}
    assert temporal.as_of_join(ours.limit(0), theirs, ["key"], "time", ["n"]).collect() == []
    with pytest.raises(ValueError, match="both sides"):
        temporal.as_of_join(ours, theirs, ["key"], "time", ["time"])


def test_no_task_holds_a_hot_key(spark):
    rows = spark.range(20_000).select(F.lit(1).alias("key"), F.col("id").alias("time"))
    setting = "spark.sql.adaptive.coalescePartitions.enabled"  # would put so few rows together
    try:
        spark.conf.set(setting, "false")
        pieces = temporal.Pieces(rows, ["key"], ["time"])
    finally:
        spark.conf.set(setting, "true")
    sizes = [r["count"] for r in pieces.rows.groupBy("__piece").count().collect()]
    assert len(sizes) > 4 and max(sizes) < 6_000


# --- ranges ------------------------------------------------------------------------


def overlaps(a, b):
    """[from, to) ranges; None is open; a point is (x, x, True)."""

    def before(x, y):
        start, end = x[0], y[1]
        return start is None or end is None or (start <= end if y[2] else start < end)

    def real(x):
        return (x[0] is not None) if x[2] else (x[0] is None or x[1] is None or x[0] < x[1])

    fine = not any(isinstance(v, float) and math.isnan(v) for v in (*a[:2], *b[:2]))
    return fine and real(a) and real(b) and before(a, b) and before(b, a)


def random_ranges(rnd, n, kind):
    out = []
    for _ in range(n):
        start = rnd.choice([None, kind(rnd.randint(-50, 50)), kind(rnd.uniform(-1e6, 1e6)) if rnd.random() < 0.1 else kind(rnd.randint(-50, 50))])
        length = rnd.choice([0, 1, 2, 3, 7, 64, 100_000, -2])
        out.append((start, None if start is None or rnd.random() < 0.1 else start + kind(length)))
    return out


@pytest.mark.parametrize("kind", [int, float])
@pytest.mark.parametrize("point", [True, False])
def test_range_join(spark, kind, point):
    rnd = random.Random(int(point) * 2 + (kind is int))
    ours, theirs = random_ranges(rnd, 150, kind), random_ranges(rnd, 80, kind)
    if kind is float:
        ours += [(float("nan"), 1.0), (float("-inf"), float("inf")), (0.25, 0.250001), (1e200, None)]
        theirs += [(0.0, float("nan")), (float("-inf"), 0.0), (0.2500005, 0.25001)]
    name = "bigint" if kind is int else "double"
    left = spark.createDataFrame([(i, *r) for i, r in enumerate(ours)], f"i int, a {name}, b {name}").repartition(4)
    right = spark.createDataFrame([(j, *r) for j, r in enumerate(theirs)], f"j int, c {name}, d {name}")
    got = temporal.range_join(left, right, ("a", "a" if point else "b"), ("c", "d"))
    mine = [(a, a if point else b, point) for a, b in ours]
    want = {(i, j) for i, x in enumerate(mine) for j, y in enumerate(theirs) if overlaps(x, (*y, False))}
    rows = [(r.i, r.j) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_range_join_with_keys_repeats_and_nothing(spark):
    left = spark.createDataFrame([("k", 1, 5), ("k", 1, 5), (None, 1, 5), ("m", 1, 5)], "key string, a int, b int")
    right = spark.createDataFrame([("k", 4, 9), ("k", 5, 9), (None, 4, 9), ("k", None, None)], "key string, c int, d int")
    got = temporal.range_join(left, right, ("a", "b"), ("c", "d"), ["key"])
    assert sorted(map(str, got.collect())) == sorted(map(str, [*got.where("c = 4").collect(), *got.where("c IS NULL").collect()]))
    assert got.columns == ["key", "a", "b", "c", "d"] and got.count() == 4
    for a, b in ((left.limit(0), right), (left, right.limit(0)), (left.limit(0), right.limit(0))):
        assert temporal.range_join(a, b, ("a", "b"), ("c", "d"), ["key"]).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|NestedLoop", plan)


def test_coarse_ranges_do_not_pair_up_fine_ones(spark):
    """One range over everything must not bring all short ranges of both sides together."""
    left = spark.range(3_000).select(F.col("id").alias("i"), F.col("id").cast("double").alias("a"), (F.col("id") + 0.5).alias("b"))
    right = spark.range(3_000).select(F.col("id").alias("j"), (F.col("id") + 0.25).alias("c"), (F.col("id") + 0.75).alias("d"))
    wide = spark.createDataFrame([(-1, 0.0, 3000.0)], "j bigint, c double, d double")
    got = temporal.range_join(left, right.union(wide), ("a", "b"), ("c", "d"))
    assert got.count() == 6_000
    binned = temporal._levelled(temporal._bounded(left, ("a", "b"), "l", []), "l", 0.0, 3000.0)
    assert [r[0] for r in binned.select("__l_level").distinct().collect()] == [-1]


# --- running totals, frames of time, ranks -------------------------------------------

LOG = "by string, time int, v double"


def log_rows(seed):
    rnd = random.Random(seed)
    rows = [(rnd.choice(["hot"] * 9 + ["b", None]), rnd.choice([None, *range(60)]), rnd.choice([None, *range(8)])) for _ in range(300)]
    return [(b, t, None if v is None else float(v)) for b, t, v in rows] + [("hot", 7, 1.0)] * 40 + [("only", 1, None)]


@pytest.mark.parametrize("seed", [0, 1])
def test_running_totals(spark, seed):
    rows = [(b, i, v) for i, (b, _, v) in enumerate(log_rows(seed))]  # a time each: the order is total
    got = temporal.running(spark.createDataFrame(rows, LOG).repartition(6), ["by"], ["time"], ["v"], ["v"], ["v"]).collect()
    seen, want = {}, []
    for b, t, v in rows:
        past = seen.setdefault(b, [])
        past.append(v)
        known = [x for x in past if x is not None]
        want.append((b, t, v, len(past), *((sum(known), min(known), max(known)) if known else (None,) * 3)))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("reach", [0, 5])
def test_moving_average(spark, reach):
    rows = log_rows(3)
    got = temporal.moving_average(spark.createDataFrame(rows, LOG).repartition(6), ["by"], "time", "v", reach).collect()
    want = []
    for b, t, v in rows:
        frame = [x for k, s, x in rows if k == b and None not in (s, t) and t - reach <= s <= t]
        known = [x for x in frame if x is not None]
        want.append((b, t, v, None if t is None else len(frame), round(sum(known) / len(known), 9) if known else None))
    assert sorted([(*r[:4], None if r[4] is None else round(r[4], 9)) for r in map(tuple, got)], key=repr) == sorted(want, key=repr)


def test_ranks(spark):
    rows = log_rows(4)
    got = temporal.ranked(spark.createDataFrame(rows, LOG).repartition(6), ["by"], "v").collect()
    low = lambda v: (v is not None, v or 0)
    want = [(b, t, v, 1 + sum(low(x) < low(v) for k, _, x in rows if k == b)) for b, t, v in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_nothing_in_order(spark):
    none = spark.createDataFrame([], LOG)
    assert temporal.running(none, ["by"], ["time"], ["v"]).collect() == []
    assert temporal.moving_average(none, ["by"], "time", "v", 3).collect() == [] == temporal.ranked(none, ["by"], "v").collect()
