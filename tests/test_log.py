"""Cubes, sketches, listing differences and JSON settings on nulls, repeats, hot groups and empty tables."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from cliploom.operators import runs, settings, sketches
from cliploom.sources import changes

LOG = "a string, b int, v double, u string"


def log_rows():
    rnd = random.Random(2)
    rows = [(rnd.choice(["hot"] * 8 + ["x", None]), rnd.choice([1, 2, None]), rnd.choice([None, 1.0, 2.5]), rnd.choice([None, "p", "q", "r"])) for _ in range(200)]
    return rows + [("hot", 1, 1.0, "p")] * 50


def plain_cube(rows, sets):
    out = {}
    for kept in sets:
        gid = sum(2 ** (1 - i) for i, c in enumerate("ab") if c not in kept)
        groups = defaultdict(list)
        for a, b, v, u in rows:
            groups[a if "a" in kept else None, b if "b" in kept else None].append((v, u))
        for (a, b), members in groups.items():
            values = [v for v, _ in members if v is not None]
            out[a, b, gid] = (len(members), sum(values) if values else None, len({u for _, u in members if u}), len(set(values)))
    return out


@pytest.mark.parametrize("sets", [None, [["a", "b"], ["a"], []], [["b"]]])
def test_cube(spark, sets):
    rows = log_rows()
    got = runs.cube(spark.createDataFrame(rows, LOG).repartition(5), ["a", "b"], ["v"], ["u", "v"], sets).collect()
    found = {(r.a, r.b, r.grouping_id): (r.n, r.sum_v, r.distinct_u, r.distinct_v) for r in got}
    every = [list(c) for k in range(3) for c in combinations("ab", k)]
    assert found == plain_cube(rows, every if sets is None else sets) and len(got) == len(found)


def test_rollup_sets_and_no_rows(spark):
    assert runs.rollup_sets(["a", "b"]) == [["a", "b"], ["a"], []]
    none = runs.cube(spark.createDataFrame([], LOG), ["a", "b"], ["v"], ["u"], [["a"]]).collect()
    assert none == []


def test_sketches_merge_in_any_order(spark):
    rows = spark.range(60_000).select(
        (F.col("id") % 30).alias("day"), F.when(F.col("id") % 50 != 0, F.col("id") % 9_000).alias("key"), (F.col("id") * 7 % 10_007).cast("double").alias("v")
    )
    daily = sketches.sketched(rows, ["day"], "key", "v").checkpoint()
    weekly = sketches.merged(daily.withColumn("week", F.floor(F.col("day") / 7)), ["week"])
    exact = rows.where("key IS NOT NULL").select("key").distinct().count()
    told = [sketches.answers(sketches.merged(s), [0.0, 0.25, 0.5, 1.0]).first() for s in (daily, daily.orderBy(F.desc("day")), weekly)]
    for r in told:  # estimates depend on the order of merging, within the bound
        assert r.n == 60_000 and abs(r.distinct - exact) <= sketches.DISTINCT_ERROR * exact
        for rank, value in zip((0.25, 0.5), r.quantiles[1:3], strict=True):
            assert abs(rows.where(F.col("v") <= value).count() / 60_000 - rank) <= sketches.RANK_ERROR
        assert (r.quantiles[0], r.quantiles[3]) == (0.0, 10_006.0)


def test_sketches_of_nulls_and_nothing(spark):
    rows = spark.createDataFrame([(1, None, None), (1, None, None), (2, "k", 3.0)], "day int, key string, v double")
    told = {r.day: (r.n, r.distinct, r.quantiles) for r in sketches.answers(sketches.sketched(rows, ["day"], "key", "v")).collect()}
    assert told == {1: (2, 0, None), 2: (1, 1, [3.0])}
    assert sketches.sketched(rows.limit(0), ["day"], "key", "v").collect() == []


LIST = "path string, size int, content string"


def test_differences_count_rows(spark):
    old = [("a", 1)] * 5 + [(None, None)] * 2 + [("b", None), ("hot", 1)] + [("hot", 2)] * 300
    new = [("a", 1)] * 2 + [(None, None)] * 3 + [("b", 2), ("c", 3), ("c", 3)] + [("hot", 2)] * 299
    left, right = (spark.createDataFrame([(*r, "x") for r in rows], LIST).repartition(4) for rows in (old, new))
    for fn, a, b in ((changes.minus, old, new), (changes.minus, new, old), (changes.common, old, new)):
        x, y = (left, right) if a is old else (right, left)
        want = Counter(a) - Counter(b) if fn is changes.minus else Counter(a) & Counter(b)
        found = fn(x, y, ["path", "size"])
        assert {(r.path, r.size): r.times for r in found.collect()} == dict(want)
        assert Counter((r.path, r.size) for r in changes.repeated(found).collect()) == want
    assert changes.minus(left, left, ["path"]).count() == 0 == changes.common(left, right.limit(0), ["path"]).count()
    plan = changes.minus(left, right, ["path", "size"])._jdf.queryExecution().optimizedPlan().toString()
    assert "content#" not in plan.split("LogicalRDD")[0] and "Aggregate" in plan


def test_changes_of_paths(spark):
    old = [("same", 1), ("same", 2), ("grown", 1), ("lost", 7), ("from", 9), ("twin1", 5), ("twin2", 5), ("times", 1), (None, 4)]
    new = [("same", 2), ("same", 1), ("grown", 2), ("came", 8), ("to", 9), ("twin3", 5), ("times", 1), ("times", 1), (None, 4)]
    left, right = (spark.createDataFrame([(*r, "x") for r in rows], LIST).repartition(3) for rows in (old, new))
    got = {r.path: (r.change, r.other) for r in changes.changes(left, right, "path", ["size"]).collect()}
    assert got == {
        "same": ("same", None), "grown": ("changed", None), "lost": ("gone", None), "from": ("renamed", "to"), "twin1": ("gone", None),
        "twin2": ("gone", None), "twin3": ("added", None), "came": ("added", None), "times": ("changed", None), None: ("same", None),
    }
    assert {r.change for r in changes.changes(left, left.limit(0), "path", ["size"]).collect()} == {"gone"}
    assert changes.changes(left.limit(0), left.limit(0), "path", ["size"]).collect() == []


def test_settings(spark):
    texts = ['{"a": 1, "b": {"c": "x"}}', '{"a": "2"}', '{"a": "no", "b": 3}', '{"a": null}', "{", "", None, "[1]", "3", "null", '{}', '{"a": 1.5}']
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    got = {r.i: (r.json_state, r.a, r.c) for r in settings.shredded(rows, "t", {"a": ("$.a", "int"), "c": ("$.b.c", "string")}).collect()}
    assert [got[i][0] for i in range(12)] == ["object"] * 4 + ["malformed"] * 2 + ["absent"] + ["other"] * 3 + ["object"] * 2
    assert got[0][1:] == (1, "x") and got[1][1:] == (2, None) and got[2][1:] == (None, None) == got[3][1:] and got[10][1:] == (None, None)
    keys = {r.key: (r.n, r.n_numbers, r.total) for r in settings.per_key(rows, [], "t").collect()}
    assert keys == {"a": (5, 3, 4.5), "b": (2, 1, 3.0)}
    assert settings.per_key(rows.limit(0), ["i"], "t").collect() == []
