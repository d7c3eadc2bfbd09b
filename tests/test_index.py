from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cliploom.operators.index import dense_index


def _expected(rows, by, order):
    counts, out = {}, {}
    for row in sorted(rows, key=lambda r: tuple((r[c] is not None, r[c]) for c in (*by, *order))):
        group = tuple(row[c] for c in by)
        out[row["id"]] = counts.get(group, 0)
        counts[group] = out[row["id"]] + 1
    return out


@pytest.mark.parametrize("by", [(), ("g",), ("g", "h")])
@pytest.mark.parametrize("parts", [1, 5])
@pytest.mark.parametrize("unique", [True, False])
def test_equals_brute_force(spark, by, parts, unique):
    rnd = random.Random(3)
    # A third of the rows share one group and one sort value; some groups are null.
    rows = [
        {"id": i, "g": "hot" if i % 3 == 0 else rnd.choice([None, *"abcdefgh"]), "h": rnd.randrange(2),
         "t": 7 if i % 3 == 0 else rnd.randrange(50)}
        for i in range(3000)
    ]
    df = spark.createDataFrame(rows, "id bigint, g string, h int, t int").repartition(parts)
    got = {r.id: r.idx for r in dense_index(df, ["t", "id"], by=by, unique=unique).collect()}
    assert got == _expected(rows, by, ("t", "id"))


def test_without_broadcast(spark):
    """More groups than a broadcast may hold: the shifts join by shuffle."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        df = spark.range(5000).withColumn("g", F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 700))
        indexed = dense_index(df, ["id"], by=["g"], unique=True)
        assert "SortMergeJoin" in indexed._jdf.queryExecution().executedPlan().toString()
        rows = [r.asDict() for r in df.collect()]
        assert {r.id: r.idx for r in indexed.collect()} == _expected(rows, ("g",), ("id",))
    finally:
        spark.conf.set(key, before)


def test_descending_and_expression_order(spark):
    df = spark.range(100)
    got = {r.id: r.idx for r in dense_index(df, [F.desc("id")]).collect()}
    assert got == {i: 99 - i for i in range(100)}


def test_empty_table(spark):
    assert dense_index(spark.range(0), ["id"]).count() == 0
    assert dense_index(spark.range(0).withColumn("g", F.lit(1)), ["id"], by=["g"]).count() == 0


@pytest.fixture
def no_coalescing(spark):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, before)


def _largest_task(df) -> int:
    return max(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())


def test_hot_group_spreads_over_tasks(spark, no_coalescing):
    df = spark.range(60_000).withColumn("g", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")))
    hot = dense_index(df, ["id"], by=["g"], unique=True).where("g = 'hot'")
    assert _largest_task(hot) < 12_000
    assert hot.agg(F.max("idx"), F.count_distinct("idx")).first()[:] == (19_999, 20_000)


def test_copies_spread_over_tasks(spark, no_coalescing):
    """A third of the rows are the same row, many times."""
    df = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 30_000).otherwise(F.col("id")).alias("x"))
    indexed = dense_index(df, ["x"])
    assert _largest_task(indexed) < 15_000
    assert indexed.agg(F.min("idx"), F.max("idx"), F.count_distinct("idx")).first()[:] == (0, 59_999, 60_000)
    ordered = [r.x for r in indexed.orderBy("idx").collect()]
    assert ordered == sorted(ordered)


def test_plan_has_no_window_over_rows(spark):
    plan = dense_index(spark.range(1000), ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan
