from __future__ import annotations

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cliploom.operators import batches, fallback, observe, sizing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=12), st.integers(1, 8))
def test_rebatch_cuts_any_stream(sizes, size):
    at, parts = 0, []
    for n in sizes:
        parts.append(pa.RecordBatch.from_pydict({"x": pa.array(range(at, at + n), pa.int64())}))
        at += n
    out = list(batches.rebatch(parts, size))
    assert [x for b in out for x in b.column("x").to_pylist()] == list(range(at))
    assert all(b.num_rows == size for b in out[:-1])
    assert not out or 0 < out[-1].num_rows <= size


def test_map_batches_sees_full_batches(spark):
    def sizes(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    out = batches.map_batches(spark.range(0, 30, 1, 3), sizes, "n bigint", 4).collect()
    assert sorted(r.n for r in out) == [2, 2, 2, 4, 4, 4, 4, 4, 4]


def test_two_hundred_rows_by_sixteen(spark):
    got = batches.batch_stats(batches.assign(spark.range(200), ["id"], 16)).first()
    assert (got.samples, got.batch_count, round(got.avg_batch_size, 2)) == (200, 13, 15.38)


def test_no_rows_no_batches(spark):
    got = batches.batch_stats(batches.assign(spark.range(0), ["id"], 16)).first()
    assert (got.samples, got.batch_count, got.avg_batch_size) == (0, 0, 0.0)


def test_collate_keeps_order(spark):
    df = spark.range(10).withColumn("name", F.concat(F.lit("n"), "id")).repartition(5)
    rows = batches.collate(batches.assign(df, ["id"], 4), ["name"]).orderBy("batch_id").collect()
    assert [r.names for r in rows] == [["n0", "n1", "n2", "n3"], ["n4", "n5", "n6", "n7"], ["n8", "n9"]]


@pytest.mark.parametrize("parts", [1, 2, 8])
def test_shuffle_is_a_permutation_that_the_seed_fixes(spark, parts):
    df = spark.range(500).repartition(parts)
    order = [r.id for r in batches.shuffle(df, ["id"], seed=9).orderBy("idx").collect()]
    again = [r.id for r in batches.shuffle(spark.range(500), ["id"], seed=9).orderBy("idx").collect()]
    other = [r.id for r in batches.shuffle(spark.range(500), ["id"], seed=10).orderBy("idx").collect()]
    assert sorted(order) == list(range(500)) and order != list(range(500))
    assert order == again != other


def test_fallback_order_preference_and_default(spark):
    attempts = spark.createDataFrame(
        [("a", 1, "gpu", False, 1.0), ("a", 2, "CPU", True, 2.0), ("b", 3, "gpu", True, 3.0), ("b", 4, "cpu", True, 4.0),
         ("c", 5, "gpu", False, 5.0), ("d", 6, "new", True, 6.0)],
        "clip string, run_no bigint, method string, success boolean, t double",
    )

    def chosen(**kw):
        rows = fallback.choose(attempts, "clip", ["gpu", "cpu"], "t", 0.0, **kw).collect()
        return {r.clip: (r.method, r.t) for r in rows}

    assert chosen() == {"a": ("CPU", 2.0), "b": ("gpu", 3.0), "c": ("none", 0.0), "d": ("new", 6.0)}
    assert chosen(prefer="cpu") == {"a": ("CPU", 2.0), "b": ("cpu", 4.0), "c": ("none", 0.0), "d": ("none", 0.0)}
    assert chosen(prefer="other") == chosen()


def test_observation_counts_rows_in_flight(spark):
    df, seen = observe.counted(spark.range(77), "rows")
    df.write.format("noop").mode("overwrite").save()
    assert seen.get["samples"] == 77


@pytest.mark.parametrize("text,size", [("10485760b", 10 << 20), ("64MB", 64 << 20), ("1g", 1 << 30), ("-1", -1), ("8kb", 8192)])
def test_broadcast_limit(spark, text, size):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, text)
        assert sizing.broadcast_limit(spark) == size
    finally:
        spark.conf.set(key, before)


def test_long_strings_count_towards_the_limit(spark):
    assert sizing.fits_broadcast(spark.range(1000))
    assert not sizing.fits_broadcast(spark.range(1000).select(F.repeat(F.lit("x"), 20_000).alias("s")))


@pytest.mark.parametrize(
    "value",
    [
        "transform(sequence(1, 2000), x -> named_struct('start', id, 'n', x))",
        "sequence(1, 4000)",
        "array(repeat('x', 20000))",
        "named_struct('a', named_struct('b', array(null, repeat('x', 20000))))",
        "map(id, array(repeat('x', 20000), null))",
        "cast(repeat('x', 20000) as binary)",
    ],
)
def test_nested_values_count_towards_the_limit(spark, value):
    """A null in every second row takes nothing away from the others."""
    rows = spark.range(2000).selectExpr("id", f"if(id % 2 = 0, {value}, null) as v")
    assert not sizing.fits_broadcast(rows)
    assert sizing.fits_broadcast(rows.where("id < 10 OR v IS NULL"))


def test_large_tables_are_not_broadcast_by_the_size_of_their_files(spark, tmp_path):
    """Their files are below the limit: Spark alone would broadcast them."""
    rows = spark.range(200_000).selectExpr("id", "sequence(1, 20) as v")
    rows.coalesce(1).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    few = spark.range(10)
    for joined in (rows.join(sizing.broadcast_or_merge(rows.withColumnRenamed("v", "w")), "id"), few.join(sizing.broadcast_or_merge(rows), "id", "left")):
        assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    assert few.join(sizing.broadcast_or_merge(rows), "id", "left").count() == 10
    assert "BroadcastHashJoin" in rows.join(sizing.broadcast_or_merge(few), "id")._jdf.queryExecution().executedPlan().toString()
