from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cliploom.operators import runs
from cliploom.session import scratch_path, shared_dir, size_shuffles
from cliploom.sources import dataset, runlog


def test_shared_dir_is_the_configured_folder(spark):
    assert spark.conf.get("spark.checkpoint.dir") in shared_dir(spark)


def test_missing_dataset(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        dataset.load(spark, str(tmp_path / "none"))


def test_buckets_round_trip_and_prune(spark):
    df = spark.range(1000).withColumn("v", F.col("id") * 2)
    path = dataset.save(df, scratch_path(spark, "buckets"), buckets=4, key="id")
    back = dataset.load(spark, path)
    assert {r[:] for r in back.select("id", "v").collect()} == {(i, 2 * i) for i in range(1000)}
    plan = back.where("bucket = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


def test_incremental_processes_only_what_is_new(spark):
    calls = spark.sparkContext.accumulator(0)

    def process(new):
        def count(batches):
            for b in batches:
                calls.add(b.num_rows)
                yield b

        return new.mapInArrow(count, new.schema)

    wanted = spark.range(100).select(F.col("id").alias("key"), F.lit("new").alias("result"))
    first = dataset.save(
        dataset.incremental(wanted, wanted.limit(0), "key", process), scratch_path(spark, "first")
    )
    assert calls.value == 100
    more = spark.range(120).select(F.col("id").alias("key"), F.lit("newer").alias("result"))
    second = dataset.incremental(more, dataset.load(spark, first), "key", process)
    path = dataset.save(second, scratch_path(spark, "second"))
    assert calls.value == 120
    counts = {r.result: r["count"] for r in dataset.load(spark, path).groupBy("result").count().collect()}
    assert counts == {"new": 100, "newer": 20}
    dataset.incremental(more, dataset.load(spark, path), "key", process).count()
    assert calls.value == 120


def test_random_access(spark):
    ds = dataset.indexed(spark.range(1000, 1100).toDF("x"), ["x"])
    assert dataset.length(ds) == 100
    assert dataset.item(ds, 7).first().x == 1007
    assert sorted(r.x for r in dataset.take_slice(ds, 95, 105).collect()) == list(range(1095, 1100))


RUNS = [
    ("alpha one", 0, "a", 5.0, 10, True, 3.0),
    ("alpha two", 1, "a", 4.0, 10, True, 2.0),
    ("beta one", 2, "b", 4.0, 10, True, 2.0),
    ("beta two", 3, "b", 0.0, 0, False, 9.0),
]


@pytest.fixture(scope="module")
def log(spark):
    df = spark.createDataFrame(
        RUNS, "name string, run_no bigint, method string, total_time double, samples_processed bigint, "
        "success boolean, memory_usage_mb double"
    )
    rate = runs.safe_ratio(F.col("samples_processed"), F.col("total_time"))
    return df.withColumn("samples_per_second", rate)


def test_first_run_wins_a_tie(log):
    best = {r.metric: r.name for r in runs.winners(log.where("success")).collect()}
    assert best == {"total_time": "alpha two", "samples_per_second": "alpha two", "memory_usage_mb": "alpha two"}


def test_no_rate_without_time(log):
    assert runs.summary(log.where("run_no = 3"), "method").first().samples_per_second == 0


def test_no_row_where_all_failed(log):
    assert runs.best_method(log.where("run_no = 3"), "method").count() == 0


def test_speed_up_is_candidate_over_baseline(log):
    good = runs.totals(log.where("success"), ["method"], 16)
    rows = {r.method: r for r in runs.against_baseline(good, "a").collect()}
    assert rows["a"].speedup == 1 and rows["a"].time_reduction_pct == 0
    assert rows["b"].speedup == pytest.approx((16 / 4) / (32 / 9))
    assert rows["b"].time_reduction_pct == pytest.approx((9 - 4) / 9 * 100)


def test_grid_is_every_combination(spark):
    cells = runs.grid(spark, num_workers=[1, 2], batch_size=[4, 8, 16], method=["x"])
    assert cells.count() == 6 and runs.feasible(cells, 1).count() == 3


@pytest.mark.parametrize("size,tier", [(1, "minimal"), (4, "small"), (7, "small"), (8, "medium"), (16, "large"), (99, "large")])
def test_tiers(spark, size, tier):
    assert spark.range(1).select(runs.tier(F.lit(size)).tier).first()[0] == tier


def test_csv_has_a_header_and_no_index(spark, log):
    path = runlog.write_csv(log, scratch_path(spark, "csv"))
    head = spark.read.text(path).first()[0]
    assert head.startswith("name,run_no,method")
    assert runlog.read_csv(spark, path, log.schema).orderBy("run_no").collect() == log.orderBy("run_no").collect()


def test_shuffle_partitions_follow_the_data(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert size_shuffles(spark, 1 << 20) == spark.sparkContext.defaultParallelism
        assert size_shuffles(spark, 100 << 40) == 819_200
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("kind", ["bigint", "int", "string"])
@pytest.mark.parametrize("limit", ["10MB", "-1"])
def test_members_without_shuffling_wide_rows(spark, kind, limit):
    """Broadcast, exact bitmap or hashed bitmap: the same rows, repeats and all, and nulls match nothing."""
    from cliploom.operators.sizing import members

    ids = [0, 1, 7, 8, 63, 64, 64, 1000, 99_999, None, *range(200, 300)]
    rows = spark.createDataFrame([(i,) for i in [*ids, -1, 5, 100_000, 1 << 30]], "id bigint").select(F.col("id").cast(kind).alias("id"), F.lit("wide").alias("data"))
    keys = spark.createDataFrame([(i, 1) for i in [*ids, 64, 2_000]], "id bigint, data int").withColumn("id", F.col("id").cast(kind))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        found = members(rows, keys, "id")
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = sorted(str(r.id) for r in found.collect())
        nothing = members(rows, keys.limit(0), "id").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == sorted(str(i) for i in ids if i is not None) and nothing == []
    assert found.columns == ["id", "data"]
    if limit == "-1" and kind != "string":
        assert "Exchange" not in plan and "Join" not in plan
