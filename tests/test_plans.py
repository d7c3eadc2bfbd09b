"""What the physical plans must not contain, for every registered query."""

from __future__ import annotations

import re

import pytest

from cliploom.plans.catalog import all_queries

QUERIES = all_queries()
EXPLODING = ("CartesianProduct", "BroadcastNestedLoopJoin")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_joins_no_row_udfs_no_single_task_windows(spark, sf_dir, name):
    plan = _plan(QUERIES[name].run(spark, sf_dir))
    for node in (*EXPLODING, "BatchEvalPython"):
        assert node not in plan
    # Windows see rows that are aggregated already, and always have a partition key.
    for window in re.findall(r"Window (\[.*)", plan):
        partition = re.search(r"\], \[([^\]]*)\]", window)
        assert partition and partition[1] and "ASC" not in partition[1] and "DESC" not in partition[1], window


@pytest.mark.parametrize("name", ["time_reduction", "speedup", "method_clip_grid"])
def test_the_log_is_read_once(spark, sf_dir, name):
    assert _plan(QUERIES[name].run(spark, sf_dir)).count("FileScan") == 1


@pytest.mark.parametrize("name", ["clip_means", "stack_frames", "zero_fill_frames"])
def test_only_requested_frames_are_shuffled(spark, sf_dir, name):
    """Without broadcasts the stored frames pass a bitmap of the wanted keys before their exchange."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = _plan(QUERIES[name].run(spark, sf_dir))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    above = plan[: plan.index("FileScan parquet")].rstrip().splitlines()[-3:]
    assert any("Filter" in line and "xxhash64(vec_id" in line for line in above), above


def test_scans_read_only_needed_columns(spark, sf_dir):
    lazy = _plan(QUERIES["lazy_metadata_scan"].run(spark, sf_dir))
    assert "ReadSchema: struct<url:string>" in lazy
    average = _plan(QUERIES["method_average"].run(spark, sf_dir))
    assert "ReadSchema: struct<event_type:string,value:double>" in average
    assert "GreaterThan(value,0.0)" in average


def test_suffix_test_reaches_the_scan(spark, sf_dir):
    assert "StringEndsWith(url,.html)" in _plan(QUERIES["listing_by_suffix"].run(spark, sf_dir))


def test_aggregates_combine_before_the_shuffle(spark, sf_dir):
    for name in ("throughput_summary", "repetition_stats", "clip_means", "decoder_fallback"):
        assert "partial_" in _plan(QUERIES[name].run(spark, sf_dir)), name
