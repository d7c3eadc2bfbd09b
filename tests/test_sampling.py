from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliploom.functions.sampling import frame_at, sample_indices, sample_timestamps
from cliploom.operators import frames

# Positions for 100 frames, 16 samples.
OF_100 = [0, 6, 13, 19, 26, 33, 39, 46, 52, 59, 66, 72, 79, 85, 92, 99]


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 64])
def test_indices_equal_linspace(spark, n):
    rows = spark.range(1, 3000).select("id", sample_indices(F.col("id"), n).alias("i")).collect()
    for row in rows:
        assert row.i == np.linspace(0, row.id - 1, n, dtype=int).tolist(), row.id


def test_known_positions(spark):
    got = spark.createDataFrame([(1,), (16,), (100,), (0,), (None,)], "t bigint").select(
        sample_indices(F.col("t"), 16).alias("i")
    )
    assert [r.i for r in got.collect()] == [[0] * 16, list(range(16)), OF_100, [], []]


def test_timestamps_equal_linspace(spark):
    rows = spark.createDataFrame([(0.0,), (0.04,), (10.0,), (123.456,)], "d double")
    for row in rows.select("d", sample_timestamps(F.col("d"), 16).alias("t")).collect():
        np.testing.assert_allclose(row.t, np.linspace(0, row.d, 16), atol=1e-12)


def test_end_of_clip_maps_to_last_frame(spark):
    row = spark.range(1).select(frame_at(F.lit(4.0), F.lit(25.0), F.lit(100)).alias("f")).first()
    assert row.f == 99


def test_fan_out_keeps_empty_clips(spark):
    clips = spark.createDataFrame([(1, 100), (2, 0), (3, 1)], "video_idx bigint, total_frames bigint")
    rows = frames.fan_out(clips, 16).collect()
    by_clip = {i: [r.frame_idx for r in sorted(rows, key=lambda r: r.k) if r.video_idx == i] for i in (1, 2, 3)}
    assert by_clip == {1: OF_100, 2: [None] * 16, 3: [0] * 16}
