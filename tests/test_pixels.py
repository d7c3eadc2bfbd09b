from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cliploom import schemas
from cliploom.functions import kernels, pixels
from cliploom.operators import clips, frames
from cliploom.plans.catalog import all_queries
from cliploom.session import BYTES_PER_BATCH, ROWS_PER_BATCH, ship_package

RNG = np.random.default_rng(5)


def exact_bilinear(frame: np.ndarray, height: int, width: int) -> np.ndarray:
    """Half-pixel bilinear in exact fractions, halves up."""

    def taps(old, new):
        for i in range(new):
            c = min(max(Fraction(2 * i + 1, 2) * old / new - Fraction(1, 2), Fraction(0)), Fraction(old - 1))
            low = c.numerator // c.denominator
            yield low, min(low + 1, old - 1), c - low

    out = np.zeros((height, width, frame.shape[2]), np.uint8)
    for i, (y0, y1, fy) in enumerate(taps(frame.shape[0], height)):
        for j, (x0, x1, fx) in enumerate(taps(frame.shape[1], width)):
            for c in range(frame.shape[2]):
                a, b, d, e = (int(frame[y, x, c]) for y, x in ((y0, x0), (y0, x1), (y1, x0), (y1, x1)))
                value = (a * (1 - fx) + b * fx) * (1 - fy) + (d * (1 - fx) + e * fx) * fy
                out[i, j, c] = int(value + Fraction(1, 2))
    return out


@settings(max_examples=40, deadline=None)
@given(st.tuples(*[st.integers(1, 9)] * 4), st.integers(1, 3), st.integers(0, 2**32 - 1))
def test_bilinear_kernel_is_exact(sizes, channels, seed):
    h, w, new_h, new_w = sizes
    frame = np.random.default_rng(seed).integers(0, 256, (h, w, channels), dtype=np.uint8)
    np.testing.assert_array_equal(kernels.bilinear(frame, new_h, new_w), exact_bilinear(frame, new_h, new_w))


def test_bilinear_of_large_targets_does_not_overflow():
    frame = np.full((3, 3, 3), 255, np.uint8)
    assert kernels.bilinear(frame, 2000, 1500).min() == 255


@settings(max_examples=40, deadline=None)
@given(st.tuples(*[st.integers(1, 9)] * 4), st.integers(0, 2**32 - 1))
def test_nearest_kernel(sizes, seed):
    h, w, new_h, new_w = sizes
    frame = np.random.default_rng(seed).integers(0, 256, (h, w, 3), dtype=np.uint8)
    want = [
        [frame[min(int(i * (h / new_h)), h - 1), min(int(j * (w / new_w)), w - 1)] for j in range(new_w)]
        for i in range(new_h)
    ]
    np.testing.assert_array_equal(kernels.nearest(frame, new_h, new_w), want)


def test_normalise_of_black_and_white():
    two = np.array([[[0, 0, 0], [255, 255, 255]]], np.uint8)
    values = kernels.normalize(two, "float64")[0]
    np.testing.assert_allclose(values[0], [-2.1179, -2.0357, -1.8044], atol=1e-4)
    np.testing.assert_allclose(values[1], [2.2489, 2.4286, 2.6400], atol=1e-4)


@pytest.mark.parametrize("src,dst", [((8, 8), (5, 3)), ((2, 7), (4, 4)), ((4, 5), (4, 5))])
@pytest.mark.parametrize("channels", [1, 3])
def test_array_functions_equal_kernels(spark, src, dst, channels):
    frame = RNG.integers(0, 256, (*src, channels), dtype=np.uint8)
    px = F.lit(frame.ravel().tolist())
    row = (
        spark.range(1)
        .select(
            pixels.resize_bilinear(px, src, dst, channels).alias("bilinear"),
            pixels.resize_nearest(px, src, dst, channels).alias("nearest"),
            pixels.to_chw(px, *src, channels).alias("chw"),
            pixels.reverse_channels(px, channels).alias("reversed"),
            pixels.flip_horizontal(px, src[1], channels).alias("flipped"),
            pixels.normalize(px).alias("normal"),
        )
        .first()
    )
    rounded = np.floor(np.round(row.bilinear, 9) + 0.5)
    np.testing.assert_array_equal(rounded, kernels.bilinear(frame, *dst).ravel())
    np.testing.assert_array_equal(row.nearest, kernels.nearest(frame, *dst).ravel())
    np.testing.assert_array_equal(row.chw, frame.transpose(2, 0, 1).ravel())
    np.testing.assert_array_equal(row.reversed, frame[..., ::-1].ravel())
    np.testing.assert_array_equal(row.flipped, frame[:, ::-1].ravel())
    if channels == 3:
        np.testing.assert_allclose(row.normal, kernels.normalize(frame, "float64").ravel(), atol=1e-12)


def _frame_table(spark, stack: np.ndarray, status: list[str]):
    rows = [
        (1, "a", "a", 9, k, k, *f.shape, "HWC", bytearray(f.tobytes()), s, None)
        for k, (f, s) in enumerate(zip(stack, status, strict=True))
    ]
    from cliploom import schemas

    return spark.createDataFrame(rows, schemas.FRAMES)


def test_binary_functions_per_frame_and_per_clip(spark):
    stack = RNG.integers(0, 256, (4, 5, 7, 3), dtype=np.uint8)
    table = _frame_table(spark, stack, ["ok"] * 4)
    tensor = clips.stack(table, 4)
    for made in (frames.resize, frames.to_chw, frames.reverse_channels):
        args = (3, 4) if made is frames.resize else ()
        per_frame = b"".join(bytes(r.data) for r in made(table, *args).orderBy("k").collect())
        assert bytes(made(tensor, *args).first().data) == per_frame


def test_rows_of_many_sizes_and_null_pixels(spark):
    shapes = [(2, 3, 3), (2, 3, 3), (4, 5, 3), (2, 3, 1), (4, 5, 3), (4, 5, 3)] * 7
    stack = [RNG.integers(0, 256, s, dtype=np.uint8) for s in shapes]
    rows = [
        (1, "a", "a", 9, k, k, *f.shape, "HWC", None if k % 5 == 0 else bytearray(f.tobytes()), "ok", None)
        for k, f in enumerate(stack)
    ]
    from cliploom import schemas

    table = spark.createDataFrame(rows, schemas.FRAMES).coalesce(1)
    for made, kernel in (
        (frames.reverse_channels, lambda f: f[..., ::-1]),
        (frames.to_chw, lambda f: f.transpose(2, 0, 1)),
        (lambda t: frames.resize(t, 3, 2), lambda f: kernels.bilinear(f, 3, 2)),
    ):
        got = [r.data and bytes(r.data) for r in made(table).orderBy("k").collect()]
        assert got == [None if k % 5 == 0 else kernel(f).tobytes() for k, f in enumerate(stack)]


def test_bytes_from_arrays_and_back(spark):
    df = spark.createDataFrame([(0, [1, 255]), (1, None), (2, [0, 128])], "id int, px array<int>").coalesce(1)
    table = frames.from_arrays(df, F.col("px"), 1, 2, 1)
    rows = table.select("id", "data", frames.to_array(F.col("data")).alias("back")).orderBy("id").collect()
    assert [r.data and list(r.data) for r in rows] == [[1, 255], None, [0, 128]]
    assert [r.back for r in rows] == [[1.0, 255.0], None, [0.0, 128.0]]


@pytest.mark.parametrize("channels", [1, 3, 4])
def test_any_image_to_rgb(spark, channels):
    frame = RNG.integers(0, 256, (2, 3, channels), dtype=np.uint8)
    df = spark.createDataFrame([(frame.ravel().tolist(),)], "px array<int>")
    row = frames.to_rgb(frames.from_arrays(df, F.col("px"), 2, 3, channels)).first()
    want = np.repeat(frame, 3, axis=2) if channels == 1 else frame[..., 2::-1]
    assert (bytes(row.data), row.channels) == (want.tobytes(), 3)


def test_status_decides_what_zero_means(spark):
    stack = np.zeros((4, 2, 2, 3), np.uint8)
    table = _frame_table(spark, stack, ["ok", "zero_filled", "empty", "error"])
    rows = frames.normalize(table, "float64").orderBy("k").collect()
    values = [np.frombuffer(r.data).reshape(2, 2, 3)[0, 0] for r in rows]
    for v in values[:3]:
        np.testing.assert_allclose(v, [-2.1179, -2.0357, -1.8044], atol=1e-4)
    np.testing.assert_array_equal(values[3], [0, 0, 0])
    assert clips.stack(table, 4).first().frame_count == 0


@pytest.mark.parametrize(("side", "n", "most"), [(2, 5000, ROWS_PER_BATCH), (224, 200, BYTES_PER_BATCH // (224 * 224 * 3) + 1)])
def test_batches_of_frames_are_bounded(spark, side, n, most):
    @F.arrow_udf("int")
    def rows(data: pa.Array) -> pa.Array:
        return pa.array([len(data)] * len(data), pa.int32())

    settings = {"maxRecordsPerBatch": "10000", "maxBytesPerBatch": "64MB"}
    for name, value in settings.items():
        spark.conf.set(f"spark.sql.execution.arrow.{name}", value)
    sizes = {"height": F.lit(side), "width": F.lit(side), "channels": F.lit(3)}
    data = F.repeat(F.lit("abc"), F.lit(side * side)).cast("binary")
    df = ship_package(spark).range(0, n, 1, 1).withColumns({**sizes, "data": data})
    got = frames.reverse_channels(df).select(rows("data").alias("n")).agg(F.max("n"), F.count("n")).first()
    assert got[0] <= most and got[1] == n


def _steps_one_by_one(table, steps, between):
    for step in steps:
        table = between(step(table))
    return table


def _content(table):
    rows = [{**r.asDict(), "data": r.data and bytes(r.data)} for r in table.orderBy("k").collect()]
    return table.columns, rows


@pytest.mark.parametrize("keys", [["video_idx", "k"], ["data"], ["Data", "k"]])
def test_steps_in_one_worker_equal_steps_one_by_one(spark, keys):
    shapes = [(2, 3, 3), (2, 3, 3), (4, 5, 3), (2, 3, 4), (4, 5, 3), (1, 1, 1)] * 8
    stack = [RNG.integers(0, 256, s, dtype=np.uint8) for s in shapes]
    rows = [
        (1, "a", "a", 9, k, k, *f.shape, "HWC", None if k % 7 == 0 else bytearray(f.tobytes()), "error" if k % 5 == 0 else "ok", None)
        for k, f in enumerate(stack)
    ]
    table = spark.createDataFrame(rows, schemas.FRAMES).withColumn("_pixels0", F.col("k")).coalesce(1)
    steps = [
        frames.to_rgb,
        lambda t: frames.random_flip(t, 11, keys=keys),
        lambda t: frames.resize(t, 3, 2),
        lambda t: frames.random_flip(t, 12, keys=keys),
        lambda t: frames.jitter_brightness(t, 13, keys=keys),
        lambda t: frames.normalize(t, "float64", layout="CHW"),
    ]
    together = _steps_one_by_one(table, steps, lambda t: t)
    want = _content(_steps_one_by_one(table, steps, lambda t: t.select("*")))
    assert _content(together) == want
    assert _plan(together).count("ArrowEvalPython") == (1 if "k" in keys and "Data" not in keys else 4)


def test_cached_steps_are_not_computed_again(spark):
    table = _frame_table(spark, RNG.integers(0, 256, (4, 5, 7, 3), dtype=np.uint8), ["ok"] * 4)
    flipped = frames.reverse_channels(table).cache()
    try:
        made = frames.to_chw(flipped)
        assert "InMemoryTableScan" in _plan(made)
        assert _content(made) == _content(frames.to_chw(frames.reverse_channels(table)))
    finally:
        flipped.unpersist()


def test_user_transforms_take_few_workers(spark, sf_dir):
    """A worker for the arrays' bytes, one for all transforms and the way back, on each core."""
    for name in ("binary_user_transforms", "binary_normalize"):
        assert _plan(all_queries()[name].run(spark, sf_dir)).count("ArrowEvalPython") == 2, name
    assert _plan(all_queries()["binary_reversed_chw"].run(spark, sf_dir)).count("ArrowEvalPython") == 3


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_draws_do_not_depend_on_partitions(spark):
    def draws(parts):
        df = spark.range(200).repartition(parts)
        return {r.id: r.u for r in df.select("id", pixels.uniform_draw(3, F.col("id")).alias("u")).collect()}

    one = draws(1)
    assert one == draws(7)
    assert 0 <= min(one.values()) and max(one.values()) < 1
    assert 0.35 < sum(u < 0.5 for u in one.values()) / 200 < 0.65
