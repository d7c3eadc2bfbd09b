"""Queries for frame and tensor operators (P*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.functions import pixels
from cliploom.functions.sampling import sample_indices
from cliploom.operators import clips, frames
from cliploom.plans import hosting as host
from cliploom.plans.registry import query

N = host.N_FRAMES
H, W, C = host.FRAME
SMALL = (5, 3)


def _wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip, k, frame_idx) for every clip."""
    return frames.fan_out(host.clip_lengths(spark, sf_dir), N).select("clip", "k", "frame_idx")


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip, frame_idx, k, vec_id) for every sampled frame."""
    return frames.fetch(_wanted(spark, sf_dir), host.frame_keys(spark, sf_dir), ["clip", "frame_idx"])


def _sampled(spark: SparkSession, sf_dir: str, stored: DataFrame | None = None) -> DataFrame:
    """Sampled frames with pixels. Keys are matched first; pixels join last, by vec_id."""
    stored = host.stored_frames(spark, sf_dir) if stored is None else stored
    return host.as_pixels(frames.fetch(_found(spark, sf_dir), stored, ["vec_id"]))


def _values(df: DataFrame, key: str, values: Column, digits: int | None = None) -> DataFrame:
    """One row per array element: key, pos, value.

    Explode an expression, not a column: for a column Spark infers a filter on its size
    and computes the pixels a second time below.
    """
    if digits:
        values = F.transform(values, lambda x: F.round(x, digits))
    return df.select(key, F.posexplode(values).alias("pos", "value"))


def _unnest(key: str, source: str, values: str, value: str = "value") -> str:
    """SQL: one row per list element."""
    return f"""SELECT {key}, pos, {value} AS value FROM (
  SELECT {key}, unnest(v) AS value, generate_subscripts(v, 1) - 1 AS pos
  FROM (SELECT {key}, {values} AS v FROM {source}) a) b"""


# --- sampling and lookup ------------------------------------------------------


@query(
    "P3",
    """SELECT doc_id, k, CASE WHEN k = 15 THEN n_chars - 1
       ELSE floor(k * ((n_chars - 1) / 15.0::DOUBLE))::BIGINT END AS frame_idx
FROM documents, range(16) r(k)""",
)
def frame_index_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = host.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return docs.select("doc_id", F.posexplode(sample_indices(F.col("n_chars"), N)).alias("k", "frame_idx"))


_SQL_SAMPLED = f"WITH {host.SQL_FRAMES}, {host.SQL_WANTED}"


@query("P6", f"{_SQL_SAMPLED} SELECT clip, k, frame_idx, vec_id FROM wanted JOIN frames USING (clip, frame_idx)")
def frame_decode_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).select("clip", "k", "frame_idx", "vec_id")


@query("P7", f"{_SQL_SAMPLED} SELECT clip AS video_idx, k, frame_idx, 224 AS height, 224 AS width FROM wanted")
def frame_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = host.clip_lengths(spark, sf_dir).withColumnRenamed("clip", "video_idx")
    sized = lengths.withColumns({"height": F.lit(224), "width": F.lit(224)})
    tasks = frames.tasks_for(sized.count() * N, 1024, spark.sparkContext.defaultParallelism)
    return frames.spread(frames.fan_out(sized, N), tasks).select("video_idx", "k", "frame_idx", "height", "width")


@query(
    "P8",
    f"""{_SQL_SAMPLED}, kept AS (SELECT * FROM frames WHERE lead > 0)
SELECT w.clip, w.k, w.frame_idx, CASE WHEN vec_id IS NULL THEN 'zero_filled' ELSE 'ok' END AS status,
       coalesce(list_sum(px), 0)::BIGINT AS total
FROM wanted w LEFT JOIN kept USING (clip, frame_idx)""",
)
def zero_fill_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that start with a negative value play the part of frames that cannot be read."""
    readable = host.stored_frames(spark, sf_dir).where(F.get("embedding", F.lit(0)) > 0)
    found = _sampled(spark, sf_dir, readable)
    filled = frames.zero_fill(found, F.array_repeat(F.lit(0), H * W * C), data="px")
    total = F.aggregate("px", F.lit(0).cast("bigint"), lambda acc, x: acc + x).alias("total")
    return filled.select("clip", "k", "frame_idx", "status", total)


@query(
    "P9",
    """SELECT o_orderkey, count(l_orderkey) AS total_frames, 16 AS n_frames,
       CASE WHEN count(l_orderkey) = 0 THEN 16 ELSE 0 END AS zero_frames,
       CASE WHEN count(l_orderkey) = 0 THEN 'empty' ELSE 'ok' END AS status
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""",
)
def empty_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = host.order_clips(spark, sf_dir).withColumn("plan", frames.positions(F.col("total_frames"), N))
    return orders.select(
        "o_orderkey",
        "total_frames",
        F.size("plan").alias("n_frames"),
        F.size(F.filter("plan", F.isnull)).alias("zero_frames"),
        clips.planned_status(F.col("total_frames")).alias("status"),
    )


# --- pixels as arrays ---------------------------------------------------------

_SQL_BILINEAR = """list_transform(range(15), lambda p:
    (grey[y0(p) * 8 + x0(p) + 1] * (1 - fx(p)) + grey[y0(p) * 8 + x1(p) + 1] * fx(p)) * (1 - fy(p))
  + (grey[y1(p) * 8 + x0(p) + 1] * (1 - fx(p)) + grey[y1(p) * 8 + x1(p) + 1] * fx(p)) * fy(p))"""


def _sql_bilinear() -> str:
    """8x8 to 5x3 in SQL, spelled out from the half-pixel rule."""
    y = "least(7.0::DOUBLE, greatest(0.0::DOUBLE, (p // 3 + 0.5::DOUBLE) * 8 / 5 - 0.5::DOUBLE))"
    x = "least(7.0::DOUBLE, greatest(0.0::DOUBLE, (p % 3 + 0.5::DOUBLE) * 8 / 3 - 0.5::DOUBLE))"
    parts = {
        "y0(p)": f"floor({y})::INT",
        "x0(p)": f"floor({x})::INT",
        "y1(p)": f"least(7, floor({y})::INT + 1)",
        "x1(p)": f"least(7, floor({x})::INT + 1)",
        "fy(p)": f"({y} - floor({y}))",
        "fx(p)": f"({x} - floor({x}))",
    }
    sql = _SQL_BILINEAR
    for short, full in parts.items():
        sql = sql.replace(short, full)
    return sql


_SQL_NEAREST = """list_transform(range(15), lambda p:
    grey[least(7, floor((p // 3) * (8 / 5.0::DOUBLE))::INT) * 8 + least(7, floor((p % 3) * (8 / 3.0::DOUBLE))::INT) + 1])"""


@query("P10", f"WITH {host.SQL_FRAMES} " + _unnest("vec_id", "frames", _sql_bilinear(), "round(value, 6)"))
def resize_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = pixels.resize_bilinear(F.col("px"), host.GREY, SMALL)
    return _values(host.grey_pixels(spark, sf_dir), "vec_id", small, 6)


@query("P11", f"WITH {host.SQL_FRAMES} " + _unnest("vec_id", "frames", _SQL_NEAREST))
def resize_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = pixels.resize_nearest(F.col("px"), host.GREY, SMALL)
    return _values(host.grey_pixels(spark, sf_dir), "vec_id", small)


_SQL_REVERSED = "list_transform(px, lambda x, i: px[i - (i - 1) % 3 + 2 - (i - 1) % 3])"


@query("P12", f"WITH {host.SQL_FRAMES} " + _unnest("vec_id", "frames", _SQL_REVERSED))
def channel_reversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(host.frame_pixels(spark, sf_dir), "vec_id", pixels.reverse_channels(F.col("px"), C))


_SQL_UNIT = "list_transform(px, lambda x: x / 255.0::DOUBLE)"


@query("P13", f"WITH {host.SQL_FRAMES} " + _unnest("vec_id", "frames", _SQL_UNIT, "round(value, 6)"))
def scale_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(host.frame_pixels(spark, sf_dir), "vec_id", pixels.scale_unit(F.col("px")), 6)


_SQL_NORMALIZED = f"WITH {host.SQL_FRAMES} " + _unnest(
    "vec_id", "frames", host.sql_normalize("px"), "round(value, 6)"
)


@query("P14", _SQL_NORMALIZED)
def channel_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(host.frame_pixels(spark, sf_dir), "vec_id", pixels.normalize(F.col("px")), 6)


_SQL_CHW = "list_transform(px, lambda x, i: px[((i - 1) % 64) * 3 + (i - 1) // 64 + 1])"


@query("P15", f"WITH {host.SQL_FRAMES} " + _unnest("vec_id", "frames", _SQL_CHW))
def layout_chw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(host.frame_pixels(spark, sf_dir), "vec_id", pixels.to_chw(F.col("px"), H, W, C))


# --- clips --------------------------------------------------------------------

_SQL_STACKED = f"""{_SQL_SAMPLED}, stacked AS (
  SELECT clip, flatten(list(px ORDER BY k)) AS px FROM wanted JOIN frames USING (clip, frame_idx) GROUP BY clip) """


@query("P16", _SQL_STACKED + _unnest("clip", "stacked", "px"))
def stack_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    stacked = clips.stack_arrays(_sampled(spark, sf_dir), ["clip"], N, "px")
    return _values(stacked, "clip", F.col("px"))


_SQL_DRAW = "('0x' || substr(md5('{seed}|' || vec_id), 1, 7))::INT / 268435456.0::DOUBLE"
_SQL_AUGMENTED = f"""WITH {host.SQL_FRAMES}, drawn AS (
  SELECT vec_id, px, {_SQL_DRAW.format(seed=11)} < 0.5 AS flip,
         0.8::DOUBLE + 0.4::DOUBLE * ({_SQL_DRAW.format(seed=12)}) AS factor FROM frames),
flipped AS (
  SELECT vec_id, factor, CASE WHEN flip THEN list_transform(px, lambda x, i:
    px[((i - 1) // 24) * 24 + (7 - ((i - 1) % 24) // 3) * 3 + (i - 1) % 3 + 1]) ELSE px END AS px FROM drawn),
bright AS (
  SELECT vec_id, list_transform(px, lambda x: least(255, floor(x * factor))::INT) AS px FROM flipped) """


@query("P17", _SQL_AUGMENTED + _unnest("vec_id", "bright", host.sql_normalize("px"), "round(value, 6)"))
def user_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    px, key = F.col("px"), F.col("vec_id")

    def flip(df: DataFrame) -> DataFrame:
        flipped = pixels.flip_horizontal(px, W, C)
        return df.withColumn("px", F.when(pixels.uniform_draw(11, key) < 0.5, flipped).otherwise(px))

    def brighten(df: DataFrame) -> DataFrame:
        factor = F.lit(0.8) + F.lit(0.4) * pixels.uniform_draw(12, key)
        return df.withColumn("px", pixels.adjust_brightness(px, factor))

    def normalise(df: DataFrame) -> DataFrame:
        return df.withColumn("px", pixels.normalize(px))

    done = frames.transform(host.frame_pixels(spark, sf_dir), flip, brighten, normalise)
    return _values(done, "vec_id", px, 6)


@query(
    "P18",
    f"""{_SQL_SAMPLED} SELECT clip, count(*) AS frame_count, count(*) || 'x8x8x3' AS frames_shape
FROM wanted JOIN frames USING (clip, frame_idx) GROUP BY clip""",
)
def frame_count_and_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = _found(spark, sf_dir).groupBy("clip").agg(F.count("vec_id").alias("n"))
    shape = clips.frames_shape(F.col("n"), *[F.lit(v) for v in (H, W, C)])
    count = clips.frame_count(F.lit("ok"), F.col("n"))
    return counted.select("clip", count.alias("frame_count"), F.array_join(shape, "x").alias("frames_shape"))


@query(
    "P19 P3 P6 P14",
    f"""{_SQL_SAMPLED}, valued AS (
  SELECT clip, {host.sql_normalize("px")} AS v FROM wanted JOIN frames USING (clip, frame_idx))
SELECT clip, count(*) AS n_frames, round(avg(list_sum(v) / len(v)), 6) AS mean_value FROM valued GROUP BY clip""",
)
def clip_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample 16 frames per clip, look them up, normalise, and average each clip."""
    normalised = _sampled(spark, sf_dir).withColumn("px", pixels.normalize(F.col("px")))
    means = clips.mean_per_clip(normalised, ["clip"], "px")
    return means.withColumn("mean_value", F.round("mean_value", 6))


_SQL_SYNTHETIC = """list_transform(range(192), lambda i:
    ('0x' || substr(md5('7|' || vec_id || '|' || (i // 16)), (i % 16) * 2 + 1, 2))::INT)"""


@query("P21", _unnest("vec_id", "embeddings", _SQL_SYNTHETIC))
def synthetic_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = host.table(spark, sf_dir, "embeddings").select("vec_id")
    return _values(keys, "vec_id", pixels.synthetic_pixels(7, F.col("vec_id"), H * W * C))


# --- the same operators on binary frames, as the media job uses them -------------


def _colour_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.from_arrays(host.frame_pixels(spark, sf_dir), F.col("px"), H, W, C)


def _grey_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.from_arrays(host.grey_pixels(spark, sf_dir), F.col("px"), *host.GREY, 1)


def _doubles(done: DataFrame) -> DataFrame:
    """Values of binary doubles. Selected right after the kernels, so that Spark unpacks them in the kernels' worker."""
    arrays = done.select("vec_id", frames.to_array(F.col("data"), "float64").alias("value"))
    return _values(arrays, "vec_id", F.col("value"), 6)


@query("P10", f"WITH {host.SQL_FRAMES} " + _unnest("vec_id", "frames", _sql_bilinear(), "floor(round(value, 9) + 0.5)"))
def binary_resize_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = frames.resize(_grey_frames(spark, sf_dir), *SMALL)
    return _values(small, "vec_id", frames.to_array(F.col("data")))


@query("P11", f"WITH {host.SQL_FRAMES} " + _unnest("vec_id", "frames", _SQL_NEAREST, "value::DOUBLE"))
def binary_resize_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = frames.resize(_grey_frames(spark, sf_dir), *SMALL, method="nearest")
    return _values(small, "vec_id", frames.to_array(F.col("data")))


_SQL_REVERSED_CHW = "list_transform(px, lambda x, i: px[((i - 1) % 64) * 3 + 2 - (i - 1) // 64 + 1])"


@query("P12 P15", f"WITH {host.SQL_FRAMES} " + _unnest("vec_id", "frames", _SQL_REVERSED_CHW, "value::DOUBLE"))
def binary_reversed_chw(spark: SparkSession, sf_dir: str) -> DataFrame:
    planar = frames.to_chw(frames.reverse_channels(_colour_frames(spark, sf_dir)))
    return _values(planar, "vec_id", frames.to_array(F.col("data")))


@query("P14", _SQL_NORMALIZED)
def binary_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doubles(frames.normalize(_colour_frames(spark, sf_dir), "float64"))


@query("P16", _SQL_STACKED + _unnest("clip", "stacked", "px", "value::DOUBLE"))
def binary_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    sampled = _sampled(spark, sf_dir).withColumn("video_path", F.col("clip").cast("string"))
    stacked = clips.stack(
        frames.from_arrays(sampled.withColumnRenamed("clip", "video_idx"), F.col("px"), H, W, C), N
    )
    return _values(stacked.withColumnRenamed("video_idx", "clip"), "clip", frames.to_array(F.col("data")))


@query("P17", _SQL_AUGMENTED + _unnest("vec_id", "bright", host.sql_normalize("px"), "round(value, 6)"))
def binary_user_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = frames.transform(
        _colour_frames(spark, sf_dir),
        lambda df: frames.random_flip(df, 11, keys=["vec_id"]),
        lambda df: frames.jitter_brightness(df, 12, keys=["vec_id"]),
        lambda df: frames.normalize(df, "float64"),
    )
    return _doubles(done)
