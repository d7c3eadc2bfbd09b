"""Roles that ordinary tables play for the operators.

==============  ===========================================================
clips, frames   ``embeddings``: clip = label, frame order = vec_id; the 64 values are an
                8x8x1 frame, and an 8x8x3 frame whose channel c of pixel p is value (p + 21 c) mod 64
clip lengths    ``documents``: frames = n_chars; ``orders``: frames = order lines
run log         ``events``: framework = event_type, time = value, run = event_id
file listing    ``pages``: path = url
==============  ===========================================================
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.functions import pixels
from cliploom.operators import runs
from cliploom.operators.index import dense_index

N_FRAMES = 16
FRAME = (8, 8, 3)
CHANNEL_SHIFT = 21  # values between the channels of a pixel
GREY = (8, 8)
SAMPLES_PER_RUN = 200
METHODS = ("view", "click", "signup", "purchase", "error")
BASELINE = "view"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip, vec_id, frame_idx): the position of each frame in its clip. Keys only."""
    keys = table(spark, sf_dir, "embeddings").select(F.col("label").alias("clip"), "vec_id")
    return dense_index(keys, ["vec_id"], by=["clip"], name="frame_idx", unique=True)


def clip_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip, total_frames)."""
    frames = table(spark, sf_dir, "embeddings")
    return frames.groupBy(F.col("label").alias("clip")).agg(F.count(F.lit(1)).alias("total_frames"))


def stored_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, embedding): frames as stored."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def as_pixels(df: DataFrame) -> DataFrame:
    """Turn ``embedding`` into ``px``, an 8x8x3 frame as an array of bytes that shows every value three times."""
    height, width, channels = FRAME
    places = F.lit([(p + CHANNEL_SHIFT * c) % (height * width) for p in range(height * width) for c in range(channels)])
    values = F.transform(places, lambda at: F.get("embedding", at))
    return df.withColumn("px", F.when(F.col("embedding").isNotNull(), pixels.from_unit(values))).drop("embedding")


def frame_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, clip, px) for every frame."""
    frames = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("clip"), "embedding")
    return as_pixels(frames)


def grey_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, px): 8x8 grey frames as arrays of bytes."""
    return table(spark, sf_dir, "embeddings").select("vec_id", pixels.from_unit(F.col("embedding")).alias("px"))


def order_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, total_frames): lines per order, 0 for orders without lines."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"))
    counts = lines.agg(F.count(F.lit(1)).alias("total_frames"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey").join(counts, "o_orderkey", "left")
    return orders.withColumn("total_frames", F.coalesce("total_frames", F.lit(0).cast("bigint")))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, video_path)."""
    return table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("video_path"))


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with the columns of ``schemas.RUNS``."""
    run, time = F.col("event_id"), F.col("value")
    third = (run % 3).cast("int")
    ninth = (F.floor(run / 3) % 3).cast("int")
    failed = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        F.concat_ws(" ", "event_type", F.lit("run"), run.cast("string")).alias("name"),
        F.col("event_type").alias("framework"),
        F.col("event_type").alias("method"),
        run.alias("run_no"),
        F.get(F.lit([2, 4, 8]), third).alias("num_workers"),
        F.get(F.lit([4, 8, 16]), ninth).alias("batch_size"),
        time.alias("total_time"),
        F.lit(SAMPLES_PER_RUN).cast("bigint").alias("samples_processed"),
        runs.safe_ratio(F.lit(float(SAMPLES_PER_RUN)), time).alias("samples_per_second"),
        F.col("user_id").cast("double").alias("memory_usage_mb"),
        F.col("user_id").cast("double").alias("peak_memory_mb"),
        (~failed).alias("success"),
        F.when(failed, F.lit("failed")).alias("error"),
    )


# --- the same roles in SQL, for the oracle ------------------------------------

TO_BYTE = "least(255, greatest(0, floor((x::DOUBLE + 1.0::DOUBLE) * 127.5::DOUBLE)))::INTEGER"

SQL_FRAMES = f"""frames AS (
  SELECT label AS clip, vec_id,
         row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_idx,
         count(*) OVER (PARTITION BY label) AS total_frames, embedding[1] AS lead,
         list_transform(list_transform(range(192), lambda j: embedding[(j // 3 + 21 * (j % 3)) % 64 + 1]), lambda x: {TO_BYTE}) AS px,
         list_transform(embedding, lambda x: {TO_BYTE}) AS grey
  FROM embeddings)"""

SQL_WANTED = """wanted AS (
  SELECT clip, k, CASE WHEN k = 15 THEN total_frames - 1
                       ELSE floor(k * ((total_frames - 1) / 15.0::DOUBLE))::BIGINT END AS frame_idx
  FROM (SELECT DISTINCT clip, total_frames FROM frames) c, range(16) r(k))"""

SQL_RUNS = """runs AS (
  SELECT event_type || ' run ' || event_id AS name, event_type AS framework, event_type AS method,
         event_id AS run_no, [2, 4, 8][event_id % 3 + 1] AS num_workers,
         [4, 8, 16][(event_id // 3) % 3 + 1] AS batch_size, value AS total_time,
         200 AS samples_processed, CASE WHEN value > 0 THEN 200.0::DOUBLE / value ELSE 0 END AS samples_per_second,
         user_id::DOUBLE AS memory_usage_mb, event_type <> 'error' AS success, user_id
  FROM events)"""

SQL_MEAN = "[0.485::DOUBLE, 0.456::DOUBLE, 0.406::DOUBLE]"
SQL_STD = "[0.229::DOUBLE, 0.224::DOUBLE, 0.225::DOUBLE]"


def sql_normalize(px: str) -> str:
    return (
        f"list_transform({px}, lambda x, i: (x / 255.0::DOUBLE - {SQL_MEAN}[(i - 1) % 3 + 1])"
        f" / {SQL_STD}[(i - 1) % 3 + 1])"
    )
