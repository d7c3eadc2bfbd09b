"""Queries for batch operators (B*)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.functions import kernels, pixels
from cliploom.functions.paths import video_name
from cliploom.operators import batches, clips, fallback
from cliploom.plans import hosting as host
from cliploom.plans.registry import query
from cliploom.sources import dataset, media

_SQL_INDEXED = "ds AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS idx FROM events)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host.table(spark, sf_dir, "events").select("event_id", "value")


def _batched_events(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    return batches.assign(_events(spark, sf_dir), ["event_id"], size, unique=True)


@query("B1", "SELECT doc_id, upper(lang) AS lang, n_chars / 25.0::DOUBLE AS duration FROM documents")
def row_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = host.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    mapped = batches.map_rows(docs, lang=F.upper("lang"), duration=F.col("n_chars") / F.lit(25.0))
    return mapped.select("doc_id", "lang", "duration")


@query("B1", "SELECT doc_id, lang || '-' || source AS label, n_chars // 25 AS seconds FROM documents")
def row_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    def describe(row: dict) -> dict:
        return {"doc_id": row["doc_id"], "label": f"{row['lang']}-{row['source']}", "seconds": row["n_chars"] // 25}

    docs = host.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return batches.map_function(docs, describe, "doc_id bigint, label string, seconds bigint")


@query(
    "B2",
    f"""WITH {host.SQL_FRAMES}, valued AS (SELECT vec_id, {host.sql_normalize("px")} AS v FROM frames)
SELECT vec_id, round(list_sum(v) / len(v), 6) AS mean_value FROM valued""",
)
def batch_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = host.FRAME[0] * host.FRAME[1]

    def normalised_means(batch: pa.RecordBatch) -> pa.RecordBatch:
        px = batch.column("px").flatten().to_numpy().reshape(-1, size, host.FRAME[2])
        means = kernels.normalize(px, "float64").mean(axis=(1, 2))
        return pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(means)], ["vec_id", "mean_value"])

    frames = host.frame_pixels(spark, sf_dir).select("vec_id", "px")
    mapped = batches.map_batches(frames, normalised_means, "vec_id bigint, mean_value double", size=256)
    return mapped.withColumn("mean_value", F.round("mean_value", 6))


@query("B3", f"WITH {_SQL_INDEXED} SELECT event_id, idx, idx // 16 AS batch_id FROM ds")
def batch_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = host.table(spark, sf_dir, "events").select("event_id")
    return batches.assign(events, ["event_id"], 16, unique=True)


@query("B4", f"WITH {_SQL_INDEXED} SELECT idx // 16 AS batch_id, round(avg(value), 6) AS batch_mean FROM ds GROUP BY 1")
def batch_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = batches.batch_mean(_batched_events(spark, sf_dir, 16), "value")
    return means.withColumn("batch_mean", F.round("batch_mean", 6))


@query(
    "B5",
    """WITH ds AS (SELECT *, row_number() OVER (ORDER BY page_id) - 1 AS idx FROM pages)
SELECT idx // 4 AS batch_id, count(*) AS batch_size, string_agg(url, ' ' ORDER BY idx) AS paths,
       string_agg(string_split(url, '/')[-1], ' ' ORDER BY idx) AS names
FROM ds GROUP BY 1""",
)
def batch_collate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = host.listing(spark, sf_dir).withColumn("video_name", video_name(F.col("video_path")))
    collated = batches.collate(batches.assign(pages, ["page_id"], 4, unique=True), ["video_path", "video_name"])
    return collated.select(
        "batch_id",
        "batch_size",
        F.array_join("video_paths", " ").alias("paths"),
        F.array_join("video_names", " ").alias("names"),
    )


@query(
    "B6",
    "SELECT event_id, row_number() OVER (ORDER BY md5('42|' || event_id), event_id) - 1 AS idx FROM events",
)
def shuffle_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.shuffle(host.table(spark, sf_dir, "events").select("event_id"), ["event_id"], seed=42, unique=True)


@query("B7", "SELECT lang, count(*) AS clips, sum(n_chars)::BIGINT AS total_frames FROM documents GROUP BY lang")
def repartition_invariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = host.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    spread = batches.repartition(docs, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return spread.groupBy("lang").agg(F.count(F.lit(1)).alias("clips"), F.sum("n_chars").alias("total_frames"))


@query(
    "B8",
    f"""WITH {host.SQL_FRAMES}
SELECT 'raw' AS kind, clip, round(avg(list_sum(px) / len(px)), 6) AS mean_value FROM frames GROUP BY clip
UNION ALL
SELECT 'normalised', clip, round(avg(list_sum(v) / len(v)), 6)
FROM (SELECT clip, {host.sql_normalize("px")} AS v FROM frames) n GROUP BY clip""",
)
def preloaded_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both means read one stored set of byte frames."""
    loaded = dataset.preload(host.frame_pixels(spark, sf_dir), how="store")
    raw = clips.mean_per_clip(loaded, ["clip"], "px")
    normalised = clips.mean_per_clip(loaded.withColumn("px", pixels.normalize(F.col("px"))), ["clip"], "px")
    both = raw.withColumn("kind", F.lit("raw")).unionByName(normalised.withColumn("kind", F.lit("normalised")))
    return both.select("kind", "clip", F.round("mean_value", 6).alias("mean_value"))


@query(
    "B9",
    """SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'new' ELSE 'stored' END AS origin,
       coalesce(l.quality, n_chars % 2)::BIGINT AS result
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def incremental_processing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = host.table(spark, sf_dir, "labels")
    stored = labels.select("doc_id", F.lit("stored").alias("origin"), F.col("quality").cast("bigint").alias("result"))

    def process(new: DataFrame) -> DataFrame:
        return new.select("doc_id", F.lit("new").alias("origin"), (F.col("n_chars") % 2).alias("result"))

    wanted = host.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return dataset.incremental(wanted, stored, "doc_id", process)


@query(
    "B10",
    """WITH ranked AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn
  FROM events WHERE event_type = 'purchase')
SELECT u.user_id, coalesce(event_type, 'none') AS method, round(coalesce(value, 0.0), 6) AS total_time
FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN ranked r ON u.user_id = r.user_id AND rn = 1""",
)
def decoder_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = host.table(spark, sf_dir, "events").select(
        "user_id",
        F.col("event_id").alias("run_no"),
        F.col("event_type").alias("method"),
        (F.col("event_type") != "error").alias("success"),
        F.col("value").alias("total_time"),
    )
    order = ["signup", "click", "view", "purchase", "error"]
    chosen = fallback.choose(attempts, "user_id", order, "total_time", 0.0, prefer="purchase")
    return chosen.withColumn("total_time", F.round("total_time", 6))


@query(
    "B11",
    """WITH tail AS (SELECT page_id, string_split(url, '/')[-1] AS name FROM pages),
parsed AS (SELECT page_id, name, TRY_CAST(name AS INTEGER) AS parsed FROM tail)
SELECT page_id, parsed, CASE WHEN parsed IS NULL THEN 'error' ELSE 'ok' END AS status,
       CASE WHEN parsed IS NULL THEN 'cannot read ' || name END AS error
FROM parsed""",
)
def failure_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    tried = fallback.attempt(video_name(F.col("video_path")), "int")
    return host.listing(spark, sf_dir).withColumns(tried).select("page_id", "parsed", "status", "error")


@query(
    "B12",
    f"""WITH {_SQL_INDEXED}
SELECT idx // 16 AS batch_id, idx // 16 + 1 AS batch_no, max(idx) + 1 AS samples_done
FROM ds GROUP BY idx // 16 HAVING (idx // 16 + 1) % 5 = 0""",
)
def progress_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = batches.progress(_batched_events(spark, sf_dir, 16), every=5)
    return done.select("batch_id", "batch_no", "samples_done")


@query(
    "B13",
    f"""WITH {host.SQL_FRAMES}, n AS (SELECT {host.sql_normalize("px")} AS v FROM frames),
totals AS (SELECT count(*) AS samples, round(avg(list_sum(v) / len(v)), 6) AS mean_value FROM n)
SELECT mode, samples, mean_value FROM totals, (VALUES ('lazy'), ('eager')) m(mode)""",
)
def lazy_vs_eager(spark: SparkSession, sf_dir: str) -> DataFrame:
    lazy = host.frame_pixels(spark, sf_dir)
    eager = dataset.preload(lazy, how="store")

    def totals(df: DataFrame, mode: str) -> DataFrame:
        value = pixels.mean_value(pixels.normalize(F.col("px")))
        mean = F.round(F.avg(value), 6).alias("mean_value")
        return df.agg(F.count(F.lit(1)).alias("samples"), mean).withColumn("mode", F.lit(mode))

    return totals(lazy, "lazy").unionByName(totals(eager, "eager"))


@query(
    "S1 P1 S6",
    """SELECT page_id, string_split(url, '/')[-1] AS video_name, row_number() OVER (ORDER BY url) - 1 AS video_idx
FROM pages WHERE ends_with(url, '.html')""",
)
def indexed_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = media.with_suffix(host.listing(spark, sf_dir), [".html"])
    named = dataset.indexed(listed, ["video_path", "page_id"])
    return named.select("page_id", video_name(F.col("video_path")).alias("video_name"), "video_idx")
