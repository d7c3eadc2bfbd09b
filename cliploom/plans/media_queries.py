"""Queries for sources and sinks (S*) and path and header functions (P1, P2, P4, P5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.functions.paths import video_name as name_of
from cliploom.functions.sampling import frame_at, sample_timestamps
from cliploom.operators import batches, clips, observe
from cliploom.plans import hosting as host
from cliploom.plans.registry import query
from cliploom.session import scratch_path
from cliploom.sources import dataset, media, runlog
from cliploom.streaming import items as streams


@query("S1", "SELECT page_id, url AS video_path FROM pages WHERE ends_with(url, '.html')")
def listing_by_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.with_suffix(host.listing(spark, sf_dir), [".html"])


@query(
    "S2",
    "SELECT page_id, url AS video_path FROM pages"
    " WHERE ends_with(url, '.html') OR ends_with(url, '/') OR ends_with(url, '#top')",
)
def listing_by_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.with_suffix(host.listing(spark, sf_dir), [".html", "/", "#top"])


@query("S3", "SELECT count(*) AS files_found FROM pages WHERE ends_with(url, '.html')")
def files_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.files_found(media.with_suffix(host.listing(spark, sf_dir), [".html"]))


@query("S4", "SELECT url AS video_path FROM pages")
def items_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.items_from(host.table(spark, sf_dir, "pages"), "url")


@query("S5", "SELECT page_id, url AS video_path FROM pages ORDER BY page_id LIMIT 200")
def sample_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.first_n(host.listing(spark, sf_dir), 200, "page_id")


@query("S6", "SELECT url AS video_path, string_split(url, '/')[-1] AS video_name, false AS processed FROM pages")
def lazy_metadata_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.lazy_scan(host.listing(spark, sf_dir))


@query("S7", "SELECT lang, count(*) AS clips, sum(n_chars)::BIGINT AS total_frames FROM documents GROUP BY lang")
def dataset_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = host.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    path = dataset.save(docs, scratch_path(spark, "dataset"), buckets=4, key="doc_id")
    saved = dataset.load(spark, path)
    return saved.groupBy("lang").agg(F.count(F.lit(1)).alias("clips"), F.sum("n_chars").alias("total_frames"))


@query("S8", "SELECT doc_id, quality, toxic FROM labels")
def dataset_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = host.table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    path = dataset.save(labels, scratch_path(spark, "dataset"))
    return dataset.load(spark, path, labels.schema)


@query(
    "S9",
    f"""WITH {host.SQL_RUNS}
SELECT name, num_workers, batch_size, round(total_time, 6) AS total_time, samples_processed, success FROM runs""",
)
def results_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = runlog.write_csv(host.run_log(spark, sf_dir), scratch_path(spark, "results"))
    log = runlog.read_csv(spark, path)
    time = F.round("total_time", 6).alias("total_time")
    return log.select("name", "num_workers", "batch_size", time, "samples_processed", "success")


@query(
    "S10",
    """WITH ds AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS video_idx FROM embeddings),
asked AS (SELECT vec_id AS asked_by, row_number() OVER (ORDER BY md5('5|' || vec_id), vec_id) - 1 AS video_idx
          FROM embeddings)
SELECT asked_by, video_idx, vec_id, label, (SELECT count(*) FROM ds) AS length FROM asked JOIN ds USING (video_idx)""",
)
def random_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of an indexed dataset, fetched by position in the order of a random sampler."""
    rows = host.table(spark, sf_dir, "embeddings").select("vec_id", "label")
    ds = dataset.indexed(rows, ["vec_id"], unique=True)
    asked = batches.shuffle(rows.select(F.col("vec_id").alias("asked_by")), ["asked_by"], seed=5, idx="video_idx", unique=True)
    return dataset.gather(ds, asked).withColumn("length", F.lit(dataset.length(ds)))


@query("S11", "SELECT event_id, event_type, round(value, 6) AS value FROM events")
def streamed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = host.table(spark, sf_dir, "events").schema
    stream = streams.stream_table(spark, f"{sf_dir}/events.parquet", schema)
    rows = stream.select("event_id", "event_type", F.round("value", 6).alias("value"))
    path = streams.run_available(rows, scratch_path(spark, "stream"), scratch_path(spark, "stream-state"))
    return dataset.load(spark, path, "event_id bigint, event_type string, value double")


@query("P1", "SELECT page_id, string_split(url, '/')[-1] AS video_name FROM pages")
def video_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host.listing(spark, sf_dir).select("page_id", name_of(F.col("video_path")).alias("video_name"))


@query(
    "P2",
    "SELECT d.doc_id, coalesce(l.quality + 1, 0)::BIGINT AS video_size"
    " FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
)
def video_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = host.table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") + 1).alias("video_size"))
    return media.with_sizes(host.table(spark, sf_dir, "documents").select("doc_id"), sizes, on="doc_id")


@query(
    "P4",
    """WITH t AS (SELECT doc_id, n_chars, k, CASE WHEN k = 15 THEN n_chars / 25.0::DOUBLE
                                               ELSE k * ((n_chars / 25.0::DOUBLE) / 15.0::DOUBLE) END AS ts
           FROM documents, range(16) r(k))
SELECT doc_id, k, round(ts, 6) AS ts, least(floor(ts * 25)::BIGINT, n_chars - 1) AS frame_idx FROM t""",
)
def timestamp_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = host.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    times = F.posexplode(sample_timestamps(F.col("n_chars") / F.lit(25.0), host.N_FRAMES)).alias("k", "ts")
    frame = frame_at(F.col("ts"), F.lit(25.0), F.col("n_chars")).alias("frame_idx")
    return docs.select("doc_id", "n_chars", times).select("doc_id", "k", F.round("ts", 6).alias("ts"), frame)


@query(
    "P5",
    """SELECT d.doc_id, coalesce(l.quality, 1000)::BIGINT AS nb_frames, coalesce(l.toxic, 10)::DOUBLE AS duration
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def clip_metadata_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers = host.table(spark, sf_dir, "labels")
    probed = host.table(spark, sf_dir, "documents").select("doc_id").join(headers, "doc_id", "left")
    filled = media.with_header_defaults(probed, F.col("quality"), F.col("toxic"))
    return filled.select("doc_id", "nb_frames", "duration")


@query(
    "P20",
    f"""WITH {host.SQL_FRAMES} SELECT array_to_string(px, ',') AS frames FROM frames""",
)
def column_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = host.frame_pixels(spark, sf_dir).withColumn("frames", F.array_join("px", ","))
    return clips.select_columns(frames, "frames")
