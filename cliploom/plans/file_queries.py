"""Queries on files that come while a stream runs. Spark writes them from ``pages``: a file per page, named after it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.functions.paths import video_name
from cliploom.plans import decode_queries
from cliploom.plans import hosting as host
from cliploom.plans.registry import query
from cliploom.session import scratch_path
from cliploom.sources import dataset
from cliploom.streaming import items as streams
from cliploom.streaming import refresh

LOTS = 3
SETTLE = 0.2  # one machine's clock


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, lot, name, content): plain and hidden names in four folders, every fifth file empty."""
    page = F.col("page_id")
    prefix = F.get(F.lit(["", "_", "."]), (page % 3).cast("int"))
    name = F.concat(F.lit("folder-"), (page % 4).cast("string"), F.lit("/"), prefix, page.cast("string"), F.lit(".mp4"))
    content = F.when(page % 5 == 0, F.lit("")).otherwise(F.col("url")).cast("binary")
    return host.table(spark, sf_dir, "pages").select("page_id", (page % LOTS).alias("lot"), name.alias("name"), content.alias("content"))


def put_files(rows: DataFrame, folder: str) -> None:
    """Write each row's content to its name below a folder. A file appears when it is complete."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, base = pafs.FileSystem.from_uri(folder)
        draft = f"{base}/.draft-{TaskContext.get().taskAttemptId()}"
        for batch in batches:
            for name, content in zip(*(batch.column(c).to_pylist() for c in ("name", "content")), strict=True):
                file = f"{base}/{name}"
                target.create_dir(file.rpartition("/")[0])
                with target.open_output_stream(draft) as out:
                    out.write(content)
                target.move(draft, file)
            yield batch.select(["name"])

    rows.select("name", "content").mapInArrow(write, "name string").write.format("noop").mode("overwrite").save()


def _shared_folder(spark: SparkSession, tag: str) -> str:
    folder = scratch_path(spark, tag).removeprefix("file:")
    filesystem, base = pafs.FileSystem.from_uri(folder)
    filesystem.create_dir(base)
    return folder


def _page_of(path: Column) -> Column:
    return F.regexp_extract(video_name(path), r"(\d+)\.mp4$", 1).cast("bigint")


@query(
    "S1 S11",
    "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 0 ELSE strlen(url) END AS video_size, 1 AS times FROM pages",
)
def streamed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that come in three lots, each followed by a trigger, and once more when nothing came: every file exactly once."""
    pages, folder = page_files(spark, sf_dir), _shared_folder(spark, "arrivals")
    out, state = scratch_path(spark, "arrived"), scratch_path(spark, "arrived-state")
    for lot in range(LOTS + 1):
        put_files(pages.where(F.col("lot") == lot), folder)
        streams.run_available(streams.stream_files(spark, folder, settle=SETTLE), out, state)
    found = dataset.load(spark, out, "video_path string, video_size bigint")
    return found.groupBy(_page_of(F.col("video_path")).alias("page_id")).agg(
        F.max("video_size").alias("video_size"), F.count(F.lit(1)).alias("times")
    )


def clip_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lot, name, content): each vector as a clip of one frame. In the first lot a third are junk and a third are empty; in
    the second every other one of the junk is mended."""
    vec = F.col("vec_id")
    pixels = F.transform("px", lambda x: F.lpad(F.hex(x.cast("int")), 2, "0"))
    head = decode_queries.HEADER + b"FRAME\n"
    clip = F.concat(F.lit(bytearray(head)), F.unhex(F.array_join(pixels, "")))
    kind = vec % 3
    first = F.when(kind == 0, clip).when(kind == 1, F.lit(bytearray(b"not a video"))).otherwise(F.lit(bytearray()))
    frames = host.grey_pixels(spark, sf_dir)
    name = F.concat((vec % 10).cast("string"), F.lit("/"), vec.cast("string"), F.lit(".mp4")).alias("name")
    mended = frames.where((kind == 1) & (vec % 2 == 1)).select(F.lit(1).alias("lot"), name, clip.alias("content"))
    return frames.select(F.lit(0).alias("lot"), name, first.alias("content")).unionByName(mended)


@query(
    "B9 B11 S11",
    f"""WITH {host.SQL_FRAMES}, clip AS (
  SELECT vec_id, vec_id % 3 AS kind, vec_id % 2 AS odd, {decode_queries.SQL_FRAME_MEAN} AS mean FROM frames)
SELECT vec_id, CASE WHEN kind = 1 AND odd = 1 THEN 2 ELSE 1 END AS opened,
       CASE WHEN kind = 2 THEN 'empty' WHEN kind = 1 AND odd = 0 THEN 'error' ELSE 'ok' END AS status,
       round(CASE WHEN kind = 2 THEN {decode_queries.SQL_ZERO_MEAN} WHEN kind = 1 AND odd = 0 THEN 0 ELSE mean END, 6) AS mean_value
FROM clip""",
)
def refreshed_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream that is told of all files three times: it opens what is new or changed and nothing else."""
    versions, folder = clip_versions(spark, sf_dir), _shared_folder(spark, "versions")
    out, state = scratch_path(spark, "refreshed"), scratch_path(spark, "refreshed-state")
    spec = decode_queries.SPEC
    process = refresh.clip_mean(spec.decoders, spec.n_frames, spec.height, spec.width)
    step = lambda rows: refresh.refreshed(rows, process, refresh.MEANS, attempts=1)
    for lot in range(3):
        put_files(versions.where(F.col("lot") == lot), folder)
        streams.run_available(streams.stream_files(spark, folder, settle=SETTLE, again=True), out, state, step)
    tried = dataset.load(spark, out, f"{refresh.COLUMNS}, {refresh.MEANS}")
    opened = tried.groupBy("video_path").agg(F.count(F.lit(1)).alias("opened"))
    last = refresh.latest(tried).join(opened, "video_path")
    vec_id = _page_of(F.col("video_path")).alias("vec_id")
    return last.select(vec_id, "opened", "status", F.round("mean_value", 6).alias("mean_value"))
