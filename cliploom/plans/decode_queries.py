"""Queries that run the clip job on real files, which Spark writes from ``embeddings``.

Each label's vectors, in order of ``vec_id``, are cut into clips of at most 64 grey 8x8
frames; a clip is one uncompressed video file.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import replace
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom import schemas
from cliploom.functions.paths import video_name
from cliploom.operators import frames
from cliploom.plans import clip_job
from cliploom.plans import hosting as host
from cliploom.plans.registry import query
from cliploom.session import scratch_path
from cliploom.sources import dataset, media
from cliploom.sources.decoders import Y4MDecoder
from cliploom.streaming import items as streams

FRAMES_PER_CLIP = 64
HEADER = b"YUV4MPEG2 W8 H8 F25:1 Ip A1:1 Cmono\n"
SPEC = clip_job.ClipSpec(height=8, width=8, decoders=(Y4MDecoder(),), batch_size=4)

# Files that go wrong: a header that promises more frames than follow, no bytes, and no video.
MISSING_FRAMES = 8

_folders: dict[tuple[str, str, str], str] = {}


def clip_folder(spark: SparkSession, sf_dir: str) -> str:
    """Folder with the clips, written once per application below the shared folder."""
    return _folder(spark, sf_dir, "clips", _clip_keys(spark, sf_dir), _whole_clip)


def broken_folder(spark: SparkSession, sf_dir: str) -> str:
    """Folder with three faulty files per clip: all its frames below a header that promises more, none, and junk."""
    return _folder(spark, sf_dir, "broken", _clip_keys(spark, sf_dir), _faulty_files)


def _clip_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.floor(F.col("frame_idx") / FRAMES_PER_CLIP)
    return host.frame_keys(spark, sf_dir).withColumn("name", F.format_string("%06d-%06d", F.col("clip"), part))


def _whole_clip(name: str, stored: Iterator[bytes]) -> Iterator[tuple[str, Iterable[bytes]]]:
    yield f"{name}.mp4", chain([HEADER], stored)


def _faulty_files(name: str, stored: Iterator[bytes]) -> Iterator[tuple[str, Iterable[bytes]]]:
    own = list(stored)  # FRAMES_PER_CLIP at most
    promised = HEADER.replace(b"\n", f" XFRAMES={len(own) + MISSING_FRAMES}\n".encode())
    yield f"{name}-short.mp4", chain([promised], own)
    yield f"{name}-empty.mp4", []
    yield f"{name}-junk.mp4", [b"not a video"]


Files = Callable[[str, Iterator[bytes]], Iterator[tuple[str, Iterable[bytes]]]]


def _folder(spark: SparkSession, sf_dir: str, kind: str, keys: DataFrame, files: Files) -> str:
    """Write the files of each ``name``; its frames lie in order in one task, 64 at most."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _folders:
        folder = scratch_path(spark, kind).removeprefix("file:")
        tasks = frames.tasks_for(keys.count(), 64 * FRAMES_PER_CLIP, spark.sparkContext.defaultParallelism)
        rows = keys.join(host.grey_pixels(spark, sf_dir), "vec_id").select("name", "frame_idx", "px")
        _write(rows.repartition(tasks, "name").sortWithinPartitions("name", "frame_idx"), folder, files)
        _folders[key] = folder
    return _folders[key]


def _into_place(filesystem: pafs.FileSystem, draft: str, file: str) -> None:
    """Rename a complete file. Another attempt of the task may have been first; its file is as good."""
    if filesystem.get_file_info(file).type == pafs.FileType.File:
        filesystem.delete_file(draft)
    else:
        filesystem.move(draft, file)


def _write(clip_frames: DataFrame, folder: str, files: Files) -> None:
    filesystem, base = pafs.FileSystem.from_uri(folder)
    filesystem.create_dir(base)

    def write(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, base = pafs.FileSystem.from_uri(folder)
        attempt = TaskContext.get().taskAttemptId()
        rows = ((n, p) for b in stream for n, p in zip(b["name"].to_pylist(), b["px"], strict=True))
        for name, clip in groupby(rows, key=lambda r: r[0]):
            stored = (b"FRAME\n" + px.values.to_numpy().astype(np.uint8).tobytes() for _, px in clip)
            for file, content in files(name, stored):
                # Moved into place when complete: a second attempt of the task cannot mix with the first.
                draft = f"{base}/.{file}.{attempt}"
                with target.open_output_stream(draft) as out:
                    for some in content:
                        out.write(some)
                _into_place(target, draft, f"{base}/{file}")
            yield pa.RecordBatch.from_pydict({"name": [name]})

    clip_frames.mapInArrow(write, "name string").write.format("noop").mode("overwrite").save()


_SQL_CLIPS = f"""WITH {host.SQL_FRAMES}, cut AS (
  SELECT printf('%06d-%06d.mp4', clip, frame_idx // 64) AS video_name, frame_idx % 64 AS frame_no, grey FROM frames),
lengths AS (SELECT video_name, count(*) AS total FROM cut GROUP BY video_name)"""

# SQL: mean of a grey frame after normalisation with the three channels' constants.
SQL_FRAME_MEAN = """list_avg(list_transform(grey, lambda x: (
    (x / 255.0::DOUBLE - 0.485::DOUBLE) / 0.229::DOUBLE + (x / 255.0::DOUBLE - 0.456::DOUBLE) / 0.224::DOUBLE
    + (x / 255.0::DOUBLE - 0.406::DOUBLE) / 0.225::DOUBLE) / 3))"""
SQL_ZERO_MEAN = "(-0.485::DOUBLE / 0.229::DOUBLE - 0.456::DOUBLE / 0.224::DOUBLE - 0.406::DOUBLE / 0.225::DOUBLE) / 3"

_SQL_MEANS = f"""{_SQL_CLIPS}, wanted AS (
  SELECT video_name, k, CASE WHEN k = 15 THEN total - 1
                             ELSE floor(k * ((total - 1) / 15.0::DOUBLE))::BIGINT END AS frame_no
  FROM lengths, range(16) r(k)),
means AS (
  SELECT video_name, avg({SQL_FRAME_MEAN}) AS mean_value
  FROM wanted JOIN cut USING (video_name, frame_no) GROUP BY video_name)"""


@query("S1 S2 P1 P2", f"{_SQL_CLIPS} SELECT video_name, {len(HEADER)} + total * 70 AS video_size FROM lengths")
def media_files_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = media.list_media(spark, clip_folder(spark, sf_dir), media.VIDEO_SUFFIXES)
    return listed.select(video_name(F.col("video_path")).alias("video_name"), "video_size")


def _clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clip_job.clips(media.list_media(spark, clip_folder(spark, sf_dir)), SPEC)


@query(
    "P5 B3",
    f"""{_SQL_CLIPS} SELECT row_number() OVER (ORDER BY video_name) - 1 AS video_idx, video_name,
       total AS total_frames, 25.0::DOUBLE AS fps, 8 AS width, 8 AS height, 'ok' AS status FROM lengths""",
)
def clip_headers_probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clips(spark, sf_dir).select(
        "video_idx", "video_name", "total_frames", "fps", "width", "height", "status"
    )


@query(
    "P3 P6 P14 P16 P18 P19 B11",
    f"""{_SQL_MEANS} SELECT video_name, 16 AS frame_count, 'ok' AS status, round(mean_value, 6) AS mean_value FROM means""",
)
def decoded_clip_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named_means(_clips(spark, sf_dir))


def _named_means(job_clips: DataFrame, spec: clip_job.ClipSpec = SPEC) -> DataFrame:
    return _rounded_means(clip_job.clip_means(job_clips, spec))


def _rounded_means(means: DataFrame) -> DataFrame:
    return means.select("video_name", "frame_count", "status", F.round("mean_value", 6).alias("mean_value"))


@query(
    "P4 P6 P19",
    f"""{_SQL_CLIPS}, timed AS (
  SELECT video_name, k, total, CASE WHEN k = 15 THEN total / 25.0::DOUBLE
                                    ELSE k * ((total / 25.0::DOUBLE) / 15.0::DOUBLE) END AS ts
  FROM lengths, range(16) r(k)),
wanted AS (SELECT video_name, k, least(floor(ts * 25)::BIGINT, total - 1) AS frame_no FROM timed)
SELECT video_name, 16 AS frame_count, 'ok' AS status, round(avg({SQL_FRAME_MEAN}), 6) AS mean_value
FROM wanted JOIN cut USING (video_name, frame_no) GROUP BY video_name""",
)
def time_sampled_clip_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames evenly spread over a clip's time."""
    spec = replace(SPEC, sample_by="time")
    return _named_means(clip_job.clips(media.list_media(spark, clip_folder(spark, sf_dir)), spec), spec)


@query(
    "S11 P5 P6 P7 P19",
    f"""{_SQL_MEANS} SELECT video_name, 16 AS frame_count, 'ok' AS status, round(mean_value, 6) AS mean_value FROM means""",
)
def streamed_clip_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clip files as a stream: each new file is probed, decoded and averaged once."""

    def decode(listing: DataFrame) -> DataFrame:
        probed = media.probe(listing.withColumn("video_idx", F.xxhash64("video_path")), SPEC.decoders)
        requests = frames.fan_out(probed, SPEC.n_frames)
        return frames.decode_means(requests, SPEC.decoders, SPEC.height, SPEC.width)

    stream = streams.stream_files(spark, clip_folder(spark, sf_dir))
    path = streams.run_available(stream, scratch_path(spark, "means"), scratch_path(spark, "means-state"), decode)
    return _rounded_means(dataset.load(spark, path, schemas.CLIP_MEANS))


@query(
    "P6 P8 P9 P18 B11",
    f"""{_SQL_CLIPS}, promised AS (SELECT replace(video_name, '.mp4', '') AS name, total, total + {MISSING_FRAMES} AS said FROM lengths),
wanted AS (
  SELECT name, k, CASE WHEN k = 15 THEN said - 1
                       ELSE floor(k * ((said - 1) / 15.0::DOUBLE))::BIGINT END AS frame_no
  FROM promised, range(16) r(k)),
short AS (
  SELECT name, max(w.frame_no) >= max(total) AS cut_off, avg(coalesce({SQL_FRAME_MEAN}, {SQL_ZERO_MEAN})) AS mean_value
  FROM wanted w JOIN promised USING (name) LEFT JOIN cut ON video_name = name || '.mp4' AND cut.frame_no = w.frame_no
  GROUP BY name)
SELECT name || '-short.mp4' AS video_name, 16 AS frame_count, CASE WHEN cut_off THEN 'zero_filled' ELSE 'ok' END AS status,
       round(mean_value, 6) AS mean_value FROM short
UNION ALL SELECT name || '-empty.mp4', 16, 'empty', round({SQL_ZERO_MEAN}, 6) FROM promised
UNION ALL SELECT name || '-junk.mp4', 0, 'error', 0.0::DOUBLE FROM promised""",
)
def faulty_clip_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What truncated, empty and unreadable files come to: flagged rows, and no failed job."""
    return _named_means(clip_job.clips(media.list_media(spark, broken_folder(spark, sf_dir)), SPEC))


@query(
    "S12",
    f"""{_SQL_CLIPS} SELECT 4 * count(*) AS listed, 4 * count(*) AS processed, 2 * count(*) AS decoded,
       count(*) AS empty, count(*) AS failed, true AS complete FROM lengths""",
)
def sample_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole, short, empty and junk files of every clip, against the rows that the decode job returns."""
    folders = (clip_folder(spark, sf_dir), broken_folder(spark, sf_dir))
    whole, broken = (media.list_media(spark, folder) for folder in folders)
    return clip_job.accounted(whole.unionByName(broken), SPEC)


@query(
    "P6 P7",
    f"""{_SQL_MEANS} SELECT video_name, k, frame_no AS frame_idx, list_sum(grey)::BIGINT * 3 AS total
FROM wanted JOIN cut USING (video_name, frame_no)""",
)
def decoded_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single frames, those of one clip in different tasks."""
    rows = clip_job.frame_rows(_clips(spark, sf_dir), SPEC)
    values = frames.to_array(F.col("data"))
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x).cast("bigint").alias("total")
    return rows.select(video_name(F.col("video_path")).alias("video_name"), "k", "frame_idx", total)


@query(
    "B3 B4 B5",
    f"""{_SQL_MEANS}, placed AS (
  SELECT *, (row_number() OVER (ORDER BY video_name) - 1) // 4 AS batch_id FROM means)
SELECT batch_id, count(*) AS batch_size, string_agg(video_name, ' ' ORDER BY video_name) AS names,
       round(avg(mean_value), 6) AS batch_mean
FROM placed GROUP BY batch_id""",
)
def decoded_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collated tensors, reduced to their mean."""
    collated = clip_job.collated(_clips(spark, sf_dir), SPEC, dtype="float64")
    mean = F.round(frames.mean_value(F.col("data"), "float64"), 6).alias("batch_mean")
    return collated.select("batch_id", "batch_size", F.array_join("video_names", " ").alias("names"), mean)
