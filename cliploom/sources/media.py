"""Media files: listing, metadata scan, header probe, image folders."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom import schemas
from cliploom.functions.paths import VIDEO_SUFFIXES, has_suffix, known_size, plain_path, video_name
from cliploom.functions.sampling import duration_or_default, frames_or_default, sample_indices, sample_timestamps
from cliploom.operators.frames import OpenClip
from cliploom.sources import listing

__all__ = [
    "VIDEO_SUFFIXES",
    "files_found",
    "first_n",
    "images",
    "items",
    "items_from",
    "lazy_scan",
    "list_binary_files",
    "list_media",
    "probe",
    "require_media",
    "sample_indices",
    "sample_timestamps",
    "with_header_defaults",
    "with_sizes",
    "with_suffix",
]


def list_media(
    spark: SparkSession, base: str, suffixes: Sequence[str] = (".mp4",), sizes: bool = True, budget: int = 50_000
) -> DataFrame:
    """Files below ``base`` whose name ends with a suffix (case-sensitive), at any depth.

    ``base`` is a path that every executor mounts, or a URI of a file system that PyArrow knows
    (``file://``, ``s3://``, ``gs://``, ``hdfs://``); for others there is ``list_binary_files``. Includes empty
    files and names that start with ``_`` or ``.``. The tree is read once, now. A folder that cannot
    be read is a row with its path and an ``error``; a base that does not exist is an error.
    """
    return listing.walk(spark, base, suffixes, sizes, budget)


def list_binary_files(spark: SparkSession, base: str, suffixes: Sequence[str] = (".mp4",)) -> DataFrame:
    """The same by Spark's own reader, for file systems that only it knows. Only path and length are read.

    Spark leaves out empty files and names that start with ``_`` or ``.``.
    """
    pattern = "*{" + ",".join(suffixes) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    return files.load(base).select(F.col("path").alias("video_path"), F.col("length").alias("video_size"))


def items_from(df: DataFrame, path: str, *keep: str) -> DataFrame:
    """Treat a table with a path column as a listing."""
    return df.select(*keep, F.col(path).alias("video_path"))


def with_suffix(items: DataFrame, suffixes: Sequence[str]) -> DataFrame:
    """Rows whose path ends with one of the suffixes."""
    return items.where(has_suffix(F.col("video_path"), suffixes))


def items(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """A small list of paths held by the caller as a listing."""
    return spark.createDataFrame([(p,) for p in paths], "video_path string")


def files_found(listing: DataFrame) -> DataFrame:
    return listing.agg(F.count(F.lit(1)).alias("files_found"))


def require_media(listing: DataFrame) -> DataFrame:
    """The listing itself, or an error when it has no rows."""
    if listing.isEmpty():
        raise FileNotFoundError("no media files found")
    return listing


def first_n(listing: DataFrame, n: int, *order: str) -> DataFrame:
    """First n rows of the ordered list. Apply before decode."""
    return listing.orderBy(*order).limit(n)


def lazy_scan(listing: DataFrame) -> DataFrame:
    """Path, name and a false ``processed`` flag. Content columns are pruned."""
    path = F.col("video_path")
    return listing.select("video_path", video_name(path).alias("video_name"), F.lit(False).alias("processed"))


def with_sizes(clips: DataFrame, listing: DataFrame, on: str = "video_path") -> DataFrame:
    """Add ``video_size`` from a listing with one row per key; 0 where the file is missing."""
    return clips.join(listing, on, "left").withColumn("video_size", known_size(F.col("video_size")))


def with_header_defaults(probed: DataFrame, frames: Column, duration: Column) -> DataFrame:
    """Frame count and duration, or the assumed values where the header has none."""
    return probed.withColumns({"nb_frames": frames_or_default(frames), "duration": duration_or_default(duration)})


def probe(found: DataFrame, decoders: Sequence) -> DataFrame:
    """Read file headers: ``schemas.CLIPS`` from rows of (video_idx, video_path, video_size).

    An empty file is a clip with 0 frames. A file that no decoder opens is a row with
    ``status = error``.
    """
    chain = list(decoders)
    schema = schemas.arrow(schemas.CLIPS)
    narrow = found.select(
        "video_idx", "video_path", video_name(F.col("video_path")).alias("video_name"),
        known_size(F.col("video_size")).alias("video_size"),
    )

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            infos = [_probe_one(chain, path) for path in batch.column("video_path").to_pylist()]
            if infos:
                headers = schemas.arrow_batch(infos, pa.schema(list(schema)[4:]))
                yield pa.RecordBatch.from_arrays([*batch.columns, *headers.columns], schema=schema)

    return narrow.mapInArrow(run, schemas.CLIPS)


def _probe_one(chain: Sequence, path: str) -> tuple:
    opened = OpenClip(chain, path)
    if opened.error is not None:
        return (0, None, None, None, schemas.ERROR, opened.error)
    try:
        clip = opened.clip
        status = schemas.OK if clip.total_frames > 0 else schemas.EMPTY
        return (clip.total_frames, clip.fps, clip.width, clip.height, status, None)
    finally:
        opened.close()


def images(spark: SparkSession, base: str) -> DataFrame:
    """Folders of still images as frames: the folder is the clip, file order is frame order.

    Uses Spark's ``image`` source. Its pixels are BGR; files it cannot read become rows
    with ``status = error`` and null pixels.
    """
    image = F.col("image")
    failed = image.width < 0
    files = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(base)
    return image_names(files.withColumn("video_path", image.origin)).select(
        "video_path",
        "frame_name",
        *[F.when(~failed, image[theirs]).alias(ours) for theirs, ours in _IMAGE_FIELDS.items()],
        F.lit("HWC").alias("layout"),
        F.when(failed, schemas.ERROR).otherwise(schemas.OK).alias("status"),
    )


_IMAGE_FIELDS = {"height": "height", "width": "width", "nChannels": "channels", "data": "data"}


def image_names(files: DataFrame) -> DataFrame:
    """Split the path of an image into ``video_path`` (its folder) and ``frame_name``."""
    path = plain_path(F.col("video_path"))
    parts = {"frame_name": video_name(path), "video_path": F.regexp_replace(path, "/[^/]*$", "")}
    return files.withColumns(parts).drop("video_size")
