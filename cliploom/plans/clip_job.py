"""The whole job: list files, sample, decode, normalise, batch, mean.

Keys and indices are shuffled while rows are narrow. Pixels appear in the decode task
and stay there: decode, resize and stacking happen in one pass, and a mean leaves the
task as one number per clip.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom import schemas
from cliploom.functions.paths import known_size
from cliploom.operators import batches, frames
from cliploom.operators.index import dense_index
from cliploom.operators.sizing import members
from cliploom.session import shared_dir, ship_package
from cliploom.sources import dataset, media
from cliploom.sources.decoders import DEFAULT_DECODERS

IMAGE_SUFFIXES = (".bmp", ".png", ".jpg")


@dataclass(frozen=True)
class ClipSpec:
    n_frames: int = 16
    height: int = 224
    width: int = 224
    method: str = "bilinear"
    batch_size: int = 4
    clips_per_task: int = 64
    decoders: Sequence = DEFAULT_DECODERS
    prefer: str | None = None
    sample_by: str = "frame"  # or "time"


def clips(listing: DataFrame, spec: ClipSpec = ClipSpec()) -> DataFrame:
    """Index the listing by path and read each header: ``schemas.CLIPS`` with ``batch_id``.

    The headers are read once: this small table is checkpointed, in tasks of equal size
    that hold whole batches.
    """
    spark = ship_package(listing.sparkSession)
    indexed = dataset.indexed(listing, ["video_path", "video_size"])
    tasks = frames.tasks_for(indexed.count(), spec.clips_per_task, spark.sparkContext.defaultParallelism)
    even = batches.with_batch_id(indexed, spec.batch_size, idx="video_idx").repartition(tasks, "batch_id")
    chain = frames.ordered_chain(spec.decoders, spec.prefer)
    probed = media.probe(even.sortWithinPartitions("video_idx"), chain).checkpoint()
    return batches.with_batch_id(probed, spec.batch_size, idx="video_idx")


def requests(clips_df: DataFrame, spec: ClipSpec = ClipSpec()) -> DataFrame:
    """Frames to read. The clips lie in even tasks already, so nothing is shuffled."""
    by_time = {"fps": "fps"} if spec.sample_by == "time" else {}
    return frames.fan_out(clips_df, spec.n_frames, **by_time).select(
        "video_idx", "video_path", "video_size", "k", "frame_idx", "error"
    )


def frame_rows(clips_df: DataFrame, spec: ClipSpec = ClipSpec()) -> DataFrame:
    """``schemas.FRAMES``: one row per sampled frame, frames of a clip in different tasks."""
    rows = clips_df.count() * spec.n_frames
    wanted = requests(clips_df, spec)
    least = clips_df.sparkSession.sparkContext.defaultParallelism
    spread = frames.spread(wanted, frames.tasks_for(rows, spec.clips_per_task * spec.n_frames, least))
    return frames.decode(spread, spec.decoders, spec.height, spec.width, spec.method, spec.prefer)


def tensors(clips_df: DataFrame, spec: ClipSpec = ClipSpec()) -> DataFrame:
    """``schemas.TENSORS``: one row of bytes per clip."""
    return frames.decode_stacked(
        requests(clips_df, spec), spec.decoders, spec.height, spec.width, spec.method, spec.prefer
    )


def collated(clips_df: DataFrame, spec: ClipSpec = ClipSpec(), dtype: str = "float32") -> DataFrame:
    """``schemas.BATCHES``: normalised training batches, collated where they are decoded.

    A batch is one binary value, which holds 2 GiB at most; larger ones are refused here.
    """
    size = spec.batch_size * spec.n_frames * spec.height * spec.width * 3 * np.dtype(dtype).itemsize
    if size >= 1 << 31:
        raise ValueError(f"a batch of {spec.batch_size} clips takes {size} bytes; 2 GiB is the limit")
    return frames.decode_batches(
        requests(clips_df, spec), spec.decoders, spec.height, spec.width, spec.batch_size, spec.method, spec.prefer, dtype
    )


def refresh(listing: DataFrame, path: str, spec: ClipSpec = ClipSpec()) -> DataFrame:
    """Bring the tensors at ``path`` up to date with a listing; return the dataset.

    Files that are new, that have another size than before, or that failed before are read; all others are neither opened
    nor read, and their rows stay where they are. New rows get the next indices; of a path the row with the highest
    index counts, and ``current`` picks it. Only paths, sizes and states are compared.
    """
    spark = listing.sparkSession
    first = 0
    try:
        stored = current(dataset.load(spark, path, schemas.TENSORS)).where(F.col("status") != schemas.ERROR)
        known = stored.select("video_path", known_size(F.col("video_size")).alias("video_size"))
        sized = listing.withColumn("video_size", known_size(F.col("video_size")))
        listing = sized.join(known, ["video_path", "video_size"], "left_anti")
        first = dataset.load(spark, path, schemas.TENSORS).agg(F.coalesce(F.max("video_idx") + 1, F.lit(0))).first()[0]
    except FileNotFoundError:
        pass
    new = tensors(clips(listing, spec), spec)
    new.withColumn("video_idx", F.col("video_idx") + first).write.mode("append").parquet(path)
    return current(dataset.load(spark, path, schemas.TENSORS))


def current(stored: DataFrame) -> DataFrame:
    """Of each path the row with the highest index. Finds it by key; rows with pixels are tested by their index where they are read."""
    latest = stored.groupBy("video_path").agg(F.max("video_idx").alias("video_idx"))
    shared_dir(stored.sparkSession)
    return members(stored, latest, "video_idx")


def accounted(listing: DataFrame, spec: ClipSpec = ClipSpec()) -> DataFrame:
    """Files listed against what the decode job made of them: one row.

    ``processed`` are the rows that leave the job, ``decoded`` those with frames of the file, and
    ``complete`` says whether every listed file has a row.
    """
    done = clip_means(clips(listing, spec), spec)
    states = {
        "decoded": F.col("status").isin(schemas.OK, schemas.ZERO_FILLED),
        "empty": F.col("status") == schemas.EMPTY,
        "failed": F.col("status") == schemas.ERROR,
    }
    out = done.agg(F.count(F.lit(1)).alias("processed"), *(F.count_if(c).alias(n) for n, c in states.items()))
    out = out.withColumn("listed", listing.agg(F.count(F.lit(1))).scalar())
    return out.withColumn("complete", F.col("listed") == F.col("processed"))


def image_frames(spark: SparkSession, base: str, spec: ClipSpec = ClipSpec(), suffixes=IMAGE_SUFFIXES) -> DataFrame:
    """Clips given as folders of images: (video_path, k, frame_idx, …) with the sampled frames.

    Names are indexed and sampled first; pixels are joined to the sampled names. A file that is empty or not an image
    becomes a zero frame, and so does one whose name starts with ``_`` or ``.``, which Spark's reader leaves out. A folder
    that cannot be read is a clip with ``status = error``.
    """
    ship_package(spark)
    listed = media.list_media(spark, base, suffixes, sizes=False)
    names = media.image_names(listed.where("error IS NULL").drop("error"))
    keyed = dense_index(names, ["frame_name"], by=["video_path"], name="frame_idx", unique=True)
    lengths = keyed.groupBy("video_path").agg(F.count(F.lit(1)).alias("total_frames"))
    wanted = frames.fan_out(lengths, spec.n_frames).drop("total_frames")
    files = frames.fetch(wanted, keyed, ["video_path", "frame_idx"])
    found = frames.fetch(files, media.images(spark, base), ["video_path", "frame_name"]).drop("status")
    sized = frames.resize(frames.to_rgb(found), spec.height, spec.width, spec.method)
    zeros = F.lit(bytearray(spec.height * spec.width * 3))
    unread = listed.where("error IS NOT NULL").select("video_path", F.lit(0).alias("total_frames"))
    failed = frames.fan_out(unread, spec.n_frames).drop("total_frames")
    failed = failed.withColumns({"data": zeros, "status": F.lit(schemas.ERROR)})
    return frames.zero_fill(sized, zeros).unionByName(failed, allowMissingColumns=True)


def clip_means(clips_df: DataFrame, spec: ClipSpec = ClipSpec()) -> DataFrame:
    """``schemas.CLIP_MEANS``: mean of the normalised frames of each clip."""
    return frames.decode_means(
        requests(clips_df, spec), spec.decoders, spec.height, spec.width, spec.method, spec.prefer
    )


def batch_means(clips_df: DataFrame, spec: ClipSpec = ClipSpec()) -> DataFrame:
    """Mean of each batch of clips. Clips have equal size, so it is the mean of clip means."""
    batched = batches.with_batch_id(clip_means(clips_df, spec), spec.batch_size, idx="video_idx")
    return batches.batch_mean(batched, "mean_value")

