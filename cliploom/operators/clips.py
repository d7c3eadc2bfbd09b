"""Clip operators: tensors and values per clip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliploom import schemas
from cliploom.functions import pixels


def stack_arrays(frames: DataFrame, keys: list[str], n: int, value: str, order: str = "k") -> DataFrame:
    """Concatenate the n sampled frames of a clip, as one array in order of ``k``.

    A group holds the n frames of one clip whatever the clip's length.
    """
    rows = F.array_sort(F.collect_list(F.struct(order, value)))
    return frames.groupBy(*keys).agg(rows.alias("rows")).select(
        *keys, F.size("rows").alias("n_frames"), F.flatten(F.col(f"rows.{value}")).alias(value)
    )


def stack(frames: DataFrame, n: int, dtype: str = "uint8") -> DataFrame:
    """``schemas.FRAMES`` to ``schemas.TENSORS``: n frames of a clip as one binary value.

    ``video_idx`` is unique per listed file, so files listed twice do not share a group.
    This moves every frame to its clip's task; ``frames.decode_stacked`` avoids that.
    """
    grouped = frames.groupBy("video_idx", "video_path").agg(
        F.count(F.lit(1)).cast("int").alias("n_frames"),
        F.max("height").alias("height"),
        F.max("width").alias("width"),
        F.max("channels").alias("channels"),
        F.max("layout").alias("layout"),
        clip_status().alias("status"),
        F.max("error").alias("error"),
        F.array_sort(F.collect_list(F.struct("k", "data"))).alias("rows"),
    )
    data = F.concat(*[F.get("rows", F.lit(k)).data for k in range(n)])
    # A clip that failed half way is zero as a whole, as it is when read clip by clip.
    zeros = F.unhex(F.repeat(F.lit("00"), F.length(data)))
    data = F.when(F.col("status") == schemas.ERROR, zeros).otherwise(data)
    return grouped.select(
        "video_idx",
        "video_path",
        "n_frames",
        "height",
        "width",
        "channels",
        F.lit(dtype).alias("dtype"),
        "layout",
        data.alias("data"),
        frame_count(F.col("status"), F.col("n_frames")).alias("frame_count"),
        "status",
        "error",
    )


def clip_status(status: str = "status") -> Column:
    """Worst frame status of a group."""
    severity = F.lit(list(schemas.SEVERITY))
    worst = F.max(F.array_position(severity, F.col(status)))
    return F.get(severity, (worst - 1).cast("int"))


def planned_status(total: Column) -> Column:
    """Status known before decode: a clip without frames is empty, and gives n zero frames."""
    return F.when(total > 0, schemas.OK).otherwise(schemas.EMPTY)


def frame_count(status: Column, n_frames: Column) -> Column:
    """Frames delivered: 0 for a clip that failed."""
    return F.when(status == schemas.ERROR, 0).otherwise(n_frames).cast("int")


def frames_shape(n: Column, height: Column, width: Column, channels: Column) -> Column:
    return F.array(*[c.cast("int") for c in (n, height, width, channels)])


def mean_per_clip(frames: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean over all values of a clip. Frames have equal size, so it is the mean of frame means.

    Reduces each row to one double before the shuffle, and the aggregate combines
    map-side: pixels do not move and a hot clip costs no more than another. Where frames have a
    ``status``, a clip with a failed one is 0 as a whole.
    """
    failed = (F.col("status") == schemas.ERROR) if "status" in frames.columns else F.lit(False)
    per_frame = frames.select(*keys, pixels.mean_value(F.col(value)).alias("frame_mean"), failed.alias("__failed"))
    mean = F.when(F.max("__failed"), 0.0).otherwise(F.avg("frame_mean"))
    return per_frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_frames"), mean.alias("mean_value"))


def dataset_stats(clips: DataFrame, n: int, height: int, width: int) -> DataFrame:
    """Number of clips, frames per clip, target size and total frames."""
    return clips.agg(F.count(F.lit(1)).alias("total_videos")).select(
        "total_videos",
        F.lit(n).cast("bigint").alias("frames_per_video"),
        F.lit(height).cast("bigint").alias("target_height"),
        F.lit(width).cast("bigint").alias("target_width"),
        (F.col("total_videos") * n).alias("total_frames"),
    )


def select_columns(df: DataFrame, *columns: str) -> DataFrame:
    """Columns a consumer asks for; the scan reads no others."""
    return df.select(*columns)
