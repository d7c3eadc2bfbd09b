"""Listings and tables as streams: one pass over what is new, stateless, exactly once."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from cliploom.sources import files

def stream_table(spark: SparkSession, path: str, schema, files_per_trigger: int = 1000) -> DataFrame:
    """A parquet table as a stream; ``path`` is a folder, or one file.

    A stream reads folders only, so a file is given as its folder and a filter on its name.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    folder, _, name = path.rstrip("/").rpartition("/")
    if not _is_file(spark, path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", re.sub(r"([\\*?\[\]{}])", r"\\\1", name)).parquet(folder)


def _is_file(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target).isFile()


def stream_files(
    spark: SparkSession, base: str, suffixes: Sequence[str] = (".mp4",), settle: float = files.SETTLE, again: bool = False
) -> DataFrame:
    """Media files as a stream of (video_path, video_size, modified), empty and hidden ones too. Content is not read.

    Each trigger takes the files that arrived since the last one, however many (``sources.files``). A file that is written or
    moved again comes again. Files inside a folder that was moved in as a whole keep their old times and do not come.
    ``again`` names all files at every trigger, those in moved folders too: for ``refresh.refreshed``, which opens new versions only.
    """
    reader = files.register(spark).readStream.format(files.FORMAT).option("suffixes", json.dumps(list(suffixes)))
    return reader.options(settle=settle, again=again).load(base).select("video_path", "video_size", "modified")


def run_available(
    stream: DataFrame, path: str, checkpoint: str, step: Callable[[DataFrame], DataFrame] | None = None
) -> str:
    """Process everything not yet processed into parquet, then stop.

    Run it again with the same checkpoint and only new input is read. Both folders must
    be shared, so that a restarted driver finds them.
    """
    out = stream.transform(step) if step else stream
    query = (
        out.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return path
