"""Media files as a Spark data source, batch and stream: ``spark.read.format("media_files")``.

Spark's own file source leaves out empty files and names that start with ``_`` or ``.``; this one returns every file.
Planning looks at a bounded number of folders, only to share the tree out; tasks do the walking.

The offset of the stream is a high-water mark in time: a batch holds the files that arrived after the last mark and up to
the new one. A file arrives when its entry is made or changed: the inode's time on a local or mounted file system, which
copying or moving a file with an old modification time also sets, and elsewhere the time of upload. A mark is a
little in the past when tasks start to walk (``settle``), so a file cannot slip in behind it. Nothing is remembered per file.
"""

from __future__ import annotations

import json
import os
import time
from collections import deque
from collections.abc import Iterator, Sequence
from itertools import batched

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from cliploom.functions.paths import VIDEO_SUFFIXES
from cliploom.session import ship_package
from cliploom.sources import listing

FORMAT = "media_files"
SCHEMA = "video_path string, video_size bigint, modified timestamp, error string"
SHARDS = 256  # parts that planning shares a tree out into, about
SETTLE = 1.0  # seconds; more than the step and the skew of the clocks that stamp files

_ARROW = pa.schema({
    "video_path": pa.string(), "video_size": pa.int64(), "modified": pa.timestamp("us", tz="UTC"), "error": pa.string(),
})


def register(spark: SparkSession) -> SparkSession:
    """Make the format known to a session; the executors get this package."""
    ship_package(spark).dataSource.register(MediaFiles)
    return spark


class MediaFiles(DataSource):
    """Files below ``path`` whose name ends with one of ``suffixes`` (a JSON list), at any depth.

    Other options: ``shards``, ``settle``, and ``again``: every trigger of a stream names all files, for a consumer that knows those it has
    seen. A folder that cannot be read is a row with its path and an ``error`` in a
    batch; a stream fails there and tries the same span of time again, as going on would lose that folder's files.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FileReader:
        return FileReader(self.options)

    def streamReader(self, schema) -> FileStreamReader:
        return FileStreamReader(self.options)


class _Tree:
    def __init__(self, options: dict[str, str]) -> None:
        self.base = options["path"]
        self.suffixes = tuple(json.loads(options.get("suffixes", json.dumps(VIDEO_SUFFIXES))))
        self.again = options.get("again", "false").lower() == "true"
        self.shards, self.settle = int(options.get("shards", SHARDS)), float(options.get("settle", SETTLE))

    def parts(self, **bounds: int) -> list[InputPartition]:
        """Folders for tasks: each whole, or without its subfolders where these are shared out too."""
        filesystem, path = pafs.FileSystem.from_uri(self.base if "://" in self.base else os.path.abspath(self.base))
        if filesystem.get_file_info(path).type != pafs.FileType.Directory:
            raise FileNotFoundError(f"no folder at {self.base}")
        whole, alone = deque([self.base]), []
        for _ in range(self.shards):
            if not whole or len(whole) >= self.shards:
                break
            folder = whole.popleft()
            try:
                below = [path for path, _, is_folder, _ in listing.entries(folder) if is_folder]
            except OSError:
                below = []  # the task says so
            alone.append((folder, not below))
            whole.extend(below)
        folders = [*alone, *((folder, True) for folder in whole)]
        tasks = min(len(folders), self.shards)
        return [InputPartition({"folders": folders[i::tasks], **bounds}) for i in range(tasks)]

    def walk(self, folders: Sequence[tuple[str, bool]], strict: bool) -> Iterator[tuple[str, int, pafs.FileInfo | str]]:
        """(path, when it arrived, its entry, or an error) of matching files."""
        pending = list(folders)
        while pending:
            folder, deep = pending.pop()
            try:
                found = listing.entries(folder, infos=True)
            except OSError as exc:
                if strict:
                    raise
                yield folder, 0, f"cannot list: {exc}"
                continue
            for path, name, is_folder, info in found:
                if is_folder:
                    pending.extend([(path, True)] if deep else [])
                elif name.endswith(self.suffixes):
                    yield path, _arrived(path, info), info


def _arrived(path: str, info: pafs.FileInfo) -> int:
    """Nanoseconds. The modification time of a local file is its writer's choice; that of its inode is not."""
    if "://" in path:
        return info.mtime_ns or 0
    try:
        return max(os.stat(path).st_ctime_ns, os.lstat(path).st_ctime_ns)
    except FileNotFoundError:  # a dangling link, or deleted since
        return info.mtime_ns or 0


def _batches(rows: Iterator[tuple[str, pafs.FileInfo | str]]) -> Iterator[pa.RecordBatch]:
    for some in batched(rows, listing.ROWS_PER_BATCH):
        failed = [isinstance(info, str) for _, info in some]
        columns = [
            [path for path, _ in some],
            [None if bad else info.size for bad, (_, info) in zip(failed, some, strict=True)],
            [None if bad or info.mtime_ns is None else info.mtime_ns // 1000 for bad, (_, info) in zip(failed, some, strict=True)],
            [info if bad else None for bad, (_, info) in zip(failed, some, strict=True)],
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


class FileReader(DataSourceReader):
    """Every file that is there, once."""

    def __init__(self, options: dict[str, str]) -> None:
        self.tree = _Tree(options)

    def partitions(self) -> Sequence[InputPartition]:
        return self.tree.parts()

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return _batches((path, info) for path, _, info in self.tree.walk(partition.value["folders"], strict=False))


class FileStreamReader(DataSourceStreamReader):
    """Files that arrived between two marks."""

    def __init__(self, options: dict[str, str]) -> None:
        self.tree = _Tree(options)

    def initialOffset(self) -> dict:
        return {"until": 0}

    def latestOffset(self) -> dict:
        mark = time.time_ns()
        time.sleep(self.tree.settle)
        return {"until": mark}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        after = 0 if self.tree.again else start["until"]
        return self.tree.parts(after=after, until=end["until"]) if start["until"] < end["until"] else []

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        span = partition.value
        found = self.tree.walk(span["folders"], strict=True)
        return _batches((path, info) for path, at, info in found if span["after"] < at <= span["until"])
