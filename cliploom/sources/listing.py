"""List files of any file system that executors reach, as Spark jobs.

Spark's ``binaryFile`` reader skips zero-byte files and every name that starts with
``_`` or ``.``; this listing returns them too. The driver looks at the base only.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from cliploom import schemas
from cliploom.operators.frames import tasks_for
from cliploom.session import shared_dir

ROWS_PER_BATCH = 10_000
FOLDERS_PER_TASK = 16
ATTEMPTS = 3  # to read a folder

_ENTRY = "video_path string, video_size bigint, error string, folder string"


def walk(spark: SparkSession, base: str, suffixes: Sequence[str], sizes: bool, budget: int) -> DataFrame:
    """(video_path, video_size, error) of the matching files below ``base``, and of folders that cannot be read.

    Works in rounds. A task walks down its folders until it has seen ``budget`` entries
    and hands on the folders it has not opened; the next round spreads those over all
    tasks. A small tree takes one round, and a folder that holds most of the files is
    shared out as soon as it has subfolders.
    """
    shared_dir(spark)
    filesystem, path = pafs.FileSystem.from_uri(base if "://" in base else os.path.abspath(base))
    if filesystem.get_file_info(path).type == pafs.FileType.NotFound:
        raise FileNotFoundError(f"no folder at {base}")
    scan = _scanner(tuple(suffixes), sizes, budget)
    folders = spark.createDataFrame([(base,)], "folder string")
    found = []
    while True:
        entries = folders.mapInArrow(scan, _ENTRY).checkpoint()
        found.append(entries.where("folder IS NULL").drop("folder"))
        folders = entries.where("folder IS NOT NULL").select("folder")
        left = folders.count()
        if not left:
            return reduce(DataFrame.unionByName, found)
        tasks = tasks_for(left, FOLDERS_PER_TASK, min(left, spark.sparkContext.defaultParallelism))
        folders = folders.repartition(tasks)


def _scanner(suffixes: tuple[str, ...], sizes: bool, budget: int):
    schema = schemas.arrow(_ENTRY)

    def scan(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = 0, []
        for batch in stream:
            pending = batch.column(0).to_pylist()
            while pending:
                folder = pending.pop()
                if seen >= budget:
                    rows.append((None, None, None, folder))
                    continue
                try:
                    within = entries(folder)
                except OSError as exc:
                    rows.append((folder, None, f"cannot list: {exc}", None))
                    continue
                for path, name, is_folder, size in within:
                    seen += 1
                    if is_folder:
                        pending.append(path)
                    elif name.endswith(suffixes):
                        rows.append((path, size if sizes else None, None, None))
                    if len(rows) >= ROWS_PER_BATCH:
                        yield schemas.arrow_batch(rows, schema)
                        rows = []
        if rows:
            yield schemas.arrow_batch(rows, schema)

    return scan


def entries(folder: str, infos: bool = False) -> list[tuple]:
    """(path, name, is a folder, size) of what a folder holds, paths in the form of the folder's; ``infos`` gives the whole entry for its size.

    Links to folders are not followed.
    """
    filesystem, path = pafs.FileSystem.from_uri(folder if "://" in folder else os.path.abspath(folder))
    prefix = folder[: -len(path)] if folder.endswith(path) else ""
    for attempt in range(ATTEMPTS):
        try:
            found = filesystem.get_file_info(pafs.FileSelector(path))
            break
        except OSError:
            if attempt == ATTEMPTS - 1:
                raise
            time.sleep(0.2 * 2**attempt)
    local = isinstance(filesystem, pafs.LocalFileSystem)
    return [
        (prefix + info.path, info.base_name, info.type == pafs.FileType.Directory, info if infos else info.size)
        for info in found
        if not (local and info.type == pafs.FileType.Directory and os.path.islink(info.path))
    ]
