"""Incremental reprocessing as a stateful stream: each version of a file is processed once, failures again after a while.

The state of a path is the version that was seen last, what became of it, and how often it was tried. A file with the
same size and modification time is not opened again, however often the source names it; a changed one is, with a new count of
attempts. A failed one is tried again when its timer runs out, ``attempts`` times in all. The state is in the checkpoint and
partitioned by path, so a restart knows all files and no task knows more than its share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliploom import schemas
from cliploom.functions import kernels
from cliploom.operators.frames import OpenClip, ordered_chain

STATE = "version string, size bigint, modified bigint, status string, attempts int, due bigint"
COLUMNS = "video_path string, video_size bigint, modified bigint, attempt int, status string, error string"
MEANS = "total_frames bigint, frame_count int, mean_value double"

Process = Callable[[str], tuple]  # path -> (status, error, values…)


def refreshed(arrivals: DataFrame, process: Process, result: str, attempts: int = 3, wait_seconds: float = 60) -> DataFrame:
    """``COLUMNS`` and the columns of ``result`` for each attempt at a version of a file.

    ``arrivals`` is a stream of (video_path, video_size, modified), as ``sources.files`` gives it. ``process`` opens a
    path in the task and returns a status, an error and the values of ``result``; what it raises is ``status = error`` with null values.
    Timers keep Spark running empty batches: an available-now run ends by itself with ``sources.files`` only, so start other sources with an interval.
    Rows without path are left out; a null size or time is a version like any other. Of several versions in one batch the latest counts.
    """
    n_values = len(result.split(","))
    names = [c.split()[0] for c in f"{COLUMNS}, {result}".split(", ")]

    def tried(path: str) -> tuple:
        try:
            return process(path)
        except Exception as exc:
            return (schemas.ERROR, f"{type(exc).__name__}: {exc}", *[None] * n_values)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        (path,), now = key, state.getCurrentProcessingTimeMs()
        known = state.get if state.exists else None
        if state.hasTimedOut:
            version, size, modified, _, before, _ = known
        else:
            seen = [r for batch in batches for r in zip(map(_whole, batch["modified"]), map(_whole, batch["video_size"]), strict=True)]
            modified, size = max(seen, key=lambda r: [(x is not None, x or 0) for x in r])
            version, before = f"{modified}:{size}", 0
            if known is not None and known[0] == version:
                _, _, _, status, before, due = known
                if status != schemas.ERROR or before >= attempts:
                    return
                if now < due:  # seen again before its time: the timer goes on
                    state.setTimeoutDuration(due - now)
                    return
        status, error, *values = tried(path)
        wait = max(1, int(wait_seconds * 1000))
        state.update((version, size, modified, status, before + 1, now + wait))
        if status == schemas.ERROR and before + 1 < attempts:
            state.setTimeoutDuration(wait)
        yield pd.DataFrame([(path, size, modified, before + 1, status, error, *values)], columns=names)

    rows = arrivals.where(F.col("video_path").isNotNull())
    rows = rows.select("video_path", "video_size", F.unix_micros("modified").alias("modified"))
    return rows.groupBy("video_path").applyInPandasWithState(
        step, f"{COLUMNS}, {result}", STATE, "append", "ProcessingTimeTimeout"
    )


def _whole(x) -> int | None:
    return None if pd.isna(x) else int(x)


def latest(results: DataFrame, keys: Sequence[str] = ("video_path",)) -> DataFrame:
    """Of each file the last attempt at its latest version."""
    best = F.max_by(F.struct(*results.columns), F.struct(F.coalesce("modified", F.lit(-1)), F.col("attempt"))).alias("best")
    return results.groupBy(*keys).agg(best).select("best.*")


def clip_mean(decoders: Sequence, n: int, height: int, width: int, method: str = "bilinear", prefer: str | None = None) -> Process:
    """``MEANS`` of one clip: n frames evenly spread, resized, normalised and averaged, with the meanings that failures have in the clip job."""
    chain, resize = ordered_chain(decoders, prefer), kernels.RESIZERS[method]

    def process(path: str) -> tuple:
        clip = OpenClip(chain, path)
        try:
            if clip.error is not None:
                return schemas.ERROR, clip.error, 0, 0, 0.0
            total = clip.clip.total_frames
            zeros, found = np.zeros((height, width, 3), np.uint8), []
            at = np.linspace(0, total - 1, n, dtype=int).tolist() if total > 0 else []
            for i in at:
                found.append(clip.read(i))
                if clip.error is not None:
                    return schemas.ERROR, clip.error, total, 0, 0.0
            status = schemas.EMPTY if not at else schemas.ZERO_FILLED if any(f is None for f in found) else schemas.OK
            pixels = [zeros if f is None else resize(f, height, width) for f in found or [None] * n]
            return status, None, total, n, float(sum(map(kernels.normalized_mean, pixels)) / n)
        finally:
            clip.close()

    return process
