"""Stateful reprocessing: what is opened, how often, and what a restart remembers."""

from __future__ import annotations

import os
import sys
import time

import numpy as np
import pytest
from media_files import write_y4m
from pyspark import cloudpickle

from cliploom.plans import clip_job
from cliploom.sources import media
from cliploom.sources.decoders import Y4MDecoder
from cliploom.streaming import items, refresh

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors cannot import this file
RNG = np.random.default_rng(8)
VALUES = "content string"


@pytest.fixture
def run(spark, tmp_path):
    base, log = tmp_path / "in", tmp_path / "opened"
    base.mkdir()
    log.mkdir()

    def process(path: str) -> tuple:
        name = os.path.basename(path)
        with open(log / name, "a") as out:
            out.write("x")
        content = open(path).read()
        if content == "raise":
            raise ValueError("cannot")
        return ("error", "bad", None) if content == "bad" else ("ok", None, content)

    def once(attempts: int = 1, wait: float = 0.01, again: bool = True):
        step = lambda rows: refresh.refreshed(rows, process, VALUES, attempts, wait)
        stream = items.stream_files(spark, str(base), [""], settle=0.1, again=again)
        items.run_available(stream, str(tmp_path / "out"), str(tmp_path / "state"), step)
        rows = spark.read.schema(f"{refresh.COLUMNS}, {VALUES}").parquet(str(tmp_path / "out"))
        opened = {p.name: len(p.read_text()) for p in log.iterdir()}
        return rows, opened

    return base, once


def test_only_new_and_changed_files_are_opened(run):
    base, once = run
    for name, content in (("a", "1"), (".b", "2"), ("_c", ""), ("d", "bad"), ("e", "raise")):
        (base / name).write_text(content)
    rows, opened = once()
    assert opened == {"a": 1, ".b": 1, "_c": 1, "d": 1, "e": 1}
    assert {os.path.basename(r.video_path): (r.status, r.error, r.content) for r in rows.collect()} == {
        "a": ("ok", None, "1"), ".b": ("ok", None, "2"), "_c": ("ok", None, ""), "d": ("error", "bad", None), "e": ("error", "ValueError: cannot", None),
    }
    (base / "a").write_text("longer")  # another size
    os.utime(base / ".b", (5, 5))  # another time
    (base / "d").write_text("mended")
    (base / "new").write_text("n")
    rows, opened = once()
    assert opened == {"a": 2, ".b": 2, "_c": 1, "d": 2, "e": 1, "new": 1}
    rows, opened = once(again=False)
    assert sum(opened.values()) == rows.count() == 9
    last = {os.path.basename(r.video_path): (r.status, r.content) for r in refresh.latest(rows.where("video_path NOT LIKE '%.b'")).collect()}
    assert last == {"a": ("ok", "longer"), "_c": ("ok", ""), "d": ("ok", "mended"), "e": ("error", None), "new": ("ok", "n")}


@pytest.mark.parametrize("again", [True, False])
def test_failures_are_tried_again_when_their_time_has_come(run, again):
    """By the timer alone, or when the source names the file again."""
    base, once = run
    (base / "a").write_text("bad")
    (base / "b").write_text("fine")
    rows, opened = once(attempts=3, wait=3600, again=again)
    assert opened == {"a": 1, "b": 1}
    rows, opened = once(attempts=3, wait=3600, again=again)
    assert opened == {"a": 1, "b": 1}, "not before its time"


def test_attempts_end(run):
    base, once = run
    (base / "a").write_text("raise")
    (base / "b").write_text("fine")
    for _ in range(4):
        rows, opened = once(attempts=3, wait=0.01)
        time.sleep(0.05)
    assert opened == {"a": 3, "b": 1}
    assert sorted(r.attempt for r in rows.where("status = 'error'").collect()) == [1, 2, 3]


def test_timer_without_news(run):
    base, once = run
    (base / "a").write_text("bad")
    for _ in range(3):
        rows, opened = once(attempts=2, wait=0.01, again=False)
        time.sleep(0.05)
    assert opened == {"a": 2}


def test_rows_without_path_size_or_time(spark, tmp_path):
    """From a table, in one batch: Spark would run empty ones for the timers without end."""
    source, out = tmp_path / "rows", tmp_path / "out"
    schema = "video_path string, video_size bigint, modified timestamp"
    spark.createDataFrame([(None, 1, None), ("p", None, None), ("p", None, None), ("q", 3, None), ("q", None, None)], schema).write.parquet(str(source))
    found = refresh.refreshed(items.stream_table(spark, str(source), schema), lambda path: ("ok", None, path), VALUES)
    query = found.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "state")).trigger(once=True).start()
    assert query.awaitTermination(60)
    rows = spark.read.parquet(str(out)).collect()
    assert sorted((r.video_path, r.video_size, r.content) for r in rows) == [("p", None, "p"), ("q", 3, "q")]


def test_clip_mean_is_that_of_the_clip_job(spark, tmp_path):
    write_y4m(tmp_path / "a.mp4", RNG.integers(16, 236, (9, 4, 6)))
    write_y4m(tmp_path / "b.mp4", RNG.integers(16, 236, (2, 4, 6)))
    (tmp_path / "empty.mp4").write_bytes(b"")
    (tmp_path / "junk.mp4").write_bytes(b"junk")
    whole = (tmp_path / "a.mp4").read_bytes()
    (tmp_path / "cut.mp4").write_bytes(whole[: len(whole) - 30])
    spec = clip_job.ClipSpec(n_frames=5, height=3, width=5, decoders=(Y4MDecoder(),))
    want = {r.video_path: r for r in clip_job.clip_means(clip_job.clips(media.list_media(spark, str(tmp_path)), spec), spec).collect()}
    process = refresh.clip_mean(spec.decoders, 5, 3, 5)
    for path, row in want.items():
        status, error, _, count, mean = process(path)
        assert (status, count, error is None) == (row.status, row.frame_count, row.error is None), path
        assert mean == pytest.approx(row.mean_value, abs=1e-12)
    assert len(want) == 5
