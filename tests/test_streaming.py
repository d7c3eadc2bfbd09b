from __future__ import annotations

import os
import shutil

import numpy as np
import pytest
from media_files import write_y4m
from pyspark.sql import functions as F

from cliploom.functions.sampling import sample_indices
from cliploom.operators import frames
from cliploom.sources import files, media
from cliploom.sources.decoders import Y4MDecoder
from cliploom.streaming import items


@pytest.fixture
def folders(tmp_path):
    return str(tmp_path / "out"), str(tmp_path / "state")


def test_stream_equals_batch_and_restart_reads_only_new_files(spark, sf_dir, tmp_path, folders):
    source = tmp_path / "in"
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value")
    events.where("event_id < 500").write.parquet(str(source))
    stream = items.stream_table(spark, str(source), events.schema)
    items.run_available(stream, *folders)
    events.where("event_id >= 500").write.mode("append").parquet(str(source))
    for _ in range(2):  # the second pass has nothing to do
        items.run_available(items.stream_table(spark, str(source), events.schema), *folders)
    got = spark.read.parquet(folders[0])
    assert got.count() == events.count()
    assert got.exceptAll(events).isEmpty()


def test_media_files_as_a_stream(spark, tmp_path, folders):
    base = tmp_path / "clips"
    rng = np.random.default_rng(2)
    for i in range(3):
        write_y4m(base / f"{i}.mp4", rng.integers(16, 236, (4 + i, 4, 4)))

    def decode(listing):
        keyed = listing.withColumn("video_idx", F.xxhash64("video_path"))
        probed = media.probe(keyed, [Y4MDecoder()])
        return frames.decode(frames.fan_out(probed, 8), [Y4MDecoder()], 2, 2)

    items.run_available(items.stream_files(spark, str(base)), *folders, step=decode)
    rows = spark.read.parquet(folders[0]).collect()
    assert len(rows) == 24 and {r.status for r in rows} == {"ok"}
    write_y4m(base / "new.mp4", rng.integers(16, 236, (5, 4, 4)))
    items.run_available(items.stream_files(spark, str(base)), *folders, step=decode)
    assert spark.read.parquet(folders[0]).count() == 32


def test_sampling_on_a_stream(spark, sf_dir, folders):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    step = lambda df: df.select("doc_id", sample_indices(F.col("n_chars"), 16).alias("i"))
    stream = items.stream_table(spark, f"{sf_dir}/documents.parquet", docs.schema)
    items.run_available(stream, *folders, step=step)
    assert spark.read.parquet(folders[0]).exceptAll(step(docs)).isEmpty()


def odd_files(base, tag):
    for folder in ("", "a", "a/b", "_hidden", ".dot"):
        (base / folder).mkdir(parents=True, exist_ok=True)
        for name, content in ((f"{tag}.mp4", b"xyz"), (f"_{tag}.mp4", b"x"), (f".{tag}.mp4", b"xy"), (f"{tag}-empty.mp4", b""), (f"{tag}.txt", b"no")):
            (base / folder / name).write_bytes(content)


def read_files(spark, base, **options):
    reader = files.register(spark).read.format(files.FORMAT).option("suffixes", '[".mp4"]')
    return reader.options(**options).load(str(base))


@pytest.mark.parametrize("shards", [1, 3, 256])
def test_file_source_equals_listing(spark, tmp_path, shards):
    odd_files(tmp_path, "x")
    os.symlink(tmp_path / "a", tmp_path / "link")
    os.symlink(tmp_path / "nowhere", tmp_path / "dangling.mp4")
    got = sorted((r.video_path, r.video_size) for r in read_files(spark, tmp_path, shards=shards).collect())
    want = sorted((r.video_path, r.video_size) for r in media.list_media(spark, str(tmp_path)).collect())
    assert got == want and len(got) == 20  # the dangling link is no file


def test_file_source_of_empty_and_missing_folders(spark, tmp_path):
    assert read_files(spark, tmp_path).count() == 0
    with pytest.raises(Exception, match="no folder at"):
        read_files(spark, tmp_path / "none").count()


def test_every_file_streams_exactly_once_over_three_triggers(spark, tmp_path, folders):
    base = tmp_path / "clips"
    odd_files(base, "first")
    run = lambda: items.run_available(items.stream_files(spark, str(base), settle=0.1), *folders)
    run()
    odd_files(base, "second")
    old = tmp_path / "late.mp4"
    old.write_bytes(b"late")
    os.utime(old, (1, 1))  # its modification time lies before all marks
    shutil.move(old, base / "late.mp4")
    future = base / "future.mp4"
    future.write_bytes(b"")
    os.utime(future, (1 << 33, 1 << 33))
    run()
    run()
    got = sorted((r.video_path, r.video_size) for r in spark.read.parquet(folders[0]).collect())
    want = sorted((r.video_path, r.video_size) for r in media.list_media(spark, str(base)).collect())
    assert got == want and len(got) == 42
    (base / "first.mp4").write_bytes(b"changed")
    run()
    again = [r for r in spark.read.parquet(folders[0]).collect() if r.video_path.endswith("/clips/first.mp4")]
    assert sorted(r.video_size for r in again) == [3, 7]


def test_a_stream_does_not_pass_over_a_folder_it_cannot_read(tmp_path, monkeypatch):
    (tmp_path / "a").mkdir()
    reader = files.FileStreamReader({"path": str(tmp_path), "suffixes": '[".mp4"]', "settle": "0"})
    parts = reader.partitions({"until": 0}, reader.latestOffset())
    monkeypatch.setattr(files.listing, "entries", lambda folder, infos=False: (_ for _ in ()).throw(PermissionError(folder)))
    with pytest.raises(PermissionError):
        [list(reader.read(p)) for p in parts]
    batch = files.FileReader({"path": str(tmp_path)})
    rows = [r for p in batch.partitions() for b in batch.read(p) for r in b.to_pylist()]
    assert [(r["video_path"], r["video_size"]) for r in rows] == [(str(tmp_path), None)] and "cannot list" in rows[0]["error"]
