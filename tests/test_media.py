from __future__ import annotations

import os

import numpy as np
import pytest
from media_files import write_bmp, write_y4m
from pyspark.sql import functions as F

from cliploom.functions import kernels
from cliploom.operators import clips, frames
from cliploom.plans import clip_job
from cliploom.sources import dataset, media
from cliploom.sources.decoders import OpenCvDecoder, Y4MDecoder

RNG = np.random.default_rng(8)
LENGTHS = {"one": 1, "two": 2, "fifteen": 15, "sixteen": 16, "seventeen": 17, "long": 100}


@pytest.fixture(scope="module")
def library(tmp_path_factory):
    """A tree of clips; returns (folder, grey levels of each readable clip)."""
    base = tmp_path_factory.mktemp("media")
    seen = {}
    for i, (name, n) in enumerate(LENGTHS.items()):
        chroma = ["444", "420jpeg", "422", "mono"][i % 4]
        luma = RNG.integers(16, 236, (n, 5, 7))
        seen[f"{name}.mp4"] = write_y4m(base / f"d{i % 2}" / "deep" / f"{name}.mp4", luma, chroma)
    seen["short.mp4"] = write_y4m(base / "short.mp4", RNG.integers(16, 236, (12, 4, 6)), "444", declared=20)
    (base / "empty.mp4").write_bytes(b"")
    (base / "junk.mp4").write_bytes(RNG.bytes(500))
    return base, seen


NAMES = ["_u.mp4", ".dot/b.mp4", "_hid/a.mp4", ".mp4", "D.MP4", "e.mp4.txt", "a b%20c.mp4", "x.avi", "y/z/w.mkv"]


@pytest.fixture(scope="module")
def odd_names(tmp_path_factory):
    base = tmp_path_factory.mktemp("names")
    for name in NAMES:
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_bytes(b"" if name == ".mp4" else b"12345")
    os.symlink(base / "y", base / "linked")
    return base


def _listed(df, base):
    return sorted(os.path.relpath(r.video_path, base) for r in df.collect())


@pytest.mark.parametrize("budget", [1, 3, 50_000])
def test_listing_sees_what_a_walk_sees(spark, odd_names, budget):
    walked = [os.path.join(d, f) for d, _, files in os.walk(odd_names) for f in files if f.endswith(".mp4")]
    got = _listed(media.list_media(spark, str(odd_names), budget=budget), odd_names)
    assert got == sorted(os.path.relpath(p, odd_names) for p in walked)
    assert ".mp4" in got and "D.MP4" not in got and "e.mp4.txt" not in got


def test_wide_and_deep_trees_take_few_rounds(spark, tmp_path):
    for i in range(40):
        folder = tmp_path / f"{i}" / "a" / "b"
        folder.mkdir(parents=True)
        for j in range(5):
            (folder / f"{j}.mp4").touch()
    assert media.list_media(spark, str(tmp_path), budget=20).count() == 200


def test_listing_with_several_suffixes_and_sizes(spark, odd_names):
    listed = media.list_media(spark, str(odd_names), media.VIDEO_SUFFIXES)
    sizes = {os.path.relpath(r.video_path, odd_names): r.video_size for r in listed.collect()}
    assert sizes["x.avi"] == 5 and sizes["y/z/w.mkv"] == 5 and sizes[".mp4"] == 0


def test_binary_file_listing_leaves_out_hidden_and_empty(spark, odd_names):
    listed = media.list_binary_files(spark, str(odd_names))
    assert [os.path.basename(r.video_path) for r in listed.collect()] == ["a b%20c.mp4"]
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]


def test_listing_guard(spark, tmp_path):
    nothing = media.list_media(spark, str(tmp_path))
    assert media.files_found(nothing).first().files_found == 0
    with pytest.raises(FileNotFoundError):
        media.require_media(nothing)
    assert media.require_media(media.items(spark, ["a.mp4"])).count() == 1


SPEC = clip_job.ClipSpec(n_frames=16, height=6, width=4, batch_size=4, clips_per_task=2)


def _expected_tensor(levels: np.ndarray, total: int) -> np.ndarray:
    grey = [
        np.repeat(levels[i][..., None], 3, axis=2) if i < len(levels) else None
        for i in np.linspace(0, total - 1, 16, dtype=int)
    ]
    return np.stack([np.zeros((6, 4, 3), np.uint8) if g is None else kernels.bilinear(g, 6, 4) for g in grey])


def test_job_statuses_and_pixels(spark, library):
    base, seen = library
    job_clips = clip_job.clips(media.list_media(spark, str(base)), SPEC)
    probed = {r.video_name: r for r in job_clips.collect()}
    assert sorted(r.video_idx for r in probed.values()) == list(range(9))
    assert {n: r.total_frames for n, r in probed.items()} == {
        **{f"{k}.mp4": v for k, v in LENGTHS.items()}, "short.mp4": 20, "empty.mp4": 0, "junk.mp4": 0,
    }
    assert probed["long.mp4"].fps == pytest.approx(29.97, abs=0.01)
    assert probed["junk.mp4"].status == "error" and "YUV4MPEG2" in probed["junk.mp4"].error

    tensors = {os.path.basename(r.video_path): r for r in clip_job.tensors(job_clips, SPEC).collect()}
    for name, levels in seen.items():
        row = tensors[name]
        got = np.frombuffer(row.data, np.uint8).reshape(16, 6, 4, 3)
        want = _expected_tensor(levels, probed[name].total_frames)
        assert np.abs(got.astype(int) - want.astype(int)).max() <= 1, name
        assert row.frame_count == 16
    assert tensors["short.mp4"].status == "zero_filled"
    assert tensors["long.mp4"].status == "ok"
    assert (tensors["empty.mp4"].status, tensors["empty.mp4"].frame_count) == ("empty", 16)


def test_failed_clip_keeps_its_row(spark, library):
    """The probe reports 0 frames for junk; a direct request shows the decode side."""
    base, _ = library
    wanted = spark.createDataFrame([(1, f"{base}/junk.mp4", 0, 0), (1, f"{base}/junk.mp4", 1, 5), (2, "/gone.mp4", 0, 0)],
                                   "video_idx bigint, video_path string, k int, frame_idx bigint")
    rows = frames.decode(wanted, [Y4MDecoder()], 6, 4).collect()
    assert [r.status for r in rows] == ["error"] * 3 and all(r.error for r in rows)
    assert all(bytes(r.data) == bytes(6 * 4 * 3) for r in rows)


def test_junk_has_frame_count_zero_and_zeros_after_normalising(spark, library):
    base, _ = library
    job_clips = clip_job.clips(media.list_media(spark, str(base)), SPEC).where("video_name = 'junk.mp4'")
    row = clip_job.clip_means(job_clips, SPEC).first()
    assert (row.status, row.frame_count, row.mean_value) == ("error", 0, 0.0)


@pytest.mark.parametrize("clips_per_task", [1, 3, 100])
def test_exactly_once_for_any_partitioning(spark, library, clips_per_task):
    base, _ = library
    spec = clip_job.ClipSpec(n_frames=16, height=6, width=4, clips_per_task=clips_per_task)
    job_clips = clip_job.clips(media.list_media(spark, str(base)), spec)
    stacked = {r.video_idx: bytes(r.data) for r in clip_job.tensors(job_clips, spec).collect()}
    by_frame = clip_job.frame_rows(job_clips, spec)
    assert by_frame.count() == 9 * 16
    regrouped = {r.video_idx: bytes(r.data) for r in clips.stack(by_frame, 16).collect()}
    assert stacked == regrouped and len(stacked) == 9


def test_same_file_listed_often(spark, library):
    base, _ = library
    listing = media.items(spark, [f"{base}/short.mp4"] * 30).withColumn("video_size", F.lit(1).cast("bigint"))
    job_clips = clip_job.clips(listing, SPEC)
    out = clip_job.tensors(job_clips, SPEC).collect()
    assert len(out) == 30 and len({bytes(r.data) for r in out}) == 1
    assert {r.n_frames for r in clips.stack(clip_job.frame_rows(job_clips, SPEC), 16).collect()} == {16}


def test_lazy_equals_eager(spark, library):
    base, _ = library
    job_clips = clip_job.clips(media.list_media(spark, str(base)), SPEC)
    lazy = clip_job.tensors(job_clips, SPEC)
    for how in ("persist", "store"):
        eager = dataset.preload(lazy, how)
        means = [
            sorted((r.video_idx, r.m) for r in frames.normalize(t).select("video_idx", frames.mean_value(F.col("data")).alias("m")).collect())
            for t in (lazy, eager)
        ]
        assert means[0] == means[1]
        eager.unpersist()


def test_means_in_the_decode_task_equal_means_of_tensors(spark, library):
    base, _ = library
    job_clips = clip_job.clips(media.list_media(spark, str(base)), SPEC)
    tensors = frames.normalize(clip_job.tensors(job_clips, SPEC), "float64")
    means = tensors.select("video_idx", frames.mean_value(F.col("data"), "float64").alias("m"))
    want = {r.video_idx: r.m for r in means.collect()}
    got = {r.video_idx: r.mean_value for r in clip_job.clip_means(job_clips, SPEC).collect()}
    assert got == pytest.approx(want, abs=1e-12)


def test_collated_batches(spark, library):
    base, _ = library
    job_clips = clip_job.clips(media.list_media(spark, str(base)), SPEC)
    normal = frames.normalize(clip_job.tensors(job_clips, SPEC), "float32", layout="CHW")
    want = {r.video_idx: (bytes(r.data), r.video_path, r.status) for r in normal.collect()}
    rows = {r.batch_id: r for r in clip_job.collated(job_clips, SPEC).collect()}
    assert {b: r.batch_size for b, r in rows.items()} == {0: 4, 1: 4, 2: 1}
    for b, row in rows.items():
        clip_range = range(b * 4, b * 4 + row.batch_size)
        assert bytes(row.data) == b"".join(want[i][0] for i in clip_range)
        assert row.video_paths == [want[i][1] for i in clip_range]
        assert row.video_names == [os.path.basename(p) for p in row.video_paths]
        assert row.statuses == [want[i][2] for i in clip_range]
        assert (row.n_frames, row.layout, row.channels) == (16, "CHW", 3)


def test_refresh_reads_only_new_files(spark, tmp_path):
    def add(*names):
        for name in names:
            write_y4m(tmp_path / "in" / name, RNG.integers(16, 236, (4, 3, 3)))

    store = str(tmp_path / "store")
    add("a.mp4", "c.mp4")
    first = {r.video_path: r for r in clip_job.refresh(media.list_media(spark, str(tmp_path / "in")), store, SPEC).collect()}
    stored = tmp_path / "in" / "a.mp4"
    stored.write_bytes(b"!" * stored.stat().st_size)  # of the same size: must not be read
    add("b.mp4")
    for _ in range(2):
        done = clip_job.refresh(media.list_media(spark, str(tmp_path / "in")), store, SPEC).collect()
    assert sorted(r.video_idx for r in done) == [0, 1, 2]
    assert {r.video_path: r for r in done if r.video_path in first} == first
    assert {r.status for r in done} == {"ok"}


def test_batch_means(spark, library):
    base, _ = library
    job_clips = clip_job.clips(media.list_media(spark, str(base)), SPEC)
    per_clip = {r.video_idx: r.mean_value for r in clip_job.clip_means(job_clips, SPEC).collect()}
    got = {r.batch_id: r.batch_mean for r in clip_job.batch_means(job_clips, SPEC).collect()}
    assert sorted(got) == [0, 1, 2]
    for b, mean in got.items():
        assert mean == pytest.approx(np.mean([per_clip[i] for i in range(b * 4, min(b * 4 + 4, 9))]))


def test_named_decoder_and_chain():
    chain = [Y4MDecoder(), OpenCvDecoder()]
    assert [d.name for d in frames.ordered_chain(chain, "OpenCV")] == ["opencv"]
    assert [d.name for d in frames.ordered_chain(chain, "unknown")] == ["y4m", "opencv"]
    error = frames.OpenClip(chain, "/no/such/file").error
    assert "y4m" in error and "opencv" in error


class Fragile:
    """Opens everything and breaks on the second frame."""

    name = "fragile"
    total_frames, fps, width, height = 4, 1.0, 2, 2

    def open(self, path):
        return self

    def read(self, i):
        if i > 0:
            raise OSError("broken")
        return np.full((2, 2, 3), 9, np.uint8)

    def close(self):
        pass


def test_next_decoder_takes_over_when_a_read_raises(tmp_path):
    levels = write_y4m(tmp_path / "a.mp4", RNG.integers(16, 236, (4, 2, 2)), "mono")
    clip = frames.OpenClip([Fragile(), Y4MDecoder()], str(tmp_path / "a.mp4"))
    assert clip.read(0).max() == 9
    np.testing.assert_array_equal(clip.read(3)[..., 0], levels[3])
    assert clip.error is None
    alone = frames.OpenClip([Fragile()], "x")
    assert alone.read(0) is not None and alone.read(1) is None and "broken" in alone.error


def test_image_folders_as_clips(spark, tmp_path):
    stack = RNG.integers(0, 256, (20, 5, 7, 3), dtype=np.uint8)
    for i, rgb in enumerate(stack):
        write_bmp(tmp_path / "many" / f"{i:03d}.bmp", rgb)
    write_bmp(tmp_path / "one" / "x.bmp", stack[0])
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.bmp").write_bytes(b"BMjunk")
    rows = clip_job.image_frames(spark, str(tmp_path), SPEC).collect()
    assert len(rows) == 48
    seen = {(os.path.basename(r.video_path), r.k): r for r in rows}
    for k, i in enumerate(np.linspace(0, 19, 16, dtype=int)):
        assert bytes(seen["many", k].data) == kernels.bilinear(stack[i], 6, 4).tobytes()
        assert bytes(seen["one", k].data) == kernels.bilinear(stack[0], 6, 4).tobytes()
        assert (seen["bad", k].status, bytes(seen["bad", k].data)) == ("zero_filled", bytes(72))


def test_empty_and_hidden_images_keep_their_place(spark, tmp_path):
    stack = RNG.integers(0, 256, (2, 4, 6, 3), dtype=np.uint8)
    write_bmp(tmp_path / "clip" / "f0.bmp", stack[0])
    (tmp_path / "clip" / "f1.bmp").write_bytes(b"")
    write_bmp(tmp_path / "clip" / "f2.bmp", stack[1])
    (tmp_path / "none").mkdir()
    (tmp_path / "blank").mkdir()
    (tmp_path / "blank" / ".x.png").write_bytes(b"")
    spec = clip_job.ClipSpec(n_frames=3, height=4, width=6)
    rows = clip_job.image_frames(spark, str(tmp_path), spec).collect()
    seen = {(os.path.basename(r.video_path), r.k): (r.status, bytes(r.data)) for r in rows}
    assert [seen["clip", k] for k in range(3)] == [("ok", stack[0].tobytes()), ("zero_filled", bytes(72)), ("ok", stack[1].tobytes())]
    assert [seen["blank", k] for k in range(3)] == [("zero_filled", bytes(72))] * 3 and len(rows) == 6


def test_image_folder_that_cannot_be_read(spark, tmp_path, monkeypatch):
    write_bmp(tmp_path / "clip" / "f0.bmp", RNG.integers(0, 256, (4, 6, 3), dtype=np.uint8))
    listed = media.list_media(spark, str(tmp_path), clip_job.IMAGE_SUFFIXES, sizes=False)
    broken = spark.createDataFrame([(f"{tmp_path}/locked", None, "cannot list: no")], listed.schema)
    monkeypatch.setattr(media, "list_media", lambda *args, **kwargs: listed.unionByName(broken))
    rows = clip_job.image_frames(spark, str(tmp_path), clip_job.ClipSpec(n_frames=2, height=4, width=6)).collect()
    seen = {(os.path.basename(r.video_path), r.k): (r.status, r.frame_idx) for r in rows}
    assert seen == {("clip", 0): ("ok", 0), ("clip", 1): ("ok", 0), ("locked", 0): ("error", None), ("locked", 1): ("error", None)}


def test_image_folders(spark, tmp_path):
    stack = RNG.integers(0, 256, (3, 5, 7, 3), dtype=np.uint8)
    for i, rgb in enumerate(stack):
        write_bmp(tmp_path / "clip" / f"{i:03d}.bmp", rgb)
    (tmp_path / "clip" / "bad.bmp").write_bytes(b"BMjunk")
    table = media.images(spark, str(tmp_path))
    good = frames.reverse_channels(table.where("status = 'ok'")).orderBy("frame_name").collect()
    assert [bytes(r.data) for r in good] == [f.tobytes() for f in stack]
    bad = table.where("status = 'error'").collect()
    assert [r.frame_name for r in bad] == ["bad.bmp"] and bad[0].data is None
