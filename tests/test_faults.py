"""Inputs that the tables do not contain: nulls, ties, failing decoders, changed files, unreadable folders."""

from __future__ import annotations

import os
import sys
from dataclasses import replace

import numpy as np
import pytest
from media_files import write_y4m
from pyspark import cloudpickle
from pyspark.sql import functions as F

from cliploom.operators import batches, clips, frames, runs
from cliploom.plans import clip_job, hosting
from cliploom.sources import listing, media
from cliploom.sources.decoders import Y4MDecoder
from cliploom.streaming import items

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors cannot import this file
RNG = np.random.default_rng(5)
SPEC = clip_job.ClipSpec(n_frames=4, height=4, width=4, decoders=(Y4MDecoder(),))
LOG = "name string, run_no bigint, method string, total_time double, samples_per_second double, memory_usage_mb double, success boolean"


def log(spark, rows):
    return spark.createDataFrame(rows, LOG)


def test_runs_without_a_value_do_not_win(spark):
    rows = [("a x", 1, "a", None, 5.0, 2.0, False), ("b x", 2, "b", 3.0, 4.0, None, True), ("c x", 3, "c", 9.0, None, 7.0, True)]
    best = {r.metric: (r.run_no, r.value) for r in runs.winners(log(spark, rows)).collect()}
    assert best == {"total_time": (2, 3.0), "samples_per_second": (2, 4.0), "memory_usage_mb": (3, 7.0)}
    none = [("a x", 1, "a", None, None, None, True)]
    assert {r.run_no for r in runs.winners(log(spark, none)).collect()} == {None}
    timed = runs.best_method(log(spark, [*none, ("a y", 2, "a", 4.0, 1.0, 1.0, True)]), "method").collect()
    assert [(r.run_no, r.total_time) for r in timed] == [(2, 4.0)]
    assert runs.best_method(log(spark, none), "method").count() == 0


def test_unknown_baseline_is_null_and_zero_baseline_is_zero(spark):
    totals = runs.totals(log(spark, [("b x", 2, "b", 3.0, 4.0, 1.0, True), ("z x", 3, "z", 0.0, 4.0, 1.0, True)]), ["method"], 16)
    assert {r.speedup for r in runs.against_baseline(totals, "missing").collect()} == {None}
    assert {r.speedup for r in runs.against_baseline(totals, "z").collect()} == {0.0}
    per = runs.against_baseline(totals.withColumn("c", F.col("method")), "b", per=["c"]).collect()
    assert {r.method: (r.speedup, r.time_reduction_pct) for r in per} == {"b": (1.0, 0.0), "z": (None, None)}


@pytest.mark.parametrize(
    "orders,left",
    [([3, None, 5], {3, 5}), ([None, None, 1], {None, 1}), ([2, 2, 2], {2}), ([7], set()), ([], set())],
)
def test_warm_up_drops_one_run_per_method(spark, orders, left):
    rows = [(m, o) for m in ("a", None) for o in orders]
    got = runs.drop_warmup(spark.createDataFrame(rows, "method string, ts int"), ["ts"]).collect()
    assert len(got) == 2 * max(0, len(orders) - 1)
    assert {r.ts for r in got} == left


def test_grid_of_results_reads_the_log_once(spark):
    done = runs.method_results(log(spark, [("a x", 1, "a", 2.0, 1.0, 1.0, True)]), "run_no", ["a", "b"]).collect()
    assert {r.method: (r.runs, r.avg_time) for r in done} == {"a": (1, 2.0), "b": (0, None)}


def test_all_values_of_a_vector_count(spark):
    rows = [(i, 0, [float(x) for x in RNG.uniform(-1, 1, 64)]) for i in range(3)]
    for at in (0, 47, 63):
        px = []
        for value in (-0.9, 0.9):
            changed = [(i, c, [*v[:at], value, *v[at + 1 :]]) for i, c, v in rows]
            table = spark.createDataFrame(changed, "vec_id bigint, clip int, embedding array<float>")
            px.append(hosting.as_pixels(table).orderBy("vec_id").first().px)
        assert len(px[0]) == 192 and sum(a != b for a, b in zip(*px, strict=True)) == 3


class Halfway(Y4MDecoder):
    """Fails at its third frame."""

    name = "halfway"

    def open(self, path):
        clip = super().open(path)
        read = clip.read

        def fail(at):
            if at >= 2:
                raise ValueError("broken")
            return read(at)

        clip.read = fail
        return clip


class Long(Y4MDecoder):
    """Opens anything and promises too many frames."""

    name = "long"

    def open(self, path):
        clip = super().open(path)
        clip.total_frames = 400
        return clip


def test_a_clip_that_fails_half_way_is_one_thing_by_frame_and_by_clip(spark, tmp_path):
    write_y4m(tmp_path / "a.mp4", RNG.integers(16, 236, (4, 4, 4)))
    spec = replace(SPEC, decoders=(Halfway(),))
    job = clip_job.clips(media.list_media(spark, str(tmp_path)), spec)
    whole = clip_job.clip_means(job, spec).first()
    stacked = frames.normalize(clip_job.tensors(job, spec)).select("status", "frame_count", frames.mean_value(F.col("data")).alias("m")).first()
    rows = clip_job.frame_rows(job, spec)
    by_frame = frames.normalize(clips.stack(rows, 4)).select("status", "frame_count", frames.mean_value(F.col("data")).alias("m")).first()
    values = rows.withColumn("px", frames.to_array(F.col("data")))
    assert (whole.status, whole.frame_count, whole.mean_value) == ("error", 0, 0.0)
    assert tuple(stacked) == tuple(by_frame) == ("error", 0, 0.0)
    assert clips.mean_per_clip(values, ["video_idx"], "px").first().mean_value == 0.0


def test_the_preferred_decoder_probes_too(spark, tmp_path):
    write_y4m(tmp_path / "a.mp4", RNG.integers(16, 236, (4, 4, 4)))
    spec = replace(SPEC, decoders=(Long(), Y4MDecoder()), prefer=Y4MDecoder().name.upper())
    job = clip_job.clips(media.list_media(spark, str(tmp_path)), spec)
    assert job.first().total_frames == 4 and clip_job.clip_means(job, spec).first().status == "ok"


def test_refresh_reads_failed_and_changed_files_again(spark, tmp_path):
    base, store = tmp_path / "in", str(tmp_path / "out")
    write_y4m(base / "a.mp4", RNG.integers(16, 236, (4, 4, 4)))
    write_y4m(base / "c.mp4", RNG.integers(16, 236, (4, 4, 4)))
    (base / "b.mp4").write_bytes(b"junk")
    refresh = lambda: {r.video_name: r for r in clip_job.refresh(media.list_media(spark, str(base)), store, SPEC).collect()}
    first = refresh()
    assert [first[n].status for n in ("a.mp4", "b.mp4", "c.mp4")] == ["ok", "error", "ok"]
    write_y4m(base / "b.mp4", RNG.integers(16, 236, (5, 4, 4)))
    write_y4m(base / "c.mp4", RNG.integers(16, 236, (9, 4, 4)))
    second = refresh()
    assert [second[n].status for n in ("a.mp4", "b.mp4", "c.mp4")] == ["ok", "ok", "ok"]
    assert second["a.mp4"] == first["a.mp4"] and second["c.mp4"].video_size > first["c.mp4"].video_size
    assert refresh() == second


def test_accounting_finds_every_file(spark, tmp_path):
    write_y4m(tmp_path / "a.mp4", RNG.integers(16, 236, (4, 4, 4)))
    (tmp_path / "_b.mp4").write_bytes(b"")
    (tmp_path / ".c.mp4").write_bytes(b"junk")
    got = clip_job.accounted(media.list_media(spark, str(tmp_path)), SPEC).first()
    assert (got.listed, got.processed, got.decoded, got.empty, got.failed, got.complete) == (3, 3, 1, 1, 1, True)


def test_uri_and_path_list_the_same(spark, tmp_path):
    for name in ("a.mp4", "_b.mp4", "sub/.c.mp4", "sub/x y#1.mp4", "sub/d.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"" if "b" in name else b"xx")
    os.symlink(tmp_path / "sub", tmp_path / "loop")
    plain = {(r.video_path, r.video_size) for r in media.list_media(spark, str(tmp_path)).collect()}
    uri = {(r.video_path.removeprefix("file://"), r.video_size) for r in media.list_media(spark, f"file://{tmp_path}").collect()}
    assert plain == uri and len(plain) == 4
    with pytest.raises(FileNotFoundError):
        media.list_media(spark, str(tmp_path / "absent"))


def test_a_folder_that_cannot_be_read_is_a_row(tmp_path):
    import pyarrow as pa

    (tmp_path / "a.mp4").write_bytes(b"x")
    scan = listing._scanner((".mp4",), True, 100)
    folders = pa.RecordBatch.from_pydict({"folder": [str(tmp_path), str(tmp_path / "gone")]})
    rows = [r for b in scan(iter([folders])) for r in b.to_pylist()]
    assert {(r["video_path"], r["error"] is not None) for r in rows} == {(str(tmp_path / "a.mp4"), False), (str(tmp_path / "gone"), True)}


def test_a_stream_takes_its_own_folder_only(spark, tmp_path):
    for name, rows in (("in", 5), ("in_old", 10), ("in*x", 3)):
        spark.range(rows).write.parquet(str(tmp_path / name))
    for name, rows in (("in", 5), ("in_old", 10)):
        out = items.run_available(items.stream_table(spark, str(tmp_path / name), "id bigint"), str(tmp_path / f"o-{rows}"), str(tmp_path / f"s-{rows}"))
        assert spark.read.parquet(out).count() == rows


def test_rows_of_any_type_from_a_function(spark):
    schema = "id bigint, a float, b boolean, c array<double>, d decimal(10,2), e struct<x:int,y:string>"

    def make(row):
        from decimal import Decimal

        return {"id": row["id"], "a": 0.5, "b": True, "c": [1.0, 2.0], "d": Decimal("1.25"), "e": {"x": 1, "y": "z"}}

    got = batches.map_function(spark.range(2), make, schema).orderBy("id").collect()
    assert [r.id for r in got] == [0, 1] and (got[0].a, got[0].b, got[0].c, str(got[0].d), got[0].e.y) == (0.5, True, [1.0, 2.0], "1.25", "z")


def test_lookups_without_a_key_find_nothing(spark):
    wanted = spark.createDataFrame([(1, 1), (2, None), (3, 9)], "k int, vec int")
    stored = spark.createDataFrame([(1, "x"), (2, "y")], "vec int, px string")
    assert sorted((r.k, r.px) for r in frames.fetch(wanted, stored, ["vec"]).collect()) == [(1, "x"), (2, None), (3, None)]


def test_a_batch_beyond_2_gib_is_refused(spark):
    with pytest.raises(ValueError, match="2 GiB"):
        clip_job.collated(spark.range(0), clip_job.ClipSpec(batch_size=112), dtype="float64")
