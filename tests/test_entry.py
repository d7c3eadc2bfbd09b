from __future__ import annotations

import os
import subprocess
import sys
import types

import numpy as np
import pytest

import __spark_entry__ as driver
from cliploom.plans.catalog import all_queries
from cliploom.sources import decoders
from cliploom.sources.decoders import OpenCvDecoder


def test_flagship(spark):
    rows = driver.entry(spark).collect()
    assert len(rows) == 10 and {r.n_frames for r in rows} == {16}


def test_every_query_has_sql():
    assert set(all_queries()) <= set(driver.oracle_sql()) <= set(driver.queries())


def test_other_queries_work_without_what_the_training_operators_need():
    """No tokenizer files, no subpackage: the entry offers all other queries."""
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    root = os.path.dirname(driver.__file__)
    said = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True)
    assert said.stdout.split() == [str(len(all_queries()))] * 2


class FakeCapture:
    """The part of OpenCV's video reader that the adapter uses: three 2x2 BGR frames."""

    def __init__(self, path: str) -> None:
        self._open, self._at = path == "good.mp4", 0

    def isOpened(self) -> bool:
        return self._open

    def get(self, prop: str) -> float:
        return {"count": 3.0, "fps": 30.0, "w": 2.0, "h": 2.0}[prop]

    def set(self, prop: str, value: float) -> None:
        self._at = value

    def read(self):
        frame = np.arange(12, dtype=np.uint8).reshape(2, 2, 3) + np.uint8(self._at)
        return (True, frame) if self._at < 2 else (False, None)

    def release(self) -> None:
        self._open = False


@pytest.fixture
def cv2(monkeypatch):
    fake = types.SimpleNamespace(
        VideoCapture=FakeCapture, CAP_PROP_FRAME_COUNT="count", CAP_PROP_FPS="fps",
        CAP_PROP_FRAME_WIDTH="w", CAP_PROP_FRAME_HEIGHT="h", CAP_PROP_POS_FRAMES="at",
    )
    monkeypatch.setitem(sys.modules, "cv2", fake)


def test_opencv_adapter_reads_rgb(cv2):
    clip = OpenCvDecoder().open("file:good.mp4")
    assert (clip.total_frames, clip.fps, clip.width, clip.height) == (3, 30.0, 2, 2)
    assert clip.read(1)[0, 0].tolist() == [3, 2, 1]
    assert clip.read(2) is None
    with pytest.raises(ValueError):
        OpenCvDecoder().open("bad.mp4")


def test_opencv_reads_a_copy_of_what_lies_elsewhere(cv2, monkeypatch, tmp_path):
    opened = []

    class Copied(FakeCapture):
        def __init__(self, path: str) -> None:
            opened.append((path, open(path, "rb").read()))
            super().__init__("good.mp4" if opened[-1][1] == b"video" else "bad.mp4")

    monkeypatch.setattr(sys.modules["cv2"], "VideoCapture", Copied)
    (tmp_path / "a.mp4").write_bytes(b"video")
    monkeypatch.setattr(decoders, "open_bytes", lambda uri: open(uri.removeprefix("store://box"), "rb"))
    clip = OpenCvDecoder().open(f"store://box{tmp_path}/a.mp4")
    assert os.path.exists(opened[0][0]) and opened[0][0].endswith(".mp4")
    clip.close()
    (tmp_path / "b.mp4").write_bytes(b"junk")
    with pytest.raises(ValueError):
        OpenCvDecoder().open(f"store://box{tmp_path}/b.mp4")
    assert len(opened) == 2 and not any(os.path.exists(path) for path, _ in opened)


def test_opencv_missing(monkeypatch):
    monkeypatch.setitem(sys.modules, "cv2", None)
    with pytest.raises(RuntimeError, match="not installed"):
        OpenCvDecoder().open("good.mp4")
