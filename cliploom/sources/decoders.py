"""Decoders: small objects that open one clip and read single frames from it.

A decoder has a ``name`` and ``open(path)``. What it returns has ``total_frames``,
``fps``, ``width``, ``height``, ``read(i)`` (RGB uint8 array or None) and ``close()``.
Decoders travel to the tasks, so they hold no open files.
"""

from __future__ import annotations

import os
import re
import tempfile

import numpy as np
import pyarrow.fs as pafs

PIECE = 8 << 20  # bytes copied at once


def open_bytes(path: str):
    """Seekable binary file from a local path or any URI that pyarrow knows."""
    if ":/" not in path:
        return open(path, "rb")
    filesystem, inner = pafs.FileSystem.from_uri(path)
    return filesystem.open_input_file(inner)


class NoFrames:
    """An empty file: a clip without frames."""

    total_frames = 0
    fps = width = height = None

    def read(self, i: int) -> None:
        return None

    def close(self) -> None:
        pass


# Chroma planes per Y4M colour space: (horizontal step, vertical step), None for grey.
_CHROMA = {"420": (2, 2), "422": (2, 1), "444": (1, 1), "mono": None}
_FRAME_MARK = b"FRAME\n"


class Y4MDecoder:
    """Uncompressed YUV4MPEG2 files. Frames have a fixed size, so reads seek directly."""

    name = "y4m"

    def open(self, path: str) -> Y4MClip | NoFrames:
        file = open_bytes(path)
        try:
            header = file.read(1024)
            if not header:
                file.close()
                return NoFrames()
            return Y4MClip(file, header)
        except Exception:
            file.close()
            raise


class Y4MClip:
    def __init__(self, file, header: bytes) -> None:
        line, end, _ = header.partition(b"\n")
        magic, *tags = line.decode("ascii", "replace").split(" ")
        if magic != "YUV4MPEG2" or not end:
            raise ValueError("not a YUV4MPEG2 file")
        tag = {t[0]: t[1:] for t in tags if t and t[0] != "X"}
        self.width, self.height = int(tag["W"]), int(tag["H"])
        rate, _, scale = tag.get("F", "25:1").partition(":")
        self.fps = int(rate) / int(scale or 1)
        colour = tag.get("C", "420")
        space = next((s for s in _CHROMA if colour.startswith(s)), None)
        if space is None or "p1" in colour:
            raise ValueError(f"colour space {colour} is not supported")
        self._step = _CHROMA[space]
        self._file = file
        self._start = len(line) + 1
        self._stride = len(_FRAME_MARK) + self._plane_bytes()
        stored = (file.seek(0, os.SEEK_END) or file.tell()) - self._start
        declared = next((t[len("XFRAMES=") :] for t in tags if t.startswith("XFRAMES=")), None)
        self.total_frames = int(declared) if declared else stored // self._stride

    def _chroma_shape(self) -> tuple[int, int]:
        across, down = self._step
        return -(-self.height // down), -(-self.width // across)

    def _plane_bytes(self) -> int:
        luma = self.height * self.width
        if self._step is None:
            return luma
        rows, cols = self._chroma_shape()
        return luma + 2 * rows * cols

    def read(self, i: int) -> np.ndarray | None:
        self._file.seek(self._start + i * self._stride)
        raw = self._file.read(self._stride)
        if len(raw) < self._stride or not raw.startswith(_FRAME_MARK):
            return None
        planes = np.frombuffer(raw, np.uint8, offset=len(_FRAME_MARK))
        luma_size = self.height * self.width
        luma = planes[:luma_size].reshape(self.height, self.width)
        if self._step is None:
            return np.repeat(luma[..., None], 3, axis=2)
        chroma = planes[luma_size:].reshape(2, *self._chroma_shape())
        return yuv_to_rgb(luma, chroma[0], chroma[1], self._step)

    def close(self) -> None:
        self._file.close()


# BT.601 luma weights of red and blue; studio range 16-235 and 16-240.
_RED, _BLUE = 0.299, 0.114
_ONE = 1 << 16


def _factor(value: float) -> np.int32:
    return np.int32(round(value * _ONE))


_LUMA = _factor(255 / 219)
_V_TO_RED = _factor(255 / 224 * 2 * (1 - _RED))
_U_TO_BLUE = _factor(255 / 224 * 2 * (1 - _BLUE))
_V_TO_GREEN = _factor(-255 / 224 * 2 * _RED * (1 - _RED) / (1 - _RED - _BLUE))
_U_TO_GREEN = _factor(-255 / 224 * 2 * _BLUE * (1 - _BLUE) / (1 - _RED - _BLUE))


def yuv_to_rgb(y: np.ndarray, u: np.ndarray, v: np.ndarray, step: tuple[int, int] = (1, 1)) -> np.ndarray:
    """Studio-range BT.601 planes to RGB bytes; chroma samples repeat over their block.

    In 16-bit fixed point, and with the chroma products at chroma resolution.
    """
    height, width = y.shape
    luma = y * _LUMA
    luma += _ONE // 2 - 16 * int(_LUMA)
    blue = u.astype(np.int32) - 128
    red = v.astype(np.int32) - 128
    across, down = step
    rgb = np.empty((height, width, 3), np.uint8)
    for channel, offset in enumerate((red * _V_TO_RED, blue * _U_TO_GREEN + red * _V_TO_GREEN, blue * _U_TO_BLUE)):
        if across > 1:
            offset = offset.repeat(across, axis=1)[:, :width]
        if down > 1:
            offset = offset.repeat(down, axis=0)[:height]
        value = luma + offset
        value >>= 16
        rgb[..., channel] = np.clip(value, 0, 255, out=value)
    return rgb


def spooled(path: str) -> str:
    """A copy of a file in the task's own temporary folder, in pieces; the caller removes it."""
    with open_bytes(path) as source, tempfile.NamedTemporaryFile(suffix=os.path.splitext(path)[1], delete=False) as copy:
        try:
            while piece := source.read(PIECE):
                copy.write(piece)
        except Exception:
            os.unlink(copy.name)
            raise
        return copy.name


def _remove(copy: str | None) -> None:
    if copy is not None and os.path.exists(copy):
        os.unlink(copy)


class OpenCvDecoder:
    """MP4 and other compressed files, where OpenCV is installed on the executors.

    OpenCV opens local files only: what lies elsewhere is first copied into a temporary file of the task, which goes
    when the clip is closed.
    """

    name = "opencv"

    def open(self, path: str) -> OpenCvClip:
        try:
            import cv2
        except ImportError as exc:
            raise RuntimeError("OpenCV is not installed") from exc
        if path.startswith("file:"):
            path = re.sub("^file:/+", "/", path) if path.startswith("file:/") else path[len("file:") :]
        copy = spooled(path) if "://" in path else None
        try:
            return OpenCvClip(cv2, copy or path, copy)
        except Exception:
            _remove(copy)
            raise


class OpenCvClip:
    def __init__(self, cv2, path: str, copy: str | None = None) -> None:
        self._cv2, self._copy = cv2, copy
        self._video = cv2.VideoCapture(path)
        if not self._video.isOpened():
            raise ValueError("cannot open")
        self.total_frames = max(0, int(self._video.get(cv2.CAP_PROP_FRAME_COUNT)))
        self.fps = self._video.get(cv2.CAP_PROP_FPS)
        self.width = int(self._video.get(cv2.CAP_PROP_FRAME_WIDTH))
        self.height = int(self._video.get(cv2.CAP_PROP_FRAME_HEIGHT))

    def read(self, i: int) -> np.ndarray | None:
        self._video.set(self._cv2.CAP_PROP_POS_FRAMES, i)
        found, frame = self._video.read()
        return frame[..., ::-1] if found else None

    def close(self) -> None:
        self._video.release()
        _remove(self._copy)


DEFAULT_DECODERS = (Y4MDecoder(), OpenCvDecoder())
