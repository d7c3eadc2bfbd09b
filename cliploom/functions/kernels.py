"""NumPy kernels for frames of unsigned bytes, used inside Arrow jobs.

Frames are (height, width, channels) uint8 arrays.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from cliploom.functions.pixels import MEAN, STD


def _axis_taps(old: int, new: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower, upper, weight of upper in units of 1/(2*new)) per target position.

    The source coordinate is (i + 1/2) * old / new - 1/2, clamped to the frame. Times
    2*new it is a whole number, so the weights are exact.
    """
    position = np.clip((2 * np.arange(new) + 1) * old - new, 0, 2 * new * (old - 1))
    low, weight = np.divmod(position, 2 * new)
    return low, np.minimum(low + 1, old - 1), weight


@lru_cache(maxsize=32)
def _bilinear_taps(old_h: int, old_w: int, height: int, width: int, channels: int) -> tuple[np.ndarray, ...]:
    """Row and element positions with their weights, in the narrowest type that holds the products."""
    number = np.int32 if 4 * height * width * 256 < 2**31 else np.int64
    y0, y1, wy = _axis_taps(old_h, height)
    x0, x1, wx = _axis_taps(old_w, width)
    left, right = ((x[:, None] * channels + np.arange(channels)).ravel() for x in (x0, x1))
    down = wy.astype(number)[:, None]
    across = np.repeat(wx, channels).astype(number)
    return y0, y1, 2 * height - down, down, left, right, 2 * width - across, across


def bilinear(frame: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear resize, half-pixel centres, edge clamp, rounded half up. Exact, in integers."""
    old_h, old_w, channels = frame.shape
    if (old_h, old_w) == (height, width):
        return frame
    y0, y1, up, down, left, right, back, across = _bilinear_taps(old_h, old_w, height, width, channels)
    lines = frame.reshape(old_h, old_w * channels)

    def line(y: np.ndarray) -> np.ndarray:
        source = lines[y]
        values = source[:, left] * back
        values += source[:, right] * across
        return values

    out = line(y0)
    out *= up
    lower = line(y1)
    lower *= down
    out += lower
    whole = 4 * height * width
    out += whole // 2
    out //= whole
    return out.astype(np.uint8).reshape(height, width, channels)


def nearest(frame: np.ndarray, height: int, width: int) -> np.ndarray:
    """Nearest-neighbour resize, source = min(int(i * old / new), old - 1)."""
    old_h, old_w = frame.shape[:2]
    rows = np.minimum((np.arange(height) * (old_h / height)).astype(np.int64), old_h - 1)
    cols = np.minimum((np.arange(width) * (old_w / width)).astype(np.int64), old_w - 1)
    return frame[rows[:, None], cols[None, :]]


RESIZERS = {"bilinear": bilinear, "nearest": nearest}


def normalize(frames: np.ndarray, dtype: str = "float32") -> np.ndarray:
    """(x/255 - mean[c]) / std[c] over the last axis."""
    width, channels = frames.shape[-2:]
    scale = np.tile(1.0 / (255.0 * np.array(STD)), width).astype(dtype)
    shift = np.tile(np.array(MEAN) / np.array(STD), width).astype(dtype)
    # Whole rows as the inner axis: a loop over 3 channels would not vectorise.
    values = np.multiply(frames.reshape(-1, width * channels), scale, dtype=dtype)
    values -= shift
    return values.reshape(frames.shape)


def normalized_mean(frame: np.ndarray) -> float:
    """Mean of ``normalize(frame)``, from exact sums per channel."""
    height, width, channels = frame.shape
    columns = frame.reshape(height, width * channels).sum(axis=0, dtype=np.int64)
    means = columns.reshape(width, channels).sum(axis=0) / (height * width)
    return float(((means / 255.0 - np.array(MEAN)) / np.array(STD)).mean())
