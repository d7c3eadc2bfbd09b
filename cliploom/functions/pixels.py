"""Pixel arithmetic on ``array`` columns, for small tensors.

All of it stays in Catalyst. Frames of real size are ``binary`` columns and go
through the Arrow functions of ``operators.frames`` with the same formulas.
Arrays are flat, row by row, channels innermost (HWC).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Per-channel mean and standard deviation (red, green, blue).
MEAN = (0.485, 0.456, 0.406)
STD = (0.229, 0.224, 0.225)


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    An outer expression used inside a lambda is otherwise computed once per element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _gather(px: Column, positions: Column) -> Column:
    """Elements of ``px`` at an array of positions."""
    return _once(px, lambda source: F.transform(positions, lambda at: F.get(source, at)))


def _rearranged(px: Column, source_of: Callable[[Column], Column]) -> Column:
    """As long as ``px``; element i comes from position ``source_of(i)``."""
    return _once(px, lambda source: F.transform(source, lambda _, i: F.get(source, source_of(i))))


def from_unit(values: Column) -> Column:
    """Map numbers in [-1, 1] to bytes 0..255, as array<int>."""
    return F.transform(
        values,
        lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((x.cast("double") + 1.0) * 127.5))).cast("int"),
    )


def scale_unit(px: Column) -> Column:
    """Bytes to [0, 1]."""
    return F.transform(px, lambda x: x / F.lit(255.0))


def normalize(px: Column, mean: tuple[float, ...] = MEAN, std: tuple[float, ...] = STD) -> Column:
    """(x/255 - mean[c]) / std[c], in double, for interleaved channels."""
    means, stds, channels = F.lit(list(mean)), F.lit(list(std)), len(mean)
    return F.transform(px, lambda x, i: (x / F.lit(255.0) - F.get(means, i % channels)) / F.get(stds, i % channels))


def reverse_channels(px: Column, channels: int = 3) -> Column:
    """BGR to RGB and back."""
    return _rearranged(px, lambda i: i - i % channels + (channels - 1) - i % channels)


def to_chw(px: Column, height: int, width: int, channels: int = 3) -> Column:
    """HWC to CHW."""
    plane = height * width
    return _rearranged(px, lambda i: (i % plane) * channels + F.floor(i / plane).cast("int"))


def flip_horizontal(px: Column, width: int, channels: int = 3) -> Column:
    """Mirror every row."""
    row = width * channels

    def source(i: Column) -> Column:
        column = F.floor((i % row) / channels).cast("int")
        return i - column * channels + (width - 1 - column) * channels

    return _rearranged(px, source)


def adjust_brightness(px: Column, factor: Column) -> Column:
    """Scale bytes by a factor, rounded down and clipped to 0..255."""
    return _once(factor, lambda f: F.transform(px, lambda x: F.least(F.lit(255), F.floor(x * f)).cast("int")))


def resize_nearest(px: Column, src: tuple[int, int], dst: tuple[int, int], channels: int = 1) -> Column:
    """Nearest neighbour: source = min(int(i * old / new), old - 1). Sizes are (height, width)."""
    rows = [min(int(i * (src[0] / dst[0])), src[0] - 1) for i in range(dst[0])]
    cols = [min(int(j * (src[1] / dst[1])), src[1] - 1) for j in range(dst[1])]
    offsets = [(y * src[1] + x) * channels + c for y in rows for x in cols for c in range(channels)]
    return _gather(px, F.lit(offsets))


def _taps(old: int, new: int) -> list[tuple[int, int, float]]:
    """(lower, upper, weight of upper) per target position, half-pixel centres."""
    taps = []
    for i in range(new):
        c = min(max((i + 0.5) * old / new - 0.5, 0.0), old - 1.0)
        low = math.floor(c)
        taps.append((low, min(low + 1, old - 1), c - low))
    return taps


def resize_bilinear(px: Column, src: tuple[int, int], dst: tuple[int, int], channels: int = 1) -> Column:
    """Bilinear with edge clamp, as array<double> (not rounded). Sizes are (height, width)."""
    corners = []
    for y0, y1, fy in _taps(src[0], dst[0]):
        for x0, x1, fx in _taps(src[1], dst[1]):
            for c in range(channels):
                corners.append(
                    F.struct(
                        *[
                            F.lit((y * src[1] + x) * channels + c).alias(name)
                            for name, y, x in (("a", y0, x0), ("b", y0, x1), ("c", y1, x0), ("d", y1, x1))
                        ],
                        F.lit(fy).alias("fy"),
                        F.lit(fx).alias("fx"),
                    )
                )

    def blend(source: Column, t: Column) -> Column:
        upper = F.get(source, t.a) * (1 - t.fx) + F.get(source, t.b) * t.fx
        lower = F.get(source, t.c) * (1 - t.fx) + F.get(source, t.d) * t.fx
        return upper * (1 - t.fy) + lower * t.fy

    return _once(px, lambda source: F.transform(F.array(*corners), lambda t: blend(source, t)))


def mean_value(values: Column) -> Column:
    """Mean of an array of numbers."""
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x) / F.size(values)


# --- seeded draws -----------------------------------------------------------
# md5 instead of rand(): the same in every run, for any partitioning, and for a
# task that runs again after an executor is lost.


def _hash_key(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def shuffle_key(seed: int, *parts: Column) -> Column:
    """Sort key that orders rows at random, the same for the same seed."""
    return _hash_key(seed, *parts)


def uniform_draw(seed: int, *parts: Column) -> Column:
    """Number in [0, 1) from the first 28 bits of the hash."""
    return F.conv(F.substring(_hash_key(seed, *parts), 1, 7), 16, 10).cast("double") / F.lit(float(16**7))


def synthetic_pixels(seed: int, key: Column, size: int) -> Column:
    """size pseudo-random bytes for a key, as array<int>."""
    blocks = F.transform(
        F.sequence(F.lit(0), F.lit(math.ceil(size / 16) - 1)),
        lambda b: F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"), b.cast("string"))),
    )
    places = F.sequence(F.lit(0), F.lit(size - 1))

    def byte(digits: Column, i: Column) -> Column:
        return F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("int")

    return _once(F.array_join(blocks, ""), lambda digits: F.transform(places, lambda i: byte(digits, i)))
