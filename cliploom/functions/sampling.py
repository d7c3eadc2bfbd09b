"""Evenly spaced positions inside a clip, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Values assumed when a header does not carry them.
DEFAULT_FRAMES = 1000
DEFAULT_DURATION = 10.0


def sample_indices(total: Column, n: int) -> Column:
    """n frame positions from 0 to total-1, both ends included, as array<bigint>.

    Positions repeat when the clip has fewer than n frames; a clip without frames
    gives an empty array. The step is a double: floor(i*(total-1)/(n-1)) in
    integers differs from the floating-point rule for some n.
    """
    last = total.cast("bigint") - 1
    step = last / F.lit(float(max(1, n - 1)))
    # Spelled out, not a lambda: compiled code, and the step is computed once.
    positions = [F.floor(F.lit(float(i)) * step) for i in range(n)]
    if n > 1:
        positions[-1] = last
    return F.when(total > 0, F.array(*positions)).otherwise(F.array().cast("array<bigint>"))


def sample_timestamps(duration: Column, n: int) -> Column:
    """n times in seconds from 0 to duration, both ends included, as array<double>."""
    end = duration.cast("double")
    step = end / F.lit(float(max(1, n - 1)))
    times = [F.lit(float(i)) * step for i in range(n)]
    if n > 1:
        times[-1] = end
    return F.array(*times)


def frame_at(timestamp: Column, fps: Column, total: Column) -> Column:
    """Frame shown at a time. The end of the clip maps to its last frame."""
    return F.least(F.floor(timestamp * fps), total.cast("bigint") - 1)


def time_indices(total: Column, fps: Column, n: int) -> Column:
    """Frames shown at n times evenly spread over a clip, as array<bigint>; without a rate the assumed duration counts."""
    rate = F.when(fps > 0, fps).otherwise(total / F.lit(DEFAULT_DURATION))
    times = sample_timestamps(total / rate, n)
    shown = F.transform(times, lambda t: frame_at(t, rate, total))
    return F.when(total > 0, shown).otherwise(F.array().cast("array<bigint>"))


def frames_or_default(total: Column) -> Column:
    return F.coalesce(total.cast("bigint"), F.lit(DEFAULT_FRAMES).cast("bigint"))


def duration_or_default(duration: Column) -> Column:
    return F.coalesce(duration.cast("double"), F.lit(DEFAULT_DURATION))
