"""Frame operators: sampling, fan-out, decode, resize, normalise.

Rows follow ``schemas.FRAMES``: one row per sampled frame, pixels as unsigned
bytes until the last step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import suppress
from dataclasses import dataclass, replace
from functools import reduce
from itertools import batched, groupby
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliploom import schemas
from cliploom.functions import kernels
from cliploom.functions.paths import video_name
from cliploom.functions.pixels import uniform_draw
from cliploom.functions.sampling import sample_indices, time_indices
from cliploom.operators.sizing import fits_broadcast, may_be_in
from cliploom.session import shared_dir

# Frames per Arrow batch leaving a decode job: 64 frames of 224x224x3 are 10 MB.
FRAMES_PER_BATCH = 64


# --- sampling ---------------------------------------------------------------


def positions(total: Column, n: int, fps: Column | None = None) -> Column:
    """The n frames to read from a clip, as array<bigint>: all null for a clip without frames.

    Evenly spread over its frames or, given a frame rate, over its time.
    """
    sampled = sample_indices(total, n) if fps is None else time_indices(total, fps, n)
    return F.when(total > 0, sampled).otherwise(F.array(*[F.lit(None).cast("bigint")] * n))


def fan_out(clips: DataFrame, n: int, total: str = "total_frames", fps: str | None = None) -> DataFrame:
    """One row per frame to read: adds ``k`` (0..n-1) and ``frame_idx``.

    A clip without frames still gives n rows, with a null ``frame_idx``.
    """
    wanted = positions(F.col(total), n, F.col(fps) if fps else None)
    return clips.select("*", F.posexplode(wanted).alias("k", "frame_idx"))


def tasks_for(rows: int, per_task: int, least: int = 1) -> int:
    """Number of tasks so that none gets more than about ``per_task`` rows."""
    return max(least, -(-rows // per_task))


def spread(requests: DataFrame, partitions: int, by_frame: bool = True) -> DataFrame:
    """Distribute frame requests over tasks, in (clip, k) order inside each task.

    ``by_frame`` puts the frames of one clip in different tasks; otherwise a clip stays
    whole and is opened once. Rows are a few bytes here and the work behind them is
    large, so the number of tasks is given and not left to a size estimate.
    """
    keys = ["video_idx", "k"] if by_frame else ["video_idx"]
    return requests.repartition(partitions, *keys).sortWithinPartitions("video_idx", "k")


def fetch(requests: DataFrame, stored: DataFrame, on: Sequence[str]) -> DataFrame:
    """Read requested frames from a stored frame table; misses keep their row with nulls.

    ``on`` is unique in ``stored`` and a request repeats a key at most n times, so no key is hot but
    null, which misses find: such rows stay out of the join. Requests are narrow and
    used more than once, so they are checkpointed. Their keys filter ``stored`` as it is scanned, so that pixels
    nobody asked for are not shuffled: few keys are broadcast, many are tested in a bitmap.
    """
    shared_dir(requests.sparkSession)
    requests = requests.checkpoint()
    complete = reduce(Column.__and__, (F.col(c).isNotNull() for c in on))
    keys = requests.select(*on).where(complete)
    if fits_broadcast(keys):
        stored = stored.join(F.broadcast(keys), list(on), "left_semi")
    else:
        stored = stored.where(may_be_in(keys, on))
    found = requests.where(complete).join(stored, list(on), "left")
    return found.unionByName(requests.where(~complete), allowMissingColumns=True)


def zero_fill(frames: DataFrame, zeros: Column, data: str = "data") -> DataFrame:
    """Replace missing pixels by zeros and flag the row."""
    missing = F.col(data).isNull()
    return frames.withColumns(
        {
            data: F.coalesce(data, zeros),
            "status": F.when(F.col("frame_idx").isNull(), schemas.EMPTY)
            .when(missing, schemas.ZERO_FILLED)
            .otherwise(schemas.OK),
        }
    )


# --- decode -----------------------------------------------------------------


def decode(
    requests: DataFrame, decoders: Sequence, height: int, width: int, method: str = "bilinear", prefer: str | None = None
) -> DataFrame:
    """Read, resize and return the requested frames as ``schemas.FRAMES``.

    ``requests`` has ``video_idx, video_path, k, frame_idx`` and may carry the probe's
    ``error``. Each clip goes to the preferred decoder, or to the first one that opens it.
    A frame that cannot be read becomes zeros (``zero_filled``); a clip that no decoder
    opens becomes zeros with ``status = error`` and the message. The job itself never
    fails on bad media.
    """
    chain = ordered_chain(decoders, prefer)
    schema = schemas.arrow(schemas.FRAMES)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _read_requests(stream, chain, height, width, method)
        rows = ((*row, height, width, 3, "HWC", data, status, error) for row, data, status, error in read)
        for some in batched(rows, FRAMES_PER_BATCH):
            yield schemas.arrow_batch(some, schema)

    return _narrow(requests).mapInArrow(run, schemas.FRAMES)


def decode_stacked(
    requests: DataFrame, decoders: Sequence, height: int, width: int, method: str = "bilinear", prefer: str | None = None
) -> DataFrame:
    """Like ``decode`` followed by ``clips.stack``, without moving pixels between tasks.

    The requests of a clip must be neighbours in one task, as ``fan_out`` leaves them and
    as ``spread(..., by_frame=False)`` does. Returns ``schemas.TENSORS``.
    """
    chain = ordered_chain(decoders, prefer)
    schema = schemas.arrow(schemas.TENSORS)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for clip in _read_clips(stream, chain, height, width, method):
            tensor = (height, width, 3, "uint8", "HWC", b"".join(clip.data))
            row = (clip.video_idx, clip.path, clip.name, clip.size, len(clip.data), *tensor, clip.delivered, clip.status, clip.error)
            yield schemas.arrow_batch([row], schema)

    return _narrow(requests).mapInArrow(run, schemas.TENSORS)


def decode_means(
    requests: DataFrame, decoders: Sequence, height: int, width: int, method: str = "bilinear", prefer: str | None = None
) -> DataFrame:
    """Mean of each clip's normalised frames: what ``decode_stacked``, ``normalize`` and
    ``mean_value`` give, with no pixel leaving the decode task. Returns ``schemas.CLIP_MEANS``.
    """
    chain = ordered_chain(decoders, prefer)
    schema = schemas.arrow(schemas.CLIP_MEANS)

    def rows(stream: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for clip in _read_clips(stream, chain, height, width, method):
            mean = 0.0
            if clip.status != schemas.ERROR:
                frames = [np.frombuffer(d, np.uint8).reshape(height, width, 3) for d in clip.data]
                mean = sum(map(kernels.normalized_mean, frames)) / len(frames)
            yield clip.video_idx, clip.path, clip.name, clip.size, clip.delivered, clip.status, clip.error, mean

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batched(rows(stream), FRAMES_PER_BATCH):
            yield schemas.arrow_batch(some, schema)

    return _narrow(requests).mapInArrow(run, schemas.CLIP_MEANS)


def decode_batches(
    requests: DataFrame,
    decoders: Sequence,
    height: int,
    width: int,
    size: int,
    method: str = "bilinear",
    prefer: str | None = None,
    dtype: str = "float32",
) -> DataFrame:
    """Collated training batches, one row each: clips ``size`` by ``size`` in index order.

    The requests of a batch must be neighbours in one task; then collating moves no
    pixels. Returns ``schemas.BATCHES``.
    """
    chain = ordered_chain(decoders, prefer)
    schema = schemas.arrow(schemas.BATCHES)

    def tensor(clip: _DecodedClip) -> bytes:
        shape = (len(clip.data), height, width, 3)
        if clip.status == schemas.ERROR:
            return np.zeros(shape, dtype).tobytes()
        pixels = np.frombuffer(b"".join(clip.data), np.uint8).reshape(shape)
        return np.moveaxis(kernels.normalize(pixels, dtype), -1, -3).tobytes()

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _read_clips(stream, chain, height, width, method)
        for batch_id, group in groupby(read, key=lambda clip: clip.video_idx // size):
            clips = list(group)
            shape = (len(clips), len(clips[0].data), height, width, 3, dtype, "CHW")
            paths = [c.path for c in clips]
            names = [c.name for c in clips]
            data = b"".join(map(tensor, clips))
            yield schemas.arrow_batch([(batch_id, *shape, data, paths, names, [c.status for c in clips])], schema)

    return _narrow(requests).mapInArrow(run, schemas.BATCHES)


def _narrow(requests: DataFrame) -> DataFrame:
    own = {"video_size": "bigint", "error": "string"}
    size, error = (F.col(c) if c in requests.columns else F.lit(None).cast(kind).alias(c) for c, kind in own.items())
    name = video_name(F.col("video_path")).alias("video_name")
    return requests.select("video_idx", "video_path", name, size, "k", "frame_idx", error)


def ordered_chain(decoders: Sequence, prefer: str | None) -> list:
    """The decoder called ``prefer`` alone (any case), or all of them in order."""
    named = [d for d in decoders if prefer and d.name.lower() == prefer.lower()]
    return named[:1] or list(decoders)


class OpenClip:
    """One clip, read by the first decoder that opens it; when a read raises, by the next one.

    Whatever a codec does wrong is data here, never a reason to fail the job.
    """

    def __init__(self, chain: Sequence, path: str) -> None:
        self._left = list(chain)
        self._path = path
        self._errors: list[str] = []
        self.clip = None
        self._next()

    def _next(self) -> None:
        self.close()
        self.clip = None
        while self.clip is None and self._left:
            self._name, decoder = self._left[0].name, self._left.pop(0)
            try:
                self.clip = decoder.open(self._path)
            except Exception as exc:
                self._errors.append(f"{self._name}: {exc}")

    @property
    def error(self) -> str | None:
        """Why no decoder is left, or None while there is one."""
        return None if self.clip is not None else "; ".join(self._errors) or "no decoder"

    def read(self, at: int) -> np.ndarray | None:
        while self.clip is not None:
            try:
                return self.clip.read(at)
            except Exception as exc:
                self._errors.append(f"{self._name}: {exc}")
                self._next()
        return None

    def close(self) -> None:
        if self.clip is not None:
            self.clip.close()


def _read_requests(stream, chain, height, width, method):
    """Yield (request, bytes, status, error), keeping one clip open at a time."""
    resize = kernels.RESIZERS[method]
    zeros = bytes(height * width * 3)
    current, clip = None, None
    try:
        for batch in stream:
            for *row, failure in zip(*[column.to_pylist() for column in batch.columns], strict=True):
                video_idx, path, *_, at = row
                if failure is not None:
                    yield row, zeros, schemas.ERROR, failure
                    continue
                if at is None:
                    yield row, zeros, schemas.EMPTY, None
                    continue
                if (video_idx, path) != current:
                    if clip is not None:
                        clip.close()
                    current, clip = (video_idx, path), OpenClip(chain, path)
                frame = clip.read(at)
                if clip.error is not None:
                    yield row, zeros, schemas.ERROR, clip.error
                elif frame is None:
                    yield row, zeros, schemas.ZERO_FILLED, None
                else:
                    yield row, resize(frame, height, width).tobytes(), schemas.OK, None
    finally:
        if clip is not None:
            clip.close()


@dataclass(frozen=True)
class _DecodedClip:
    video_idx: int
    path: str
    name: str
    size: int | None
    data: list[bytes]
    status: str
    error: str | None

    @property
    def delivered(self) -> int:
        return 0 if self.status == schemas.ERROR else len(self.data)


def _read_clips(stream, chain, height, width, method) -> Iterator[_DecodedClip]:
    """Group neighbouring requests into clips; a clip has the worst status of its frames."""
    read = _read_requests(stream, chain, height, width, method)
    for clip, group in groupby(read, key=lambda r: tuple(r[0][:4])):
        _, data, statuses, errors = zip(*group, strict=True)
        status = max(statuses, key=schemas.SEVERITY.index)
        yield _DecodedClip(*clip, list(data), status, next(filter(None, errors), None))


# --- arrays and bytes -------------------------------------------------------


def from_arrays(df: DataFrame, px: Column, height: int, width: int, channels: int) -> DataFrame:
    """Add the pixel columns of ``schemas.FRAMES`` from an array of bytes 0..255."""

    @F.arrow_udf("binary")
    def pack(values: pa.Array) -> pa.Array:
        present = values.is_valid().to_numpy(zero_copy_only=False)
        if not present.any():
            return pa.nulls(len(values), pa.binary())
        flat = values.drop_null().flatten().to_numpy().astype(np.uint8)
        packed = _as_binary(flat.reshape(-1, height * width * channels))
        return packed if present.all() else packed.take(pa.array(np.cumsum(present) - 1, mask=~present))

    return df.withColumns(
        {
            "height": F.lit(height),
            "width": F.lit(width),
            "channels": F.lit(channels),
            "layout": F.lit("HWC"),
            "data": pack(px),
            "status": F.lit(schemas.OK),
            "error": F.lit(None).cast("string"),
        }
    )


def to_array(data: Column, dtype: str = "uint8") -> Column:
    """Values of a binary column as array<double>, for small frames."""

    @F.arrow_udf("array<double>")
    def unpack(values: pa.Array) -> pa.Array:
        rows = [np.frombuffer(v.as_buffer(), dtype).astype(np.float64) if v.is_valid else None for v in values]
        return pa.array(rows, pa.list_(pa.float64()))

    return unpack(data)


# --- per-frame functions on binary pixels -----------------------------------

# Rows go to a kernel together up to this size, so that small frames do not cost a call each
# and large ones stay in cache.
BYTES_PER_CALL = 1 << 20


def _map_rows(data: pa.Array, sizes: Sequence[pa.Array], kernel: Callable[..., np.ndarray]) -> pa.Array:
    """Apply a kernel to the rows of a binary column; null stays null.

    ``sizes`` are height, width, channels and maybe further values. Neighbours that agree
    on them go together, as (rows, frames, height, width, channels); a row is one frame or
    a stacked clip.
    """
    keys = zip(pc.binary_length(data).to_pylist(), *[s.to_pylist() for s in sizes], strict=True)
    parts, at = [], 0
    for (length, *size), group in groupby(keys):
        end = at + sum(1 for _ in group)
        if length is None:
            parts.append(pa.nulls(end - at, pa.binary()))
        else:
            step = max(1, BYTES_PER_CALL // max(1, length))
            for start in range(at, end, step):
                rows = _stacked_bytes(data.slice(start, min(step, end - start)), length)
                parts.append(_as_binary(kernel(rows.reshape(len(rows), -1, *size[:3]), *size[3:])))
        at = end
    return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())


def _stacked_bytes(rows: pa.Array, length: int) -> np.ndarray:
    """Rows of equal length as a (rows, length) view."""
    first = np.frombuffer(rows.buffers()[1], np.int32)[rows.offset]
    return np.frombuffer(rows.buffers()[2], np.uint8, len(rows) * length, first).reshape(len(rows), length)


def _as_binary(values: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(values).reshape(len(values), -1).view(np.uint8)
    fixed = pa.binary(flat.shape[1])
    return pa.FixedSizeBinaryArray.from_buffers(fixed, len(flat), [None, pa.py_buffer(flat)]).cast(pa.binary())


@dataclass(frozen=True)
class _Steps:
    """Kernels that follow one another, before they run: ``source`` has the pixels and the kernels' arguments under hidden names."""

    source: DataFrame
    hidden: str
    kernels: tuple[Callable[..., np.ndarray], ...] = ()
    arguments: tuple[tuple[str, ...], ...] = ()

    def then(self, kernel: Callable[..., np.ndarray], more: Sequence[Column], changed: dict[str, Column]) -> _Steps:
        values = [F.col("height"), F.col("width"), F.col("channels"), *more]
        names = tuple(f"{self.hidden}{len(self.kernels)}_{i}" for i in range(len(values)))
        source = self.source.withColumns({**dict(zip(names, values, strict=True)), **changed})
        return _Steps(source, self.hidden, (*self.kernels, kernel), (*self.arguments, names))

    def run(self) -> DataFrame:
        kernels, counts = self.kernels, [len(names) for names in self.arguments]

        @F.arrow_udf("binary")
        def apply(data: pa.Array, *arguments: pa.Array) -> pa.Array:
            at = 0
            for kernel, count in zip(kernels, counts, strict=True):
                data = _map_rows(data, arguments[at : at + count], kernel)
                at += count
            return data

        names = [name for own in self.arguments for name in own]
        done = self.source.withColumn(self.hidden, apply(self.hidden, *names))
        return done.drop(*names).withColumnRenamed(self.hidden, "data")


_steps: WeakKeyDictionary[DataFrame, _Steps] = WeakKeyDictionary()


def _apply(frames: DataFrame, kernel: Callable[..., np.ndarray], *more: Column, **changed: Column) -> DataFrame:
    """Replace ``data`` by the kernel's result, and other columns as given.

    A kernel that follows another one directly runs in the same Python worker. A step that is kept or whose arguments
    depend on the pixels themselves starts anew.
    """
    steps = None
    if frames in _steps and not frames.is_cached:
        with suppress(AnalysisException):  # the pixels are hidden
            steps = _steps[frames].then(kernel, more, changed)
    if steps is None:
        hidden = "_pixels"
        while any(c.lower().startswith(hidden) for c in frames.columns):
            hidden = "_" + hidden
        steps = _Steps(frames, hidden).then(kernel, more, changed)
        steps = replace(steps, source=steps.source.withColumnRenamed("data", hidden))
    done = steps.run()
    _steps[done] = steps
    return done


def resize(frames: DataFrame, height: int, width: int, method: str = "bilinear") -> DataFrame:
    one = kernels.RESIZERS[method]

    def kernel(rows: np.ndarray) -> np.ndarray:
        return np.stack([[one(f, height, width) for f in row] for row in rows])

    return _apply(frames, kernel, height=F.lit(height), width=F.lit(width))


def reverse_channels(frames: DataFrame) -> DataFrame:
    """BGR to RGB and back."""
    return _apply(frames, lambda rows: rows[..., ::-1])


def to_rgb(frames: DataFrame) -> DataFrame:
    """BGR, BGRA or grey pixels to RGB."""

    def kernel(rows: np.ndarray) -> np.ndarray:
        return rows[..., 2::-1] if rows.shape[-1] >= 3 else rows[..., :1].repeat(3, axis=-1)

    return _apply(frames, kernel, channels=F.lit(3))


def to_chw(frames: DataFrame) -> DataFrame:
    """Rewrite HWC pixels as CHW. The size columns keep their meaning."""
    return _apply(frames, lambda rows: np.moveaxis(rows, -1, -3), layout=F.lit("CHW"))


def transform(frames: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply user transforms in order. Each takes and returns a frame DataFrame."""
    for step in steps:
        frames = frames.transform(step)
    return frames


def random_flip(frames: DataFrame, seed: int, p: float = 0.5, keys: Sequence[str] = ("video_idx", "k")) -> DataFrame:
    """Mirror a frame with probability p. The draw depends on the seed and the frame's keys only."""
    flip = uniform_draw(seed, *[F.col(k) for k in keys]) < p
    return _apply(frames, lambda rows, flipped: rows[..., ::-1, :] if flipped else rows, flip)


def jitter_brightness(
    frames: DataFrame, seed: int, amount: float = 0.2, keys: Sequence[str] = ("video_idx", "k")
) -> DataFrame:
    """Scale a frame by a factor drawn from 1-amount to 1+amount, clipped to 0..255."""
    factor = F.lit(1 - amount) + F.lit(2 * amount) * uniform_draw(seed, *[F.col(k) for k in keys])
    return _apply(frames, lambda rows, f: np.minimum(rows * f, 255).astype(np.uint8), factor)


def normalize(frames: DataFrame, dtype: str = "float32", layout: str = "HWC") -> DataFrame:
    """Bytes (HWC) to (x/255 - mean)/std as little-endian ``dtype``; the last step before a consumer.

    Zero-filled frames and empty clips were zero before this step and come out as
    -mean/std. Frames of a clip that failed are zero after it.
    """

    def kernel(rows: np.ndarray, failed: bool) -> np.ndarray:
        values = np.zeros(rows.shape, dtype) if failed else kernels.normalize(rows, dtype)
        return np.moveaxis(values, -1, -3) if layout == "CHW" else values

    return _apply(frames, kernel, F.col("status") == schemas.ERROR, dtype=F.lit(dtype), layout=F.lit(layout))


def mean_value(data: Column, dtype: str = "float32") -> Column:
    """Mean of the values in a binary column."""

    @F.arrow_udf("double")
    def apply(values: pa.Array) -> pa.Array:
        means = [np.frombuffer(v.as_buffer(), dtype).mean(dtype=np.float64) if v.is_valid else None for v in values]
        return pa.array(means, pa.float64())

    return apply(data)
