"""Best-fit packing: documents as token pieces in as few sequences of fixed size as best fit finds.

Only lengths decide a packing, and there are at most ``size`` of them. So tasks count pieces
per length, the driver packs these counts (longest first, each piece into the tightest open
sequence that a segment tree finds), and tasks look up their pieces' places by length and rank.
What the driver and the tasks hold depends on ``size`` and not on the number of documents.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cliploom.llm.common import kept
from cliploom.llm.tokens import byte_encoder, encoded
from cliploom.operators.sizing import broadcast_if_small

SIZE = 1024
END_ID = 2
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task int, task_rank bigint"
PACKED = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"


class OpenSequences:
    """Segment tree over remaining capacities 0..size; each capacity keeps runs of sequences (first, count)."""

    def __init__(self, size: int):
        self._leaves = 1 << size.bit_length()
        self._open = [0] * (2 * self._leaves)  # sequences below each node
        self._runs: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def _add(self, capacity: int, count: int) -> None:
        node = capacity + self._leaves
        while node:
            self._open[node] += count
            node //= 2

    def put(self, capacity: int, first: int, count: int) -> None:
        if count and capacity:
            self._runs[capacity].append((first, count))
            self._add(capacity, count)

    def take(self, capacity: int) -> tuple[int, int]:
        first, count = self._runs[capacity].pop()
        self._add(capacity, -count)
        return first, count

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least ``least`` that an open sequence has."""
        node = least + self._leaves
        if self._open[node]:
            return least
        while node > 1:  # up to the first right-hand neighbour that has sequences, then down to its left-most
            if node % 2 == 0 and self._open[node + 1]:
                node += 1
                while node < self._leaves:
                    node = 2 * node + (not self._open[2 * node])
                return node - self._leaves
            node //= 2
        return None


@dataclass(frozen=True)
class Placement:
    """Pieces of one length with ranks from ``rank``: ``each`` to a sequence, from ``sequence`` on, at ``offset``."""

    length: int
    rank: int
    sequence: int
    each: int
    offset: int


def best_fit_decreasing(counts: Mapping[int, int], size: int = SIZE) -> tuple[list[Placement], int]:
    """Placements of ``counts[length]`` pieces of each length, and the number of sequences.

    Equal pieces are placed a run at a time, to the same result as one by one: after a piece
    went to the tightest sequence, that sequence is tightest for the next one while it has room.
    """
    bins, placements, used = OpenSequences(size), [], 0
    for length in sorted(counts, reverse=True):
        if not 0 < length <= size:
            raise ValueError(f"pieces of {length} tokens for sequences of {size}")
        rank, left = 0, counts[length]
        while left:
            capacity = bins.tightest(length)
            if capacity is None:
                capacity, first, there = size, used, -(-left // (size // length))
                used += there
            else:
                first, there = bins.take(capacity)
            each = capacity // length
            full = min(there, left // each)
            placements.append(Placement(length, rank, first, each, size - capacity))
            rest = min(left - full * each, each - 1) if full < there else 0
            bins.put(capacity - each * length, first, full)
            if rest:
                bins.put(capacity - rest * length, first + full, 1)
            bins.put(capacity, first + full + bool(rest), there - full - bool(rest))
            rank, left = rank + full * each + rest, left - full * each - rest
    return placements, used


def pieces(docs: DataFrame, vocabulary: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """One row per piece of each document's ids, with an end id after the last: whole pieces of
    ``size`` ids, before them a shorter one with the rest. A null or empty text is the end id alone.

    ``task`` and ``task_rank`` number the pieces of a length; write the rows before using them.
    """
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, seen = byte_encoder(vocabulary), TaskContext.get().partitionId(), defaultdict(int)
        for batch, (ids, at) in encoded(batches, "text", lambda texts: encoder.encode_column(texts, end)):
            rows, raw, at = [], memoryview(ids).cast("B"), at.tolist()
            for doc_id, first, last in zip(batch.column("doc_id").to_pylist(), at[:-1], at[1:], strict=True):
                n = last - first
                found = raw[4 * first : 4 * last]
                ends = range(n % size or size, n + 1, size)
                for piece, stop in enumerate(ends):
                    start = max(0, stop - size) if piece else 0
                    length = stop - start
                    rows.append((doc_id, piece, start, length, zlib.crc32(found[4 * start : 4 * stop]), task, seen[length]))
                    seen[length] += 1
            columns = list(zip(*rows, strict=True))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = [c.split()[0] for c in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def pack(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """Sequence and offset of each piece. ``cut`` is what ``pieces`` returns, written to files.

    Sequences are filled without gaps from offset 0. Repeated rows are packed as often as
    they come; no pieces, no rows. Of equal lengths any may go first.
    """
    per_task = cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    per_task = kept(per_task.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "lengths")
    counts = {row.length: row.n for row in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    placements, _ = best_fit_decreasing(counts, size)
    ranked = cut.join(broadcast_if_small(per_task.drop("n")), ["task", "length"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("task_rank"))
    names = [c.split()[0] for c in PACKED.split(", ")]
    return ranked.select(*names[:5], "rank").mapInArrow(_places(placements), PACKED)


def _places(placements: list[Placement]) -> Callable:
    """Look up places by (length, rank). The table has a few rows per length."""
    ordered = sorted(placements, key=lambda p: (p.length, p.rank))
    keys = np.array([(p.length << 48) + p.rank for p in ordered], dtype=np.int64)
    rank, sequence, each, offset = (
        np.array([getattr(p, field) for p in ordered], dtype=np.int64) for field in ("rank", "sequence", "each", "offset")
    )

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, own = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 48) + own, "right") - 1
            later = own - rank[at]
            places = (sequence[at] + later // each[at], offset[at] + later % each[at] * length)
            columns = [*batch.columns[:-1], *map(pa.array, places)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "sequence_id", "offset"])

    return look_up


def pack_documents(docs: DataFrame, vocabulary: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """Cut and pack documents; see ``pieces`` and ``pack``. Columns other than doc_id and text are ignored."""
    return pack(kept(pieces(docs, vocabulary, size, end_id), "pieces"), size)
