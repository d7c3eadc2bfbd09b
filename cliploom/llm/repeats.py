"""Repeated byte strings across documents: every byte of a repeat but those of its first occurrence.

A window is a string of ``WINDOW`` bytes inside a document's UTF-8 text. A byte is removed when a window
that covers it also starts earlier: in a document of smaller id, or earlier in the same one.
Windows are compared as given, not as what is left after removals.

The windows are ordered by most-significant-digit passes, as a radix sort of suffixes to a depth of WINDOW
would do; a group that a pass leaves with one member is done. The digits are chosen so that
far fewer than all suffixes move:

1. The first digit of a window is the least of its grams of ``GRAM`` bytes by hash. Equal windows have it at
   the same place, and neighbours share it: windows go in runs around one gram, about one run per 27 bytes.
2. The second digit is all bytes that the windows of a run cover. Runs that agree in it are equal
   window by window: all but the first are repeats.
3. Where runs with one gram differ in the second digit, the first run of each kind is opened and the third digit is
   the whole window, at full depth. Groups that are equal here are exactly the repeated windows.

Digits are compared by two independent 64-bit hashes. Runs travel as packed arrays, a row per block of texts and
bucket of digits. Grams that a bounded sample shows to be frequent are dealt out by the second digit
as well, so that no gram, however common, is one task's work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliploom.llm.common import kept
from cliploom.llm.textbytes import Substrings, blocks, merge_spans, mix
from cliploom.operators.index import dense_index
from cliploom.operators.sizing import broadcast_or_merge

WINDOW = 100
GRAM = 48
BUCKET_BYTES = 16 << 20  # text behind one bucket of digits
SAMPLE = 4_000  # texts that tell frequent grams
FREQUENT = 200_000  # grams at most that count as frequent
_OFTEN = 8  # texts of the sample
WINDOWS_AT_ONCE = 200_000

RUN = np.dtype([("gram", "<u8"), ("all", "<u8"), ("doc", "<i8"), ("start", "<i4"), ("n", "u1"), ("state", "u1")])
WIDE = np.dtype([("one", "<u8"), ("two", "<u8"), ("doc", "<i8"), ("start", "<i4"), ("state", "u1")])
_OPEN, _REPEAT = 0, 1  # state: still to compare, known to occur earlier
PACKED = "bucket bigint, rows binary"
FOUND = "doc bigint, start int, n int, open boolean"


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, by doubling."""
    reach = 1
    while 2 * reach <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def window_runs(data: np.ndarray, at: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """Runs of windows around one gram: their texts, first starts in the block, numbers of windows, and both digits."""
    empty = np.zeros(0, np.int64)
    if len(data) < window:
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    hashes = Substrings(data).hash_all(gram)
    bits = np.uint64(max(1, int(len(hashes)).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    place = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)  # of equal grams the first
    least = _sliding_least(place, window - gram + 1)
    edges = np.zeros(len(least) + 1, np.int64)
    long = np.flatnonzero(np.diff(at) >= window)
    np.add.at(edges, at[:-1][long], 1)
    np.add.at(edges, at[1:][long] - window + 1, -1)
    valid = np.cumsum(edges)[:-1] > 0
    starts = np.flatnonzero(valid)
    anchor = (least[starts] & low).astype(np.int64)
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]][: len(anchor)])
    n = np.diff(np.r_[first, len(anchor)])
    start, anchor = starts[first], anchor[first]
    text = np.searchsorted(at, start, "right") - 1
    covered = Substrings(data, second=True).hash(start, start + n + window - 1)
    return text, start, n, hashes[anchor], covered


def _first_in_group(rows: np.ndarray, *digits: str) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by digits, then document and start, and which of them are first with their digits."""
    rows = rows[np.lexsort((rows["start"], rows["doc"], *(rows[d] for d in reversed(digits))))]
    first = np.ones(len(rows), bool)
    first[1:] = np.logical_or.reduce([rows[d][1:] != rows[d][:-1] for d in digits])
    return rows, first


def _pack(rows: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(bucket)])
    ends = np.r_[first[1:], len(rows)][: len(first)]
    packed = [rows[a:b].tobytes() for a, b in zip(first.tolist(), ends.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int64)), pa.array(packed, pa.binary())], ["bucket", "rows"])


def _deal(rows: np.ndarray, digits: tuple[str, str], key: Callable, buckets: int) -> pa.RecordBatch:
    """Rows of a block by bucket. What repeats inside the block is known to, and is dealt out evenly."""
    rows, first = _first_in_group(rows, *digits)
    rows["state"] = np.where(first, rows["state"], _REPEAT)
    anywhere = mix(rows["doc"].astype(np.uint64) + mix(rows["start"].astype(np.uint64)))
    return _pack(rows, np.where(first, key(rows), anywhere) % np.uint64(buckets))


def _runs_by_gram(buckets: int, frequent: np.ndarray) -> Callable:
    def key(rows: np.ndarray) -> np.ndarray:
        own = rows["gram"]
        if len(frequent):
            own = np.where(np.isin(own, frequent), mix(own ^ rows["all"]), own)
        return mix(own)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc").to_numpy(zero_copy_only=False)
            for first, _, data, at in blocks(batch.column("text")):
                text, start, n, gram, covered = window_runs(data, at)
                rows = np.zeros(len(start), RUN)
                rows["gram"], rows["all"], rows["doc"] = gram, covered, ids[first + text]
                rows["start"], rows["n"] = start - at[text], n
                yield _deal(rows, ("gram", "all"), key, buckets)

    return make


def _by_bucket(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> Iterator[np.ndarray]:
    """All rows of a bucket at a time. Batches come sorted by bucket."""
    last, parts = None, []
    for batch in batches:
        for bucket, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if bucket != last and parts:
                yield np.frombuffer(b"".join(parts), kind)
                parts = []
            last = bucket
            parts.append(packed.as_py())
    if parts:
        yield np.frombuffer(b"".join(parts), kind)


def _found(rows: np.ndarray, n: np.ndarray, still_open: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(rows["doc"]), pa.array(rows["start"]), pa.array(n.astype(np.int32)), pa.array(still_open)]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in FOUND.split(", ")])


def _compare_runs(frequent: np.ndarray) -> Callable:
    """Second digit: runs that repeat, and first runs of their kind whose gram has other kinds."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_bucket(batches, RUN):
            known, rows = rows[rows["state"] == _REPEAT], rows[rows["state"] == _OPEN]
            rows, first = _first_in_group(rows, "gram", "all")
            repeats = np.concatenate([known, rows[~first]])
            yield _found(repeats, repeats["n"], np.zeros(len(repeats), bool))
            kinds = rows[first]
            same = np.zeros(len(kinds) + 1, bool)
            same[1:-1] = kinds["gram"][1:] == kinds["gram"][:-1]
            opened = kinds[same[1:] | same[:-1] | np.isin(kinds["gram"], frequent)]
            yield _found(opened, opened["n"], np.ones(len(opened), bool))

    return compare


def _windows(buckets: int) -> Callable:
    """Third digit: the windows of opened runs."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, runs = batch.column("doc").to_numpy(zero_copy_only=False), batch.column("runs")
            for first, end, data, at in blocks(batch.column("text")):
                own = runs.slice(first, end - first)
                text = np.repeat(np.arange(end - first), pc.list_value_length(own).to_numpy(zero_copy_only=False))
                start, n = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in own.flatten().flatten())
                one, two = Substrings(data), Substrings(data, second=True)
                # Some runs at a time: a text may be all opened runs.
                for some in np.array_split(np.arange(len(n)), -(-int(n.sum()) // WINDOWS_AT_ONCE) or 1):
                    yield _deal(opened(one, two, ids[first:end], at, text[some], start[some], n[some]), ("one", "two"), key, buckets)

    def opened(one: Substrings, two: Substrings, ids: np.ndarray, at: np.ndarray, text: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        each = np.repeat(start - np.r_[0, np.cumsum(n)[:-1]][: len(n)], n) + np.arange(n.sum())
        text = np.repeat(text, n)
        rows = np.zeros(len(each), WIDE)
        rows["doc"], rows["start"] = ids[text], each
        each += at[text]
        rows["one"], rows["two"] = one.hash(each, each + WINDOW), two.hash(each, each + WINDOW)
        return rows

    def key(rows: np.ndarray) -> np.ndarray:
        return mix(rows["one"])

    return make


def _compare_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _by_bucket(batches, WIDE):
        known, rows = rows[rows["state"] == _REPEAT], rows[rows["state"] == _OPEN]
        rows, first = _first_in_group(rows, "one", "two")
        repeats = np.concatenate([known, rows[~first]])
        # Neighbouring windows of a document as one run.
        repeats = repeats[np.lexsort((repeats["start"], repeats["doc"]))]
        new = np.r_[True, (repeats["doc"][1:] != repeats["doc"][:-1]) | (repeats["start"][1:] != repeats["start"][:-1] + 1)]
        at = np.flatnonzero(new[: len(repeats)])
        yield _found(repeats[at], np.diff(np.r_[at, len(repeats)]), np.zeros(len(at), bool))


def _frequent(texts: DataFrame, rows: int) -> np.ndarray:
    sample = texts.where(F.pmod(F.xxhash64("doc", F.lit(23)), F.lit(max(1, rows // SAMPLE))) == 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, at in blocks(batch.column("text")):
                text, _, _, gram, _ = window_runs(data, at)
                pairs = np.unique(np.stack([gram.view(np.int64), text]), axis=1)[0]
                grams, times = np.unique(pairs, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(times.astype(np.int64))], ["gram", "texts"])

    counts = sample.mapInArrow(count, "gram bigint, texts bigint").groupBy("gram").agg(F.sum("texts").alias("texts"))
    top = counts.where(f"texts >= {_OFTEN}").orderBy(F.desc("texts"), "gram").limit(FREQUENT).select("gram")
    grams = top.toArrow().column("gram").to_numpy()  # collect() would send the driver as many of each task
    return np.sort(grams.view(np.uint64))


def _sorted_by_bucket(packed: DataFrame) -> DataFrame:
    return packed.repartition("bucket").sortWithinPartitions("bucket")


def repeated_runs(texts: DataFrame) -> DataFrame:
    """(doc, start, n): runs of n windows of a text (doc, text) that all start earlier somewhere."""
    spark = texts.sparkSession
    rows, size = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    frequent = _frequent(texts, rows)
    runs = _sorted_by_bucket(texts.mapInArrow(_runs_by_gram(buckets, frequent), PACKED))
    found = kept(runs.mapInArrow(_compare_runs(frequent), FOUND), "runs")
    opened = found.where("open").groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    opened = texts.join(broadcast_or_merge(kept(opened, "opened")), "doc").select("doc", "text", "runs")
    windows = _sorted_by_bucket(opened.mapInArrow(_windows(buckets), PACKED)).mapInArrow(_compare_windows, FOUND)
    return found.where("NOT open").union(windows).drop("open")


def numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, doc_id, text) of each row, with doc in the order of doc_id, and (doc, text) of each document.

    It is the doc_id itself where ids are unique and not null. Otherwise documents are counted in order of
    (doc_id, nulls first, then a hash of the text); rows equal in both are one document.
    """
    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    repeated = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL")
    if repeated.isEmpty():
        rows = rows.withColumn("doc", F.col("doc_id"))
        return rows, rows.select("doc", "text")
    rows = rows.withColumn("hash", F.xxhash64("text"))
    names = dense_index(rows.select("doc_id", "hash").distinct(), ["doc_id", "hash"], name="doc", unique=True)
    names = names.select(F.col("doc_id").alias("id"), F.col("hash").alias("of"), "doc")
    rows = rows.join(names.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("of")))
    rows = kept(rows.select("doc", "doc_id", "text"), "numbered")
    return rows, rows.select("doc", "text").dropDuplicates(["doc"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, removed, kept) of each row of docs (doc_id, text): the removed byte ranges, maximal
    and in order, and the bytes that remain (which may start or end inside a character).

    A null text is empty; texts shorter than a window lose nothing. Rows that repeat a doc_id and its text are
    one document: each gets its result. Other columns are ignored.
    """
    rows, texts = numbered(docs)
    spans = repeated_runs(texts).groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    shape = "doc_id bigint, n_bytes bigint, removed array<struct<start:int,end:int>>, kept binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, at in blocks(batch.column("text")):
                own = batch.column("spans").slice(first, end - first)
                lengths = pc.list_value_length(own).fill_null(0).to_numpy(zero_copy_only=False)
                start, n = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in own.flatten().flatten())
                text = np.repeat(np.arange(end - first), lengths)
                text, low, high = merge_spans(text, start + at[text], start + n + WINDOW - 1 + at[text])
                change = np.zeros(len(data) + 1, np.int8)
                change[low] += 1  # no two spans start, or end, at one place
                change[high] -= 1
                keep = np.cumsum(change[:-1], dtype=np.int8) == 0
                left = np.r_[0, np.cumsum(keep)][at]
                counts = np.bincount(text, minlength=end - first)
                fields = [pa.array((x - at[text]).astype(np.int32)) for x in (low, high)]
                removed = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.StructArray.from_arrays(fields, ["start", "end"]))
                raw = data[keep].tobytes()
                parts = pa.Array.from_buffers(pa.binary(), end - first, [None, pa.py_buffer(left.astype(np.int32)), pa.py_buffer(raw)])
                columns = [batch.column("doc_id").slice(first, end - first), pa.array(np.diff(at)), removed, parts]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "removed", "kept"])

    placed = rows.join(broadcast_or_merge(kept(spans, "spans")), "doc", "left")
    return placed.select("doc_id", "text", "spans").mapInArrow(cut, shape)
