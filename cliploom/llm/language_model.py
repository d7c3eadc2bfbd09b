"""Stupid-backoff scores of documents by the n-gram counts of all other documents.

A word scores count(n-gram) / count(n-gram without the word) for the longest n-gram ending in it that another
document has, times ALPHA for every word the n-gram had to be shortened by. Counts cover all
documents less the scored one's own, so copies and common phrases score high and a document does not vouch for itself.

Counting and look-up are one join by hash. Texts are dealt out in blocks. A block asks each bucket of hashes for its
distinct n-grams, as one packed row; a bucket adds up what all blocks have and answers in the same
order; the block, read again from the same shuffle, scores its words with the answers and sums per document.
A frequent n-gram costs a block one entry, so no n-gram is one task's work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliploom.llm.common import kept
from cliploom.llm.textbytes import LOWER_ASCII, NOT_SPACE, Substrings, blocks, ngrams, words

ORDER = 2
ALPHA = 0.4
TEXT_BYTES = 2 << 20  # of texts in a block
BUCKET_BYTES = 16 << 20  # text behind a bucket of n-grams

ASKED = "n int, bucket int, block int, grams binary, counts binary"
ANSWERED = "block int, n int, bucket int, counts binary"
SUMS = "doc_id bigint, n_words bigint, log_sum double, n_words_alone bigint"


def _planes(values: np.ndarray, size: int) -> bytes:
    """Bytes of the values, most significant ones of all values first: sorted or small values compress well."""
    return np.ascontiguousarray(values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - size :].T).tobytes()


def _from_planes(raw: bytes, size: int) -> np.ndarray:
    wide = np.zeros((len(raw) // size, 8), np.uint8)
    wide[:, 8 - size :] = np.frombuffer(raw, np.uint8).reshape(size, -1).T
    return wide.reshape(-1).view(">u8").astype(np.uint64)


class _Grams:
    """n-grams of the texts of a block, per order: distinct ones by (bucket, hash) and where each word's ends."""

    def __init__(self, texts: pa.ChunkedArray, order: int, buckets: int):
        hashes, owner, first_text = [], [], 0
        for first, end, data, at in blocks(texts.combine_chunks()):
            data = LOWER_ASCII[data]
            starts, ends, own = words(data, at, NOT_SPACE)
            hashes.append(Substrings(data).hash(starts, ends))
            owner.append(own + first)
        self.words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        self.buckets = buckets
        self.orders = []  # per n: distinct n-grams, the word each occurrence ends in, its n-gram
        for n in range(1, order + 1):
            grams, first = ngrams(self.words, self.owner, n)
            distinct, which = np.unique(grams, return_inverse=True)
            self.orders.append((distinct, first + n - 1, which))

    def asked(self, block: int) -> Iterator[tuple[int, int, int, bytes, bytes]]:
        for n, (distinct, _, which) in enumerate(self.orders, 1):
            counts = np.bincount(which, minlength=len(distinct))
            bucket = (distinct >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)  # ranges of hashes
            first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(bucket)])
            ends = np.r_[first[1:], len(bucket)][: len(first)]  # a block may have no n-gram of an order
            for a, b in zip(first.tolist(), ends.tolist(), strict=True):
                yield n, int(bucket[a]), block, _planes(distinct[a:b], 8), _planes(counts[a:b], 8)


def _ask(order: int, buckets: int) -> Callable:
    names = [c.split()[0] for c in ASKED.split(", ")]
    types = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())

    def ask(block: pa.Table) -> pa.Table:
        rows = list(_Grams(block.column("text"), order, buckets).asked(block.column("block")[0].as_py()))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return ask


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per bucket, sorted: the counts that all blocks together have, to each block for its n-grams."""

    def total(key: tuple[int, int], parts: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        grams = [_from_planes(g, 8) for _, g, _ in parts]
        counts = np.concatenate([_from_planes(c, 8) for *_, c in parts])
        _, which = np.unique(np.concatenate(grams), return_inverse=True)
        totals = np.zeros(which.max() + 1, np.uint64)
        np.add.at(totals, which, counts)
        ends = np.cumsum([len(g) for g in grams])[:-1]
        back = [_planes(x, 8) for x in np.split(totals[which] - counts, ends)]  # what other blocks have
        n = len(parts)
        columns = [pa.array([b for b, *_ in parts], pa.int32()), *(pa.array([k] * n, pa.int32()) for k in key), pa.array(back, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["block", "n", "bucket", "counts"])

    key, parts = None, []
    for batch in batches:
        for n, bucket, block, grams, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (n, bucket) != key and parts:
                yield total(key, parts)
                parts = []
            key = n, bucket
            parts.append((block, grams, counts))
    if parts:
        yield total(key, parts)


def _score(order: int, buckets: int, alpha: float) -> Callable:
    def others(grams: _Grams, n: int, answers: pa.Table) -> np.ndarray:
        """For each word, in how many places of other documents the n-gram ending in it occurs; 0 where none ends."""
        distinct, word, which = grams.orders[n - 1]
        own = answers.filter(pa.compute.equal(answers.column("n"), n)).sort_by("bucket")
        elsewhere = np.concatenate([np.zeros(0, np.uint64), *(_from_planes(x, 8) for x in own.column("counts").to_pylist())])
        in_block = np.bincount(which, minlength=len(distinct))
        owner = grams.owner[word]
        _, group, in_text = np.unique(owner * len(distinct) + which, return_inverse=True, return_counts=True)
        found = np.zeros(len(grams.words))
        found[word] = elsewhere[which].astype(np.int64) + in_block[which] - in_text[group]
        return found

    def score(block: pa.Table, answers: pa.Table) -> pa.Table:
        grams = _Grams(block.column("text"), order, buckets)
        owner, m = grams.owner, len(grams.words)
        place = np.arange(m) - np.searchsorted(owner, owner)  # of a word in its text
        counts = [others(grams, n, answers) for n in range(1, order + 1)]
        logs, alone = np.zeros(m), np.ones(m, bool)
        for n in range(order, 1, -1):
            seen = np.flatnonzero(alone & (counts[n - 1] > 0))
            shortened = np.minimum(place[seen], order - 1) - (n - 1)
            logs[seen] = np.log(counts[n - 1][seen]) - np.log(counts[n - 2][seen - 1]) + shortened * np.log(alpha)
            alone[seen] = False
        rest = np.flatnonzero(alone)  # a word that no other document has counts as if it occurred once
        logs[rest] = np.log(np.maximum(counts[0][rest], 1)) + np.minimum(place[rest], order - 1) * np.log(alpha)
        texts = block.num_rows
        columns = [
            block.column("doc_id"),
            pa.array(np.bincount(owner, minlength=texts), pa.int64()),
            pa.array(np.bincount(owner, logs, texts), pa.float64()),  # without words NumPy gives integers
            pa.array(np.bincount(owner[rest], minlength=texts), pa.int64()),
        ]
        return pa.table(columns, [c.split()[0] for c in SUMS.split(", ")])

    return score


def scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score) of each row of docs (doc_id, text).

    Words are lower-cased (A-Z) runs without ASCII white space. Null and empty texts have no words,
    log_score 0 and a null mean. A row that repeats vouches for its copy like any other document.
    With one document alone every word counts as once in one word. Other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_blocks, buckets = max(16, -(-size // TEXT_BYTES)), max(16, -(-size // BUCKET_BYTES))
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_blocks // 4)
    # Copies of a text, or of an id, are dealt out like any other rows.
    spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_blocks)).cast("int")
    dealt = texts.withColumn("block", spread).repartition(partitions, "block")
    asked = dealt.groupBy("block").applyInArrow(_ask(order, buckets), ASKED)
    answered = asked.repartition("n", "bucket").sortWithinPartitions("n", "bucket").mapInArrow(_answer, ANSWERED)
    both = dealt.groupBy("block").cogroup(answered.groupBy("block"))
    sums = kept(both.applyInArrow(_score(order, buckets, alpha), SUMS), "scores")
    total = sums.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    others = F.greatest(F.lit(total) - F.col("n_words"), F.lit(1))
    score = F.col("log_sum") - F.col("n_words_alone") * F.log(others)
    return sums.select(
        "doc_id", "n_words", score.alias("log_score"), F.when(F.col("n_words") > 0, score / F.col("n_words")).alias("mean_log_score")
    )
