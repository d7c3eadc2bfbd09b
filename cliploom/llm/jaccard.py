"""N-gram Jaccard join: texts whose sets of word n-grams overlap by a share of their union.

Words are lower-cased (A-Z) runs without ASCII white space; a text's set holds its distinct n-grams, or, if it
has fewer words, all of them as one. Two texts link when |A & B| / |A | B| reaches the threshold.

The join is a sparse product of the incidence matrix (texts by n-grams) with its transpose:

* Texts with equal sets are one row of the matrix; a group of copies costs one row.
* n-grams have a global order, frequent ones last. If two texts link, they share an n-gram among the
  first ``n - ceil(t * n) + 1`` of each, so only these prefixes are columns of the product.
* A column that few rows have gives all its pairs, summed to overlap counts in blocks. A column with many
  rows is cut into cells by the bands that the two sizes of a pair are in, for which prefixes are shorter still; a cell
  first gives pairs with pivot rows only, and then those pairs that are not connected. So no group of copies is squared.
* A pair is discarded when its sizes differ too much, or when its overlap so far plus all that
  could still come falls short of the overlap that the sizes ask for.
* A set has a sketch: the parity of its n-grams at each of ``SKETCH_BITS`` places. Two sets differ in at least as many
  n-grams as their sketches do in bits, so a pair whose sketches differ too much is discarded without moving its sets.
* What is left is checked on the whole sets. Only links between rows that are not connected yet can change a
  component, so pairs within one are not checked again.

``links`` and ``link_counts`` find every link. All of them are within components, so the sets of a component are dealt
out in blocks, and each pair of blocks is one product of whole incidence matrices. A task holds two blocks; pairs become
rows only in ``links``, whose result they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliploom.llm.common import kept, kept_narrow
from cliploom.llm.graph import FEW_NODES, components
from cliploom.llm.textbytes import LOWER_ASCII, NOT_SPACE, Substrings, blocks, mix, ngrams, words
from cliploom.operators.sizing import broadcast_if_small

N = 5
THRESHOLD = (4, 5)  # a ratio of integers, to compare exactly
FEW = 48  # rows of a column whose pairs are all made,
PAIRS = 1 << 18  # about so many at a time
SKETCH_BITS = 1_024
SAMPLE = 8_000  # texts whose n-grams tell the frequent ones; the order changes speed only, not results
FREQUENT = 300_000  # n-grams at most that are ordered last: 5 MB
BROADCAST_ROWS = 1_000_000  # ids (8 bytes each) that may be broadcast
BLOCK_SETS = 1_024  # sets of a component in a block, on average, and n-grams of them
BLOCK_GRAMS = 1 << 18
DENSE = 32  # sets of a block pair that share an n-gram, above which it is a column of a dense product
DENSE_COLUMNS = 4_096  # of which a dense product takes so many at a time
HOT = 100  # an n-gram that more than one in so many sampled texts has is a large column without being counted in one task
BAND = 1.05  # ratio of the greatest to the smallest size of a band
PIVOTS = 6  # rounds of pivots, at most, before the rest of large columns is compared pair by pair,
APART = 4  # which is earlier if their pairs that are not connected are at most so many a row

_ROWS = "doc_id bigint, n bigint, key1 bigint, key2 bigint, prefix array<bigint>, sketch binary"
_SET = ["n", "key1", "key2"]


def shingles(data: np.ndarray, at: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text of a block, sorted by (text, hash), and their texts."""
    data = LOWER_ASCII[data]
    starts, ends, owner = words(data, at, NOT_SPACE)
    hashes = Substrings(data).hash(starts, ends)
    grams, first = ngrams(hashes, owner, n)
    owners = owner[first]
    counts = np.bincount(owner, minlength=len(at) - 1)
    for k in range(1, n):  # texts with fewer words
        own = counts[owner] == k
        if own.any():
            short, first = ngrams(hashes[own], owner[own], k)
            grams, owners = np.r_[grams, short], np.r_[owners, owner[own][first]]
    order = np.lexsort((grams, owners))
    grams, owners = grams[order], owners[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owners[1:] != owners[:-1])
    return grams[new], owners[new]


def least_overlap(a, b, threshold: tuple[int, int] = THRESHOLD):
    """Smallest overlap of linked sets of sizes a and b: overlap / (a + b - overlap) >= p / q."""
    p, q = threshold
    return -(-(p * (a + b)) // (p + q))


def _prefix_length(n, threshold: tuple[int, int]):
    p, q = threshold
    return n - -(-(p * n) // q) + 1


def _frequent(texts: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n-grams that several texts of a bounded sample have, sorted, with their numbers of texts."""
    every = max(1, texts.count() // SAMPLE)
    sample = texts.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(every)) == 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, at in blocks(batch.column("text")):
                grams, times = np.unique(shingles(data, at, n)[0].view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(times.astype(np.int64))], ["gram", "texts"])

    counts = sample.select("text").mapInArrow(count, "gram bigint, texts bigint").groupBy("gram").agg(F.sum("texts").alias("texts"))
    top = counts.where("texts >= 3").orderBy(F.desc("texts"), "gram").limit(FREQUENT).toArrow()
    grams, times = (top.column(c).to_numpy() for c in ("gram", "texts"))
    order = np.argsort(grams.view(np.uint64))
    return grams.view(np.uint64)[order], times.astype(np.uint64)[order]


def _set_keys(grams: np.ndarray, before: np.ndarray) -> list[np.ndarray]:
    """Two hashes of each set, whose n-grams are those between its two places in ``before``."""
    keys = []
    for salt in (1, 2):
        total = np.r_[np.uint64(0), np.cumsum(mix(grams + np.uint64(salt)))]
        keys.append((total[before[1:]] - total[before[:-1]]).view(np.int64))
    return keys


def _sketches(grams: np.ndarray, owner: np.ndarray, texts: int) -> pa.Array:
    """Per text, at each place the parity of the number of its n-grams there."""
    size = SKETCH_BITS // 8
    place = grams & np.uint64(SKETCH_BITS - 1)
    parity = np.zeros(texts * size, np.uint8)
    np.bitwise_xor.at(parity, owner * size + (place >> np.uint64(3)).astype(np.int64), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), texts, [None, pa.py_buffer(parity)]).cast(pa.binary())


def _matrix_rows(n: int, threshold: tuple[int, int], frequent: tuple[np.ndarray, np.ndarray]) -> Callable:
    """Per text: set size, two hashes of the set, the prefix and the sketch. Within a block, later copies of a set have no prefix."""
    grams_last, times = frequent

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, at in blocks(batch.column("text")):
                grams, owner = shingles(data, at, n)
                sizes = np.bincount(owner, minlength=end - first)
                before = np.r_[0, np.cumsum(sizes)]
                keys = _set_keys(grams, before)
                place = grams >> np.uint64(1)
                if len(grams_last) and len(grams):
                    slot = np.minimum(np.searchsorted(grams_last, grams), len(grams_last) - 1)
                    late = np.flatnonzero(grams_last[slot] == grams)
                    often = np.minimum(times[slot[late]], np.uint64((1 << 20) - 1)) << np.uint64(43)
                    place[late] = np.uint64(1 << 63) | often | (grams[late] >> np.uint64(21))
                order = np.lexsort((grams, place, owner))
                rank = np.arange(len(grams)) - before[owner]
                named = batch.column("doc_id").slice(first, end - first).is_valid().to_numpy(zero_copy_only=False)
                _, seen = np.unique(np.stack([named, sizes, *keys], 1), axis=0, return_index=True)
                alone = np.zeros(end - first, bool)
                alone[seen] = True
                want = (rank < _prefix_length(sizes, threshold)[owner]) & alone[owner]
                lengths = np.bincount(owner[want], minlength=end - first)
                prefix = pa.ListArray.from_arrays(
                    pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), pa.array(grams[order][want].view(np.int64))
                )
                columns = [batch.column("doc_id").slice(first, end - first), pa.array(sizes.astype(np.int64)), *map(pa.array, keys), prefix]
                columns.append(_sketches(grams, owner, end - first))
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _ROWS.split(", ")])

    return make


def classes(docs: DataFrame, n: int = N, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs (doc_id, text).

    component_id is the smallest doc_id reachable by links, the own one included. Null and empty texts and texts
    without words have empty sets and link with nothing. A row whose doc_id is null has no part in links
    and a null component_id. Rows that share a doc_id are one document in links. No rows, no result.
    """
    _, rows, named = _named(docs, n, threshold)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("class", "doc_id"))
    placed = rows.join(named, _SET, "left")
    return placed.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def _named(docs: DataFrame, n: int, threshold: tuple[int, int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The texts, the matrix's rows without prefixes and sketches, and (n, key1, key2, id, class) of each set."""
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    frequent = _frequent(texts, n)
    rows = kept(texts.mapInArrow(_matrix_rows(n, threshold, frequent), _ROWS), "matrix")
    # Of a block's copies one has the prefix, the others an empty one, which is less.
    groups = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy(*_SET)
    sets = kept(groups.agg(F.min("doc_id").alias("id"), F.max("prefix").alias("prefix"), F.max("sketch").alias("sketch")), "sets")
    hot = frequent[0][frequent[1] > SAMPLE // HOT].view(np.int64)
    found = _linked(texts, sets, hot, n, threshold)
    named = sets.select(*_SET, "id").join(found, "id", "left").select(*_SET, "id", F.coalesce("component", "id").alias("class"))
    return texts, rows.drop("prefix", "sketch"), named


def link_counts(docs: DataFrame, n: int = N, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links): ``classes`` and with how many other rows of docs a row links.

    Links with copies count. Rows without doc_id or without words have none, and count for no other.
    """
    texts, rows, named = _named(docs, n, threshold)
    copies = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy(*_SET).agg(F.count(F.lit(1)).alias("copies"))
    named = kept(named.join(copies, _SET), "named")
    made = _block_pairs(texts, named, n).mapInArrow(_linked_in_blocks(threshold, False), "n bigint, key1 bigint, key2 bigint, links bigint")
    others = made.groupBy(*_SET).agg(F.sum("links").alias("links"))
    counted = kept(named.join(others, _SET, "left"), "counted")
    named_row = F.col("doc_id").isNotNull()
    return rows.join(counted, _SET, "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(named_row, F.coalesce("class", "doc_id")).alias("component_id"),
        F.when(named_row, F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0))).otherwise(0).cast("bigint").alias("n_links"),
    )


def links(docs: DataFrame, n: int = N, threshold: tuple[int, int] = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """All links: pairs (a, b) of sets, a < b, and the members (doc_id, id) of each set.

    Documents link if their sets are the same or a pair. A set is named by its smallest doc_id, so exact copies cost a row
    each and not a pair each.
    """
    texts, rows, named = _named(docs, n, threshold)
    named = kept(named.withColumn("copies", F.lit(1).cast("bigint")), "named")
    pairs = _block_pairs(texts, named, n).mapInArrow(_linked_in_blocks(threshold, True), "a bigint, b bigint")
    members = rows.where("n > 0 AND doc_id IS NOT NULL").join(named.select(*_SET, "id"), _SET)
    return kept(pairs.where("a != b").distinct(), "links"), members.select("doc_id", "id").distinct()


def _block_pairs(texts: DataFrame, named: DataFrame, n: int) -> DataFrame:
    """Sets of components with others, whole, once for each pair of blocks that they are compared in.

    Rows of a pair of blocks (class, low, high) follow each other; a set is in its first or its second block.
    """
    per_class = named.groupBy("class").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("grams")).where("sets > 1")
    parts = F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.least("sets", F.ceil(F.col("grams") / BLOCK_GRAMS)))
    inside = kept(named.join(per_class.select("class", parts.alias("parts")), "class"), "inside")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, end, data, at in ((first, end - first, d, a) for first, end, d, a in blocks(batch.column("text"))):
                grams, owner = shingles(data, at, n)
                before = np.r_[0, np.cumsum(np.bincount(owner, minlength=end))]
                sets = [grams[a:b].tobytes() for a, b in zip(before[:-1], before[1:], strict=True)]
                columns = [np.diff(before), *_set_keys(grams, before)]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(sets, pa.binary())], [*_SET, "grams"])

    ids = kept(inside.select("id").distinct(), "ids")
    found = only(texts, "doc_id", ids).select("text").mapInArrow(whole, "n bigint, key1 bigint, key2 bigint, grams binary")
    found = found.groupBy(*_SET).agg(F.first("grams").alias("grams"))
    block = F.pmod(F.xxhash64(*_SET), F.col("parts"))
    rows = kept(inside.join(found, _SET).withColumn("block", block), "whole")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    low, high = F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    rows = rows.select("class", low, high, (F.col("block") > F.col("other")).alias("second"), "id", *_SET, "copies", "grams")
    return rows.repartition("class", "low", "high").sortWithinPartitions("class", "low", "high")


def _linked_in_blocks(threshold: tuple[int, int], pairs: bool) -> Callable:
    """Of each pair of blocks the links: as pairs of ids, or per set the number of rows that it links with."""
    p, q = threshold

    def found(key: tuple[int, int, int], rows: list[tuple]) -> pa.RecordBatch:
        second, ids, sizes, key1, key2, copies, raw = zip(*rows, strict=True)
        ids, sizes, key1, key2, copies = (np.array(x, np.int64) for x in (ids, sizes, key1, key2, copies))
        same = key[1] == key[2]
        y = np.flatnonzero(np.array(second, bool))
        x = np.flatnonzero(~np.array(second, bool))
        y = x if same else y
        overlap = _overlaps(raw, x, y)
        linked = q * overlap >= p * (sizes[x][:, None] + sizes[y][None, :] - overlap)
        if same:
            np.fill_diagonal(linked, False)
        if pairs:
            i, j = np.nonzero(np.triu(linked) if same else linked)
            a, b = ids[x[i]], ids[y[j]]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
        counts = np.zeros(len(ids), np.int64)
        counts[x] += linked @ copies[y]
        if not same:
            counts[y] += copies[x] @ linked
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (sizes, key1, key2, counts)], [*_SET, "links"]).filter(pa.array(counts > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != key and rows:
                    yield found(key, rows)
                    rows = []
                key = row[:3]
                rows.append(row[3:])
        if rows:
            yield found(key, rows)

    return run


def _overlaps(raw: tuple[bytes, ...], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Numbers of n-grams that each set of x has in common with each set of y."""
    grams = np.frombuffer(b"".join(raw), np.uint64)
    owner = np.repeat(np.arange(len(raw)), [len(r) // 8 for r in raw])
    _, column, times = np.unique(grams, return_inverse=True, return_counts=True)
    order = np.lexsort((owner, column))
    order = order[times[column[order]] > 1]
    column, owner = column[order], owner[order]
    times, first = times[times > 1], np.flatnonzero(np.r_[True, column[1:] != column[:-1]][: len(column)])
    total = np.zeros((len(x), len(y)), np.int64)
    at_x, at_y = np.full(len(raw), -1), np.full(len(raw), -1)
    at_x[x], at_y[y] = np.arange(len(x)), np.arange(len(y))
    for width in np.unique(times[times <= DENSE]):
        rows = owner[first[times == width][:, None] + np.arange(width)]
        for i in range(width):
            for j in range(width):
                a, b = at_x[rows[:, i]], at_y[rows[:, j]]
                both = (a >= 0) & (b >= 0)
                np.add.at(total, (a[both], b[both]), 1)
    dense = np.flatnonzero(times > DENSE)
    for k in range(0, len(dense), DENSE_COLUMNS):
        some = dense[k : k + DENSE_COLUMNS]
        has = np.zeros((len(raw), len(some)), np.float32)
        for c, (start, width) in enumerate(zip(first[some].tolist(), times[some].tolist(), strict=True)):
            has[owner[start : start + width], c] = 1
        total += (has[x] @ has[y].T).astype(np.int64)
    return total


def _linked(texts: DataFrame, sets: DataFrame, hot: np.ndarray, n: int, threshold: tuple[int, int]) -> DataFrame:
    """(id, component) of the sets that link with others."""
    columns = kept(_shared_columns(sets.select("id", "n", F.posexplode("prefix").alias("pos", "gram")), hot), "columns")
    is_large = (F.col("rows") > FEW).cast("bigint")
    per_id = columns.groupBy("id").agg(F.sum(1 - is_large).alias("small"), F.sum(is_large).alias("large"))
    per_id = kept(per_id, "counts")
    few = columns.where(F.col("rows") <= FEW).groupBy("gram").agg(F.collect_list(F.struct("id", "n")).alias("rows"))
    blocks_of_pairs = few.select("rows").mapInArrow(_product(threshold), "a bigint, b bigint, na bigint, nb bigint, overlap bigint")
    sums = blocks_of_pairs.groupBy("a", "b", "na", "nb").agg(F.sum("overlap").alias("overlap"))
    sketches = sets.select("id", "n", "sketch")
    near = kept(_alike(_possible(sums, per_id, threshold), sketches, threshold), "pairs")
    cells = _cells(columns.where(F.col("rows") > FEW), per_id, threshold)

    placed, labels = 0, None
    for turn in range(PIVOTS + 1):
        cells = kept(_still_open(cells, labels), "cells")
        placed = placed or cells.count()
        last = turn == PIVOTS or turn > 0 and _open_pairs(cells) <= APART * placed
        apart = _labelled(_labelled(near, labels, "a", "la"), labels, "b", "lb").where("la != lb").select("a", "b")
        if last:
            pairs = apart.union(_alike(_possible(_all_apart(cells, threshold), per_id, threshold), sketches, threshold))
        else:
            with_pivots = _possible(_with_pivots(cells, turn, threshold), per_id, threshold)
            pairs = _one_each(apart, turn).union(_alike(with_pivots, sketches, threshold))
        pairs = kept(pairs.distinct(), "tested")
        found = kept_narrow(_checked(texts, pairs, n, threshold), "links", pairs.count())
        if not found.isEmpty():
            # What was connected before is a star, so earlier links need not be read again.
            labels = components(found if labels is None else found.union(labels.select("id", "component").where("id != component")))
            labels = F.broadcast(labels) if labels.count() <= FEW_NODES else labels
        if last:
            return texts.sparkSession.createDataFrame([], "id bigint, component bigint") if labels is None else labels


def _shared_columns(entries: DataFrame, hot: np.ndarray) -> DataFrame:
    """entries (id, n, pos, gram) of the n-grams of several rows, with ``rows``, the number of these.

    Entries are moved once, and those that no other row shares end there. Hot n-grams are not brought together: their
    entries are spread by id and count as large columns.
    """
    known = entries.sparkSession.createDataFrame(pa.table({"hot": pa.array(hot, pa.int64())}))
    marked = entries.join(F.broadcast(known), F.col("gram") == F.col("hot"), "left")  # at most HOT times the n-grams of a text
    spread = Window.partitionBy("gram", F.when(F.col("hot").isNotNull(), F.pmod(F.xxhash64("id"), F.lit(1 << 16))))
    rows = F.when(F.col("hot").isNotNull(), FEW + 1).otherwise(F.count(F.lit(1)).over(spread)).cast("bigint")
    return marked.select("id", "n", "pos", "gram", rows.alias("rows")).where("rows > 1")


def _sizes_fit(na: Column, nb: Column, threshold: tuple[int, int]) -> Column:
    p, q = threshold
    return F.least(na, nb) * q >= F.greatest(na, nb) * p


def _possible(pairs: DataFrame, per_id: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Pairs whose overlap so far can still grow to what their sizes ask for: by the large columns that
    both may share, and by all that follows a prefix. An overlap not counted is at most the number of small columns."""
    p, q = threshold
    per_id = broadcast_if_small(per_id)
    for side in ("a", "b"):
        counts = per_id.select(F.col("id").alias(side), F.col("small").alias("s" + side), F.col("large").alias("l" + side))
        pairs = pairs.join(counts, side)
    least = F.ceil((F.col("na") + F.col("nb")) * p / (p + q))
    rest = F.ceil(F.greatest("na", "nb") * p / q) - 1
    most = F.coalesce("overlap", F.least("sa", "sb")) + F.least("la", "lb") + rest
    return pairs.where(most >= least).select("a", "b")


def _alike(pairs: DataFrame, sketches: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) whose sketches differ in no more bits than linked sets of their sizes may differ in n-grams."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(len(na), -1) for c in ("x", "y"))
            differ = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
            yield batch.select(["a", "b"]).filter(pa.array(differ <= na + nb - 2 * least_overlap(na, nb, threshold)))

    pairs = kept(pairs, "possible")
    ids = kept(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids")
    wanted = only(sketches, "id", ids).select("id", "n", "sketch")
    both = pairs.join(wanted.toDF("b", "nb", "y"), "b").join(wanted.toDF("a", "na", "x"), "a")
    return both.select("a", "b", "na", "nb", "x", "y").mapInArrow(compare, "a bigint, b bigint")


def _labelled(rows: DataFrame, labels: DataFrame | None, of: str, name: str = "label") -> DataFrame:
    """rows with the component of the id in column ``of``; an id without links is its own."""
    if labels is None:
        return rows.withColumn(name, F.col(of))
    found = labels.select(F.col("id").alias(of), F.col("component").alias(name))
    return rows.join(found, of, "left").withColumn(name, F.coalesce(name, of))


def _least(a: Column, b: Column, threshold: tuple[int, int]) -> Column:
    p, q = threshold
    return F.ceil((a + b) * p / (p + q))


def _band(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / float(np.log(BAND))).cast("bigint")


def _cells(large: DataFrame, per_id: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Rows of large columns by the two bands (lo, hi) of a pair's sizes: (gram, lo, hi, band, id, n, pos, central).

    A pair of sizes n and m that links shares an n-gram within the first n - least_overlap(n, m) + 1 of one and
    the first m - least_overlap(n, m) + 1 of the other. So a row is in the cells of those bands only, of the bands that its
    column has, for whose smallest size that fits its n-gram comes early enough. ``central`` is higher for rows whose
    prefix others share: rows in the middle of a group of near copies.
    """
    p, q = threshold
    large = large.withColumn("band", _band(F.col("n")))
    bands = large.groupBy("gram", F.col("band").alias("other")).agg(F.min("n").alias("from"), F.max("n").alias("to"))
    smallest = F.greatest("from", F.ceil(F.col("n") * p / q))
    fits = (smallest <= F.col("to")) & _sizes_fit(F.col("n"), smallest, threshold) & (F.col("pos") <= F.col("n") - _least(F.col("n"), smallest, threshold))
    rows = large.join(bands, "gram").where(fits)
    cells = rows.select("gram", F.least("band", "other").alias("lo"), F.greatest("band", "other").alias("hi"), "band", "id", "n", "pos")
    shared = per_id.select(F.col("id").alias("of"), F.col("large").alias("central"))
    return cells.join(broadcast_if_small(shared), F.col("id") == F.col("of")).drop("of")


_CELL = ["gram", "lo", "hi"]


def _still_open(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """Cells with rows of both bands that are not connected, with the rows' components."""
    rows = _labelled(cells.drop("label"), labels, "id")
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("label", "band") for f in (F.min, F.max)]
    mixed = rows.groupBy(*_CELL).agg(*ends).where("min_label != max_label AND (lo = hi OR min_band != max_band)")
    return rows.join(mixed.select(*_CELL), _CELL)


def _open_pairs(cells: DataFrame) -> int:
    """Pairs of rows of one cell, one of each band, that are not connected yet."""
    of = [F.sum((F.col("band") == F.col(c)).cast("double")).alias("k" + c) for c in ("lo", "hi")]
    per_label = cells.groupBy(*_CELL, "label").agg(*of)
    apart = F.sum("klo") * F.sum("khi") - F.sum(F.col("klo") * F.col("khi"))
    per_cell = per_label.groupBy(*_CELL).agg((apart / F.when(F.col("lo") == F.col("hi"), 2).otherwise(1)).alias("pairs"))
    return int(per_cell.agg(F.coalesce(F.sum("pairs"), F.lit(0.0))).first()[0])


def _one_each(pairs: DataFrame, turn: int) -> DataFrame:
    """Of each id's pairs one, at first that with the smallest partner: enough to connect most groups."""
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    first = both.groupBy("id").agg(F.min_by("other", F.xxhash64("other", F.lit(turn)) if turn else F.col("other")).alias("other"))
    return first.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))


def _early(threshold: tuple[int, int]) -> Column:
    """Sizes of the pair fit, and both have the n-gram early enough for them."""
    least = _least(F.col("n"), F.col("pn"), threshold)
    return _sizes_fit(F.col("n"), F.col("pn"), threshold) & (F.col("pos") <= F.col("n") - least) & (F.col("ppos") <= F.col("pn") - least)


def _with_pivots(cells: DataFrame, turn: int, threshold: tuple[int, int]) -> DataFrame:
    """Pairs of each row of a cell with a pivot of its cell that it is not connected with.

    There is a pivot for each of the two bands: at first the most central row, in later turns any one, by hash.
    """
    luck = F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(1 << 20))
    rank = luck if turn else F.least("central", F.lit(1 << 30)) * (1 << 20) + luck
    pivots = cells.groupBy(*_CELL, "band").agg(*(F.max_by(c, rank).alias("p" + c) for c in ("id", "n", "pos", "label")))
    pivots = pivots.withColumnRenamed("band", "pband")
    stars = cells.join(pivots, _CELL).where("label != plabel AND (band != pband OR lo = hi)")
    return _as_pairs(stars.where(_early(threshold)))


def _all_apart(cells: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """All pairs of rows of a cell, one of each band, that are not connected."""
    other = cells.select(*_CELL, *(F.col(c).alias("p" + c) for c in ("id", "n", "pos", "band", "label"))).where("pband = hi")
    pairs = cells.where("band = lo").join(other, _CELL)
    return _as_pairs(pairs.where("label != plabel AND (lo != hi OR id < pid)").where(_early(threshold)))


def _as_pairs(found: DataFrame) -> DataFrame:
    """Pairs found in large columns; their overlap in small ones is not counted here."""
    small = F.col("id") < F.col("pid")
    return found.select(
        F.least("id", "pid").alias("a"),
        F.greatest("id", "pid").alias("b"),
        F.when(small, F.col("n")).otherwise(F.col("pn")).alias("na"),
        F.when(small, F.col("pn")).otherwise(F.col("n")).alias("nb"),
        F.lit(None).cast("bigint").alias("overlap"),
    ).distinct()


def _product(threshold: tuple[int, int]) -> Callable:
    """Overlap counts of all pairs of rows in a block of small columns."""
    p, q = threshold

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0)
            at = rows.offsets.to_numpy().astype(np.int64)
            ids, sizes = (x.to_numpy(zero_copy_only=False) for x in rows.values.flatten())
            widths = np.diff(at)
            before = np.cumsum(widths * (widths - 1) // 2)
            for part in np.split(np.arange(len(widths)), np.flatnonzero(np.diff(before // PAIRS)) + 1):
                made = []
                for width in np.unique(widths[part]):
                    first = at[part][widths[part] == width][:, None]
                    a, b = ((first + i).ravel() for i in np.triu_indices(width, 1))
                    fit = (np.minimum(sizes[a], sizes[b]) * q >= np.maximum(sizes[a], sizes[b]) * p) & (ids[a] != ids[b])
                    a, b = a[fit], b[fit]
                    swap = ids[a] > ids[b]
                    a, b = np.where(swap, b, a), np.where(swap, a, b)
                    made.append(np.stack([ids[a], ids[b], sizes[a], sizes[b]]))
                pairs = np.concatenate(made, 1) if made else np.zeros((4, 0), np.int64)
                pairs = pairs[:, np.lexsort(pairs[::-1])]
                new = np.flatnonzero(np.r_[True, (pairs[:, 1:] != pairs[:, :-1]).any(0)][: pairs.shape[1]])
                counts = np.diff(np.r_[new, pairs.shape[1]])
                columns = [pa.array(c, pa.int64()) for c in (*pairs[:, new], counts)]
                yield pa.RecordBatch.from_arrays(columns, ["a", "b", "na", "nb", "overlap"])

    return multiply


def only(rows: DataFrame, key: str, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows whose key is (``left_anti``: is not) in ``ids``. Up to a counted number of ids is broadcast; more are shuffled."""
    wanted = ids.toDF("__only")
    wanted = F.broadcast(wanted) if ids.count() <= BROADCAST_ROWS else wanted
    return rows.join(wanted, F.col(key) == F.col("__only"), how)


def _checked(texts: DataFrame, pairs: DataFrame, n: int, threshold: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold."""
    p, q = threshold

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, at in blocks(batch.column("text")):
                grams, owner = shingles(data, at, n)
                ends = np.r_[0, np.cumsum(np.bincount(owner, minlength=end - first))]
                found = [grams[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                columns = [batch.column("doc_id").slice(first, end - first), pa.array(found, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "grams"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(q * common >= p * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ids = kept(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids")
    found = only(texts, "doc_id", ids).mapInArrow(whole, "id bigint, grams binary")
    found = kept(found, "grams")
    if found.count() > ids.count():  # rows that share a doc_id
        found = found.distinct()
    both = pairs.join(found.select(F.col("id").alias("b"), F.col("grams").alias("y")), "b")
    both = both.join(found.select(F.col("id").alias("a"), F.col("grams").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(compare, "a bigint, b bigint").distinct()


def deduplicate(docs: DataFrame, n: int = N, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """Rows of docs without those that link, directly or through others, with a smaller doc_id.

    All columns are kept. Rows without doc_id or without words stay; so do repeated rows of a doc_id that stays.
    """
    found = classes(docs.select("doc_id", "text"), n, threshold)
    return only(docs, "doc_id", kept(found.where("doc_id != component_id").select("doc_id").distinct(), "ids"), "left_anti")
