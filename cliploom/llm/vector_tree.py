"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample; every vector goes down to the leaf of the nearest centroids.
A query walks the tree with a priority queue of branches not taken yet, nearest centroid first, and so visits
leaves in the order in which they are likely to hold neighbours. How many leaves is not guessed:
for a bounded set of queries the true neighbours are found by comparison with all vectors, in blocks, and
visits are widened until the wanted share of these neighbours lies in visited leaves.

Rows move in blocks: a leaf is cut into blocks of vectors, its queries into blocks of queries, and a join on the leaf
brings each pair of blocks together, so a crowded leaf is many small rows. Equal vectors are kept once, with as
many of their smallest ids as a result can hold, which loses nothing: the others could never be in a result.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliploom.llm.common import kept

SAMPLE = 20_000  # vectors the tree is fitted on, about
LEAF = 40  # vectors of the sample in a leaf, at most
BRANCHES = 8
CALIBRATION = 100  # queries compared with all vectors, at most
RECALL = 0.95  # share of their neighbours that visited leaves must hold
BLOCK = 512  # vectors of a leaf in a row, about
QUERIES = 64  # queries of a leaf in a row, about

HELD = 2_000_000  # candidates that a task collects before it thins them out

_HITS = "query_id bigint, vec_id bigint, distance double"
_HIT = np.dtype([("query", "<i8"), ("id", "<i8"), ("distance", "<f8")])


def _usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("bigint"), F.col("embedding").alias("vector"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fine = F.col("vec_id").isNotNull() & (F.size("vector") > 0) & ~F.exists("vector", bad) & F.exists("vector", lambda x: x != 0)
    rows = rows.where(fine)
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("vector") == (sizes.n if sizes else 0))


def _matrix(vectors: pa.Array) -> np.ndarray:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 1))


def distances(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distances of all pairs, from differences in double precision."""
    return np.stack([np.sqrt(((points - q) ** 2).sum(1)) for q in queries]) if len(queries) else np.zeros((0, len(points)))


@dataclass
class Tree:
    """children[i] are the nodes below node i, centers[i] their centroids; a node without children is a leaf."""

    children: list[list[int]]
    centers: list[np.ndarray | None]
    leaf_of: list[int]  # leaf number, -1 for inner nodes

    @property
    def leaves(self) -> int:
        return max(self.leaf_of) + 1

    def place(self, points: np.ndarray) -> np.ndarray:
        """Leaf of each point: down the nearest centroids."""
        found, todo = np.zeros(len(points), np.int32), [(0, np.arange(len(points)))]
        while todo:
            node, own = todo.pop()
            if not self.children[node]:
                found[own] = self.leaf_of[node]
            elif len(own):
                nearest = _nearest(points[own], self.centers[node])
                todo += [(child, own[nearest == k]) for k, child in enumerate(self.children[node])]
        return found

    def visits(self, query: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            while self.children[node]:
                apart = np.sqrt(((self.centers[node] - query) ** 2).sum(1))
                best = int(apart.argmin())
                for k, child in enumerate(self.children[node]):
                    if k != best:
                        heapq.heappush(queue, (float(apart[k]), child))
                node = self.children[node][best]
            yield self.leaf_of[node]


def _nearest(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((centers**2).sum(1) - 2 * points @ centers.T).argmin(1)


def fit(points: np.ndarray, leaf: int = LEAF, branches: int = BRANCHES, seed: int = 0) -> Tree:
    """Hierarchical k-means: split until a node has ``leaf`` points at most or its points cannot be told apart."""
    rng, tree = np.random.default_rng(seed), Tree([[]], [None], [-1])
    todo, leaves = [(0, points)], 0
    while todo:
        node, own = todo.pop()
        centers = _k_means(own, branches, rng) if len(own) > leaf else None
        if centers is None:
            tree.leaf_of[node] = leaves
            leaves += 1
            continue
        nearest = _nearest(own, centers)
        tree.centers[node] = centers
        for k in range(len(centers)):
            tree.children.append([])
            tree.centers.append(None)
            tree.leaf_of.append(-1)
            tree.children[node].append(len(tree.children) - 1)
            todo.append((len(tree.children) - 1, own[nearest == k]))
    return tree


def _k_means(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray | None:
    """Centroids of the clusters that have points; None if there is one cluster only."""
    start = np.unique(points, axis=0)
    centers = start[rng.choice(len(start), min(k, len(start)), replace=False)]
    for _ in range(rounds):
        nearest = _nearest(points, centers)
        used = np.unique(nearest)
        centers = np.stack([points[nearest == c].mean(0) for c in used])
    return centers[np.unique(_nearest(points, centers))] if len(np.unique(_nearest(points, centers))) > 1 else None


def _sampled(rows: DataFrame, most: int, n: int, salt: int) -> DataFrame:
    return rows.where(F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(-(-n // most) or 1)) == 0)


def build(points: DataFrame, n: int, sample: int = SAMPLE, leaf: int = LEAF) -> Tree:
    """The tree of n points, fitted on about ``sample`` of them, which the driver holds."""
    rows = _sampled(points, sample, n, 31).orderBy("vec_id").select("vector").toArrow()
    found = _matrix(rows.column("vector"))
    return fit(found, leaf) if len(found) else Tree([[]], [None], [0])


def _distinct(rows: DataFrame, k: int) -> DataFrame:
    """(vec_id, vector, ids): each distinct vector once, with its k + 1 smallest ids; a query's own may be among them.

    Copies are thinned out before the shuffle, by a limit per group that Spark applies on both sides of it.
    """
    by_vector = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.distinct().withColumn("rank", F.row_number().over(by_vector)).where(F.col("rank") <= k + 1)
    return few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("vec_id"), "vector", "ids")


def _in_leaves(points: DataFrame, tree: Tree) -> DataFrame:
    kind = points.schema["vector"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = pa.array(tree.place(_matrix(batch.column("vector"))), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, leaf], ["vec_id", "vector", "ids", "leaf"])

    return points.mapInArrow(place, f"vec_id bigint, vector {kind}, ids array<bigint>, leaf int")


def _best(hits: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query, ties to the smaller id."""
    nearest = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return hits.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)


def _true_neighbours(points: DataFrame, queries: list, k: int) -> DataFrame:
    """(query_id, vec_id, distance, leaf) of the k nearest distinct vectors of each of a bounded list of queries."""
    ids, vectors = [q.vec_id for q in queries], np.array([q.vector for q in queries], np.float64)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, leaf = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "leaf"))
            apart = distances(vectors, _matrix(batch.column("vector")))
            for query, row in zip(ids, apart, strict=True):
                near = np.flatnonzero(row <= np.partition(row, min(k, len(row)) - 1)[min(k, len(row)) - 1]) if len(row) else []
                columns = [pa.array([query] * len(near), pa.int64()), *map(pa.array, (own[near], row[near], leaf[near]))]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "distance", "leaf"])

    return _best(points.mapInArrow(compare, _HITS + ", leaf int"), k)


def calibrate(points: DataFrame, queries: DataFrame, tree: Tree, k: int, recall: float = RECALL) -> tuple[int, float]:
    """Leaves to visit, and the share of true neighbours in them over the calibration queries.

    Visits are doubled until the share is reached, then narrowed down to the least number that reaches it.
    """
    sample = queries.orderBy(F.xxhash64("vec_id", F.lit(77)), "vec_id").limit(CALIBRATION).collect()
    if not sample:
        return tree.leaves, 1.0
    leaves = {q.vec_id: list(tree.visits(np.array(q.vector, np.float64))) for q in sample}
    truth = _true_neighbours(points, sample, k + 1).select("query_id", "leaf").collect()
    places = np.array([leaves[r.query_id].index(r.leaf) for r in truth])

    def reached(visits: int) -> float:
        return float((places < visits).mean())

    visits = 1
    while visits < tree.leaves and reached(visits) < recall:
        visits *= 2
    visits = min(visits, tree.leaves)
    while visits > 1 and reached(visits - 1) >= recall:
        visits -= 1
    return visits, reached(visits)


def _probes(queries: DataFrame, tree: Tree, visits: int, held: np.ndarray, k: int) -> DataFrame:
    """A row per query and visited leaf. Visits go on until the leaves hold k ids besides the query's own."""
    kind = queries.schema["vector"].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, leaves = [], []
            for i, vector in enumerate(_matrix(batch.column("vector"))):
                total = 0
                for turn, leaf in enumerate(tree.visits(vector)):
                    if turn >= visits and total > k:
                        break
                    total += held[leaf]
                    rows.append(i)
                    leaves.append(leaf)
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(leaves, pa.int32())], ["vec_id", "vector", "leaf"])

    return queries.mapInArrow(walk, f"vec_id bigint, vector {kind}, leaf int")


def _blocked(rows: DataFrame, counts: Column, size: int, name: str, *fields: str) -> DataFrame:
    """Rows of a leaf in blocks of about ``size``, by hash."""
    block = F.pmod(F.xxhash64("vec_id"), F.ceil(counts[F.col("leaf")] / size)).alias("block")
    grouped = rows.select("*", block).groupBy("leaf", "block")
    return grouped.agg(*(F.collect_list(f).alias(f"{name}_{f}") for f in fields)).drop("block")


def _per_leaf(rows: DataFrame, tree: Tree) -> tuple[list[int], Column]:
    """Number of rows of each leaf, which is one number per leaf of a tree of bounded size."""
    counts = {r.leaf: r["count"] for r in rows.groupBy("leaf").count().collect()}
    numbers = [max(1, counts.get(leaf, 0)) for leaf in range(tree.leaves)]
    return numbers, F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")


def _compare(k: int) -> Callable:
    """The k nearest of each query among the points that meet it in this task."""

    def best(parts: list[np.ndarray]) -> np.ndarray:
        rows = np.concatenate(parts)
        rows = rows[np.lexsort((rows["id"], rows["distance"], rows["query"]))]
        first = np.flatnonzero(np.r_[True, rows["query"][1:] != rows["query"][:-1]][: len(rows)])
        rank = np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)]))
        return rows[rank < k]

    def nearest(batch: pa.RecordBatch, i: int) -> Iterator[np.ndarray]:
        ids = batch.column("p_ids")[i].values
        owner = np.repeat(np.arange(len(ids)), pc.list_value_length(ids).to_numpy())
        ids = ids.flatten().to_numpy()
        apart = distances(_matrix(batch.column("q_vector")[i].values), _matrix(batch.column("p_vector")[i].values))
        for query, row in zip(batch.column("q_vec_id")[i].values.to_numpy(), apart, strict=True):
            own = row[owner]
            order = np.lexsort((ids, own))
            order = order[ids[order] != query][:k]
            found = np.zeros(len(order), _HIT)
            found["query"], found["id"], found["distance"] = query, ids[order], own[order]
            yield found

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [np.zeros(0, _HIT)], 0
        for batch in batches:
            for i in range(batch.num_rows):
                found = list(nearest(batch, i))
                parts += found
                held += sum(map(len, found))
                if held > HELD:  # if it stays that many, these queries' results so far go out
                    parts = [best(parts)]
                    held = len(parts[0])
                    if held > HELD // 2:
                        yield out(parts[0])
                        parts, held = [np.zeros(0, _HIT)], 0
        yield out(best(parts))

    def out(rows: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(np.ascontiguousarray(rows[c])) for c in ("query", "id", "distance")]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _HITS.split(", ")])

    return compare


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found of each query; both tables have (vec_id, embedding).

    Vectors that are null, zero or hold null or non-finite components take no part, nor do rows without
    vec_id or whose vector has another length than most. Rows with the query's vec_id are its own
    and no candidates; repeated rows count once. With fewer candidates than k all are returned.
    """
    rows = kept(_usable(vectors).distinct(), "vectors")
    wanted = kept(_usable(queries).distinct(), "queries")
    points = kept(_distinct(rows, k), "points")
    tree = build(points, points.count())
    points = kept(_in_leaves(points, tree), "leaves")
    visits, _ = calibrate(points, wanted, tree, k, recall)
    ids_per_leaf = {r.leaf: r.n for r in points.groupBy("leaf").agg(F.sum(F.size("ids")).alias("n")).collect()}
    held = np.array([ids_per_leaf.get(leaf, 0) for leaf in range(tree.leaves)])
    probes = kept(_probes(wanted, tree, visits, held, k), "probes")
    _, per_leaf = _per_leaf(points, tree)
    _, probes_per_leaf = _per_leaf(probes, tree)
    left = _blocked(probes, probes_per_leaf, QUERIES, "q", "vec_id", "vector")
    right = _blocked(points, per_leaf, BLOCK, "p", "ids", "vector")
    hits = left.join(right, "leaf").drop("leaf").mapInArrow(_compare(k), _HITS)
    return _best(hits, k).select("query_id", "rank", "vec_id", F.col("distance").alias("score"))
