"""A dataset manifest as a persistent Merkle tree: rows are leaves, and a changed row makes a version.

Rows of one tree (a language, say) ascend by id; every ``FAN_OUT`` consecutive nodes become the digest of theirs, until
one is left, the subroot. The subroots, in the order of their trees, are the leaves of one more such tree, whose last node is the root.

The tree is built in aligned blocks of ``BLOCK`` nodes, which is ``BLOCK_LEVELS`` levels: a block is one row, folded in
whatever task reads it, and the tops of all blocks are the nodes of the next round. So n rows take about log n / log ``BLOCK``
rounds, each a shuffle of ``BLOCK`` times fewer nodes, and no task holds more than a block. On the way back down every block gets the
path from its top to the root: the siblings on the left and on the right, level by level.

Nodes never change. A changed leaf copies its ancestors only (``BlockTree.copies``): those inside its block next to the block's
shared nodes, those above by the block's path, in the task that has the block. All versions share every other node.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliploom.llm.common import kept
from cliploom.operators.index import dense_index
from cliploom.operators.sizing import broadcast_if_small

FAN_OUT = 8
BLOCK_LEVELS = 3
BLOCK = FAN_OUT**BLOCK_LEVELS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
ABSENT = "-"

_ABOVE = "tree string, place bigint, path string, subroot string, root string"
PROOFS = "doc_id bigint, leaf string, changed string, subroot string, root string, proof_sha256 string, folded_root string"
WHOLE_PATHS = "siblings array<string>, copies array<string>"
_KINDS = {"string": pa.string(), "bigint": pa.int64(), "array<string>": pa.list_(pa.string())}


def digest(parts: str) -> str:
    return sha256(parts.encode()).hexdigest()


def leaf(columns: Sequence[Column]) -> Column:
    """Digest of the values, each ``-`` if null, else its number of UTF-8 bytes, a colon and itself."""
    values = [c.cast("string") for c in columns]
    told = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit(ABSENT)) for v in values]
    return F.sha2(F.concat(*told), 256)


def height(nodes: int) -> int:
    """Levels above ``nodes`` nodes, until one is left."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // FAN_OUT), levels + 1
    return levels


class BlockTree:
    """Digests by level, lowest first. Nothing in it changes once it is built."""

    def __init__(self, leaves: Sequence[str], levels: int) -> None:
        self.levels = [list(leaves)]
        for _ in range(levels):
            below = self.levels[-1]
            self.levels.append([digest("".join(below[i : i + FAN_OUT])) for i in range(0, len(below), FAN_OUT)])

    @property
    def top(self) -> str:
        return self.levels[-1][0]

    def siblings(self, place: int) -> list[tuple[str, str]]:
        """What stands left and right of a leaf and of its ancestors inside their runs, lowest first."""
        found = []
        for level in self.levels[:-1]:
            first = place - place % FAN_OUT
            found.append(("".join(level[first:place]), "".join(level[place + 1 : first + FAN_OUT])))
            place //= FAN_OUT
        return found


def copies(changed: str, siblings: Sequence[tuple[str, str]]) -> list[str]:
    """A version: the leaf and copies of its ancestors up to the last level of ``siblings``, which are shared."""
    nodes = [changed]
    for left, right in siblings:
        nodes.append(digest(left + nodes[-1] + right))
    return nodes


@dataclass(frozen=True)
class Manifest:
    """Written nodes: blocks of each round, lowest first, and the rounds above the subroots.

    A block is a row (tree, block, levels, nodes, top); the lowest ones also hold the ids and changed leaves.
    """

    rounds: list[DataFrame]
    upper: list[DataFrame]
    subroots: DataFrame  # (tree, place, digest): place among the subroots


def manifest(
    docs: DataFrame, columns: Sequence[str] = COLUMNS, by: str = "lang", order: str = "doc_id",
    tampered: Column | None = None, edits: dict[str, Column] | None = None,
) -> Manifest:
    """The tree over all rows, one subtree per value of ``by`` (null is a value, and comes first).

    Where ``tampered`` holds, ``edits`` give other values of columns: that leaf's changed digest is stored with it.
    Rows with the same order, null too, are ordered by their digests, so equal rows are equal leaves in any order. Other
    columns are ignored; an empty table has no node.
    """
    values = {c: F.col(c) for c in columns}
    changed = F.when(tampered, leaf(list((values | (edits or {})).values()))) if tampered is not None else F.lit(None)
    leaves = docs.select(
        F.col(by).cast("string").alias("tree"), F.col(order).cast("bigint").alias("doc_id"),
        leaf(list(values.values())).alias("digest"), changed.cast("string").alias("changed"),
    )
    placed = dense_index(leaves, ["doc_id", "digest"], by=["tree"], name="place")
    rounds = _rounds(placed, ("doc_id", "changed"))
    tops = rounds[-1].select("tree", F.col("top").alias("digest"))
    subroots = kept(dense_index(tops, ["tree"], name="place", unique=True), "subroots")
    return Manifest(rounds, _rounds(subroots.withColumn("tree", F.lit(None).cast("string"))), subroots)


def _rounds(nodes: DataFrame, further: Sequence[str] = ()) -> list[DataFrame]:
    """Fold (tree, place, digest) block by block, until each tree is one node."""
    rounds = []
    while True:
        rounds.append(_blocks(nodes, further))
        nodes, further = rounds[-1].select("tree", F.col("block").alias("place"), F.col("top").alias("digest")), ()
        if not nodes.where("place > 0").take(1):
            return rounds


def _blocks(nodes: DataFrame, further: Sequence[str]) -> DataFrame:
    """A row per aligned block of nodes, with the digest that its levels come to."""
    block = F.floor(F.col("place") / BLOCK)
    parts = ("place", "digest", *further)
    grouped = nodes.groupBy("tree", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct(*parts))).alias("at"))
    arrays = [F.col(f"at.{c}").alias(c) for c in ("digest", *further)]
    packed = kept(grouped.select("tree", "block", *arrays), "merkle")
    last = packed.groupBy("tree").agg(F.max_by(F.size("digest") + F.col("block") * BLOCK, "block").alias("n"))
    sizes = broadcast_if_small(kept(last.select(F.col("tree").alias("of"), "n"), "sizes"))
    sized = packed.join(sizes, F.col("tree").eqNullSafe(F.col("of"))).drop("of")
    names = ["tree", "block", "n", "digest", *further]
    schema = "tree string, block bigint, n bigint, digest array<string>" + "".join(
        f", {c} array<{nodes.schema[c].dataType.simpleString()}>" for c in further
    )

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            levels = [min(BLOCK_LEVELS, height(n)) for n in batch.column("n").to_pylist()]
            tops = [BlockTree(x, k).top for x, k in zip(batch.column("digest").to_pylist(), levels, strict=True)]
            extra = [pa.array(levels, pa.int32()), pa.array(tops, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*names, "levels", "top"])

    return kept(sized.select(*names).mapInArrow(fold, schema + ", levels int, top string"), "blocks")


def proofs(found: Manifest, whole: bool = False) -> DataFrame:
    """``PROOFS`` per row: its leaf and changed leaf, the roots, and what proves it.

    ``proof_sha256`` is the digest of the siblings of the leaf and of its ancestors, level by level up to the root, left to right;
    ``folded_root`` is what the changed leaf (where there is none, the leaf) and these siblings come to. ``whole`` adds the
    ``siblings`` themselves, and ``copies``: the nodes of the row's version from leaf to root (null for a row without
    change), which shares all other nodes with the tree.
    """
    top = found.upper[-1].select("tree", F.lit(0).cast("bigint").alias("place"), F.lit("").alias("path"), F.col("top").alias("root"))
    above = _down(found.upper, top.withColumn("subroot", F.lit(None).cast("string")))
    trees = found.subroots.select(F.col("tree").alias("of"), F.col("place").alias("at"), F.col("digest").alias("top"))
    above = above.drop("tree", "subroot").join(broadcast_if_small(trees), F.col("place") == F.col("at"))
    above = above.select(F.col("of").alias("tree"), F.lit(0).cast("bigint").alias("place"), "path", F.col("top").alias("subroot"), "root")
    above = _down(found.rounds[1:], above)
    schema = f"{PROOFS}, {WHOLE_PATHS}" if whole else PROOFS

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield _batch(_proofs_of(batch.slice(k, 1).to_pylist()[0], whole), schema)

    return _with_paths(found.rounds[0], above).mapInArrow(prove, schema)


def _proofs_of(block: dict, whole: bool) -> list[tuple]:
    tree, above, rows = BlockTree(block["digest"], block["levels"]), _sides(block["path"]), []
    for i, (own, changed) in enumerate(zip(block["digest"], block["changed"], strict=True)):
        path = [*tree.siblings(i), *above]
        version = copies(own if changed is None else changed, path)
        proof = digest("".join([side for pair in path for side in pair]))
        row = (block["doc_id"][i], own, changed, block["subroot"], block["root"], proof, version[-1])
        if whole:
            row += ([side[j : j + 64] for pair in path for side in pair for j in range(0, len(side), 64)],)
            row += (None if changed is None else version,)
        rows.append(row)
    return rows


def _down(rounds: Sequence[DataFrame], above: DataFrame) -> DataFrame:
    """From paths of the last round's blocks to paths of the first round's nodes, which are the blocks of the round below."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                tree = BlockTree(r["digest"], r["levels"])
                for i in range(len(r["digest"])):
                    path = ",".join([*(f"{left}:{right}" for left, right in tree.siblings(i)), *filter(None, [r["path"]])])
                    rows.append((r["tree"], r["block"] * BLOCK + i, path, r["subroot"], r["root"]))
            yield _batch(rows, _ABOVE)

    for blocks in reversed(rounds):
        above = kept(_with_paths(blocks, above).mapInArrow(extend, _ABOVE), "paths")
    return above


def _with_paths(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """Blocks with the path from their top to the root; ``above`` has a row per block."""
    renamed = above.withColumnsRenamed({"tree": "of", "place": "at"})
    mine = F.col("tree").eqNullSafe(F.col("of")) & (F.col("block") == F.col("at"))
    return blocks.join(broadcast_if_small(renamed), mine).drop("of", "at")


def _sides(path: str) -> list[tuple[str, str]]:
    return [tuple(pair.split(":")) for pair in path.split(",") if pair]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    columns = [c.split() for c in schema.split(", ")]
    arrays = [pa.array([r[k] for r in rows], _KINDS[kind]) for k, (_, kind) in enumerate(columns)]
    return pa.RecordBatch.from_arrays(arrays, [name for name, _ in columns])
