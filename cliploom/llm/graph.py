"""Connected components of an edge table, in the time of its logarithm and without a driver copy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliploom.llm.common import kept_narrow


FEW_NODES = 100_000  # with their least neighbours: 16 bytes each, which may be broadcast


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node in ``edges`` (a, b): the smallest node it reaches. A written table.

    Alternates large-star (link the larger neighbours of a node to its least one) and small-star (link
    the others to it) until nothing changes. Every step is a join on a node with one row
    on the other side, so a node with very many neighbours is split by adaptive execution; the one row of up to
    ``FEW_NODES`` nodes is broadcast, and the links stay where they are.
    Loops and repeated edges change nothing; without edges there are no nodes.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    size = edges.count()
    links, state = kept_narrow(pairs, "links", size), None
    few = 2 * size <= FEW_NODES
    while True:
        both = _each(links, ("u", "v"), ("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(F.broadcast(least) if few else least, F.col("u") == F.col("k"))
        large = large.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large if few else large.distinct()  # a row for each link at most
        root = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = large.join(F.broadcast(root) if few else root, F.col("u") == F.col("k")).select("u", "v", "m")
        links = _each(small, ("u", "m"), ("v", "m")).where("u != v")
        links = kept_narrow(links.distinct(), "links", 2 * size)
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    found = links.select(F.col("u").alias("id"), F.col("v").alias("component")).union(links.select("v", "v").distinct())
    return kept_narrow(found, "labels", 2 * size)


def _each(rows: DataFrame, *ends: tuple[str, str]) -> DataFrame:
    """Links (u, v): one for each pair of columns, from one pass over the rows."""
    made = F.array(*(F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in ends))
    return rows.select(F.inline(made))
