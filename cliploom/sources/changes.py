"""What changed between two listings, by counted keys: content is never moved.

Rows are compared as a multiset: a row that is in one listing three times and in the other once is different twice. Both sides are
counted before they meet, so copies cost one row and a hot key costs nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADDED, GONE, CHANGED, RENAMED, SAME = "added", "gone", "changed", "renamed", "same"


def counted(old: DataFrame, new: DataFrame, on: Sequence[str]) -> DataFrame:
    """(on, n_old, n_new): how often each row is in either listing. Nulls are values that equal each other."""
    sides = [
        side.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).select(*on, *(F.when(F.lit(mine), F.col("n")).alias(name) for mine, name in flags))
        for side, flags in ((old, ((True, "n_old"), (False, "n_new"))), (new, ((False, "n_old"), (True, "n_new"))))
    ]
    zero = F.lit(0).cast("bigint")
    return sides[0].union(sides[1]).groupBy(*on).agg(
        F.coalesce(F.sum("n_old"), zero).alias("n_old"), F.coalesce(F.sum("n_new"), zero).alias("n_new")
    )


def minus(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """(on, times): rows of ``left`` beyond those of ``right``, and how many."""
    times = F.col("n_old") - F.col("n_new")
    return counted(left, right, on).where(times > 0).select(*on, times.alias("times"))


def common(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """(on, times): rows that both have, and how often both have them."""
    times = F.least("n_old", "n_new")
    return counted(left, right, on).where(times > 0).select(*on, times.alias("times"))


def repeated(rows: DataFrame) -> DataFrame:
    """The rows of ``minus`` or ``common``, each ``times`` times."""
    names = [c for c in rows.columns if c != "times"]
    return rows.withColumn("times", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select(*names)


def changes(old: DataFrame, new: DataFrame, path: str, state: Sequence[str]) -> DataFrame:
    """(path, change, other): what became of each path that is in either listing.

    A path in both is the same or, if the multiset of its states (size and time, say) differs, changed. A gone path and an added one are a renaming,
    from ``path`` to ``other``, if they have the same states and no other gone or added path has; otherwise each stands for itself. Null is a path.
    """
    keys = [path, *state]
    both = counted(old, new, keys)

    def states(n: str) -> Column:
        """The multiset of a path's states, as a digest of bounded size."""
        listed = F.sort_array(F.collect_list(F.when(F.col(n) > 0, F.struct(*state, F.col(n).alias("n")))))
        return F.sha2(F.to_json(listed), 256)

    paths = both.groupBy(path).agg(
        F.sum("n_old").alias("__old"), F.sum("n_new").alias("__new"), F.max(F.col("n_old") != F.col("n_new")).alias("__differs"),
        states("n_old").alias("__was"), states("n_new").alias("__is"),
    )
    change = F.when(F.col("__old") == 0, ADDED).when(F.col("__new") == 0, GONE).when(F.col("__differs"), CHANGED).otherwise(SAME)
    paths = paths.withColumn("change", change)
    mark = F.when(F.col("change") == ADDED, F.col("__is")).otherwise(F.col("__was"))
    single = paths.where(F.col("change").isin(ADDED, GONE)).withColumn("__mark", mark)
    moved = single.groupBy("__mark").agg(
        F.count_if(F.col("change") == GONE).alias("gone"), F.count_if(F.col("change") == ADDED).alias("added"),
        F.max(F.when(F.col("change") == GONE, F.col(path))).alias("__from"), F.max(F.when(F.col("change") == ADDED, F.col(path))).alias("__to"),
    ).where("gone = 1 AND added = 1").select(F.col("__mark").alias("__moved"), "__from", "__to")
    told = single.join(moved, F.col("__mark") == F.col("__moved"), "left")
    renamed = F.col("__moved").isNotNull()
    lone = told.where(~(renamed & (F.col("change") == ADDED))).select(
        path, F.when(renamed, RENAMED).otherwise(F.col("change")).alias("change"), F.when(renamed, F.col("__to")).alias("other")
    )
    nothing = F.lit(None).cast(dict(paths.dtypes)[path]).alias("other")
    return paths.where(F.col("change").isin(CHANGED, SAME)).select(path, "change", nothing).unionByName(lone)

