"""Counters taken while a job runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The same rows, and an observation with ``samples`` once an action has run."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("samples")), seen


def accounting(listed: DataFrame, processed: DataFrame) -> DataFrame:
    """Rows listed, rows processed, and whether they agree. One row."""
    sides = [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(side).alias("side"), "n")
        for side, df in (("listed", listed), ("processed", processed))
    ]
    both = sides[0].unionByName(sides[1])
    counts = both.agg(
        *[F.sum(F.when(F.col("side") == s, F.col("n"))).alias(s) for s in ("listed", "processed")]
    )
    return counts.withColumn("complete", F.col("listed") == F.col("processed"))
