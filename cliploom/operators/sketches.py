"""Distinct counts and quantiles as sketches that are stored and merged later.

A sketch is a binary column of bounded size, whatever it has seen, and sketches merge: those of days give months, those of tasks give
days. They are made map-side, so only sketches are shuffled. Errors are relative to the exact answer: a distinct count
is off by at most ``DISTINCT_ERROR`` and a quantile's rank by at most ``RANK_ERROR``, in all but about one case in a hundred.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG_CELLS = 14  # 2 ** 14 cells: a standard error of 0.8 %
DISTINCT_ERROR = 0.025
K = 800
RANK_ERROR = 0.005
SKETCHES = ("n", "distinct_sketch", "quantile_sketch")


def sketched(rows: DataFrame, by: Sequence[str], key: str, value: str) -> DataFrame:
    """Per group: rows, a sketch of the distinct keys, and one of the distribution of values. Nulls are in neither sketch."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.hll_sketch_agg(key, LG_CELLS).alias("distinct_sketch"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), K).alias("quantile_sketch"),
    )


def merged(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sketches of coarser groups from those of finer ones."""
    return sketches.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.kll_merge_agg_double("quantile_sketch", K).alias("quantile_sketch"),
    )


def answers(sketches: DataFrame, ranks: Sequence[float] = (0.5,)) -> DataFrame:
    """What sketches say: ``distinct`` keys, and ``quantiles`` at the ranks (null without any value)."""
    seen = F.kll_sketch_get_n_double("quantile_sketch") > 0
    at = F.kll_sketch_get_quantile_double("quantile_sketch", F.lit([float(r) for r in ranks]))
    said = sketches.withColumns({"distinct": F.hll_sketch_estimate("distinct_sketch"), "quantiles": F.when(seen, at)})
    return said.drop("distinct_sketch", "quantile_sketch")
