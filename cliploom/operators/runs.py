"""Analytics over a log of benchmark runs (``schemas.RUNS``).

Aggregates only: each groups by a key, combines map-side and returns one row per
group, so a framework or method that holds most of the log costs nothing extra.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.operators.index import dense_index
from cliploom.operators.sizing import broadcast_if_small
from cliploom.session import shared_dir

# Settings per tier, by smallest value that belongs to the tier.
TIER_COLUMNS = (
    "tier", "loader_workers", "task_workers", "map_processes", "batch_sizes", "map_batch", "cpus_per_task", "concurrency"
)
TIERS = (
    (16, ("large", 8, 12, 8, [8, 16, 32], 16, 2, 8)),
    (8, ("medium", 6, 8, 6, [4, 8, 16], 12, 2, 6)),
    (4, ("small", 4, 4, 4, [4, 8], 8, 1, 4)),
)
LOWEST_TIER = ("minimal", 2, 2, 2, [2, 4], 4, 1, 2)


def safe_ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, 0 where bottom is not positive."""
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def summary(runs: DataFrame, *by: str) -> DataFrame:
    """Samples, time and samples per second for each group."""
    totals = runs.groupBy(*by).agg(
        F.sum("samples_processed").alias("samples_processed"), F.sum("total_time").alias("total_time")
    )
    rate = safe_ratio(F.col("samples_processed"), F.col("total_time"))
    return totals.withColumn("samples_per_second", rate)


def winners(runs: DataFrame) -> DataFrame:
    """Shortest time, highest rate and smallest memory of the successful runs; the first run wins a tie.

    Runs without a value for a metric do not compete for it; without any, name, run_no and value are null.
    """

    def first_by(metric: str, best, sign: int) -> Column:
        competes = F.col("success") & F.col(metric).isNotNull()
        key = F.when(competes, F.struct(F.col(metric), F.col("run_no") * sign))
        return best(F.struct("name", "run_no", F.col(metric).alias("value")), key)

    best = runs.agg(
        F.array(
            *[
                F.struct(F.lit(metric).alias("metric"), first_by(metric, fn, sign).alias("run"))
                for metric, fn, sign in (
                    ("total_time", F.min_by, 1),
                    ("samples_per_second", F.max_by, -1),
                    ("memory_usage_mb", F.min_by, 1),
                )
            ]
        ).alias("rows")
    )
    return best.select(F.inline("rows")).select("metric", "run.name", "run.run_no", "run.value")


def framework_of(name: Column) -> Column:
    """First word of a run's name."""
    return F.get(F.split(name, " "), F.lit(0))


def by_framework(runs: DataFrame) -> DataFrame:
    """Runs grouped by framework, in order, as (framework, position) rows.

    Rows and not lists: a framework's runs may be a third of the log.
    """
    named = runs.withColumn("framework", framework_of(F.col("name")))
    return dense_index(named, ["run_no"], by=["framework"], name="position", unique=True)


def repetition_stats(runs: DataFrame, by: str, frames_per_run: int) -> DataFrame:
    """Mean and population standard deviation of time, and frames / mean time."""
    stats = runs.groupBy(by).agg(F.avg("total_time").alias("avg_time"), F.stddev_pop("total_time").alias("std_time"))
    return stats.withColumn("fps", safe_ratio(F.lit(float(frames_per_run)), F.col("avg_time")))


def method_average(runs: DataFrame, frames_per_run: int) -> DataFrame:
    """Mean frame rate per method over its successful runs; methods without one have no row."""
    done = runs.where("success").where("total_time > 0")
    return done.groupBy("method").agg(F.avg(F.lit(float(frames_per_run)) / F.col("total_time")).alias("avg_fps"))


def best_method(runs: DataFrame, per: str) -> DataFrame:
    """Fastest successful run for each ``per`` value; none where every run failed or has no time."""
    best = F.min(F.struct("total_time", "run_no", "method")).alias("best")
    return runs.where("success AND total_time IS NOT NULL").groupBy(per).agg(best).select(per, "best.method", "best.total_time", "best.run_no")


def totals(runs: DataFrame, by: Sequence[str], frames_per_run: int) -> DataFrame:
    """Total time, time per run, total frames, and frames / time as a ratio of sums."""
    sums = runs.groupBy(*by).agg(F.count(F.lit(1)).alias("runs"), F.sum("total_time").alias("total_time"))
    return sums.withColumns(
        {
            "avg_time_per_run": F.col("total_time") / F.col("runs"),
            "total_frames": F.col("runs") * frames_per_run,
            "avg_fps": safe_ratio(F.col("runs") * frames_per_run, F.col("total_time")),
        }
    )


_BASE = {"base_fps": "avg_fps", "base_time": "total_time"}


def against_baseline(totals_df: DataFrame, baseline: str, per: Sequence[str] = (), method: str = "method") -> DataFrame:
    """Compare each method's totals with the baseline method's.

    Adds ``speedup`` (candidate rate / baseline rate) and ``time_reduction_pct``
    ((baseline time - time) / baseline time * 100). With ``per``, within each configuration.
    Both are null where the baseline did not run, and 0 where its rate or time is not positive.
    """
    is_base = F.col(method) == baseline
    # Totals are a row per method (and configuration): they are gathered, and the log is read once.
    base = [F.max(F.when(is_base, F.col(of))).alias(c) for c, of in _BASE.items()]
    gathered = totals_df.groupBy(*[F.col(c).alias(f"__{c}") for c in per]).agg(F.collect_list(F.struct("*")).alias("__rows"), *base)
    compared = gathered.select(F.inline("__rows"), *_BASE)
    ratios = {
        "speedup": (F.col("base_fps"), safe_ratio(F.col("avg_fps"), F.col("base_fps"))),
        "time_reduction_pct": (
            F.col("base_time"),
            safe_ratio(F.col("base_time") - F.col("total_time"), F.col("base_time")) * 100,
        ),
    }
    return compared.withColumns({c: F.when(known.isNotNull(), ratio) for c, (known, ratio) in ratios.items()}).drop(*_BASE)


def grid(spark: SparkSession, **axes: Sequence) -> DataFrame:
    """All combinations of a few parameter lists, in the given order of axes."""
    rows = spark.range(1).select()
    for name, values in axes.items():
        rows = rows.select("*", F.explode(F.lit(list(values))).alias(name))
    return rows


def method_grid(clips: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Each clip with each method of a fixed list: one scan, no join."""
    return clips.select("*", F.explode(F.lit(list(methods))).alias("method"))


def method_results(runs: DataFrame, key: str, methods: Sequence[str]) -> DataFrame:
    """Runs and mean time of each key with each method of a fixed list, 0 runs where none ran.

    A column per method in one aggregate by key: the log is read once and joined to nothing.
    """
    own = {m: F.col("method") == m for m in methods}
    cells = [
        F.struct(
            F.lit(m).alias("method"),
            F.count_if(is_own).alias("runs"),
            F.avg(F.when(is_own, F.col("total_time"))).alias("avg_time"),
        )
        for m, is_own in own.items()
    ]
    return runs.groupBy(key).agg(F.array(*cells).alias("cells")).select(key, F.inline("cells"))


def feasible(grid_df: DataFrame, limit: int, column: str = "num_workers") -> DataFrame:
    """Drop settings that need more than ``limit`` workers."""
    return grid_df.where(F.col(column) <= limit)


def grid_results(grid_df: DataFrame, runs: DataFrame, on: Sequence[str]) -> DataFrame:
    """Runs per grid point, 0 where none ran. The log is aggregated before the join."""
    done = runs.groupBy(*on).agg(F.count(F.lit(1)).alias("runs"), F.avg("total_time").alias("avg_time"))
    return grid_df.join(done, list(on), "left").withColumn("runs", F.coalesce("runs", F.lit(0).cast("bigint")))


def tier(value: Column) -> Column:
    """Settings for a size, as a struct: the tier with the highest threshold not above it."""

    def settings(row: tuple) -> Column:
        return F.struct(*[F.lit(v).alias(name) for name, v in zip(TIER_COLUMNS, row, strict=True)])

    chosen = reduce(
        lambda chain, t: chain.when(value >= t[0], settings(t[1])),
        TIERS[1:],
        F.when(value >= TIERS[0][0], settings(TIERS[0][1])),
    )
    return chosen.otherwise(settings(LOWEST_TIER))


def clamp(value: Column, limit: Column) -> Column:
    return F.least(value, limit)


def drop_warmup(runs: DataFrame, order: Sequence[str], by: str = "method") -> DataFrame:
    """Leave out each method's first run: the first in ``order``, nulls first, and one of those that tie.

    The least leading key is one value per method, so no run is sorted or moved to find it; only
    the runs that have it are put in order.
    """
    lead = F.col(order[0])
    least = runs.groupBy(F.col(by).alias("__by")).agg(F.min(lead).alias("__least"), F.max(lead.isNull()).alias("__null"))
    shared_dir(runs.sparkSession)
    least = broadcast_if_small(least.withColumn("__least", F.when(~F.col("__null"), F.col("__least"))).checkpoint())
    keyed = runs.join(least, F.col(by).eqNullSafe(F.col("__by")))
    leading = lead.eqNullSafe(F.col("__least"))
    first = dense_index(keyed.where(leading).select(*runs.columns), order, by=[by], name="__place")
    return keyed.where(~leading).select(*runs.columns).union(first.where("__place > 0").select(*runs.columns))


def call_counts(runs: DataFrame, by: str, batch_size: int) -> DataFrame:
    """Function calls for row-wise and batch-wise work, and time per call."""
    sums = runs.groupBy(by).agg(F.count(F.lit(1)).alias("row_calls"), F.sum("total_time").alias("total_time"))
    return sums.withColumn("batch_calls", F.ceil(F.col("row_calls") / batch_size)).withColumns(
        {
            "time_per_row_call": F.col("total_time") / F.col("row_calls"),
            "time_per_batch_call": F.col("total_time") / F.col("batch_calls"),
        }
    )


def combine(*logs: DataFrame) -> DataFrame:
    """One log from several, matched by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), logs)


def cube(
    runs: DataFrame, dims: Sequence[str], sums: Sequence[str] = (), distinct: Sequence[str] = (), sets: Sequence[Sequence[str]] | None = None
) -> DataFrame:
    """Runs, sums and distinct values for all combinations of ``dims``, or for the given grouping sets.

    Columns: the dims (null where rolled up; ``grouping_id`` has that dim's bit set then, the first dim's is the highest), n, ``sum_`` and
    ``distinct_`` columns. The log is read once for the sums and once per distinct column, and is reduced to one row per finest combination
    (and value) before anything is multiplied by the number of sets. A null dim is a group of its own; null values count for nothing.
    """
    sets = [list(s) for s in sets or ()]

    def grouped(fine: DataFrame):
        return fine.groupingSets(sets, *dims) if sets else fine.cube(*dims)

    gid = F.grouping_id(*dims).cast("bigint").alias("grouping_id")
    fine = runs.groupBy(*dims).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"sum_{c}") for c in sums])
    out = grouped(fine).agg(gid, F.sum("n").alias("n"), *[F.sum(f"sum_{c}").alias(f"sum_{c}") for c in sums])
    keys = [*dims, "grouping_id"]
    for c in distinct:
        values = runs.where(F.col(c).isNotNull()).select(*dims, F.col(c).alias("__value")).distinct()
        counts = grouped(values).agg(gid, F.count_distinct("__value").alias(f"distinct_{c}"))
        counts = counts.select(*[F.col(k).alias(f"__{k}") for k in keys], f"distinct_{c}")
        same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
        joined = out.join(counts, same, "left").drop(*(f"__{k}" for k in keys))
        out = joined.withColumn(f"distinct_{c}", F.coalesce(f"distinct_{c}", F.lit(0).cast("bigint")))
    return out


def rollup_sets(dims: Sequence[str]) -> list[list[str]]:
    """The grouping sets of a roll-up: all dims, then one less from the right each time."""
    return [list(dims[:k]) for k in range(len(dims), -1, -1)]
