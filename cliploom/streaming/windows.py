"""Event time: tumbling and sliding windows and sessions, over a table or a stream, with late rows accounted for.

Aggregates combine before they are shuffled, so a key or an hour with most of the rows costs a row per task. On a stream each
group waits in the state store until the watermark has passed its end, and is then written once; what comes later is left out, and
``late_rows`` says how much that was. The state is in the checkpoint, so a restarted query goes on where it ended.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MICROS = 1_000_000
SPLIT_SECONDS = 86_400  # sessions are found within spans of a key's time, then joined over their edges


def _measures(value: str | None) -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), *([F.sum(value).alias("total")] if value else [])]


def windowed(
    rows: DataFrame, time: str, size: str, slide: str | None = None, by: Sequence[str] = (), value: str | None = None,
    delay: str | None = None,
) -> DataFrame:
    """Rows (and the sum of ``value``) per window and key: (window_start, window_end, keys, n, total).

    Windows of ``size`` start every ``slide`` (``size`` without it), counted from 1970 in UTC. A null key is a group, a row without time is
    in none. ``delay`` sets the watermark of a stream: how far behind the latest time a row may come.
    """
    rows = rows.withWatermark(time, delay) if delay else rows
    window = F.window(time, size, slide) if slide else F.window(time, size)
    grouped = rows.groupBy(window.alias("window"), *by).agg(*_measures(value))
    bounds = [F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end")]
    return grouped.select(*bounds, *by, "n", *(["total"] if value else []))


def late_rows(arrived: DataFrame, counted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Windows over all that arrived, with what a stream has counted of it: (keys, n, further columns of ``counted``, late).

    A window of which nothing was counted has n = 0. Both are aggregates with a row per window and key; nulls match.
    """
    mine = counted.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in counted.columns if c not in keys])
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
    n = F.coalesce(mine["n"], F.lit(0).cast("bigint"))
    further = [mine[c] for c in counted.columns if c not in (*keys, "n")]
    both = arrived.select(*keys, F.col("n").alias("__arrived")).join(mine, same, "left")
    return both.select(*keys, n.alias("n"), *further, (F.col("__arrived") - n).alias("late"))


def sessions(
    rows: DataFrame, key: str, time: str, gap_seconds: int, value: str | None = None, split_seconds: int = SPLIT_SECONDS
) -> DataFrame:
    """A row per session of a table: (key, session_start, session_end, n, total); the end is the time of the last row.

    A session goes on while the next row comes at most ``gap_seconds`` after the last. Rows are grouped by key and span of time first,
    so a key that holds most rows is many groups. Only the first and last session of a span can touch another's; these, two rows
    per key and span, are joined as sessions whose gap is their own length longer. A null key is a key; rows without time are in no session.
    """
    span = F.floor(F.unix_micros(F.col(time)) / (split_seconds * MICROS))
    kept = rows.where(F.col(time).isNotNull()).withColumn("__span", span)
    part = kept.groupBy(key, "__span", F.session_window(time, f"{gap_seconds} seconds").alias("__at")).agg(
        F.min(time).alias("session_start"), F.max(time).alias("session_end"), *_measures(value)
    ).drop("__at")
    edges = part.groupBy(F.col(key).alias("__key"), F.col("__span").alias("__of")).agg(
        F.min("session_start").alias("__first"), F.max("session_start").alias("__last")
    )
    mine = F.col(key).eqNullSafe(F.col("__key")) & (F.col("__span") == F.col("__of"))
    marked = part.join(edges, mine).withColumn("__edge", F.col("session_start").isin(F.col("__first"), F.col("__last")))
    columns = [key, "session_start", "session_end", "n", *(["total"] if value else [])]
    length = (F.unix_micros("session_end") - F.unix_micros("session_start") + gap_seconds * MICROS).cast("string")
    reach = F.concat(length, F.lit(" microseconds"))
    sums = [F.sum("n").alias("n"), *([F.sum("total").alias("total")] if value else [])]
    joined = marked.where("__edge").groupBy(key, F.session_window("session_start", reach).alias("__at")).agg(
        F.min("session_start").alias("__start"), F.max("session_end").alias("session_end"), *sums
    )
    joined = joined.withColumnRenamed("__start", "session_start").select(*columns)
    return marked.where("NOT __edge").select(*columns).unionByName(joined)


def streamed_sessions(
    rows: DataFrame, key: str, time: str, gap_seconds: int, value: str | None = None, delay: str = "0 seconds"
) -> DataFrame:
    """The same of a stream, where the state holds the open sessions of each key and joins those that a row connects."""
    window = F.session_window(time, f"{gap_seconds} seconds").alias("__at")
    found = rows.withWatermark(time, delay).groupBy(key, window)
    found = found.agg(F.min(time).alias("session_start"), F.max(time).alias("session_end"), *_measures(value))
    return found.select(key, "session_start", "session_end", "n", *(["total"] if value else []))


def closing_row(like: DataFrame, time: str, after: Column) -> DataFrame:
    """One row that has nothing but a time: appended to a stream that has ended, it lets the watermark pass all open groups."""
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in like.schema if f.name != time]
    return like.sparkSession.range(1).select(*empty, after.cast(like.schema[time].dataType).alias(time)).select(*like.columns)
