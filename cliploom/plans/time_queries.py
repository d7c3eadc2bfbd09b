"""Queries along event time: windows, sessions, the latest baseline, ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.operators import temporal
from cliploom.plans import hosting as host
from cliploom.plans.registry import query
from cliploom.session import scratch_path
from cliploom.sources import dataset
from cliploom.streaming import items as streams
from cliploom.streaming import windows

SIZE_HOURS, SLIDE_HOURS, DELAY_HOURS = 6, 3, 1
GAP_SECONDS = 6 * 3600
LATE = 7  # one event in so many comes a lot later than the others
AFTER = "2100-01-01"


def timed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with ``ts`` as an instant, and ``lot``: in which of three lots a row arrives."""
    events = host.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    lot = F.floor((F.dayofmonth("ts") - 1) / 16) + (F.col("event_id") % LATE == 3).cast("bigint")
    return events.select("event_id", "ts", "user_id", "event_type", "value", lot.alias("lot"))


def _stream_lots(spark: SparkSession, events: DataFrame, step, lots: int, tag: str) -> DataFrame:
    """Run a stream once per lot, each time from the checkpoint of the last, and once more after a closing row."""
    folder, out, state = (scratch_path(spark, f"{tag}-{kind}") for kind in ("lots", "out", "state"))
    parts = [*(events.where(F.col("lot") == lot) for lot in range(lots)), windows.closing_row(events, "ts", F.lit(AFTER).cast("timestamp"))]
    for part in parts:
        part.write.mode("append").parquet(folder)
        stream = streams.stream_table(spark, folder, events.schema)
        streams.run_available(stream, out, state, step)
    return dataset.load(spark, out, step(events).schema)


def _text(time: str) -> Column:
    return F.date_format(time, "yyyy-MM-dd HH:mm:ss").alias(time)


@query(
    "A2 S11",
    f"""WITH arrival AS (
  SELECT *, (day(ts) - 1) // 16 + (event_id % {LATE} = 3)::BIGINT AS lot, epoch_ms(ts) // {SLIDE_HOURS * 3600000} AS slot FROM events),
marks AS (
  SELECT lot, max(max(epoch_ms(ts))) OVER (ORDER BY lot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {DELAY_HOURS * 3600000} AS mark
  FROM arrival GROUP BY lot),
placed AS (
  SELECT event_type, value, (slot - back) * {SLIDE_HOURS * 3600000} AS start,
         (slot - back) * {SLIDE_HOURS * 3600000} + {SIZE_HOURS * 3600000} > coalesce(mark, 0) AS counted
  FROM arrival JOIN marks USING (lot), range({SIZE_HOURS // SLIDE_HOURS}) r(back))
SELECT strftime(make_timestamp(start * 1000), '%Y-%m-%d %H:%M:%S') AS window_start, event_type,
       count(*) FILTER (counted) AS n, round(sum(value) FILTER (counted), 4) AS total, count(*) FILTER (NOT counted) AS late
FROM placed GROUP BY start, event_type""",
)
def windowed_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding windows of a stream that restarts twice; a seventh of the rows comes late, and what came too late is counted."""
    events = timed_events(spark, sf_dir)
    size, slide = f"{SIZE_HOURS} hours", f"{SLIDE_HOURS} hours"

    def step(rows: DataFrame) -> DataFrame:
        return windows.windowed(rows, "ts", size, slide, ["event_type"], "value", f"{DELAY_HOURS} hours")

    counted = _stream_lots(spark, events, step, 3, "windows")
    arrived = windows.windowed(events, "ts", size, slide, ["event_type"])
    found = windows.late_rows(arrived, counted.drop("window_end"), ["window_start", "event_type"])
    return found.select(_text("window_start"), "event_type", "n", F.round("total", 4).alias("total"), "late")


@query(
    "A2",
    """SELECT strftime(time_bucket(INTERVAL 6 HOURS, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type,
       count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""",
)
def tumbling_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same windows over the table, without overlap and without late rows."""
    found = windows.windowed(timed_events(spark, sf_dir), "ts", f"{SIZE_HOURS} hours", by=["event_type"], value="value")
    return found.select(_text("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


_SQL_SESSIONS = f"""WITH marked AS (
  SELECT *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) > {GAP_SECONDS * windows.MICROS}, true)::INT AS opens
  FROM events),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM marked)
SELECT user_id, epoch_us(min(ts)) AS session_start, epoch_us(max(ts)) AS session_end, count(*) AS n, round(sum(value), 4) AS total
FROM numbered GROUP BY user_id, session"""


def _plain_sessions(found: DataFrame) -> DataFrame:
    times = [F.unix_micros(c).alias(c) for c in ("session_start", "session_end")]
    return found.select("user_id", *times, "n", F.round("total", 4).alias("total"))


@query("A2", _SQL_SESSIONS)
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain_sessions(windows.sessions(timed_events(spark, sf_dir), "user_id", "ts", GAP_SECONDS, "value"))


@query("A2 S11", _SQL_SESSIONS)
def streamed_user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a stream in two lots: many a session is open when the first ends."""
    events = timed_events(spark, sf_dir).withColumn("lot", F.floor((F.dayofmonth("ts") - 1) / 16))
    step = lambda rows: windows.streamed_sessions(rows, "user_id", "ts", GAP_SECONDS, "value")
    return _plain_sessions(_stream_lots(spark, events, step, 2, "sessions"))


_CONFIG = "[2, 4, 8][event_id % 3 + 1] AS num_workers, [4, 8, 16][(event_id // 3) % 3 + 1] AS batch_size"


@query(
    "A9",
    f"""WITH runs AS (SELECT event_id, ts, event_type, value, {_CONFIG} FROM events)
SELECT r.event_id AS run_no, b.event_id AS base_run, CASE WHEN r.value > 0 THEN round(b.value / r.value, 6) END AS speedup
FROM runs r ASOF LEFT JOIN (FROM runs WHERE event_type = '{host.BASELINE}') b
  ON r.num_workers = b.num_workers AND r.batch_size = b.batch_size AND r.ts >= b.ts""",
)
def speedup_over_latest_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run against the latest baseline run of its configuration: nine configurations hold all runs."""
    log = host.run_log(spark, sf_dir).select("run_no", "framework", "total_time", "num_workers", "batch_size")
    times = host.table(spark, sf_dir, "events").select(F.col("event_id").alias("run_no"), "ts")
    runs = log.join(times, "run_no")
    base = runs.where(F.col("framework") == host.BASELINE).withColumnsRenamed({"run_no": "base_run", "total_time": "base_time"})
    found = temporal.as_of_join(runs, base, ["num_workers", "batch_size"], "ts", ["base_run", "base_time"], ["base_run"])
    speedup = F.when(F.col("total_time") > 0, F.round(F.col("base_time") / F.col("total_time"), 6)).alias("speedup")
    return found.select("run_no", "base_run", speedup)


@query(
    "A14",
    """WITH tier AS (
  SELECT n_nationkey AS tier, CASE WHEN n_nationkey % 6 <> 1 THEN n_nationkey * 8.0::DOUBLE END AS above,
         CASE WHEN n_nationkey % 5 <> 2 THEN n_nationkey * 8.0::DOUBLE + 2.0::DOUBLE ** (n_regionkey * 2) END AS below FROM nation)
SELECT tier, count(*) AS runs, round(sum(value), 4) AS total FROM events
JOIN tier ON (above IS NULL OR value >= above) AND (below IS NULL OR value < below) GROUP BY tier""",
)
def tier_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers as a table: ranges of many lengths, overlapping and open at either end."""
    key, power = F.col("n_nationkey"), F.pow(F.lit(2.0), F.col("n_regionkey") * 2)
    tiers = host.table(spark, sf_dir, "nation").select(
        key.alias("tier"), F.when(key % 6 != 1, key * 8.0).alias("above"), F.when(key % 5 != 2, key * 8.0 + power).alias("below")
    )
    runs = host.table(spark, sf_dir, "events").select("event_id", "value")
    found = temporal.range_join(runs, tiers, ("value", "value"), ("above", "below"))
    return found.groupBy("tier").agg(F.count(F.lit(1)).alias("runs"), F.round(F.sum("value"), 4).alias("total"))


@query(
    "A14",
    """WITH ship AS (
  SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS line, l_shipdate::DATE AS sent, l_shipdate::DATE + (1 + l_quantity::INT) AS due FROM lineitem)
SELECT a.l_suppkey, count(*) AS pairs, sum(a.line) AS lines FROM ship a
JOIN ship b ON a.l_suppkey = b.l_suppkey AND a.sent < b.due AND b.sent < a.due AND a.line < b.line GROUP BY a.l_suppkey""",
)
def overlapping_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a supplier's shipments that are under way at the same time."""
    lines = host.table(spark, sf_dir, "lineitem").select(
        "l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), F.col("l_shipdate").cast("date").alias("sent"),
        F.date_add("l_shipdate", (1 + F.col("l_quantity").cast("int"))).alias("due"),
    )
    others = lines.withColumnsRenamed({"line": "other", "sent": "other_sent", "due": "other_due"})
    found = temporal.range_join(lines, others, ("sent", "due"), ("other_sent", "other_due"), ["l_suppkey"])
    pairs = found.where("line < other").groupBy("l_suppkey")
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), F.sum("line").alias("lines"))


# Nine runs in ten are of one framework.
_SQL_MAIN = "CASE WHEN event_id % 10 = 0 THEN event_type ELSE 'main' END"


def _by_framework(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = host.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    framework = F.when(F.col("event_id") % 10 == 0, F.col("event_type")).otherwise("main")
    return log.select("event_id", framework.alias("framework"), F.unix_micros("ts").alias("at"), F.col("value").alias("total_time"))


@query(
    "A2",
    f"""WITH r AS (SELECT event_id, {_SQL_MAIN} AS framework, epoch_us(ts) AS us, value FROM events)
SELECT event_id, framework, row_number() OVER w AS run_no, round(sum(value) OVER w, 4) AS time_so_far,
       min(value) OVER w AS best_so_far, max(value) OVER w AS worst_so_far
FROM r WINDOW w AS (PARTITION BY framework ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)""",
)
def running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = temporal.running(
        _by_framework(spark, sf_dir), ["framework"], ["at", "event_id"], ["total_time"], ["total_time"], ["total_time"]
    )
    return found.select(
        "event_id", "framework", "run_no", F.round("sum_total_time", 4).alias("time_so_far"),
        F.col("min_total_time").alias("best_so_far"), F.col("max_total_time").alias("worst_so_far"),
    )


@query(
    "A6",
    f"""WITH r AS (SELECT event_id, {_SQL_MAIN} AS framework, epoch_us(ts) AS us, value FROM events)
SELECT event_id, count(*) OVER w AS rows_in_frame, round(sum(value) OVER w, 2) AS time_in_frame
FROM r WINDOW w AS (PARTITION BY framework ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)""",
)
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the day before each run, and their mean, told as the time that they took: a mean can end in a five, where rounding differs."""
    found = temporal.moving_average(_by_framework(spark, sf_dir), ["framework"], "at", "total_time", 86_400 * windows.MICROS)
    return found.select(
        "event_id", "rows_in_frame", F.round(F.col("moving_average") * F.col("rows_in_frame"), 2).alias("time_in_frame")
    )


@query(
    "A4",
    f"""WITH r AS (SELECT event_id, {_SQL_MAIN} AS framework, floor(value) AS seconds FROM events)
SELECT event_id, framework, rank() OVER (PARTITION BY framework ORDER BY seconds) AS rank FROM r""",
)
def ranks_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each run in its framework by whole seconds, which many share."""
    runs = _by_framework(spark, sf_dir).withColumn("seconds", F.floor("total_time"))
    return temporal.ranked(runs, ["framework"], "seconds").select("event_id", "framework", "rank")
