"""Queries for run-log analytics (A*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.operators import batches, clips, runs
from cliploom.plans import hosting as host
from cliploom.plans.registry import query

N = host.N_FRAMES
RUNS = f"WITH {host.SQL_RUNS}"


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(
    "A1",
    """SELECT count(DISTINCT label) AS total_videos, 16 AS frames_per_video, 224 AS target_height,
       224 AS target_width, count(DISTINCT label) * 16 AS total_frames FROM embeddings""",
)
def dataset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clips.dataset_stats(host.clip_lengths(spark, sf_dir), N, 224, 224)


@query(
    "A2",
    f"""{RUNS} SELECT framework, sum(samples_processed)::BIGINT AS samples_processed,
       round(sum(total_time), 6) AS total_time,
       round(CASE WHEN sum(total_time) > 0 THEN sum(samples_processed) / sum(total_time) ELSE 0 END, 6)
         AS samples_per_second
FROM runs GROUP BY framework""",
)
def throughput_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(runs.summary(host.run_log(spark, sf_dir), "framework"), "total_time", "samples_per_second")


@query(
    "A3",
    "SELECT count(*) AS samples, ceil(count(*) / 16.0)::BIGINT AS batch_count,"
    " round(count(*) / ceil(count(*) / 16.0::DOUBLE), 6) AS avg_batch_size FROM events",
)
def batch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = host.table(spark, sf_dir, "events").select("event_id")
    return _rounded(batches.batch_stats(batches.assign(events, ["event_id"], 16, unique=True)), "avg_batch_size")


@query(
    "A4",
    f"""{RUNS}
SELECT 'total_time' AS metric, name, run_no, round(total_time, 6) AS value
  FROM (SELECT * FROM runs WHERE success AND total_time IS NOT NULL ORDER BY total_time, run_no LIMIT 1) a
UNION ALL SELECT 'samples_per_second', name, run_no, round(samples_per_second, 6)
  FROM (SELECT * FROM runs WHERE success AND samples_per_second IS NOT NULL ORDER BY samples_per_second DESC, run_no LIMIT 1) b
UNION ALL SELECT 'memory_usage_mb', name, run_no, round(memory_usage_mb, 6)
  FROM (SELECT * FROM runs WHERE success AND memory_usage_mb IS NOT NULL ORDER BY memory_usage_mb, run_no LIMIT 1) c""",
)
def winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(runs.winners(host.run_log(spark, sf_dir)), "value")


@query(
    "A5",
    f"""{RUNS} SELECT string_split(name, ' ')[1] AS framework, run_no, num_workers, batch_size,
       row_number() OVER (PARTITION BY string_split(name, ' ')[1] ORDER BY run_no) - 1 AS position FROM runs""",
)
def runs_by_framework(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = host.run_log(spark, sf_dir).select("name", "run_no", "num_workers", "batch_size")
    return runs.by_framework(log).select("framework", "run_no", "num_workers", "batch_size", "position")


@query(
    "A6",
    f"""{RUNS} SELECT method, round(avg(total_time), 6) AS avg_time, round(stddev_pop(total_time), 6) AS std_time,
       round(16 / avg(total_time), 6) AS fps FROM runs GROUP BY method""",
)
def repetition_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(runs.repetition_stats(host.run_log(spark, sf_dir), "method", N), "avg_time", "std_time", "fps")


@query(
    "A7",
    f"""{RUNS} SELECT method, round(avg(16.0::DOUBLE / total_time), 6) AS avg_fps
FROM runs WHERE success AND total_time > 0 GROUP BY method""",
)
def method_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(runs.method_average(host.run_log(spark, sf_dir), N), "avg_fps")


@query(
    "A8",
    f"""{RUNS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY total_time, run_no) AS rn
                FROM runs WHERE success AND total_time IS NOT NULL)
SELECT memory_usage_mb AS clip, method, round(total_time, 6) AS total_time, run_no FROM ranked WHERE rn = 1""",
)
def best_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = host.run_log(spark, sf_dir).withColumnRenamed("memory_usage_mb", "clip")
    return _rounded(runs.best_method(log, "clip"), "total_time")


_SQL_TOTALS = f"""{RUNS}, totals AS (
  SELECT method, count(*) AS runs, sum(total_time) AS total_time, sum(total_time) / count(*) AS avg_time_per_run,
         count(*) * 16 AS total_frames, count(*) * 16 / sum(total_time) AS avg_fps FROM runs GROUP BY method)"""


@query(
    "A9",
    f"""{_SQL_TOTALS} SELECT t.method, round(t.avg_fps, 6) AS avg_fps, round(t.avg_fps / b.avg_fps, 6) AS speedup
FROM totals t, totals b WHERE b.method = 'view'""",
)
def speedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = runs.against_baseline(runs.totals(host.run_log(spark, sf_dir), ["method"], N), host.BASELINE)
    return _rounded(compared.select("method", "avg_fps", "speedup"), "avg_fps", "speedup")


@query(
    "A10",
    f"""{RUNS}, totals AS (
  SELECT method, num_workers, batch_size, sum(total_time) AS total_time FROM runs GROUP BY ALL)
SELECT t.method, t.num_workers, t.batch_size,
       round((b.total_time - t.total_time) / b.total_time * 100, 6) AS time_reduction_pct
FROM totals t JOIN totals b USING (num_workers, batch_size) WHERE b.method = 'view'""",
)
def time_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = ["num_workers", "batch_size"]
    sums = runs.totals(host.run_log(spark, sf_dir), ["method", *config], N)
    compared = runs.against_baseline(sums, host.BASELINE, per=config)
    return _rounded(compared.select("method", *config, "time_reduction_pct"), "time_reduction_pct")


_SQL_GRID = """grid AS (
  SELECT * FROM (VALUES (2), (4), (8)) w(num_workers), (VALUES (4), (8), (16)) b(batch_size),
                (VALUES ('view'), ('click'), ('signup'), ('purchase'), ('error')) m(method))"""
_SQL_DONE = """done AS (SELECT num_workers, batch_size, method, count(*) AS runs, avg(total_time) AS avg_time
                FROM runs GROUP BY ALL)"""
_GRID_KEYS = ["num_workers", "batch_size", "method"]


def _grid(spark: SparkSession) -> DataFrame:
    return runs.grid(spark, num_workers=[2, 4, 8], batch_size=[4, 8, 16], method=host.METHODS)


@query(
    "A11",
    f"""{RUNS}, {_SQL_GRID}, {_SQL_DONE}
SELECT num_workers, batch_size, method, coalesce(runs, 0) AS runs, round(avg_time, 6) AS avg_time
FROM grid LEFT JOIN done USING (num_workers, batch_size, method)""",
)
def parameter_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(runs.grid_results(_grid(spark), host.run_log(spark, sf_dir), _GRID_KEYS), "avg_time")


@query(
    "A12",
    """WITH cells AS (SELECT user_id, method FROM (SELECT DISTINCT user_id FROM events) u,
  (VALUES ('view'), ('click'), ('signup'), ('purchase'), ('error')) m(method))
SELECT c.user_id, c.method, count(e.event_id) AS runs, round(avg(e.value), 6) AS avg_time
FROM cells c LEFT JOIN events e ON e.user_id = c.user_id AND e.event_type = c.method GROUP BY ALL""",
)
def method_clip_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = host.table(spark, sf_dir, "events").select(
        "user_id", F.col("event_type").alias("method"), F.col("value").alias("total_time")
    )
    return _rounded(runs.method_results(log, "user_id", host.METHODS), "avg_time")


@query(
    "A13",
    f"""{RUNS}, {_SQL_GRID}, {_SQL_DONE}
SELECT num_workers, batch_size, method, coalesce(runs, 0) AS runs, round(avg_time, 6) AS avg_time
FROM grid LEFT JOIN done USING (num_workers, batch_size, method) WHERE num_workers <= 4""",
)
def feasible_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = runs.feasible(_grid(spark), limit=4)
    return _rounded(runs.grid_results(cells, host.run_log(spark, sf_dir), _GRID_KEYS), "avg_time")


@query(
    "A14",
    """SELECT p_partkey, p_size,
  CASE WHEN p_size >= 16 THEN 'large' WHEN p_size >= 8 THEN 'medium' WHEN p_size >= 4 THEN 'small' ELSE 'minimal' END AS tier,
  CASE WHEN p_size >= 16 THEN 8 WHEN p_size >= 8 THEN 6 WHEN p_size >= 4 THEN 4 ELSE 2 END AS loader_workers,
  CASE WHEN p_size >= 16 THEN 12 WHEN p_size >= 8 THEN 8 WHEN p_size >= 4 THEN 4 ELSE 2 END AS task_workers,
  CASE WHEN p_size >= 16 THEN 8 WHEN p_size >= 8 THEN 6 WHEN p_size >= 4 THEN 4 ELSE 2 END AS map_processes,
  CASE WHEN p_size >= 16 THEN '8,16,32' WHEN p_size >= 8 THEN '4,8,16' WHEN p_size >= 4 THEN '4,8' ELSE '2,4' END AS batch_sizes,
  CASE WHEN p_size >= 16 THEN 16 WHEN p_size >= 8 THEN 12 WHEN p_size >= 4 THEN 8 ELSE 4 END AS map_batch,
  CASE WHEN p_size >= 8 THEN 2 ELSE 1 END AS cpus_per_task,
  CASE WHEN p_size >= 16 THEN 8 WHEN p_size >= 8 THEN 6 WHEN p_size >= 4 THEN 4 ELSE 2 END AS concurrency
FROM part""",
)
def settings_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = host.table(spark, sf_dir, "part").select("p_partkey", "p_size")
    settings = parts.select("p_partkey", "p_size", F.inline(F.array(runs.tier(F.col("p_size")))))
    return settings.withColumn("batch_sizes", F.array_join("batch_sizes", ","))


@query(
    "A15",
    """SELECT p_partkey, least(p_size, CASE WHEN p_size >= 16 THEN 8 WHEN p_size >= 8 THEN 6
       WHEN p_size >= 4 THEN 4 ELSE 2 END) AS concurrency FROM part""",
)
def clamped_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = host.table(spark, sf_dir, "part").select("p_partkey", "p_size")
    limit = runs.tier(F.col("p_size")).concurrency
    return parts.select("p_partkey", runs.clamp(F.col("p_size"), limit).alias("concurrency"))


@query(
    "A16",
    """WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn
           FROM events) SELECT event_type AS method, event_id AS run_no FROM r WHERE rn > 1""",
)
def warmup_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = host.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("method"), "ts", F.col("event_id").alias("run_no")
    )
    return runs.drop_warmup(log, ["ts", "run_no"]).select("method", "run_no")


@query(
    "A17",
    f"""{_SQL_TOTALS} SELECT method, runs, round(total_time, 6) AS total_time,
       round(avg_time_per_run, 6) AS avg_time_per_run, total_frames, round(avg_fps, 6) AS avg_fps FROM totals""",
)
def method_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = runs.totals(host.run_log(spark, sf_dir), ["method"], N)
    return _rounded(sums, "total_time", "avg_time_per_run", "avg_fps")


@query(
    "A18",
    f"""{RUNS} SELECT method, count(*) AS row_calls, ceil(count(*) / 4.0)::BIGINT AS batch_calls,
       round(sum(total_time) / count(*), 6) AS time_per_row_call,
       round(sum(total_time) / ceil(count(*) / 4.0::DOUBLE), 6) AS time_per_batch_call
FROM runs GROUP BY method""",
)
def call_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = runs.call_counts(host.run_log(spark, sf_dir), "method", 4).drop("total_time")
    return _rounded(counted, "time_per_row_call", "time_per_batch_call")


@query(
    "A19",
    f"""{RUNS} SELECT framework, 'all' AS scope, NULL::INTEGER AS num_workers,
       sum(samples_processed)::BIGINT AS samples_processed, round(sum(total_time), 6) AS total_time
FROM runs GROUP BY framework
UNION ALL SELECT framework, 'workers', num_workers, sum(samples_processed)::BIGINT, round(sum(total_time), 6)
FROM runs GROUP BY framework, num_workers""",
)
def combined_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = host.run_log(spark, sf_dir)
    overall = runs.summary(log, "framework").withColumn("scope", F.lit("all"))
    by_workers = runs.summary(log, "framework", "num_workers").withColumn("scope", F.lit("workers"))
    both = runs.combine(overall, by_workers)
    return _rounded(both, "total_time").select(
        "framework", "scope", "num_workers", "samples_processed", "total_time"
    )
