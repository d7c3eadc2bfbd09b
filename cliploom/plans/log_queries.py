"""Queries on the run log as a whole: cubes, sketches, differences of listings, settings in JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.operators import runs, settings, sketches
from cliploom.plans import hosting as host
from cliploom.plans.registry import query
from cliploom.session import scratch_path
from cliploom.sources import changes, dataset

DIMS = ("framework", "num_workers", "batch_size")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = host.run_log(spark, sf_dir)
    return log.select(*DIMS, "total_time", F.col("memory_usage_mb").cast("bigint").alias("user"), F.floor("total_time").alias("seconds"))


@query(
    "A11 A2",
    f"""WITH {host.SQL_RUNS}
SELECT framework, num_workers, batch_size, grouping_id(framework, num_workers, batch_size)::BIGINT AS grouping_id, count(*) AS n,
       round(sum(total_time), 4) AS sum_total_time, count(DISTINCT user_id) AS distinct_user, count(DISTINCT floor(total_time)) AS distinct_seconds
FROM runs GROUP BY CUBE (framework, num_workers, batch_size)""",
)
def runs_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.cube(_log(spark, sf_dir), DIMS, ["total_time"], ["user", "seconds"])
    return found.withColumn("sum_total_time", F.round("sum_total_time", 4))


@query(
    "A11 A2",
    f"""WITH {host.SQL_RUNS}
SELECT framework, num_workers, batch_size, grouping_id(framework, num_workers, batch_size)::BIGINT AS grouping_id, count(*) AS n,
       count(DISTINCT user_id) AS distinct_user
FROM runs GROUP BY ROLLUP (framework, num_workers, batch_size)""",
)
def runs_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.cube(_log(spark, sf_dir), DIMS, distinct=["user"], sets=runs.rollup_sets(DIMS))


_RANKS = (0.1, 0.5, 0.9)


@query(
    "A2 A6",
    """WITH exact AS (SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ROLLUP (event_type))
SELECT event_type, n, users, true AS distinct_close, true AS ranks_close, true AS merge_close FROM exact""",
)
def merged_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily sketches per event type, stored, then merged per type and over all: as close to the exact answers as documented."""
    events = host.table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("day"), "user_id", "value")
    daily = sketches.sketched(events, ["event_type", "day"], "user_id", "value")
    stored = dataset.load(spark, dataset.save(daily, scratch_path(spark, "sketches")), daily.schema)
    by_type, all_types = sketches.merged(stored, ["event_type"]), sketches.merged(stored)
    both = by_type.unionByName(all_types.withColumn("event_type", F.lit(None).cast("string")))
    said = sketches.answers(both, _RANKS)
    whole = sketches.merged(sketches.sketched(events, ["event_type"], "user_id", "value"), ["event_type"])
    alone = sketches.answers(whole).select(F.col("event_type").alias("of"), F.col("distinct").alias("alone"))
    exact = runs.cube(events, ["event_type"], distinct=["user_id"])
    ranked = _ranks_of(events, said)
    found = said.join(exact.select(F.col("event_type").alias("x"), "distinct_user_id"), F.col("event_type").eqNullSafe(F.col("x")))
    found = found.join(ranked, F.col("event_type").eqNullSafe(F.col("type"))).join(alone, F.col("event_type") == F.col("of"), "left")
    allowed = sketches.DISTINCT_ERROR * F.col("distinct_user_id")
    close = F.abs(F.col("distinct") - F.col("distinct_user_id")) <= allowed
    return found.select(
        "event_type", "n", F.col("distinct_user_id").alias("users"), close.alias("distinct_close"), "ranks_close",
        F.coalesce(F.abs(F.col("alone") - F.col("distinct")) <= allowed, F.lit(True)).alias("merge_close"),
    )


def _ranks_of(events: DataFrame, said: DataFrame) -> DataFrame:
    """Whether the share of values below, and up to, each quantile encloses its rank, but for the error."""
    each = events.select("event_type", "value").unionByName(events.select(F.lit(None).cast("string").alias("event_type"), "value"))
    told = F.broadcast(said.select(F.col("event_type").alias("type"), "quantiles"))  # a row per type
    both = each.join(told, F.col("event_type").eqNullSafe(F.col("type")))
    shares = []
    for i, rank in enumerate(_RANKS):
        at = F.get("quantiles", F.lit(i))
        below, upto = F.avg((F.col("value") < at).cast("int")), F.avg((F.col("value") <= at).cast("int"))
        shares.append((below <= rank + sketches.RANK_ERROR) & (upto >= rank - sketches.RANK_ERROR))
    close = shares[0] & shares[1] & shares[2]
    return both.groupBy("type").agg(close.alias("ranks_close"))


# The listing before: paths repeat, as pages of one path differ in their query only. After: some are gone, doubled or moved.
_SQL_LISTINGS = """page AS (SELECT page_id, string_split(string_split(url, '#')[1], '?')[1] AS path, strlen(html) % 50 AS size FROM pages),
old AS (SELECT CASE WHEN page_id % 5 = 0 THEN 'shared' ELSE path END AS path, size FROM page),
new AS (
  SELECT CASE WHEN page_id % 5 = 0 THEN 'shared' WHEN page_id % 11 = 1 THEN path || '.moved' ELSE path END AS path,
         CASE WHEN page_id % 13 = 2 THEN size + 1 ELSE size END AS size FROM page WHERE page_id % 7 <> 3)"""


def _listings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    page = F.col("page_id")
    path = F.substring_index(F.substring_index("url", "#", 1), "?", 1)
    pages = host.table(spark, sf_dir, "pages").select(page, path.alias("path"), (F.octet_length("html") % 50).alias("size"))
    old = pages.select(F.when(page % 5 == 0, "shared").otherwise(F.col("path")).alias("path"), "size")
    moved = F.when(page % 5 == 0, "shared").when(page % 11 == 1, F.concat("path", F.lit(".moved"))).otherwise(F.col("path"))
    size = F.when(page % 13 == 2, F.col("size") + 1).otherwise(F.col("size"))
    return old, pages.where(page % 7 != 3).select(moved.alias("path"), size.alias("size"))


@query(
    "S1 B9",
    f"""WITH {_SQL_LISTINGS}
SELECT 'gone' AS kind, path, size FROM (FROM old EXCEPT ALL FROM new) UNION ALL
SELECT 'added', path, size FROM (FROM new EXCEPT ALL FROM old) UNION ALL
SELECT 'kept', path, size FROM (FROM old INTERSECT ALL FROM new)""",
)
def listing_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _listings(spark, sf_dir)
    on = ["path", "size"]
    parts = {"gone": changes.minus(old, new, on), "added": changes.minus(new, old, on), "kept": changes.common(old, new, on)}
    rows = [changes.repeated(part).select(F.lit(kind).alias("kind"), *on) for kind, part in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(
    "S1 B9",
    f"""WITH {_SQL_LISTINGS},
was AS (SELECT path, string_agg(size, ',' ORDER BY size) AS states FROM old GROUP BY path),
now AS (SELECT path, string_agg(size, ',' ORDER BY size) AS states FROM new GROUP BY path),
lost AS (SELECT path, states, count(*) OVER (PARTITION BY states) AS n FROM was WHERE path NOT IN (SELECT path FROM now)),
came AS (SELECT path, states, count(*) OVER (PARTITION BY states) AS n FROM now WHERE path NOT IN (SELECT path FROM was)),
moved AS (SELECT l.path, c.path AS other FROM lost l JOIN came c ON l.states = c.states AND l.n = 1 AND c.n = 1)
SELECT path, CASE WHEN was.states = now.states THEN 'same' ELSE 'changed' END AS change, NULL AS other FROM was JOIN now USING (path)
UNION ALL SELECT path, 'renamed', other FROM moved
UNION ALL SELECT path, 'gone', NULL FROM lost WHERE path NOT IN (SELECT path FROM moved)
UNION ALL SELECT path, 'added', NULL FROM came WHERE path NOT IN (SELECT other FROM moved)""",
)
def listing_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.changes(*_listings(spark, sf_dir), "path", ["size"])


_SQL_PROPS = """texts AS (
  SELECT event_id, event_type, CASE WHEN event_id % 11 = 0 THEN left(props, length(props) - 1) WHEN event_id % 13 = 0 THEN NULL
    WHEN event_id % 17 = 0 THEN '[1, 2]' ELSE left(props, length(props) - 1) || ', "run": {"workers": ' || event_id % 8 || ', "name": "'
      || event_type || '"}, "user": "' || user_id || '"}' END AS props FROM events)"""


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run settings: nested objects, and some cut off, absent, or no object."""
    event = F.col("event_id")
    cut = F.expr("left(props, length(props) - 1)")
    nested = F.concat(
        cut, F.lit(', "run": {"workers": '), (event % 8).cast("string"), F.lit(', "name": "'), "event_type", F.lit('"}, "user": "'),
        F.col("user_id").cast("string"), F.lit('"}'),
    )
    text = F.when(event % 11 == 0, cut).when(event % 13 == 0, F.lit(None)).when(event % 17 == 0, "[1, 2]").otherwise(nested)
    return host.table(spark, sf_dir, "events").select("event_id", "event_type", text.alias("props"))


@query(
    "A5 B11",
    f"""WITH {_SQL_PROPS}
SELECT event_id, CASE WHEN props IS NULL THEN 'absent' WHEN NOT json_valid(props) THEN 'malformed'
                      WHEN json_type(props) = 'OBJECT' THEN 'object' ELSE 'other' END AS json_state,
       CASE WHEN json_valid(props) THEN json_extract(props, '$.k')::INT END AS k,
       CASE WHEN json_valid(props) THEN json_extract(props, '$.run.workers')::INT END AS workers,
       CASE WHEN json_valid(props) THEN json_extract_string(props, '$.run.name') END AS name,
       CASE WHEN json_valid(props) THEN try_cast(json_extract_string(props, '$.user') AS BIGINT) END AS user
FROM texts""",
)
def settings_shredded(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = {"k": ("$.k", "int"), "workers": ("$.run.workers", "int"), "name": ("$.run.name", "string"), "user": ("$.user", "bigint")}
    return settings.shredded(_texts(spark, sf_dir), "props", paths).drop("event_type", "props")


@query(
    "A5",
    f"""WITH {_SQL_PROPS},
objects AS (SELECT event_type, props FROM texts WHERE json_valid(props) AND json_type(props) = 'OBJECT'),
pairs AS (SELECT event_type, key, json_extract_string(props, '$.' || key) AS value FROM (SELECT *, unnest(json_keys(props)) AS key FROM objects))
SELECT event_type, key, count(*) AS n, count(try_cast(value AS DOUBLE)) AS n_numbers, sum(try_cast(value AS DOUBLE)) AS total
FROM pairs GROUP BY event_type, key""",
)
def settings_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settings.per_key(_texts(spark, sf_dir), ["event_type"], "props")
