"""Settings of runs as JSON: parsed once, known paths as columns, all keys as aggregates; malformed rows are flagged."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ABSENT, MALFORMED, OTHER, OBJECT = "absent", "malformed", "other", "object"


def shredded(rows: DataFrame, column: str, paths: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Add ``json_state`` and a column per (path, type): ``{"workers": ("$.run.workers", "int")}``.

    A state is ``absent`` (null), ``malformed``, ``other`` (JSON, but no object) or ``object``. A path that a row lacks, or whose value is not of the
    type, is null. The text is parsed once per row, as a variant.
    """
    parsed = rows.withColumn("__json", F.try_parse_json(column))
    kind = F.schema_of_variant("__json")
    state = (
        F.when(F.col(column).isNull(), ABSENT).when(F.col("__json").isNull(), MALFORMED)
        .when(F.startswith(kind, F.lit("OBJECT")), OBJECT).otherwise(OTHER)
    )
    found = {name: F.try_variant_get("__json", path, kind) for name, (path, kind) in paths.items()}
    return parsed.withColumns({"json_state": state, **found}).drop("__json")


def per_key(rows: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """(by, key, n, n_numbers, total): top-level keys of the objects of each group, and the sum of their numeric values.

    Keys are rows, so a group may have any number of them; malformed rows have none.
    """
    pairs = rows.select(*by, F.explode(F.from_json(column, "map<string,string>")).alias("key", "value"))
    number = F.col("value").try_cast("double")
    return pairs.groupBy(*by, "key").agg(
        F.count(F.lit(1)).alias("n"), F.count(number).alias("n_numbers"), F.sum(number).alias("total")
    )
