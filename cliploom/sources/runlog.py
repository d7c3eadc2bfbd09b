"""The run log as CSV: header line, no index column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cliploom import schemas


def write_csv(runs: DataFrame, path: str) -> str:
    runs.write.mode("overwrite").option("header", True).csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: str = schemas.RUNS) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)
