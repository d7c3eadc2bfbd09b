"""What the operators share: tables, written intermediate results, renamed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cliploom.session import BYTES_PER_BATCH, ROWS_PER_BATCH, scratch_path, ship_package  # noqa: F401


def prepared(spark: SparkSession) -> SparkSession:
    """The session with this package on its executors and Arrow batches of bounded size, in rows and in bytes."""
    return ship_package(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame, tag: str) -> DataFrame:
    """The rows, computed once and written to the shared folder: later jobs read the files,
    and lost executors cost nothing but their running tasks."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


ROWS_PER_FILE = 200_000  # of narrow tables whose size is known


def kept_narrow(df: DataFrame, tag: str, rows: int) -> DataFrame:
    """The same for a narrow table of about ``rows`` rows: no more files than it takes."""
    return kept(df.coalesce(rows // ROWS_PER_FILE + 1), tag)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the table lacks; names differ in more than case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
