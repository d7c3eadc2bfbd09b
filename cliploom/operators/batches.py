"""Batch operators: row order, fixed-size batches, functions over batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliploom import schemas
from cliploom.functions import pixels
from cliploom.operators.index import dense_index


def assign(
    df: DataFrame, order: Sequence[str | Column], size: int, idx: str = "idx", unique: bool = False
) -> DataFrame:
    """Add a dense ``idx`` and ``batch_id = idx div size``. The last batch may be short.

    ``unique`` says that no two rows have the same order key.
    """
    return with_batch_id(dense_index(df, order, name=idx, unique=unique), size, idx)


def with_batch_id(df: DataFrame, size: int, idx: str = "idx") -> DataFrame:
    """Add ``batch_id`` to rows that have a dense index already."""
    return df.withColumn("batch_id", F.floor(F.col(idx) / size))


def shuffle(df: DataFrame, keys: Sequence[str], seed: int, idx: str = "idx", unique: bool = False) -> DataFrame:
    """Random order that the seed fixes: adds each row's position in it."""
    drawn = pixels.shuffle_key(seed, *[F.col(k) for k in keys])
    return dense_index(df, [drawn, *keys], name=idx, unique=unique)


def repartition(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """Spread rows over n tasks. Without keys rows go round-robin, so a hot key does not matter."""
    return df.repartition(n, *keys)


def map_rows(df: DataFrame, **columns: Column) -> DataFrame:
    """One value per row, as expressions: no Python call per row."""
    return df.withColumns(columns)


def map_function(df: DataFrame, fn: Callable[[dict], dict], schema: str) -> DataFrame:
    """Call a Python function on every row, as a dict. For functions that expressions cannot state.

    Rows cross to Python in Arrow batches; ``schema`` uses the types of ``schemas``.
    """
    layout = schemas.arrow(schema)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            yield pa.RecordBatch.from_pylist([fn(row) for row in batch.to_pylist()], layout)

    return df.mapInArrow(run, schema)


def rebatch(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Cut a stream of Arrow batches into batches of ``size`` rows; the last may be short."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        at = 0
        while batch.num_rows - at >= size - rows:
            take = size - rows
            yield _join([*held, batch.slice(at, take)])
            held, rows, at = [], 0, at + take
        if at < batch.num_rows:
            held.append(batch.slice(at))
            rows += batch.num_rows - at
    if held:
        yield _join(held)


def _join(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.concat_batches(parts)


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, size: int
) -> DataFrame:
    """Call ``fn`` on Arrow batches of ``size`` rows. Batches do not span partitions."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatch(stream, size):
            yield fn(batch)

    return df.mapInArrow(run, schema)


def collate(df: DataFrame, fields: Sequence[str], idx: str = "idx") -> DataFrame:
    """One row per batch; each field becomes a list in index order.

    A group holds one batch, so lists never exceed the batch size.
    """
    rows = F.array_sort(F.collect_list(F.struct(idx, *fields)))
    grouped = df.groupBy("batch_id").agg(rows.alias("rows"))
    return grouped.select(
        "batch_id", F.size("rows").alias("batch_size"), *[F.col(f"rows.{f}").alias(f"{f}s") for f in fields]
    )


def batch_mean(df: DataFrame, value: str) -> DataFrame:
    """Mean of a per-row value in each batch."""
    return df.groupBy("batch_id").agg(F.avg(value).alias("batch_mean"))


def batch_stats(df: DataFrame) -> DataFrame:
    """Samples, number of batches and mean batch size; 0 when there are no batches."""
    sizes = df.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("samples"), F.count(F.lit(1)).alias("batch_count"))
    return total.withColumn(
        "avg_batch_size",
        F.when(F.col("batch_count") > 0, F.col("samples") / F.col("batch_count")).otherwise(F.lit(0.0)),
    )


def progress(df: DataFrame, every: int, idx: str = "idx") -> DataFrame:
    """Samples done after every ``every``-th batch, read off the index: no running sum needed."""
    done = df.groupBy("batch_id").agg((F.max(idx) + 1).alias("samples_done"))
    return done.withColumn("batch_no", F.col("batch_id") + 1).where(F.col("batch_no") % every == 0)
