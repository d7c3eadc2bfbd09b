"""Token ids as ORC files in document order, to be read by stripe, range or document.

Ids are an ``array<int>`` column, which ORC writes with integer run-length encoding. Row
indexes hold the least and greatest doc_id of every ``INDEX_ROWS`` rows, and a Bloom filter
of them, so a reader that asks for some documents skips stripes and row groups by their metadata;
a reader of everything gets a task per group of stripes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cliploom.llm.common import kept
from cliploom.llm.tokens import encoded, word_encoder
from cliploom.operators.sizing import broadcast_if_small

END_ID = 2
INDEX_ROWS = 1_000
STRIPE_BYTES = 16 << 20
SLICE_BYTES = 4 << 20  # of text encoded at a time
FILES = "part int, doc_id bigint, start_in_part bigint, n_tokens bigint, ids array<int>"


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID) -> None:
    """Encode each text, append the end id, and write the documents in ascending doc_id order.

    A null or empty text is the end id alone. Null ids come first; repeated ids keep the order of
    the input. Rows are dealt out by range of (doc_id, place in the input), so even copies of
    one id spread. Part k holds lower keys than part k + 1, one file each. Other columns are ignored.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, start = word_encoder(vocabulary), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for batch, (ids, at) in encoded(batches, "text", lambda texts: encoder.encode_column(texts, end), SLICE_BYTES):
            columns = [
                pa.array(np.full(batch.num_rows, part, np.int32)),
                batch.column("doc_id"),
                pa.array(start + at[:-1]),
                pa.array(np.diff(at)),
                pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.view("<i4"))),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in FILES.split(", ")])
            start += int(at[-1])

    place = F.monotonically_increasing_id().alias("place")
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), place)
    ordered = rows.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place")
    writer = ordered.select("doc_id", "text").mapInArrow(encode, FILES).write.option("compression", "lz4")
    writer = writer.option("orc.stripe.size", STRIPE_BYTES).option("orc.row.index.stride", INDEX_ROWS)
    writer.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", 0.01).orc(folder)


def read(
    spark: SparkSession, folder: str, ids: Sequence[int] | None = None, between: tuple[int, int] | None = None
) -> DataFrame:
    """Documents of the files: all, those with the given ids, or those in an inclusive range.

    The condition is pushed down to the metadata of stripes and row groups.
    """
    files = spark.read.schema(FILES).orc(folder)
    if ids is not None:
        files = files.where(F.col("doc_id").isin(*map(int, ids)))
    if between is not None:
        files = files.where(F.col("doc_id").between(*between))
    return files


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: ids of all documents before it, number of ids, and their CRC-32.

    Tokens before a part come from one total per part, summed over the parts before it.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            at = ids.offsets.to_numpy().astype(np.int64)
            raw = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)).cast("B")
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            columns = [*map(batch.column, ("part", "doc_id", "start_in_part", "n_tokens")), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "start_in_part", "n_tokens", "ids_crc32"])

    files = read(spark, folder)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row per file
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    checked = files.mapInArrow(
        check, "part int, doc_id bigint, start_in_part bigint, n_tokens bigint, ids_crc32 bigint"
    )
    return checked.join(broadcast_if_small(kept(before, "parts")), "part").select(
        "doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32"
    )
