"""Broadcast only what was measured; beyond that, filter by a bitmap of bounded size."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A row of a hash table takes about this much besides its strings and what is nested.
_BYTES_PER_ROW = 64
_BYTES_PER_COLUMN = 16
_BYTES_PER_VALUE = 8  # nested: a value, or where a longer one lies, and the flags of a struct's nulls

_BITS_PER_KEY = 12
_MOST_BITS = 1 << 24  # 2 MB, whatever the number of keys
_MOST_EXACT_BITS = 1 << 27  # 16 MB


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Mark a table for broadcast when it is below the session's limit, else leave it to a shuffle.

    Measures the table, so pass one that is checkpointed.
    """
    return F.broadcast(df) if fits_broadcast(df) else df


def broadcast_or_merge(df: DataFrame) -> DataFrame:
    """The same, but beyond the limit neither this table nor the other side of its join is broadcast.

    Spark goes by the size of files. Those of arrays, or of texts that repeat, may be a tenth of the
    rows that the driver would hold.
    """
    return F.broadcast(df) if fits_broadcast(df) else df.hint("merge")


def fits_broadcast(df: DataFrame) -> bool:
    varying = [_varying_bytes(F.col(field.name), field.dataType) for field in df.schema]
    sums = [F.coalesce(F.sum(size), F.lit(0)) for size in varying if size is not None]
    rows, *lengths = df.agg(F.count(F.lit(1)), *sums).first()
    per_row = _BYTES_PER_ROW + sum(_BYTES_PER_COLUMN + _fixed_bytes(field.dataType) for field in df.schema)
    return rows * per_row + sum(lengths) <= broadcast_limit(df.sparkSession)


def _fixed_bytes(kind: T.DataType) -> int:
    """What each value takes besides its place in the row: the places of a struct's fields."""
    if not isinstance(kind, T.StructType):
        return 0
    return _BYTES_PER_VALUE + sum(_BYTES_PER_VALUE + _fixed_bytes(field.dataType) for field in kind)


def _varying_bytes(value: Column, kind: T.DataType) -> Column | None:
    """What a value takes beyond that, none for most kinds: the bytes of strings, the elements of arrays and maps."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.octet_length(value).cast("bigint")
    if isinstance(kind, T.StructType):
        sizes = [_varying_bytes(value.getField(field.name), field.dataType) for field in kind]
        sizes = [F.coalesce(size, F.lit(0)) for size in sizes if size is not None]
        return reduce(Column.__add__, sizes) if sizes else None
    if isinstance(kind, T.MapType):
        keys = _varying_bytes(F.map_keys(value), T.ArrayType(kind.keyType))
        return keys + _varying_bytes(F.map_values(value), T.ArrayType(kind.valueType))
    if isinstance(kind, T.ArrayType):
        size = F.array_size(value).cast("bigint") * (_BYTES_PER_VALUE + _fixed_bytes(kind.elementType))
        if _varying_bytes(F.lit(None), kind.elementType) is None:
            return size
        return F.aggregate(value, size, lambda total, x: total + F.coalesce(_varying_bytes(x, kind.elementType), F.lit(0)))
    return None


def broadcast_limit(spark: SparkSession) -> int:
    """``spark.sql.autoBroadcastJoinThreshold`` in bytes; it may be set as 64MB, 10m or -1."""
    return in_bytes(spark.conf.get("spark.sql.autoBroadcastJoinThreshold"))


def in_bytes(text: str) -> int:
    """A size as Spark's settings have it."""
    number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)(?:i?b)?", text.strip().lower()).groups()
    return int(number) << (10 * " kmgtp".index(unit or " "))


def may_be_in(keys: DataFrame, on: Sequence[str]) -> Column:
    """A condition on columns ``on`` that every row of ``keys`` meets, and most others do not.

    It tests a bit of a bitmap of hashes, which the driver gathers as at most 2 MB; a million
    keys let 6 % of other rows pass. Measures the table, so pass one that is checkpointed.
    """
    bits = min(_MOST_BITS, 1 << max(10, (keys.count() * _BITS_PER_KEY).bit_length()))
    place = F.pmod(F.xxhash64(*on), F.lit(bits))
    return _bit_is_set(keys, place, bits)


def members(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key is in the table of keys: a semi-join that does not shuffle wide rows where it can be helped.

    Few keys are broadcast. Many whole numbers that are dense, such as indices, are a bitmap with a bit each, exactly, up to
    16 MB on the driver, which is 134 million; rows are tested where they are read. Of other keys a bitmap of hashes is
    tested first, so only rows that probably stay are shuffled. Null keys match nothing. ``keys`` is checkpointed here.
    """
    keys = keys.select(on).where(F.col(on).isNotNull()).distinct().checkpoint()
    if fits_broadcast(keys):
        return rows.join(F.broadcast(keys), on, "left_semi").select(*rows.columns)
    if all(dict(df.dtypes)[on] in ("tinyint", "smallint", "int", "bigint") for df in (rows, keys)):
        low, high = keys.agg(F.min(on), F.max(on)).first()
        if low is None:
            return rows.where(F.lit(False))
        if low >= 0 and high < _MOST_EXACT_BITS:
            place = F.col(on).cast("bigint")
            inside = place.between(0, high)
            return rows.where(inside & _bit_is_set(keys, place, high + 1))
    return rows.where(may_be_in(keys, [on])).join(keys, on, "left_semi").select(*rows.columns)


def _bit_is_set(keys: DataFrame, place: Column, bits: int) -> Column:
    byte, bit = F.floor(place / 8), F.get(F.lit([1 << k for k in range(8)]), (place % 8).cast("int"))
    set_bits = keys.groupBy(byte.alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bitmap = np.zeros(-(-bits // 8), np.uint8)
    bitmap[set_bits.column("at").to_numpy()] = set_bits.column("bits").to_numpy()
    own = F.conv(F.hex(F.substring(F.lit(bitmap.tobytes()), (byte + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return own.bitwiseAND(bit) != 0
