"""Dense row numbers without gathering rows in one task."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliploom.operators.sizing import broadcast_if_small
from cliploom.session import shared_dir

# monotonically_increasing_id keeps the partition above bit 33 and the position
# inside the partition below it.
_POSITION_BITS = 33
_SLOT, _PART, _POS, _SHIFT = "__slot", "__part", "__pos", "__shift"
_TIE = "__tie"
_OF = "__of_"  # prefix of the key columns on the shift side


def dense_index(
    df: DataFrame, order: Sequence[str | Column], by: Sequence[str] = (), name: str = "idx", unique: bool = False
) -> DataFrame:
    """Add ``name``: 0, 1, 2, … in the given order, restarting for each ``by`` group.

    The rows are range-sorted on (by, order), so a group or a leading key that
    holds a third of the table spreads over many partitions. The sorted rows are
    checkpointed: their partitions no longer change, and each row's position in
    its partition plus the rows of the group in earlier partitions is its index.
    Pass narrow rows (keys and ids) and join wide columns afterwards.

    Rows that tie fall in any order. As equal sort keys cannot be split, copies get a
    tie-breaker: their place in a first checkpoint, where it is the same for every reader.
    Say ``unique`` when (by, order) has no repeats, such as an id, to leave that out.
    """
    shared_dir(df.sparkSession)
    keys = [*by, *order]
    rows = df
    if not unique:
        rows = df.checkpoint().withColumn(_TIE, F.monotonically_increasing_id())
        keys.append(_TIE)
    slots = (
        rows.orderBy(*keys)
        .drop(_TIE)
        .checkpoint()
        .withColumn(_SLOT, F.monotonically_increasing_id())
        .withColumn(_PART, F.shiftright(_SLOT, _POSITION_BITS).cast("int"))
        .withColumn(_POS, F.col(_SLOT).bitwiseAND((1 << _POSITION_BITS) - 1))
    )
    if by:
        shifts = _group_shifts(slots, by)
        same_group = [F.col(c).eqNullSafe(F.col(_OF + c)) for c in (_PART, *by)]
        slots, shift = slots.join(shifts, same_group), F.col(_SHIFT)
    else:
        shift = F.get(_rows_before(slots), F.col(_PART))
    return slots.select(*df.columns, (F.col(_POS) + shift).alias(name))


def _rows_before(slots: DataFrame) -> Column:
    """Rows in earlier partitions, as a constant array: one number per partition."""
    counts = {part: n for part, n in slots.groupBy(_PART).count().collect()}
    before = accumulate((counts.get(part, 0) for part in range(max(counts, default=0))), initial=0)
    return F.split(F.lit(",".join(map(str, before))), ",").cast("array<bigint>")


def _group_shifts(slots: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per (partition, group): rows of the group in earlier partitions minus its first position.

    The window sees one row per partition a group touches, not the group's rows.
    """
    earlier = Window.partitionBy(*by).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    runs = slots.groupBy(_PART, *by).agg(F.count(F.lit(1)).alias("__n"), F.min(_POS).alias("__first"))
    shift = F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")
    shifts = runs.select(*[F.col(c).alias(_OF + c) for c in (_PART, *by)], shift.alias(_SHIFT)).checkpoint()
    return broadcast_if_small(shifts)
