"""As-of joins, running totals and moving averages along an order, and joins of rows to ranges.

What looks back along an order is computed in two levels, so that no task holds a key. The rows are range-sorted by (key, order), so a
key with most of the rows lies in many partitions. Windows run inside the pieces, a key's rows in one partition, and each
piece is reduced to one row; what the pieces before it come to is found among these, a row per partition that a key
touches, and added to the piece's rows. Sorted rows are checkpointed, which fixes the pieces.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliploom.operators.sizing import broadcast_if_small
from cliploom.session import shared_dir

_PIECE, _AT, _TIE = "__piece", "__at", "__tie"


class Pieces:
    """Rows sorted by (keys, order), with the number of their partition and their place in it."""

    def __init__(self, rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> None:
        shared_dir(rows.sparkSession)
        # Rows that tie on everything cannot be split by a range sort; their place in a first checkpoint tells them apart.
        placed = rows.checkpoint().withColumn(_TIE, F.monotonically_increasing_id())
        ordered = placed.orderBy(*keys, *order, _TIE).drop(_TIE).checkpoint()
        slot = F.monotonically_increasing_id()
        at = slot.bitwiseAND((1 << 33) - 1)
        self.rows = ordered.select("*", F.shiftright(slot, 33).cast("int").alias(_PIECE), at.alias(_AT))
        self.keys = list(keys)

    def inside(self) -> Window:
        """Rows of a piece up to the current one."""
        return Window.partitionBy(_PIECE, *self.keys).orderBy(_AT).rowsBetween(Window.unboundedPreceding, 0)

    def reduced(self, *aggregates: Column) -> DataFrame:
        return self.rows.groupBy(_PIECE, *self.keys).agg(*aggregates)

    def before(self) -> Window:
        """Pieces of a key before the current one, in the table of reduced pieces."""
        return Window.partitionBy(*self.keys).orderBy(_PIECE).rowsBetween(Window.unboundedPreceding, -1)

    def joined(self, carried: DataFrame, rows: DataFrame) -> DataFrame:
        """Rows with the columns that their piece has in ``carried``."""
        names = [_PIECE, *self.keys]
        side = broadcast_if_small(carried.withColumnsRenamed({c: f"{c}__of" for c in names}).checkpoint())
        same = [F.col(c).eqNullSafe(F.col(f"{c}__of")) for c in names]
        return rows.join(side, same, "left").drop(*(f"{c}__of" for c in names))


def as_of_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], time: str, take: Sequence[str], order: Sequence[str] = ()
) -> DataFrame:
    """Each left row with columns ``take`` of the latest right row of its keys at or before its time; nulls where there is none.

    Of right rows at the same time the last in ``order`` counts, nulls first. A null key or time on either side matches nothing; left rows
    stay all the same, as often as they are there. The taken columns follow the left ones and must have other names.
    """
    clash = {c.lower() for c in take} & {c.lower() for c in left.columns}
    if clash:
        raise ValueError(f"columns of both sides: {sorted(clash)}")
    known = lambda *cols: reduce(Column.__and__, (F.col(c).isNotNull() for c in cols))
    mine = [F.col(c).alias(f"__left_{i}") for i, c in enumerate(left.columns)]
    theirs = F.struct(*[F.col(c).alias(f"take_{i}") for i, c in enumerate(take)])
    keys = [F.col(c).alias(f"__key_{i}") for i, c in enumerate(on)]
    names = [f"__key_{i}" for i in range(len(on))]
    order_names = [f"__order_{i}" for i in range(len(order))]
    searched = left.where(known(*on, time)).select(*keys, F.col(time).alias("__time"), F.lit(1).alias("__side"), F.struct(*mine).alias("__left"))
    offered = right.where(known(*on, time)).select(
        *keys, F.col(time).alias("__time"), F.lit(0).alias("__side"), theirs.alias("__taken"),
        *[F.col(c).alias(n) for c, n in zip(order, order_names, strict=True)],
    )
    both = searched.unionByName(offered, allowMissingColumns=True)
    pieces = Pieces(both, names, ["__time", "__side", *order_names])
    local = pieces.rows.withColumn("__found", F.last("__taken", ignorenulls=True).over(pieces.inside()))
    ends = pieces.reduced(F.max_by("__taken", F.when(F.col("__taken").isNotNull(), F.col(_AT))).alias("__end"))
    carried = ends.withColumn("__carried", F.last("__end", ignorenulls=True).over(pieces.before())).drop("__end")
    found = pieces.joined(carried.where(F.col("__carried").isNotNull()), local.where("__side = 1"))
    taken = F.coalesce("__found", "__carried")
    out = [F.col(f"__left.__left_{i}").alias(c) for i, c in enumerate(left.columns)]
    matched = found.select(*out, *[taken[f"take_{i}"].alias(c) for i, c in enumerate(take)])
    nothing = [F.lit(None).cast(right.schema[c].dataType).alias(c) for c in take]
    return matched.unionByName(left.where(~F.coalesce(known(*on, time), F.lit(False))).select("*", *nothing))


# --- ranges ---------------------------------------------------------------------


def range_join(
    left: DataFrame, right: DataFrame, left_range: tuple[str, str], right_range: tuple[str, str], on: Sequence[str] = ()
) -> DataFrame:
    """Pairs of rows whose ranges [from, to) have a point in common, of any number and length; columns of both sides.

    Name one column twice for a point. A null bound of a range is open; a null point, and a range that ends where it starts or before,
    meets nothing. ``on`` are keys that must be equal too. NaN is no bound.

    A range goes to the level of the power of two not below its length, where it touches two or three bins at most, and
    looks for the other side's ranges there (shorter ones there look at each level in use above theirs). So bins are keys of an equality join, a pair
    meets at one level only, and in the first bin that both touch. Work follows the pairs that lie within a bin of each other, mostly pairs of the result.
    """
    clash = {c.lower() for c in left.columns} & {c.lower() for c in right.columns} - {c.lower() for c in on}
    if clash:
        raise ValueError(f"columns of both sides: {sorted(clash)}")
    sides = [_bounded(left, left_range, "l", on), _bounded(right, right_range, "r", on)]
    ends = [0.0]
    for side, p in zip(sides, "lr", strict=True):
        both = (f"__{p}_from", f"__{p}_to")
        ends += [x for x in side.agg(F.min(F.least(*both)), F.max(F.greatest(*both))).first() if x is not None]
    low, high = min(ends) - 1.0, max(ends) + 1.0
    sides = [_levelled(side, p, low, high) for side, p in zip(sides, "lr", strict=True)]
    levels = [sorted(r[0] for r in side.select(f"__{p}_level").distinct().collect()) for side, p in zip(sides, "lr", strict=True)]
    short_left = _meet(sides, "l", "r", levels[1], on, strict=False)
    columns = [*left.columns, *(c for c in right.columns if c not in on)]
    if not all(levels) or levels[0][-1] <= levels[1][0]:  # no left range is longer: points, for instance
        return short_left.select(*columns)
    short_right = _meet(sides, "r", "l", levels[0], on, strict=True)
    return short_left.select(*columns).unionByName(short_right.select(*columns))


def _bounded(rows: DataFrame, bounds: tuple[str, str], side: str, on: Sequence[str]) -> DataFrame:
    """Rows that can meet something, their bounds as doubles next to the exact ones (null where open)."""

    kinds = dict(rows.dtypes)

    def number(c: str) -> Column:
        plain = F.col(c).cast("timestamp") if kinds[c] == "timestamp_ntz" else F.col(c)
        plain = {"timestamp": F.unix_micros, "timestamp_ntz": F.unix_micros, "date": F.unix_date}.get(kinds[c], lambda x: x)(plain)
        plain = plain.cast("double")
        return F.when(plain.isNotNull(), F.least(F.greatest(plain, F.lit(-_FAR)), F.lit(_FAR)))

    first, last = map(number, bounds)
    nan = [F.coalesce(F.isnan(F.col(c).cast("double")), F.lit(False)) for c in bounds if kinds[c] in ("double", "float")]
    usable = reduce(Column.__and__, (~n for n in nan), F.lit(True))
    if bounds[0] == bounds[1]:
        usable = usable & first.isNotNull()
    else:
        usable = usable & F.coalesce(F.col(bounds[0]) < F.col(bounds[1]), F.lit(True))
    for c in on:
        usable = usable & F.col(c).isNotNull()
    exact = [F.col(c).alias(f"__{side}_{end}_exact") for c, end in zip(bounds, ("from", "to"), strict=True)]
    point = F.lit(bounds[0] == bounds[1]).alias(f"__{side}_point")
    return rows.where(usable).select(*rows.columns, first.alias(f"__{side}_from"), last.alias(f"__{side}_to"), *exact, point)


def _levelled(rows: DataFrame, side: str, low: float, high: float) -> DataFrame:
    """Open ends put beyond all others, and the level of each range: the power of two not below its length."""
    start, end = f"__{side}_from", f"__{side}_to"
    rows = rows.withColumns({start: F.coalesce(start, F.lit(low)), end: F.coalesce(end, F.lit(high))})
    length = F.col(end) - F.col(start)
    level = F.when(length > 0, F.ceil(F.log2(length))).otherwise(F.lit(_POINT_LEVEL)).cast("int")
    return rows.withColumn(f"__{side}_level", level)


_POINT_LEVEL = -1_100  # below the level of any length
_FAR = 1e300  # infinite bounds are taken to lie here; the comparison that decides is that of the bounds themselves


def _meet(sides: list[DataFrame], short: str, long: str, levels: Sequence[int], on: Sequence[str], strict: bool) -> DataFrame:
    """Pairs in which ``long`` has the higher level (or the same, unless ``strict``): they meet at its level."""
    shorter, longer = (sides["lr".index(p)] for p in (short, long))
    own = F.col(f"__{short}_level")
    above = [F.when(own < k if strict else own <= k, F.lit(k)) for k in levels]
    shorter = shorter.withColumn("__level", F.explode(F.array_compact(F.array(*above).cast("array<int>"))))
    longer = longer.withColumn("__level", F.col(f"__{long}_level"))
    binned = []
    for rows, p in ((shorter, short), (longer, long)):
        first, last = (F.floor(F.col(f"__{p}_{end}") / _width()) for end in ("from", "to"))
        binned.append(rows.withColumn(f"__{p}_first", first).withColumn("__bin", F.explode(F.sequence(first, last))))
    pairs = binned[0].join(binned[1], ["__level", "__bin", *on])
    touch = F.col("__bin") == F.greatest(f"__{short}_first", f"__{long}_first")
    return pairs.where(touch & _before("l", "r") & _before("r", "l"))


def _width() -> Column:
    """A power of two per level, exact; points that meet points at their own level have bins of one."""
    return F.when(F.col("__level") == _POINT_LEVEL, F.lit(1.0)).otherwise(F.pow(F.lit(2.0), F.col("__level")))


def _before(a: str, b: str) -> Column:
    """Side a starts before side b ends: a point ends at itself, inclusive."""
    start, end = F.col(f"__{a}_from_exact"), F.col(f"__{b}_to_exact")
    open_ended = start.isNull() | end.isNull()
    return open_ended | F.when(F.col(f"__{b}_point"), start <= end).otherwise(start < end)


# --- running totals, frames of time, ranks ------------------------------------------


def running(
    rows: DataFrame, by: Sequence[str], order: Sequence[str], sums: Sequence[str] = (), least: Sequence[str] = (), most: Sequence[str] = ()
) -> DataFrame:
    """Add ``run_no`` (1, 2, …) and, for each column, ``sum_``, ``min_`` or ``max_`` of it over the rows of the keys up to this one.

    Nulls add nothing; a sum of nulls only is null. Null keys are a group. Rows that tie in ``order`` come in any order.
    """
    pieces = Pieces(rows, by, order)
    parts = [("sum", c, F.sum) for c in sums] + [("min", c, F.min) for c in least] + [("max", c, F.max) for c in most]
    ones = F.lit(1).cast("bigint")
    local = pieces.rows.withColumns({
        "__run_n": F.count(ones).over(pieces.inside()), **{f"__run_{kind}_{c}": fn(c).over(pieces.inside()) for kind, c, fn in parts}
    })
    ends = pieces.reduced(F.count(ones).alias("__run_n"), *[fn(c).alias(f"__run_{kind}_{c}") for kind, c, fn in parts])
    earlier = {"__run_n_before": F.sum("__run_n").over(pieces.before())}
    earlier |= {f"__run_{kind}_{c}_before": fn(f"__run_{kind}_{c}").over(pieces.before()) for kind, c, fn in parts}
    carried = ends.select(_PIECE, *pieces.keys, *[column.alias(name) for name, column in earlier.items()])
    both = pieces.joined(carried, local)
    join = {"min": F.least, "max": F.greatest}
    out = {"run_no": F.col("__run_n") + F.coalesce("__run_n_before", F.lit(0))}
    for kind, c, _ in parts:
        own, before = F.col(f"__run_{kind}_{c}"), F.col(f"__run_{kind}_{c}_before")
        out[f"{kind}_{c}"] = join[kind](own, before) if kind in join else F.coalesce(own + before, own, before)
    return both.select(*rows.columns, *[column.alias(name) for name, column in out.items()])


def moving_average(rows: DataFrame, by: Sequence[str], time: str, value: str, reach: int) -> DataFrame:
    """Add ``rows_in_frame`` and ``moving_average`` of ``value`` over the rows of the keys with times from ``reach`` before this row's to its own.

    ``time`` is an integer (microseconds, say); rows at the same time are in each other's frame. Sums up to each distinct time are differences of
    running decimals with six digits, so a frame costs two look-ups however many rows are in it, and nothing cancels.
    Rows with a null time are in no frame and get nulls; null values add nothing.
    """
    keys = [f"__by_{i}" for i in range(len(by))]
    named = [F.coalesce(F.to_json(F.array(c)), F.lit("")).alias(k) for c, k in zip(by, keys, strict=True)]  # null is a key here
    exact = F.col(value).cast("decimal(28,6)")
    kept = rows.select("*", *named)
    each = kept.where(F.col(time).isNotNull()).groupBy(*keys, F.col(time).alias("__time"))
    per_time = each.agg(
        F.coalesce(F.sum(exact), F.lit(0).cast("decimal(38,6)")).alias("__sum"), F.count(value).alias("__known"), F.count(F.lit(1)).alias("__rows")
    )
    totals = running(per_time, keys, ["__time"], sums=["__sum", "__known", "__rows"])
    upto = totals.select(*keys, "__time", *[F.col(f"sum___{c}").alias(f"__{c}_to") for c in ("sum", "known", "rows")])
    before = totals.select(*keys, F.col("__time").alias("__ago"), *[F.col(f"sum___{c}").alias(f"__{c}_off") for c in ("sum", "known", "rows")])
    shifted = upto.withColumn("__ago", F.col("__time") - (reach + 1))
    frames = as_of_join(shifted, before, keys, "__ago", ["__sum_off", "__known_off", "__rows_off"])
    left = {c: F.col(f"__{c}_to") - F.coalesce(f"__{c}_off", F.lit(0)) for c in ("sum", "known", "rows")}
    frames = frames.select(
        *[F.col(k).alias(f"{k}_of") for k in keys], F.col("__time").alias("__time_of"), left["rows"].alias("rows_in_frame"),
        F.when(left["known"] > 0, left["sum"].cast("double") / left["known"]).alias("moving_average"),
    )
    same = [F.col(k) == F.col(f"{k}_of") for k in keys] + [F.col(time) == F.col("__time_of")]
    return kept.join(frames, reduce(Column.__and__, same), "left").select(*rows.columns, "rows_in_frame", "moving_average")


def ranked(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Add ``rank``: 1 plus the rows of the keys with a smaller value, so ties share a rank and leave a gap; nulls come first.

    Equal values are counted before anything is put in order: copies of one value cost one row.
    """
    keys = [*by, value]
    counts = rows.groupBy(*[F.col(c).alias(f"__of_{i}") for i, c in enumerate(keys)]).agg(F.count(F.lit(1)).alias("__n"))
    names = [f"__of_{i}" for i in range(len(keys))]
    placed = running(counts, names[:-1], names[-1:], sums=["__n"])
    ranks = placed.select(*names, (F.col("sum___n") - F.col("__n") + 1).alias("rank"))
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(n)) for c, n in zip(keys, names, strict=True)))
    return rows.join(ranks, same).drop(*names)
