"""Choose among several methods' results for the same clip."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def priority(method: Column, order: Sequence[str]) -> Column:
    """Position of a method in the list (any case); after all others when it is not listed."""
    at = F.array_position(F.lit([m.lower() for m in order]), F.lower(method))
    return F.when(at > 0, at - 1).otherwise(F.lit(len(order)).cast("bigint"))


def choose(
    attempts: DataFrame, per: str, order: Sequence[str], result: str, default, prefer: str | None = None
) -> DataFrame:
    """Result of the first method in ``order`` that succeeded, else ``default``; of ``prefer`` alone if that is in ``order``.

    The rule for a named method is that of ``frames.ordered_chain``. ``attempts`` has ``method``, ``success``, ``run_no`` and ``result``. It is a minimum
    per clip and combines map-side. Clips without any success keep their row.
    """
    named = [m for m in order if prefer and m.lower() == prefer.lower()][:1]
    counts = F.col("success") & (F.lower("method") == named[0].lower() if named else F.lit(True))
    rank = F.struct(priority(F.col("method"), order).alias("priority"), "run_no", "method", result)
    best = attempts.groupBy(per).agg(F.min(F.when(counts, rank)).alias("best"))
    return best.select(
        per,
        F.coalesce("best.method", F.lit("none")).alias("method"),
        F.coalesce(F.col(f"best.{result}"), F.lit(default)).alias(result),
    )


def attempt(value: Column, target: str) -> dict[str, Column]:
    """Cast that captures failure in columns instead of ending the job."""
    parsed = value.try_cast(target)
    failed = value.isNotNull() & parsed.isNull()
    return {
        "parsed": parsed,
        "status": F.when(failed, "error").otherwise("ok"),
        "error": F.when(failed, F.concat(F.lit("cannot read "), value)),
    }
