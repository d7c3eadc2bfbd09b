"""Expressions on file paths."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

VIDEO_SUFFIXES = (".mp4", ".avi", ".mov", ".mkv")


def video_name(path: Column) -> Column:
    """Last segment of a path."""
    return F.substring_index(path, "/", -1)


def plain_path(path: Column) -> Column:
    """Local paths without ``file:``, as Spark's readers write it in several ways."""
    return F.regexp_replace(path, "^file:/+", "/")


def has_suffix(path: Column, suffixes: str | Iterable[str]) -> Column:
    """True where the path ends with one of the suffixes (case-sensitive)."""
    if isinstance(suffixes, str):
        suffixes = [suffixes]
    return reduce(Column.__or__, [F.endswith(path, F.lit(s)) for s in suffixes])


def known_size(size: Column) -> Column:
    """File size in bytes, 0 where the file is missing."""
    return F.coalesce(size.cast("bigint"), F.lit(0).cast("bigint"))
