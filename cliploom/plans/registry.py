"""Registered queries: a callable, the operator it exercises, and SQL with the same result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from cliploom.session import ship_package

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    covers: str  # operators of the inventory, e.g. "P3" or "S7 S8"
    build: Run
    sql: str

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(ship_package(spark), sf_dir)


REGISTRY: dict[str, Query] = {}


def query(covers: str, sql: str) -> Callable[[Run], Run]:
    """Register a function under its own name."""

    def register(build: Run) -> Run:
        REGISTRY[build.__name__] = Query(build.__name__, covers, build, sql.strip())
        return build

    return register
