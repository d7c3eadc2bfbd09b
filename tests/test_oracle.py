"""Every registered query against its SQL, on whole tables."""

from __future__ import annotations

import pytest
from oracle import connect, differences

from cliploom.plans.catalog import all_queries

QUERIES = all_queries()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    query = QUERIES[name]
    assert differences(query.run(spark, sf_dir), duck, query.sql) == []


def test_every_operator_of_the_inventory_has_a_query():
    covered = {op for q in QUERIES.values() for op in q.covers.split()}
    wanted = {f"{kind}{i}" for kind, n in (("S", 12), ("P", 21), ("B", 13), ("A", 19)) for i in range(1, n + 1)}
    assert covered == wanted
