"""Every registered query agrees with its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
import compare
from pagetables.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return compare.duck(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert QUERIES.keys() <= entry.queries().keys() and ORACLES.keys() <= entry.oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, db, name):
    assert compare.compare(QUERIES[name](spark, SF), db, ORACLES[name]) is None


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(r["square_footage_int"] >= 5000 for r in rows)
