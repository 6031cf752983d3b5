"""Every registered query against its SQL, on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.conftest import SMALL
from tests.oracle_check import compare, connect

QUERIES, ORACLES = queries(), oracle_sql()


@pytest.fixture(scope="module")
def db():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    verdict = compare(spark, db, name, SMALL, QUERIES[name], ORACLES.get(name))
    assert verdict.startswith("ok") or (name not in ORACLES and verdict.startswith("rows")), verdict


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["branch", "avg_temperature"]
    assert df.count() == 13


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(QUERIES)
