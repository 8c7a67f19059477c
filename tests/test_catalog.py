"""Every query against its SQL, and those without SQL for rows and a stable schema."""

from __future__ import annotations

import pytest

from vecloom import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(name, same_rows):
    same_rows(QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys() - {"nystrom_svm"}))
def test_rows_without_sql(name, spark, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    assert df.schema == QUERIES[name](spark, sf_dir).schema
    assert df.count() > 0


def test_sql_belongs_to_queries():
    assert ORACLES.keys() <= QUERIES.keys()


def test_flagship(spark, sf_dir):
    rows = catalog.flagship(spark, sf_dir).collect()
    assert sum(r["n"] for r in rows) == 500
