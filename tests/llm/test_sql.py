from __future__ import annotations

import pytest

from vecloom.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_as_sql(name, same_rows):
    """SQL states the contract's columns; those that a query adds are left out."""
    sql = oracle_sql()[name]
    same_rows(queries()[name], sql)


def test_every_operator_has_a_query():
    assert sorted(int(k[2:].split("_")[0]) for k in queries()) == list(range(1, 14))
