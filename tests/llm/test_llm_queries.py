"""Registered queries against their SQL."""

from __future__ import annotations

import pytest

from batchloom.llm import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_match_sql(agrees, name):
    agrees(queries.queries()[name], SQL[name])
