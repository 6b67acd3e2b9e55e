"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from tests.compare import duck, duck_rows, rows_of

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql():
    assert set(entry.QUERIES) == set(entry.ORACLE)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.ORACLE))
def test_query_equals_sql(spark, con, name):
    frame = entry.queries()[name](spark, SF)
    columns, rows = duck_rows(con, entry.oracle_sql()[name])
    assert sorted(frame.columns) == sorted(columns)
    assert rows_of(frame.columns, frame.collect()) == rows_of(columns, rows)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
