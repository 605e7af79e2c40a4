"""Every registered query against DuckDB on the smallest tables."""

from __future__ import annotations

import oracle
import pytest

from tessera.queries import load

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(load()))
def test_same_rows_as_duckdb(spark, duck, name):
    q = load()[name]
    assert oracle.compare(q.run(spark, SF), duck, q.sql) is None


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
