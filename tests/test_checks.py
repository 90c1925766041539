"""Every registered query against its SQL on the smallest driver tables."""

import pytest
from compare import compare, duck

from riskgraph.plans.checks import QUERIES, SQL
from riskgraph.sources import driver_tables


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf_dir, name, monkeypatch):
    """Agrees with its SQL, and reads at least one of the given tables."""
    read, table = [], driver_tables.table
    monkeypatch.setattr(driver_tables, "table", lambda s, d, t: read.append(t) or table(s, d, t))
    if name in SQL:
        assert compare(spark, con, sf_dir, QUERIES[name], SQL[name]) == []
    else:
        assert QUERIES[name](spark, sf_dir).count() > 0
    assert read, "no table was read"
