"""Every registered query with SQL gives the rows that the SQL states."""

import pytest
from sitelens.plans import markup, more, registry  # noqa: F401
from tests import oracle


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, con, name):
    frame = registry.QUERIES[name](spark, sf)
    assert name in registry.ORACLE_SQL
    assert oracle.compare(frame, con, registry.ORACLE_SQL[name]) is None
