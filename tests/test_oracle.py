"""Every query with SQL gives the rows DuckDB gives."""

import pytest
from strandline.plans import registry

from tests import oracle

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SMALL)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert oracle.compare(spark, registry.queries()[name], registry.oracle_sql()[name], SMALL, con) is None


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_other_queries_run(spark, name):
    assert registry.queries()[name](spark, SMALL).count() > 0
