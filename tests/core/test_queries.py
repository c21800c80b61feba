import pytest

from driftline.plans.catalog import ORACLE, QUERIES
from tests.oracle import connection, differences

#: Queries whose result is empty on 200 documents.
MAY_BE_EMPTY = {"trend_summary"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, sf, name):
    found = differences(QUERIES[name](spark, sf), connection(sf), ORACLE[name])
    assert not found or (found == "no rows" and name in MAY_BE_EMPTY)


def test_entry_is_there():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLE) <= set(__spark_entry__.oracle_sql())
