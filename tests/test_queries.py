import pytest
from compare import SF, assert_same, duck

from tessella import queries as Q


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_same_as_sql(spark, name):
    assert_same(Q.QUERIES[name](spark, SF), Q.ORACLE[name], duck())


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE)))
def test_runs(spark, name):
    assert Q.QUERIES[name](spark, SF).count() > 0
