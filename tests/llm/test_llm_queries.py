import pytest
from compare import assert_same, duck

from tessella.llm import queries as Q

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_same_as_sql(spark, name):
    assert_same(Q.QUERIES[name](spark, SF), Q.ORACLE[name], duck(SF))
