import pytest

from gaugeworks.result_queries import QUERIES, SQL
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    assert_same(QUERIES[name](spark, SF), SQL[name], SF)
