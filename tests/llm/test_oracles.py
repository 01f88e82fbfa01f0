import pytest

from symsearch.llm import queries
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_against_sql(spark, name, size):
    same(spark, f"/root/testdata/{size}", queries.queries()[name], queries.oracle_sql()[name])
