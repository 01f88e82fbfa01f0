import pytest

import __spark_entry__
from symsearch import queries
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, sf_dir, name):
    rows = same(spark, sf_dir, queries.QUERIES[name], queries.ORACLES[name])
    assert rows or name == "match_nothing"


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLES)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 12
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_ranked_search_is_ranked(spark, sf_dir):
    scores = [r.score for r in queries.QUERIES["ranked_search"](spark, sf_dir).collect()]
    assert scores and scores == sorted(scores, reverse=True)
