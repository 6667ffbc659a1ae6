import pytest

from loomtext.plans import catalogue
from tests.oracle import check

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    check(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"model_text_vote"}))
def test_query_runs(spark, name):
    check(spark, QUERIES[name], None)
