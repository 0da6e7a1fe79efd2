import pytest

from crosslake.plans import engine_queries, record_queries, service_queries
from tests.conftest import DATA, needs_data
from tests.oracle import assert_same, connect

QUERIES = engine_queries.QUERIES | service_queries.QUERIES | record_queries.QUERIES
SQL = engine_queries.SQL | service_queries.SQL | record_queries.SQL


@pytest.fixture(scope="module")
def db():
    return connect(DATA)


@needs_data
@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_matches_sql(spark, db, name):
    assert_same(QUERIES[name](spark, DATA), SQL[name], db)


@needs_data
@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_runs(spark, name):
    QUERIES[name](spark, DATA).count()
