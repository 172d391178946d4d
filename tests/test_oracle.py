"""Every registered query against its oracle SQL on the smallest data set."""

import duckdb
import pytest

import __spark_entry__ as entry
from shelfwise.plans.registry import QUERIES as PLANS
from tests.conftest import SMALL
from tests.support import tables_equal

NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
QUERIES = {name: query for name, query in entry.queries().items() if name in PLANS}
ORACLE = {name: sql for name, sql in entry.oracle_sql().items() if name in PLANS}


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in NAMES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, con, name):
    assert tables_equal(con, QUERIES[name](spark, SMALL).toArrow(), ORACLE[name]) is None


def test_only_the_models_lack_an_oracle():
    assert set(QUERIES) - set(ORACLE) == {"expiry_model_scores", "demand_forecast", "expiry_model_report", "expiry_search"}
    assert not set(ORACLE) - set(QUERIES)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
