"""Corpus queries that have SQL, against it on the smallest data set."""

import duckdb
import pytest

import __spark_entry__ as entry
from shelfwise.llm.queries import ORACLE
from tests.support import tables_equal

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    assert entry.oracle_sql()[name] == ORACLE[name]
    assert tables_equal(con, entry.queries()[name](spark, SMALL).toArrow(), ORACLE[name]) is None
