"""All queries against their SQL twins, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
import check

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    import glob
    import os

    db = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return db


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, con, sf, name):
    good, note = check.compare(spark, con, sf, name)
    assert good, note


def test_flagship(spark):
    result = entry.entry(spark)
    assert result.columns[-1] == "anomaly_score" and result.count() > 0
