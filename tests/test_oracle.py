"""Every query with a SQL check, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from riftline.plans.bindings import TABLES
from tools.check import compare

FOLDER = "/root/testdata/sf0.001"
CHECKS = entry.oracle_sql()
HEAVY = {"train_evaluate_projects", "tune_cv"}  # run by tools/check.py


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - HEAVY))
def test_query(spark, database, name):
    line, good = compare(spark, database, name, FOLDER, entry.queries()[name], CHECKS.get(name))
    spark.catalog.clearCache()
    assert good, line


def test_entry(spark):
    assert entry.entry(spark).count() > 0
