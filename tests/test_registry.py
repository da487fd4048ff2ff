"""Registered queries against their SQL on the smallest data; a few of them only with LEADFLOW_FEW=1."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry
from leadflow.plans import all_sql
from tools.check import TABLES, digest

SF = "/root/testdata/sf0.001"
SAMPLE = ("canonical_url", "build_windows", "watch_matches", "classify_outcomes", "source_reports", "merge_listings", "listing_leads", "stream_dedup")
# Queries of the optional part have tests of their own.
NAMES = SAMPLE if os.environ.get("LEADFLOW_FEW") else sorted(all_sql())

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    db.execute(entry.oracle_sql()[name])
    names = [c[0] for c in db.description]
    assert sorted(names) == sorted(df.columns)
    assert digest(df.columns, rows)[0] == digest(names, db.fetchall())[0]


def test_queries_are_listed_without_a_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; from pyspark import SparkContext; assert len(e.queries()) >= len(e.oracle_sql()) > 100 and SparkContext._active_spark_context is None"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(entry.__file__))


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
