"""Queries over the smallest tables: all columns that a problem covers are processed."""

import os

import pytest

from graylark.llm import queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def covered(spark, name, parts):
    counts = {r["tab"]: r["count"] for r in queries.queries()[name](spark, DATA).groupBy("tab").count().collect()}
    assert counts == {tab: spark.read.parquet(f"{DATA}/{tab}.parquet").count() for tab in parts}


def test_unified_covers_all_columns(spark):
    covered(spark, "p6_unified", ("dataset", "risk_assessment", "domain_analysis"))


def test_redacted_covers_all_columns(spark):
    covered(spark, "p5_redacted", ("dataset", "risk_assessment"))
    found = {(r.tab, r.row_key) for r in queries.p5_found(spark, DATA).where("tab = 'risk_assessment'").collect()}
    rows = {(r.tab, r.row_key): r.redacted for r in queries.p5_redacted(spark, DATA).where("tab = 'risk_assessment'").collect()}
    assert found and all("[" in rows[k] for k in found)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    df = queries.queries()[name](spark, DATA)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want) and want
