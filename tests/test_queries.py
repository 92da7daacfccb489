"""Every query with SQL against DuckDB on the smallest tables; batch and stream agree."""

import math
import os
from collections import Counter
from decimal import Decimal

import pytest

duckdb = pytest.importorskip("duckdb")
from graylark.plans import catalog  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return float(f"{float(v):.10g}") if isinstance(v, (float, Decimal)) else v


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    cur = duck.execute(catalog.SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = Counter(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall())
    assert Counter(tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_windowed_stream(spark):
    from graylark.plans.funnel import verdicts
    from graylark.streaming.scoring import message_stream, scored_stream, windowed_counts

    path = f"{DATA}/raw_email.parquet"
    table = spark.read.parquet(path)
    stream = windowed_counts(scored_stream(message_stream(spark, path, table.schema)), width="30 days")
    stream.writeStream.outputMode("complete").format("memory").queryName("windowed").trigger(availableNow=True).start().awaitTermination()
    want = Counter(tuple(r) for r in windowed_counts(verdicts(table), width="30 days").collect())
    assert Counter(tuple(r) for r in spark.table("windowed").collect()) == want
