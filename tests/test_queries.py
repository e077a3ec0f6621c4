"""Each query against its SQL, and the entry module."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from quillmark.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def rows(result):
    return sorted((tuple(repr(float(x)) if isinstance(x, float) else repr(x) for x in r) for r in result))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = rows(df.select(*columns).collect())
    assert name.startswith("canonical") or name in catalog.ORACLES
    if name in catalog.ORACLES:
        sql = duck.sql(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLES[name]})")
        assert sorted(sql.columns) == columns
        assert got == rows(sql.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "position"
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_row_order_does_not_matter(spark):
    from quillmark.operators import digests
    from quillmark.plans.digest_queries import research_events

    events = research_events(spark, FOLDER)
    relevance = events.selectExpr("work_id", "'d' AS domain_id", "'direct' AS decision").distinct()
    nothing = events.where("false")
    pick = lambda e: rows(digests.select(e, nothing, nothing, e, relevance).collect())
    assert pick(events) == pick(events.repartition(7).sortWithinPartitions("title"))
