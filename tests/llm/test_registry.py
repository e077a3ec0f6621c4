"""Every registered query runs over the smallest tables; those with SQL give the rows of their SQL."""

import duckdb
import pytest

from quillmark.llm import registry

TABLES = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    got = registry.QUERIES[name](spark, TABLES)
    rows = [tuple(r) for r in got.collect()]
    assert rows and len(set(got.columns)) == len(got.columns)
    if name not in registry.ORACLES:
        return
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations", "labels", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{TABLES}/{table}.parquet')")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.ORACLES[name].strip().rstrip(';')})").fetchall()
    near = lambda row: tuple(pytest.approx(x, rel=1e-12) if isinstance(x, float) else x for x in row)
    order = lambda row: tuple(map(str, (x for x in row if not isinstance(x, float))))
    assert sorted(rows, key=order) == [near(w) for w in sorted(want, key=order)]
