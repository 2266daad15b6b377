"""The examples on literal rows against their DuckDB twins: values, column names and types of values."""

import duckdb
import pytest

from evidence_engine.plans import catalog

_EXAMPLES = catalog.examples()


def plain(x):
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    return int(x) if isinstance(x, float) and x == int(x) else x


@pytest.mark.parametrize("name", sorted(_EXAMPLES))
def test_example(spark, sf, name):
    query, sql = _EXAMPLES[name]
    frame = query(spark, sf)
    rows = sorted(([plain(r[c]) for c in sorted(frame.columns)] for r in frame.collect()), key=repr)
    if sql is None:
        assert rows
        return
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "conversations", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(frame.columns)
    want = sorted(([plain(dict(zip(names, r, strict=True))[c]) for c in sorted(names)] for r in cur.fetchall()), key=repr)
    assert rows == want


def test_no_query_is_an_example():
    assert catalog.EXAMPLES == set(_EXAMPLES) and not catalog.EXAMPLES & set(catalog.queries())
