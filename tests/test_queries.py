"""Every query with SQL against DuckDB on the smallest tables; the others return rows."""

from __future__ import annotations

import math

import duckdb
import pytest

from quirelake.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return v


def rows(table):
    return sorted(repr(x) for x in zip(*[[plain(v) for v in table[c].to_pylist()] for c in sorted(table.column_names)]))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, name):
    got = registry.QUERIES[name](spark, sf_dir).toArrow()
    if name not in registry.SQL:
        assert got.num_rows > 0
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    want = con.sql(registry.SQL[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names) and rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
