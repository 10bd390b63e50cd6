"""The queries against their SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import pytest

from papyrion.plans import html_queries, source_queries, upkeep_queries
from papyrion.plans.oracle import SQL
from papyrion.plans.queries import QUERIES

duckdb = pytest.importorskip("duckdb")
NAMES = [*html_queries.SQL, *source_queries.SQL, *(n for n in upkeep_queries.QUERIES if n in SQL), "page_unique_path", "library_paths", "sync_plan", "collections_normalized", "inventory_pages", "page_state", "inventory_csv_lines", "aggregate_documents"]


@pytest.fixture(scope="module")
def tables(data):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def test_every_query_of_the_core_is_known():
    assert set(SQL) <= set(QUERIES) and set(NAMES) <= set(SQL)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, data, tables, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = Counter(tuple(r[c] for c in columns) for r in df.collect())
    found = tables.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == Counter(tuple(r[names.index(c)] for c in columns) for r in found.fetchall())
