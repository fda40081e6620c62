"""Every query with SQL gives DuckDB's rows on the small tables."""

import math
import os

import duckdb
import pytest

from pulseframe import catalog

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 4) + 0.0
    return int(x) if isinstance(x, bool) else x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=lambda r: [(x is None, str(type(x)), x if x is not None else 0) for x in r]), sorted(columns)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got, cols = rows_of(df.columns, df.collect())
    rel = duck.sql(catalog.ORACLE_SQL[name])
    want, want_cols = rows_of(rel.columns, rel.fetchall())
    assert cols == want_cols
    assert len(got) == len(want)
    bad = [(a, b) for a, b in zip(got, want) if a != b and not all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-4)) for x, y in zip(a, b))]
    assert not bad, bad[:3]


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").limit(5).count() > 0
