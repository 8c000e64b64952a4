"""Every core query against DuckDB, and on empty and odd tables."""

import os

import duckdb
import pytest

from conftest import DATA, TABLES
from helpdex.plans.catalogue import FLAGSHIP, QUERIES, SQL


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, list | tuple):
        return tuple(map(plain, value))
    return value


def compare(spark, queries, sql, name, data_dir):
    found = queries[name](spark, data_dir)
    with duckdb.connect() as db:
        db.execute("SET timezone = 'UTC'")
        for t in TABLES:
            p = f"{data_dir}/{t}.parquet"
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
        ran = db.execute(sql[name])
        names = [c[0] for c in ran.description]
        want = ran.fetchall()
    assert sorted(found.columns) == sorted(names)
    rows = sorted(repr([plain(r[c]) for c in sorted(names)]) for r in found.collect())
    assert rows == sorted(repr([plain(r[names.index(c)]) for c in sorted(names)]) for r in want)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    compare(spark, QUERIES, SQL, name, DATA)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty_dir, name):
    rows = QUERIES[name](spark, empty_dir).collect()
    assert len(rows) <= 1 if name in ("sync_stats", "calibrate_summary") else not rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_tables(spark, odd_dir, name):
    QUERIES[name](spark, odd_dir).collect()


def test_flagship_and_contract():
    import __spark_entry__ as entry

    assert FLAGSHIP in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
