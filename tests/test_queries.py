"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: The driver may take the operators of one subpackage away.
NAMES = sorted(entry.engine.ORACLE_SQL)


@pytest.fixture(scope="module")
def oracle(sf):
    db = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return db


def plain(rows):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in row) for row in rows)


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, sf, oracle, name):
    got, want = entry.queries()[name](spark, sf), oracle.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert plain(map(tuple, got.select(columns).collect())) == plain(want.select(*[f'"{c}"' for c in columns]).fetchall())


@pytest.mark.parametrize("name", sorted(set(entry.engine.QUERIES) - set(NAMES)))
def test_others_run(spark, sf, name):
    assert entry.engine.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() > 0
