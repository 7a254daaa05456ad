"""Every registered query with SQL gives the rows that DuckDB gives."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"
OWN = [k for k in entry.queries() if not re.match(r"op\d|pipeline", k)]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def rows(frame):
    def value(x):
        if x is None or x != x:
            return None
        return float(f"{float(x):.9g}") if isinstance(x, (int, float)) or "int" in type(x).__name__ or "float" in type(x).__name__ else str(x)

    names = sorted(frame.columns)
    return sorted((tuple(value(x) for x in r) for r in frame[names].astype(object).where(frame[names].notna(), None).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", [k for k in OWN if k in entry.oracle_sql()])
def test_against_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", [k for k in OWN if k not in entry.oracle_sql()])
def test_without_sql_gives_rows(spark, sf_dir, name):
    assert entry.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())
