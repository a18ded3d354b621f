"""Every query: against its SQL on real tables, and on empty and awkward ones."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import DATA

QUERIES, SQL = entry.queries(), entry.oracle_sql()
CORE = [q for q in QUERIES if "auditlake.llm" not in QUERIES[q].__module__]


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v if v is None or isinstance(v, int) else str(v)


def rows_of(df):
    cols = sorted(df.columns)
    return Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())


def rows_of_sql(sql, folder=DATA):
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    order = [names.index(c) for c in sorted(names)]
    return Counter(tuple(plain(r[i]) for i in order) for r in found.fetchall())


@pytest.mark.parametrize("name", [q for q in CORE if q in SQL])
def test_matches_sql(spark, name):
    assert rows_of(QUERIES[name](spark, DATA)) == rows_of_sql(SQL[name])


@pytest.mark.parametrize("name", [q for q in CORE if q not in SQL])
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


@pytest.mark.parametrize("name", CORE)
def test_empty_tables(spark, empty_tables, name):
    assert QUERIES[name](spark, empty_tables).count() == 0


@pytest.mark.parametrize("name", CORE)
def test_awkward_tables(spark, awkward_tables, name):
    QUERIES[name](spark, awkward_tables).count()


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "score" in df.columns
