"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import math
import os
from pathlib import Path

import pytest

from dossierkit.plans import archive_queries, orphan_queries, search_queries

SF = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
QUERIES = {n: q for m in (archive_queries, orphan_queries, search_queries) for n, q in m.QUERIES.items()}
SQL = {n: q for m in (archive_queries, orphan_queries, search_queries) for n, q in m.SQL.items()}

pytestmark = pytest.mark.skipif(not SF.is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in SF.glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.8g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, str(SF))
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    answer = duck.execute(SQL[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(dict(zip(names, row))[c]) for c in columns) for row in answer.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_others_run(spark, name):
    df = QUERIES[name](spark, str(SF))
    assert df.count() >= 0 and df.columns


def test_recall_of_the_index(spark):
    assert QUERIES["ann_recall"](spark, str(SF)).first()["recall"] >= 0.9
