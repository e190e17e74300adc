"""Queries that have SQL give the same rows as DuckDB, at the smallest scale."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
from lectern.queries import QUERIES, SQL  # noqa: E402

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"mistake_counts", "tags_of_readings"}  # checked at the golden example and by brute force too
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str([shown(x) for x in v]) if isinstance(v, list | tuple) else str(v)


@pytest.mark.parametrize("name", [n for n in SQL if n not in SLOW])
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    want = duck.sql(SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    got = sorted(tuple(map(shown, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    assert got == sorted(tuple(map(shown, r)) for r in want.select(*[f'"{c}"' for c in columns]).fetchall())
    assert got or name == "attach_passages"


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
