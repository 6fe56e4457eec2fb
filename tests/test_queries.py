"""Every query runs at the smallest scale; those with SQL give what DuckDB gives."""

import math
import os

import duckdb
import pytest

from textloom import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{v:.6f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    want = duck.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert table(df.columns, rows) == table(want.columns, want.fetchall())


def test_nothing_outside_imports_the_optional_package():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    optional = os.path.join(root, "textloom", "llm")
    for folder, _, names in os.walk(os.path.join(root, "textloom")):
        if not folder.startswith(optional):
            for n in names:
                if n.endswith(".py"):
                    assert "textloom.llm" not in open(os.path.join(folder, n), encoding="utf-8").read()
