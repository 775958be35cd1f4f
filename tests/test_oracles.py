"""Every registered graph, text and vector query against its SQL."""

import os
from decimal import Decimal

import duckdb
import pytest

from quadweave import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return round(x, 6) + 0.0
    return float(x) if isinstance(x, Decimal) else x


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(name, spark, sf, duck):
    ours = queries.QUERIES[name](spark, sf)
    theirs = duck.sql(queries.ORACLES[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    rows = [tuple(map(plain, r)) for r in ours.select(*columns).collect()]
    want = [tuple(map(plain, r)) for r in theirs.select(*[f'"{c}"' for c in columns]).fetchall()]
    assert sorted(rows, key=repr) == sorted(want, key=repr)


def test_path_search_text_over_many_suppliers(spark, sf, tmp_path):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW nation AS SELECT * FROM '{sf}/nation.parquet'")
    for t in TABLES:
        if t != "supplier":
            os.symlink(f"{sf}/{t}.parquet", tmp_path / f"{t}.parquet")
    many = f"SELECT s.* REPLACE (s_suppkey + 1000 * i AS s_suppkey) FROM '{sf}/supplier.parquet' s, range(600) r(i)"
    con.sql(f"COPY ({many}) TO '{tmp_path}/supplier.parquet'")
    con.sql(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet'")
    ours = [tuple(r) for r in queries.QUERIES["path_search_text"](spark, str(tmp_path)).select("path", "n").collect()]
    want = con.sql(queries.ORACLES["path_search_text"]).fetchall()
    assert len(want) > 500 and sorted(ours) == sorted(want)


def test_entry_point_imports():
    import __spark_entry__

    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
    assert os.path.exists(os.path.join(os.path.dirname(__spark_entry__.__file__), "bench.py"))
