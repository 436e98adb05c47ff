"""Every registered query against its SQL on the smallest tables, and the driver's entry points."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__
from larkspur.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        path = f"{SF}/{name}"
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = [[r[c] for c in columns] for r in df.collect()]
    sql = f"SELECT {', '.join(columns)} FROM ({catalog.ORACLES[name]})"
    assert plain(rows) == plain(duck.sql(sql).fetchall())


def test_entry_points(spark):
    assert __spark_entry__.entry(spark).columns == ["item", "price", "drop_from", "score", "rank"]
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_survivors_are_never_removed_and_keepers_are_final(spark):
    left = {r.ord for r in catalog.QUERIES["linkage_survivors"](spark, SF).collect()}
    merged = {r.removed: r.keeper for r in catalog.QUERIES["linkage_merges"](spark, SF).collect()}
    records = {r.p_partkey for r in catalog.table(spark, SF, "part").select("p_partkey").collect()}
    assert left and left == records - merged.keys()


def test_whole_texts_are_normalized(spark):
    rows = catalog.table(spark, SF, "documents").join(catalog.normalize_texts(spark, SF), "doc_id").collect()
    long = [r for r in rows if len(r.text or "") > 200]
    assert long and all(len(r.name) == len(" ".join(r.text.replace("\xa0", " ").split())) for r in long)
