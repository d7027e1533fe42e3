"""Every registered query against its SQL counterpart in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidewire.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(columns, rows):
    order = [columns.index(c) for c in sorted(columns)]

    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 9)
        return v

    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cursor = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    same = {"bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}
    rows = cursor.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert normal(df.columns, [tuple(r) for r in df.collect()]) == normal(columns, rows)
    for column, dtype in df.dtypes:
        expected = {same[dtype], "HUGEINT"} if dtype == "bigint" else {same[dtype]}
        assert types[column] in expected | ({"INTEGER"} if dtype == "bigint" else set()), column


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["channel", "AI_Category", "messages", "top_keywords"] and df.count() > 0
