"""Every query of the core library against its SQL on DuckDB."""

import datetime
import math
import os

import pytest

from wayfold.plans import catalogue

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def store():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.all_sql()))
def test_query_equals_its_sql(spark, store, name):
    df = catalogue.all_queries()[name](spark, DATA)
    answer = store.execute(catalogue.all_sql()[name])
    columns = [c[0] for c in answer.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, answer.fetchall())


def test_queries_without_sql_have_rows(spark):
    for name in sorted(set(catalogue.all_queries()) - set(catalogue.all_sql())):
        assert not catalogue.all_queries()[name](spark, DATA).isEmpty()
