"""Every registered query against its SQL on the smallest data folder."""

import math
import os

import pytest

import __spark_entry__ as entry
from oddspark.checks import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def sql():
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return db


def canonical(names, table):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [
        tuple(None if isinstance(v, float) and math.isnan(v) else v
              for v in (row[i] for i in order))
        for row in table
    ]
    return sorted(names), sorted(plain, key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, sql, name):
    df = entry.queries()[name](spark, FOLDER)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    result = sql.execute(entry.oracle_sql()[name])
    want = canonical([c[0] for c in result.description], result.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) > 0
    assert got[1] == want[1]


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["drug_key", "event_pt"] and df.count() > 0


def test_every_query_but_the_encoder_search_has_sql():
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"term_search_by_text"}
    assert set(registry.QUERIES) <= set(entry.queries())
