import datetime
import json
from types import SimpleNamespace

import pytest

from oddspark import schemas
from oddspark.sources import fixtures, tables
from oddspark.workspace import shared_folder


def test_append_and_overwrite(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (2, "")], "n long, s string")
    tables.append_table(df, path, ["s", "n"])
    tables.append_table(df, path, ["s", "n"])
    stored = spark.read.parquet(path)
    assert stored.columns == ["s", "n"]
    assert rows(stored) == sorted([("a", 1), ("a", 1), (None, 2), (None, 2)], key=repr)
    tables.overwrite_table(df, path)
    tables.overwrite_table(df, path)
    assert spark.read.parquet(path).count() == 2


def test_quarters_are_replaced_alone(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    both = spark.createDataFrame([(1, "2024Q1"), (2, "2024Q2")], "n long, faers_quarter string")
    tables.write_parquet(both, path)
    tables.write_parquet(spark.createDataFrame([(9, "2024Q2")], both.schema), path)
    assert rows(spark.read.parquet(path)) == [(1, "2024Q1"), (9, "2024Q2")]


def test_insert_ignore_twice(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([("a", 1)], "k string, v long")
    second = spark.createDataFrame([("a", 2), ("b", 3)], "k string, v long")
    for df in (first, second, second):
        tables.insert_ignore_table(df, path, ["k"])
    assert rows(spark.read.parquet(path)) == [("a", 1), ("b", 3)]


def test_upsert_writes_beside(spark, tmp_path, rows):
    one, two = str(tmp_path / "v1"), str(tmp_path / "v2")
    first = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v long")
    tables.upsert_table(first, str(tmp_path / "none"), one, ["k"])
    tables.upsert_table(spark.createDataFrame([("b", 2)], first.schema), one, two, ["k"])
    assert rows(spark.read.parquet(one)) == [("a", 1), ("b", 1)]
    assert rows(spark.read.parquet(two)) == [("a", 1), ("b", 2)]
    with pytest.raises(ValueError):
        tables.upsert_table(first, one, one + "/", ["k"])


def test_publish(spark, tmp_path, rows):
    columns = {"parent": ["n"], "child": ["n", "s"], "absent": ["x"]}
    source = spark.createDataFrame([(1, "a"), (2, "b")], "n long, s string")
    report = tables.publish_reconciled({"child": source, "parent": source}, str(tmp_path), columns)
    assert rows(report) == [("child", 2, 2, "OK"), ("parent", 2, 2, "OK")]
    empty = source.filter("n > 5")
    report = tables.publish_reconciled({"child": empty}, str(tmp_path), columns)
    assert rows(report) == [("child", 0, 2, "SKIPPED")]
    assert spark.read.parquet(f"{tmp_path}/parent").columns == ["n"]


def test_json_rows(spark):
    df = spark.createDataFrame([(1, None, datetime.date(2024, 1, 2))], "n long, s string, d date")
    assert json.loads(tables.rows_to_json(df).first()[0]) == {"n": 1, "s": None, "d": "2024-01-02"}


def test_fixtures(spark, tmp_path):
    path = str(tmp_path / "known")
    known = fixtures.known_signals(spark)
    assert known.count() == 11 and known.schema == schemas.KNOWN_SIGNALS
    tables.json_report_sink(known, path)
    again = fixtures.load_fixture(spark, path, schemas.KNOWN_SIGNALS)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, known.collect()))


@pytest.mark.parametrize("master", ["local-cluster[2,1,1024]", "spark://host:7077", "yarn"])
def test_a_cluster_needs_a_shared_folder(master):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda name, default: default))
    with pytest.raises(RuntimeError):
        shared_folder(session)
