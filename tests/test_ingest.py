"""Files by name, one scan per header, rejected rows, unreadable files, and counts taken on the way."""

import gzip

import pytest
from pyspark.sql import functions as F

from oddspark.sources import delimited, tables
from oddspark.sources.versions import Store


@pytest.fixture
def raw(tmp_path):
    def put(name, text):
        path = tmp_path / "raw" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())
        return path

    put("2024Q1/ascii/DRUG24Q1.txt", "PRIMARYID$DRUGNAME\n1$A\n2$B\n")
    put("2024Q1/ascii/DRUGS_README.txt", "how to read\nthese files\n")
    put("2024Q2/DRUG24Q2 a+b.txt", "PRIMARYID$DRUGNAME\n3$C\n")
    put("2024Q3/DRUG.txt", "DRUGNAME$PRIMARYID$EXTRA\nD$4$x\n")
    put("2024Q1/REAC24Q1.txt", 'PRIMARYID$PT\n1$"a$b"\n2\n3$x$y\n4$z\n')
    put("2024Q2/OUTC24Q2.txt", "")
    put("2024Q2/REAC24Q2.txt.gz", gzip.compress(b"PRIMARYID$PT\n5$q\n"))
    return str(tmp_path / "raw"), put


def test_a_table_is_told_by_its_whole_name(spark, raw):
    found = [r["path"].rsplit("/", 1)[-1] for r in delimited.discover_table_files(spark, raw[0]).collect()]
    assert sorted(found) == ["DRUG.txt", "DRUG24Q1.txt", "DRUG24Q2 a+b.txt", "OUTC24Q2.txt", "REAC24Q1.txt"]


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_files_are_read_in_one_scan_per_header(spark, raw, rows, scheme):
    parsed = delimited.parse_quarters(spark, scheme + raw[0])
    assert set(parsed) == {"drug", "reac"}
    drug = parsed["drug"]
    assert rows(drug, "primaryid", "drugname", "extra", "faers_quarter") == [
        (1, "A", None, "2024Q1"), (2, "B", None, "2024Q1"), (3, "C", None, "2024Q2"), (4, "D", "x", "2024Q3")]
    assert drug._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2
    assert rows(parsed["reac"], "primaryid", "pt") == [(1, "a$b"), (2, None), (3, "x"), (4, "z")]


def test_many_files_make_as_many_branches_as_headers(spark, raw):
    root, put = raw
    for k in range(60):
        put(f"2025Q{k % 4 + 1}/DRUG_{k}.txt", f"PRIMARYID$DRUGNAME\n{100 + k}$X\n")
    drug = delimited.parse_quarters(spark, root)["drug"]
    assert drug._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2 and drug.count() == 64


def test_a_profile_has_a_row_for_every_file(spark, raw):
    root, put = raw
    put("2024Q4/DRUG24Q4.txt.gz", b"this is not compressed")
    put("2024Q4/OUTC24Q4.txt", "PRIMARYID$OUTC_COD\n")
    for suffix in (".txt", ".gz"):
        found = {r["file"].rsplit("/", 1)[-1]: r for r in delimited.profile_files(spark, root, suffix=suffix).collect()}
        if suffix == ".gz":
            assert found["DRUG24Q4.txt.gz"].status == "UNREADABLE" and found["DRUG24Q4.txt.gz"].n_rows is None
            assert (found["REAC24Q2.txt.gz"].status, found["REAC24Q2.txt.gz"].n_rows) == ("OK", 1)
            continue
        assert {n: r.status for n, r in found.items()} == {
            "DRUG.txt": "OK", "DRUG24Q1.txt": "OK", "DRUG24Q2 a+b.txt": "OK", "OUTC24Q2.txt": "EMPTY",
            "OUTC24Q4.txt": "OK", "REAC24Q1.txt": "REJECTS"}
        reac = found["REAC24Q1.txt"]
        assert (reac.n_rows, reac.n_short, reac.n_surplus, reac.n_columns) == (4, 1, 1, 2)
        assert reac.first_columns == ["primaryid", "pt"] and found["OUTC24Q4.txt"].n_rows == 0
        assert found["OUTC24Q2.txt"].n_columns == 0 and found["DRUG24Q2 a+b.txt"].n_rows == 1
    assert delimited.profile_source({}).count() == 0
    assert delimited.profile_files(spark, root, ["NONE"]).count() == 0


def test_all_tables_come_in_at_once(spark, raw, tmp_path, rows):
    path = str(tmp_path / "store")
    report = delimited.ingest(spark, raw[0], path)
    assert rows(report, "table_name", "n_files", "n_rows", "n_rejected", "status") == sorted([
        ("demo", 0, 0, 0, "MISSING"), ("drug", 3, 4, 0, "OK"), ("reac", 1, 4, 2, "REJECTS"), ("outc", 1, 0, 0, "EMPTY"),
        ("indi", 0, 0, 0, "MISSING"), ("rpsr", 0, 0, 0, "MISSING"), ("ther", 0, 0, 0, "MISSING")])
    store = Store(spark, path)
    assert store.numbers() == [1] and set(store.manifest().tables) == {"drug", "reac"}
    assert rows(store.read("drug"), "primaryid", "faers_quarter")[0] == (1, "2024Q1")


def test_each_published_source_is_computed_once(spark, tmp_path, rows):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    source = spark.range(50).mapInArrow(count, "id long")
    columns = {"child": ["id"], "parent": ["id"]}
    report = tables.publish_reconciled({"child": source}, str(tmp_path), columns)
    assert rows(report) == [("child", 50, 50, "OK")] and seen.value == 50
    empty = source.filter(F.col("id") < 0)
    assert rows(tables.publish_reconciled({"child": empty}, str(tmp_path), columns)) == [("child", 0, 50, "SKIPPED")]
