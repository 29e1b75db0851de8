"""Cases that earlier versions got wrong."""

import pytest
from pyspark.sql import functions as F

from oddspark.functions import demographics
from oddspark.functions.metrics import FLAGS, METRICS
from oddspark.operators import upsert
from oddspark.plans import background as B
from oddspark.plans import search, validation
from oddspark.sources import delimited, tables


def test_java_suffixes_are_no_numbers(spark):
    df = spark.createDataFrame([("12d",), ("5F",), (" 7.5 ",), ("1e3",), (".5",), (None,)], "v string")
    got = [r[0] for r in df.select(demographics.lenient_cast(F.col("v"), "double")).collect()]
    assert got == [None, None, 7.5, 1000.0, 0.5, None]


def test_a_backslash_in_a_key_stands_for_itself(spark):
    df = spark.createDataFrame([("INSULIN GLARGINE\\LIXISENATIDE",), ("INSULIN",)], "v string")
    hit = demographics.like_contains_ci([F.col("v")], "glargine\\lixi")[0]
    assert df.where(hit).count() == 1


def test_all_parts_of_a_quarter_are_read_below_paths_and_uris(spark, tmp_path):
    for quarter in ("2024q1", "2024q2"):
        folder = tmp_path / quarter / "ascii"
        folder.mkdir(parents=True)
        for part in "ab":
            (folder / f"DEMO_{part}.txt").write_text(f"primaryid$x\n{part}$2\n")
    for root in (str(tmp_path), f"file://{tmp_path}"):
        demo = delimited.parse_quarters(spark, root)["demo"]
        counts = {r["faers_quarter"]: r["count"] for r in demo.groupBy("faers_quarter").count().collect()}
        assert counts == {"2024q1": 2, "2024q2": 2}


DEMO = "primaryid long, caseid long, caseversion int, faers_quarter string"
DRUG = "primaryid long, drugname string, prod_ai string, role_cod string, faers_quarter string"
REAC = "primaryid long, pt string, faers_quarter string"


def test_a_rerun_leaves_no_stale_counts(spark, tmp_path, rows):
    demo = spark.createDataFrame([(1, 1, 1, "Q1"), (2, 2, 1, "Q2")], DEMO)
    drug = spark.createDataFrame([(1, "A", "A", "PS", "Q1"), (2, "A", "A", "PS", "Q2")], DRUG)
    reac = spark.createDataFrame([(1, "Ileus", "Q1"), (2, "Ileus", "Q2")], REAC)
    B.write_background(demo, drug, reac, str(tmp_path))
    later = drug.withColumn("role_cod", F.when(F.col("primaryid") == 1, "C").otherwise("PS"))
    again = B.write_background(demo.where("faers_quarter = 'Q1'"), later, reac, str(tmp_path))
    assert rows(again.quarter_totals, "faers_quarter", "n_reports") == [("Q1", 1), ("Q2", 1)]
    assert rows(again.drug_totals, "faers_quarter", "n_reports") == [("Q2", 1)]
    assert rows(again.drug_event_counts, "faers_quarter", "n_reports") == [("Q2", 1)]


def test_a_case_that_moved_counts_once(spark, tmp_path, rows):
    demo = spark.createDataFrame([(11, 1, 1, "Q1"), (12, 1, 2, "Q2")], DEMO)
    drug = spark.createDataFrame([(11, "A", "A", "PS", "Q1"), (12, "A", "A", "PS", "Q2")], DRUG)
    reac = spark.createDataFrame([(11, "Ileus", "Q1"), (12, "Ileus", "Q2")], REAC)
    B.write_background(demo.where("faers_quarter = 'Q1'"), drug, reac, str(tmp_path), "all")
    both = B.write_background(demo, drug, reac, str(tmp_path), "all")
    assert rows(both.quarter_totals, "faers_quarter", "n_reports") == [("Q2", 1)]
    assert rows(both.drug_totals, "faers_quarter", "n_reports") == [("Q2", 1)]
    with pytest.raises(ValueError):
        B.write_background(demo.where("faers_quarter = 'Q1'"), drug, reac, str(tmp_path), "all")


def test_items_with_a_shared_or_missing_id_stay_apart(spark):
    fixture = spark.createDataFrame(
        [("k", "a", ["x"], 2020, "s"), ("k", "b", ["x"], 2020, "s"), (None, "a", ["x"], 2020, "s")],
        "id string, drug string, event_pts array<string>, year int, literature_source string")
    numbers = ", ".join(f"cast(2 as double) as {m}" for m in METRICS)
    flags = ", ".join(f"true as {f}" for f in FLAGS)
    signals = spark.sql(f"SELECT 'a' AS drug_key, 'x' AS event_pt, 5L AS a, {numbers}, {flags}")
    got = validation.validate_known_signals(fixture, signals).collect()
    assert sorted(((r["id"] or "", r["drug"], r["found"]) for r in got)) == [
        ("", "a", True), ("k", "a", True), ("k", "b", False)]


def test_equal_search_texts_have_rankings_of_their_own(spark):
    corpus = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "pt string, embedding array<float>")
    queries = spark.createDataFrame([("q", [1.0, 0.1]), ("q", [0.1, 1.0])], "query string, vector array<float>")
    best = search.semantic_event_search(corpus, queries, 2, -1.0).collect()
    assert sorted((r["pt"], r["rank"]) for r in best) == [("x", 1), ("x", 2), ("y", 1), ("y", 2)]
    named = queries.withColumn("query_id", F.monotonically_increasing_id())
    assert {r["query_id"] for r in search.semantic_event_search(corpus, named, 1, -1.0).collect()} == {
        r["query_id"] for r in named.collect()}


def test_the_winner_among_duplicates_is_determined(spark, rows):
    stored = spark.createDataFrame([(1, 0, "old")], "k int, t int, v string")
    new = spark.createDataFrame([(1, 2, "a"), (1, 1, "z"), (2, 2, "b"), (2, 1, "c")], stored.schema)
    for df in (new, new.orderBy("t").coalesce(1)):
        assert rows(upsert.upsert_by_key(stored, df, ["k"], ["t"])) == [(1, 2, "a"), (2, 2, "b")]
        assert rows(upsert.insert_ignore(stored, df, ["k"], ["t"])) == [(1, 0, "old"), (2, 1, "c")]
        assert rows(upsert.upsert_by_key(stored, df, ["k"], ["v"])) == [(1, 1, "z"), (2, 1, "c")]


def test_tables_without_listed_columns_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        tables.publish_reconciled({"other": spark.range(1)}, str(tmp_path), {"child": ["id"]})
    with pytest.raises(ValueError):
        tables.publish_reconciled({}, str(tmp_path), {"child": ["id"]})
