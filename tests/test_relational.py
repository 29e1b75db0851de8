import random
from collections import Counter

from pyspark.sql import functions as F

from oddspark.operators.dedupe import dedupe_latest_version, report_events, valid_reports
from oddspark.operators.pairing import join_within
from oddspark.operators.ranking import forest_rows, rank_by_ic, top_n, top_n_per
from oddspark.operators.upsert import insert_ignore, upsert_by_key

DEMO = "primaryid long, caseid long, caseversion int, faers_quarter string, sex string"


def test_latest_version(spark, rows):
    demo = spark.createDataFrame([
        (11, 1, 1, "2024Q1", "F"), (12, 1, 2, "2024Q1", "F"), (13, 1, 3, "2024Q2", "F"),
        (21, 2, None, "2024Q1", "M"), (22, 2, 9, "2024Q1", "M"),
        (31, 3, 1, "2024Q1", "F"), (32, 3, 1, "2024Q1", None),
        (41, None, 1, "2024Q1", "F"), (42, None, 2, "2024Q1", "F"),
    ], DEMO)
    latest = dedupe_latest_version(demo)
    assert latest.columns == demo.columns
    assert [r[0] for r in rows(latest, "primaryid")] == [12, 13, 21, 32, 42]
    every = dedupe_latest_version(demo, scope="all")
    assert [r[0] for r in rows(every, "primaryid")] == [13, 21, 32, 42]


def test_latest_version_reduces_before_the_shuffle(spark):
    demo = spark.range(100000).select(
        F.col("id").alias("primaryid"), F.lit(1).cast("long").alias("caseid"),
        F.lit(1).alias("caseversion"), F.lit("2024Q1").alias("faers_quarter"),
    )
    latest = dedupe_latest_version(demo)
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan and "Window" not in plan
    assert latest.first()["primaryid"] == 99999


def test_version_and_id_travel_as_one_number(spark):
    low, high = -(2**63), 2**63 - 1
    demo = spark.createDataFrame([
        (high, 1, 2**31 - 1, "2024Q1", ""), (low, 1, None, "2024Q1", ""),
        (low, 2, -(2**31), "2024Q1", ""), (None, 2, -(2**31), "2024Q1", ""),
        (None, 3, None, "2024Q1", ""), (0, 4, 0, "2024Q1", ""), (-1, 4, 0, "2024Q1", ""),
        (5, 5, -1, "2024Q1", ""), (9, 5, -2, "2024Q1", ""), (high, 6, None, None, ""), (5, None, 1, None, ""),
    ], DEMO)
    narrow = demo.drop("sex")
    found = dedupe_latest_version(narrow).collect()
    assert Counter(found) == Counter(dedupe_latest_version(demo).drop("sex").collect())
    assert {case: (report, version) for report, case, version, _ in found} == {
        1: (low, None), 2: (low, -(2**31)), 3: (None, None), 4: (0, 0), 5: (5, -1), 6: (high, None), None: (5, 1)}
    plan = valid_reports(demo)._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "partial_max" in plan


def _brute(left, right):
    return Counter((k, a, b) for k, a in left for k2, b in right if k == k2)


def test_join_within_equals_the_plain_join(spark):
    rng = random.Random(1)
    left = [(rng.choice([1, 1, 1, 2, 3, 4]), f"d{rng.randint(0, 30)}") for _ in range(120)]
    right = [(rng.choice([1, 1, 2, 5]), f"e{rng.randint(0, 30)}") for _ in range(90)]
    l = spark.createDataFrame(left, "k long, a string")
    r = spark.createDataFrame(right, "k long, b string")
    for cell_rows in (1, 4, 7, 1000):
        found = Counter(tuple(x) for x in join_within(l, r, ["k"], "a", "b", cell_rows).collect())
        assert found == _brute(left, right)


def test_join_within_mixes_small_and_large_keys_null_keys_and_kept_ones(spark):
    left = [(k, f"d{i}") for k in (1, 2, 3, 4, None) for i in range(9 if k == 2 else 2)]
    right = [(k, f"e{i}") for k in (1, 2, 3, 5, None) for i in range(8 if k == 3 else 2)]
    l = spark.createDataFrame(left, "k long, a string")
    r = spark.createDataFrame(right, "k long, b string")
    kept = spark.createDataFrame([(2, "x"), (3, "y"), (5, "z")], "k long, q string")
    found = join_within(l, r, ["k"], "a", "b", 4, per_key=kept).select("k", "a", "b", "q").collect()
    names = {2: "x", 3: "y"}
    assert Counter(map(tuple, found)) == Counter(
        (k, a, b, names[k]) for (k, a, b) in _brute(left, right).elements() if k in names)


def test_join_within_spreads_one_large_key(spark):
    left = spark.range(600).select(F.lit(7).alias("k"), F.col("id").cast("string").alias("a"))
    right = spark.range(500).select(F.lit(7).alias("k"), F.col("id").cast("string").alias("b"))
    joined = join_within(left, right, ["k"], "a", "b", cell_rows=50)
    per_task = joined.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in per_task) == 600 * 500
    assert joined.distinct().count() == 600 * 500
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        per_task = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(per_task) >= 6 and max(per_task) < 600 * 500 / 2


def test_events_are_distinct_and_not_empty(spark, rows):
    reac = spark.createDataFrame(
        [(1, "a"), (1, "a"), (1, ""), (1, None), (2, "a")], "primaryid long, pt string")
    assert rows(report_events(reac)) == [(1, "a"), (2, "a")]


def test_upsert_and_insert(spark, rows):
    stored = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C"), (3, "C")], "k long, v string")
    assert rows(upsert_by_key(stored, new, ["k"])) == [(1, "a"), (2, "B"), (3, "C")]
    assert rows(insert_ignore(stored, new, ["k"])) == [(1, "a"), (2, "b"), (3, "C")]
    assert rows(insert_ignore(stored, stored, ["k"])) == rows(stored)


def test_orders_and_ties(spark):
    df = spark.createDataFrame(
        [("x", "b", 1.0, 5.0), ("x", "a", 1.0, 4.0), ("x", "c", None, 3.0), ("x", "d", 2.0, 9.0)],
        "drug_key string, event_pt string, ic double, ror double",
    )
    assert [r["event_pt"] for r in rank_by_ic(df).collect()] == ["d", "a", "b", "c"]
    assert [r["event_pt"] for r in forest_rows(df, 3).collect()] == ["a", "b", "d"]
    assert [r["event_pt"] for r in top_n(df, "ic", 2, "event_pt").collect()] == ["d", "a"]
    best = top_n_per(df, "drug_key", "ic", 3, "event_pt")
    assert [r["event_pt"] for r in best.orderBy("rank").collect()] == ["d", "a", "b"]
    assert "WindowGroupLimit" in best._jdf.queryExecution().executedPlan().toString()
