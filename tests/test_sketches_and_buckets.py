import pytest
from pyspark.sql import functions as F

from oddspark.plans import dashboard, sketches
from oddspark.sources import bucketed

VALID = "primaryid long, faers_quarter string"


def test_sketches_unite_terms_and_quarters(spark, tmp_path):
    valid = spark.range(4000).select(
        F.col("id").alias("primaryid"), F.concat(F.lit("2024Q"), 1 + F.col("id") % 2).alias("faers_quarter"))
    # Term a: reports 0..2999, term b: 1000..3999, so 4000 of either but 6000 counts.
    pairs = (valid.filter("primaryid < 3000").select("primaryid", F.lit("a").alias("event_pt"))
             .unionByName(valid.filter("primaryid >= 1000").select("primaryid", F.lit("b").alias("event_pt"))))
    pairs = pairs.unionByName(spark.createDataFrame([(1, None), (99999, "a")], "primaryid long, event_pt string"))
    path = str(tmp_path / "s")
    stored = sketches.write_sketches(pairs, valid, "event_pt", path)
    assert stored.count() == 4
    bound = 5 * sketches.relative_error()
    per_term = {r.event_pt: r.n_estimated for r in sketches.estimated_reports(stored, "event_pt").collect()}
    assert set(per_term) == {"a", "b"}
    assert all(abs(n - 3000) <= bound * 3000 for n in per_term.values())
    assert abs(sketches.estimated_reports(stored).first()[0] - 4000) <= bound * 4000
    one_quarter = sketches.estimated_reports(stored.filter("faers_quarter = '2024Q1'")).first()[0]
    assert abs(one_quarter - 2000) <= bound * 2000
    groups = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y"), ("never", "z"), ("a", None)],
                                   "event_pt string, grp string")
    of = {r.grp: r.n_estimated for r in
          sketches.estimated_reports_of(stored, groups, "event_pt", "grp").collect()}
    assert set(of) == {"x", "y", "z", None} and of["z"] == 0
    assert abs(of["x"] - 4000) <= bound * 4000 and abs(of[None] - 3000) <= bound * 3000
    # A load of one quarter replaces that quarter and no other; a second run changes nothing.
    later = valid.filter("faers_quarter = '2024Q2'").limit(100)
    for _ in range(2):
        stored = sketches.write_sketches(pairs, later, "event_pt", path)
        n = sketches.estimated_reports(stored).first()[0]
        assert 2000 * (1 - bound) <= n <= 2100 * (1 + bound)


def test_sketches_of_nothing(spark):
    none = spark.createDataFrame([], "primaryid long, event_pt string")
    made = sketches.report_sketches(none, spark.createDataFrame([], VALID), "event_pt")
    assert made.count() == 0
    assert sketches.estimated_reports(made, "event_pt").count() == 0
    assert sketches.estimated_reports(made).first()[0] == 0


def test_sketches_reduce_before_the_shuffle(spark):
    valid = spark.createDataFrame([(1, "2024Q1")], VALID)
    pairs = spark.createDataFrame([(1, "a")], "primaryid long, event_pt string")
    plan = sketches.report_sketches(pairs, valid, "event_pt")._jdf.queryExecution().executedPlan().toString()
    assert "partial_hll_sketch_agg" in plan


@pytest.fixture
def by_report(spark, tmp_path):
    reports = spark.createDataFrame([(k,) for k in [*range(1, 50), 7, None]], "primaryid long")
    drug = spark.createDataFrame(
        [(k % 40, f"d{k}") for k in range(200)] + [(7, "hot")] * 500 + [(None, "x"), (1000, "y")],
        "primaryid long, drugname string")
    reac = spark.createDataFrame([], "primaryid long, pt string")
    label = tmp_path.name.replace("-", "_")
    tables = {"reports": reports, "drug": drug, "reac": reac}
    yield tmp_path, label, {
        n: bucketed.write_by_report(df, f"{n}_{label}", str(tmp_path / n), 8) for n, df in tables.items()}
    for n in tables:
        spark.sql(f"DROP TABLE IF EXISTS {n}_{label}")


def test_rows_per_report_need_no_shuffle(spark, by_report):
    _, _, t = by_report
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        counted = bucketed.rows_per_report(t["reports"], {"n_drugs": t["drug"], "n_reactions": t["reac"]})
        plan = counted._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Bucketed: true" in plan
        got = {r.primaryid: (r.n_drugs, r.n_reactions) for r in counted.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {k: ((5 if k < 40 else 0) + (500 if k == 7 else 0), 0) for k in range(1, 50)}
    semi = t["drug"].hint("merge").join(t["reports"], "primaryid", "left_semi")
    assert "Exchange" not in semi._jdf.queryExecution().executedPlan().toString()
    assert semi.count() == 39 * 5 + 500


def test_bucketed_tables_open_in_another_catalog(spark, by_report):
    folder, label, t = by_report
    want = sorted(map(tuple, t["drug"].collect()), key=repr)
    spark.sql(f"DROP TABLE drug_{label}")
    opened = bucketed.open_by_report(spark, f"drug_{label}", str(folder / "drug"))
    assert sorted(map(tuple, opened.collect()), key=repr) == want
    described = {r[0]: r[1] for r in spark.sql(f"DESCRIBE FORMATTED drug_{label}").collect()}
    assert described["Num Buckets"] == "8" and described["Bucket Columns"] == "[`primaryid`]"
    with pytest.raises(ValueError):
        bucketed.open_by_report(spark, f"none_{label}", str(folder / "nowhere"))


def test_ingredient_distribution(spark):
    drugs = spark.createDataFrame(
        [(1, "s"), (1, "s"), (2, "s"), (2, "t"), (3, None)], "primaryid long, active_ingredient string")
    got = [tuple(r) for r in dashboard.ingredient_distribution(drugs).collect()]
    assert got == [("s", 3, 2), ("t", 1, 1)]
    assert len(dashboard.ingredient_distribution(drugs, 1).collect()) == 1
