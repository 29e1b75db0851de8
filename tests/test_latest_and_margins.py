"""Winners packed in longs and decimals, drugs with their quarter, and margins that stay off the driver."""

import pytest
from pyspark.sql import functions as F

from oddspark.operators import dedupe
from oddspark.operators.upsert import with_keys, without_keys
from oddspark.plans import background as B
from oddspark.plans import signals as G


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_usual_ids_make_a_long_and_all_others_win_or_lose_as_before(spark):
    ids = [None, -2**63, -5, -1, 0, 7, 2**41 - 1, 2**41, 2**63 - 1]
    versions = [None, -2**31, -1, 0, 3, 2**22 - 2, 2**22 - 1, 2**31 - 1]
    ranked = sorted(((v is None, v or 0, p is not None, p or 0), p, v) for v in versions for p in ids)
    # Every case holds two rows, so that each pair of kinds meets once.
    rows, want = [], {}
    for i, (a, p, v) in enumerate(ranked):
        for j, (b, q, w) in enumerate(ranked[:i + 1]):
            case = i * 100 + j
            rows += [(p, case, v, "Q"), (q, case, w, "Q")]
            want[case] = (p, v)
    demo = spark.createDataFrame(rows, "primaryid long, caseid long, caseversion int, faers_quarter string")
    for scope in ("quarter", "all"):
        got = {r.caseid: (r.primaryid, r.caseversion) for r in dedupe.dedupe_latest_version(
            demo.drop("faers_quarter") if scope == "all" else demo, scope).collect()}
        assert got == want
    usual = demo.filter("primaryid between 0 and 9 and caseversion between 0 and 9")
    packed = usual.agg(F.max(dedupe._long_packed()).alias("small"), F.max(F.when(~dedupe._fits_long(), 1)).alias("wide"))
    assert packed.first() == (3 * 2**41 + 7, None)


@pytest.mark.parametrize("tied", [False, True])
def test_stored_counts_equal_the_plan_with_repeated_reports(spark, tmp_path, rows, tied):
    """A report of two quarters, and of two cases in one, counts as often as the lazy plan counts it."""
    demo = spark.createDataFrame(
        [(1, 1, 1, "Q1"), (1, 2, 1, "Q1"), (1, 1, 2, "Q2"), (2, 3, 1, "Q1"), (3, 4, None, None), (None, 5, 1, "Q1")],
        "primaryid long, caseid long, caseversion int, faers_quarter string")
    keys = [(1, "Q1"), (1, "Q2"), (2, "Q1"), (3, None), (None, "Q1"), (9, "Q1")]
    drug = spark.createDataFrame([(p, d, "", "PS", q) for p, q in keys for d in "ABA"],
                                 "primaryid long, drugname string, prod_ai string, role_cod string, faers_quarter string")
    reac = spark.createDataFrame([(p, e, q) for p, q in keys for e in ("x", "y", "x", None)],
                                 "primaryid long, pt string, faers_quarter string")
    if not tied:
        drug, reac = drug.drop("faers_quarter"), reac.drop("faers_quarter")
    want = B.build_background(demo, drug, reac)
    got = B.write_background(demo, drug, reac, str(tmp_path / "b"))
    for table in B.TABLES:
        columns = getattr(want, table).columns
        assert rows(getattr(got, table), *columns) == rows(getattr(want, table), *columns), table
    valid = dedupe.valid_reports(demo)
    again = B.write_background(demo, drug, reac, str(tmp_path / "c"), valid=valid)
    for table in B.TABLES:
        assert rows(getattr(again, table)) == rows(getattr(got, table)), table
    assert valid.count() == 6


def test_margins_and_keys_meet_by_merge(spark):
    counts = spark.createDataFrame([("a", "x", "Q1", 5), ("b", "x", "Q1", 4)],
                                   "drug_key string, event_pt string, faers_quarter string, n_reports long")
    held = B.Background(
        quarter_totals=counts.groupBy("faers_quarter").agg(F.sum("n_reports").alias("n_reports")),
        drug_totals=counts.drop("event_pt"), event_totals=counts.drop("drug_key"), drug_event_counts=counts)
    signals = G.scan_signals(held)
    assert "Broadcast" not in plan(signals) and signals.count() == 2
    ids, some = spark.range(9), spark.range(3, 5)
    for df in (with_keys(ids, some, ["id"]), without_keys(ids, some, ["id"])):
        assert "Broadcast" not in plan(df)
    assert (with_keys(ids, some, ["id"]).count(), without_keys(ids, some, ["id"]).count()) == (2, 7)
