"""What is stored by report joins and counts by report without a shuffle, with the same rows."""

from pyspark.sql import functions as F

from oddspark.operators.pairing import join_within
from oddspark.plans.cohort import write_cohort
from oddspark.sources.bucketed import drop_kept, keep_by_report, read_kept
from oddspark.sources.fixtures import inline_dictionary


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_written_cohort_lies_by_report(spark, tmp_path):
    demo = spark.createDataFrame(
        [(i, i, 1, "20240101", "20240101", "40", "YR", "F", "US", "us", "1", "2024Q1") for i in range(1, 9)],
        "primaryid long, caseid long, caseversion int, event_dt string, fda_dt string, age string, age_cod string,"
        " sex string, reporter_country string, occr_country string, rept_cod string, faers_quarter string")
    drug = spark.createDataFrame(
        [(1, "1", "PS", "ozempic", None, "oral", "1", "MG"), (1, "1", "PS", "ozempic", None, "oral", "1", "MG"),
         (2, "1", "PS", "aspirin", "", "oral", "x", "MG"), (3, "2", "C", "other", "Ozempic 1 mg", "oral", "1", "MG"),
         (None, "1", "PS", "ozempic", None, "oral", "1", "MG"), (99, "1", "PS", "ozempic", None, "oral", "1", "MG")],
        "primaryid long, drug_seq string, role_cod string, drugname string, prod_ai string, route string,"
        " dose_amt string, dose_unit string")
    reac = spark.createDataFrame([(1, "a", None), (1, "a", None), (2, "b", None), (3, None, None), (None, "c", None)],
                                 "primaryid long, pt string, drug_rec_act string")
    outc = spark.createDataFrame([(1, "DE"), (2, "OT"), (3, "HO")], "primaryid long, outc_cod string")
    indi = spark.createDataFrame([(1, "1", "x"), (3, "2", "y")], "primaryid long, indi_drug_seq string, indi_pt string")
    members = inline_dictionary(spark, [("semaglutide", ["Ozempic"], "both")])
    cohort = write_cohort(demo, drug, reac, outc, indi, members, str(tmp_path))
    for table in (cohort.drugs, cohort.reactions, cohort.outcomes, cohort.indications):
        assert "Exchange" not in plan(table.groupBy("primaryid").agg(F.count(F.lit(1))))
    assert sorted(r.primaryid for r in cohort.drugs.collect()) == [1, 1, 3]
    assert sorted((r.primaryid, r.pt) for r in cohort.reactions.collect()) == [(1, "a"), (1, "a")]
    assert sorted(r.primaryid for r in cohort.reports.collect()) == [1, 3]
    assert spark.read.parquet(f"{tmp_path}/drugs").count() == 3


def test_join_within_of_stored_tables_moves_only_the_cells(spark, tmp_path):
    left = spark.range(300).select((F.col("id") % 7).alias("primaryid"), F.col("id").alias("d"))
    left = left.unionByName(spark.createDataFrame([(None, 1), (50, 2)], "primaryid long, d long"))
    right = spark.range(200).select((F.col("id") % 9).alias("primaryid"), F.col("id").alias("e"))
    kept = [keep_by_report(df, f"{tmp_path}/{name}", ["primaryid"], gather=True) for name, df in (("l", left), ("r", right))]
    for cell_rows in (10, 1000):
        joined = join_within(*kept, ["primaryid"], "d", "e", cell_rows)
        shuffles = [line for line in plan(joined).splitlines() if "Exchange" in line]
        assert shuffles and all("REBALANCE" in x or "_left_cell" in x for x in shuffles)
        expected = left.join(right, "primaryid")
        assert joined.count() == expected.count()
        assert joined.exceptAll(expected).isEmpty()
    assert read_kept(spark, f"{tmp_path}/l").count() == 302
    drop_kept(spark, f"{tmp_path}/l")
    assert not (tmp_path / "l").exists()
