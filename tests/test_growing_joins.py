"""Joins of tables that grow with the input: never by broadcast, and on keys that spread."""

from oddspark.checks.star import Star
from oddspark.functions.names import build_matcher
from oddspark.operators.matching import add_member_by_name, add_member_by_product, class_names, class_products
from oddspark.plans.cohort import in_cohort


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_and_parts_meet_by_merge_and_quarters_come_before_the_texts(spark, tmp_path):
    tables = {
        "part": "SELECT 1L p_partkey, 'a' p_name, 'Brand#1' p_brand, 'T' p_type, 5 p_size",
        "lineitem": "SELECT 1L l_orderkey, 1L l_partkey, 1 l_linenumber, 'A' l_returnflag, 'O' l_linestatus",
        "orders": "SELECT 1L o_orderkey, 1L o_custkey, 'F' o_orderstatus, TIMESTAMP'1998-02-03' o_orderdate, '1-U' o_orderpriority",
    }
    for name, sql in tables.items():
        spark.sql(sql).write.parquet(str(tmp_path / f"{name}.parquet"))
    star = Star(spark, str(tmp_path))
    for df in (star.drug, star.reac, star.indi, star.with_quarter("drug"), star.with_quarter("outc"),
               in_cohort(star.reac, star.demo_core)):
        assert "SortMergeJoin" in plan(df) and "Broadcast" not in plan(df)
    row = star.with_quarter("drug").first()
    assert star.with_quarter("drug").columns == [*star.drug.columns, "faers_quarter"]
    assert (row.primaryid, row.drugname, row.faers_quarter) == (1, "BRAND#1 (A) 5 MG INJ", "1998Q1")


def test_products_are_joined_on_both_names(spark):
    rows = [(k, n, a) for k, (n, a) in enumerate([
        ("WIDGET X", ""), ("WIDGET X", None), (None, "widget"), (None, None), ("other", ""), ("other", "widget 5 mg"), ("", "")] * 2)]
    drug = spark.createDataFrame(rows, "primaryid long, drugname string, prod_ai string")
    matcher = build_matcher(spark.createDataFrame(
        [("widget", ["gadget"], 0)], "active_ingredient string, brand_names array<string>, position int"))
    products = class_products(drug, matcher)
    got = sorted(map(str, add_member_by_product(drug, products).collect()))
    assert got == sorted(map(str, add_member_by_name(drug, class_names(drug, matcher)).collect()))
    assert len(got) == len(rows) and products.count() == 4
