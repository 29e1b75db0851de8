"""The cohort: full detail of the reports that mention the target class."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddspark.functions.demographics import age_to_years, lenient_cast, lenient_date
from oddspark.functions.names import build_matcher
from oddspark.operators.dedupe import dedupe_latest_version, report_key, valid_reports
from oddspark.operators.matching import add_member_by_product, class_products
from oddspark.sources.bucketed import keep_by_report, read_kept
from oddspark.workspace import materialize, new_folder

TABLES = ("reports", "drugs", "reactions", "outcomes", "indications")


@dataclass(frozen=True)
class Cohort:
    ids: DataFrame
    reports: DataFrame
    drugs: DataFrame
    reactions: DataFrame
    outcomes: DataFrame
    indications: DataFrame


def class_reports(flagged: DataFrame) -> DataFrame:
    """Keys of the reports with a class member in any role."""
    members = flagged.filter(F.col("active_ingredient").isNotNull())
    return members.select(*report_key(flagged)).distinct()


def cohort_ids(flagged: DataFrame, valid: DataFrame) -> DataFrame:
    """Keys of the deduplicated reports among them."""
    members = class_reports(flagged)
    return valid.join(members.hint("merge"), members.columns, "left_semi")


def in_cohort(child: DataFrame, ids: DataFrame) -> DataFrame:
    """Child rows of cohort reports. The keys grow with the input, and are never broadcast."""
    key = report_key(child)
    return child.join(ids.select(*key).hint("merge"), key, "left_semi")


def shape_reports(demo: DataFrame) -> DataFrame:
    """DEMO rows in the form of the ``reports`` table.

    ``serious`` is never filled by the load; seriousness is read from the outcomes.
    """
    age = lenient_cast(F.col("age"), "double")
    return demo.select(
        F.col("primaryid").cast("long").alias("primaryid"),
        F.col("caseid").cast("long").alias("caseid"),
        F.col("caseversion").cast("int").alias("caseversion"),
        lenient_date(F.col("event_dt").cast("string")).alias("event_dt"),
        lenient_date(F.col("fda_dt").cast("string")).alias("fda_dt"),
        age_to_years(age, F.col("age_cod")).alias("age"),
        F.col("age_cod").alias("age_unit"),
        "sex",
        "reporter_country",
        F.col("occr_country").alias("occur_country"),
        F.col("rept_cod").alias("reporter_type"),
        F.lit(False).alias("serious"),
        "faers_quarter",
    )


def shape_drugs(flagged: DataFrame) -> DataFrame:
    return flagged.select(
        "primaryid",
        lenient_cast(F.col("drug_seq"), "int").alias("drug_seq"),
        "role_cod",
        "drugname",
        "prod_ai",
        "route",
        lenient_cast(F.col("dose_amt"), "double").alias("dose_amt"),
        "dose_unit",
        F.col("active_ingredient").isNotNull().alias("is_glp1"),
        "active_ingredient",
    )


def shape_reactions(reac: DataFrame) -> DataFrame:
    """Reactions with a term; the term is required."""
    named = reac.filter(F.col("pt").isNotNull() & (F.col("pt") != ""))
    return named.select("primaryid", "pt", "drug_rec_act")


def shape_indications(indi: DataFrame) -> DataFrame:
    return indi.select(
        "primaryid", lenient_cast(F.col("indi_drug_seq"), "int").alias("indi_drug_seq"), "indi_pt"
    )


def build_cohort(
    demo: DataFrame,
    drug: DataFrame,
    reac: DataFrame,
    outc: DataFrame,
    indi: DataFrame,
    dictionary: DataFrame,
    scope: str = "quarter",
) -> Cohort:
    """The five cohort tables as lazy plans.

    The report keys are a table and never a set in memory. Each detail table is reduced by one
    semi join, by merge at any size.
    """
    products = class_products(drug, build_matcher(dictionary))

    def recognize(rows: DataFrame) -> DataFrame:
        return add_member_by_product(rows, products)

    ids = cohort_ids(recognize(drug), valid_reports(demo, scope))
    return _detail(demo, drug, reac, outc, indi, recognize, ids, scope)


def _detail(demo, drug, reac, outc, indi, recognize, ids: DataFrame, scope: str) -> Cohort:
    """The tables of the given reports. Each but the first ends with the join by report, and so lies by report."""
    latest = dedupe_latest_version(in_cohort(demo, ids), scope)
    return Cohort(
        ids=ids,
        reports=shape_reports(latest),
        drugs=shape_drugs(in_cohort(recognize(drug), ids)),
        reactions=shape_reactions(in_cohort(reac, ids)),
        outcomes=in_cohort(outc, ids).select("primaryid", "outc_cod"),
        indications=shape_indications(in_cohort(indi, ids)),
    )


def write_cohort(
    demo: DataFrame,
    drug: DataFrame,
    reac: DataFrame,
    outc: DataFrame,
    indi: DataFrame,
    dictionary: DataFrame,
    path: str,
    scope: str = "quarter",
) -> Cohort:
    """Build and store the cohort below ``path`` and return the stored tables.

    The class's products and the report keys are written first: names are cleaned once each and not
    once per row, and all five tables read the keys. The joins with the keys deal the rows by report, and the
    tables tied by the report id alone are stored as they then lie, so that readers need no shuffle by report.
    """
    spark = demo.sparkSession
    products = materialize(class_products(drug, build_matcher(dictionary)), "class-products")

    def recognize(rows: DataFrame) -> DataFrame:
        return add_member_by_product(rows, products)

    def by_id(child: DataFrame) -> bool:
        return report_key(child) == ["primaryid"]

    ids = cohort_ids(recognize(drug), valid_reports(demo, scope))
    if by_id(drug):
        ids = keep_by_report(ids, new_folder(spark, "cohort-ids"), ["primaryid"])
    else:
        ids = materialize(ids, "cohort-ids")
    cohort = _detail(demo, drug, reac, outc, indi, recognize, ids, scope)
    children = {"drugs": drug, "reactions": reac, "outcomes": outc, "indications": indi}
    for table in TABLES:
        rows = getattr(cohort, table)
        if table in children and by_id(children[table]):
            keep_by_report(rows, f"{path}/{table}", ["primaryid"])
        else:
            rows.write.mode("overwrite").parquet(f"{path}/{table}")
    return read_cohort(spark, path, ids)


def read_cohort(spark: SparkSession, path: str, ids: DataFrame | None = None) -> Cohort:
    tables = {t: read_kept(spark, f"{path}/{t}") for t in TABLES}
    if ids is None:
        ids = tables["reports"].select("primaryid", "faers_quarter")
    return Cohort(ids=ids, **tables)


def load_row_counts(
    demo: DataFrame, drug: DataFrame, cohort: Cohort, valid: DataFrame
) -> DataFrame:
    """Rows before and after each step: ``step, n_rows``."""
    steps = {
        "demo_read": demo,
        "demo_deduplicated": valid,
        "drug_read": drug,
        "cohort_ids": cohort.ids,
        **{table: getattr(cohort, table) for table in TABLES},
    }
    counts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(step).alias("step"), "n_rows")
        for step, df in steps.items()
    ]
    total = counts[0]
    for one in counts[1:]:
        total = total.unionByName(one)
    return total
