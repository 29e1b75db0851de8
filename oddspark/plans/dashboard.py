"""Counts over the stored cohort: filtered event counts and the dashboard figures."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddspark import fixed_values as V
from oddspark.functions.demographics import (
    age_band,
    all_of,
    any_of,
    in_range,
    like_contains_ci,
    or_unknown,
)
from oddspark.operators.pairing import join_within
from oddspark.operators.ranking import top_n as take_top
from oddspark.plans.cohort import Cohort


def serious_reports(outcomes: DataFrame) -> DataFrame:
    """Ids of reports with a serious outcome, once each."""
    serious = outcomes.filter(F.col("outc_cod").isin(V.SERIOUS_OUTCOMES))
    return serious.select("primaryid").distinct()


def star_join(reports: DataFrame, drugs: DataFrame, reactions: DataFrame) -> DataFrame:
    """Reports with each of their drug rows and reaction rows, repeats counted in ``n_rows``.

    Drug and reaction rows of one report multiply. Equal rows are first counted, so that repeats
    do not travel, and the distinct ones meet in the balanced join, which carries the report.
    """
    def counted(rows: DataFrame, name: str) -> DataFrame:
        equal = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias(f"_n_{name}"))
        return equal.withColumn(f"_{name}", F.xxhash64(*rows.columns))

    joined = join_within(
        counted(drugs, "drug"),
        counted(reactions, "reaction"),
        ["primaryid"],
        "_drug",
        "_reaction",
        per_key=reports,
    )
    return joined.withColumn("n_rows", F.col("_n_drug") * F.col("_n_reaction")).drop(
        "_n_drug", "_n_reaction", "_drug", "_reaction"
    )


def matching_reports(
    cohort: Cohort,
    drug_key: str | None = None,
    age_min: float | None = None,
    age_max: float | None = None,
    sex: str | None = None,
    serious_only: bool = False,
) -> DataFrame:
    """Ids of reports with a matching class drug and matching demographics."""
    wanted = all_of([
        F.col("is_glp1"), *like_contains_ci([F.col("drugname"), F.col("prod_ai")], drug_key)
    ])
    with_drug = cohort.drugs.filter(wanted).select("primaryid").distinct()
    conditions = in_range(F.col("age"), age_min, age_max)
    if sex:
        conditions.append(F.col("sex") == sex)
    ids = cohort.reports.filter(all_of(conditions)).select("primaryid")
    ids = ids.join(with_drug, "primaryid", "left_semi")
    if serious_only:
        ids = ids.join(serious_reports(cohort.outcomes), "primaryid", "left_semi")
    return ids


def events_of_reports(reactions: DataFrame, ids: DataFrame) -> DataFrame:
    """Distinct reports per event term among the given reports: ``event_pt, n_reports``."""
    return (
        reactions.select("primaryid", "pt")
        .distinct()
        .join(ids, "primaryid", "left_semi")
        .groupBy(F.col("pt").alias("event_pt"))
        .agg(F.count(F.lit(1)).alias("n_reports"))
    )


def query_cohort_events(
    cohort: Cohort,
    drug_key: str | None = None,
    event_pts: list[str] | DataFrame | None = None,
    age_min: float | None = None,
    age_max: float | None = None,
    sex: str | None = None,
    serious_only: bool = False,
    top_n: int = 20,
) -> DataFrame:
    """Reports per event term under the given filters, the most frequent first.

    Counting distinct reports per term needs no drug x reaction product: whether a report matches
    is decided by semi joins, and a report counts once per term. ``event_pts`` may also be a
    table with a column ``pt``, such as the result of a term search.
    """
    if not 1 <= top_n <= 50:
        raise ValueError("top_n is 1 to 50")
    ids = matching_reports(cohort, drug_key, age_min, age_max, sex, serious_only)
    reactions = cohort.reactions.select("primaryid", "pt")
    if isinstance(event_pts, DataFrame):
        reactions = reactions.join(event_pts.select("pt").distinct(), "pt", "left_semi")
    else:
        reactions = reactions.filter(all_of(any_of(F.col("pt"), event_pts)))
    counted = events_of_reports(reactions, ids)
    return take_top(counted, "n_reports", top_n, "event_pt")


def cohort_overview(cohort: Cohort) -> DataFrame:
    """Five figures in one row, each a scalar subquery."""
    def one(df: DataFrame):
        return df.agg(F.count(F.lit(1))).scalar()

    return cohort.reports.sparkSession.range(1).select(
        one(cohort.reports).alias("total_reports"),
        one(cohort.drugs.filter("is_glp1")).alias("total_drug_mentions"),
        one(cohort.reactions).alias("total_reactions"),
        cohort.reactions.agg(F.countDistinct("pt")).scalar().alias("unique_events"),
        one(serious_reports(cohort.outcomes)).alias("serious_reports"),
    )


def reports_by_quarter(reports: DataFrame) -> DataFrame:
    counted = reports.groupBy("faers_quarter").agg(F.count(F.lit(1)).alias("n_reports"))
    return counted.orderBy("faers_quarter")


def drug_distribution(drugs: DataFrame, n: int = 20) -> DataFrame:
    """The most frequent raw names among class mentions."""
    counted = drugs.filter("is_glp1").groupBy("drugname").agg(F.count(F.lit(1)).alias("n_reports"))
    return take_top(counted, "n_reports", n, "drugname")


def ingredient_distribution(drugs: DataFrame, n: int = 20) -> DataFrame:
    """Mentions and distinct reports of the class's ingredients, whatever names they were reported by.

    Rows are first reduced to one per ingredient and report, so no ingredient's reports meet in one task.
    """
    per_report = (
        drugs.filter(F.col("active_ingredient").isNotNull())
        .groupBy("active_ingredient", "primaryid")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    counted = per_report.groupBy("active_ingredient").agg(
        F.sum("n").alias("n_mentions"), F.count(F.lit(1)).alias("n_reports")
    )
    return take_top(counted, "n_mentions", n, "active_ingredient")


def demographics(reports: DataFrame) -> DataFrame:
    """Reports per age band and sex."""
    return (
        reports.select(age_band(F.col("age")).alias("age_group"), or_unknown(F.col("sex")).alias("sex"))
        .groupBy("age_group", "sex")
        .agg(F.count(F.lit(1)).alias("n_reports"))
        .orderBy("age_group", "sex")
    )


def demographics_pivot(counted: DataFrame, sexes: list[str] | None = None) -> DataFrame:
    """Age band by sex, missing cells 0. Named columns spare the pass that would find them."""
    wide = counted.groupBy("age_group").pivot("sex", sexes).agg(F.sum("n_reports"))
    return wide.fillna(0, wide.columns[1:])
