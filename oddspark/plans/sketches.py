"""Distinct reports by sketches that merge: stored per item and quarter, united over any of them.

Counts per quarter or per term don't add up to distinct reports over several terms, as a report
may hold more than one of them. Sketches do: a union of sketches stands for the union of reports,
and none of the reports is read again.
"""

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddspark.plans.background import in_valid_reports

#: Log of the number of buckets of a sketch; 12 are at most 4 KB each.
LOG_BUCKETS = 12


def relative_error(log_buckets: int = LOG_BUCKETS) -> float:
    """Standard error of an estimate, as a share of it."""
    return 1.04 / math.sqrt(2 ** log_buckets)


def report_sketches(pairs: DataFrame, valid: DataFrame, item: str, log_buckets: int = LOG_BUCKETS) -> DataFrame:
    """``item, faers_quarter, sketch`` over the deduplicated reports of distinct (report, item) pairs.

    Each task reduces its rows to one sketch per item and quarter before the shuffle, so that an
    item held by a third of all reports reaches it as one row per task. No rows give no sketch.
    """
    held = in_valid_reports(pairs, valid).filter(F.col(item).isNotNull())
    return held.groupBy(item, "faers_quarter").agg(F.hll_sketch_agg("primaryid", log_buckets).alias("sketch"))


def write_sketches(pairs: DataFrame, valid: DataFrame, item: str, path: str,
                   log_buckets: int = LOG_BUCKETS) -> DataFrame:
    """Store the sketches below ``path`` by quarter and return all stored ones.

    The quarters of the input are replaced, others stay. All of one path need the same size.
    """
    made = report_sketches(pairs, valid, item, log_buckets)
    (
        made.hint("rebalance", "faers_quarter")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("faers_quarter")
        .parquet(path)
    )
    return read_sketches(pairs.sparkSession, path)


def read_sketches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def estimated_reports(sketches: DataFrame, *by: str) -> DataFrame:
    """Estimated distinct reports (``n_estimated``) per ``by``, over all rows without it.

    The sketches of a group are united, not added, so a report counts once per group however many
    items or quarters name it. Filters on quarters and items go on ``sketches``.
    """
    united = F.hll_sketch_estimate(F.hll_union_agg("sketch"))
    return sketches.groupBy(*by).agg(F.coalesce(united, F.lit(0)).alias("n_estimated"))


def estimated_reports_of(sketches: DataFrame, groups: DataFrame, item: str, group: str) -> DataFrame:
    """Estimated distinct reports with any item of a group; ``groups`` holds ``item, group``.

    Groups without a known item get 0. An item may belong to several groups.
    """
    wanted = groups.select(item, group).distinct()
    found = estimated_reports(wanted.join(sketches, item), group)
    named = wanted.select(group).distinct()
    return named.join(found, named[group].eqNullSafe(found[group]), "left").select(
        named[group], F.coalesce("n_estimated", F.lit(0)).alias("n_estimated"))
