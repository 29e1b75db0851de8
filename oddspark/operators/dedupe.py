"""Latest version of every case, and distinct report-item pairs."""

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddspark import fixed_values as V
from oddspark.functions.names import drug_key
from oddspark.operators.once import computed_once


#: More than the number of report ids, so that version and id make one number.
ID_SPAN = Decimal(2 * 10**19)
#: Stands for a missing version: higher than every int.
NO_VERSION = 2**31
#: Ids below and versions below make one long together; the top version stands for a missing one.
LONG_IDS, LONG_VERSIONS = 2**41, 2**22 - 1


def _fits_long() -> Column:
    """Whether version and id make a long. Never null."""
    version, report = F.col("caseversion"), F.col("primaryid")
    fits = report.between(0, LONG_IDS - 1) & (version.isNull() | version.between(0, LONG_VERSIONS - 1))
    return F.coalesce(fits, F.lit(False))


def _long_packed() -> Column:
    """What ``_packed`` orders by, in a long; null where that is too small."""
    version = F.coalesce(F.col("caseversion").cast("long"), F.lit(LONG_VERSIONS))
    return F.when(_fits_long(), version * F.lit(LONG_IDS) + F.col("primaryid"))


def _greater_of(small: str, wide: str) -> dict[str, Column]:
    """Id and version of the greater of ``_long_packed`` and ``_packed``; decimals are worked on only where there are any."""
    report = F.col(small).bitwiseAND(F.lit(LONG_IDS - 1))
    version = F.nullif(F.shiftright(small, 41).cast("int"), F.lit(LONG_VERSIONS))
    same = F.coalesce(version.cast("long"), F.lit(NO_VERSION)).cast("decimal(10,0)") * F.lit(ID_SPAN) + (
        report.cast("decimal(20,0)") + F.lit(Decimal(2**63 + 1))).cast("decimal(20,0)")
    only_small = F.col(wide).isNull() | (F.col(small).isNotNull() & (same > F.col(wide)))
    other = _unpacked(wide)
    return {
        "primaryid": F.when(only_small, report).otherwise(other["primaryid"]),
        "caseversion": F.when(only_small, version).otherwise(other["caseversion"]),
    }


def _packed() -> Column:
    """Version and report id as one number: ordered by version, a missing one highest, then id, a missing one lowest."""
    version = F.coalesce(F.col("caseversion").cast("long"), F.lit(NO_VERSION)).cast("decimal(10,0)")
    report = F.coalesce(F.col("primaryid").cast("decimal(20,0)") + F.lit(Decimal(2**63 + 1)), F.lit(Decimal(0)))
    return version * F.lit(ID_SPAN) + report.cast("decimal(20,0)")


def _unpacked(packed: str) -> dict[str, Column]:
    report = F.pmod(F.col(packed), F.lit(ID_SPAN))
    version = ((F.col(packed) - report) / F.lit(ID_SPAN)).cast("long")
    return {
        "primaryid": F.when(report > 0, (report - F.lit(Decimal(2**63 + 1))).cast("long")),
        "caseversion": F.nullif(version, F.lit(NO_VERSION)).cast("int"),
    }


def dedupe_latest_version(demo: DataFrame, scope: str = "quarter") -> DataFrame:
    """One row per case: the highest case version, a missing version counting as the highest.

    Ties go to the larger report id. ``scope="quarter"`` keeps the latest version within each
    quarter, ``scope="all"`` over all quarters.

    This is an aggregate and not a window, so each task first reduces its own rows: a case that
    holds a large part of all rows reaches the shuffle as one row per task. Where only version and id
    are asked for, they travel as one number of fixed width, whose maximum needs no sort: a long for ids
    and versions of usual size, and a decimal, which costs many times as much, for all others.
    """
    if scope not in ("quarter", "all"):
        raise ValueError("scope must be 'quarter' or 'all'")
    keys = ["faers_quarter", "caseid"] if scope == "quarter" else ["caseid"]
    rest = [c for c in demo.columns if c not in keys + ["caseversion", "primaryid"]]
    kinds = {c: kind for c, kind in demo.dtypes if c in ("caseversion", "primaryid")}
    if not rest and kinds == {"caseversion": "int", "primaryid": "bigint"}:
        latest = demo.groupBy(*keys).agg(
            F.max(_long_packed()).alias("_small"), F.max(F.when(~_fits_long(), _packed())).alias("_wide"))
        return latest.withColumns(_greater_of("_small", "_wide")).select(*demo.columns)
    order = [F.col("caseversion").isNull().alias("_missing"), "caseversion", "primaryid"]
    return (
        demo.groupBy(*keys)
        .agg(F.max(F.struct(*order, *rest)).alias("latest"))
        .select(*keys, "latest.*")
        .select(*demo.columns)
    )


def valid_reports(demo: DataFrame, scope: str = "quarter") -> DataFrame:
    """Ids and quarters of the deduplicated reports, reading nothing else from ``demo``."""
    narrow = demo.select("primaryid", "caseid", "caseversion", "faers_quarter")
    return dedupe_latest_version(narrow, scope).select("primaryid", "faers_quarter")


def report_key(child: DataFrame) -> list[str]:
    """The columns that tie a child row to its report.

    Raw tables carry the quarter they came from. A table without it is tied by the report id.
    """
    return [c for c in ("faers_quarter", "primaryid") if c in child.columns]


def restrict_to_valid(child: DataFrame, valid: DataFrame) -> DataFrame:
    """Child rows of deduplicated reports."""
    key = report_key(child)
    return child.join(valid.select(*key).hint("merge"), key, "left_semi")


def distinct_pairs(child: DataFrame, item: str) -> DataFrame:
    """Distinct (report, item) pairs with a non-empty item.

    Shuffled by report and item together after a reduction in each task. A report then holds at
    most one row per item of the vocabulary.
    """
    named = child.filter(F.col(item).isNotNull() & (F.col(item) != ""))
    return named.select(*report_key(child), item).distinct()


def report_drugs(drug: DataFrame) -> DataFrame:
    """Distinct (report, drug key) pairs of suspect products."""
    suspect = drug.filter(F.col("role_cod").isin(V.SUSPECT_ROLES))
    key = drug_key(F.col("prod_ai"), F.col("drugname"))
    return distinct_pairs(computed_once(suspect, {"drug_key": key}), "drug_key")


def report_events(reac: DataFrame) -> DataFrame:
    """Distinct (report, event term) pairs."""
    return distinct_pairs(reac.withColumnRenamed("pt", "event_pt"), "event_pt")
