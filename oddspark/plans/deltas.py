"""The background kept up to date load by load, with signed counts of the cases that a load touches."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oddspark.operators.dedupe import dedupe_latest_version, report_drugs, report_events, report_key
from oddspark.operators.upsert import with_keys, without_keys
from oddspark.plans.background import TABLES, Background, background_of
from oddspark.sources.versions import Store
from oddspark.workspace import delete_folder, new_folder, stored

#: What the counts were made of: the winning report of every case, and all items ever loaded.
LEDGER = ("winners", "report_drugs", "report_events")


def merged_counts(*parts: DataFrame) -> DataFrame:
    """Counts added up by their keys. Rows may be negative; what comes to nothing goes.

    Sums don't depend on the order, so counts of any number of loads merge in any grouping.
    """
    keys = [c for c in parts[0].columns if c != "n_reports"]
    total = reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(F.sum("n_reports").alias("n_reports"))
    return total.filter("n_reports <> 0")


def negated(counts: DataFrame) -> DataFrame:
    """The same counts to be taken away."""
    return counts.withColumn("n_reports", -F.col("n_reports"))


def case_key(scope: str) -> list[str]:
    return ["faers_quarter", "caseid"] if scope == "quarter" else ["caseid"]


def signed_counts(
    before: DataFrame, after: DataFrame, items_before: tuple[DataFrame, DataFrame], items_after: tuple[DataFrame, DataFrame]
) -> dict[str, DataFrame]:
    """Per table of the background: minus what the touched cases counted for, plus what they count for now.

    ``before`` and ``after`` are reports (primaryid, faers_quarter), items their drugs and events. A case that
    moved to another quarter or report gives minus rows there and plus rows here; pairs that stayed cancel.
    """
    old, new = background_of(before, *items_before), background_of(after, *items_after)
    return {t: merged_counts(getattr(new, t), negated(getattr(old, t))) for t in TABLES}


def apply_load(
    spark: SparkSession, path: str, demo: DataFrame, drug: DataFrame, reac: DataFrame, scope: str = "all"
) -> Background:
    """Add a load to the background below ``path`` and return the new one, the same as if built from all loads at once.

    Cases are touched if their winning report changes, or if the report that stays gets new items
    (a drug or event may come in a later load than its report, or before it). Only their items are
    paired again; other cases come in as stored counts, and only the quarters that change are
    written. A load that was applied before changes nothing. All seven tables switch to
    the new version at once, so a failed load leaves the old one. Loads of one path share one ``scope``.
    """
    store, made = Store(spark, path), new_folder(spark, "load")
    change = store.change()
    case, item = case_key(scope), {"report_drugs": "drug_key", "report_events": "event_pt"}
    narrow = demo.select("primaryid", "caseid", "caseversion", "faers_quarter")
    incoming = stored(dedupe_latest_version(narrow, scope), f"{made}/incoming")
    held = {
        "winners": store.rows_of(change.base, "winners", incoming.schema),
        "report_drugs": None, "report_events": None,
    }
    fresh = {}
    for name, rows in (("report_drugs", report_drugs(drug)), ("report_events", report_events(reac))):
        held[name] = store.rows_of(change.base, name, rows.schema)
        if held[name].columns != rows.columns:
            raise ValueError(f"the stored {name} are tied to their reports by other columns")
        fresh[name] = stored(without_keys(rows, held[name], rows.columns), f"{made}/{name}")
    report = report_key(fresh["report_drugs"])
    if report != report_key(fresh["report_events"]):
        raise ValueError("drugs and events are tied to their reports by different columns")

    rivals = with_keys(held["winners"], incoming, case)
    winners = stored(dedupe_latest_version(rivals.unionByName(incoming), scope), f"{made}/winners")
    changed = without_keys(winners, held["winners"], winners.columns)
    late = fresh["report_drugs"].select(*report).unionByName(fresh["report_events"].select(*report)).distinct()
    stays = with_keys(without_keys(held["winners"], changed, case), late, report)
    moved = changed.unionByName(stays)
    # A report counts once, also if several cases name it: those cases are looked at together.
    named = moved.select(*report).unionByName(with_keys(held["winners"], moved, case).select(*report)).distinct()
    others = with_keys(without_keys(held["winners"], moved, case), named, report)
    touched = stored(moved.unionByName(others), f"{made}/touched")
    kept = ["primaryid", "faers_quarter"]
    after = touched.select(*kept)
    before = stored(with_keys(held["winners"], touched, case).select(*kept), f"{made}/before")

    def items(name: str, reports: DataFrame, with_fresh: bool) -> DataFrame:
        rows = held[name].unionByName(fresh[name]) if with_fresh else held[name]
        return with_keys(rows, reports.select(*report).distinct(), report).select(*report, item[name])

    signed = signed_counts(
        before, after,
        tuple(stored(items(n, before, False), f"{made}/{n}-before") for n in item),
        tuple(stored(items(n, after, True), f"{made}/{n}-after") for n in item),
    )
    for table, rows in signed.items():
        rows = stored(rows, f"{made}/signed-{table}")
        # Four quarters a year.
        quarters = [r[0] for r in rows.select("faers_quarter").distinct().collect()]
        of_quarter = [F.col("faers_quarter").eqNullSafe(F.lit(q)) for q in quarters]
        old = store.rows_of(change.base, table, rows.schema).filter(reduce(Column.__or__, of_quarter, F.lit(False)))
        change.replace(table, merged_counts(old, rows).select(*rows.columns), "faers_quarter", quarters)
    change.put("winners", without_keys(held["winners"], winners, case).unionByName(winners))
    for name in item:
        change.add(name, fresh[name])
    change.commit()
    delete_folder(spark, made)
    return read_loads(spark, path)


def read_loads(spark: SparkSession, path: str, version: int | None = None) -> Background:
    """The background after all loads, or as of an earlier version."""
    store = Store(spark, path)
    version = store.manifest(version).number
    return Background(**{t: store.read(t, version=version) for t in TABLES})
