"""Background counts over all reports: per quarter, drug, event and drug x event."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddspark.functions.demographics import all_of, any_of
from oddspark.operators.dedupe import (
    report_drugs,
    report_events,
    report_key,
    restrict_to_valid,
    valid_reports,
)
from oddspark.operators.pairing import join_within
from oddspark.sources.bucketed import drop_kept, keep_by_report
from oddspark.workspace import delete_folder, new_folder, stored, stored_values

TABLES = ("quarter_totals", "drug_totals", "event_totals", "drug_event_counts")


@dataclass(frozen=True)
class Background:
    quarter_totals: DataFrame
    drug_totals: DataFrame
    event_totals: DataFrame
    drug_event_counts: DataFrame

    def restricted(
        self, drugs: list[str] | None = None, events: list[str] | None = None
    ) -> "Background":
        """The counts of some drugs and events; the filters reach the stored files."""
        of_drug = all_of(any_of(F.col("drug_key"), drugs))
        of_event = all_of(any_of(F.col("event_pt"), events))
        return Background(
            quarter_totals=self.quarter_totals,
            drug_totals=self.drug_totals.filter(of_drug),
            event_totals=self.event_totals.filter(of_event),
            drug_event_counts=self.drug_event_counts.filter(of_drug & of_event),
        )


def in_valid_reports(pairs: DataFrame, valid: DataFrame) -> DataFrame:
    """Pairs of deduplicated reports, with the quarter of the report."""
    if "faers_quarter" in pairs.columns:
        return restrict_to_valid(pairs, valid)
    return pairs.join(valid.hint("merge"), "primaryid")


def _n_reports(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_reports"))


def quarter_totals(valid: DataFrame) -> DataFrame:
    return _n_reports(valid, "faers_quarter")


def drug_totals(drugs: DataFrame) -> DataFrame:
    return _n_reports(drugs, "drug_key", "faers_quarter")


def event_totals(events: DataFrame) -> DataFrame:
    return _n_reports(events, "event_pt", "faers_quarter")


def cooccurring_pairs(drugs: DataFrame, events: DataFrame, valid: DataFrame) -> DataFrame:
    """Every (drug, event) pair of every valid report, with the quarter of the report."""
    key = _shared_key(drugs, events)
    return join_within(
        drugs.select(*key, "drug_key"),
        events.select(*key, "event_pt"),
        key,
        "drug_key",
        "event_pt",
        per_key=valid,
    )


def drug_event_counts(drugs: DataFrame, events: DataFrame, valid: DataFrame) -> DataFrame:
    return _n_reports(
        cooccurring_pairs(drugs, events, valid), "drug_key", "event_pt", "faers_quarter"
    )


def _shared_key(drugs: DataFrame, events: DataFrame) -> list[str]:
    key = report_key(drugs)
    return key if key == report_key(events) else ["primaryid"]


def build_background(
    demo: DataFrame, drug: DataFrame, reac: DataFrame, scope: str = "quarter"
) -> Background:
    """The four tables as lazy plans, all quarters at once."""
    return background_of(valid_reports(demo, scope), report_drugs(drug), report_events(reac))


def background_of(valid: DataFrame, drugs: DataFrame, events: DataFrame) -> Background:
    return Background(
        quarter_totals=quarter_totals(valid),
        drug_totals=drug_totals(in_valid_reports(drugs, valid)),
        event_totals=event_totals(in_valid_reports(events, valid)),
        drug_event_counts=drug_event_counts(drugs, events, valid),
    )


def background_of_dated(valid: DataFrame, drugs: DataFrame, events: DataFrame) -> Background:
    """``background_of`` for drugs that were joined with the valid reports, a row for each, and tied by the id alone."""
    pairs = join_within(drugs, events, ["primaryid"], "drug_key", "event_pt")
    return Background(
        quarter_totals=quarter_totals(valid),
        drug_totals=drug_totals(drugs),
        event_totals=event_totals(in_valid_reports(events, valid)),
        drug_event_counts=_n_reports(pairs, "drug_key", "event_pt", "faers_quarter"),
    )


def write_background(
    demo: DataFrame, drug: DataFrame, reac: DataFrame, path: str, scope: str = "quarter", valid: DataFrame | None = None
) -> Background:
    """Build and store the four tables below ``path`` and return the stored ones.

    ``valid`` are the valid reports of ``demo`` where the caller has stored them by report already; they stay.

    The valid reports and the two tables of their distinct pairs each feed several of the results, so
    they are written to the shared folder once, by report, and deleted at the end: what joins or counts
    them by report needs no further shuffle. Re-running replaces the
    quarters that ``demo`` holds, also those that no longer have a count; others stay. With
    ``scope="all"`` a case counts in one quarter only, so ``demo`` must hold every stored quarter.
    Rows are gathered by quarter before the write, large quarters split and small ones joined, so
    that the number of files follows the size of the result.
    """
    spark, made = demo.sparkSession, new_folder(demo.sparkSession, "background")
    held = _quarters(demo)
    if scope == "all":
        left = set().union(*[stored_values(spark, f"{path}/{t}", "faers_quarter") for t in TABLES]) - held
        if left:
            raise ValueError(f"stored quarters are not in the input: {', '.join(sorted(left))}")
    drugs, events = report_drugs(drug), report_events(reac)
    key = _shared_key(drugs, events)
    if valid is None:
        valid = keep_by_report(valid_reports(demo, scope), f"{made}/valid-reports", key, gather=True)
    tied_by_id = "faers_quarter" not in {*drugs.columns, *events.columns}

    def kept(pairs: DataFrame, name: str) -> DataFrame:
        of_valid = pairs.join(valid.select(*key).hint("merge"), key, "left_semi")
        return keep_by_report(of_valid, f"{made}/{name}", key)

    if tied_by_id:
        # The drugs take the quarter of their report along, so neither their counts nor the pairs join it again.
        dated = keep_by_report(in_valid_reports(drugs, valid), f"{made}/report-drugs", key)
        results = background_of_dated(valid, dated, kept(events, "report-events"))
    else:
        results = background_of(valid, kept(drugs, "report-drugs"), kept(events, "report-events"))
    for table in TABLES:
        result = stored(getattr(results, table).hint("rebalance", "faers_quarter"), f"{made}/{table}")
        (
            result.hint("rebalance", "faers_quarter")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("faers_quarter")
            .parquet(f"{path}/{table}")
        )
        gone = held - _quarters(result)
        for quarter, folder in stored_values(spark, f"{path}/{table}", "faers_quarter").items():
            if quarter in gone:
                delete_folder(spark, folder)
    for name in ("valid-reports", "report-drugs", "report-events"):
        drop_kept(spark, f"{made}/{name}")
    delete_folder(spark, made)
    return read_background(spark, path)


def _quarters(df: DataFrame) -> set[str]:
    """The quarters of a table, four a year."""
    rows = df.select(F.col("faers_quarter").cast("string")).distinct().collect()
    return {r[0] for r in rows if r[0] is not None}


def read_background(spark: SparkSession, path: str) -> Background:
    return Background(**{t: spark.read.parquet(f"{path}/{t}") for t in TABLES})
