"""From background counts to signals, for any number of drugs and events in one plan."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddspark.functions.demographics import all_of, any_of
from oddspark.functions.metrics import (
    CELLS,
    FLAGS,
    METRICS,
    contingency_cells,
    disproportionality,
    rounded,
)
from oddspark.operators.ranking import forest_rows, rank_by_ic
from oddspark.plans.background import Background
from oddspark.schemas import DRUG_KEYS, GRID
from oddspark.workspace import local_table

MIN_CASES = 3
SIGNAL_COLUMNS = ["drug_key", "event_pt", *CELLS, *METRICS, *FLAGS]
TOOL_COLUMNS = ["event_pt", "a", *METRICS, *FLAGS]
TABLE_COLUMNS = ["event_pt", "a", *METRICS]


def _check(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)


def sum_over_quarters(
    counts: DataFrame, keys: list[str], name: str, quarters: list[str] | None = None
) -> DataFrame:
    """Quarterly counts added up per key, for some quarters or for all."""
    chosen = counts.filter(all_of(any_of(F.col("faers_quarter"), quarters)))
    total = F.coalesce(F.sum("n_reports"), F.lit(0)).cast("long")
    return chosen.groupBy(*keys).agg(total.alias(name))


def events_having_min(
    counts: DataFrame,
    drugs: list[str] | None = None,
    quarters: list[str] | None = None,
    min_cases: int = MIN_CASES,
) -> DataFrame:
    """Pairs reported together at least ``min_cases`` times: ``drug_key, event_pt, n_both``."""
    wanted = counts.filter(all_of(any_of(F.col("drug_key"), drugs)))
    pairs = sum_over_quarters(wanted, ["drug_key", "event_pt"], "n_both", quarters)
    return pairs.filter(F.col("n_both") >= min_cases)


def _add_cells(pairs: DataFrame, background: Background, quarters: list[str] | None) -> DataFrame:
    """Turn ``drug_key, event_pt, n_both`` into the four cells.

    The margins are joined by key, by merge at any size, so that none travels through the driver; the grand
    total is one value and enters as a scalar subquery. An unknown drug or event counts 0.
    """
    n_drug = sum_over_quarters(background.drug_totals, ["drug_key"], "n_drug", quarters)
    n_event = sum_over_quarters(background.event_totals, ["event_pt"], "n_event", quarters)
    n_all = sum_over_quarters(background.quarter_totals, [], "n_all", quarters)
    cells = contingency_cells(
        F.col("n_both"),
        F.coalesce("n_drug", F.lit(0)),
        F.coalesce("n_event", F.lit(0)),
        F.col("n_all"),
    )
    return (
        pairs.join(n_drug.hint("merge"), "drug_key", "left")
        .join(n_event.hint("merge"), "event_pt", "left")
        .withColumn("n_all", n_all.scalar())
        .withColumns(cells)
        .drop("n_both", "n_drug", "n_event", "n_all")
    )


def contingency(
    background: Background, pairs: DataFrame, quarters: list[str] | None = None
) -> DataFrame:
    """The four cells of every requested (drug_key, event_pt), also of pairs never seen."""
    wanted = pairs.select("drug_key", "event_pt").distinct()
    counts = background.drug_event_counts.join(wanted, ["drug_key", "event_pt"], "left_semi")
    n_both = sum_over_quarters(counts, ["drug_key", "event_pt"], "n_both", quarters)
    known = pairs.join(n_both, ["drug_key", "event_pt"], "left")
    return _add_cells(known.fillna(0, ["n_both"]), background, quarters)


def compute_signal(
    background: Background, drug: str, event: str, quarters: list[str] | None = None
) -> DataFrame:
    """Cells and metrics of one pair, one row."""
    return compare_grid(background, [drug], [event], quarters).select(*SIGNAL_COLUMNS)


def compare_grid(
    background: Background, drugs: list[str], events: list[str], quarters: list[str] | None = None
) -> DataFrame:
    """Every drug with every event, in the order of the two lists (``drug_pos, event_pos``)."""
    spark = background.drug_totals.sparkSession
    cells = [
        {"drug_pos": i, "drug_key": d, "event_pos": j, "event_pt": e}
        for i, d in enumerate(drugs)
        for j, e in enumerate(events)
    ]
    grid = local_table(spark, cells, GRID)
    return disproportionality(contingency(background.restricted(drugs, events), grid, quarters))


def compare_drugs(
    background: Background, drug_keys: list[str], event_pts: list[str]
) -> DataFrame:
    """Head-to-head comparison of 2 to 6 drugs over 1 to 15 events, in input order."""
    _check(2 <= len(drug_keys) <= 6, "compare 2 to 6 drugs")
    _check(1 <= len(event_pts) <= 15, "compare over 1 to 15 events")
    return (
        compare_grid(background, drug_keys, event_pts)
        .orderBy("drug_pos", "event_pos")
        .select("drug_key", "event_pt", "a", *METRICS, *FLAGS)
    )


def scan_signals(
    background: Background,
    drugs: list[str] | None = None,
    quarters: list[str] | None = None,
    min_cases: int = MIN_CASES,
) -> DataFrame:
    """All events of the given drugs (all drugs if none) with their cells and metrics."""
    chosen = background.restricted(drugs)
    pairs = events_having_min(chosen.drug_event_counts, drugs, quarters, min_cases)
    return _signals_of(pairs, chosen, quarters)


def _signals_of(
    pairs: DataFrame, background: Background, quarters: list[str] | None = None
) -> DataFrame:
    cells = _add_cells(pairs, background, quarters)
    return disproportionality(cells).select(*SIGNAL_COLUMNS)


def precompute_signals(
    background: Background, drugs: list[str], path: str, min_cases: int = MIN_CASES
) -> DataFrame:
    """Store the scan of the given drugs, replacing the table, and return the stored one.

    Rows are sorted by drug within the files, so a reader that asks for one drug skips the rest.
    """
    signals = scan_signals(background, drugs, min_cases=min_cases)
    (
        signals.repartitionByRange("drug_key", "event_pt")
        .sortWithinPartitions("drug_key", "event_pt")
        .write.mode("overwrite")
        .parquet(path)
    )
    return signals.sparkSession.read.schema(signals.schema).parquet(path)


def stored_signals(stored: DataFrame, drugs: list[str], min_cases: int = 10) -> DataFrame:
    """Rows of the stored table for the given drugs with enough cases."""
    return stored.filter(F.col("drug_key").isin(list(drugs)) & (F.col("a") >= min_cases))


def precomputed_or_live(
    stored: DataFrame, background: Background, drugs: list[str], min_cases: int = 10
) -> DataFrame:
    """Stored rows, and a live scan for each drug for which the stored filter finds nothing.

    The drugs left over are known before the counts are read: when there are none, the adaptive
    planner drops the live branch.
    """
    found = stored_signals(stored, drugs, min_cases).select(*SIGNAL_COLUMNS)
    asked = local_table(stored.sparkSession, [{"drug_key": d} for d in drugs], DRUG_KEYS)
    missing = asked.distinct().join(found.select("drug_key"), "drug_key", "left_anti")
    chosen = background.restricted(drugs)
    counts = chosen.drug_event_counts.join(missing, "drug_key", "left_semi")
    live = _signals_of(events_having_min(counts, min_cases=min_cases), chosen)
    return found.unionByName(live)


def filter_flags_or(signals: DataFrame) -> DataFrame:
    """Signals by either criterion."""
    return signals.filter("is_signal_ema or is_signal_bcpnn")


def detect_signals(
    stored: DataFrame, background: Background, drug: str, min_cases: int = 10, top_n: int = 20
) -> DataFrame:
    """The top signals of a drug by information component."""
    _check(min_cases >= 3, "min_cases is 3 or more")
    _check(1 <= top_n <= 50, "top_n is 1 to 50")
    signals = filter_flags_or(precomputed_or_live(stored, background, [drug], min_cases))
    return rank_by_ic(signals).limit(top_n).select(*TOOL_COLUMNS)


def signal_explorer(
    stored: DataFrame, background: Background, drug: str, min_cases: int = 10
) -> dict[str, DataFrame]:
    """What the explorer shows for a drug: the scan, its EMA signals, a table, a plot, counts."""
    scanned = precomputed_or_live(stored, background, [drug], min_cases)
    ema = scanned.filter("is_signal_ema")
    return {
        "scanned": rank_by_ic(scanned),
        "ema": rank_by_ic(ema),
        "table": rank_by_ic(ema).limit(30).select("event_pt", "a", *rounded(METRICS)),
        "forest": forest_rows(ema),
        "counts": scanned.agg(
            F.count(F.lit(1)).alias("n_scanned"), F.count_if("is_signal_ema").alias("n_ema")
        ),
    }
