"""Detection of signals known from the literature."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddspark.functions.metrics import FLAGS, METRICS

BEST = ["a", "prr", "ror", "ror_ci_low", "ror_ci_high", "ic", "ic_ci_low"]


def fixture_left_join(fixture: DataFrame, signals: DataFrame, *carried: str) -> DataFrame:
    """Every known item with its candidate signals; items without any stay."""
    wanted = fixture.select(
        "id", "drug", *carried, F.explode_outer(F.array_distinct("event_pts")).alias("event_pt")
    )
    stored = signals.select(F.col("drug_key").alias("drug"), "event_pt", "a", *METRICS, *FLAGS)
    return wanted.join(stored, ["drug", "event_pt"], "left")


def best_match_per_item(fixture: DataFrame, signals: DataFrame) -> DataFrame:
    """Per item, with its own columns, all matches, the highest information component first.

    Items are told apart by their place in the list, so a missing or shared id mixes nothing. An
    item has at most as many matches as it lists events, so the list stays short.
    """
    order = [F.col("ic").isNull().alias("_missing"), (-F.col("ic")).alias("_falling")]
    match = F.struct(*order, "event_pt", "a", *METRICS, *FLAGS)
    numbered = fixture.select(
        "*",
        F.monotonically_increasing_id().alias("_number"),
        F.struct(*fixture.columns).alias("_item"),
    )
    grouped = (
        fixture_left_join(numbered, signals, "_number", "_item")
        .groupBy("_number")
        .agg(
            F.first("_item").alias("_item"),
            F.sort_array(F.collect_list(F.when(F.col("a").isNotNull(), match))).alias("matches"),
        )
    )
    fields = ["event_pt", "a", *METRICS, *FLAGS]
    return grouped.select(
        "_item.*",
        F.transform("matches", lambda m: F.struct(*[m[f].alias(f) for f in fields])).alias("matches"),
    )


def status_label() -> Column:
    return (
        F.when(F.col("is_signal_ema") | F.col("is_signal_bcpnn"), "DETECTED")
        .when(F.col("found"), "PRESENT-NOT-SIGNAL")
        .otherwise("MISSING")
    )


def validate_known_signals(fixture: DataFrame, signals: DataFrame) -> DataFrame:
    """One row per known item: found or not, its best match and its status."""
    best = F.try_element_at("matches", F.lit(1))
    flags = [F.coalesce(best[f], F.lit(False)).alias(f) for f in FLAGS]
    return (
        best_match_per_item(fixture, signals)
        .select(
            "id",
            "drug",
            "event_pts",
            "year",
            F.trim("literature_source").alias("source"),
            (F.size("matches") > 0).alias("found"),
            best["event_pt"].alias("best_match_pt"),
            "matches",
            *[best[f].alias(f) for f in BEST],
            *flags,
        )
        .withColumn("status", status_label())
    )


def detection_summary(results: DataFrame) -> DataFrame:
    """Nine figures: counts and rates of found and detected items."""
    ema, bcpnn = F.col("is_signal_ema"), F.col("is_signal_bcpnn")
    n = F.count(F.lit(1))

    def rate(condition: Column) -> Column:
        return F.try_divide(F.count_if(condition), n)

    return results.agg(
        n.alias("total_known_signals"),
        F.count_if("found").alias("found_in_data"),
        rate(F.col("found")).alias("found_rate"),
        F.count_if(ema).alias("detected_by_ema"),
        F.count_if(bcpnn).alias("detected_by_bcpnn"),
        F.count_if(ema | bcpnn).alias("detected_by_either"),
        rate(ema | bcpnn).alias("detection_rate_either"),
        rate(ema).alias("detection_rate_ema"),
        rate(bcpnn).alias("detection_rate_bcpnn"),
    )
