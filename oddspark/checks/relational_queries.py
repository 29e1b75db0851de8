"""Registered queries: joins, aggregates, deduplication, top-k, sets and whole plans."""

from pyspark.sql import functions as F

from oddspark.checks.registry import query
from oddspark.checks.star import metrics_sql
from oddspark.functions.metrics import FLAGS, METRICS
from oddspark.functions.names import build_matcher
from oddspark.operators import dedupe as E1
from oddspark.operators.matching import add_class_member
from oddspark.operators.ranking import forest_rows, rank_by_ic, top_n
from oddspark.operators.upsert import new_rows
from oddspark.plans import background as B
from oddspark.plans import cohort as H
from oddspark.plans import dashboard as D
from oddspark.plans import deltas as L
from oddspark.plans import signals as G
from oddspark.plans import sketches as K
from oddspark.plans.search import missing_terms
from oddspark.sources import bucketed
from oddspark.workspace import materialize, new_folder

ROUNDED = ", ".join(f"round({m}, 6) AS {m}" for m in METRICS)
SHOWN = f"drug_key, event_pt, a, {ROUNDED}, {', '.join(FLAGS)}"


def _flagged(star):
    return add_class_member(star.drug, build_matcher(star.dictionary))


@query("restrict_to_valid", """
SELECT primaryid, role_cod, drugname, prod_ai FROM drug
WHERE primaryid IN (SELECT primaryid FROM latest)""")
def _(star):
    kept = E1.restrict_to_valid(star.drug, E1.valid_reports(star.demo_core))
    return kept.select("primaryid", "role_cod", "drugname", "prod_ai")


@query("cohort_semi_join", """
SELECT primaryid, pt, drug_rec_act FROM reac WHERE primaryid IN (SELECT primaryid FROM ids)""")
def _(star):
    ids = H.cohort_ids(_flagged(star), E1.valid_reports(star.demo_core))
    return H.in_cohort(star.reac, ids)


@query("cooccurrence_join", """
SELECT primaryid, drug_key, event_pt, faers_quarter
FROM drug_pairs JOIN event_pairs USING (primaryid) JOIN latest USING (primaryid)""")
def _(star):
    valid = E1.valid_reports(star.demo_core)
    pairs = B.cooccurring_pairs(E1.report_drugs(star.drug), E1.report_events(star.reac), valid)
    return pairs.select("primaryid", "drug_key", "event_pt", "faers_quarter")


@query("star_join", """
SELECT sex, is_glp1, pt, count(*) AS n_rows, count(DISTINCT primaryid) AS n_reports
FROM reports JOIN drugs USING (primaryid) JOIN reactions USING (primaryid) GROUP BY ALL""")
def _(star):
    c = star.cohort
    rows = D.star_join(
        c.reports.select("primaryid", "sex"),
        c.drugs.select("primaryid", "is_glp1"),
        c.reactions.select("primaryid", "pt"),
    )
    return rows.groupBy("sex", "is_glp1", "pt").agg(
        F.sum("n_rows").alias("n_rows"), F.countDistinct("primaryid").alias("n_reports")
    )


@query("exists_semi", """
SELECT primaryid FROM reports WHERE EXISTS (
  SELECT 1 FROM outcomes o WHERE o.primaryid = reports.primaryid
  AND o.outc_cod IN ('DE','LT','HO','DS','CA'))""")
def _(star):
    c = star.cohort
    serious = D.serious_reports(c.outcomes)
    return c.reports.select("primaryid").join(serious, "primaryid", "left_semi")


@query("anti_join_missing", """
SELECT DISTINCT r.pt FROM reactions r LEFT JOIN (
  SELECT DISTINCT event_pt AS pt FROM signals WHERE drug_key = 'brand#1' AND is_signal_bcpnn) e
  ON e.pt = r.pt WHERE e.pt IS NULL AND r.pt IS NOT NULL ORDER BY 1""")
def _(star):
    signals = G.scan_signals(star.background, ["brand#1"])
    known = signals.filter("is_signal_bcpnn").select(F.col("event_pt").alias("pt"))
    return missing_terms(star.cohort.reactions, known).orderBy("pt")


@query("except_missing", """
SELECT event_pt FROM event_pairs EXCEPT
SELECT event_pt FROM signals WHERE drug_key = 'brand#2' AND is_signal_bcpnn""")
def _(star):
    signals = G.scan_signals(star.background, ["brand#2"]).filter("is_signal_bcpnn")
    terms = star.reac.filter("pt is not null").select(F.col("pt").alias("event_pt"))
    return new_rows(signals.select("event_pt"), terms, ["event_pt"])


GRID_DRUGS = ["brand#3", "never", "brand#12"]
GRID_EVENTS = ["STANDARD 1", "PROMO 0", "never 9", "SMALL 4"]
_GRID_CELLS = """(
  SELECT drug_pos, drug_key, event_pos, event_pt, n AS a, nd - n AS b, ne - n AS c,
         nt - nd - ne + n AS d
  FROM (SELECT drug_pos, g.drug_key, event_pos, g.event_pt,
    (SELECT coalesce(sum(n_reports), 0)::BIGINT FROM drug_event_counts x
      WHERE x.drug_key = g.drug_key AND x.event_pt = g.event_pt) AS n,
    (SELECT coalesce(sum(n_reports), 0)::BIGINT FROM drug_totals x
      WHERE x.drug_key = g.drug_key) AS nd,
    (SELECT coalesce(sum(n_reports), 0)::BIGINT FROM event_totals x
      WHERE x.event_pt = g.event_pt) AS ne,
    (SELECT coalesce(sum(n_reports), 0)::BIGINT FROM quarter_totals) AS nt
  FROM (SELECT * FROM (VALUES %s) d(drug_pos, drug_key)
        CROSS JOIN (VALUES %s) e(event_pos, event_pt)) g))""" % (
    ", ".join(f"({i}, '{d}')" for i, d in enumerate(GRID_DRUGS)),
    ", ".join(f"({i}, '{e}')" for i, e in enumerate(GRID_EVENTS)),
)


@query("grid_cross_join", f"""
SELECT drug_pos, drug_key, event_pos, event_pt, a, b, c, d, round(ror, 6) AS ror
FROM ({metrics_sql(_GRID_CELLS)})""")
def _(star):
    grid = G.compare_grid(star.background, GRID_DRUGS, GRID_EVENTS)
    return grid.select(
        "drug_pos", "drug_key", "event_pos", "event_pt", "a", "b", "c", "d", "ror"
    )


@query("compare_drugs", f"SELECT {SHOWN} FROM ({metrics_sql(_GRID_CELLS)})")
def _(star):
    return G.compare_drugs(star.background, GRID_DRUGS, GRID_EVENTS)


@query("compute_signal", f"""
SELECT a, b, c, d, {ROUNDED}, {', '.join(FLAGS)} FROM ({metrics_sql(_GRID_CELLS)})
WHERE drug_key = 'brand#12' AND event_pt = 'STANDARD 1'""")
def _(star):
    one = G.compute_signal(star.background, "brand#12", "STANDARD 1")
    return one.select("a", "b", "c", "d", *METRICS, *FLAGS)


@query("totals_join", "SELECT drug_key, event_pt, a, b, c, d FROM cells")
def _(star):
    pairs = star.background.drug_event_counts.select("drug_key", "event_pt").distinct()
    return G.contingency(star.background, pairs).select("drug_key", "event_pt", *"abcd")


_QUARTERS = ["1996Q1", "1997Q3", "1998Q4"]
_QUARTER_LIST = ", ".join(f"'{q}'" for q in _QUARTERS)


@query("contingency", f"""
SELECT p.drug_key, p.event_pt, p.n AS a, d.n - p.n AS b, e.n - p.n AS c,
  t.n - d.n - e.n + p.n AS d
FROM (SELECT drug_key, event_pt,
        coalesce(sum(n_reports) FILTER (faers_quarter IN ({_QUARTER_LIST})), 0)::BIGINT AS n
      FROM drug_event_counts GROUP BY ALL) p
JOIN (SELECT drug_key,
        coalesce(sum(n_reports) FILTER (faers_quarter IN ({_QUARTER_LIST})), 0)::BIGINT AS n
      FROM drug_totals GROUP BY ALL) d USING (drug_key)
JOIN (SELECT event_pt,
        coalesce(sum(n_reports) FILTER (faers_quarter IN ({_QUARTER_LIST})), 0)::BIGINT AS n
      FROM event_totals GROUP BY ALL) e USING (event_pt)
CROSS JOIN (SELECT sum(n_reports)::BIGINT AS n FROM quarter_totals
            WHERE faers_quarter IN ({_QUARTER_LIST})) t""")
def _(star):
    pairs = star.background.drug_event_counts.select("drug_key", "event_pt").distinct()
    cells = G.contingency(star.background, pairs, _QUARTERS)
    return cells.select("drug_key", "event_pt", *"abcd")


@query("quarter_totals", "SELECT * FROM quarter_totals")
def _(star):
    return star.live_background.quarter_totals


@query("event_totals", "SELECT * FROM event_totals")
def _(star):
    return star.live_background.event_totals


@query("drug_event_counts", "SELECT * FROM drug_event_counts")
def _(star):
    return star.live_background.drug_event_counts


@query("sum_over_quarters", f"""
SELECT drug_key, sum(n_reports)::BIGINT AS n FROM drug_totals
WHERE faers_quarter IN ({_QUARTER_LIST}) GROUP BY ALL""")
def _(star):
    return G.sum_over_quarters(star.background.drug_totals, ["drug_key"], "n", _QUARTERS)


@query("events_having_min", """
SELECT drug_key, event_pt, sum(n_reports)::BIGINT AS n_both FROM drug_event_counts
GROUP BY ALL HAVING sum(n_reports) >= 20 ORDER BY n_both DESC, drug_key, event_pt""")
def _(star):
    return G.events_having_min(star.background.drug_event_counts, min_cases=20).orderBy(
        F.desc("n_both"), "drug_key", "event_pt"
    )


def _events_of(*conditions: str, events: str = "") -> str:
    """SQL: how many reports name each event, over the reports that meet every condition by a set of ids."""
    ids = " ".join(f"INTERSECT SELECT primaryid FROM {c}" for c in conditions)
    return f""", chosen AS (SELECT primaryid FROM reports {ids}),
    named AS (SELECT DISTINCT pt, primaryid FROM reactions {events})
  SELECT pt AS event_pt, count(*) AS n_reports FROM named SEMI JOIN chosen USING (primaryid) GROUP BY pt"""


@query("count_distinct_reports", _events_of("drugs WHERE is_glp1"))
def _(star):
    ids = D.matching_reports(star.cohort)
    return D.events_of_reports(star.cohort.reactions, ids)


@query("query_cohort_events", _events_of(
    "drugs WHERE is_glp1 AND contains(lower(concat_ws(chr(10), drugname, prod_ai)), 'brand#1')",
    "reports WHERE age BETWEEN 18 AND 80 AND sex = 'BUILDING'",
    "outcomes WHERE outc_cod <> 'OT'") + " ORDER BY n_reports DESC, event_pt LIMIT 20")
def _(star):
    return D.query_cohort_events(
        star.cohort, "Brand#1", age_min=18, age_max=80, sex="BUILDING", serious_only=True
    )


@query("query_listed_events", _events_of(
    "drugs WHERE is_glp1", events="WHERE list_contains(['STANDARD 1', 'PROMO 0', 'never'], pt)"))
def _(star):
    return D.query_cohort_events(star.cohort, event_pts=["STANDARD 1", "PROMO 0", "never"])


@query("cohort_overview", """
SELECT count(*) FILTER (kind = 'report') AS total_reports, count(*) FILTER (kind = 'mention') AS total_drug_mentions,
  count(*) FILTER (kind = 'event') AS total_reactions, count(DISTINCT pt) AS unique_events,
  count(DISTINCT primaryid) FILTER (kind = 'outcome') AS serious_reports
FROM (
  SELECT 'report' AS kind, primaryid, NULL AS pt FROM reports
  UNION ALL SELECT 'mention', primaryid, NULL FROM drugs WHERE is_glp1
  UNION ALL SELECT 'event', primaryid, pt FROM reactions
  UNION ALL SELECT 'outcome', primaryid, NULL FROM outcomes WHERE outc_cod <> 'OT')""")
def _(star):
    return D.cohort_overview(star.cohort)


@query("reports_by_quarter", """
SELECT faers_quarter, count(*) AS n_reports FROM reports GROUP BY ALL ORDER BY 1""")
def _(star):
    return D.reports_by_quarter(star.cohort.reports)


@query("drug_distribution", """
SELECT drugname, count(*) AS n_reports FROM drugs WHERE is_glp1
GROUP BY ALL ORDER BY n_reports DESC, drugname LIMIT 20""")
def _(star):
    return D.drug_distribution(star.cohort.drugs)


@query("ingredient_distribution", """
SELECT active_ingredient, count(*) AS n_mentions, count(DISTINCT primaryid) AS n_reports
FROM drugs WHERE is_glp1 GROUP BY ALL ORDER BY n_mentions DESC, active_ingredient LIMIT 20""")
def _(star):
    return D.ingredient_distribution(star.cohort.drugs)


_GROUPS = """SELECT CASE WHEN age < 18 THEN '<18' WHEN age < 40 THEN '18-39'
  WHEN age < 60 THEN '40-59' WHEN age < 75 THEN '60-74' WHEN age >= 75 THEN '75+'
  ELSE 'Unknown' END AS age_group, coalesce(sex, 'Unknown') AS sex, primaryid FROM reports"""


@query("demographics", f"""
SELECT age_group, sex, count(*) AS n_reports FROM ({_GROUPS}) GROUP BY ALL
ORDER BY age_group, sex""")
def _(star):
    return D.demographics(star.cohort.reports)


SEXES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "Unknown"]


@query("demographics_pivot", f"""
SELECT age_group, {', '.join(f"count(*) FILTER (sex = '{s}') AS {s}" for s in SEXES)}
FROM ({_GROUPS}) GROUP BY ALL""")
def _(star):
    return D.demographics_pivot(D.demographics(star.cohort.reports), SEXES)


@query("load_row_counts", """
SELECT 'demo_read' AS step, count(*) AS n_rows FROM demo
UNION ALL SELECT 'demo_deduplicated', count(*) FROM latest
UNION ALL SELECT 'drug_read', count(*) FROM drug
UNION ALL SELECT 'cohort_ids', count(*) FROM ids
UNION ALL SELECT 'reports', count(*) FROM reports
UNION ALL SELECT 'drugs', count(*) FROM drugs
UNION ALL SELECT 'reactions', count(*) FROM reactions
UNION ALL SELECT 'outcomes', count(*) FROM outcomes
UNION ALL SELECT 'indications', count(*) FROM indications""")
def _(star):
    stored = star.write_cohort(new_folder(star.spark, "cohort"))
    return H.load_row_counts(star.demo, star.kept.drug, stored, E1.valid_reports(star.demo_core))


@query("dedupe_latest_version", """
SELECT primaryid, caseid, caseversion::VARCHAR AS caseversion, age, sex, faers_quarter
FROM latest""")
def _(star):
    latest = E1.dedupe_latest_version(star.demo)
    return latest.select(
        "primaryid", "caseid", F.col("caseversion").cast("string").alias("caseversion"), "age",
        "sex", "faers_quarter",
    )


@query("dedupe_all_quarters", """
SELECT primaryid, caseid, caseversion::VARCHAR AS caseversion, faers_quarter FROM (
  SELECT *, row_number() OVER (PARTITION BY caseid
    ORDER BY caseversion DESC NULLS FIRST, primaryid DESC) AS rn FROM demo) WHERE rn = 1""")
def _(star):
    latest = E1.dedupe_latest_version(star.demo_core, scope="all")
    return latest.withColumn("caseversion", F.col("caseversion").cast("string"))


@query("distinct_pairs", """
SELECT primaryid, drug_key AS item FROM drug_pairs
UNION ALL SELECT primaryid, event_pt FROM event_pairs""")
def _(star):
    drugs = E1.report_drugs(star.drug).withColumnRenamed("drug_key", "item")
    return drugs.unionByName(E1.report_events(star.reac).withColumnRenamed("event_pt", "item"))


@query("top_n", """
SELECT event_pt, sum(n_reports)::BIGINT AS n FROM event_totals
GROUP BY ALL ORDER BY n DESC, event_pt LIMIT 10""")
def _(star):
    totals = G.sum_over_quarters(star.background.event_totals, ["event_pt"], "n")
    return top_n(totals, "n", 10, "event_pt")


@query("forest_rows", """
SELECT drug_key, event_pt, round(ror, 6) AS ror, round(ror_ci_low, 6) AS ror_ci_low,
  round(ror_ci_high, 6) AS ror_ci_high, is_signal_ema
FROM (SELECT * FROM signals ORDER BY ic DESC, drug_key, event_pt LIMIT 20) ORDER BY ror""")
def _(star):
    best = forest_rows(G.scan_signals(star.background))
    return best.select("drug_key", "event_pt", "ror", "ror_ci_low", "ror_ci_high",
                       "is_signal_ema")


@query("ordered_listing", "SELECT DISTINCT pt FROM reac WHERE pt IS NOT NULL ORDER BY pt")
def _(star):
    return star.reac.filter("pt is not null").select("pt").distinct().orderBy("pt")


@query("intersect_ids", "SELECT primaryid, faers_quarter FROM ids")
def _(star):
    return H.cohort_ids(_flagged(star), E1.valid_reports(star.demo_core))


@query("build_cohort", """
SELECT 'reports' AS table_name, primaryid, age_unit AS v1, sex AS v2,
  round(age, 6) AS number FROM reports
UNION ALL SELECT 'drugs', primaryid, drugname, prod_ai, dose_amt FROM drugs
UNION ALL SELECT 'reactions', primaryid, pt, drug_rec_act, 0 FROM reactions
UNION ALL SELECT 'outcomes', primaryid, outc_cod, '', 0 FROM outcomes
UNION ALL SELECT 'indications', primaryid, indi_pt, '', indi_drug_seq FROM indications""")
def _(star):
    c = star.live_cohort
    zero, empty = F.lit(0.0), F.lit("")
    parts = [
        ("reports", c.reports, "age_unit", "sex", F.col("age")),
        ("drugs", c.drugs, "drugname", "prod_ai", F.col("dose_amt")),
        ("reactions", c.reactions, "pt", "drug_rec_act", zero),
        ("outcomes", c.outcomes, "outc_cod", empty, zero),
        ("indications", c.indications, "indi_pt", empty,
         F.col("indi_drug_seq").cast("double")),
    ]
    total = None
    for name, df, v1, v2, number in parts:
        v2 = F.col(v2) if isinstance(v2, str) else v2
        one = df.select(
            F.lit(name).alias("table_name"), "primaryid", F.col(v1).alias("v1"),
            v2.alias("v2"), number.alias("number"),
        )
        total = one if total is None else total.unionByName(one)
    return total


def _listed(stored):
    """All counts of a background in one table."""
    empty = F.lit("")
    parts = [
        stored.quarter_totals.withColumns(
            {"kind": F.lit("quarter"), "drug_key": empty, "event_pt": empty}),
        stored.drug_totals.withColumns({"kind": F.lit("drug"), "event_pt": empty}),
        stored.event_totals.withColumns({"kind": F.lit("event"), "drug_key": empty}),
        stored.drug_event_counts.withColumn("kind", F.lit("pair")),
    ]
    columns = ["kind", "drug_key", "event_pt", "faers_quarter", "n_reports"]
    total = parts[0].select(*columns)
    for part in parts[1:]:
        total = total.unionByName(part.select(*columns))
    return total.withColumn("faers_quarter", F.col("faers_quarter").cast("string"))


@query("build_background", """
SELECT 'quarter' AS kind, '' AS drug_key, '' AS event_pt, faers_quarter, n_reports
FROM quarter_totals
UNION ALL SELECT 'drug', drug_key, '', faers_quarter, n_reports FROM drug_totals
UNION ALL SELECT 'event', '', event_pt, faers_quarter, n_reports FROM event_totals
UNION ALL SELECT 'pair', drug_key, event_pt, faers_quarter, n_reports FROM drug_event_counts""")
def _(star):
    stored = B.write_background(
        star.demo_core, star.drug, star.reac, new_folder(star.spark, "background")
    )
    return _listed(stored)


@query("scan_signals", f"SELECT {SHOWN}, b, c, d FROM signals")
def _(star):
    return rank_by_ic(G.scan_signals(star.background))


@query("precompute_signals", f"""
SELECT {SHOWN}, b, c, d FROM signals WHERE drug_key LIKE 'brand#%'""")
def _(star):
    brands = [f"brand#{n}" for n in range(1, 26)]
    path = new_folder(star.spark, "signals")
    return G.precompute_signals(star.background, brands, path)


@query("detect_signals", f"""
SELECT event_pt, a, {ROUNDED}, {', '.join(FLAGS)} FROM signals
WHERE drug_key = 'brand#5' AND a >= 3 AND (is_signal_ema OR is_signal_bcpnn)
ORDER BY signals.ic DESC, event_pt LIMIT 20""")
def _(star):
    stored = materialize(
        G.scan_signals(star.background, ["brand#5", "brand#6"]), "stored-signals"
    )
    return G.detect_signals(stored, star.background, "brand#5", min_cases=3)


@query("signal_explorer", """
SELECT 'table' AS part, event_pt, a, round(ror, 3) AS ror FROM (
  SELECT * FROM signals WHERE drug_key = 'brand#8' AND is_signal_ema
  ORDER BY ic DESC, event_pt LIMIT 30)
UNION ALL SELECT 'forest', event_pt, a, round(ror, 6) FROM (
  SELECT * FROM signals WHERE drug_key = 'brand#8' AND is_signal_ema
  ORDER BY ic DESC, event_pt LIMIT 20)
UNION ALL SELECT 'ema', event_pt, a, round(ror, 6) FROM signals
  WHERE drug_key = 'brand#8' AND is_signal_ema
UNION ALL SELECT 'scanned', event_pt, a, round(ror, 6) FROM signals WHERE drug_key = 'brand#8'
UNION ALL SELECT 'n_scanned', '', count(*), 0 FROM signals WHERE drug_key = 'brand#8'
UNION ALL SELECT 'n_ema', '', count(*), 0 FROM signals
  WHERE drug_key = 'brand#8' AND is_signal_ema""")
def _(star):
    stored = materialize(G.scan_signals(star.background), "stored-signals")
    shown = G.signal_explorer(stored, star.background, "brand#8", min_cases=3)
    counts = shown.pop("counts")
    total = None
    for part, df in shown.items():
        one = df.select(F.lit(part).alias("part"), "event_pt", "a", "ror")
        total = one if total is None else total.unionByName(one)
    for name in ("n_scanned", "n_ema"):
        total = total.unionByName(counts.select(
            F.lit(name).alias("part"), F.lit("").alias("event_pt"), F.col(name).alias("a"),
            F.lit(0.0).alias("ror"),
        ))
    return total


_LOADS_SQL = """, winners AS (
  SELECT * EXCLUDE (_rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY caseid
      ORDER BY caseversion DESC NULLS FIRST, primaryid DESC) AS _rn FROM demo) WHERE _rn = 1)
SELECT 'quarter' AS kind, '' AS drug_key, '' AS event_pt, faers_quarter, count(*) AS n_reports
FROM winners GROUP BY ALL
UNION ALL SELECT 'drug', drug_key, '', faers_quarter, count(*)
FROM drug_pairs JOIN winners USING (primaryid) GROUP BY ALL
UNION ALL SELECT 'event', '', event_pt, faers_quarter, count(*)
FROM event_pairs JOIN winners USING (primaryid) GROUP BY ALL
UNION ALL SELECT 'pair', drug_key, event_pt, faers_quarter, count(*)
FROM drug_pairs JOIN event_pairs USING (primaryid) JOIN winners USING (primaryid) GROUP BY ALL"""


@query("apply_load", _LOADS_SQL)
def _(star):
    """The background after two loads: reports from 1999 on come second, as do all fifth lines of earlier ones."""
    path, first = new_folder(star.spark, "loads"), F.col("faers_quarter") < "1999"
    early = star.demo_core.filter(first).select("primaryid", F.lit(True).alias("_early")).distinct()
    in_time = F.col("l_linenumber") != 5

    def parts(child, column):
        """Child rows that come with the first load, and those that come with the second."""
        told = child.join(early.hint("merge"), "primaryid", "left")
        soon = told.filter(F.col("_early") & in_time)
        later = told.filter(F.col("_early").isNull() | ~in_time)
        return soon.drop(column, "_early"), later.drop(column, "_early")

    number = F.col("drug_seq").cast("int").alias("l_linenumber")
    drugs = parts(star.kept.drug.select("*", number), "l_linenumber")
    events = parts(star.kept.numbered_reac, "l_linenumber")
    L.apply_load(star.spark, path, star.demo_core.filter(first), drugs[0], events[0])
    return _listed(L.apply_load(star.spark, path, star.demo_core.filter(~first), drugs[1], events[1]))


def _event_sketches(star):
    return K.write_sketches(E1.report_events(star.kept.reac), star.kept_valid, "event_pt",
                            new_folder(star.spark, "sketches"))


def _near(estimated: str, exact: str):
    """Whether an estimate lies within five standard errors of the exact count."""
    return F.abs(F.col(estimated) - F.col(exact)) <= 5 * K.relative_error() * F.col(exact)


@query("event_report_sketches", """
SELECT event_pt, sum(n_reports)::BIGINT AS n_reports, true AS is_near FROM event_totals GROUP BY event_pt""")
def _(star):
    estimated = K.estimated_reports(_event_sketches(star), "event_pt")
    exact = star.background.event_totals.groupBy("event_pt").agg(F.sum("n_reports").alias("n_reports"))
    both = exact.join(estimated, "event_pt", "left")
    return both.select("event_pt", "n_reports", _near("n_estimated", "n_reports").alias("is_near"))


@query("any_term_report_sketches", """
SELECT p_type AS kind, count(DISTINCT primaryid) AS n_reports, true AS is_near
FROM event_pairs JOIN latest USING (primaryid)
JOIN (SELECT DISTINCT p_type, p_type || ' ' || (p_size // 10) AS event_pt FROM part WHERE p_size < 50)
  USING (event_pt) GROUP BY p_type""")
def _(star):
    term = F.concat("p_type", F.lit(" "), F.floor(F.col("p_size") / 10).cast("string"))
    groups = star.table("part").filter("p_size < 50").select(
        F.col("p_type").alias("kind"), term.alias("event_pt")).distinct()
    estimated = K.estimated_reports_of(_event_sketches(star), groups, "event_pt", "kind")
    held = B.in_valid_reports(E1.report_events(star.reac), E1.valid_reports(star.demo_core))
    exact = held.join(groups, "event_pt").groupBy("kind").agg(F.count_distinct("primaryid").alias("n_reports"))
    both = exact.join(estimated, "kind", "left")
    return both.select("kind", "n_reports", _near("n_estimated", "n_reports").alias("is_near"))


@query("rows_per_report", """
SELECT primaryid, coalesce(d.n, 0) AS n_drugs, coalesce(r.n, 0) AS n_reactions
FROM latest
LEFT JOIN (SELECT primaryid, count(*) AS n FROM drug GROUP BY primaryid) d USING (primaryid)
LEFT JOIN (SELECT primaryid, count(*) AS n FROM reac GROUP BY primaryid) r USING (primaryid)""")
def _(star):
    path = new_folder(star.spark, "by-report")
    label = path.rsplit("-", 1)[-1]
    tables = {"valid": E1.valid_reports(star.demo_core), "drug": star.drug, "reac": star.reac}
    stored = {
        name: bucketed.write_by_report(df, f"by_report_{name}_{label}", f"{path}/{name}", buckets=32)
        for name, df in tables.items()
    }
    return bucketed.rows_per_report(
        stored["valid"], {"n_drugs": stored["drug"], "n_reactions": stored["reac"]})
