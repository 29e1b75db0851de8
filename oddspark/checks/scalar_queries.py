"""Registered queries: projections, predicates and scalar functions."""

from pyspark.sql import functions as F

from oddspark.checks.registry import query
from oddspark.checks.star import metrics_sql, normalized
from oddspark.functions import demographics as D
from oddspark.functions import metrics as M
from oddspark.functions import names as N
from oddspark.operators.matching import (
    add_class_member,
    add_member_by_name,
    class_names,
    matched_names,
)
from oddspark.operators.ranking import rank_by_ic
from oddspark.plans.cohort import shape_reports
from oddspark.plans.signals import (
    TABLE_COLUMNS,
    TOOL_COLUMNS,
    contingency,
    filter_flags_or,
    scan_signals,
    stored_signals,
)
from oddspark.workspace import materialize


@query("project_rename_cast", """
SELECT primaryid, caseid, caseversion::VARCHAR AS caseversion,
  CASE WHEN length(event_dt) = 8 THEN try_strptime(event_dt, '%Y%m%d')::DATE::VARCHAR END
    AS event_dt,
  strptime(fda_dt, '%Y%m%d')::DATE::VARCHAR AS fda_dt, round(age_years, 6) AS age,
  age_cod AS age_unit, sex, reporter_country, occr_country AS occur_country,
  rept_cod AS reporter_type, false AS serious, faers_quarter FROM years""")
def _(star):
    return shape_reports(star.demo).withColumns({
        c: F.col(c).cast("string") for c in ("event_dt", "fda_dt", "caseversion")
    })


@query("lenient_cast", """
SELECT primaryid, drug_seq, dose_amt, try_cast(dose_amt AS DOUBLE) AS dose FROM drug""")
def _(star):
    dose = D.lenient_cast(F.col("dose_amt"), "double").alias("dose")
    return star.drug.select("primaryid", "drug_seq", "dose_amt", dose)


@query("lenient_date", """
SELECT primaryid, CASE WHEN length(event_dt) = 8
  THEN try_strptime(event_dt, '%Y%m%d')::DATE::VARCHAR END AS event_date FROM demo""")
def _(star):
    date = D.lenient_date(F.col("event_dt")).cast("string").alias("event_date")
    return star.demo.select("primaryid", date)


@query("coalesce_nonempty", """
SELECT primaryid, coalesce(nullif(prod_ai, ''), drugname) AS name FROM drug""")
def _(star):
    name = N.coalesce_nonempty(F.col("prod_ai"), F.col("drugname")).alias("name")
    return star.drug.select("primaryid", name)


@query("filter_in_list", """
SELECT primaryid, role_cod, drugname FROM drug WHERE role_cod IN ('PS', 'SS')""")
def _(star):
    chosen = F.col("role_cod").isin("PS", "SS")
    return star.drug.filter(chosen).select("primaryid", "role_cod", "drugname")


@query("filter_not_null", "SELECT primaryid, pt FROM reac WHERE pt IS NOT NULL")
def _(star):
    return star.reac.filter(F.col("pt").isNotNull()).select("primaryid", "pt")


@query("flag_not_null", "SELECT primaryid, pt IS NOT NULL AS has_term FROM reac")
def _(star):
    return star.reac.select("primaryid", F.col("pt").isNotNull().alias("has_term"))


@query("like_contains_ci", """
SELECT primaryid, drugname, prod_ai FROM drug
WHERE lower(drugname) LIKE '%brand#1%ring%' OR lower(prod_ai) LIKE '%brand#1%ring%'""")
def _(star):
    hits = D.like_contains_ci([F.col("drugname"), F.col("prod_ai")], "BRAND#1%ring")
    return star.drug.filter(D.all_of(hits)).select("primaryid", "drugname", "prod_ai")


@query("range_filter", """
SELECT primaryid, round(age_years, 6) AS age FROM years
WHERE age_years >= 18 AND age_years <= 65""")
def _(star):
    reports = shape_reports(star.demo)
    chosen = D.all_of(D.in_range(F.col("age"), 18, 65))
    return reports.filter(chosen).select("primaryid", "age")


@query("any_of_list", """
SELECT primaryid, pt FROM reac WHERE pt IN ('STANDARD 1', 'PROMO 3', 'never')""")
def _(star):
    chosen = D.any_of(F.col("pt"), ["STANDARD 1", "PROMO 3", "never"]) + D.any_of(F.col("pt"), [])
    return star.reac.filter(D.all_of(chosen)).select("primaryid", "pt")


@query("dynamic_conjunction", """
SELECT primaryid, sex, round(age_years, 6) AS age FROM years
WHERE sex = 'BUILDING' AND age_years >= 40""")
def _(star):
    conditions = [F.col("sex") == "BUILDING", *D.in_range(F.col("age"), 40, None)]
    reports = shape_reports(star.demo).filter(D.all_of(conditions))
    return reports.select("primaryid", "sex", "age")


_BAND_SQL = """CASE WHEN age < 18 THEN '<18' WHEN age < 40 THEN '18-39' WHEN age < 60 THEN '40-59'
  WHEN age < 75 THEN '60-74' WHEN age >= 75 THEN '75+' ELSE 'Unknown' END"""


@query("case_buckets", f"""
SELECT primaryid, {_BAND_SQL.replace("age", "age_years")} AS age_group FROM years""")
def _(star):
    reports = shape_reports(star.demo)
    return reports.select("primaryid", D.age_band(F.col("age")).alias("age_group"))


@query("coalesce_default", "SELECT primaryid, coalesce(sex, 'Unknown') AS sex FROM demo")
def _(star):
    return star.demo.select("primaryid", D.or_unknown(F.col("sex")).alias("sex"))


@query("filter_flags_or", """
SELECT drug_key, event_pt, is_signal_ema, is_signal_bcpnn FROM signals
WHERE is_signal_ema OR is_signal_bcpnn""")
def _(star):
    signals = filter_flags_or(scan_signals(star.background))
    return signals.select("drug_key", "event_pt", "is_signal_ema", "is_signal_bcpnn")


@query("filter_stored_signals", """
SELECT drug_key, event_pt, a FROM signals
WHERE drug_key IN ('brand#1', 'brand#2', 'never') AND a >= 10""")
def _(star):
    stored = materialize(scan_signals(star.background), "stored-signals")
    chosen = stored_signals(stored, ["brand#1", "brand#2", "never"], 10)
    return chosen.select("drug_key", "event_pt", "a")


@query("project_metrics", """
SELECT event_pt, a, round(prr, 3) AS prr, round(prr_chi2, 3) AS prr_chi2, round(ror, 3) AS ror,
  round(ror_ci_low, 3) AS ror_ci_low, round(ror_ci_high, 3) AS ror_ci_high,
  round(ic, 3) + 0.0 AS ic, round(ic_ci_low, 3) + 0.0 AS ic_ci_low, is_signal_ema,
  is_signal_bcpnn FROM signals""")
def _(star):
    signals = scan_signals(star.background).select(*TOOL_COLUMNS)
    kept = [c for c in TOOL_COLUMNS if c not in M.METRICS]
    return signals.select(*kept, *M.rounded(M.METRICS))


@query("project_table", """
SELECT event_pt, a, round(prr, 6) AS prr, round(prr_chi2, 6) AS prr_chi2, round(ror, 6) AS ror,
  round(ror_ci_low, 6) AS ror_ci_low, round(ror_ci_high, 6) AS ror_ci_high, round(ic, 6) AS ic,
  round(ic_ci_low, 6) AS ic_ci_low FROM signals""")
def _(star):
    return scan_signals(star.background).select(*TABLE_COLUMNS)


@query("numeric_and_bool_cast", """
SELECT primaryid, try_cast(dose_amt AS DOUBLE) AS dose,
  coalesce(try_cast(dose_amt AS DOUBLE) > 20, false) AS high FROM drug""")
def _(star):
    dose = D.lenient_cast(F.col("dose_amt"), "double")
    high = F.coalesce(dose > 20, F.lit(False)).alias("high")
    return star.drug.select("primaryid", dose.alias("dose"), high)


@query("split_trim_list", """
SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split(text, ','),
  lambda x: trim(x)), lambda x: x <> ''), '|') AS items FROM conversations""")
def _(star):
    items = F.array_join(D.split_trim_list(F.col("text")), "|").alias("items")
    return star.table("conversations").select("conv_id", "turn", items)


@query("normalize_drug_name", f"""
SELECT drugname, {normalized("drugname")} AS name, count(*) AS n_rows FROM drug GROUP BY ALL""")
def _(star):
    counted = star.drug.groupBy("drugname").agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.select("drugname", N.normalize_drug_name(F.col("drugname")).alias("name"),
                          "n_rows")


@query("match_class_member", "SELECT primaryid, drugname, prod_ai, active_ingredient FROM member")
def _(star):
    flagged = add_class_member(star.drug, N.build_matcher(star.dictionary))
    return flagged.select("primaryid", "drugname", "prod_ai", "active_ingredient")


@query("dictionary_contains_join", """
SELECT primaryid, drugname, prod_ai, active_ingredient FROM member""")
def _(star):
    joined = add_class_member(star.drug, N.build_matcher(star.dictionary), gram=1)
    return joined.select("primaryid", "drugname", "prod_ai", "active_ingredient")


@query("class_names", """
SELECT primaryid, drugname, prod_ai, active_ingredient FROM member""")
def _(star):
    names = materialize(class_names(star.drug, N.build_matcher(star.dictionary)), "class-names")
    flagged = add_member_by_name(star.drug, names)
    return flagged.select("primaryid", "drugname", "prod_ai", "active_ingredient")


@query("matched_names", """
SELECT name, CASE WHEN contains(name, 'ring') THEN 'r' WHEN contains(name, 'bolt') THEN 'b'
  WHEN contains(name, 'in') THEN 'i' END AS active
FROM (SELECT DISTINCT p_name AS name FROM part)
WHERE contains(name, 'ring') OR contains(name, 'bolt') OR contains(name, 'in')""")
def _(star):
    rows = [("ring", "r", 0, 0), ("bolt", "b", 1, 0), ("in", "i", 2, 0)]
    matcher = star.spark.createDataFrame(
        rows, "variant string, active string, dict_pos int, name_pos int"
    )
    return matched_names(star.table("part").select(F.col("p_name").alias("name")).distinct(), matcher)


@query("build_matcher", """
SELECT variant, lower(brand) AS active FROM (
  SELECT p_brand AS variant, p_brand AS brand FROM part UNION
  SELECT lower(p_name), max(p_brand) FROM part GROUP BY p_name)""")
def _(star):
    # One dictionary row per brand with the names of its parts, brands in text order.
    members = star.table("part").select("p_brand", "p_name").distinct()
    rows = members.select(
        F.lit(0).alias("position"),
        F.col("p_brand").alias("active_ingredient"),
        F.array(F.upper("p_name")).alias("brand_names"),
    )
    place = F.substring("active_ingredient", 7, 9)
    ordered = rows.withColumn("position", F.ascii(place) * 256 + F.ascii(F.substring(place, 2, 1)))
    matcher = N.build_matcher(ordered)
    return matcher.select("variant", F.lower("active").alias("active"))


@query("age_to_years", """
SELECT primaryid, age, age_cod, round(age_years, 6) AS years FROM years""")
def _(star):
    years = D.age_to_years(D.lenient_cast(F.col("age"), "double"), F.col("age_cod"))
    return star.demo.select("primaryid", "age", "age_cod", years.alias("years"))


def _metric(name: str, columns: list[str]):
    shown = ", ".join(
        c if c.startswith("is_") else f"round({c}, 6) AS {c}" for c in columns
    )

    @query(name, f"SELECT drug_key, event_pt, {shown} FROM signals")
    def _(star):
        return scan_signals(star.background).select("drug_key", "event_pt", *columns)


_metric("yates_chi2", ["prr_chi2"])
_metric("prr", ["prr"])
_metric("ror_ci", ["ror", "ror_ci_low", "ror_ci_high"])
_metric("information_component", ["ic", "ic_ci_low"])
_metric("signal_flags", ["is_signal_ema", "is_signal_bcpnn"])


@query("contingency_cells", "SELECT drug_key, event_pt, a, b, c, d FROM signals")
def _(star):
    return scan_signals(star.background).select("drug_key", "event_pt", *M.CELLS)


@query("disproportionality", """
SELECT drug_key, event_pt, a, b, c, d, round(prr, 6) AS prr, round(prr_chi2, 6) AS prr_chi2,
  round(ror, 6) AS ror, round(ror_ci_low, 6) AS ror_ci_low, round(ror_ci_high, 6) AS ror_ci_high,
  round(ic, 6) AS ic, round(ic_ci_low, 6) AS ic_ci_low, is_signal_ema, is_signal_bcpnn
FROM (""" + metrics_sql("cells") + ")")
def _(star):
    counts = star.background.drug_event_counts
    pairs = counts.select("drug_key", "event_pt").distinct()
    return M.disproportionality(contingency(star.background, pairs))


@query("text_basics", """
SELECT primaryid, lower(drugname) AS low, upper(prod_ai) AS up, trim(drugname) AS trimmed,
  contains(drugname, 'RING') AS has_ring, drugname LIKE '%(%) 4_ MG%' AS like_forty FROM drug""")
def _(star):
    name = F.col("drugname")
    return star.drug.select(
        "primaryid",
        F.lower(name).alias("low"),
        F.upper("prod_ai").alias("up"),
        F.trim(name).alias("trimmed"),
        F.contains(name, F.lit("RING")).alias("has_ring"),
        name.like("%(%) 4_ MG%").alias("like_forty"),
    )


@query("round_prefix_length", """
SELECT conv_id, turn, left(text, 500) AS preview, length(text) AS n_chars,
  round(length(text) / 7, 3) AS sevenths FROM conversations""")
def _(star):
    text = F.col("text")
    return star.table("conversations").select(
        "conv_id",
        "turn",
        F.substring(text, 1, 500).alias("preview"),
        F.length(text).cast("long").alias("n_chars"),
        F.round(F.length(text) / 7, 3).alias("sevenths"),
    )


@query("ci_error_bars", """
SELECT drug_key, event_pt, round(ror_ci_high - ror, 6) AS error_plus,
  round(ror - ror_ci_low, 6) AS error_minus FROM signals""")
def _(star):
    signals = scan_signals(star.background).withColumns(M.ci_error_bars())
    return signals.select("drug_key", "event_pt", "error_plus", "error_minus")


@query("rank_by_ic", """
SELECT drug_key, event_pt, round(ic, 6) AS ic FROM signals
ORDER BY signals.ic DESC, drug_key, event_pt""")
def _(star):
    return rank_by_ic(scan_signals(star.background)).select("drug_key", "event_pt", "ic")
