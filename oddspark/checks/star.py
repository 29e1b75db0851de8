"""The given star-schema tables seen as spontaneous reports.

An order is a report, its customer the case and the person, a line item is both a drug mention
(the brand of its part) and a reaction (type and size band of its part).
"""

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddspark.operators.dedupe import valid_reports
from oddspark.plans.background import Background, build_background, read_background, write_background
from oddspark.plans.cohort import Cohort, build_cohort, read_cohort, write_cohort
from oddspark.sources.bucketed import keep_by_report, read_kept
from oddspark.sources.fixtures import inline_dictionary
from oddspark.workspace import new_folder

# A drug class among the brands: order matters, as 'brand#1' is part of 'brand#11' and others.
STAR_CLASS = [
    ("brand#19", ["BRAND#9"], "both"),
    ("brand#1", ["widget"], "diabetes"),
    ("brand#7", ["Brand#4", "brand#11"], "both"),
]


#: Where this process has stored what was built from a folder.
STORED: dict[tuple[str, str, str], str] = {}


class Star:
    """Lazy views for one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def demo_core(self) -> DataFrame:
        """Ids, version and quarter of the reports, from the orders alone."""
        date = F.col("o_orderdate")
        return self.table("orders").select(
            F.col("o_orderkey").alias("primaryid"),
            F.col("o_custkey").alias("caseid"),
            F.when(
                ~F.col("o_orderpriority").startswith("4"),
                F.datediff(date, F.lit("1990-01-01").cast("date")),
            ).alias("caseversion"),
            F.concat(F.year(date), F.lit("Q"), F.quarter(date)).alias("faers_quarter"),
        )

    @cached_property
    def demo(self) -> DataFrame:
        """Reports with the person's details, as raw text where the raw files hold text."""
        date = F.col("o_orderdate")
        day = F.date_format(date, "yyyyMMdd")
        orders = self.table("orders")
        people = self.table("customer").join(
            self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left"
        ).hint("merge")
        joined = orders.join(people, F.col("o_custkey") == F.col("c_custkey"), "left")
        return joined.select(
            F.col("o_orderkey").alias("primaryid"),
            F.col("o_custkey").alias("caseid"),
            F.when(
                ~F.col("o_orderpriority").startswith("4"),
                F.datediff(date, F.lit("1990-01-01").cast("date")),
            ).alias("caseversion"),
            F.when(F.col("o_orderstatus") == "P", F.substring(day, 1, 6))
            .when(F.col("o_orderstatus") == "O", F.concat(F.substring(day, 1, 6), F.lit("31")))
            .otherwise(day)
            .alias("event_dt"),
            day.alias("fda_dt"),
            F.when(F.col("c_acctbal") < 0, "UNK")
            .otherwise(F.floor(F.col("c_acctbal") / 100).cast("string"))
            .alias("age"),
            F.when(F.col("o_orderpriority").startswith("2"), "mon")
            .when(F.col("o_orderpriority").startswith("3"), F.lit(None))
            .when(F.col("o_orderpriority").startswith("4"), "XX")
            .otherwise("YR")
            .alias("age_cod"),
            F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("sex"),
            F.col("n_name").alias("reporter_country"),
            F.lower("n_name").alias("occr_country"),
            F.substring("o_orderpriority", 1, 1).alias("rept_cod"),
            F.concat(F.year(date), F.lit("Q"), F.quarter(date)).alias("faers_quarter"),
        )

    # Tables that grow with the input are joined by merge at any size: none travels through the driver, and the
    # plan, with what it shuffles, is the same for small and large folders.
    def _with_parts(self, lines: DataFrame) -> DataFrame:
        return lines.join(self.table("part").hint("merge"), F.col("l_partkey") == F.col("p_partkey"))

    @cached_property
    def _lines(self) -> DataFrame:
        return self._with_parts(self.table("lineitem"))

    @cached_property
    def _kept_lines(self) -> DataFrame:
        """The lines with their parts, stored by report once for this folder and application."""
        columns = ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "p_name", "p_brand", "p_type", "p_size"]
        path = self._stored("lines", lambda path: keep_by_report(
            self._lines.select(*columns), path, ["l_orderkey"], gather=True))
        return read_kept(self.spark, path)

    @cached_property
    def kept(self) -> "Star":
        """The same views, with those of lines on the stored ones: for what reads several of them by report."""
        same = Star(self.spark, self.folder)
        same._lines = self._kept_lines
        return same

    @cached_property
    def kept_valid(self) -> DataFrame:
        """The deduplicated reports, stored by report like the lines."""
        path = self._stored("valid", lambda path: keep_by_report(
            valid_reports(self.demo_core), path, ["primaryid"], gather=True))
        return read_kept(self.spark, path)

    @cached_property
    def _quartered_lines(self) -> DataFrame:
        """The lines with the quarter of their report, joined before the parts bring their long texts."""
        quarters = self.demo_core.select("primaryid", "faers_quarter").hint("merge")
        lines = self.table("lineitem")
        return self._with_parts(lines.join(quarters, F.col("l_orderkey") == F.col("primaryid")).drop("primaryid"))

    @cached_property
    def drug(self) -> DataFrame:
        return self._drug_of(self._lines)

    def _drug_of(self, lines: DataFrame, *more: str) -> DataFrame:
        size = F.col("p_size").cast("string")
        return lines.select(
            F.col("l_orderkey").alias("primaryid"),
            F.col("l_linenumber").cast("string").alias("drug_seq"),
            F.when(F.col("l_returnflag") == "A", "PS")
            .when(F.col("l_returnflag") == "N", "SS")
            .otherwise("C")
            .alias("role_cod"),
            F.when(F.col("l_linenumber") == 3, F.upper("p_name"))
            .otherwise(
                F.concat(
                    F.upper("p_brand"), F.lit(" ("), F.upper("p_name"), F.lit(") "), size,
                    F.lit(" MG INJ"),
                )
            )
            .alias("drugname"),
            F.when(F.col("l_linestatus") == "O", "")
            .otherwise(F.concat("p_brand", F.lit(" "), size, F.lit(".5 mg tablet")))
            .alias("prod_ai"),
            F.col("p_type").alias("route"),
            F.when(F.col("p_size") > 45, "n/a").otherwise(size).alias("dose_amt"),
            F.lit("MG").alias("dose_unit"),
            *more,
        )

    @cached_property
    def reac(self) -> DataFrame:
        return self.numbered_reac.drop("l_linenumber")

    @cached_property
    def numbered_reac(self) -> DataFrame:
        return self._reac_of(self._lines, "l_linenumber")

    def _reac_of(self, lines: DataFrame, *more: str) -> DataFrame:
        band = F.floor(F.col("p_size") / 10).cast("string")
        return lines.select(
            F.col("l_orderkey").alias("primaryid"),
            F.when(F.col("p_size") < 50, F.concat("p_type", F.lit(" "), band)).alias("pt"),
            F.nullif("l_linestatus", F.lit("O")).alias("drug_rec_act"),
            *more,
        )

    @cached_property
    def outc(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("primaryid"),
            F.when(F.col("o_orderstatus") == "F", "DE")
            .when(F.col("o_orderstatus") == "P", "HO")
            .otherwise("OT")
            .alias("outc_cod"),
        )

    @cached_property
    def indi(self) -> DataFrame:
        return self._indi_of(self._lines)

    def _indi_of(self, lines: DataFrame, *more: str) -> DataFrame:
        return lines.select(
            F.col("l_orderkey").alias("primaryid"),
            F.when(F.col("l_linenumber") == 7, "x")
            .otherwise(F.col("l_linenumber").cast("string"))
            .alias("indi_drug_seq"),
            F.col("p_name").alias("indi_pt"),
            *more,
        )

    def with_quarter(self, child: str) -> DataFrame:
        """A child table as the raw files hold it, tagged with the quarter of its report."""
        if child == "outc":
            return self.outc.join(self.demo_core.select("primaryid", "faers_quarter").hint("merge"), "primaryid")
        views = {"drug": self._drug_of, "reac": self._reac_of, "indi": self._indi_of}
        return views[child](self._quartered_lines, "faers_quarter")

    @cached_property
    def dictionary(self) -> DataFrame:
        return inline_dictionary(self.spark, STAR_CLASS)

    @cached_property
    def live_background(self) -> Background:
        """The counts as a lazy plan over the tables."""
        return build_background(self.demo_core, self.drug, self.reac)

    @cached_property
    def live_cohort(self) -> Cohort:
        return build_cohort(
            self.demo, self.drug, self.reac, self.outc, self.indi, self.dictionary
        )

    @cached_property
    def background(self) -> Background:
        """The counts as readers find them: built and stored once for this folder and application."""
        path = self._stored("background", lambda path: write_background(
            self.demo_core, self.kept.drug, self.kept.reac, path, valid=self.kept_valid))
        return read_background(self.spark, path)

    @cached_property
    def cohort(self) -> Cohort:
        path = self._stored("cohort", self.write_cohort)
        return read_cohort(self.spark, path)

    def write_cohort(self, path: str) -> Cohort:
        """Build and store the cohort, which reads the lines four times."""
        lines = self.kept
        return write_cohort(self.demo, lines.drug, lines.reac, self.outc, lines.indi, self.dictionary, path)

    def _stored(self, kind: str, write: Callable[[str], object]) -> str:
        key = (self.spark.sparkContext.applicationId, self.folder, kind)
        if key not in STORED:
            path = new_folder(self.spark, kind)
            write(path)
            STORED[key] = path
        return STORED[key]

    @cached_property
    def known(self) -> DataFrame:
        """Known items: every brand with its smallest and middle band and a term never seen."""
        kinds = self.table("part").select(F.lower("p_brand").alias("drug"), "p_type").distinct()
        return kinds.select(
            F.concat_ws("/", "drug", "p_type").alias("id"),
            "drug",
            F.array(
                F.concat("p_type", F.lit(" 0")),
                F.concat("p_type", F.lit(" 2")),
                F.concat("p_type", F.lit(" never")),
            ).alias("event_pts"),
            F.concat(F.lit(" about "), "p_type", F.lit(" ")).alias("literature_source"),
            F.lit(2024).alias("year"),
            F.lit(None).cast("string").alias("notes"),
        )

    @cached_property
    def answers(self) -> DataFrame:
        """Assistant turns as answers; the turn number stands for the question."""
        text = F.col("text")
        tool = (
            F.when(F.col("conv_id") % 3 == 0, "detect_signals")
            .when(F.col("conv_id") % 3 == 1, "compare_drugs")
            .otherwise("semantic_event_search")
        )
        call = F.struct(
            F.col("turn").cast("int").alias("turn"),
            tool.alias("name"),
            F.lit("{}").alias("arguments"),
            F.lit("").alias("output_preview"),
        )
        return self.table("conversations").filter(F.col("role") == "assistant").select(
            "conv_id",
            "turn",
            F.concat(F.lit("turn "), F.col("turn")).alias("question"),
            F.array(call).alias("tool_calls"),
            text.alias("final_answer"),
            F.col("turn").cast("int").alias("n_turns"),
            F.lit("end_turn").alias("stop_reason"),
            F.when(F.length(text) < 200, "short").alias("error"),
        )

    @cached_property
    def rules(self) -> DataFrame:
        """One rule per question that occurs."""
        def words(*items: str):
            return F.array(*[F.lit(i) for i in items])

        turn = F.col("turn")
        asked = self.answers.select("turn", "question").distinct()
        return asked.select(
            F.concat(F.lit("r"), turn).alias("id"),
            F.when(turn == 7, "edge_case").otherwise("open_signal").alias("category"),
            "question",
            F.when(turn == 1, "detect_signals")
            .when(turn == 2, "get_open_signals")
            .when(turn == 3, "check_signal")
            .when(turn == 5, "compare_drugs")
            .otherwise("query_cohort_events")
            .alias("expected_tool"),
            F.when(turn == 4, F.lit(None).cast("array<string>"))
            .otherwise(words(*MUST_MENTION))
            .alias("must_mention_pts"),
            F.array().cast("array<string>").alias("expected_signals"),
            F.when(turn == 6, F.lit(None).cast("array<string>"))
            .otherwise(words(*FORBIDDEN))
            .alias("forbidden_claims"),
            F.lit(None).cast("string").alias("notes"),
        )


# Scoring words that occur in the given conversations.
MUST_MENTION = ["Nausea", "Tion", "Der", "thanst", "La"]
FORBIDDEN = ["The", "of the", "la", "und"]
SYNONYMS = {"nausea": ["nausea", "onwh", "eauou"], "tion": ["tionth", "tionan"]}
NEGATIONS = ["that", "que", "ing the", "die"]
LIMITATIONS = ["was", "pour", "nicht"]


# The same views in SQL.
def _variant_cases(name: str) -> str:
    cases = ""
    for active, brands, _ in STAR_CLASS:
        for variant in [active, *[b.lower() for b in brands]]:
            cases += f" WHEN contains({name}, '{variant}') THEN '{active}'"
    return f"CASE{cases} END"


def normalized(name: str) -> str:
    return (
        r"nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace("
        rf"lower({name}), '\([^)]*\)', '', 'g'),"
        r" '\d+(\.\d+)?\s*(mg|mcg|g|ml|units?|iu|%)\b', '', 'g'),"
        r" '\b(injection|inj|tablet|tab|capsule|cap|solution|sol|suspension|susp|"
        r"cream|ointment|patch|xr|er|sr|cr)\b', '', 'g'),"
        r" '\s+', ' ', 'g')), '')"
    )


def metrics_sql(cells: str) -> str:
    """Metric columns over a relation with a, b, c, d."""
    return f"""
    SELECT * EXCLUDE (_r1, _r2, _c1, _c2, _n, _ror, _se, _ic, _var, _prr, _chi),
      _prr AS prr, _chi AS prr_chi2, _ror AS ror,
      exp(ln(_ror) - 1.96 * _se) AS ror_ci_low, exp(ln(_ror) + 1.96 * _se) AS ror_ci_high,
      _ic AS ic,
      CASE WHEN _n = 0 THEN 0.0 ELSE _ic - 1.96 * sqrt(greatest(_var, 0.0)) END AS ic_ci_low,
      _prr >= 2 AND _chi >= 4 AND a >= 3 AS is_signal_ema,
      CASE WHEN _n = 0 THEN false ELSE _ic - 1.96 * sqrt(greatest(_var, 0.0)) > 0 END
        AS is_signal_bcpnn
    FROM (
      SELECT *,
        CASE WHEN _r1 = 0 OR _r2 = 0 OR c = 0 THEN 0.0
             ELSE (a / _r1) / (c / _r2) END AS _prr,
        CASE WHEN _r1 = 0 OR _r2 = 0 OR _c1 = 0 OR _c2 = 0 THEN 0.0
             ELSE _n * power(abs(a::DOUBLE * d - b::DOUBLE * c) - _n / 2, 2)
                  / (_r1 * _r2 * _c1 * _c2) END AS _chi,
        ((a + 0.5::DOUBLE) * (d + 0.5::DOUBLE)) / ((b + 0.5::DOUBLE) * (c + 0.5::DOUBLE)) AS _ror,
        sqrt(1 / (a + 0.5::DOUBLE) + 1 / (b + 0.5::DOUBLE) + 1 / (c + 0.5::DOUBLE)
             + 1 / (d + 0.5::DOUBLE)) AS _se,
        CASE WHEN _n = 0 THEN 0.0 ELSE log2((a + 0.5::DOUBLE)
             / ((_r1 / _n) * (_c1 / _n) * _n + 0.5::DOUBLE)) END AS _ic,
        power(1 / ln(2), 2) * ((_n - a + 0.5) / ((a + 0.5::DOUBLE) * (1 + _n))
             + (_n - _r1 + 0.5) / ((_r1 + 0.5) * (1 + _n))
             + (_n - _c1 + 0.5) / ((_c1 + 0.5) * (1 + _n))) AS _var
      FROM (
        SELECT *, (a + b)::DOUBLE AS _r1, (c + d)::DOUBLE AS _r2, (a + c)::DOUBLE AS _c1,
               (b + d)::DOUBLE AS _c2, (a + b + c + d)::DOUBLE AS _n
        FROM {cells}
      )
    )"""


MODEL_SQL = f"""
demo AS (
  SELECT o_orderkey AS primaryid, o_custkey AS caseid,
    CASE WHEN o_orderpriority NOT LIKE '4%'
         THEN date_diff('day', DATE '1990-01-01', o_orderdate::DATE) END AS caseversion,
    CASE o_orderstatus WHEN 'P' THEN strftime(o_orderdate, '%Y%m')
         WHEN 'O' THEN strftime(o_orderdate, '%Y%m') || '31'
         ELSE strftime(o_orderdate, '%Y%m%d') END AS event_dt,
    strftime(o_orderdate, '%Y%m%d') AS fda_dt,
    CASE WHEN c_acctbal < 0 THEN 'UNK' ELSE floor(c_acctbal / 100)::BIGINT::VARCHAR END AS age,
    CASE WHEN o_orderpriority LIKE '2%' THEN 'mon' WHEN o_orderpriority LIKE '3%' THEN NULL
         WHEN o_orderpriority LIKE '4%' THEN 'XX' ELSE 'YR' END AS age_cod,
    nullif(c_mktsegment, 'MACHINERY') AS sex, n_name AS reporter_country,
    lower(n_name) AS occr_country, left(o_orderpriority, 1) AS rept_cod,
    year(o_orderdate) || 'Q' || quarter(o_orderdate) AS faers_quarter
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
              LEFT JOIN nation ON c_nationkey = n_nationkey),
lines AS (SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey),
drug AS (
  SELECT l_orderkey AS primaryid, l_linenumber::VARCHAR AS drug_seq,
    CASE l_returnflag WHEN 'A' THEN 'PS' WHEN 'N' THEN 'SS' ELSE 'C' END AS role_cod,
    CASE WHEN l_linenumber = 3 THEN upper(p_name)
         ELSE upper(p_brand) || ' (' || upper(p_name) || ') ' || p_size || ' MG INJ' END
      AS drugname,
    CASE WHEN l_linestatus = 'O' THEN '' ELSE p_brand || ' ' || p_size || '.5 mg tablet' END
      AS prod_ai,
    p_type AS route, CASE WHEN p_size > 45 THEN 'n/a' ELSE p_size::VARCHAR END AS dose_amt,
    'MG' AS dose_unit
  FROM lines),
reac AS (
  SELECT l_orderkey AS primaryid,
    CASE WHEN p_size < 50 THEN p_type || ' ' || (p_size // 10) END AS pt,
    nullif(l_linestatus, 'O') AS drug_rec_act
  FROM lines),
outc AS (
  SELECT o_orderkey AS primaryid,
    CASE o_orderstatus WHEN 'F' THEN 'DE' WHEN 'P' THEN 'HO' ELSE 'OT' END AS outc_cod
  FROM orders),
indi AS (
  SELECT l_orderkey AS primaryid,
    CASE WHEN l_linenumber = 7 THEN 'x' ELSE l_linenumber::VARCHAR END AS indi_drug_seq,
    p_name AS indi_pt
  FROM lines),
latest AS (
  SELECT * EXCLUDE (_rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY faers_quarter, caseid
      ORDER BY caseversion DESC NULLS FIRST, primaryid DESC) AS _rn FROM demo) WHERE _rn = 1),
keyed AS (
  SELECT *, {normalized("coalesce(nullif(prod_ai, ''), drugname)")} AS drug_key FROM drug),
drug_pairs AS (
  SELECT DISTINCT primaryid, drug_key FROM keyed
  WHERE role_cod IN ('PS', 'SS') AND drug_key IS NOT NULL),
event_pairs AS (SELECT DISTINCT primaryid, pt AS event_pt FROM reac WHERE pt IS NOT NULL),
quarter_totals AS (
  SELECT faers_quarter, count(*) AS n_reports FROM latest GROUP BY ALL),
drug_totals AS (
  SELECT drug_key, faers_quarter, count(*) AS n_reports
  FROM drug_pairs JOIN latest USING (primaryid) GROUP BY ALL),
event_totals AS (
  SELECT event_pt, faers_quarter, count(*) AS n_reports
  FROM event_pairs JOIN latest USING (primaryid) GROUP BY ALL),
drug_event_counts AS (
  SELECT drug_key, event_pt, faers_quarter, count(*) AS n_reports
  FROM drug_pairs JOIN event_pairs USING (primaryid) JOIN latest USING (primaryid)
  GROUP BY ALL),
cells AS (
  SELECT p.drug_key, p.event_pt, p.n_both AS a, (d.n - p.n_both) AS b, (e.n - p.n_both) AS c,
         (t.n - d.n - e.n + p.n_both) AS d
  FROM (SELECT drug_key, event_pt, sum(n_reports)::BIGINT AS n_both FROM drug_event_counts
        GROUP BY ALL) p
  JOIN (SELECT drug_key, sum(n_reports)::BIGINT AS n FROM drug_totals GROUP BY ALL) d
    USING (drug_key)
  JOIN (SELECT event_pt, sum(n_reports)::BIGINT AS n FROM event_totals GROUP BY ALL) e
    USING (event_pt)
  CROSS JOIN (SELECT sum(n_reports)::BIGINT AS n FROM quarter_totals) t),
signals AS ({metrics_sql("cells")} WHERE a >= 3),
member AS (
  SELECT *, coalesce({_variant_cases(normalized("drugname"))},
                     {_variant_cases(normalized("prod_ai"))}) AS active_ingredient
  FROM drug),
ids AS (
  SELECT primaryid, faers_quarter FROM latest
  WHERE primaryid IN (SELECT primaryid FROM member WHERE active_ingredient IS NOT NULL)),
years AS (
  SELECT *, try_cast(age AS DOUBLE) * CASE upper(coalesce(nullif(age_cod, ''), 'YR'))
    WHEN 'DEC' THEN 10.0::DOUBLE WHEN 'MON' THEN 1::DOUBLE / 12 WHEN 'WK' THEN 1::DOUBLE / 52
    WHEN 'DY' THEN 1::DOUBLE / 365 WHEN 'HR' THEN 1::DOUBLE / 8760 ELSE 1.0::DOUBLE END AS age_years
  FROM demo),
reports AS (
  SELECT primaryid, caseid, caseversion,
    CASE WHEN length(event_dt) = 8 THEN try_strptime(event_dt, '%Y%m%d')::DATE END AS event_dt,
    CASE WHEN length(fda_dt) = 8 THEN try_strptime(fda_dt, '%Y%m%d')::DATE END AS fda_dt,
    age_years AS age, age_cod AS age_unit, sex, reporter_country, occr_country AS occur_country,
    rept_cod AS reporter_type, false AS serious, faers_quarter
  FROM years WHERE primaryid IN (SELECT primaryid FROM ids)),
drugs AS (
  SELECT primaryid, try_cast(drug_seq AS INTEGER) AS drug_seq, role_cod, drugname, prod_ai, route,
    try_cast(dose_amt AS DOUBLE) AS dose_amt, dose_unit, active_ingredient IS NOT NULL AS is_glp1,
    active_ingredient
  FROM member WHERE primaryid IN (SELECT primaryid FROM ids)),
reactions AS (
  SELECT * FROM reac WHERE pt IS NOT NULL AND primaryid IN (SELECT primaryid FROM ids)),
outcomes AS (SELECT * FROM outc WHERE primaryid IN (SELECT primaryid FROM ids)),
indications AS (
  SELECT primaryid, try_cast(indi_drug_seq AS INTEGER) AS indi_drug_seq, indi_pt FROM indi
  WHERE primaryid IN (SELECT primaryid FROM ids)),
known AS (
  SELECT drug || '/' || p_type AS id, drug,
    [p_type || ' 0', p_type || ' 2', p_type || ' never'] AS event_pts,
    'about ' || p_type AS source
  FROM (SELECT DISTINCT lower(p_brand) AS drug, p_type FROM part)),
known_best AS (
  SELECT * EXCLUDE (_rn) FROM (
    SELECT k.id, k.drug, k.source, s.event_pt, s.a, s.prr, s.ror, s.ic, s.is_signal_ema,
      s.is_signal_bcpnn, count(s.a) OVER (PARTITION BY k.id) AS n_matches,
      row_number() OVER (PARTITION BY k.id ORDER BY s.ic DESC NULLS LAST, s.event_pt) AS _rn
    FROM (SELECT id, drug, source, unnest(event_pts) AS pt FROM known) k
    LEFT JOIN signals s ON s.drug_key = k.drug AND s.event_pt = k.pt) WHERE _rn = 1)
"""


def sql_list(items: list[str]) -> str:
    return "[" + ", ".join(f"'{i}'" for i in items) + "]"


def _synonym_cases() -> str:
    cases = "".join(f" WHEN '{k}' THEN {sql_list(v)}" for k, v in SYNONYMS.items())
    return f"CASE lower(pt){cases} ELSE [lower(pt)] END"


_WORD = r"[\p{L}\p{M}\p{N}_]"
_BEFORE = "list_reduce(parts[1:i], lambda x, y: x || lower(claim) || y)"
_AFTER = "list_reduce(parts[i + 1:], lambda x, y: x || lower(claim) || y)"
_CONTEXT = f"right({_BEFORE}, 30) || lower(claim) || left({_AFTER}, 30)"

ANSWER_SQL = f"""
answers AS (
  SELECT conv_id, turn, lower(text) AS answer, text,
    CASE conv_id % 3 WHEN 0 THEN 'detect_signals' WHEN 1 THEN 'compare_drugs'
         ELSE 'semantic_event_search' END AS tool,
    CASE turn WHEN 4 THEN [] ELSE {sql_list(MUST_MENTION)} END AS must,
    CASE turn WHEN 6 THEN [] ELSE {sql_list(FORBIDDEN)} END AS forbidden,
    turn = 7 AS edge,
    CASE WHEN turn = 1 THEN ['detect_signals']
         WHEN turn = 2 THEN []
         WHEN turn = 3 THEN ['semantic_event_search', 'detect_signals', 'query_cohort_events',
                             'compare_drugs']
         WHEN turn = 5 THEN ['compare_drugs']
         ELSE ['query_cohort_events', 'check_subgroup'] END AS accepted,
    CASE WHEN length(text) < 200 THEN 'short' END AS error
  FROM conversations WHERE role = 'assistant'),
term_hits AS (
  SELECT conv_id, turn, ord, pt,
    list_bool_or(list_transform({_synonym_cases()}, lambda s: contains(answer, s))) AS hit
  FROM (SELECT conv_id, turn, answer, unnest(must) AS pt,
               generate_subscripts(must, 1) AS ord FROM answers)),
claim_hits AS (
  SELECT conv_id, turn, ord, claim,
    len(list_filter(range(1, len(parts)), lambda i:
      NOT regexp_matches(right({_BEFORE}, 1), '{_WORD}')
      AND NOT regexp_matches(left({_AFTER}, 1), '{_WORD}')
      AND NOT list_bool_or(list_transform({sql_list(NEGATIONS)},
                                          lambda g: contains({_CONTEXT}, g))))) > 0 AS hit
  FROM (SELECT conv_id, turn, unnest(forbidden) AS claim,
               generate_subscripts(forbidden, 1) AS ord,
               string_split(answer, lower(unnest(forbidden))) AS parts FROM answers)),
scores AS (
  SELECT a.conv_id, a.turn, 'r' || a.turn AS id, a.text, a.answer, a.edge, a.error, a.tool,
    a.edge OR len(a.accepted) = 0 OR list_contains(a.accepted, a.tool) AS tool_ok,
    coalesce(t.mentioned, '') AS mentioned, coalesce(t.missing, '') AS missing,
    CASE WHEN len(a.must) = 0 THEN 1.0::DOUBLE ELSE t.n_hits::DOUBLE / len(a.must) END
      AS pt_coverage,
    coalesce(c.violations, '') AS violations,
    a.edge OR regexp_matches(a.answer, 'n\\s*=\\s*\\d+') AS has_n_citation,
    a.edge OR list_bool_or(list_transform({sql_list(LIMITATIONS)},
                                          lambda s: contains(a.answer, s))) AS has_limitation
  FROM answers a
  LEFT JOIN (SELECT conv_id, turn, count(*) FILTER (hit) AS n_hits,
               array_to_string(list(pt ORDER BY ord) FILTER (hit), ',') AS mentioned,
               array_to_string(list(pt ORDER BY ord) FILTER (NOT hit), ',') AS missing
             FROM term_hits GROUP BY ALL) t USING (conv_id, turn)
  LEFT JOIN (SELECT conv_id, turn,
               array_to_string(list(claim ORDER BY ord) FILTER (hit), ',') AS violations
             FROM claim_hits GROUP BY ALL) c USING (conv_id, turn))
"""
