"""Registered queries: reading, writing and table maintenance."""

from pyspark.sql import functions as F

from oddspark import schemas
from oddspark.checks.registry import joined, query
from oddspark.checks.star import STAR_CLASS
from oddspark.operators.dedupe import report_drugs, valid_reports
from oddspark.operators.upsert import insert_ignore, upsert_by_key
from oddspark.plans.background import drug_totals, quarter_totals
from oddspark.plans.signals import precomputed_or_live, scan_signals
from oddspark.sources import delimited, fixtures, tables
from oddspark.sources.versions import Store
from oddspark.workspace import materialize, new_folder

DEMO_TEXT = [
    "primaryid", "caseid", "caseversion", "event_dt", "fda_dt", "age", "age_cod", "sex",
    "reporter_country",
]


def _write_text(star, df, name):
    path = new_folder(star.spark, name)
    df.write.option("sep", "$").option("header", True).csv(path)
    return path


@query("scan_delimited", """
SELECT primaryid::VARCHAR AS primaryid, caseid::VARCHAR AS caseid,
  caseversion::VARCHAR AS caseversion, event_dt, fda_dt, age, age_cod, sex, reporter_country
FROM demo""")
def _(star):
    path = _write_text(star, star.demo.select(*DEMO_TEXT), "demo-text")
    return delimited.scan_delimited(star.spark, path).select(*DEMO_TEXT)


@query("discover_table_files", """
SELECT DISTINCT 'part' AS table_name, 'faers_quarter=' || faers_quarter AS faers_quarter
FROM demo""")
def _(star):
    path = new_folder(star.spark, "quarters-text")
    star.demo_core.write.partitionBy("faers_quarter").option("sep", "$").csv(path)
    files = delimited.discover_table_files(star.spark, path, ["part", "none"], ".csv")
    return files.select("table_name", "faers_quarter")


@query("normalize_columns", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders""")
def _(star):
    orders = star.table("orders").drop("o_orderdate")
    return delimited.normalize_columns(orders.toDF(*[c.upper() for c in orders.columns]))


@query("tag_source_quarter", """
SELECT o_orderkey AS primaryid, '2024Q1' AS faers_quarter FROM orders""")
def _(star):
    ids = star.table("orders").select(F.col("o_orderkey").alias("primaryid"))
    return delimited.tag_source_quarter(ids, "2024Q1")


@query("write_parquet", """
SELECT faers_quarter, count(*) AS n_rows, sum(primaryid)::BIGINT AS sum_ids,
  count(age_cod) AS n_units FROM demo GROUP BY ALL""")
def _(star):
    path = new_folder(star.spark, "demo")
    tables.write_parquet(star.demo, path)
    return star.spark.read.parquet(path).groupBy("faers_quarter").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("primaryid").alias("sum_ids"),
        F.count("age_cod").alias("n_units"),
    )


def _write_detail(star):
    root = new_folder(star.spark, "detail")
    tables.write_parquet(star.demo, f"{root}/demo")
    for name in ("drug", "reac", "outc", "indi"):
        tables.write_parquet(star.with_quarter(name), f"{root}/{name}")
    return root


@query("scan_parquet", """
SELECT t.table_name, faers_quarter, count(*) AS n_rows FROM (
  SELECT 'demo' AS table_name, primaryid FROM demo UNION ALL
  SELECT 'drug', primaryid FROM drug UNION ALL SELECT 'reac', primaryid FROM reac UNION ALL
  SELECT 'outc', primaryid FROM outc UNION ALL SELECT 'indi', primaryid FROM indi) t
JOIN demo USING (primaryid) GROUP BY ALL""")
def _(star):
    read = tables.scan_parquet(star.spark, _write_detail(star))
    return delimited.profile_source(read).select("table_name", "faers_quarter", "n_rows")


@query("profile_source", """
SELECT table_name, faers_quarter, count(*) AS n_rows, any_value(n) AS n_columns,
  any_value(first) AS first_columns
FROM (
  SELECT 'demo' AS table_name, primaryid, 11 AS n, 'primaryid,caseid,caseversion,event_dt,fda_dt,'
    || 'age,age_cod,sex,reporter_country,occr_country' AS first FROM demo UNION ALL
  SELECT 'outc', primaryid, 2, 'primaryid,outc_cod' FROM outc UNION ALL
  SELECT 'indi', primaryid, 3, 'primaryid,indi_drug_seq,indi_pt' FROM indi) t
JOIN demo USING (primaryid) GROUP BY ALL""")
def _(star):
    profile = delimited.profile_source({
        "demo": star.demo,
        "outc": star.with_quarter("outc"),
        "indi": star.with_quarter("indi"),
    })
    return profile.withColumn("first_columns", joined("first_columns"))


def _quarter_files(star, df, name):
    """Text files below a folder for each quarter, as they are delivered."""
    root = new_folder(star.spark, name)
    df.write.partitionBy("faers_quarter").option("sep", "$").option("header", True).csv(root)
    return root


@query("ingest", """
SELECT primaryid, caseid, caseversion::VARCHAR AS caseversion, sex, age, 'faers_quarter=' || faers_quarter AS faers_quarter FROM demo""")
def _(star):
    """Text files of all quarters, stored as one version and read back."""
    root, path = _quarter_files(star, star.demo, "demo-text"), new_folder(star.spark, "ingested")
    report = delimited.ingest(star.spark, root, path, ["part", "absent"], ".csv").collect()
    if {r["table_name"]: r["status"] for r in report} != {"part": "OK", "absent": "MISSING"}:
        raise ValueError(f"not all rows came in: {report}")
    columns = ["primaryid", "caseid", "caseversion", "sex", "age", "faers_quarter"]
    stored = Store(star.spark, path).read("part").withColumn("caseversion", F.col("caseversion").cast("string"))
    return stored.select(*columns)


@query("profile_files", """
SELECT 'part' AS table_name, 'faers_quarter=' || faers_quarter AS faers_quarter, count(*) AS n_rows, 11 AS n_columns,
  0::BIGINT AS n_short, 0::BIGINT AS n_surplus, 'OK' AS status FROM demo GROUP BY ALL""")
def _(star):
    files = delimited.profile_files(star.spark, _quarter_files(star, star.demo, "demo-text"), ["part"], ".csv")
    per_quarter = files.groupBy("table_name", "faers_quarter", "n_columns", "status")
    return per_quarter.agg(*[F.sum(c).alias(c) for c in ("n_rows", "n_short", "n_surplus")])


@query("publish_all", """
SELECT 'glp1_drugs' AS table_name, 3 AS n_source, 3 AS n_target, 'OK' AS status UNION ALL
SELECT 'reports', count(*), count(*), 'OK' FROM reports UNION ALL
SELECT 'drugs', count(*), count(*), 'OK' FROM drugs UNION ALL
SELECT 'reactions', count(*), count(*), 'OK' FROM reactions UNION ALL
SELECT 'outcomes', count(*), count(*), 'OK' FROM outcomes UNION ALL
SELECT 'indications', count(*), count(*), 'OK' FROM indications UNION ALL
SELECT 'glp1_signals', count(*), count(*), 'OK' FROM signals UNION ALL
SELECT 'pt_embeddings', count(*), count(*), 'OK' FROM embeddings""")
def _(star):
    """All eight tables; each source is computed once."""
    cohort = star.cohort
    return tables.publish_reconciled(
        {
            "glp1_drugs": star.dictionary,
            "reports": cohort.reports,
            "drugs": cohort.drugs,
            "reactions": cohort.reactions,
            "outcomes": cohort.outcomes,
            "indications": cohort.indications,
            "glp1_signals": scan_signals(star.background),
            "pt_embeddings": star.table("embeddings").select(F.col("vec_id").alias("pt"), "embedding"),
        },
        new_folder(star.spark, "published"),
    )


@query("append_table", """
SELECT prod_ai, role_cod, count(*) AS n_rows FROM (
  SELECT nullif(prod_ai, '') AS prod_ai, role_cod FROM drug UNION ALL
  SELECT drugname, role_cod FROM drug) GROUP BY ALL""")
def _(star):
    path = new_folder(star.spark, "drugs")
    tables.append_table(star.drug, path, ["role_cod", "prod_ai"])
    renamed = star.drug.select("role_cod", F.col("drugname").alias("prod_ai"))
    tables.append_table(renamed, path, ["role_cod", "prod_ai"])
    stored = star.spark.read.parquet(path)
    return stored.groupBy("prod_ai", "role_cod").agg(F.count(F.lit(1)).alias("n_rows"))


@query("overwrite_table", "SELECT * FROM drug_totals")
def _(star):
    path = new_folder(star.spark, "drug-totals")
    tables.overwrite_table(star.background.event_totals, path)
    tables.overwrite_table(star.background.drug_totals, path)
    return star.spark.read.parquet(path)


@query("insert_ignore", """
SELECT drug_key, event_pt, a, a >= 20 AS first FROM signals""")
def _(star):
    signals = materialize(
        scan_signals(star.background).select("drug_key", "event_pt", "a"), "signals"
    )
    first = signals.filter("a >= 20").withColumn("first", F.lit(True))
    again = signals.withColumn("first", F.lit(False))
    return insert_ignore(first, again.unionByName(again), ["drug_key", "event_pt"])


@query("insert_ignore_table", "SELECT drug_key, event_pt, a, a >= 20 AS first FROM signals")
def _(star):
    path = new_folder(star.spark, "stored-signals")
    signals = materialize(
        scan_signals(star.background).select("drug_key", "event_pt", "a"), "signals"
    )
    first = signals.filter("a >= 20").withColumn("first", F.lit(True))
    key = ["drug_key", "event_pt"]
    tables.insert_ignore_table(first, path, key)
    for _ in range(2):
        tables.insert_ignore_table(signals.withColumn("first", F.lit(False)), path, key)
    return star.spark.read.parquet(path)


@query("upsert_by_key", """
SELECT vec_id AS pt, CASE WHEN label >= 5 THEN label + 100 ELSE label END AS label
FROM embeddings
UNION ALL SELECT vec_id + 1000000000, label + 100 FROM embeddings WHERE label >= 5""")
def _(star):
    existing = star.table("embeddings").select(F.col("vec_id").alias("pt"), "label")
    changed = existing.filter("label >= 5").withColumn("label", F.col("label") + 100)
    added = changed.withColumn("pt", F.col("pt") + 1000000000)
    return upsert_by_key(existing, changed.unionByName(added), ["pt"])


@query("versioned_tables", """
SELECT nullif(vec_id, 7)::VARCHAR AS pt, CASE WHEN label >= 5 THEN label + 100 ELSE label END AS label, 'first' AS load
FROM embeddings WHERE label >= 2
UNION ALL SELECT nullif(vec_id, 7)::VARCHAR, label, 'second' FROM embeddings WHERE label < 2""")
def _(star):
    """Loads and changes of a versioned table, each run twice, after a writer that was lost before it switched."""
    store = Store(star.spark, new_folder(star.spark, "versioned"))
    terms = star.table("embeddings").select(F.nullif("vec_id", F.lit(7)).cast("string").alias("pt"), "label")
    key = ["pt"]
    steps = [
        (store.append, terms.filter("label >= 2"), "first", ["one"]),
        (store.insert_ignore, terms, "second", [key]),
        (store.upsert, terms.filter("label >= 5").withColumn("label", F.col("label") + 100), "first", [key]),
    ]
    for write, rows, load, rest in steps:
        store.change().add("terms", rows.withColumn("load", F.lit("lost")))
        for _ in range(2):
            write("terms", rows.withColumn("load", F.lit(load)), *rest)
    return store.read("terms")


@query("publish_reconciled", """
SELECT 'reports' AS table_name, count(*) AS n_source, count(*) AS n_target, 'OK' AS status
FROM reports UNION ALL
SELECT 'drugs', count(*), count(*), 'OK' FROM drugs UNION ALL
SELECT 'reactions', count(*), count(*), 'OK' FROM reactions UNION ALL
SELECT 'outcomes', 0, 0, 'SKIPPED' UNION ALL
SELECT 'glp1_signals', count(*), count(*), 'OK' FROM signals""")
def _(star):
    cohort = star.write_cohort(new_folder(star.spark, "cohort"))
    return tables.publish_reconciled(
        {
            "reports": cohort.reports,
            "drugs": cohort.drugs,
            "reactions": cohort.reactions,
            "outcomes": cohort.outcomes.filter("outc_cod = 'none'"),
            "glp1_signals": materialize(scan_signals(star.background), "signals"),
        },
        new_folder(star.spark, "published"),
    )


_BRANDS_SQL = " UNION ALL ".join(
    f"SELECT '{active}' AS active_ingredient, '{brand}' AS brand"
    for active, brands, _ in STAR_CLASS
    for brand in brands
)


@query("inline_dictionary", f"""
SELECT active_ingredient, brand, count(p_partkey) AS n_parts
FROM ({_BRANDS_SQL}) b LEFT JOIN part ON lower(p_brand) = lower(brand) GROUP BY ALL""")
def _(star):
    brands = star.dictionary.select("active_ingredient", F.explode("brand_names").alias("brand"))
    parts = star.table("part").groupBy(F.lower("p_brand").alias("_key")).agg(
        F.count(F.lit(1)).alias("n_parts")
    )
    counted = brands.join(parts, F.lower("brand") == F.col("_key"), "left").drop("_key")
    return counted.fillna(0, ["n_parts"])


@query("list_dictionary", """
SELECT DISTINCT lower(p_brand) AS active_ingredient FROM part ORDER BY 1""")
def _(star):
    members = star.table("part").select(F.lower("p_brand").alias("active_ingredient")).distinct()
    return fixtures.list_dictionary(members)


@query("rows_to_json", """
SELECT to_json({'primaryid': primaryid, 'sex': sex, 'fda_dt':
  strftime(strptime(fda_dt, '%Y%m%d'), '%Y-%m-%d'), 'faers_quarter': faers_quarter}) AS json
FROM demo""")
def _(star):
    rows = star.demo.select(
        "primaryid", "sex", F.to_date("fda_dt", "yyyyMMdd").alias("fda_dt"), "faers_quarter"
    )
    return tables.rows_to_json(rows)


@query("json_report_sink", "SELECT faers_quarter, n_reports FROM quarter_totals")
def _(star):
    path = new_folder(star.spark, "report-json")
    totals = quarter_totals(valid_reports(star.demo_core))
    tables.json_report_sink(totals, path)
    return star.spark.read.schema("faers_quarter string, n_reports long").json(path)


@query("load_fixture", """
SELECT id, drug, array_to_string(event_pts, ',') AS events, 2024 AS year FROM known""")
def _(star):
    path = new_folder(star.spark, "known-json")
    tables.json_report_sink(star.known, path)
    loaded = fixtures.load_fixture(star.spark, path, schemas.KNOWN_SIGNALS)
    return loaded.select("id", "drug", joined("event_pts").alias("events"), "year")


@query("precomputed_or_live", """
SELECT drug_key, event_pt, a, round(prr, 6) AS prr, round(ic, 6) AS ic FROM signals
WHERE a >= 10 AND drug_key LIKE 'brand#%'""")
def _(star):
    live = scan_signals(star.background)
    stored = materialize(live.filter("drug_key < 'brand#2'"), "stored-signals")
    brands = [f"brand#{n}" for n in range(1, 26)]
    found = precomputed_or_live(stored, star.background, brands, min_cases=10)
    return found.select("drug_key", "event_pt", "a", "prr", "ic")


@query("union_quarters", "SELECT primaryid, faers_quarter FROM demo")
def _(star):
    demo = star.demo_core.select("primaryid", "faers_quarter")
    seasons = [demo.filter(F.col("faers_quarter").endswith(f"Q{n}")) for n in range(1, 5)]
    return delimited.union_quarters(seasons)


@query("drug_totals", "SELECT * FROM drug_totals")
def _(star):
    pairs = report_drugs(star.drug).join(valid_reports(star.demo_core), "primaryid")
    return drug_totals(pairs)
