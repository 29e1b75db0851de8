"""Registered queries: vectors, known-signal validation and answer scoring."""

from pyspark.sql import functions as F

from oddspark.checks import star as S
from oddspark.checks.registry import joined, query
from oddspark.functions import text as X
from oddspark.functions.vectors import cosine_similarity
from oddspark.operators.ranking import top_n_per
from oddspark.plans import answers as H14
from oddspark.plans import search as H11
from oddspark.plans import validation as H13
from oddspark.plans.signals import scan_signals
from oddspark.sources.tables import overwrite_table
from oddspark.sources.versions import Store
from oddspark.workspace import new_folder


def _terms(star):
    return star.table("embeddings").select(F.col("vec_id").alias("pt"), "embedding", "label")


def _centroids(star):
    """The mean vector of each label, as query vectors."""
    parts = _terms(star).select("label", F.posexplode("embedding").alias("pos", "x"))
    means = parts.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    in_order = F.array_sort(F.collect_list(F.struct("pos", "mean")))
    return means.groupBy(F.col("label").cast("string").alias("query")).agg(
        F.transform(in_order, lambda p: p["mean"]).alias("vector")
    )


_CENTROIDS = """centroids AS (
  SELECT label, list(mean ORDER BY pos) AS vector FROM (
    SELECT label, pos, avg(x) AS mean FROM (
      SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS x
      FROM embeddings) GROUP BY ALL) GROUP BY label),
hits AS (
  SELECT c.label::VARCHAR AS query, vec_id AS pt,
    list_cosine_similarity(embedding::DOUBLE[], c.vector) AS similarity
  FROM embeddings, centroids c),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, pt) AS rank FROM hits)
"""


@query("cosine_similarity", f"""
SELECT * FROM (WITH {_CENTROIDS} SELECT e.vec_id AS pt, round(h.similarity, 6) AS similarity
FROM embeddings e JOIN hits h ON h.pt = e.vec_id AND h.query = e.label::VARCHAR)""")
def _(star):
    own = _centroids(star).withColumnRenamed("query", "label")
    rows = _terms(star).withColumn("label", F.col("label").cast("string")).join(own, "label")
    return rows.select(
        "pt", cosine_similarity(F.col("embedding"), F.col("vector")).alias("similarity")
    )


@query("knn_top_k", f"""
SELECT * FROM (WITH {_CENTROIDS} SELECT query, pt, round(similarity, 6) AS similarity, rank
FROM ranked WHERE rank <= 25)""")
def _(star):
    found = H11.semantic_event_search(_terms(star), _centroids(star), 25, -1.0)
    return found.withColumn("rank", F.col("rank").cast("long"))


@query("knn_top_k_blocks", f"""
SELECT * FROM (WITH {_CENTROIDS} SELECT query, pt, round(similarity, 6) AS similarity, rank
FROM ranked WHERE rank <= 25)""")
def _(star):
    hits = H11.similarities(_terms(star), _centroids(star), packed=3)
    return top_n_per(hits, "query", "similarity", 25, "pt").withColumn(
        "rank", F.col("rank").cast("long")
    )


@query("search_in_cells", f"""
SELECT * FROM (WITH {_CENTROIDS} SELECT query, pt, round(similarity, 6) AS similarity, rank
FROM ranked WHERE rank <= 15 AND similarity >= 0.35)""")
def _(star):
    """The same search over terms stored by cell."""
    store = Store(star.spark, new_folder(star.spark, "cells"))
    cells = H11.write_search_cells(_terms(star), store, width=64)
    found, _ = H11.search_in_cells(cells, _centroids(star))
    return found.drop("query_id").withColumn("rank", F.col("rank").cast("long"))


@query("semantic_event_search", f"""
SELECT * FROM (WITH {_CENTROIDS} SELECT query, pt, round(similarity, 6) AS similarity, rank
FROM ranked WHERE rank <= 15 AND similarity >= 0.35)""")
def _(star):
    found = H11.semantic_event_search(_terms(star), _centroids(star))
    return found.withColumn("rank", F.col("rank").cast("long"))


def _embedded_types(star):
    """Vectors of the terms of one part type, as if the others were new."""
    terms = star.reac.filter("pt like 'PROMO%'").select("pt").distinct()
    return H11.embed_terms(terms)


@query("embed_missing", """
SELECT DISTINCT pt, 1024::BIGINT AS width, 1.0::DOUBLE AS length FROM reac
WHERE pt IS NOT NULL AND pt NOT LIKE 'PROMO%'""")
def _(star):
    new = H11.embed_missing(star.reac, _embedded_types(star))
    squares = F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x * x)
    return new.select(
        "pt",
        F.size("embedding").cast("long").alias("width"),
        F.round(F.sqrt(squares), 3).alias("length"),
    )


@query("refresh_embeddings", """
SELECT DISTINCT pt, 1024::BIGINT AS width FROM reac WHERE pt IS NOT NULL""")
def _(star):
    stored, merged = new_folder(star.spark, "terms"), new_folder(star.spark, "terms")
    overwrite_table(_embedded_types(star), stored)
    H11.refresh_embeddings(star.reac, stored, merged)
    return star.spark.read.parquet(merged).select(
        "pt", F.size("embedding").cast("long").alias("width")
    )


@query("encoder", """
SELECT DISTINCT pt, 1.0::DOUBLE AS similarity FROM reac WHERE pt IS NOT NULL""")
def _(star):
    terms = star.reac.filter("pt is not null").select("pt").distinct()
    documents = H11.embed_terms(terms)
    queries = H11.embed_terms(terms, kind="query", batch=7).withColumnRenamed(
        "embedding", "vector"
    )
    same = documents.join(queries, "pt")
    return same.select(
        "pt", F.round(cosine_similarity(F.col("embedding"), F.col("vector")), 3).alias("similarity")
    )


@query("term_search_by_text")
def _(star):
    terms = star.reac.filter("pt is not null").select("pt").distinct()
    queries = H11.query_vectors(star.spark, ["standard product", "small item", "promo"])
    return H11.semantic_event_search(H11.embed_terms(terms), queries, 10, 0.1)


@query("fixture_left_join", """
SELECT k.id, k.drug, k.pt AS event_pt, coalesce(s.a, 0) AS a, round(s.ic, 6) AS ic
FROM (SELECT id, drug, unnest(event_pts) AS pt FROM known) k
LEFT JOIN signals s ON s.drug_key = k.drug AND s.event_pt = k.pt""")
def _(star):
    pairs = H13.fixture_left_join(star.known, scan_signals(star.background))
    return pairs.fillna(0, ["a"]).select("id", "drug", "event_pt", "a", "ic")


@query("best_match_per_item", """
SELECT id, event_pt, n_matches, round(ic, 6) AS ic FROM known_best""")
def _(star):
    best = H13.best_match_per_item(star.known, scan_signals(star.background))
    first = F.try_element_at("matches", F.lit(1))
    return best.select(
        "id",
        first["event_pt"].alias("event_pt"),
        F.size("matches").cast("long").alias("n_matches"),
        first["ic"].alias("ic"),
    )


@query("validate_known_signals", """
SELECT id, drug, source, n_matches > 0 AS found, event_pt AS best_match_pt, coalesce(a, 0) AS a,
  round(prr, 6) AS prr, round(ror, 6) AS ror, round(ic, 6) AS ic,
  coalesce(is_signal_ema, false) AS is_signal_ema,
  coalesce(is_signal_bcpnn, false) AS is_signal_bcpnn
FROM known_best""")
def _(star):
    results = H13.validate_known_signals(star.known, scan_signals(star.background))
    return results.fillna(0, ["a"]).select(
        "id", "drug", "source", "found", "best_match_pt", "a", "prr", "ror", "ic",
        "is_signal_ema", "is_signal_bcpnn",
    )


@query("status_label", """
SELECT id, CASE WHEN is_signal_ema OR is_signal_bcpnn THEN 'DETECTED'
  WHEN n_matches > 0 THEN 'PRESENT-NOT-SIGNAL' ELSE 'MISSING' END AS status FROM known_best""")
def _(star):
    results = H13.validate_known_signals(star.known, scan_signals(star.background))
    return results.select("id", "status")


_RATE = "round(count(*) FILTER ({})::DOUBLE / count(*), 6)"


@query("detection_summary", f"""
SELECT count(*) AS total_known_signals, count(*) FILTER (n_matches > 0) AS found_in_data,
  {_RATE.format("n_matches > 0")} AS found_rate,
  count(*) FILTER (is_signal_ema) AS detected_by_ema,
  count(*) FILTER (is_signal_bcpnn) AS detected_by_bcpnn,
  count(*) FILTER (is_signal_ema OR is_signal_bcpnn) AS detected_by_either,
  {_RATE.format("is_signal_ema OR is_signal_bcpnn")} AS detection_rate_either,
  {_RATE.format("is_signal_ema")} AS detection_rate_ema,
  {_RATE.format("is_signal_bcpnn")} AS detection_rate_bcpnn
FROM known_best""")
def _(star):
    results = H13.validate_known_signals(star.known, scan_signals(star.background))
    return H13.detection_summary(results)


def _scores(star):
    return H14.score_answers(
        star.answers,
        star.rules,
        synonyms=S.SYNONYMS,
        negations=S.NEGATIONS,
        limitations=S.LIMITATIONS,
        keep=("conv_id", "turn"),
    )


@query("tool_set_overlap", "SELECT conv_id, turn, tool, tool_ok FROM scores", answers=True)
def _(star):
    return _scores(star).select("conv_id", "turn", joined("called_tools").alias("tool"), "tool_ok")


@query("synonym_match", "SELECT conv_id, turn, mentioned FROM scores", answers=True)
def _(star):
    return _scores(star).select("conv_id", "turn", joined("mentioned_pts").alias("mentioned"))


@query("array_difference", "SELECT conv_id, turn, missing FROM scores", answers=True)
def _(star):
    return _scores(star).select("conv_id", "turn", joined("missing_pts").alias("missing"))


@query("ratio_default", """
SELECT conv_id, turn, round(pt_coverage, 6) AS pt_coverage FROM scores""", answers=True)
def _(star):
    return _scores(star).select("conv_id", "turn", "pt_coverage")


@query("forbidden_with_negation", """
SELECT conv_id, turn, violations, violations = '' AS no_forbidden FROM scores""", answers=True)
def _(star):
    violations = joined("forbidden_violations").alias("violations")
    return _scores(star).select("conv_id", "turn", violations, "no_forbidden")


@query("regex_citation", r"""
SELECT doc_id, regexp_matches(lower(text), 'n\s*=\s*\d+') AS cited FROM documents""")
def _(star):
    cited = X.regex_citation(F.lower("text")).alias("cited")
    return star.table("documents").select("doc_id", cited)


@query("any_term", """
SELECT doc_id, contains(lower(text), 'was') OR contains(lower(text), 'pour')
  OR contains(lower(text), 'nicht') AS limited FROM documents""")
def _(star):
    limited = X.any_term(F.lower("text"), S.LIMITATIONS).alias("limited")
    return star.table("documents").select("doc_id", limited)


@query("score_answers", """
SELECT conv_id, turn, id, CASE WHEN edge THEN 'edge_case' ELSE 'open_signal' END AS category,
  tool_ok, round(pt_coverage, 6) AS pt_coverage, mentioned, violations, has_n_citation,
  has_limitation, turn AS n_turns, error FROM scores""", answers=True)
def _(star):
    return _scores(star).select(
        "conv_id", "turn", "id", "category", "tool_ok", "pt_coverage",
        joined("mentioned_pts").alias("mentioned"),
        joined("forbidden_violations").alias("violations"),
        "has_n_citation", "has_limitation", F.col("n_turns").cast("long").alias("n_turns"), "error",
    )


_SUMMARY = """
SELECT count(*) AS total_questions, round(avg(tool_ok::INT), 6) AS tool_accuracy,
  round(avg(pt_coverage), 6) AS avg_pt_coverage,
  round(avg((violations = '')::INT), 6) AS no_forbidden_rate,
  round(avg(has_n_citation::INT), 6) AS n_citation_rate,
  round(avg(has_limitation::INT), 6) AS limitation_rate, round(avg(turn), 6) AS avg_turns,
  count(error) AS n_errors FROM scores"""


@query("answer_summary", _SUMMARY, answers=True)
@query("summarize_answers", _SUMMARY, answers=True)
def _(star):
    return H14.summarize_answers(_scores(star))


@query("failed_answers", """
SELECT id, error FROM scores WHERE error IS NOT NULL""", answers=True)
def _(star):
    return H14.failed_answers(_scores(star))
