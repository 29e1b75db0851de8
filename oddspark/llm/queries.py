"""The registered queries of this folder, and their SQL where SQL can say them."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddspark.llm import (
    clustering, covertree, lines, minhash, mixing, packing, periodic, quality, secrets, suffixes, toxicity, urls, warc,
)
from oddspark.llm.shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_rules(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


QUERIES["op7_quality_rules"] = op7_quality_rules
_FENCES = ", ".join(
    f"max(CASE WHEN metric = '{name}' THEN greatest(q3 + 3 * (q3 - q1), {floor}) END) AS max_{name}"
    for name, floor in quality.FLOORS.items())
_LIMITS = ", ".join(
    f"CASE WHEN o.docs >= {quality.LEAST_GROUP} THEN o.max_{n} "
    f"WHEN b.docs >= {quality.LEAST_GROUP} THEN b.max_{n} ELSE a.max_{n} END AS max_{n}"
    for n in quality.FLOORS)
ORACLES["op7_quality_rules"] = rf"""
WITH cut AS (
  SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
win AS (
  SELECT k, p, array_to_string(w[p:p + 4], ' ') AS g
  FROM (SELECT k, w, unnest(range(1, len(w) - 3)) AS p FROM cut WHERE len(w) >= 5)),
twice AS (SELECT k, p, lag(p) OVER (PARTITION BY k ORDER BY p) AS before
  FROM (SELECT k, p, count(*) OVER (PARTITION BY k, g) AS n FROM win) WHERE n >= 2),
rep AS (SELECT k, sum(least(5, p - coalesce(before, p - 5))) AS n FROM twice GROUP BY k),
m AS (
  SELECT cut.k, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
    length(t) - length(replace(t, '!', '')) AS n_shouts
  FROM cut LEFT JOIN rep USING (k)),
c AS (SELECT *, CAST(len(l) AS BIGINT) AS n_lines,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines FROM m),
r AS (SELECT *, coalesce(1000 * n_symbols // nullif(word_chars, 0), 0) AS symbol_rate,
    coalesce(1000 * n_repeat_words // nullif(n_words, 0), 0) AS repeat_rate,
    coalesce(1000 * n_dup_lines // nullif(n_lines, 0), 0) AS dup_line_rate,
    coalesce(1000 * n_shouts // nullif(n_words, 0), 0) AS shout_rate FROM c),
v AS (
  SELECT lang, source, 'symbol_rate' AS metric, symbol_rate AS v FROM r
  UNION ALL SELECT lang, source, 'repeat_rate', repeat_rate FROM r
  UNION ALL SELECT lang, source, 'dup_line_rate', dup_line_rate FROM r
  UNION ALL SELECT lang, source, 'shout_rate', shout_rate FROM r),
levels AS (
  SELECT 0 AS level, lang, source, metric, v FROM v UNION ALL SELECT 1, lang, NULL, metric, v FROM v
  UNION ALL SELECT 2, NULL, NULL, metric, v FROM v),
sk AS (
  SELECT level, lang, source, metric,
    v - v % CAST(pow(10, greatest(length(CAST(v AS VARCHAR)) - 2, 0)) AS BIGINT) AS bucket,
    count(*) AS n
  FROM levels GROUP BY ALL),
run AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY bucket) AS below,
    sum(n) OVER (PARTITION BY level, lang, source, metric) AS docs FROM sk),
q AS (
  SELECT level, lang, source, metric, max(docs) AS docs,
    min(CASE WHEN below * 100 >= 25 * docs THEN bucket END) AS q1,
    min(CASE WHEN below * 100 >= 75 * docs THEN bucket END) AS q3
  FROM run GROUP BY level, lang, source, metric),
f AS (SELECT level, lang, source, max(docs) AS docs, {_FENCES} FROM q GROUP BY level, lang, source),
lim AS (
  SELECT o.lang, o.source, {_LIMITS}
  FROM f o JOIN f b ON b.level = 1 AND o.lang IS NOT DISTINCT FROM b.lang JOIN f a ON a.level = 2
  WHERE o.level = 0)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
    AND {" AND ".join(f"{n} <= max_{n}" for n in quality.FLOORS)} AS kept
FROM r JOIN lim ON r.lang IS NOT DISTINCT FROM lim.lang AND r.source IS NOT DISTINCT FROM lim.source
"""


def op5_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(table(spark, folder, "documents")).drop("row_hash")


QUERIES["op5_source_mix"] = op5_source_mix
ORACLES["op5_source_mix"] = rf"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS place,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
src AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source)),
w AS (SELECT *, CAST([5, 2, 1][number % 3 + 1] AS BIGINT) AS weight FROM src),
lvl AS (
  SELECT CAST(0 AS DOUBLE) AS level, CAST(-1 AS BIGINT) AS capped, CAST(0 AS BIGINT) AS turn
  UNION ALL
  SELECT CAST((SELECT sum(source_size) FROM w) * 1.0 - f.words AS DOUBLE) / f.rest, f.n, l.turn + 1
  FROM lvl l, LATERAL (
    SELECT count(CASE WHEN weight * l.level > 3 * source_size THEN 1 END) AS n,
      coalesce(sum(CASE WHEN weight * l.level > 3 * source_size THEN 3 * source_size END), 0) AS words,
      sum(CASE WHEN weight * l.level > 3 * source_size THEN NULL ELSE weight END) AS rest FROM w) f
  WHERE f.n <> l.capped AND f.rest > 0),
tgt AS (
  SELECT w.*, least(weight * level, CAST(3 * source_size AS DOUBLE)) AS target
  FROM w, (SELECT level FROM lvl ORDER BY turn DESC LIMIT 1)),
s0 AS (
  SELECT *, target / 8 AS ideal, CAST(floor(sum(target) OVER () / 8 + 0.5) AS BIGINT) AS total,
    CAST(floor(target / 8 + 0.5) AS BIGINT) AS seats, count(*) OVER () AS parties FROM tgt),
s1 AS (SELECT *, total - sum(seats) OVER () AS short FROM s0),
sc AS (
  SELECT number, sign(short) AS way, row_number() OVER (ORDER BY CASE WHEN short > 0 THEN -1 ELSE 1 END
    * (ideal / (2 * (CASE WHEN short > 0 THEN seats + step ELSE seats - 1 - step END) + 1)), number, step) AS r,
    abs(short) AS many
  FROM (SELECT *, unnest(range(0, CAST(ceil(ideal * parties / (2 * greatest(total, 1))) AS BIGINT) + 2)) AS step
        FROM s1 WHERE short <> 0)
  WHERE ideal > 0 AND CASE WHEN short > 0 THEN seats + step ELSE seats - 1 - step END >= 0),
quota AS (
  SELECT s1.*, s1.seats + coalesce(m.moved, 0) AS quota,
    CAST(greatest(ceil(source_size / {mixing.SHARD_WORDS}.0), 1) AS BIGINT) AS shards
  FROM s1 LEFT JOIN (SELECT number, sum(way) AS moved FROM sc WHERE r <= many GROUP BY number) m USING (number)),
dealt AS (
  SELECT d.*, q.number, q.source_size, q.target, q.quota,
    CAST(('0x' || substr(place, 9, 8)) AS BIGINT) % q.shards AS shard
  FROM sized d JOIN quota q ON d.source IS NOT DISTINCT FROM q.source),
h0 AS (
  SELECT number, shard, sum(size) AS shard_size, max(quota) AS total, max(source_size) AS whole
  FROM dealt GROUP BY number, shard),
h1 AS (
  SELECT *, coalesce(total * shard_size / CAST(nullif(whole, 0) AS DOUBLE), 0) AS ideal,
    count(*) OVER (PARTITION BY number) AS parties FROM h0),
h2 AS (SELECT *, CAST(floor(ideal + 0.5) AS BIGINT) AS seats FROM h1),
h3 AS (SELECT *, total - sum(seats) OVER (PARTITION BY number) AS short FROM h2),
hc AS (
  SELECT number, shard, sign(short) AS way, abs(short) AS many, row_number() OVER (PARTITION BY number
    ORDER BY CASE WHEN short > 0 THEN -1 ELSE 1 END
    * (ideal / (2 * (CASE WHEN short > 0 THEN seats + step ELSE seats - 1 - step END) + 1)), shard, step) AS r
  FROM (SELECT *, unnest(range(0, CAST(ceil(ideal * parties / (2 * greatest(total, 1))) AS BIGINT) + 2)) AS step
        FROM h3 WHERE short <> 0)
  WHERE ideal > 0 AND CASE WHEN short > 0 THEN seats + step ELSE seats - 1 - step END >= 0),
sh AS (
  SELECT h3.number, h3.shard, h3.shard_size,
    CAST(('0x' || substr(md5('mix:' || h3.number || ':' || h3.shard), 1, 8)) AS BIGINT)
      % CAST(greatest(ceil(h3.shard_size / 8.0), 1) AS BIGINT) * 8 AS b,
    CAST(least((h3.seats + coalesce(m.moved, 0)) * 8, 3 * h3.shard_size) AS BIGINT) AS words
  FROM h3 LEFT JOIN (SELECT number, shard, sum(way) AS moved FROM hc WHERE r <= many GROUP BY number, shard) m
    USING (number, shard)),
laid AS (
  SELECT dealt.*, sum(size) OVER (PARTITION BY number, shard ORDER BY place, doc_id, size
    ROWS UNBOUNDED PRECEDING) AS stop FROM dealt)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(coalesce(
    words // nullif(shard_size, 0) * size
    + greatest(0, least(stop, b + words % nullif(shard_size, 0)) - greatest(stop - size, b))
    + greatest(0, least(stop, b - shard_size + words % nullif(shard_size, 0))
        - greatest(stop - size, b - shard_size)), 0) AS BIGINT) AS taken
FROM laid JOIN sh USING (number, shard)
"""


def op6_line_chunks(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs).select(
        "doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


QUERIES["op6_line_chunks"] = op6_line_chunks
ORACLES["op6_line_chunks"] = f"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, text, string_split(text, chr(10)) AS l FROM documents),
h AS (
  SELECT k, doc_id, l, list_transform(l, lambda x: CAST(('0x' || substr(md5(x), 1, 8)) AS BIGINT)) AS h
  FROM d WHERE text IS NOT NULL),
ln AS (SELECT k, doc_id, unnest(range(1, len(l) + 1)) AS i, l, h FROM h),
ends AS (
  SELECT k, doc_id, i, l[i] AS line, coalesce(i >= 3 AND
    (h[i - 2] % {lines.PRIME} * {lines.BASE} + h[i - 1]) % {lines.PRIME} % {lines.ONE_IN} = 0, FALSE) AS starts FROM ln),
c AS (SELECT *, sum(CAST(starts AS INT)) OVER (PARTITION BY k ORDER BY i) AS c FROM ends),
chunk AS (
  SELECT k, doc_id, c, min(i) AS i, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS t
  FROM c GROUP BY k, doc_id, c),
multi AS (SELECT * FROM chunk WHERE n >= 2 AND length(trim(t, ' ')) > 0),
gone AS (SELECT k, c FROM (SELECT k, c, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS r
  FROM multi) WHERE r > 1),
marked AS (SELECT chunk.*, gone.k IS NOT NULL AS gone FROM chunk LEFT JOIN gone USING (k, c)),
kept AS (
  SELECT k, sum(n) AS n_lines, sum(CASE WHEN gone THEN n ELSE 0 END) AS n_removed,
    coalesce(string_agg(CASE WHEN NOT gone THEN t END, chr(10) ORDER BY i), '') AS t
  FROM marked GROUP BY k)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
  CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(kept.t) AS kept_sha256
FROM d LEFT JOIN kept USING (k)
"""


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))


QUERIES["op3_warc"] = op3_warc
ORACLES["op3_warc"] = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
g AS (SELECT digest, max(page_id) AS first FROM p WHERE n >= {warc.LEAST_REVISIT} GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN g USING (digest)
"""


def op4_url_models(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge_urls(table(spark, folder, "pages"))


QUERIES["op4_url_models"] = op4_url_models


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = (table(spark, folder, name) for name in ("documents", "labels"))
    return toxicity.score_toxicity(docs, labels)


QUERIES["op1_toxicity"] = op1_toxicity


def op8_cover_tree(spark: SparkSession, folder: str) -> DataFrame:
    return covertree.link_vectors(table(spark, folder, "embeddings"))


QUERIES["op8_cover_tree"] = op8_cover_tree
ORACLES["op8_cover_tree"] = """
WITH RECURSIVE d AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
v AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM d
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
reach AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links,
  least(vec_id, coalesce((SELECT min(b) FROM reach r WHERE r.a = vec_id), vec_id)) AS component_id,
  vec_id <= coalesce((SELECT min(b) FROM reach r WHERE r.a = vec_id), vec_id) AS kept
FROM embeddings
"""


def op9_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"), width=4).drop("row_hash")


QUERIES["op9_minhash"] = op9_minhash
ORACLES["op9_minhash"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS p FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY ALL),
l AS (SELECT a, b FROM met JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id
  WHERE 100 * met.n >= 80 * (x.n + y.n - met.n)),
reach AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(c.b, w.doc_id)) AS component_id,
  w.doc_id <= coalesce(c.b, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = w.doc_id
"""


def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"))


QUERIES["op2_best_fit_packing"] = op2_best_fit_packing


def op10_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.dedup_strings(table(spark, folder, "documents")).drop("kept")


QUERIES["op10_suffix_dedup"] = op10_suffix_dedup


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic.run_report(periodic.with_planted_runs(table(spark, folder, "documents")))


QUERIES["op11_periodic_runs"] = op11_periodic_runs


def op12_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secret_report(table(spark, folder, "documents"))


QUERIES["op12_secret_scan"] = op12_secret_scan


def op13_pivot_clustering(spark: SparkSession, folder: str) -> DataFrame:
    return clustering.cluster_vectors(table(spark, folder, "embeddings"))


QUERIES["op13_pivot_clustering"] = op13_pivot_clustering


def _round(n: int) -> str:
    """Vectors with their nearest centroid of round ``n``, and the centroids after it."""
    return f"""
a{n} AS (SELECT vec_id, v, arg_min(k, (d, k)) AS k, min(d) AS d FROM (
    SELECT s.id, vec_id, s.v, c.k, list_sum(list_transform(range(1, {clustering.DIM + 1}),
      lambda i: (s.v[i] - c.v[i]) * (s.v[i] - c.v[i]))) AS d
    FROM s, c{n} c) GROUP BY id, vec_id, v),
c{n + 1} AS (SELECT c.k, coalesce(m.v, c.v) AS v FROM c{n} c LEFT JOIN (
    SELECT k, list((t - ((t % n) + n) % n) // n ORDER BY i) AS v FROM (
      SELECT k, i, CAST(sum(v[i]) AS BIGINT) AS t, count(*) AS n
      FROM (SELECT k, v, unnest(range(1, {clustering.DIM + 1})) AS i FROM a{n}) GROUP BY k, i) GROUP BY k) m USING (k))"""


ORACLES["op13_pivot_clustering"] = f"""
WITH f AS (
  SELECT row_number() OVER () AS id, vec_id, embedding AS e FROM embeddings
  WHERE len(embedding) = {clustering.DIM}
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT id, vec_id, list_transform(e, lambda x: CAST(floor({clustering.STEPS} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM f),
c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v
  FROM (SELECT v, sha256('1:' || CAST(vec_id AS VARCHAR)) AS h FROM s ORDER BY h NULLS LAST, v LIMIT {clustering.CENTROIDS})),
{",".join(_round(n) for n in range(clustering.ROUNDS + 1))}
SELECT vec_id, CAST(a.k AS INT) AS cluster, CAST(d AS BIGINT) AS distance,
  CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{clustering.ROUNDS} a JOIN c{clustering.ROUNDS} c USING (k)
"""
