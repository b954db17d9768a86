"""The operators as queries over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import bayes_dedup, bpe, dual_tree_search, fingerprints, jaccard, licenses, mixing, neighbours, ngram_lm, periodic_runs, preferences, ranking, token_rollup

#: The vocabulary file of byte-level BPE; a parameter of the operator.
BPE_FILE = public_tokenizers.path("byte_bpe_50k.json")

UPPER, LOWER = licenses.UPPER, licenses.LOWER


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score_texts(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files: a folder for each source, in it one for each language, in it one for each thousand ids."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("_"))
    thousand = F.coalesce(F.floor(F.col("doc_id") / 1000).cast("string"), F.lit("_"))
    return docs.select("doc_id", F.concat_ws("/", part("source"), part("lang"), thousand, F.concat(part("doc_id"), F.lit(".txt"))).alias("path"), "text")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(document_paths(table(spark, sf_dir, "documents")))
    doc_id = F.regexp_extract("path", "([0-9]+)[.]txt$", 1).cast("long")
    return found.select(doc_id.alias("doc_id"), "path", "license", F.round("similarity", 6).alias("similarity"), "origin", "directory")


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), "id % 100 = 0", k=10)


def digests(encoded: DataFrame) -> DataFrame:
    """Digest columns of ids and decoded texts."""
    return encoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), BPE_FILE))


def op9_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences.format_pairs(preferences.exchanged_endings(table(spark, sf_dir, "conversations")))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rollup.maintain(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), scratch_path(spark, "rollup"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree_search.best_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bayes_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), plant=True)


QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_fingerprints, op3_jaccard_join, op4_lm_scores, op5_quality, op6_licenses, op7_neighbours, op8_bpe,
        op9_preferences, op10_token_counts, op11_lexical_search, op12_near_dedup, op13_periodic_runs,
    )
}

MIX_SQL = r"""
WITH RECURSIVE given AS (SELECT *, coalesce(text, '') AS body FROM documents),
volumes AS (SELECT source, CAST(sum(length(body) + 1) AS DOUBLE) AS volume FROM given GROUP BY source),
rates AS (
  SELECT source, sqrt(volume) / sum(sqrt(volume)) OVER () * sum(volume) OVER () / volume AS rate FROM volumes),
steps AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM steps WHERE k < ceil(rate + 12 * sqrt(rate) + 30)),
seeds AS (
  SELECT *, 'mix:' || coalesce(CAST(doc_id AS VARCHAR), 'text ' || md5(body)) AS seed FROM given),
drawn AS (
  SELECT *, CAST(CAST('0x' || substr(md5(seed), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u FROM seeds),
copies AS (
  SELECT d.*, (SELECT count(*) FROM steps s WHERE s.source IS NOT DISTINCT FROM d.source AND s.c <= d.u) AS n FROM drawn d),
repeated AS (SELECT *, unnest(range(1, n + 1)) AS copy FROM copies)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS copy_no, md5(seed || ':' || CAST(copy AS VARCHAR)) AS shuffle_key FROM repeated
"""

JACCARD_SQL = rf"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM worded),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least_id AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT doc_id, min(other) AS least_id FROM reach GROUP BY doc_id) USING (doc_id)
"""

NEAR_DEDUP_SQL = rf"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS s FROM worded),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other),
roots AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN roots USING (doc_id)
"""

SEARCH_SQL = rf"""
WITH given AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
lengths AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n FROM given WHERE len(w) > 0),
totals AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
counts AS (SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM given) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight
  FROM counts CROSS JOIN totals GROUP BY term, docs),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
scored AS (
  SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN lengths USING (doc_id) CROSS JOIN totals GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""

_TEMPLATES = ", ".join(f"('{name}', '{text}')" for name, text in licenses.TEMPLATES.items())
_WORDS = "list_filter(string_split_regex(translate({}, '" + UPPER + "', '" + LOWER + "'), '[^a-z0-9]+'), lambda x: x <> '')"
LICENSE_SQL = rf"""
WITH RECURSIVE templates(license, words) AS (SELECT name, {_WORDS.format("t")} FROM (VALUES {_TEMPLATES}) v(name, t)),
given AS (
  SELECT doc_id, source || '/' || lang || '/' || CAST(doc_id // 1000 AS VARCHAR) AS home, coalesce(text, '') AS text FROM documents),
lines AS (SELECT doc_id, home, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM given),
worded AS (SELECT * FROM (SELECT doc_id, home, line_no, {_WORDS.format("line")} AS words FROM lines) WHERE len(words) > 0),
vocabulary AS (SELECT DISTINCT unnest(words) AS word FROM templates),
terms AS (
  SELECT doc_id, home, line_no, word, count(*) AS tf FROM (SELECT doc_id, home, line_no, unnest(words) AS word FROM worded) GROUP BY ALL),
total AS (SELECT count(*) AS n FROM worded),
weights AS (
  SELECT word, ln((1 + any_value(n)) / (1 + count(t.word))) + 1 AS weight FROM vocabulary LEFT JOIN terms t USING (word) CROSS JOIN total GROUP BY word),
parts AS (
  SELECT license, word, tf * weight AS x FROM (SELECT license, word, count(*) AS tf FROM (SELECT license, unnest(words) AS word FROM templates) GROUP BY ALL) JOIN weights USING (word)),
template_lengths AS (SELECT license, sqrt(sum(x * x)) AS length FROM parts GROUP BY license),
weighed AS (SELECT t.*, tf * coalesce(weight, ln(1 + (SELECT n FROM total)) + 1) AS x FROM terms t LEFT JOIN weights USING (word)),
lengths AS (SELECT doc_id, line_no, sqrt(sum(x * x)) AS length, sum(tf) AS line_words FROM weighed GROUP BY ALL),
dots AS (SELECT doc_id, home, line_no, license, sum(w.x * p.x) AS dot FROM weighed w JOIN parts p USING (word) GROUP BY ALL),
scored AS (
  SELECT doc_id, home, line_no, license, line_words, round(dot / l.length / t.length, 9) AS similarity
  FROM dots JOIN lengths l USING (doc_id, line_no) JOIN template_lengths t USING (license)),
best AS (
  SELECT * FROM scored WHERE similarity >= {licenses.LEAST}
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, license, line_words, line_no) = 1),
sizes AS (SELECT doc_id, sum(len(words)) AS file_words FROM worded GROUP BY doc_id),
licensed AS (
  SELECT home, license AS given_license, similarity AS given_similarity FROM best JOIN sizes USING (doc_id) WHERE line_words >= {licenses.SHARE} * file_words
  QUALIFY row_number() OVER (PARTITION BY home ORDER BY similarity DESC, home || '/' || CAST(doc_id AS VARCHAR) || '.txt') = 1)
SELECT g.doc_id, g.home || '/' || CAST(g.doc_id AS VARCHAR) || '.txt' AS path, coalesce(license, given_license) AS license,
  round(coalesce(similarity, given_similarity), 6) AS similarity,
  CASE WHEN license IS NOT NULL THEN 'own' WHEN given_license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN license IS NULL AND given_license IS NOT NULL THEN g.home END AS directory
FROM given g LEFT JOIN best b USING (doc_id) LEFT JOIN licensed l ON l.home = g.home
"""

NEIGHBOURS_SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (
  SELECT q.vec_id AS query_id, c.vec_id, 
    sqrt(list_reduce(list_transform(list_zip(q.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda a, b: a + b)) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM d
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) <= 10
"""

PREFERENCE_SQL = f"""
WITH given AS (
  SELECT conv_id AS pair_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
endings AS (
  SELECT pair_id, turn, text FROM given WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY turn DESC, text DESC) = 1),
met AS (
  SELECT g.*, coalesce(g.role = 'assistant' AND g.turn = e.turn AND g.text = e.text, false) AS is_last, o.text AS ending
  FROM given g LEFT JOIN endings e ON e.pair_id = g.pair_id LEFT JOIN endings o ON o.pair_id = xor(g.pair_id, 1)),
paired AS (
  SELECT pair_id, 'chosen' AS side, turn, role, text FROM met
  UNION ALL SELECT pair_id, 'rejected', turn, role, CASE WHEN is_last THEN ending ELSE text END FROM met WHERE NOT is_last OR ending IS NOT NULL),
sides AS (
  SELECT pair_id, turn, role, text, bool_or(side = 'chosen') AS c, bool_or(side = 'rejected') AS r FROM paired GROUP BY ALL),
parting AS (SELECT pair_id, min(turn) AS parting FROM sides WHERE NOT (c AND r) GROUP BY pair_id),
placed AS (
  SELECT s.pair_id, turn, role, text, 'prompt' AS part FROM sides s LEFT JOIN parting p USING (pair_id) WHERE parting IS NULL OR turn < parting
  UNION ALL SELECT s.pair_id, turn, role, text, 'chosen' FROM sides s JOIN parting p USING (pair_id) WHERE turn >= parting AND c
  UNION ALL SELECT s.pair_id, turn, role, text, 'rejected' FROM sides s JOIN parting p USING (pair_id) WHERE turn >= parting AND r),
shown AS (
  SELECT *, (row_number() OVER (PARTITION BY pair_id, part, chunk ORDER BY turn, role, text) - 1) // {preferences.CHUNK} AS piece FROM (
    SELECT *, CAST(floor(turn / {preferences.CHUNK}) AS BIGINT) AS chunk, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown FROM placed)),
run AS (
  SELECT *, coalesce(sum(length(shown)) OVER (PARTITION BY pair_id, part, chunk, piece ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    + length(role) + 5 AS b FROM shown)
SELECT pair_id, part, chunk, piece, count(*) AS n_turns, string_agg(shown, '' ORDER BY turn, role, text) AS text,
  coalesce(string_agg(CAST(CAST(b AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(b + length(text) + 7 AS BIGINT) AS VARCHAR), ' ' ORDER BY turn, role, text)
    FILTER (WHERE role = 'assistant' AND part <> 'prompt'), '') AS loss_spans
FROM run GROUP BY pair_id, part, chunk, piece
"""

ROLLUP_SQL = r"""
WITH counted AS (
  SELECT doc_id, source, lang, CAST(length(coalesce(text, '')) AS BIGINT) AS characters,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS v1,
    len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9\x{80}-\x{10FFFF}]+|[!-/:-@\[-`{-~]')) AS v2 FROM documents),
marks AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
live AS (
  SELECT c.*, quality = 0 AS poor FROM counted c LEFT JOIN marks USING (doc_id) WHERE coalesce(toxic, 0) <> 1),
versions AS (SELECT source, lang, CASE WHEN poor THEN 'v2' ELSE 'v1' END AS tokenizer, CASE WHEN poor THEN v2 ELSE v1 END AS tokens, characters FROM live)
SELECT source, lang, tokenizer, count(*) AS documents, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(characters) AS BIGINT) AS characters
FROM versions GROUP BY source, lang, tokenizer
"""

SQL = {
    "op1_mix_sources": MIX_SQL, "op3_jaccard_join": JACCARD_SQL, "op6_licenses": LICENSE_SQL, "op7_neighbours": NEIGHBOURS_SQL,
    "op9_preferences": PREFERENCE_SQL, "op10_token_counts": ROLLUP_SQL, "op11_lexical_search": SEARCH_SQL, "op12_near_dedup": NEAR_DEDUP_SQL,
}
