"""The registered queries: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tasteloom.llm import (decontaminate, fingerprints, neardup, packing, periodic, quality, shards, suffix_dedup, token_files, toxicity,
                           variants, window_dedup, wrappers)
from tasteloom.llm.inputs import table
from tasteloom.session import new_path

QUERIES = {}
SQL: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    found = fingerprints.fingerprints(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_chars", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        fingerprints.as_text(F.col("sketch")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next")


@query
def op2_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"))


@query
def op3_token_id_output(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    manifest = token_files.write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"),
                                             new_path(spark, "token-files"))
    return token_files.read_token_files(manifest, checksums=True)


@query
def op4_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op8_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return wrappers.extract_main_text(table(spark, folder, "pages"))


@query
def op9_harmonic_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op5_hilbert_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shards.hilbert_shards(table(spark, folder, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve")


@query
def op6_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_dedup.suffix_dedup(table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = window_dedup.substring_dedup(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256)
                        .alias("kept_sha256"), "n_spans")


@query
def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants.spelling_variants(table(spark, folder, "documents"))


@query
def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic.periodic_runs(table(spark, folder, "documents"), widen=True)
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli",
                        F.sha2(F.col("runs").cast("binary"), 256).alias("runs_sha256"),
                        F.sha2(F.col("kept_text").cast("binary"), 256).alias("collapsed_sha256"))


@query
def op13_toxicity_grammar(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


# ---------------------------------------------------------------- the same in SQL

SQL["op2_minhash_near_dedup"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[j:j + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS j FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
  GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
  WHERE 100 * c >= 75 * (x.n + y.n - c)),
steps AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reached AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reached.a, steps.b FROM reached JOIN steps ON reached.b = steps.a),
roots AS (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM roots LEFT JOIN sizes USING (doc_id)
"""

# Every alignment, with a seed or without one.
SQL["op4_benchmark_decontamination"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM d),
bw AS (SELECT item_id, len(w) AS n, unnest(w) AS word, unnest(range(0, len(w))) AS j FROM b WHERE len(w) >= 5),
same AS (
  SELECT doc_id, item_id, i - j AS start, any_value(n) AS n, list(j) AS js, least(16, any_value(n)) AS size
  FROM dw JOIN bw USING (word) GROUP BY doc_id, item_id, i - j HAVING count(*) >= ceil(0.8 * least(16, any_value(n)))),
found AS (
  SELECT * FROM same WHERE list_max(list_transform(range(0, n - size + 1),
    lambda s: len(list_filter(js, lambda x: x >= s AND x < s + size)))) >= ceil(0.8 * size))
SELECT doc_id, item_id, max(len(js)) AS matched, any_value(n) AS n_words, arg_max(start, (len(js), -start)) AS start
FROM found GROUP BY doc_id, item_id
"""

SQL["op6_suffix_array_dedup"] = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (
  SELECT doc_id, j, substr(h, 2 * j + 1, 200) AS s
  FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS j FROM d WHERE len(h) >= 200)),
hits AS (SELECT doc_id, j FROM strings QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, j) > 1),
heads AS (
  SELECT *, CASE WHEN j <= lag(j) OVER (PARTITION BY doc_id ORDER BY j) + 100 THEN 0 ELSE 1 END AS head FROM hits),
runs AS (SELECT *, sum(head) OVER (PARTITION BY doc_id ORDER BY j) AS run FROM heads),
gone AS (SELECT doc_id, run, min(j) AS a, max(j) + 100 AS b FROM runs GROUP BY doc_id, run),
gaps AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM gone),
parts AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, max(b) AS tail,
    string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS front
  FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN parts USING (doc_id)
"""

# The tables' pages mark their content with an article element.
SQL["op8_html_extraction"] = r"""
WITH bodies AS (
  SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*?)(?:</article>|\z)', 1),
    '<(br|/?b)>', ' ', 'g'), '<[^>]*\z', '') AS body FROM pages),
blocks AS (
  SELECT page_id, url, list_filter(list_transform(regexp_split_to_array(body, '<[^>]*>'), lambda x: trim(regexp_replace(
    regexp_replace(regexp_replace(x, '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') AS b FROM bodies)
SELECT page_id, url, array_to_string(b, chr(10) || chr(10)) AS text, length(array_to_string(b, chr(10) || chr(10))) AS n_chars FROM blocks
"""

SQL["op10_substring_dedup"] = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, j, list_aggregate(w[j:j + 49], 'string_agg', ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS j FROM words WHERE len(w) >= 50)),
firsts AS (SELECT win, min(doc_id) AS first FROM windows GROUP BY win HAVING min(doc_id) < max(doc_id)),
hits AS (
  SELECT DISTINCT doc_id, j + s AS i FROM windows JOIN firsts USING (win), range(50) AS t(s)
  WHERE first < doc_id),
gone AS (SELECT doc_id, list(i) AS g, list_sort(list(i)) AS o FROM hits GROUP BY doc_id),
parts AS (
  SELECT words.doc_id, w, coalesce(g, []) AS g, coalesce(o, []) AS o FROM words LEFT JOIN gone USING (doc_id))
SELECT doc_id, len(w) AS n_words, len(g) AS n_removed,
       sha256(coalesce(list_aggregate(list_filter(w, lambda x, i: NOT list_contains(g, i)), 'string_agg', ' '), ''))
         AS kept_sha256,
       len(list_filter(o, lambda x, i: i = 1 OR o[i - 1] <> x - 1)) AS n_spans
FROM parts
"""

# crc32 from its rule: the table of all bytes, then a step for each byte of a text.
_CRC = """crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END)) AS c
    FROM (SELECT unnest(range(0, 256)) AS i)))"""
_CRC_OF_X = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(range(0, strlen(x)), lambda k: ('0x' || substr(hex(encode(x)), 2 * k + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"""

SQL["op11_spelling_variants"] = rf"""
WITH RECURSIVE {_CRC},
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
kinds AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
coded AS (SELECT run, n, {_CRC_OF_X} AS h FROM (SELECT run, n, doc_id || ':' || run AS x FROM kinds), crc_table),
results AS (
  SELECT n, CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM coded),
words AS (SELECT word, sum(n)::BIGINT AS n FROM results GROUP BY word HAVING sum(n) >= 3 AND length(word) >= 5),
cuts AS (
  SELECT word, left(word, i) || '*' || substr(word, i + 2) AS gap, left(word, i) || substr(word, i + 2) AS less
  FROM (SELECT word, unnest(range(0, length(word))) AS i FROM words)),
pairs AS (
  SELECT x.word AS a, y.word AS b FROM cuts x JOIN cuts y USING (gap) WHERE x.word <> y.word
  UNION SELECT c.word, w.word FROM cuts c JOIN words w ON c.less = w.word
  UNION SELECT w.word, c.word FROM cuts c JOIN words w ON c.less = w.word),
near AS (
  SELECT a, count(*) AS n_near, max(n) AS most, arg_min(b, (-n, b)) AS best FROM pairs JOIN words ON b = word GROUP BY a),
found AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * n THEN best END AS form,
    CASE WHEN most >= 2 * n THEN most END AS form_n FROM words LEFT JOIN near ON a = word),
ways AS (
  SELECT word, word AS root, form FROM found
  UNION ALL SELECT ways.word, found.word, found.form FROM ways JOIN found ON found.word = ways.form)
SELECT word, found.form, root, n, n_near, form_n FROM found JOIN ways USING (word) WHERE ways.form IS NULL
"""

SQL["op12_periodic_runs"] = rf"""
WITH {_CRC},
codes AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {_CRC_OF_X} AS h
  FROM (SELECT doc_id, text, doc_id::VARCHAR AS x FROM documents), crc_table),
places AS (SELECT doc_id, w, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM codes),
tails AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM places),
texts AS (
  SELECT doc_id, n, CASE WHEN a IS NULL THEN w
    ELSE list_transform(range(0, n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) END AS w FROM tails),
words AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(0, n)) AS i FROM texts),
equal AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y
  ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM equal),
stretches AS (
  SELECT doc_id, min(i) AS start, count(*) + q AS length, q FROM islands GROUP BY doc_id, q, island
  HAVING count(*) >= 3 * q AND count(*) + q >= 6),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY doc_id, start, length),
gone AS (
  SELECT doc_id, list(DISTINCT i) AS gone FROM (SELECT doc_id, unnest(range(start + period, start + length)) AS i FROM runs)
  GROUP BY doc_id),
listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
  FROM runs GROUP BY doc_id),
best AS (
  SELECT doc_id, start, length, period FROM runs x WHERE NOT EXISTS (
    SELECT 1 FROM runs y WHERE y.doc_id = x.doc_id AND (y.length * x.period > x.length * y.period
      OR (y.length * x.period = x.length * y.period AND (y.start, y.period) < (x.start, x.period)))))
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256,
  sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w
    ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i - 1)) END, ' '), '')) AS collapsed_sha256
FROM texts LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN gone USING (doc_id)
"""
