"""The queries of this subpackage: each applies one operator, with production parameters, to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm import simhash

    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), max_bits=3, shingle_words=3, seed=42)


def op2_isomedia(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm import isomedia

    return isomedia.round_trip(_table(spark, sf_dir, "documents"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm import langid

    return langid.identify(_table(spark, sf_dir, "documents"), folds=4, held=2)


def op4_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm import linededup

    return linededup.dedup(_table(spark, sf_dir, "documents"), threshold=0.8)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm import store, warc

    return warc.captures(_table(spark, sf_dir, "pages"), store.new_path(spark, "warc"), min_revisit_bytes=0, compression="gzip")


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm import decontam

    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op7_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm import urlfilter

    return urlfilter.judge(_table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm import toxicity

    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), folds=5, held=0)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from graphloom.llm import packing

    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm import quality

    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), at_least=1, threshold=0.5)


QUERIES = {"op1_simhash": op1_simhash, "op2_isomedia": op2_isomedia, "op3_langid": op3_langid, "op4_linededup": op4_linededup, "op5_warc": op5_warc, "op6_decontam": op6_decontam, "op7_urlfilter": op7_urlfilter, "op8_toxicity": op8_toxicity, "op9_packing": op9_packing, "op10_quality": op10_quality}
#: Every pair of lines that share a pair of words is counted; the operator's filters have no part in it.
LINES_SQL = """
WITH l AS (
  SELECT doc_id, i, list_filter(string_split_regex(lower(string_split(text, chr(10))[i]), '[ \\t\\x0B\\f\\r]+'), lambda x: x <> '') AS w
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)
), s AS (
  SELECT doc_id, i, CASE WHEN len(w) = 1 THEN w ELSE list_sort(list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]))) END AS s FROM l WHERE len(w) > 0
), placed AS (SELECT doc_id, i, s, row_number() OVER (ORDER BY doc_id, i) AS place FROM s),
first AS (SELECT s, min(place) AS place, len(s) AS n FROM placed GROUP BY s),
tokens AS (SELECT place, n, unnest(s) AS t FROM first),
similar_to AS (
  SELECT b.place FROM tokens a JOIN tokens b ON a.t = b.t AND a.place < b.place GROUP BY a.place, b.place, a.n, b.n
  HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9
), gone AS (
  SELECT doc_id, list(i) AS gone FROM placed JOIN first USING (s)
  WHERE placed.place > first.place OR first.place IN (SELECT place FROM similar_to) GROUP BY doc_id
), cut AS (
  SELECT doc_id, lang, source, CASE WHEN gone IS NULL THEN text ELSE
    coalesce(array_to_string(list_transform(list_filter(range(1, len(string_split(text, chr(10))) + 1), lambda k: NOT list_contains(gone, k)), lambda k: string_split(text, chr(10))[k]), chr(10)), '') END AS text,
    coalesce(len(gone), 0) AS lines_removed
  FROM documents LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, text, lang, source, length(text) AS n_chars, lines_removed FROM cut
"""

#: Base 32 from the 160 bits of a digest.
WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT *, row_number() OVER w AS k, first_value(page_id) OVER w AS first FROM p WINDOW w AS (PARTITION BY h ORDER BY page_id DESC NULLS LAST)),
b AS (SELECT *, CAST(CAST(unhex(h) AS BIT) AS VARCHAR) AS bits FROM r)
SELECT page_id, octet_length(encode(html)) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + list_sum(list_transform(range(1, 6), lambda j: CAST(substr(bits, CAST(5 * i + j AS INT), 1) AS INT) * (1 << CAST(5 - j AS INT)))) AS INT), 1)), '') AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN first END AS refers_to
FROM b
"""

#: Rules, and for the rest the scores of the link graph after 100 rounds.
URL_SQL = """
WITH RECURSIVE u AS (
  SELECT page_id, coalesce(html, '') AS html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages
), rules(kind, rule, h, p) AS (VALUES ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'), ('allow', 'www.example.com/en/', 'www.example.com', '/en/'), ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')),
fits AS (
  SELECT page_id, arg_max(rule, len(rule)) AS rule, arg_max(kind, len(rule)) AS said FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY 1
), links AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=\\s*["'']?([^"''\\s>]+)', 1)) AS link FROM u WHERE host <> ''),
ends AS (
  SELECT src, CASE WHEN starts_with(link, '//') THEN translate(regexp_extract('x:' || link, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    WHEN lower(regexp_extract(link, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) IN ('http', 'https') THEN translate(regexp_extract(link, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    WHEN regexp_extract(link, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) = '' THEN src END AS dst FROM links
), edges AS (SELECT src, dst, count(*) AS n FROM ends WHERE dst <> '' GROUP BY 1, 2),
share AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS part FROM edges),
base AS (
  SELECT host, max(t) AS t, max(d) AS d FROM (
    SELECT host, avg(CASE WHEN said = 'allow' THEN 1.0 ELSE 0.0 END) AS t, avg(CASE WHEN said = 'block' THEN 1.0 ELSE 0.0 END) AS d FROM u LEFT JOIN fits USING (page_id) WHERE host <> '' GROUP BY 1
    UNION ALL SELECT unnest([src, dst]), 0, 0 FROM edges) GROUP BY 1
), steps AS (
  SELECT src AS sender, dst AS host, part AS ahead, 0 AS back FROM share UNION ALL SELECT dst, src, 0, part FROM share UNION ALL SELECT host, host, 1, 1 FROM base WHERE host NOT IN (SELECT src FROM edges)
), scores(round, host, t, d) AS (
  SELECT 0, host, CAST(t AS DOUBLE), CAST(d AS DOUBLE) FROM base
  UNION ALL
  SELECT any_value(s.round) + 1, b.host, 0.15 * any_value(b.t) + 0.85 * sum(x.ahead * s.t), 0.15 * any_value(b.d) + 0.85 * sum(x.back * s.d) FROM scores s JOIN steps x ON x.sender = s.host JOIN base b ON b.host = x.host WHERE s.round < 100 GROUP BY b.host
)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN d >= 0.5 AND d > t THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN fits USING (page_id) LEFT JOIN (SELECT host, t, d FROM scores WHERE round = 100) USING (host)
"""

ORACLE_SQL: dict[str, str] = {"op4_linededup": LINES_SQL, "op5_warc": WARC_SQL, "op7_urlfilter": URL_SQL}
