"""Registered queries of the corpus operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plansift.llm import divergence, extraction, interactions, licenses, lines, minhash, mixing, pieces, quality, sharding, substrings, toxicity, vectors
from plansift.llm.common import table, written


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality(table(spark, sf_dir, "documents"))
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the text of a page is cut out of its html once; counting, marking and dropping lines read it again
    pages = written(table(spark, sf_dir, "pages").select(
        "page_id", lines.host_of(F.col("url")).alias("host"), lines.visible_text(F.col("html")).alias("text")))
    found = lines.dedup_lines(pages, "page_id", F.col("host"), F.col("text"))
    return found.select("row.page_id", "host", "n_lines", "n_dropped", "kept_text")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("row.*", "copy", "n_copies", "shuffle_key")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op2_quality_rules, op8_line_dedup, op9_mixing, op10_sharding)}
ORACLE: dict[str, str] = {}

_WORD = r"[^\x20\x09-\x0D]+"
_WORD_LINES = rf"list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}'))"

ORACLE["op2_quality_rules"] = rf"""
WITH w AS (SELECT row_number() OVER () AS r, *, coalesce(regexp_extract_all(text, '{_WORD}'), []) AS ws, {_WORD_LINES} AS ls FROM documents),
windows AS (SELECT r, unnest(range(1, len(ws) - 3)) AS i, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) AS g FROM w),
hit AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
cover AS (SELECT r, count(DISTINCT i + k) AS n FROM hit, range(0, 5) AS o(k) GROUP BY r),
m AS (SELECT w.*, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
  length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
  coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN cover USING (r)),
j AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 3 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 2 * n_dup_lines > len(ls)
    OR 4 * length(regexp_replace(text, '[0-9\x21-\x40\x5B-\x60\x7B-\x7E\x09-\x0D\x20]+', '', 'g')) < word_chars
    OR len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|\x{{2026}})[\x20\x09-\x0D]*$'))) > 0.3 * len(ls)
    OR len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*\x{{2022}}][\x20]'))) > 0.9 * len(ls)
    OR len(list_filter(ws, lambda x: length(x) >= 1000)) > 0) AS kept
FROM j"""

_BLOCK = lines.BLOCK_TAGS
ORACLE["op8_line_dedup"] = rf"""
WITH p AS (SELECT row_number() OVER () AS r, page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)), '') AS host,
  string_split(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g'),
    '(?i)</?({_BLOCK})(/|[ \t\n\r][^>]*)?>', chr(10), 'g'), '<[^>]*>', '', 'g'), chr(10)) AS ls FROM pages),
l AS (SELECT r, host, unnest(ls) AS raw, generate_subscripts(ls, 1) AS i FROM p),
t AS (SELECT r, host, i, raw, trim(raw, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS line FROM l),
totals AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
bad AS (SELECT t.host, line FROM t JOIN totals ON t.host IS NOT DISTINCT FROM totals.host WHERE line <> ''
  GROUP BY t.host, line HAVING count(DISTINCT r) > 0.2::DOUBLE * any_value(pages) AND count(DISTINCT r) > 1),
flag AS (SELECT t.*, bad.line IS NOT NULL AS dropped FROM t LEFT JOIN bad ON t.host IS NOT DISTINCT FROM bad.host AND t.line = bad.line)
SELECT p.page_id, p.host, count(*) FILTER (line <> '') AS n_lines, coalesce(count(*) FILTER (dropped), 0) AS n_dropped,
  coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (NOT dropped), '') AS kept_text
FROM p LEFT JOIN flag USING (r) GROUP BY p.r, p.page_id, p.host"""

_UNIT = "(('0x' || md5(concat('{seed}:', coalesce(doc_id::VARCHAR, 'null'), ':1'))[1:13])::BIGINT::DOUBLE + 0.5) / 4503599627370496"
ORACLE["op9_mixing"] = f"""
WITH RECURSIVE s AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, 0.5) AS w FROM documents GROUP BY source),
r AS (SELECT source, (sum(n) OVER ())::DOUBLE * (w / sum(w) OVER ()) / n AS rate FROM s),
k AS (SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS cdf FROM r
  UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) FROM k WHERE k < 60),
d AS (SELECT documents.*, {_UNIT.format(seed=mixing.SEED)} AS u FROM documents),
c AS (SELECT d.* EXCLUDE (u), (SELECT count(*) FROM k WHERE k.source IS NOT DISTINCT FROM d.source AND k.cdf <= d.u) AS n_copies FROM d),
e AS (SELECT c.*, unnest(range(0, n_copies)) AS copy FROM c)
SELECT doc_id, text, lang, source, n_chars, copy, n_copies, md5(concat('{mixing.SEED}-order:', coalesce(doc_id::VARCHAR, 'null'), ':', copy)) AS shuffle_key FROM e"""


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.dedup_substrings(table(spark, sf_dir, "documents"), digest=True)
    return found.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.encode_decode(table(spark, sf_dir, "documents"), pieces.public_model(), digest=True)
    return found.select("doc_id", "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    each = F.transform("licences", lambda x: F.concat(x["licence"], F.lit(":"), x["kind"], F.lit("="), x["n"].cast("string")))
    return found.select("doc_id", "n_known", F.array_join(each, ";").alias("licences"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE["op3_license_scan"] = licenses.oracle_sql()

QUERIES |= {f.__name__: f for f in (op1_embedding_dedup, op3_license_scan, op4_toxicity, op5_minhash_dedup, op6_substring_dedup, op7_sentencepiece)}


def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.filter_interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extraction.extract(pages, extraction.train(pages)).select("page_id", "url", "text", "n_chars")


QUERIES |= {f.__name__: f for f in (op11_html_extraction, op12_filter_interactions, op13_source_divergence)}
ORACLE["op12_filter_interactions"] = interactions.oracle_sql()
ORACLE["op13_source_divergence"] = divergence.oracle_sql()
