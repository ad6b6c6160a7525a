"""The registered queries of the corpus operators, each over its whole table, and the SQL that they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing
from .best_fit import best_two_fit
from .common import read
from .exact_dedup import exact_groups
from .langid import identify
from .license_scan import license_scan
from .line_rules import line_rules
from .merkle import audit, tree
from .packing import harmonic_pack
from .quality_gam import quality_scores
from .simhash import simhash_groups
from .spelling import spelling_variants
from .token_attribution import section_tokens
from .whitening import whiten


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file is on this machine; the operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))


def damaged(pages: DataFrame) -> DataFrame:
    """The replica that op2 audits: ``pages`` with one in 101 pages altered, one in 103 lost and one in 107 repeated."""
    key = F.col("page_id")
    html = F.when(key % 101 == 7, F.concat(F.col("html"), F.lit("x"))).otherwise(F.col("html"))
    return pages.where(key.isNull() | (key % 103 != 11)).select(
        F.explode(F.when(key % 107 == 13, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))), "page_id", "url", html.alias("html")
    ).drop("col")


def op2_warc_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return audit(tree(pages), tree(damaged(pages)))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents"))


def op4_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmonic_pack(read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op5_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), mixing.label_domain(), mixing.WEIGHTS)


def op6_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"))


def op7_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules(read(spark, sf_dir, "documents"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(read(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read(spark, sf_dir, "documents"))


def op12_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_two_fit(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deviation as a long; null if it has more than 63 bits."""
    return whiten(read(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_language_id, op2_warc_merkle_audit, op3_license_scan, op4_harmonic_packing, op5_soft_mixing,
        op6_token_attribution, op7_quality_gam, op8_line_rules, op9_simhash_dedup, op10_exact_dedup,
        op11_spelling_variants, op12_best_two_fit, op13_embedding_whitening,
    )}


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS host,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, i AS p FROM rep UNION ALL SELECT doc_id, i + 1 FROM rep UNION ALL SELECT doc_id, i + 2 FROM rep)
  GROUP BY doc_id),
lines AS (
  SELECT doc_id, host, trim(raw, ' ') AS line
  FROM (SELECT doc_id, host, unnest(string_split(regexp_replace(lower(t), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), chr(10))) AS raw FROM d)
  WHERE trim(raw, ' ') <> ''),
common AS (SELECT host, line FROM lines GROUP BY host, line HAVING count(DISTINCT doc_id) > 20),
lost AS (
  SELECT doc_id, count(*) AS common_lines, sum(length(l.line) - length(replace(l.line, ' ', '')) + 1) AS common_line_words
  FROM lines l JOIN common c ON l.host = c.host AND l.line = c.line GROUP BY doc_id),
b AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(common_lines, 0) AS BIGINT) AS common_lines,
         CAST(coalesce(common_line_words, 0) AS BIGINT) AS common_line_words
  FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id LEFT JOIN lost ON d.doc_id = lost.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND common_line_words <= 0.5 * n_words AS kept, common_lines, common_line_words
FROM f
"""

OP10_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""


#: A page's record and its place: 1024 pages a file, offsets in the order of page_id.
OP2_SQL = r"""
WITH r AS (
  SELECT page_id, html, page_id // 1024 AS warc_file, page_id % 1024 AS slot,
         'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>'
           || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html'
           || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
           || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM pages),
o AS (
  SELECT *, CAST(strlen(record) AS BIGINT) AS bytes,
         coalesce(sum(strlen(record)) OVER (PARTITION BY warc_file ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bytes_before
  FROM r)
SELECT warc_file, slot, CASE WHEN page_id % 101 = 7 AND page_id % 103 <> 11 AND page_id % 107 <> 13 THEN 'corrupt' ELSE 'missing' END AS status,
       CAST(bytes_before AS BIGINT) AS "offset", bytes, CAST(1 AS BIGINT) AS records
FROM o WHERE page_id % 103 = 11 OR page_id % 101 = 7
UNION ALL
SELECT warc_file, slot, 'extra', NULL, CASE WHEN page_id % 101 = 7 THEN bytes + 1 + strlen(CAST(strlen(coalesce(html, '')) + 1 AS VARCHAR)) - strlen(CAST(strlen(coalesce(html, '')) AS VARCHAR)) ELSE bytes END,
       CASE WHEN page_id % 101 = 7 THEN 2 ELSE 1 END
FROM o WHERE page_id % 107 = 13 AND page_id % 103 <> 11
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_merkle_audit": OP2_SQL, "op8_line_rules": OP8_SQL, "op10_exact_dedup": OP10_SQL}
