"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.sources.tables import table

from . import bpe, decontaminate, html_extract, langid, lm, minhash, simhash, substring_dedup, suffix_dedup, token_counts

QUERIES = {}
ORACLE_SQL: dict[str, str] = {}


def query(run):
    QUERIES[run.__name__] = run
    return run


@query
def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), nearest=True)


@query
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=400)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), least=decontaminate.THRESHOLD)


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@query
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.digests(table(spark, sf_dir, "documents"))


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


ORACLE_SQL["op3_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT r, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM d),
g AS (SELECT r, i, w, CASE WHEN count(*) OVER f = 20 THEN md5(string_agg(w, ' ') OVER f) END AS h FROM t WINDOW f AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
s AS (SELECT r, i, w, h IS NOT NULL AND row_number() OVER (PARTITION BY h ORDER BY r, i) > 1 AS again FROM g),
c AS (SELECT r, i, w, bool_or(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM s),
k AS (SELECT r, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(w, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM c GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""

# Windows of 400 bytes are named by md5 over five of 80 bytes, those by the bytes themselves; every start is compared, no anchors.
ORACLE_SQL["op2_suffix_dedup"] = r"""
WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r, encode(coalesce(text, '')) AS b FROM documents),
t AS (SELECT r, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM (SELECT r, regexp_extract_all(hex(b), '..') AS x FROM d)),
h4 AS (SELECT r, i, x, x || lead(x) OVER w || lead(x, 2) OVER w || lead(x, 3) OVER w AS h FROM t WINDOW w AS (PARTITION BY r ORDER BY i)),
h16 AS (SELECT r, i, x, h || lead(h, 4) OVER w || lead(h, 8) OVER w || lead(h, 12) OVER w AS h FROM h4 WINDOW w AS (PARTITION BY r ORDER BY i)),
h80 AS (SELECT r, i, x, md5(h || lead(h, 16) OVER w || lead(h, 32) OVER w || lead(h, 48) OVER w || lead(h, 64) OVER w) AS h FROM h16 WINDOW w AS (PARTITION BY r ORDER BY i)),
h400 AS (SELECT r, i, x, md5(h || lead(h, 80) OVER w || lead(h, 160) OVER w || lead(h, 240) OVER w || lead(h, 320) OVER w) AS h FROM h80 WINDOW w AS (PARTITION BY r ORDER BY i)),
s AS (SELECT r, i, x, h IS NOT NULL AND count(*) OVER (PARTITION BY h) > 1 AS again FROM h400),
c AS (SELECT r, i, x, bool_or(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 399 PRECEDING AND CURRENT ROW) AS gone FROM s),
e AS (SELECT r, i, x, gone, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), false) AS begins FROM c),
k AS (SELECT r, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, string_agg(x, '' ORDER BY i) FILTER (NOT gone) AS kept FROM e GROUP BY r)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""
