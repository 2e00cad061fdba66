"""One query for each operator, over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparquill.llm.bpe_stream import round_trip
from sparquill.llm.exact_dedup import exact_groups
from sparquill.llm.licenses import scan, sql
from sparquill.llm.packing import pack_documents
from sparquill.llm.quality_classifier import quality_classifier
from sparquill.llm.quality_rules import quality_rules
from sparquill.llm.simhash import near_groups
from sparquill.llm.substring_dedup import substring_dedup
from sparquill.llm.suffix_dedup import suffix_dedup
from sparquill.llm.toxicity import toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_table(spark, sf_dir, "documents"), texts=False)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(_table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(_table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents"), texts=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_license_scan": op3_license_scan,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_toxicity": op5_toxicity,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_bpe_round_trip": op9_bpe_round_trip,
    "op10_substring_dedup": op10_substring_dedup,
}

SQL: dict[str, str] = {
    "op3_license_scan": sql(),
    "op7_exact_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS b FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY b) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(b) AS text_sha256
FROM d WINDOW w AS (PARTITION BY b ORDER BY length(t) DESC, doc_id)
""",
    "op8_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '-') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM (SELECT r, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d)),
v AS (SELECT r, i, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) AS v, lead(w, 4) OVER o IS NOT NULL AS full_window FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, v) > 1 AS twice FROM v WHERE full_window),
cov AS (SELECT w.r, w.i, max(CASE WHEN t.twice THEN w.i END) OVER (PARTITION BY w.r ORDER BY w.i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c FROM w LEFT JOIN twice t ON t.r = w.r AND t.i = w.i),
words AS (SELECT r, count(*) AS n_words, count(c) AS n_repeat_words FROM cov GROUP BY r),
ln AS (SELECT r, host, unnest(string_split(t, chr(10))) AS x FROM d),
l AS (SELECT r, host, x, trim(regexp_replace(regexp_replace(lower(x), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS y, len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda z: z <> '')) AS n FROM ln WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT x) AS n_dup_lines FROM l GROUP BY r),
hosts AS (SELECT host, count(*) AS host_docs FROM d GROUP BY host),
common AS (SELECT host, y FROM l JOIN hosts USING (host) GROUP BY host, y, host_docs HAVING count(DISTINCT r) > 20 AND count(DISTINCT r) > host_docs * 0.01),
gone AS (SELECT r, sum(n)::BIGINT AS removed_words FROM l JOIN common USING (host, y) GROUP BY r),
f AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed_words, 0) AS removed_words FROM d LEFT JOIN words USING (r) LEFT JOIN dup USING (r) LEFT JOIN gone USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR n_repeat_words * 100 > n_words * 20 AS base_failed,
       NOT (n_words < 10 OR n_repeat_words * 100 > n_words * 20) AND NOT (removed_words > 0 AND (n_words - removed_words < 10 OR n_words - removed_words < n_words * 0.2)) AS kept, removed_words
FROM f
""",
}
