"""The flagship query: one document of each text, and what each language keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.functions.text import collapse, split_lines
from sparquill.plans.registry import query
from sparquill.sources.tables import table


def kept_documents(docs: DataFrame) -> DataFrame:
    """Documents by the digest of their normalised lines: the best of each group (most characters, then least id).

    One aggregation with a map-side combine; no window, so a text with many copies is no hot partition.
    """
    body = F.array_join(F.filter(F.transform(split_lines("text"), collapse), lambda x: x != ""), "\n")
    marked = docs.select("doc_id", "lang", "n_chars", F.sha2(body, 256).alias("body_sha256"))
    best = F.min(F.struct((-F.col("n_chars")).alias("size"), "doc_id", "lang"))
    return marked.groupBy("body_sha256").agg(best.alias("b"), F.count(F.lit(1)).alias("copies")).select("b.doc_id", "b.lang", (-F.col("b.size")).alias("n_chars"), "body_sha256", "copies")


@query("corpus_keep_best", r"""WITH l AS (SELECT doc_id, lang, n_chars, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[\t ]+', ' ', 'g'), ' ')), lambda x: x <> '') AS ls FROM documents),
h AS (SELECT doc_id, lang, n_chars, sha256(array_to_string(ls, chr(10))) AS s FROM l), k AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY n_chars DESC, doc_id) AS r, count(*) OVER (PARTITION BY s) AS copies FROM h)
SELECT lang, count(*) AS n_kept, sum(copies - 1)::BIGINT AS n_dropped, sum(n_chars)::BIGINT AS n_chars FROM k WHERE r = 1 GROUP BY lang""")
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    kept = kept_documents(table(spark, sf, "documents"))
    return kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n_kept"), F.sum(F.col("copies") - 1).alias("n_dropped"), F.sum("n_chars").alias("n_chars"))
