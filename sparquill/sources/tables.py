"""The driver's tables, and the views of them that the queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparquill.functions.text import BREAKS, bucket, split_lines, stable_hash

FAMILIES = ["qa", "chat", "rewrite", "summary", "refusal"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deals rows of a table with few files over all tasks before work that is heavy for each row."""
    return df.repartition(*keys) if keys else df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_no (from 1), line."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(split_lines("text")).alias("i", "line"))
    return docs.select("doc_id", (F.col("i") + 1).alias("line_no"), "line")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question and answer records: user turns that an assistant turn follows, with the fields of a release."""
    own = W.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("question"), F.lead("text").over(own).alias("answer"), F.lead("role").over(own).alias("next"))
    topic = F.concat(F.lit("t"), F.floor(F.col("conv_id") / 3).cast("string"))
    b = bucket(F.sha2(topic, 256))
    return turns.where("role = 'user' AND next = 'assistant'").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "turn", "question", "answer",
        F.element_at(F.array(*map(F.lit, FAMILIES)), (F.col("conv_id") % 5 + 1).cast("int")).alias("family"),
        topic.alias("topic_id"), F.concat(F.lit("f"), F.floor(F.col("conv_id") / 2).cast("string")).alias("fact_id"),
        F.when(b < 80, "train").when(b < 90, "val").otherwise("test").alias("split"),
    )


LINES = f"""lines AS (SELECT doc_id, generate_subscripts(x, 1) AS line_no, unnest(x) AS line FROM (SELECT doc_id, CASE WHEN x[-1] = '' THEN x[:-2] ELSE x END AS x FROM (SELECT doc_id, string_split_regex(text, '{BREAKS}') AS x FROM documents)))"""
RECORDS = """rec AS (SELECT conv_id * 1000 + turn AS id, conv_id, turn, question, answer, ['qa', 'chat', 'rewrite', 'summary', 'refusal'][conv_id % 5 + 1] AS family,
  't' || (conv_id // 3) AS topic_id, 'f' || (conv_id // 2) AS fact_id,
  CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'val' ELSE 'test' END AS split
FROM (SELECT conv_id, turn, role, text AS question, lead(text) OVER o AS answer, lead(role) OVER o AS next, ('0x' || substr(sha256('t' || (conv_id // 3)), 1, 8))::BIGINT % 100 AS b
      FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next = 'assistant')"""
__all__ = ["FAMILIES", "LINES", "RECORDS", "lines", "records", "spread", "stable_hash", "table"]
