"""Queries that go through sources (S) and sinks (K): each writes to the shared folder and reads back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.operators.staging import shared_dir
from sparquill.plans.registry import query
from sparquill.sources import io
from sparquill.sources.tables import LINES, RECORDS, lines, records, table


def _place(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@query("S2_line_scan", f"WITH {LINES} SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE trim(line, ' ') = '') AS n_blank FROM lines GROUP BY doc_id")
def s2(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.trim("line") == "").alias("n_blank"))


@query("S3_json_lines", f"WITH {RECORDS} SELECT id, question, answer, split FROM rec")
def s3(spark: SparkSession, sf: str) -> DataFrame:
    path = _place(spark, "jsonl")
    io.write_json_lines(records(spark, sf).select("id", "question", "answer", "split"), path)
    return io.json_lines(spark, path, "id long, question string, answer string, split string")


@query("S4_numbered_json_lines", f"WITH {RECORDS} SELECT count(*) AS n, count(DISTINCT id) AS n_ids, 1 AS first_line FROM rec")
def s4(spark: SparkSession, sf: str) -> DataFrame:
    path = _place(spark, "jsonl")
    io.write_json_lines(records(spark, sf).select("id"), path)
    return io.numbered_json_lines(spark, path, "id long").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_ids"), F.min("line_no").alias("first_line"))


@query("S5_authorised_split", f"WITH {RECORDS} SELECT id FROM rec WHERE split = 'val'")
def s5(spark: SparkSession, sf: str) -> DataFrame:
    return io.authorised_split(records(spark, sf).where("split = 'val'"), "val").select("id")


@query("S6_prefix", f"WITH {RECORDS} SELECT id FROM rec ORDER BY id LIMIT 25")
def s6(spark: SparkSession, sf: str) -> DataFrame:
    return io.prefix(records(spark, sf).select("id"), "id", 25)


@query("S8_csv_history", "SELECT event_id AS step, value AS val_loss FROM events WHERE event_type = 'view'")
def s8(spark: SparkSession, sf: str) -> DataFrame:
    path = _place(spark, "csv")
    io.write_csv(table(spark, sf, "events").where("event_type = 'view'").select(F.col("event_id").alias("step"), F.col("value").alias("val_loss")), path)
    return io.metric_history(spark, path, "step long, val_loss double")


@query("S9_prompts", "SELECT DISTINCT trim(p, ' ') AS prompt FROM (SELECT unnest(string_split(text, chr(10))) AS p FROM benchmark) WHERE trim(p, ' ') <> ''")
def s9(spark: SparkSession, sf: str) -> DataFrame:
    path = _place(spark, "prompts")
    table(spark, sf, "benchmark").select("text").write.text(path)
    return io.prompts(spark, path).distinct()


@query("S11_import_defaults", f"WITH {RECORDS} SELECT id, coalesce(nullif(fact_id, 'f0'), topic_id) AS fact_id, CASE family WHEN 'qa' THEN 'fact' WHEN 'chat' THEN 'talk' ELSE family END AS task_family, 'legacy' AS origin FROM rec")
def s11(spark: SparkSession, sf: str) -> DataFrame:
    m = F.broadcast(spark.createDataFrame([("qa", "fact"), ("chat", "talk")], "family string, task string"))
    return records(spark, sf).join(m, "family", "left").select("id", F.coalesce(F.nullif("fact_id", F.lit("f0")), "topic_id").alias("fact_id"), F.coalesce("task", "family").alias("task_family"), F.lit("legacy").alias("origin"))


@query("K3_release", f"WITH {RECORDS} SELECT 'complete' AS status, split, count(*) AS rows FROM rec GROUP BY split")
def k3(spark: SparkSession, sf: str) -> DataFrame:
    return io.write_release(records(spark, sf), _place(spark, "release"))


@query("K4_blocked_release", "SELECT 'freeze_not_ready' AS status, NULL::VARCHAR AS split, NULL::BIGINT AS rows")
def k4(spark: SparkSession, sf: str) -> DataFrame:
    return io.write_release(records(spark, sf), _place(spark, "release"), ready=False)


@query("K6_verify_artifacts", "SELECT * FROM (VALUES ('a', 'ok'), ('b', 'changed'), ('c', 'missing')) t(name, status)")
def k6(spark: SparkSession, sf: str) -> DataFrame:
    # Names and contents stand in for files; digests() gives the same columns for files under a path.
    want = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "name string, content string").select("name", F.sha2("content", 256).alias("sha256"))
    have = spark.createDataFrame([("a", "x"), ("b", "Y")], "name string, content string").select("name", F.sha2("content", 256).alias("sha256"))
    return io.verified(want, have)


@query("K5_sidecar", "SELECT sha256(source) || '  ' || source AS line FROM (SELECT DISTINCT source FROM documents)")
def k5(spark: SparkSession, sf: str) -> DataFrame:
    return io.sidecar(table(spark, sf, "documents").select(F.col("source").alias("name"), F.sha2("source", 256).alias("sha256")).distinct())


@query("K8_token_arrays", f"WITH {RECORDS} SELECT id, length(answer) AS n_ids FROM rec")
def k8(spark: SparkSession, sf: str) -> DataFrame:
    from sparquill.functions.text import chars

    path = _place(spark, "tokens")
    records(spark, sf).select("id", F.transform(chars("answer"), lambda c: F.ascii(c)).alias("ids")).write.parquet(path)
    return spark.read.schema("id long, ids array<int>").parquet(path).select("id", F.size("ids").cast("long").alias("n_ids"))
