"""A release of question and answer records with their contracts, as the audits see it, made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.functions import text as X
from sparquill.operators.tokens import conversations, role_contract
from sparquill.sources.tables import LINES, RECORDS, lines, records, table

#: Families of records -> dimension of the release.
DIMENSIONS = {"qa": "parametric_core", "chat": "natural_chat", "rewrite": "expression", "summary": "grounded_multi", "refusal": "capability_boundary"}
MODES = ["known_core", "grounded_answer", "needs_evidence"]
STATUS = ["approved", "pending", "rejected"]
CONTEXT = 2048

#: The same release in SQL: a record, its conversation's contract, its evidence (a line of the document of its number,
#: with a digest pinned at making, which is stale for every 13th record) and what a generator declared about it.
RELEASE = f"""{LINES}, {RECORDS},
conv AS (SELECT conv_id, count(*) AS n_messages, count(*) % 2 = 0 AND bool_and(role = CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END AND trim(text, ' ') <> '') AS roles_ok,
  1 + sum(1 + length(text)) + count(*) FILTER (WHERE role = 'assistant') AS sequence, sum(CASE WHEN role = 'assistant' THEN length(text) + 1 ELSE 0 END) AS supervised
  FROM (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations WHERE role <> 'system') GROUP BY conv_id),
rel AS (SELECT rec.*, CASE family WHEN 'qa' THEN 'parametric_core' WHEN 'chat' THEN 'natural_chat' WHEN 'rewrite' THEN 'expression' WHEN 'summary' THEN 'grounded_multi' ELSE 'capability_boundary' END AS dimension,
  'p' || (conv_id % 37) AS template_id, 'x' || (conv_id // 3) AS triplet_id, ['known_core', 'grounded_answer', 'needs_evidence'][conv_id % 3 + 1] AS mode,
  CASE WHEN id % 7 = 0 THEN 'rejected' WHEN id % 3 = 0 THEN 'pending' ELSE 'approved' END AS review, n_messages, roles_ok, sequence::BIGINT AS sequence, supervised::BIGINT AS supervised,
  sequence::BIGINT + CASE WHEN id % 17 = 0 THEN 1 ELSE 0 END AS declared_sequence, e.line AS evidence, e.doc_id AS chapter,
  sha256(e.line || CASE WHEN id % 13 = 0 THEN '.' ELSE '' END) AS evidence_sha256
  FROM rec JOIN conv USING (conv_id) LEFT JOIN (SELECT doc_id, line FROM lines WHERE line_no = 1) e ON e.doc_id = conv_id)"""


def release(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = conversations(table(spark, sf_dir, "conversations"))
    own = lambda m: m["role"] == "assistant"
    size = lambda messages, f: F.aggregate(F.transform(messages, f), F.lit(0).cast("long"), lambda a, x: a + x)
    conv = c.select(
        "conv_id",
        F.size("messages").cast("long").alias("n_messages"),
        role_contract(F.col("messages")).alias("roles_ok"),
        (1 + size(F.col("messages"), lambda m: F.length(m["text"]) + 1 + own(m).cast("int"))).alias("sequence"),
        size(F.col("messages"), lambda m: F.when(own(m), F.length(m["text"]) + 1).otherwise(0)).alias("supervised"),
    )
    first = lines(spark, sf_dir).where("line_no = 1").select("doc_id", F.col("line").alias("evidence"))
    r = records(spark, sf_dir).join(conv, "conv_id").join(first, F.col("conv_id") == F.col("doc_id"), "left")
    i, k = F.col("id"), F.col("conv_id")
    names = F.create_map(*[F.lit(x) for pair in DIMENSIONS.items() for x in pair])
    return r.select(
        *records(spark, sf_dir).columns,
        names[F.col("family")].alias("dimension"),
        F.concat(F.lit("p"), (k % 37).cast("string")).alias("template_id"),
        F.concat(F.lit("x"), F.floor(k / 3).cast("string")).alias("triplet_id"),
        F.element_at(F.array(*map(F.lit, MODES)), (k % 3 + 1).cast("int")).alias("mode"),
        F.when(i % 7 == 0, STATUS[2]).when(i % 3 == 0, STATUS[1]).otherwise(STATUS[0]).alias("review"),
        "n_messages",
        "roles_ok",
        "sequence",
        "supervised",
        (F.col("sequence") + F.when(i % 17 == 0, 1).otherwise(0)).alias("declared_sequence"),
        "evidence",
        F.col("doc_id").alias("chapter"),
        F.sha2(F.concat("evidence", F.when(i % 13 == 0, ".").otherwise("")), 256).alias("evidence_sha256"),
    )


#: Record-level rules: code -> severity, SQL condition; the same in columns below.
RISKS = {
    "invalid_role_alternation": ("P0", "NOT roles_ok"),
    "evidence_missing": ("P1", "evidence IS NULL AND mode <> 'needs_evidence'"),
    "evidence_sha256_mismatch": ("P0", "evidence IS NOT NULL AND evidence_sha256 <> sha256(evidence)"),
    "support_conflicts_with_mode": ("P0", "evidence IS NOT NULL AND mode = 'needs_evidence' AND dimension = 'grounded_multi'"),
    "review_not_approved": ("P1", "review <> 'approved'"),
    "unbalanced_answer_punctuation": ("P0", "length(answer) - length(replace(answer, '(', '')) <> length(answer) - length(replace(answer, ')', ''))"),
    "positive_math": ("P0", "regexp_matches(question, '[0-9]+ *[-+*/=] *[0-9]+') AND dimension <> 'capability_boundary'"),
    "sequence_over_context": ("P0", f"sequence > {CONTEXT}"),
    "encoding_audit_mismatch": ("P0", "declared_sequence <> sequence"),
    "echo": ("P1", "question = answer"),
    "short_question": ("P2", "length(question) < 20"),
}
_CODES = ", ".join(f"CASE WHEN {sql} THEN '{code}' END" for code, (_, sql) in RISKS.items())
_SEVERITY = " ".join(f"WHEN '{code}' THEN '{s}'" for code, (s, _) in RISKS.items())
RISK_ROWS = f"risk AS (SELECT id, split, family, code, CASE code {_SEVERITY} END AS severity FROM (SELECT id, split, family, unnest(list_filter([{_CODES}], lambda x: x IS NOT NULL)) AS code FROM rel))"


def risk_rules() -> dict:
    e, mode, a = F.col("evidence"), F.col("mode"), F.col("answer")
    return {
        "invalid_role_alternation": ~F.col("roles_ok"),
        "evidence_missing": e.isNull() & (mode != "needs_evidence"),
        "evidence_sha256_mismatch": F.col("evidence_sha256") != F.sha2("evidence", 256),
        "support_conflicts_with_mode": e.isNotNull() & (mode == "needs_evidence") & (F.col("dimension") == "grounded_multi"),
        "review_not_approved": F.col("review") != "approved",
        "unbalanced_answer_punctuation": X.occurrences(a, F.lit("(")) != X.occurrences(a, F.lit(")")),
        "positive_math": F.col("question").rlike("[0-9]+ *[-+*/=] *[0-9]+") & (F.col("dimension") != "capability_boundary"),
        "sequence_over_context": F.col("sequence") > CONTEXT,
        "encoding_audit_mismatch": F.col("declared_sequence") != F.col("sequence"),
        "echo": F.col("question") == a,
        "short_question": F.length("question") < 20,
    }
