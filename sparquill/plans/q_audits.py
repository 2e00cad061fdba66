"""Queries of audits and validators (V) and of the remaining record functions (X)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparquill.functions import metrics as M
from sparquill.functions import text as X
from sparquill.operators import validators as V
from sparquill.operators.sampling import numbered_within
from sparquill.operators.tokens import conversations, role_contract
from sparquill.plans.q_aggregates import _DOCS_SPLIT, _docs_split
from sparquill.plans.q_text import _RULES_SQL, AD_RULES
from sparquill.plans.registry import query
from sparquill.plans.release import CONTEXT, DIMENSIONS, RELEASE, RISK_ROWS, RISKS, release, risk_rules
from sparquill.sources.tables import LINES, RECORDS, lines, records, table


def n():
    return F.count(F.lit(1))


@query("V1_corpus_audit", f"WITH {LINES}, m AS (SELECT doc_id, unnest({_RULES_SQL}) AS rule FROM lines) SELECT rule, count(*) AS n_lines, count(DISTINCT doc_id) AS n_docs FROM m GROUP BY rule")
def v1(spark: SparkSession, sf: str) -> DataFrame:
    m = lines(spark, sf).select("doc_id", F.explode(X.matched_rules("line", AD_RULES)).alias("rule"))
    return m.groupBy("rule", "doc_id").agg(n().alias("k")).groupBy("rule").agg(F.sum("k").alias("n_lines"), n().alias("n_docs"))


_FLAGS = "list_filter([CASE WHEN contains(answer, '%%%') THEN 'symbols' END, CASE WHEN length(answer) < 60 THEN 'short' END, CASE WHEN contains(answer, '!!') THEN 'shout' END, CASE WHEN contains(answer, 'idiot') THEN 'insult' END], lambda x: x IS NOT NULL)"


@query("V4_risk_queue", f"WITH {RECORDS} SELECT id, flags, CASE WHEN list_has_any(flags, ['insult']) THEN 'P0' WHEN list_has_any(flags, ['symbols', 'shout']) THEN 'P1' ELSE 'P2' END AS priority FROM (SELECT id, {_FLAGS} AS flags FROM rec) WHERE len(flags) > 0")
def v4(spark: SparkSession, sf: str) -> DataFrame:
    a = F.col("answer")
    flags = F.filter(F.array(F.when(a.contains("%%%"), "symbols"), F.when(F.length(a) < 60, "short"), F.when(a.contains("!!"), "shout"), F.when(a.contains("idiot"), "insult")), lambda x: x.isNotNull())
    r = records(spark, sf).select("id", flags.alias("flags")).where(F.size("flags") > 0)
    has = lambda *x: F.arrays_overlap("flags", F.array(*map(F.lit, x)))
    return r.withColumn("priority", F.when(has("insult"), "P0").when(has("symbols", "shout"), "P1").otherwise("P2"))


@query("V5_review_status", f"WITH {RECORDS} SELECT split, CASE WHEN id % 7 = 0 THEN 'rejected' WHEN id % 3 = 0 THEN 'approved' ELSE 'pending' END AS status, count(*) AS n FROM rec GROUP BY ALL")
def v5(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("id") % 7 == 0, "rejected").when(F.col("id") % 3 == 0, "approved").otherwise("pending")
    return records(spark, sf).groupBy("split", status.alias("status")).agg(n().alias("n"))


@query("V6_gap_to_target", f"WITH {RECORDS}, t(family, target) AS (VALUES ('qa', 60), ('chat', 30), ('summary', 45)) SELECT family, target, count(id) AS n, target - count(id) AS gap FROM t LEFT JOIN rec USING (family) GROUP BY family, target")
def v6(spark: SparkSession, sf: str) -> DataFrame:
    t = F.broadcast(spark.createDataFrame([("qa", 60), ("chat", 30), ("summary", 45)], "family string, target int"))
    have = records(spark, sf).groupBy("family").agg(n().alias("n"))
    return t.join(have, "family", "left").select("family", "target", F.coalesce("n", F.lit(0)).alias("n"), (F.col("target") - F.coalesce("n", F.lit(0))).alias("gap"))


@query("V8_role_contract", "WITH c AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations WHERE role <> 'system') SELECT conv_id, count(*) % 2 = 0 AND bool_and(role = CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END AND trim(text, ' ') <> '') AS valid FROM c GROUP BY conv_id")
def v8(spark: SparkSession, sf: str) -> DataFrame:
    return conversations(table(spark, sf, "conversations")).select("conv_id", role_contract(F.col("messages")).alias("valid"))


@query("V10_decisions", f"WITH {RECORDS}, d AS (SELECT id, CASE id % 3 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' ELSE 'edit' END AS decision, CASE WHEN id % 2 = 0 THEN 'why' ELSE '' END AS notes, sha256(answer) AS pinned, sha256(CASE WHEN id % 11 = 0 THEN answer || '.' ELSE answer END) AS digest FROM rec) SELECT id, CASE WHEN pinned <> digest THEN 'stale' WHEN decision = 'reject' AND notes = '' THEN 'reason_missing' WHEN decision = 'edit' THEN 'modified' ELSE decision END AS state FROM d")
def v10(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("id")
    d = records(spark, sf).select("id", F.when(i % 3 == 0, "approve").when(i % 3 == 1, "reject").otherwise("edit").alias("decision"), F.when(i % 2 == 0, "why").otherwise("").alias("notes"), F.sha2("answer", 256).alias("pinned"), F.sha2(F.when(i % 11 == 0, F.concat("answer", F.lit("."))).otherwise(F.col("answer")), 256).alias("digest"))
    return d.select("id", F.when(F.col("pinned") != F.col("digest"), "stale").when((F.col("decision") == "reject") & (F.col("notes") == ""), "reason_missing").when(F.col("decision") == "edit", "modified").otherwise(F.col("decision")).alias("state"))


@query("V12_comparison", "WITH m AS (SELECT l_returnflag AS f, l_linestatus AS s, avg(l_tax) AS v FROM lineitem GROUP BY ALL) SELECT f, max(v) FILTER (WHERE s = 'F') AS before, max(v) FILTER (WHERE s = 'O') AS after, max(v) FILTER (WHERE s = 'O') - max(v) FILTER (WHERE s = 'F') AS delta FROM m GROUP BY f")
def v12(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("f")).pivot("l_linestatus", ["F", "O"]).agg(F.avg("l_tax"))
    return p.toDF("f", "before", "after").withColumn("delta", F.col("after") - F.col("before"))


@query("X2_key_fallback", f"WITH {RECORDS} SELECT id, coalesce(nullif(CASE WHEN id % 2 = 0 THEN fact_id ELSE '' END, ''), nullif(CASE WHEN id % 5 = 0 THEN topic_id END, ''), 'unknown') AS key FROM rec")
def x2(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("id")
    return records(spark, sf).select("id", F.coalesce(F.nullif(F.when(i % 2 == 0, F.col("fact_id")).otherwise(""), F.lit("")), F.nullif(F.when(i % 5 == 0, F.col("topic_id")), F.lit("")), F.lit("unknown")).alias("key"))


@query("X3_combined_text", "SELECT conv_id, sha256(string_agg(text, chr(10) ORDER BY turn)) AS combined FROM conversations WHERE role <> 'system' GROUP BY conv_id")
def x3(spark: SparkSession, sf: str) -> DataFrame:
    return conversations(table(spark, sf, "conversations")).select("conv_id", F.sha2(F.array_join(F.transform("messages", lambda m: m["text"]), "\n"), 256).alias("combined"))


@query("X4_polymorphic", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def x4(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.try_variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))


@query("X5_identity", "SELECT doc_id, substr(sha256('id|' || doc_id), 1, 12) AS fingerprint, round_even(n_chars / 7919, 8) AS share FROM documents")
def x5(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.substring(F.sha2(F.concat(F.lit("id|"), F.col("doc_id").cast("string")), 256), 1, 12).alias("fingerprint"), F.bround(F.col("n_chars") / 7919, 8).alias("share"))


@query("X6_cloze_builder", f"WITH {RECORDS}, w AS (SELECT id, question, regexp_extract(substr(question, 17), '[a-z]{{6,}}', 0) AS e FROM rec) SELECT id, e, right(left(question, strpos(question, e) - 1), 128) AS prefix FROM w WHERE e <> '' AND (length(question) - length(replace(question, e, ''))) // length(e) = 1 AND strpos(question, e) > 16")
def x6(spark: SparkSession, sf: str) -> DataFrame:
    w = records(spark, sf).select("id", "question", F.regexp_extract(F.expr("substr(question, 17)"), "[a-z]{6,}", 0).alias("e")).where("e <> ''")
    once = w.where((X.occurrences("question", F.col("e")) == 1) & (F.expr("instr(question, e)") > 16))
    return once.select("id", "e", F.expr("right(left(question, instr(question, e) - 1), 128)").alias("prefix"))


@query("X8_wrong_option", f"WITH {RECORDS} SELECT id, ['chat', 'qa', 'refusal', 'rewrite', 'summary'][(list_position(['chat', 'qa', 'refusal', 'rewrite', 'summary'], family) + ('0x' || substr(sha256(id::VARCHAR), 1, 8))::BIGINT % 4) % 5 + 1] AS wrong, split || '-' || lpad((row_number() OVER (PARTITION BY split ORDER BY id))::VARCHAR, 5, '0') AS running_id FROM rec")
def x8(spark: SparkSession, sf: str) -> DataFrame:
    options = F.array(*map(F.lit, ["chat", "qa", "refusal", "rewrite", "summary"]))
    at = (F.array_position(options, F.col("family")) + X.bucket(F.sha2(F.col("id").cast("string"), 256), 4)) % 5
    r = numbered_within(records(spark, sf).select("id", "family", "split"), ["split"], [F.col("id")])
    return r.select("id", F.get(options, at.cast("int")).alias("wrong"), F.concat("split", F.lit("-"), F.lpad((F.col("k") + 1).cast("string"), 5, "0")).alias("running_id"))


@query("X9_seed_explode", "SELECT * FROM (VALUES ('hello', 0, 'hi'), ('hello', 1, 'hey'), ('bye', 0, 'see you')) t(intent, k, question)")
def x9(spark: SparkSession, sf: str) -> DataFrame:
    seeds = spark.createDataFrame([("hello", ["hi", "hey"]), ("bye", ["see you"])], "intent string, questions array<string>")
    return seeds.select("intent", F.posexplode("questions").alias("k", "question"))


@query("X11_bundles", f"WITH {LINES} SELECT doc_id, sha256(string_agg('[' || line_no || '] ' || line, chr(10) ORDER BY line_no)) AS bundle FROM lines WHERE line_no <= 3 GROUP BY doc_id")
def x11(spark: SparkSession, sf: str) -> DataFrame:
    g = lines(spark, sf).where("line_no <= 3").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("c"))
    return g.select("doc_id", F.sha2(F.array_join(F.transform("c", lambda r, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), r["line"])), "\n"), 256).alias("bundle"))


@query("X14_flag_changes", f"WITH {RECORDS} SELECT id, list_sort(list_distinct(list_concat(list_filter([family, split], lambda x: x <> 'train'), ['checked']))) AS flags FROM rec")
def x14(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).select("id", F.array_sort(F.array_union(F.array_remove(F.array("family", "split"), F.lit("train")), F.array(F.lit("checked")))).alias("flags"))


@query("X16_body", f"WITH {LINES} SELECT doc_id, count(*) AS n_lines FROM lines WHERE line_no > 1 AND length(line) > 24 GROUP BY doc_id")
def x16(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).where((F.col("line_no") > 1) & (F.length("line") > 24)).groupBy("doc_id").agg(n().alias("n_lines"))


@query("X18_overrides", f"WITH {RECORDS} SELECT id, coalesce(CASE WHEN id % 4 = 0 THEN 0.2 END, 0.8)::DOUBLE AS temperature, coalesce(CASE WHEN id % 3 = 0 THEN 64 END, 128) AS max_tokens FROM rec")
def x18(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("id")
    return records(spark, sf).select("id", F.coalesce(F.when(i % 4 == 0, 0.2), F.lit(0.8)).alias("temperature"), F.coalesce(F.when(i % 3 == 0, 64), F.lit(128)).alias("max_tokens"))


@query("X20_lineage", "WITH a AS (SELECT source, count(*) AS n FROM documents GROUP BY source), b AS (SELECT source, count(*) + CASE WHEN source = 'src3' THEN 1 ELSE 0 END AS n FROM documents WHERE source <> 'src5' GROUP BY source) SELECT count(*) FILTER (WHERE a.n IS DISTINCT FROM b.n) AS mismatches FROM a FULL JOIN b USING (source)")
def x20(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "documents").groupBy("source").agg(n().alias("n"))
    b = a.where("source <> 'src5'").select("source", (F.col("n") + F.when(F.col("source") == "src3", 1).otherwise(0)).alias("m"))
    return a.join(b, "source", "full").agg(F.count_if(~F.col("n").eqNullSafe(F.col("m"))).alias("mismatches"))


@query("X22_guards", "SELECT count(*) FILTER (WHERE NOT isnan(value) AND NOT isinf(value)) AS n_finite, count(*) FILTER (WHERE value / 100 BETWEEN 0 AND 1) AS n_probability FROM events")
def x22(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").agg(F.count_if(M.finite(F.col("value"))).alias("n_finite"), F.count_if(M.probability(F.col("value") / 100)).alias("n_probability"))


@query("X23_topk_hits", "SELECT count(*) AS n FROM (SELECT l_returnflag, rank() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC) AS r FROM lineitem) WHERE r <= 2 AND l_returnflag = 'A'")
def x23(spark: SparkSession, sf: str) -> DataFrame:
    r = F.rank().over(W.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice")))
    return table(spark, sf, "lineitem").select("l_returnflag", r.alias("r")).where("r <= 2 AND l_returnflag = 'A'").agg(n().alias("n"))


@query("X24_candidate_scores", "SELECT l_orderkey, sum(ln(l_tax + 0.01)) AS total, avg(ln(l_tax + 0.01)) AS per_token, round(sum(ln(l_tax + 0.01)) - sum(ln(l_discount + 0.01)), 6) + 0.0 AS lift FROM lineitem GROUP BY l_orderkey")
def x24(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.log(F.col("l_tax") + 0.01), F.log(F.col("l_discount") + 0.01)
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(a).alias("total"), F.avg(a).alias("per_token"), (F.round(F.sum(a) - F.sum(b), 6) + 0.0).alias("lift"))


@query("X25_two_means", "SELECT avg(m) AS mean_of_means, sum(s) / sum(w) AS weighted FROM (SELECT avg(l_tax) AS m, sum(l_tax * l_quantity) AS s, sum(l_quantity) AS w FROM lineitem GROUP BY l_orderkey % 100)")
def x25(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey") % 100).agg(F.avg("l_tax").alias("m"), F.sum(F.col("l_tax") * F.col("l_quantity")).alias("s"), F.sum("l_quantity").alias("w"))
    return b.agg(F.avg("m").alias("mean_of_means"), (F.sum("s") / F.sum("w")).alias("weighted"))


@query("X26_supervised_only", f"WITH {RECORDS} SELECT id, answer FROM rec")
def x26(spark: SparkSession, sf: str) -> DataFrame:
    labels = F.concat(F.array_repeat(F.lit("\x00"), F.length("question")), X.chars("answer"))
    return records(spark, sf).select("id", F.array_join(F.filter(labels, lambda c: c != "\x00"), "").alias("answer"))


@query("X27_coverage", f"WITH {RECORDS} SELECT family, count(DISTINCT id) AS seen, count(*) AS draws FROM (SELECT id, family, unnest(range(id % 3)) FROM rec) GROUP BY family")
def x27(spark: SparkSession, sf: str) -> DataFrame:
    d = records(spark, sf).where("id % 3 > 0").select("id", "family", F.explode(F.sequence(F.lit(1), (F.col("id") % 3).cast("int"))))
    return d.groupBy("family").agg(F.count_distinct("id").alias("seen"), n().alias("draws"))


@query("X28_metric_choice", f"WITH {RECORDS} SELECT id, CASE family WHEN 'qa' THEN length(answer)::DOUBLE ELSE turn::DOUBLE END AS metric FROM rec")
def x28(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).select("id", F.when(F.col("family") == "qa", F.length("answer").cast("double")).otherwise(F.col("turn").cast("double")).alias("metric"))


@query("X29_relative_paths", r"SELECT page_id, regexp_replace(regexp_replace(url, '^https?://[^/]+/', ''), '[?#].*$', '') AS path, NOT regexp_matches(url, '@|\.\.') AS publishable FROM pages")
def x29(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", F.regexp_replace(F.regexp_replace(u, "^https?://[^/]+/", ""), "[?#].*$", "").alias("path"), (~u.rlike(r"@|\.\.")).alias("publishable"))


@query("X31_failures", f"WITH {_DOCS_SPLIT} SELECT 'EMPTY_SPLIT' AS code, v.split AS context, 'Provide more groups.' AS remediation FROM (VALUES ('train'), ('val'), ('test'), ('sealed')) v(split) WHERE v.split NOT IN (SELECT split FROM s)")
def x31(spark: SparkSession, sf: str) -> DataFrame:
    want = spark.createDataFrame([("train",), ("val",), ("test",), ("sealed",)], "split string")
    return want.join(_docs_split(spark, sf).select("split").distinct(), "split", "left_anti").select(F.lit("EMPTY_SPLIT").alias("code"), F.col("split").alias("context"), F.lit("Provide more groups.").alias("remediation"))


def _report(spark: SparkSession, sf: str) -> DataFrame:
    """The release's report: section, name, value."""
    r = release(spark, sf).withColumn("codes", V.risk_codes(risk_rules()))
    keys = {
        "id": F.col("id"), "question": F.col("question"), "canonical_question": X.alnum_lower("question"), "pair": F.concat("question", F.lit("\u241f"), "answer"), "answer": F.col("answer"),
        "topic": F.col("topic_id"), "fact": F.col("fact_id"), "group": F.col("conv_id"), "chapter": F.col("chapter"), "evidence": F.col("evidence_sha256"), "template": F.col("template_id"),
        "opening": X.fingerprint(X.alnum_lower("answer")),
    }
    values = V.value_report(r, keys, F.col("split"))
    tallies = V.counts(r, {"split": F.col("split"), "family": F.col("family"), "dimension": F.col("dimension"), "review": F.col("review"), "mode": F.col("mode")})
    risks = V.counts(r.select(F.explode("codes").alias("code")), {"risk": F.col("code")})
    ok = F.col("evidence_sha256") == F.sha2("evidence", 256)
    sums = V.totals(r, "total", {
        "records": n(), "verified_evidence": F.count_if(ok), "verified_share": F.count_if(ok) / n(), "multi_turn": F.count_if(F.col("n_messages") > 2),
        "unapproved_evaluation": F.count_if((F.col("split") != "train") & (F.col("review") != "approved")), "sequence_tokens": F.sum("sequence"), "supervised_tokens": F.sum("supervised"),
        "longest_sequence": F.max("sequence"), "sequence_p50": F.percentile("sequence", 0.5), "sequence_p95": F.percentile("sequence", 0.95), "answer_p50": F.percentile(F.length("answer"), 0.5),
        "long_answers": F.count_if(F.length("answer").between(400, 1500)), "blank_answers": F.count_if(F.trim("answer") == ""), "negative_grounding": F.count_if((F.col("dimension") == "grounded_multi") & (F.col("mode") == "needs_evidence")),
    })
    per = r.groupBy("triplet_id").agg(F.min("split").alias("low"), F.max("split").alias("high"), F.count_distinct("mode").alias("modes"), F.count_distinct("conv_id").alias("convs"))
    triplets = V.totals(per, "triplets", {"complete": F.count_if((F.col("low") == F.col("high")) & (F.col("modes") == 3) & (F.col("convs") == 3)), "crossing": F.count_if(F.col("low") != F.col("high"))})
    return values.unionByName(tallies).unionByName(risks).unionByName(sums).unionByName(triplets)


_KEYS = {"id": "id", "question": "question", "canonical_question": "regexp_replace(lower(question), '[^\\p{L}\\p{N}]+', '', 'g')", "pair": "question || '\u241f' || answer", "answer": "answer", "topic": "topic_id", "fact": "fact_id", "group": "conv_id", "chapter": "chapter", "evidence": "evidence_sha256", "template": "template_id"}
_REPORT = f"""{RELEASE}, {RISK_ROWS},
kv AS (SELECT unnest([{", ".join(f"'{k}'" for k in _KEYS)}, 'opening']) AS section, unnest([{", ".join(f"({v})::VARCHAR" for v in _KEYS.values())}, OPENING]) AS v, split FROM rel),
each AS (SELECT section, v, count(*) AS n, min(split) AS low, max(split) AS high FROM kv WHERE trim(v, ' ') <> '' GROUP BY ALL),
found AS (SELECT section, count(*) AS a, sum(n - 1) AS b, count(*) FILTER (WHERE n > 1) AS c, max(n) AS d, count(*) FILTER (WHERE low <> high) AS e FROM each GROUP BY section),
ct AS (SELECT unnest(['split', 'family', 'dimension', 'review', 'mode']) AS section, unnest([split, family, dimension, review, mode]) AS name FROM rel),
tot AS (SELECT count(*) AS records, count(*) FILTER (WHERE evidence_sha256 = sha256(evidence)) AS verified, count(*) FILTER (WHERE n_messages > 2) AS multi, count(*) FILTER (WHERE split <> 'train' AND review <> 'approved') AS unapproved,
  sum(sequence) AS seq, sum(supervised) AS sup, max(sequence) AS longest, quantile_cont(sequence, 0.5) AS p50, quantile_cont(sequence, 0.95) AS p95, quantile_cont(length(answer), 0.5) AS a50,
  count(*) FILTER (WHERE length(answer) BETWEEN 400 AND 1500) AS long_answers, count(*) FILTER (WHERE trim(answer, ' ') = '') AS blank, count(*) FILTER (WHERE dimension = 'grounded_multi' AND mode = 'needs_evidence') AS negative FROM rel),
tri AS (SELECT count(*) FILTER (WHERE low = high AND modes = 3 AND convs = 3) AS complete, count(*) FILTER (WHERE low <> high) AS crossing FROM (SELECT triplet_id, min(split) AS low, max(split) AS high, count(DISTINCT mode) AS modes, count(DISTINCT conv_id) AS convs FROM rel GROUP BY triplet_id)),
report AS (SELECT section, unnest(['distinct', 'extra_rows', 'repeated', 'most', 'crossing']) AS name, unnest([a, b, c, d, e])::DOUBLE AS value FROM found
  UNION ALL SELECT section, coalesce(name, 'missing'), count(*)::DOUBLE FROM ct GROUP BY ALL
  UNION ALL SELECT 'risk', code, count(*)::DOUBLE FROM risk GROUP BY code
  UNION ALL SELECT 'total', unnest(['records', 'verified_evidence', 'verified_share', 'multi_turn', 'unapproved_evaluation', 'sequence_tokens', 'supervised_tokens', 'longest_sequence', 'sequence_p50', 'sequence_p95', 'answer_p50', 'long_answers', 'blank_answers', 'negative_grounding']),
    unnest([records::DOUBLE, verified, verified / records, multi, unapproved, seq, sup, longest, p50, p95, a50, long_answers, blank, negative]) FROM tot
  UNION ALL SELECT 'triplets', unnest(['complete', 'crossing']), unnest([complete, crossing])::DOUBLE FROM tri)"""
_REPORT = _REPORT.replace("OPENING", "substr(sha256(left(regexp_replace(lower(answer), '[^\\p{L}\\p{N}]+', '', 'g'), 12)), 1, 16)")


def _gates_sql(spec: list[tuple]) -> str:
    rows = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE" for x in r) + ")" for r in spec)
    return f"SELECT gate, severity, coalesce(value, 0) AS actual, low, high, coalesce(value, 0) BETWEEN low AND high AS passed FROM (VALUES {rows}) g(gate, severity, section, name, low, high) LEFT JOIN report USING (section, name)"


#: The quality gate's nine gates.
GATES = [
    ("record_count", "P0", "total", "records", 500.0, 500.0),
    ("validation_count", "P0", "split", "val", 50.0, 1e9),
    ("family_count", "P0", "family", "refusal", 100.0, 1e9),
    ("minimum_topics", "P0", "topic", "distinct", 100.0, 1e9),
    ("maximum_questions_per_fact", "P0", "fact", "most", 0.0, 8.0),
    ("maximum_identical_answers", "P0", "answer", "most", 0.0, 5.0),
    ("minimum_verified_evidence_share", "P0", "total", "verified_share", 0.7, 1.0),
    ("topic_leakage", "P0", "topic", "crossing", 0.0, 0.0),
    ("evaluation_reviewed", "P0", "total", "unapproved_evaluation", 0.0, 0.0),
]
TARGETS = {"qa": 400, "chat": 300, "rewrite": 300, "summary": 300, "refusal": 400}

#: The release validator's gates: quotas, repeats, leaks over every key, record-level risks, coverage.
RELEASE_GATES = [
    *[(f"quota.split.{s}", "P0", "split", s, lo, 1e9) for s, lo in (("train", 200.0), ("val", 20.0), ("test", 20.0))],
    *[(f"quota.dimension.{d}", "P0", "dimension", d, 50.0, 1e9) for d in sorted(DIMENSIONS.values())],
    *[(f"duplicate_{k}", "P0", k, "extra_rows", 0.0, 0.0) for k in ("id", "question", "canonical_question", "pair")],
    *[(f"{k}_split_leakage", "P0", k, "crossing", 0.0, 0.0) for k in ("question", "canonical_question", "topic", "fact", "group", "chapter", "evidence", "template")],
    ("triplet_split_leakage", "P0", "triplets", "crossing", 0.0, 0.0),
    ("calibration_triplets", "P1", "triplets", "complete", 20.0, 1e9),
    *[(f"risk.{c}", s, "risk", c, 0.0, 0.0) for c, (s, _) in RISKS.items()],
    ("pending_review", "P1", "review", "pending", 0.0, 0.0),
    ("multi_turn_coverage", "P1", "total", "multi_turn", 100.0, 1e9),
    ("negative_grounding", "P1", "total", "negative_grounding", 1.0, 1e9),
    ("answer_opening_repeat", "P1", "opening", "most", 0.0, 20.0),
    ("general_exact_answer_repeat", "P1", "answer", "most", 0.0, 5.0),
    ("longest_sequence", "P0", "total", "longest_sequence", 0.0, float(CONTEXT)),
]


@query("V2_quality_gate", f"WITH {_REPORT} {_gates_sql(GATES)}")
def v2(spark: SparkSession, sf: str) -> DataFrame:
    return V.gated(_report(spark, sf), GATES)


@query("V2_deficits", f"WITH {_REPORT} SELECT name, target, coalesce(value, 0) AS actual, greatest(0, target - coalesce(value, 0)) AS missing FROM (VALUES {', '.join(f"('family', '{k}', {v}::DOUBLE)" for k, v in TARGETS.items())}) t(section, name, target) LEFT JOIN report USING (section, name)")
def v2_deficits(spark: SparkSession, sf: str) -> DataFrame:
    return V.deficits(_report(spark, sf), "family", TARGETS)


@query("V3_readiness", f"WITH {_REPORT} SELECT section, name, round(value, 6) AS value FROM report")
def v3(spark: SparkSession, sf: str) -> DataFrame:
    return _report(spark, sf).withColumn("value", F.round("value", 6))


@query("V3_family_report", f"WITH {RELEASE} SELECT family, count(*) AS records, round(count(*) / sum(count(*)) OVER (), 6) AS share, round(count(DISTINCT question) / count(*), 6) AS unique_question_ratio, round(count(DISTINCT answer) / count(*), 6) AS unique_answer_ratio, quantile_cont(length(answer), 0.5) AS p50, quantile_cont(length(answer), 0.95) AS p95 FROM rel GROUP BY family")
def v3_family(spark: SparkSession, sf: str) -> DataFrame:
    g = release(spark, sf).groupBy("family").agg(n().alias("records"), F.count_distinct("question").alias("q"), F.count_distinct("answer").alias("a"), F.percentile(F.length("answer"), 0.5).alias("p50"), F.percentile(F.length("answer"), 0.95).alias("p95"))
    ratio = lambda c: F.round(F.col(c) / F.col("records"), 6)
    return g.select("family", "records", F.round(F.col("records") / F.sum("records").over(W.partitionBy(F.lit(0))), 6).alias("share"), ratio("q").alias("unique_question_ratio"), ratio("a").alias("unique_answer_ratio"), "p50", "p95")


@query("V7_semantic_density", f"WITH {RELEASE}, g AS (SELECT split, dimension, count(*) AS records, sum(supervised)::DOUBLE AS tokens, count(DISTINCT fact_id) AS facts, count(DISTINCT template_id) AS templates, count(*) FILTER (WHERE contains(answer, evidence)) AS copied FROM rel GROUP BY split, dimension) SELECT split, dimension, records, facts, templates, copied, round(records / sum(records) OVER (PARTITION BY split), 8) AS record_share, round(tokens / sum(tokens) OVER (PARTITION BY split), 8) AS token_share, round((tokens / sum(tokens) OVER (PARTITION BY split)) / (records / sum(records) OVER (PARTITION BY split)), 6) AS density FROM g")
def v7(spark: SparkSession, sf: str) -> DataFrame:
    g = release(spark, sf).groupBy("split", "dimension").agg(n().alias("records"), F.sum("supervised").cast("double").alias("tokens"), F.count_distinct("fact_id").alias("facts"), F.count_distinct("template_id").alias("templates"), F.count_if(F.contains("answer", "evidence")).alias("copied"))
    own = W.partitionBy("split")  # few rows: splits times dimensions
    records_share, token_share = F.col("records") / F.sum("records").over(own), F.col("tokens") / F.sum("tokens").over(own)
    return g.select("split", "dimension", "records", "facts", "templates", "copied", F.round(records_share, 8).alias("record_share"), F.round(token_share, 8).alias("token_share"), F.round(token_share / records_share, 6).alias("density"))


@query("V8_release_gates", f"WITH {_REPORT} {_gates_sql(RELEASE_GATES)}")
def v8_release(spark: SparkSession, sf: str) -> DataFrame:
    return V.gated(_report(spark, sf), RELEASE_GATES)


@query("V8_status", f"WITH {_REPORT}, g AS ({_gates_sql(RELEASE_GATES)}) SELECT CASE WHEN bool_and(passed) THEN 'passed' ELSE 'needs_revision' END AS status, list_sort(list(gate) FILTER (WHERE NOT passed AND severity = 'P0')) AS p0_failures, list_sort(list(gate) FILTER (WHERE NOT passed AND severity = 'P1')) AS p1_failures FROM g")
def v8_status(spark: SparkSession, sf: str) -> DataFrame:
    failed = lambda s: F.sort_array(F.collect_list(F.when(~F.col("passed") & (F.col("severity") == s), F.col("gate"))))
    return v8_release(spark, sf).agg(F.when(F.every("passed"), "passed").otherwise("needs_revision").alias("status"), failed("P0").alias("p0_failures"), failed("P1").alias("p1_failures"))


@query("V9_risk_records", f"WITH {RELEASE}, {RISK_ROWS} SELECT id, split, family, code, severity FROM risk")
def v9(spark: SparkSession, sf: str) -> DataFrame:
    r = release(spark, sf).select("id", "split", "family", F.explode(V.risk_codes(risk_rules())).alias("code"))
    severity = F.create_map(*[F.lit(x) for code, (s, _) in RISKS.items() for x in (code, s)])
    return r.withColumn("severity", severity[F.col("code")])


@query("V11_evidence_share", f"WITH {RELEASE}, c AS (SELECT doc_id AS chapter, line FROM lines), u AS (SELECT DISTINCT chapter, line FROM c) SELECT r.split, count(*) AS records, count(*) FILTER (WHERE u.line IS NOT NULL AND r.evidence_sha256 = sha256(r.evidence)) AS resolved, round(count(*) FILTER (WHERE u.line IS NOT NULL AND r.evidence_sha256 = sha256(r.evidence)) / count(*), 6) AS share FROM rel r LEFT JOIN u ON u.chapter = r.chapter AND u.line = r.evidence GROUP BY r.split")
def v11(spark: SparkSession, sf: str) -> DataFrame:
    """Each record's evidence is looked up again, by its text, among the lines of its chapter; digests must agree too."""
    r = release(spark, sf)
    there = lines(spark, sf).select(F.col("doc_id").alias("chapter"), F.col("line").alias("evidence"), F.lit(True).alias("found")).distinct()
    ok = F.coalesce(F.col("found"), F.lit(False)) & (F.col("evidence_sha256") == F.sha2("evidence", 256))
    g = r.join(there, ["chapter", "evidence"], "left").groupBy("split").agg(n().alias("records"), F.count_if(ok).alias("resolved"))
    return g.withColumn("share", F.round(F.col("resolved") / F.col("records"), 6))


_RULE_TEXTS = ", ".join(f"CASE WHEN regexp_matches(line, '{p}') THEN '{k}.' || CASE WHEN trim(regexp_replace(line, '{p}', '', 'g'), ' ') = '' THEN 'whole' ELSE 'embedded' END END" for k, p in AD_RULES.items())


@query("V1_audit_report", f"""WITH {LINES}, m AS (SELECT doc_id, unnest(list_filter([{_RULE_TEXTS}], lambda x: x IS NOT NULL)) AS name FROM lines),
h AS (SELECT doc_id, line, count(*) AS k FROM lines WHERE length(line) BETWEEN 1 AND 40 GROUP BY doc_id, line), t AS (SELECT count(*) AS a, count(*) FILTER (WHERE trim(line, ' ') = '') AS b, count(DISTINCT doc_id) AS c, max(length(line)) AS d FROM lines)
SELECT 'rule' AS section, name, count(*)::BIGINT AS value FROM m GROUP BY name UNION ALL SELECT 'headings', unnest(['short_lines', 'repeated', 'extra']), unnest([count(*), count(*) FILTER (WHERE k > 1), coalesce(sum(k - 1), 0)])::BIGINT FROM h
UNION ALL SELECT 'lines', unnest(['all', 'blank', 'documents', 'longest']), unnest([a, b, c, d])::BIGINT FROM t""")
def v1_report(spark: SparkSession, sf: str) -> DataFrame:
    """Rules by whole-line and embedded matches, repeated headings, sizes."""
    l = lines(spark, sf)
    kinds = [F.when(F.col("line").rlike(p), F.concat(F.lit(k + "."), F.when(F.trim(F.regexp_replace("line", p, "")) == "", "whole").otherwise("embedded"))) for k, p in AD_RULES.items()]
    rules = l.select(F.explode(F.filter(F.array(*kinds), lambda x: x.isNotNull())).alias("name")).groupBy("name").agg(n().cast("double").alias("value")).select(F.lit("rule").alias("section"), "name", "value")
    h = l.where(F.length("line").between(1, 40)).groupBy("doc_id", "line").agg(n().alias("k"))
    heads = V.totals(h, "headings", {"short_lines": n(), "repeated": F.count_if(F.col("k") > 1), "extra": F.coalesce(F.sum(F.col("k") - 1), F.lit(0))})
    sizes = V.totals(l, "lines", {"all": n(), "blank": F.count_if(F.trim("line") == ""), "documents": F.count_distinct("doc_id"), "longest": F.max(F.length("line"))})
    return rules.unionByName(heads).unionByName(sizes).withColumn("value", F.col("value").cast("long"))


@query("V4_release_queue", f"WITH {RELEASE}, {RISK_ROWS} SELECT id, split, list_sort(list(code)) AS flags, min(severity) AS priority FROM risk GROUP BY id, split")
def v4_release(spark: SparkSession, sf: str) -> DataFrame:
    """Records to look at with their flags; a record's priority is that of its gravest flag."""
    severity = F.create_map(*[F.lit(x) for code, (s, _) in RISKS.items() for x in (code, s)])
    r = release(spark, sf).select("id", "split", F.sort_array(V.risk_codes(risk_rules())).alias("flags")).where(F.size("flags") > 0)
    return r.withColumn("priority", F.array_min(F.transform("flags", lambda c: severity[c])))


@query("V5_review_summary", f"WITH {RELEASE}, {RISK_ROWS}, g AS (SELECT id, min(severity) AS priority FROM risk GROUP BY id) SELECT split, review, coalesce(priority, 'clean') AS priority, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY split), 6) AS share FROM rel LEFT JOIN g USING (id) GROUP BY split, review, coalesce(priority, 'clean')")
def v5_summary(spark: SparkSession, sf: str) -> DataFrame:
    """What reviewers have done and what is left for them: by split, decision and the gravest flag."""
    severity = F.create_map(*[F.lit(x) for code, (s, _) in RISKS.items() for x in (code, s)])
    priority = F.coalesce(F.array_min(F.transform(V.risk_codes(risk_rules()), lambda c: severity[c])), F.lit("clean"))
    g = release(spark, sf).groupBy("split", "review", priority.alias("priority")).agg(n().alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("split")), 6))


_GOALS = [(d, s, t) for d, t in (("capability_boundary", 60), ("expression", 50), ("grounded_multi", 70), ("natural_chat", 40), ("parametric_core", 80), ("unheard_of", 5)) for s, t in (("train", t), ("val", max(1, t // 8)))]


@query("V6_gap_report", f"WITH {RELEASE}, t(dimension, split, target) AS (VALUES {', '.join(f"('{d}', '{s}', {t})" for d, s, t in _GOALS)}), c AS (SELECT dimension, split, count(*) AS n, count(*) FILTER (WHERE review = 'approved') AS approved, count(DISTINCT fact_id) AS facts FROM rel GROUP BY dimension, split) SELECT dimension, split, target, coalesce(n, 0) AS n, coalesce(approved, 0) AS approved, coalesce(facts, 0) AS facts, greatest(0, target - coalesce(n, 0)) AS missing, round(coalesce(n, 0) / target, 6) AS fulfilled FROM t LEFT JOIN c USING (dimension, split)")
def v6_report(spark: SparkSession, sf: str) -> DataFrame:
    """Targets by dimension and split against what there is, what is approved of it, and how many facts it covers."""
    t = F.broadcast(spark.createDataFrame(_GOALS, "dimension string, split string, target int"))
    c = release(spark, sf).groupBy("dimension", "split").agg(n().alias("n"), F.count_if(F.col("review") == "approved").alias("approved"), F.count_distinct("fact_id").alias("facts"))
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    g = t.join(c, ["dimension", "split"], "left").select("dimension", "split", "target", zero("n"), zero("approved"), zero("facts"))
    return g.withColumn("missing", F.greatest(F.lit(0), F.col("target") - F.col("n"))).withColumn("fulfilled", F.round(F.col("n") / F.col("target"), 6))


@query("V12_checkpoints", "WITH m AS (SELECT user_id % 10 AS cohort, event_type AS checkpoint, avg(value) AS v, count(*) AS k FROM events GROUP BY ALL), f AS (SELECT cohort, v AS base FROM (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY checkpoint) AS r FROM m) WHERE r = 1) SELECT m.cohort, checkpoint, k AS n, round(v, 6) AS score, round(v - base, 6) AS delta, round((v - base) / base, 6) AS relative, v > base AS improved FROM m JOIN f ON f.cohort = m.cohort")
def v12_checkpoints(spark: SparkSession, sf: str) -> DataFrame:
    """Each checkpoint's score by cohort against the first checkpoint's: difference, relative difference, improved or not."""
    m = table(spark, sf, "events").groupBy((F.col("user_id") % 10).alias("cohort"), F.col("event_type").alias("checkpoint")).agg(F.avg("value").alias("v"), n().alias("n"))
    # The means are computed once: sums of a second run may differ in their last bits, and a base from its own mean.
    d = F.col("v") - F.col("base")
    return m.withColumn("base", F.first("v").over(W.partitionBy("cohort").orderBy(F.asc_nulls_last("checkpoint")))).select("cohort", "checkpoint", "n", F.round("v", 6).alias("score"), F.round(d, 6).alias("delta"), F.round(d / F.col("base"), 6).alias("relative"), (d > 0).alias("improved"))
