"""Queries of scalar transforms (P) and predicates (F)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.functions import text as X
from sparquill.functions.metrics import bits_per_character, degradation, warmup_cosine
from sparquill.operators.sampling import numbered_within
from sparquill.plans.registry import query
from sparquill.sources.tables import FAMILIES, LINES, RECORDS, lines, records, spread, table

WS, CONTROLS = X.WS, X.CONTROLS


def _values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


@query("P1_newlines", r"""SELECT doc_id, (length(text) - length(replace(text, chr(13), '')))::BIGINT AS n_cr, (length(text) - length(replace(text, chr(0), '')))::BIGINT AS n_nul,
 sha256(replace(regexp_replace(text, '\r\n|\r', chr(10), 'g'), chr(0), '')) AS clean_sha256 FROM documents""")
def p1(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", X.occurrences("text", "\r").alias("n_cr"), X.occurrences("text", "\0").alias("n_nul"), F.sha2(F.regexp_replace(X.newlines("text"), "\0", ""), 256).alias("clean_sha256"))


@query("P2_control_histogram", f"""SELECT code_point, count(*) AS n FROM (SELECT 'U+' || upper(lpad(to_hex(unicode(c)), 4, '0')) AS code_point FROM (SELECT unnest(regexp_extract_all(text || chr(127) || chr(8), '{CONTROLS}')) AS c FROM documents)) GROUP BY code_point""")
def p2(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all(F.concat("text", F.lit("\x7f\x08")), F.lit(f"({CONTROLS})"))).alias("c"))
    return d.groupBy(F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii("c")), 4, "0")).alias("code_point")).agg(F.count(F.lit(1)).alias("n"))


@query("P3_collapse", f"""SELECT doc_id, sha256(trim(regexp_replace(text, '{WS}+', ' ', 'g'), ' ')) AS collapsed, length(regexp_replace(text, '{WS}+', '', 'g'))::BIGINT AS n_compact FROM documents""")
def p3(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2(X.collapse("text"), 256).alias("collapsed"), F.length(X.compact("text")).cast("long").alias("n_compact"))


@query("P4_positions", rf"""WITH {LINES}, c AS (SELECT doc_id, line_no, generate_subscripts(x, 1) AS pos, unnest(x) AS ch FROM (SELECT doc_id, line_no, string_split(line, '') AS x FROM lines))
SELECT doc_id, line_no, coalesce(string_agg(ch, '' ORDER BY pos), '') AS compact_line, coalesce(list(pos - 1 ORDER BY pos), []) AS positions FROM c WHERE NOT regexp_matches(ch, '{WS}') AND ch <> '' GROUP BY doc_id, line_no""")
def p4(spark: SparkSession, sf: str) -> DataFrame:
    placed = F.filter(F.transform(X.chars("line"), lambda c, i: F.struct(c.alias("c"), i.cast("long").alias("i"))), lambda s: ~s["c"].rlike(WS))
    kept = lines(spark, sf).select("doc_id", "line_no", placed.alias("p")).where(F.size("p") > 0)
    return kept.select("doc_id", "line_no", F.array_join(F.transform("p", lambda s: s["c"]), "").alias("compact_line"), F.transform("p", lambda s: s["i"]).alias("positions"))


NUMERALS = ["二百四十二", "十七", "一千零五", "三万零二", "12", "百", "两千", "三四五", "abc", "二〇二四", "一万二千"]


@query("P5_numerals", "SELECT * FROM (VALUES ('二百四十二', 242::BIGINT, 242::BIGINT), ('十七', 17, 17), ('一千零五', 1005, 1005), ('三万零二', 30002, 30002), ('12', 12, 12), ('百', 100, 100), ('两千', 2000, 2000), ('三四五', 5, 345), ('abc', 0, NULL), ('二〇二四', 4, 2024), ('一万二千', 12000, 12000)) t(numeral, loose, strict)")
def p5(spark: SparkSession, sf: str) -> DataFrame:
    return _values(spark, [(n,) for n in NUMERALS], "numeral string").select("numeral", X.chinese_number("numeral").alias("loose"), X.strict_chinese_number("numeral").alias("strict"))


@query("P6_headings", f"""WITH {LINES} SELECT doc_id, line_no, regexp_replace(regexp_replace(regexp_replace(line, '^{WS}+|{WS}+$', '', 'g'), '^The ', ''), '{WS}+', '', 'g') AS heading FROM lines WHERE length(line) BETWEEN 1 AND 40""")
def p6(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).where(F.length("line").between(1, 40)).select("doc_id", "line_no", X.compact(F.regexp_replace(X.strip("line"), "^The ", "")).alias("heading"))


@query("P7_numbers", r"""SELECT doc_id, nullif(regexp_extract(text, '[0-9]+', 0), '') AS first_number, regexp_extract_all(text, '[0-9]+') AS numbers FROM documents""")
def p7(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.nullif(F.regexp_extract("text", "[0-9]+", 0), F.lit("")).alias("first_number"), F.regexp_extract_all("text", F.lit("([0-9]+)")).alias("numbers"))


@query("P8_rebase", r"""WITH r AS (SELECT conv_id, turn, '第' || conv_id || '章 ' || text || ' 第' || (conv_id + 1) || '章' AS t FROM conversations)
SELECT conv_id, turn, sha256(replace(t, '第' || conv_id || '章', '第1章')) AS rebased FROM r""")
def p8(spark: SparkSession, sf: str) -> DataFrame:
    mark = lambda n: F.concat(F.lit("第"), n.cast("string"), F.lit("章"))
    t = F.concat(mark(F.col("conv_id")), F.lit(" "), "text", F.lit(" "), mark(F.col("conv_id") + 1))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.sha2(F.replace(t, mark(F.col("conv_id")), F.lit("第1章")), 256).alias("rebased"))


@query("P9_repair_map", f"""WITH {LINES}, fix(bad, good) AS (VALUES ('As.', 'Chapter as.'), ('The.', 'Chapter the.'), ('Es be.', 'Chapter es be.'))
SELECT doc_id, line_no, coalesce(good, line) AS line, good IS NOT NULL AS repaired FROM lines LEFT JOIN fix ON line = bad""")
def p9(spark: SparkSession, sf: str) -> DataFrame:
    fix = F.broadcast(_values(spark, [("As.", "Chapter as."), ("The.", "Chapter the."), ("Es be.", "Chapter es be.")], "bad string, good string"))
    return lines(spark, sf).join(fix, F.col("line") == F.col("bad"), "left").select("doc_id", "line_no", F.coalesce("good", "line").alias("line"), F.col("good").isNotNull().alias("repaired"))


NOISE = {"licence": r"(?:Licensed|Released) under [^\n.]*\.", "symbols": r"[#*$%&]{3}", "bangs": "!!+"}


@query("P10_noise_rules", f"""WITH a AS (SELECT doc_id, text AS t0, regexp_replace(text, '{NOISE['licence']}', '', 'g') AS t1 FROM documents), b AS (SELECT *, regexp_replace(t1, '{NOISE['symbols']}', '', 'g') AS t2 FROM a)
SELECT doc_id, len(regexp_extract_all(t0, '{NOISE['licence']}'))::BIGINT AS n_licence, len(regexp_extract_all(t1, '{NOISE['symbols']}'))::BIGINT AS n_symbols, len(regexp_extract_all(t2, '{NOISE['bangs']}'))::BIGINT AS n_bangs, sha256(regexp_replace(t2, '{NOISE['bangs']}', '', 'g')) AS cleaned FROM b""")
def p10(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("t"))
    for name, rule in NOISE.items():  # a count is of what the rules before have left
        d = d.withColumn(f"n_{name}", F.regexp_count("t", F.lit(rule)).cast("long")).withColumn("t", F.regexp_replace("t", rule, ""))
    return d.select("doc_id", *[f"n_{n}" for n in NOISE], F.sha2("t", 256).alias("cleaned"))


@query("P11_canonical_text", r"""SELECT doc_id, sha256(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\p{L}\p{N}]+', '', 'g')) AS canonical FROM documents""")
def p11(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.sha2(X.canonical_text("text"), 256).alias("canonical"))


@query("P12_canonical_question", rf"""WITH {RECORDS} SELECT id, regexp_replace(lower(question), '[ ,.!?;:，。！？；：、\n]+', '', 'g') AS canonical FROM rec""")
def p12(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).select("id", F.regexp_replace(X.nfkc_lower("question"), r"[ ,.!?;:，。！？；：、\n]+", "").alias("canonical"))


@query("P13_overlap_text", r"""SELECT item_id, regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') AS overlap FROM benchmark""")
def p13(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", X.overlap_text("text").alias("overlap"))


@query("P14_canonical_answer", rf"""WITH {RECORDS} SELECT id, regexp_replace(replace(lower(answer), 'ß', 'ss'), '\p{{P}}|{WS}', '', 'g') AS canonical FROM rec""")
def p14(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).select("id", X.canonical_answer("answer").alias("canonical"))


@query("P15_lexical", rf"""WITH {RECORDS} SELECT id, regexp_replace(lower(answer), '[^\p{{L}}\p{{N}}]+', '', 'g') AS lexical FROM rec""")
def p15(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).select("id", X.alnum_lower("answer").alias("lexical"))


@query("P16_style_prefixes", rf"""WITH {RECORDS}, p AS (SELECT id, 'please briefly: ' || question AS q FROM rec) SELECT id, regexp_replace(lower(regexp_replace(q, '^(?:(?:please|briefly|in\ short|:){WS}*)+', '')), '[^\p{{L}}\p{{N}}]+', '', 'g') AS prompt FROM p""")
def p16(spark: SparkSession, sf: str) -> DataFrame:
    q = X.without_prefixes(F.concat(F.lit("please briefly: "), "question"), ["please", "briefly", "in short", ":"])
    return records(spark, sf).select("id", X.alnum_lower(q).alias("prompt"))


@query("P17_opening_fingerprint", rf"""WITH {RECORDS} SELECT id, substr(sha256(substr(regexp_replace(lower(question), '[^\p{{L}}\p{{N}}]+', '', 'g'), 1, 12)), 1, 16) AS opening FROM rec""")
def p17(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).select("id", X.fingerprint(X.alnum_lower("question")).alias("opening"))


@query("P18_first_sentence", r"""SELECT doc_id, regexp_extract(text, '^[^.!?。！？]*[.!?。！？]?', 0) AS sentence FROM documents""")
def p18(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.first_sentence("text").alias("sentence"))


@query("P19_truncate", rf"""WITH {RECORDS} SELECT id, CASE WHEN length(q) > 40 THEN substr(q, 1, 39) || '…' || CASE WHEN strpos(substr(q, 1, 39), '(') > 0 AND length(substr(q, 1, 39)) - length(replace(substr(q, 1, 39), '(', '')) = length(substr(q, 1, 39)) - length(replace(substr(q, 1, 39), ')', '')) + 1 THEN ')' ELSE '' END ELSE q END AS short FROM (SELECT id, '(' || question || ')' AS q FROM rec)""")
def p19(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).select("id", X.truncated(F.concat(F.lit("("), "question", F.lit(")")), 40).alias("short"))


@query("P20_balanced", "SELECT page_id, " + " AND ".join(f"length(html) - length(replace(html, '{a}', '')) = length(html) - length(replace(html, '{b}', ''))" for a, b in X.PAIRS) + " AS balanced FROM pages")
def p20(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", X.balanced("html").alias("balanced"))


@query("P21_sha256", """SELECT doc_id, sha256(text) AS text_sha256, sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '"}') AS record_sha256 FROM documents""")
def p21(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.sha2(F.to_json(F.struct("doc_id", "lang", "source"), {"ignoreNullFields": "false"}), 256).alias("record_sha256"))


@query("P22_stable_hash", """SELECT doc_id, 'r-' || substr(h, 1, 16) AS record_id, ('0x' || substr(h, 1, 8))::BIGINT % 100 AS bucket FROM (SELECT doc_id, sha256('v1|' || lang || '|' || source || '|' || doc_id || '|None') AS h FROM documents)""")
def p22(spark: SparkSession, sf: str) -> DataFrame:
    h = X.stable_hash(F.lit("v1"), "lang", "source", "doc_id", F.lit(None))
    return table(spark, sf, "documents").select("doc_id", F.concat(F.lit("r-"), F.substring(h, 1, 16)).alias("record_id"), X.bucket(h).alias("bucket"))


AD_RULES = {"licence": "(?i)licensed|released under", "symbols": "[#*$%&]{3}", "table": r" \| ", "shout": "!!", "digits": "[0-9]{4,}"}
_RULES_SQL = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(line, '{p}') THEN '{n}' END" for n, p in AD_RULES.items()) + "], lambda r: r IS NOT NULL)"


@query("P23_classify_line", f"""WITH {LINES} SELECT kind, count(*) AS n FROM (SELECT CASE WHEN len(r) = 0 THEN 'clean' WHEN list_contains(r, 'licence') OR line LIKE 'Licensed%' THEN 'whole_line' ELSE 'embedded' END AS kind FROM (SELECT line, {_RULES_SQL} AS r FROM lines)) GROUP BY kind""")
def p23(spark: SparkSession, sf: str) -> DataFrame:
    r = lines(spark, sf).withColumn("r", X.matched_rules("line", AD_RULES))
    kind = F.when(F.size("r") == 0, "clean").when(F.array_contains("r", "licence") | F.col("line").startswith("Licensed"), "whole_line").otherwise("embedded")
    return r.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("P24_confidence", "SELECT vec_id, CASE WHEN s >= 0.98 THEN 'high' WHEN s >= 0.6 THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT vec_id, (vec_id % 100) / 100.0 AS s FROM embeddings)")
def p24(spark: SparkSession, sf: str) -> DataFrame:
    s = (F.col("vec_id") % 100) / 100.0
    return table(spark, sf, "embeddings").select("vec_id", F.when(s >= 0.98, "high").when(s >= 0.6, "medium").otherwise("low").alias("confidence"))


MAPPING = [("qa", "knowledge"), ("chat", "dialogue"), ("rewrite", "expression"), ("summary", "expression")]


@query("P25_mapping", f"""WITH {RECORDS}, m(family, dimension) AS (VALUES ('qa', 'knowledge'), ('chat', 'dialogue'), ('rewrite', 'expression'), ('summary', 'expression')) SELECT id, coalesce(dimension, 'unmapped') AS dimension FROM rec LEFT JOIN m USING (family)""")
def p25(spark: SparkSession, sf: str) -> DataFrame:
    m = F.broadcast(_values(spark, MAPPING, "family string, dimension string"))
    return records(spark, sf).join(m, "family", "left").select("id", F.coalesce("dimension", F.lit("unmapped")).alias("dimension"))


@query("P26_task_transform", f"""WITH {RECORDS} SELECT id, CASE family WHEN 'rewrite' THEN 'Copy: ' || question WHEN 'qa' THEN 'Is it true that: ' || question WHEN 'chat' THEN 'Clarify: ' || question ELSE 'In short: ' || question END AS question FROM rec""")
def p26(spark: SparkSession, sf: str) -> DataFrame:
    form = lambda s: F.format_string(s, F.col("question"))
    f = F.col("family")
    return records(spark, sf).select("id", F.when(f == "rewrite", form("Copy: %s")).when(f == "qa", form("Is it true that: %s")).when(f == "chat", form("Clarify: %s")).otherwise(form("In short: %s")).alias("question"))


@query("P27_templates", f"""WITH {RECORDS}, t(k, template) AS (VALUES (0, 'Tell me: {{q}}'), (1, '{{q}} ({{f}})'), (2, 'About {{f}}: {{q}}')), n AS (SELECT id, question, fact_id, (row_number() OVER (PARTITION BY family ORDER BY id) - 1) % 3 AS k FROM rec)
SELECT id, replace(replace(template, '{{f}}', fact_id), '{{q}}', question) AS prompt FROM n JOIN t USING (k)""")
def p27(spark: SparkSession, sf: str) -> DataFrame:
    t = F.broadcast(_values(spark, [(0, "Tell me: {q}"), (1, "{q} ({f})"), (2, "About {f}: {q}")], "k int, template string"))
    n = numbered_within(records(spark, sf), ["family"], [F.col("id")]).withColumn("k", (F.col("k") % 3).cast("int"))
    return n.join(t, "k").select("id", F.replace(F.replace("template", F.lit("{f}"), F.col("fact_id")), F.lit("{q}"), F.col("question")).alias("prompt"))


@query("P28_split_point", f"""WITH {LINES}, c AS (SELECT doc_id, line_no, length(line) AS n, generate_subscripts(x, 1) AS i, unnest(x) AS ch FROM (SELECT doc_id, line_no, line, string_split(line, '') AS x FROM lines))
SELECT doc_id, line_no, arg_min(i, abs(i - n // 2) * 1000000 + i)::INT AS split_at FROM c WHERE ch IN (',', '，', '、') AND i >= 8 AND n - i >= 8 GROUP BY doc_id, line_no""")
def p28(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).select("doc_id", "line_no", X.split_point("line").cast("int").alias("split_at")).where("split_at IS NOT NULL")


@query("P29_cloze", f"""WITH {RECORDS} SELECT id, left(question, p - 1) || '____' || substr(question, p + length(w)) AS cloze FROM (SELECT id, question, regexp_extract(question, '[a-z]{{6,}}', 0) AS w, strpos(question, regexp_extract(question, '[a-z]{{6,}}', 0)) AS p FROM rec) WHERE w <> ''""")
def p29(spark: SparkSession, sf: str) -> DataFrame:
    w = records(spark, sf).select("id", "question", F.regexp_extract("question", "[a-z]{6,}", 0).alias("w")).where("w <> ''").withColumn("p", F.expr("instr(question, w)"))
    return w.select("id", F.expr("concat(substr(question, 1, p - 1), '____', substr(question, p + length(w)))").alias("cloze"))


@query("P30_bits_per_character", f"""WITH {RECORDS} SELECT id, CASE WHEN length(answer) > 0 THEN 2.5::DOUBLE * turn / length(answer) / ln(2) END AS bpc FROM rec""")
def p30(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).select("id", bits_per_character(F.lit(2.5), F.col("turn"), F.length("answer")).alias("bpc"))


@query("P31_degradation", "SELECT l_orderkey, l_linenumber, l_tax - l_discount AS absolute, CASE WHEN l_discount <> 0 THEN (l_tax - l_discount) / l_discount END AS relative, CASE WHEN l_discount <> 0 THEN (l_tax - l_discount) / l_discount <= 0.5 END AS passed FROM lineitem")
def p31(spark: SparkSession, sf: str) -> DataFrame:
    a, r, ok = degradation(F.col("l_discount"), F.col("l_tax"), 0.5)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", a.alias("absolute"), r.alias("relative"), ok.alias("passed"))


@query("P32_schedule", "SELECT step, CASE WHEN step < 100 THEN 0.001 * (step + 1) / 100 ELSE 0.0001 + 0.0009 * 0.5 * (1 + cos(pi() * (step - 100) / 900.0)) END AS rate FROM range(1000) t(step)")
def p32(spark: SparkSession, sf: str) -> DataFrame:
    return spark.range(1000).select(F.col("id").alias("step"), warmup_cosine(F.col("id"), 100, 1000, 1e-3, 1e-4).alias("rate"))


@query("P33_redact", r"""SELECT event_id, regexp_replace(regexp_replace(s, '(?i)\b(api[_-]?key|authorization|cookie|password|passwd|private[_-]?key|secret|token)\b(\s*[:=]\s*)([^\s,;]+)', '\1\2[REDACTED]', 'g'), '(?i)\b(bearer\s+)[A-Za-z0-9._~+/=-]+', '\1[REDACTED]', 'g') AS line,
 CASE WHEN user_id % 2 = 0 THEN '[REDACTED]' ELSE user_id::VARCHAR END AS masked FROM (SELECT event_id, user_id, event_type || ' token=' || user_id || '; Bearer abc.' || event_id AS s FROM events)""")
def p33(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    s = F.concat("event_type", F.lit(" token="), F.col("user_id").cast("string"), F.lit("; Bearer abc."), F.col("event_id").cast("string"))
    key = F.when(F.col("user_id") % 2 == 0, "api_key").otherwise("name")
    return e.select("event_id", X.redacted(s).alias("line"), F.map_values(X.redacted_map(F.create_map(key, F.col("user_id").cast("string"))))[0].alias("masked"))


@query("P33_redact_tree", r"""SELECT event_id, regexp_replace(regexp_replace(regexp_replace(s, '(?i)("(?:api[_-]?key|authorization|cookie|password|passwd|private[_-]?key|secret|token)"\s*:\s*)("(?:[^"\\]|\\.)*"|\[[^\[\]]*\]|\{[^{}]*\}|[^\s,}\]]+)', '\1"[REDACTED]"', 'g'), '(?i)\b(api[_-]?key|authorization|cookie|password|passwd|private[_-]?key|secret|token)\b(\s*[:=]\s*)([^\s,;]+)', '\1\2[REDACTED]', 'g'), '(?i)\b(bearer\s+)[A-Za-z0-9._~+/=-]+', '\1[REDACTED]', 'g') AS tree
FROM (SELECT event_id, '{"user": {"api_key": "k' || user_id || '", "name": "n' || user_id || '", "private-key": ["a", ' || event_id || ']}, "log": ["Bearer abc.' || event_id || '", "cookie=c' || user_id || '; ok"], "Token": ' || event_id || '}' AS s FROM events)""")
def p33_tree(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", F.col("user_id").cast("string").alias("u"), F.col("event_id").cast("string").alias("i"))
    s = F.concat(F.lit('{"user": {"api_key": "k'), "u", F.lit('", "name": "n'), "u", F.lit('", "private-key": ["a", '), "i", F.lit(']}, "log": ["Bearer abc.'), "i", F.lit('", "cookie=c'), "u", F.lit('; ok"], "Token": '), "i", F.lit("}"))
    return e.select("event_id", X.redacted_tree(s).alias("tree"))


@query("P34_table_cell", r"""SELECT doc_id, sha256(replace(replace(replace(text, '\', '\\'), '|', '\|'), chr(10), '<br>')) AS cell FROM documents""")
def p34(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2(X.table_cell("text"), 256).alias("cell"))


@query("P35_json", """SELECT event_id, (props->>'k')::BIGINT AS k, '{"event_type":"' || event_type || '","k":' || (props->>'k') || '}' AS out_json FROM events""")
def p35(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("p", F.from_json("props", "k long"))
    return e.select("event_id", F.col("p.k").alias("k"), F.to_json(F.struct("event_type", F.col("p.k").alias("k"))).alias("out_json"))


@query("P36_record", f"""WITH {RECORDS} SELECT 'rec-' || substr(sha256(family || '|' || fact_id || '|' || question), 1, 12) AS record_id, 'g-' || substr(sha256(topic_id), 1, 8) AS group_id, split, 'pending' AS status, coalesce(nullif(fact_id, ''), topic_id) AS fact FROM rec""")
def p36(spark: SparkSession, sf: str) -> DataFrame:
    r = records(spark, sf)
    return r.select(F.concat(F.lit("rec-"), F.substring(X.stable_hash("family", "fact_id", "question"), 1, 12)).alias("record_id"), F.concat(F.lit("g-"), F.substring(F.sha2("topic_id", 256), 1, 8)).alias("group_id"), "split", F.lit("pending").alias("status"), F.coalesce(F.nullif("fact_id", F.lit("")), "topic_id").alias("fact"))


@query("F1_matched_rules", f"""WITH {LINES} SELECT doc_id, line_no, rules FROM (SELECT doc_id, line_no, {_RULES_SQL} AS rules FROM lines) WHERE len(rules) > 0""")
def f1(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).select("doc_id", "line_no", X.matched_rules("line", AD_RULES).alias("rules")).where(F.size("rules") > 0)


TERMS = ["tion", "ment", "ción", "keit"]
_BAL = " AND ".join(f"length(line) - length(replace(line, '{a}', '')) = length(line) - length(replace(line, '{b}', ''))" for a, b in X.PAIRS)


@query("F2_safe_lines", f"""WITH {LINES} SELECT doc_id, line_no, line FROM lines WHERE length(line) BETWEEN 32 AND 220 AND NOT regexp_matches(line, '[#*$%&|]|http') AND {_BAL} AND ({' OR '.join(f"contains(line, '{t}')" for t in TERMS)})""")
def f2(spark: SparkSession, sf: str) -> DataFrame:
    l = lines(spark, sf).where(F.length("line").between(32, 220) & ~F.col("line").rlike("[#*$%&|]|http") & X.balanced("line"))
    return l.where(F.exists(F.array(*map(F.lit, TERMS)), lambda t: F.col("line").contains(t)))


@query("F3_clean_evidence", rf"""WITH {LINES} SELECT doc_id, line_no FROM lines WHERE length(line) BETWEEN 20 AND 46 AND len(regexp_extract_all(line, '[a-zA-Z]')) >= 0.78 * length(line) AND NOT regexp_matches(line, '(?:of|the)\.$') AND regexp_matches(line, 'th|en|de')""")
def f3(spark: SparkSession, sf: str) -> DataFrame:
    l = lines(spark, sf).where(F.length("line").between(20, 46) & (F.regexp_count("line", F.lit("[a-zA-Z]")) >= 0.78 * F.length("line")))
    return l.where(~F.col("line").rlike(r"(?:of|the)\.$") & F.col("line").rlike("th|en|de")).select("doc_id", "line_no")


@query("F4_paragraphs", f"""WITH {LINES} SELECT doc_id, line_no FROM lines WHERE length(line) BETWEEN 48 AND 360 AND line_no > 1 AND NOT regexp_matches(line, '^-+$') AND NOT regexp_matches(line, 'https?://|www[.]')""")
def f4(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).where(F.length("line").between(48, 360) & (F.col("line_no") > 1) & ~F.col("line").rlike("^-+$") & ~F.col("line").rlike("https?://|www[.]")).select("doc_id", "line_no")


@query("F5_arithmetic", r"""SELECT doc_id, regexp_matches(text, '[0-9]+\s*[-+*/=]\s*[0-9]+') AS arithmetic, regexp_matches(text, '(?i)\b(sum|plus|minus|equation)\b') AND regexp_matches(text, '[0-9]') AS math_topic FROM documents""")
def f5(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", t.rlike(r"[0-9]+\s*[-+*/=]\s*[0-9]+").alias("arithmetic"), (t.rlike(r"(?i)\b(sum|plus|minus|equation)\b") & t.rlike("[0-9]")).alias("math_topic"))


REASONS = {"short": "length(text) < 200", "symbols": "text rlike '[#*$%&]{3}'", "table": "text like '% | %'", "shout": "text like '%!!%'"}


@query("F7_removal_reason", """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN length(text) < 200 THEN 'short' WHEN regexp_matches(text, '[#*$%&]{3}') THEN 'symbols' WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, '!!') THEN 'shout' ELSE 'kept' END AS reason FROM documents) GROUP BY reason""")
def f7(spark: SparkSession, sf: str) -> DataFrame:
    reason = F.coalesce(*[F.when(F.expr(e), n) for n, e in REASONS.items()], F.lit("kept"))
    return table(spark, sf, "documents").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("F8_encodable", """WITH d AS (SELECT doc_id, list_filter(list_distinct(string_split(text, '')), lambda c: c <> '' AND NOT regexp_matches(c, '[a-zA-Z .,\n]')) AS missing FROM documents)
SELECT missing_char, count(*) AS n_docs FROM (SELECT unnest(missing) AS missing_char FROM d) GROUP BY missing_char""")
def f8(spark: SparkSession, sf: str) -> DataFrame:
    vocab = F.array(*[F.lit(c) for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ .,\n"])
    d = table(spark, sf, "documents").select("doc_id", F.explode(F.array_except(X.chars("text"), vocab)).alias("missing_char"))
    return d.groupBy("missing_char").agg(F.count(F.lit(1)).alias("n_docs"))


@query("F9_name_shape", r"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '(?:^|[ \n])([A-Z][a-z]{2,7})[ .,]', 1)) AS name FROM documents) SELECT name FROM w WHERE substr(name, 1, 1) IN ('A', 'B', 'E', 'T') AND NOT regexp_matches(name, '(?:ing|tion)$') AND NOT regexp_matches(name, '^(?:The|And)')""")
def f9(spark: SparkSession, sf: str) -> DataFrame:
    w = table(spark, sf, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("(?:^|[ \n])([A-Z][a-z]{2,7})[ .,]"), 1))).alias("name")).distinct()
    return w.where(F.substring("name", 1, 1).isin("A", "B", "E", "T") & ~F.col("name").rlike("(?:ing|tion)$") & ~F.col("name").rlike("^(?:The|And)"))


@query("F10_markers", f"""WITH {RECORDS} SELECT id, contains(answer, 'cannot') OR contains(answer, 'der ') OR contains(answer, 'que ') AS marked FROM rec""")
def f10(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).select("id", F.exists(F.array(*map(F.lit, ["cannot", "der ", "que "])), lambda m: F.col("answer").contains(m)).alias("marked"))


@query("F11_prefix_anti", r"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '(?:^|[ \n])([A-Z][a-z]{1,4})[ .,]', 1)) AS name FROM documents) SELECT name FROM w WHERE NOT EXISTS (SELECT 1 FROM w s WHERE s.name <> w.name AND (s.name = substr(w.name, 1, 2) OR s.name = substr(w.name, 1, 3)))""")
def f11(spark: SparkSession, sf: str) -> DataFrame:
    w = table(spark, sf, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("(?:^|[ \n])([A-Z][a-z]{1,4})[ .,]"), 1))).alias("name")).distinct()
    for n in (2, 3):  # two equi joins in place of a loop over prefixes
        w = w.join(w.select(F.col("name").alias("short")), (F.col("short") == F.substring("name", 1, n)) & (F.length("name") > n), "left_anti")
    return w


@query("F12_forbidden_keys", """SELECT event_id, json_keys(props) AS keys, len(list_filter(json_keys(props), lambda k: regexp_matches(k, 'hidden|sealed'))) > 0 AS forbidden FROM events""")
def f12(spark: SparkSession, sf: str) -> DataFrame:
    keys = F.json_object_keys("props")
    return table(spark, sf, "events").select("event_id", keys.alias("keys"), F.exists(keys, lambda k: k.rlike("hidden|sealed")).alias("forbidden"))


@query("F13_review_page", f"""WITH {RECORDS} SELECT id, family FROM rec WHERE family = 'rewrite' AND split = 'train' ORDER BY id LIMIT 10 OFFSET 5""")
def f13(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).where("family = 'rewrite' AND split = 'train'").orderBy("id").offset(5).limit(10).select("id", "family")


__all__ = ["FAMILIES"]
