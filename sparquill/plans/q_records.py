"""Queries of whole files, builders of records, probes and payloads: the rest of S, K and X."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparquill.functions import text as X
from sparquill.operators.sampling import numbered
from sparquill.operators.segments import last_line_no, sections
from sparquill.plans.q_io import _place
from sparquill.plans.q_text import NOISE
from sparquill.plans.registry import query
from sparquill.plans.release import RELEASE, release
from sparquill.sources import io
from sparquill.sources.tables import LINES, RECORDS, lines, records, table


def n() -> Column:
    return F.count(F.lit(1))


def values(rows: list[tuple]) -> str:
    """Rows as SQL's VALUES."""
    return ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


@query("S1_whole_texts", "SELECT item_id, sha256(text) AS text_sha256, false AS has_nul FROM benchmark")
def s1(spark: SparkSession, sf: str) -> DataFrame:
    path = _place(spark, "whole")
    table(spark, sf, "benchmark").select("item_id", F.concat(F.lit("﻿"), "text").alias("value")).repartition("item_id").write.partitionBy("item_id").text(path)
    found = io.whole_texts(spark, path).select(F.regexp_extract("path", "item_id=([0-9]+)", 1).cast("long").alias("item_id"), F.regexp_replace("text", "\n$", "").alias("text"))
    return found.select("item_id", F.sha2("text", 256).alias("text_sha256"), F.contains("text", F.lit("\0")).alias("has_nul"))


@query("S7_json_document", f"WITH {RECORDS} SELECT split, count(*) AS rows, 'release-1' AS version FROM rec GROUP BY split")
def s7(spark: SparkSession, sf: str) -> DataFrame:
    path = _place(spark, "manifest")
    splits = records(spark, sf).groupBy("split").agg(n().alias("rows"))
    whole = splits.agg(F.map_from_entries(F.collect_list(F.struct("split", "rows"))).alias("splits")).select(F.to_json(F.struct(F.lit("release-1").alias("version"), "splits"), {"pretty": "true"}).alias("value"))
    whole.coalesce(1).write.text(path)
    return io.json_document(spark, path, "version string, splits map<string,long>").select("version", F.explode("splits").alias("split", "rows")).select("split", "rows", "version")


@query("S10_token_arrays", f"WITH {RECORDS} SELECT id, length(answer) AS n_tokens, list_sum(list_transform(string_split(answer, ''), lambda c: unicode(c)))::BIGINT AS checksum FROM rec WHERE length(answer) > 0")
def s10(spark: SparkSession, sf: str) -> DataFrame:
    path = _place(spark, "tokens")
    ids = F.transform(F.split("answer", ""), lambda c: F.ascii(c).cast("long"))
    records(spark, sf).where("length(answer) > 0").select("id", ids.alias("tokens")).write.parquet(path)
    t = io.token_arrays(spark, path)
    return t.select("id", F.size("tokens").alias("n_tokens"), F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("checksum"))


#: Artifacts of a release by the names that they have gone by, the preferred first.
ALIASES = [("training", ["split=training", "split=train"]), ("development", ["split=dev", "split=val"]), ("held_out", ["split=heldout", "split=test"]), ("sealed", ["split=sealed"])]


@query("S12_discovery", f"WITH {RECORDS}, a(artifact, preference, name) AS (VALUES {values([(k, i, a) for k, names in ALIASES for i, a in enumerate(names)])}), there AS (SELECT DISTINCT 'split=' || split AS name FROM rec) SELECT artifact, arg_min(there.name, preference) AS found, CASE WHEN arg_min(there.name, preference) IS NULL THEN 'missing' ELSE 'found' END AS status FROM a LEFT JOIN there USING (name) GROUP BY artifact")
def s12(spark: SparkSession, sf: str) -> DataFrame:
    path = _place(spark, "release")
    io.write_release(records(spark, sf).select("id", "split"), path)
    return io.discovered(spark, f"{path}/data", ALIASES)


#: A catalog of terms: term, aliases.
TERMS = [("fruit", ["oranges", "apple"]), ("insult", ["idiot", "moron", "clown"]), ("licence", ["licensed", "license"]), ("symbols", ["%%%", "###"])]


@query("S13_seed_catalog", f"WITH t(term, alias) AS (VALUES {values([(t, a) for t, names in TERMS for a in names])}) SELECT term, alias, count(doc_id) AS n_docs FROM t LEFT JOIN documents ON contains(lower(text), alias) GROUP BY term, alias")
def s13(spark: SparkSession, sf: str) -> DataFrame:
    seeds = spark.createDataFrame(TERMS, "term string, aliases array<string>").select("term", F.explode("aliases").alias("alias"))
    low = F.lower("text")
    found = F.filter(F.array(*[F.when(low.contains(a), F.lit(a)) for _, names in TERMS for a in names]), lambda x: x.isNotNull())
    hits = table(spark, sf, "documents").select(F.explode(found).alias("alias")).groupBy("alias").agg(n().alias("n"))
    return seeds.join(hits, "alias", "left").select("term", "alias", F.coalesce("n", F.lit(0)).alias("n_docs"))


@query("K1_atomic_publish", f"WITH {RECORDS} SELECT id, split, 2 AS version FROM rec WHERE split <> 'train'")
def k1(spark: SparkSession, sf: str) -> DataFrame:
    path = _place(spark, "published")
    r = records(spark, sf).select("id", "split")
    io.publish(r.withColumn("version", F.lit(1)), path)
    io.publish(r.where("split <> 'train'").withColumn("version", F.lit(2)), path)
    return spark.read.parquet(path)


@query("K2_sorted_json_lines", f"""WITH {RECORDS} SELECT '{{"id":' || id || ',"note":"é漢","split":"' || split || '","topic_id":null}}' AS line FROM rec""")
def k2(spark: SparkSession, sf: str) -> DataFrame:
    path = _place(spark, "jsonl")
    io.write_json_lines(records(spark, sf).select("split", F.lit("é漢").alias("note"), F.lit(None).cast("string").alias("topic_id"), "id"), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("K7_csv_lines", f"""WITH {RECORDS} SELECT 'id,family,note' AS line UNION SELECT id || ',' || family || ',' || CASE WHEN id % 2 = 0 THEN '"a, b"' ELSE 'plain' END FROM rec""")
def k7(spark: SparkSession, sf: str) -> DataFrame:
    path = _place(spark, "csv")
    io.write_csv(records(spark, sf).select("id", "family", F.when(F.col("id") % 2 == 0, "a, b").otherwise("plain").alias("note")), path)
    return spark.read.text(path).select(F.col("value").alias("line")).distinct()


@query("K6_files_verified", f"WITH {RECORDS} SELECT 'split=' || split AS name, CASE WHEN split = 'val' THEN 'changed' ELSE 'ok' END AS status FROM (SELECT DISTINCT split FROM rec) UNION ALL SELECT 'split=sealed', 'missing'")
def k6_files(spark: SparkSession, sf: str) -> DataFrame:
    """A release's files are digested, one split is written again with other rows, and all are held against the digests."""
    path = _place(spark, "release")
    r = records(spark, sf).select("id", "split")
    io.write_release(r, path)
    own = lambda: io.folder_digests(spark, f"{path}/data")
    pinned = spark.createDataFrame([tuple(x) for x in own().collect()] + [("split=sealed", "0")], "name string, sha256 string")  # one row a split
    r.where("split = 'val'").select((F.col("id") + 1).alias("id")).write.mode("overwrite").parquet(f"{path}/data/split=val")
    return io.verified(pinned, own())


_CASES = f"""{RECORDS}, w AS (SELECT id, split, question, regexp_extract(substr(question, 17), '[a-z]{{6,}}', 0) AS e FROM rec),
c AS (SELECT id, split, e, right(left(question, strpos(question, e) - 1), 128) AS prefix FROM w WHERE e <> '' AND (length(question) - length(replace(question, e, ''))) // length(e) = 1 AND strpos(question, e) > 16),
pool AS (SELECT e AS x FROM c GROUP BY e ORDER BY count(*) DESC, e LIMIT 32),
d AS (SELECT id, x, row_number() OVER (PARTITION BY id ORDER BY sha256(id || '|' || x)) AS k FROM c JOIN pool ON x <> e AND NOT contains(prefix, x)),
o AS (SELECT id, e AS x FROM c UNION ALL SELECT id, x FROM d WHERE k <= 3),
cases AS (SELECT c.id, c.split, c.prefix, c.e AS answer, list(o.x ORDER BY sha256(o.id || '#' || o.x)) AS options FROM c JOIN o USING (id) GROUP BY ALL)"""


def cloze_cases(spark: SparkSession, sf: str, pool: int = 32, distractors: int = 3) -> DataFrame:
    """Cloze cases with distractors from the `pool` most frequent entities (a fixed number) and options in hash order."""
    w = records(spark, sf).select("id", "split", "question", F.regexp_extract(F.expr("substr(question, 17)"), "[a-z]{6,}", 0).alias("e")).where("e <> ''")
    once = (F.length("question") - F.length(F.replace("question", F.col("e"), F.lit("")))) / F.length("e") == 1
    c = w.where(once & (F.expr("instr(question, e)") > 16)).select("id", "split", "e", F.expr("right(left(question, instr(question, e) - 1), 128)").alias("prefix"))
    names = c.groupBy("e").agg(n().alias("n")).orderBy(F.desc("n"), "e").limit(pool).agg(F.collect_list("e").alias("pool"))
    key = lambda x, mark: F.sha2(F.concat(F.col("id").cast("string"), F.lit(mark), x), 256)
    ranked = lambda xs, mark: F.transform(F.array_sort(F.transform(xs, lambda x: F.struct(key(x, mark).alias("k"), x.alias("x")))), lambda s: s["x"])
    others = F.filter("pool", lambda x: (x != F.col("e")) & ~F.contains("prefix", x))
    chosen = F.slice(ranked(others, "|"), 1, distractors)
    return c.crossJoin(F.broadcast(names)).select("id", "split", "prefix", F.col("e").alias("answer"), ranked(F.concat(F.array("e"), chosen), "#").alias("options"))


@query("X6_cloze_options", f"WITH {_CASES} SELECT id, prefix, answer, options FROM cases")
def x6_options(spark: SparkSession, sf: str) -> DataFrame:
    return cloze_cases(spark, sf).select("id", "prefix", "answer", "options")


_DIGEST = "sum(('0x' || substr(sha256({0}), 1, 12))::BIGINT)::VARCHAR"


def content_digest(value: Column) -> Column:
    """A digest of a set of values that needs no order: the sum of 48 bits of each one's SHA-256."""
    return F.sum(F.conv(F.substring(F.sha2(value, 256), 1, 12), 16, 10).cast("decimal(38,0)")).cast("string")


@query("X7_probe_artifact", f"WITH {_CASES}, s AS (SELECT split, {_DIGEST.format('question')} AS digest, CASE WHEN split = 'val' THEN 'other' ELSE {_DIGEST.format('question')} END AS pinned FROM rec GROUP BY split) SELECT s.split, CASE WHEN digest = pinned THEN 'verified' ELSE 'changed' END AS status, count(cases.id) AS n_cases, coalesce({_DIGEST.format('cases.id || answer')}, '0') AS cases_digest FROM s LEFT JOIN cases ON cases.split = s.split AND digest = pinned GROUP BY s.split, digest, pinned")
def x7(spark: SparkSession, sf: str) -> DataFrame:
    """Only splits whose content has the digest that the manifest pins are read for cases; the artifact lists the rest."""
    s = records(spark, sf).groupBy("split").agg(content_digest(F.col("question")).alias("digest"))
    s = s.withColumn("pinned", F.when(F.col("split") == "val", "other").otherwise(F.col("digest")))
    ok = F.col("digest") == F.col("pinned")
    cases = cloze_cases(spark, sf).groupBy("split").agg(n().alias("n"), content_digest(F.concat(F.col("id").cast("string"), "answer")).alias("d"))
    both = s.join(cases, "split", "left")
    return both.select("split", F.when(ok, "verified").otherwise("changed").alias("status"), F.when(ok, F.coalesce("n", F.lit(0))).otherwise(0).alias("n_cases"), F.when(ok, F.coalesce("d", F.lit("0"))).otherwise("0").alias("cases_digest"))


#: Templates of candidates: family, question, answer; {n} is the name, {r} its region, {c} the count of its customers.
TEMPLATES = [
    ("entity", "Which region does {n} belong to?", "{n} belongs to {r}."),
    ("entity", "Name the region of {n}.", "{r}."),
    ("fact", "How many customers does {n} have?", "{n} has {c} customers."),
    ("relation", "Is {n} in {r}?", "Yes, {n} is in {r}."),
]
UNKNOWN = ["ATLANTIS", "ELDORADO", "UTOPIA"]


@query("X10_candidates", f"""WITH f AS (SELECT n_name AS n, r_name AS r, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS c FROM nation JOIN region ON r_regionkey = n_regionkey),
t(family, q, a) AS (VALUES {values(TEMPLATES)}), u AS (SELECT family, n AS fact_id, replace(replace(replace(q, '{{n}}', n), '{{r}}', r), '{{c}}', c::VARCHAR) AS question, replace(replace(replace(a, '{{n}}', n), '{{r}}', r), '{{c}}', c::VARCHAR) AS answer FROM f, t
UNION ALL SELECT 'boundary', x, 'Which region does ' || x || ' belong to?', 'The source does not mention ' || x || '.' FROM (VALUES {values([(x,) for x in UNKNOWN])}) b(x))
SELECT substr(sha256(family || '|' || question), 1, 16) AS id, family, fact_id, question, answer FROM u""")
def x10(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(n().alias("c"))
    f = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).join(c, "n_nationkey", "left")
    f = f.select(F.col("n_name").alias("n"), F.col("r_name").alias("r"), F.coalesce("c", F.lit(0)).cast("string").alias("c"))
    fill = lambda t: F.replace(F.replace(F.replace(F.lit(t), F.lit("{n}"), F.col("n")), F.lit("{r}"), F.col("r")), F.lit("{c}"), F.col("c"))
    rows = f.select(F.col("n").alias("fact_id"), F.explode(F.array(*[F.struct(F.lit(k).alias("family"), fill(q).alias("question"), fill(a).alias("answer")) for k, q, a in TEMPLATES])).alias("x")).select("x.family", "fact_id", "x.question", "x.answer")
    unknown = spark.createDataFrame([("boundary", x, f"Which region does {x} belong to?", f"The source does not mention {x}.") for x in UNKNOWN], rows.schema)
    return rows.unionByName(unknown).select(F.substring(F.sha2(F.concat_ws("|", "family", "question"), 256), 1, 16).alias("id"), "family", "fact_id", "question", "answer")


_FORMS = ["numbered", "summary", "insufficient", "correction", "rewrite"]


@query("X11_answer_forms", f"""WITH {LINES}, c AS (SELECT doc_id, list(line ORDER BY line_no) AS xs FROM lines WHERE trim(line, ' ') <> '' GROUP BY doc_id), f AS (SELECT doc_id, xs, [{", ".join(f"'{x}'" for x in _FORMS)}][doc_id % 5 + 1] AS form FROM c)
SELECT doc_id, form, sha256(CASE form WHEN 'numbered' THEN list_aggregate(list_transform(xs, lambda x, i: '[' || i || '] ' || x), 'string_agg', chr(10)) WHEN 'summary' THEN 'In short: ' || xs[1] || ' ' || xs[-1] WHEN 'insufficient' THEN 'The ' || len(xs) || ' passages do not say.' WHEN 'correction' THEN 'Not quite. ' || xs[1] ELSE list_aggregate(list_transform(xs, lambda x: upper(left(x, 1)) || substr(x, 2)), 'string_agg', ' ') END) AS answer_sha256 FROM f""")
def x11_forms(spark: SparkSession, sf: str) -> DataFrame:
    c = lines(spark, sf).where(F.trim("line") != "").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]).alias("xs"))
    xs, form = F.col("xs"), F.element_at(F.array(*map(F.lit, _FORMS)), (F.col("doc_id") % 5 + 1).cast("int"))
    answer = (
        F.when(form == "numbered", F.array_join(F.transform(xs, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x)), "\n"))
        .when(form == "summary", F.concat(F.lit("In short: "), xs[0], F.lit(" "), F.element_at(xs, -1)))
        .when(form == "insufficient", F.concat(F.lit("The "), F.size(xs).cast("string"), F.lit(" passages do not say.")))
        .when(form == "correction", F.concat(F.lit("Not quite. "), xs[0]))
        .otherwise(F.array_join(F.transform(xs, lambda x: F.concat(X.upper_char(F.substring(x, 1, 1)), F.substr(x, F.lit(2)))), " "))
    )
    return c.select("doc_id", form.alias("form"), F.sha2(answer, 256).alias("answer_sha256"))


_HEAD = "(length(line) BETWEEN 1 AND 40 AND NOT regexp_matches(line, '[.!?,]$'))"


def _head() -> Column:
    return F.length("line").between(1, 40) & ~F.col("line").rlike("[.!?,]$")


@query("X12_fact_evidence", f"WITH {LINES}, m AS (SELECT doc_id, count(*) AS k FROM lines GROUP BY doc_id), f AS (SELECT l.doc_id, doc_id % k + 1 AS line_no FROM labels l JOIN m USING (doc_id)), h AS (SELECT doc_id, line_no, line, max(CASE WHEN {_HEAD} THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no) AS head FROM lines) SELECT doc_id, line_no, coalesce(head, 0) AS head_line_no, sha256(line) AS evidence_sha256 FROM f JOIN h USING (doc_id, line_no)")
def x12(spark: SparkSession, sf: str) -> DataFrame:
    """Reviewed facts name a line; its text is the evidence, and the chapter is the last heading up to it."""
    l = lines(spark, sf)
    size = l.groupBy("doc_id").agg(n().alias("k"))
    f = table(spark, sf, "labels").select("doc_id").join(size, "doc_id").select("doc_id", (F.col("doc_id") % F.col("k") + 1).alias("line_no"))
    h = l.withColumn("head", last_line_no(_head()))
    return f.join(h, ["doc_id", "line_no"]).select("doc_id", "line_no", F.coalesce("head", F.lit(0)).alias("head_line_no"), F.sha2("line", 256).alias("evidence_sha256"))


@query("X13_local_reframe", f"""WITH {RECORDS}, x AS (SELECT id, question, answer, regexp_extract(answer, '([A-Z][a-z]{{3,}})', 1) AS entity, regexp_extract(answer, '([0-9]+)', 1) AS level, regexp_extract(answer, '^[^.!?]*[.!?]?', 0) AS first FROM rec)
SELECT id, entity <> '' AS reframed, CASE WHEN entity <> '' THEN 'According to the passage, what is said of ' || entity || CASE WHEN level <> '' THEN ' and ' || level ELSE '' END || '?' ELSE question END AS question, CASE WHEN entity <> '' THEN 'The passage says: ' || trim(first, ' ') ELSE answer END AS answer, entity = '' OR contains(answer, trim(first, ' ')) AS supported FROM x""")
def x13(spark: SparkSession, sf: str) -> DataFrame:
    """A global claim becomes one about its evidence: the entity and the number are taken from it, question and answer are
    rewritten, and the rewritten answer is checked against the evidence again."""
    a = F.col("answer")
    x = records(spark, sf).select("id", "question", "answer", F.regexp_extract(a, "([A-Z][a-z]{3,})", 1).alias("entity"), F.regexp_extract(a, "([0-9]+)", 1).alias("level"), F.trim(F.regexp_extract(a, "^[^.!?]*[.!?]?", 0)).alias("first"))
    has = F.col("entity") != ""
    asked = F.concat(F.lit("According to the passage, what is said of "), "entity", F.when(F.col("level") != "", F.concat(F.lit(" and "), "level")).otherwise(""), F.lit("?"))
    return x.select("id", has.alias("reframed"), F.when(has, asked).otherwise(F.col("question")).alias("question"), F.when(has, F.concat(F.lit("The passage says: "), "first")).otherwise(a).alias("answer"), (~has | F.contains("answer", "first")).alias("supported"))


_BANGS = NOISE["bangs"]


@query("X15_repair_run", f"""WITH {RECORDS}, c AS (SELECT id, split, regexp_replace(question, '{_BANGS}', '', 'g') AS q, question, answer FROM rec), k AS (SELECT *, row_number() OVER (PARTITION BY lower(q), answer ORDER BY id) AS k FROM c), o AS (SELECT id, split, q <> question AS changed, k > 1 AS dropped, length(answer) < 60 AS flagged FROM k)
SELECT split, count(*) AS n_in, count(*) FILTER (WHERE dropped) AS n_dropped, count(*) FILTER (WHERE changed AND NOT dropped) AS n_changed, count(*) FILTER (WHERE flagged AND NOT dropped) AS n_flagged, count(*) FILTER (WHERE NOT dropped) AS n_out, count(*) FILTER (WHERE NOT dropped AND NOT flagged) AS n_ready FROM o GROUP BY split""")
def x15(spark: SparkSession, sf: str) -> DataFrame:
    """Repair, dedup, flag and account for every record, by split."""
    c = records(spark, sf).withColumn("q", F.regexp_replace("question", _BANGS, ""))
    first = c.groupBy(F.lower("q").alias("lq"), "answer").agg(F.min("id").alias("keep"))
    o = c.withColumn("lq", F.lower("q")).join(first, ["lq", "answer"]).select("split", (F.col("q") != F.col("question")).alias("changed"), (F.col("id") != F.col("keep")).alias("dropped"), (F.length("answer") < 60).alias("flagged"))
    kept = ~F.col("dropped")
    return o.groupBy("split").agg(n().alias("n_in"), F.count_if("dropped").alias("n_dropped"), F.count_if(F.col("changed") & kept).alias("n_changed"), F.count_if(F.col("flagged") & kept).alias("n_flagged"), F.count_if(kept).alias("n_out"), F.count_if(kept & ~F.col("flagged")).alias("n_ready"))


@query("X17_clean_chapter", f"""WITH {LINES}, p AS (SELECT doc_id, line_no, line, lower(line) AS h, min(CASE WHEN length(line) < 60 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS is_lead FROM lines), q AS (SELECT *, CASE WHEN is_lead = 1 THEN row_number() OVER (PARTITION BY doc_id, h ORDER BY line_no) ELSE 1 END AS k FROM p),
r AS (SELECT doc_id, line_no, regexp_replace(regexp_replace(regexp_replace(line, '{NOISE["licence"]}', '', 'g'), '{NOISE["symbols"]}', '', 'g'), '{NOISE["bangs"]}', '', 'g') AS line FROM q WHERE k = 1)
SELECT doc_id, count(*) AS n_lines, sha256(string_agg(line, chr(10) ORDER BY line_no)) AS cleaned_sha256 FROM r GROUP BY doc_id""")
def x17(spark: SparkSession, sf: str) -> DataFrame:
    """Repeated headings of the leading block go, then the inline rules run over what is left."""
    run = W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    p = lines(spark, sf).withColumn("lead", F.min(F.when(F.length("line") < 60, 1).otherwise(0)).over(run))
    k = F.row_number().over(W.partitionBy("doc_id", F.lower("line")).orderBy("line_no"))
    kept = p.withColumn("k", F.when(F.col("lead") == 1, k).otherwise(1)).where("k = 1")
    for rule in NOISE.values():
        kept = kept.withColumn("line", F.regexp_replace("line", rule, ""))
    rows = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return kept.groupBy("doc_id").agg(n().alias("n_lines"), rows.alias("x")).select("doc_id", "n_lines", F.sha2(F.array_join(F.transform("x", lambda s: s["line"]), "\n"), 256).alias("cleaned_sha256"))


#: The rules for encoded records: ids and labels of one length, labels that are the next input or -100, ids in the
#: vocabulary, a length limit, answers that are supervised at all.
_PAYLOAD = f"""{RECORDS}, enc AS (SELECT id, split, list_transform(string_split(question || answer, ''), lambda c: unicode(c)) AS ids, length(question) AS nq FROM rec WHERE length(question) > 0 AND length(answer) > 0),
pay AS (SELECT id, split, ids, list_transform(ids, lambda x, i: CASE WHEN i <= nq AND id % 19 <> 0 THEN -100 WHEN id % 23 = 0 THEN x + 1 ELSE x END) AS labels0 FROM enc),
pay2 AS (SELECT id, split, ids, CASE WHEN id % 29 = 0 THEN labels0[1:len(labels0) - 1] ELSE labels0 END AS labels FROM pay)"""


@query("X19_payload_violations", f"""WITH {_PAYLOAD}, v AS (SELECT id, split, unnest(list_filter([CASE WHEN len(ids) <> len(labels) THEN 'length_mismatch' END, CASE WHEN len(list_filter(labels, lambda x, i: x <> -100 AND x <> ids[i])) > 0 THEN 'label_not_input' END, CASE WHEN len(list_filter(labels, lambda x: x <> -100)) = 0 THEN 'nothing_supervised' END, CASE WHEN labels[1] <> -100 THEN 'prompt_supervised' END, CASE WHEN list_max(ids) > 65535 THEN 'outside_vocabulary' END, CASE WHEN len(ids) > 2048 THEN 'too_long' END], lambda x: x IS NOT NULL)) AS code FROM pay2) SELECT split, code, count(*) AS n FROM v GROUP BY split, code""")
def x19(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("id")
    r = records(spark, sf).where("length(question) > 0 AND length(answer) > 0")
    e = r.select("id", "split", F.length("question").alias("nq"), F.transform(F.split(F.concat("question", "answer"), ""), lambda c: F.ascii(c)).alias("ids"))
    labels = F.transform("ids", lambda x, k: F.when((k < F.col("nq")) & (i % 19 != 0), -100).when(i % 23 == 0, x + 1).otherwise(x))
    p = e.withColumn("labels", labels).withColumn("labels", F.when(i % 29 == 0, F.slice("labels", 1, F.size("labels") - 1)).otherwise(F.col("labels")))
    return payload_violations(p).groupBy("split", "code").agg(n().alias("n"))


def payload_violations(p: DataFrame, vocabulary: int = 65536, longest: int = 2048) -> DataFrame:
    """id, split, code: each rule that an encoded record (ids, labels) breaks."""
    ids, labels = F.col("ids"), F.col("labels")
    rules = {
        "length_mismatch": F.size(ids) != F.size(labels),
        "label_not_input": F.exists(F.zip_with(ids, labels, lambda a, b: (b != -100) & (a != b)), lambda x: F.coalesce(x, F.lit(False))),
        "nothing_supervised": ~F.exists(labels, lambda x: x != -100),
        "prompt_supervised": F.get(labels, F.lit(0)) != -100,
        "outside_vocabulary": F.array_max(ids) >= vocabulary,
        "too_long": F.size(ids) > longest,
    }
    codes = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]), lambda x: x.isNotNull())
    return p.select("id", "split", F.explode(codes).alias("code"))


@query("X21_same_contract", f"WITH r AS (SELECT event_type AS checkpoint, user_id, count(*) AS k, avg(value) AS score FROM events GROUP BY event_type, user_id), c AS (SELECT checkpoint, count(*) AS n_cases, {_DIGEST.format('user_id::VARCHAR')} AS contract, round(avg(score), 6) AS mean_score FROM r GROUP BY checkpoint) SELECT checkpoint, n_cases, contract, mean_score, contract = (SELECT contract FROM c ORDER BY checkpoint LIMIT 1) AS same_contract FROM c")
def x21(spark: SparkSession, sf: str) -> DataFrame:
    """Reports of several checkpoints: their metric, and whether they were made over the same cases as the first one's."""
    r = table(spark, sf, "events").groupBy(F.col("event_type").alias("checkpoint"), "user_id").agg(F.avg("value").alias("score"))
    c = r.groupBy("checkpoint").agg(n().alias("n_cases"), content_digest(F.col("user_id").cast("string")).alias("contract"), F.round(F.avg("score"), 6).alias("mean_score"))
    first = c.agg(F.min(F.struct("checkpoint", "contract")).alias("f")).select(F.col("f.contract").alias("wanted"))
    return c.crossJoin(F.broadcast(first)).select("checkpoint", "n_cases", "contract", "mean_score", (F.col("contract") == F.col("wanted")).alias("same_contract"))


@query("X26_supervised_labels", f"WITH {_PAYLOAD} SELECT id, sha256(list_aggregate(list_transform(list_filter(labels, lambda x: x <> -100), lambda x: chr(x::INT)), 'string_agg', '')) AS answer_sha256 FROM pay2 WHERE id % 23 <> 0 AND len(list_filter(labels, lambda x: x <> -100)) > 0")
def x26(spark: SparkSession, sf: str) -> DataFrame:
    """The text of the supervised labels only."""
    i = F.col("id")
    r = records(spark, sf).where("length(question) > 0 AND length(answer) > 0 AND id % 23 <> 0")
    chars = F.split(F.concat("question", "answer"), "")
    own = F.filter(F.transform(chars, lambda c, k: F.when((k < F.length("question")) & (i % 19 != 0), F.lit(None)).otherwise(c)), lambda c: c.isNotNull())
    cut = F.when(i % 29 == 0, F.slice(own, 1, F.size(own) - 1)).otherwise(own)
    return r.select("id", cut.alias("x")).where(F.size("x") > 0).select("id", F.sha2(F.array_join("x", ""), 256).alias("answer_sha256"))


@query("X30_section_texts", f"WITH {LINES}, s AS (SELECT doc_id, line_no, line, sum(CASE WHEN {_HEAD} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM lines) SELECT doc_id, section::BIGINT AS section, CASE WHEN ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT % 100 < 90 THEN 'train' ELSE 'val' END AS split, sha256(string_agg(line, chr(10) ORDER BY line_no)) AS text_sha256, sum(length(line) + 1)::BIGINT AS n_tokens FROM s GROUP BY doc_id, section")
def x30(spark: SparkSession, sf: str) -> DataFrame:
    """Each section's text, with the end mark counted, and the split of its document, ready for encoding."""
    s = sections(lines(spark, sf), _head())
    b = F.conv(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 8), 16, 10).cast("long") % 100
    rows = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    g = s.groupBy("doc_id", "section").agg(rows.alias("x"), F.sum(F.length("line") + 1).alias("n_tokens"))
    return g.select("doc_id", F.col("section").cast("long").alias("section"), F.when(b < 90, "train").otherwise("val").alias("split"), F.sha2(F.array_join(F.transform("x", lambda r: r["line"]), "\n"), 256).alias("text_sha256"), "n_tokens")


@query("V10_validated_decisions", f"WITH {RELEASE} SELECT id, CASE WHEN evidence IS NULL THEN 'no_evidence' WHEN evidence_sha256 <> sha256(evidence) THEN 'stale_digest' WHEN review = 'rejected' AND length(question) % 2 = 1 THEN 'reason_missing' WHEN review = 'approved' AND NOT roles_ok THEN 'approved_but_invalid' WHEN review = 'approved' AND declared_sequence <> sequence THEN 'modified' ELSE review END AS state FROM rel")
def v10_validated(spark: SparkSession, sf: str) -> DataFrame:
    """The state of each record's review: a decision counts only for the evidence it was pinned to, a rejection needs a
    reason, and an approved record that was edited since is modified."""
    e, review = F.col("evidence"), F.col("review")
    state = (
        F.when(e.isNull(), "no_evidence")
        .when(F.col("evidence_sha256") != F.sha2("evidence", 256), "stale_digest")
        .when((review == "rejected") & (F.length("question") % 2 == 1), "reason_missing")
        .when((review == "approved") & ~F.col("roles_ok"), "approved_but_invalid")
        .when((review == "approved") & (F.col("declared_sequence") != F.col("sequence")), "modified")
        .otherwise(review)
    )
    return release(spark, sf).select("id", state.alias("state"))


def positional_mismatches(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """One row: mismatches, n of two ordered lists (columns key, o) that should hold the same keys in the same order.
    Each is numbered by a distributed sort, so no task sees all rows."""
    left, right = numbered(a, "o").select(key, "k"), numbered(b, "o").select(F.col(key).alias("id2"), F.col("k").alias("k2"))
    both = left.join(right, (F.col(key) == F.col("id2")) & (F.col("k") == F.col("k2")), "full")
    return both.agg(F.count_if(F.col(key).isNull() | F.col("id2").isNull()).alias("mismatches"), n().alias("n"))
