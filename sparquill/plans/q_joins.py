"""Queries of joins (J), duplicates and graphs (D) and sets (T)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparquill.functions import text as X
from sparquill.operators import dedup as D
from sparquill.operators.components import connected_components
from sparquill.operators.distractors import nearest_facts
from sparquill.operators.quotes import containing, located, nearly
from sparquill.operators.sampling import numbered_within
from sparquill.operators.staging import salted_join
from sparquill.plans.q_records import positional_mismatches
from sparquill.plans.registry import query
from sparquill.sources.tables import LINES, RECORDS, lines, records, spread, table


def _decisions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").selectExpr("doc_id AS conv", "CASE quality WHEN 1 THEN 'approve' ELSE 'reject' END AS decision")


@query("J1_decisions", f"""WITH {RECORDS}, d AS (SELECT doc_id AS conv, CASE quality WHEN 1 THEN 'approve' ELSE 'reject' END AS decision FROM labels) SELECT id, coalesce(decision, 'pending') AS decision FROM rec LEFT JOIN d ON conv = conv_id""")
def j1(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).join(_decisions(spark, sf), F.col("conv") == F.col("conv_id"), "left").select("id", F.coalesce("decision", F.lit("pending")).alias("decision"))


@query("J2_positional_pair", f"""WITH {RECORDS}, a AS (SELECT id, row_number() OVER (ORDER BY id) AS n FROM rec), b AS (SELECT id, row_number() OVER (ORDER BY conv_id, turn) AS n FROM rec WHERE id % 97 <> 0) SELECT count(*) FILTER (WHERE a.id IS NULL OR b.id IS NULL) AS mismatches, count(*) AS n FROM a FULL JOIN b ON a.id = b.id AND a.n = b.n""")
def j2(spark: SparkSession, sf: str) -> DataFrame:
    r = records(spark, sf)
    b = r.where("id % 97 <> 0").select("id", (F.col("conv_id") * 1000 + F.col("turn")).alias("o"))
    return positional_mismatches(r.select("id", F.col("id").alias("o")), b)


@query("J3_pairs_within_key", "SELECT a.c_nationkey AS k, count(*) AS n_pairs, sum(CASE WHEN a.c_mktsegment = b.c_mktsegment THEN 1 ELSE 0 END)::BIGINT AS n_same FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey < b.c_custkey GROUP BY a.c_nationkey".replace("customer", "(SELECT s_nationkey AS c_nationkey, s_suppkey AS c_custkey, s_acctbal > 0 AS c_mktsegment FROM supplier)"))
def j3(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").selectExpr("s_nationkey AS k", "s_suppkey AS id", "s_acctbal > 0 AS good")
    # Pairs are counted from the sizes of the groups, which combine before the shuffle; no pair is made.
    pairs = lambda c: (c * (c - 1) / 2).cast("long")
    kinds = s.groupBy("k", "good").agg(F.count(F.lit(1)).alias("c"))
    return kinds.groupBy("k").agg(pairs(F.sum("c")).alias("n_pairs"), F.sum(pairs(F.col("c"))).alias("n_same")).where("n_pairs > 0")


@query("J5_block_sections", f"""WITH {LINES}, h AS (SELECT doc_id, line_no // 4 AS sec, min(line_no) AS s, max(line_no) AS e FROM lines GROUP BY doc_id, line_no // 4), p AS (SELECT a.doc_id, a.line_no AS i, b.line_no AS j FROM lines a JOIN lines b ON a.doc_id = b.doc_id AND a.line = b.line AND a.line_no < b.line_no WHERE length(a.line) >= 30)
SELECT DISTINCT p.doc_id, x.sec AS first_section, y.sec AS second_section FROM p JOIN h x ON x.doc_id = p.doc_id AND i BETWEEN x.s AND x.e JOIN h y ON y.doc_id = p.doc_id AND j BETWEEN y.s AND y.e WHERE x.sec <> y.sec""")
def j5(spark: SparkSession, sf: str) -> DataFrame:
    l = lines(spark, sf).where(F.length("line") >= 30)
    p = l.alias("a").join(l.alias("b"), (F.col("a.doc_id") == F.col("b.doc_id")) & (F.xxhash64("a.line") == F.xxhash64("b.line")) & (F.col("a.line") == F.col("b.line")) & (F.col("a.line_no") < F.col("b.line_no"))).select("a.doc_id", F.col("a.line_no").alias("i"), F.col("b.line_no").alias("j"))
    h = lines(spark, sf).groupBy("doc_id", F.floor(F.col("line_no") / 4).alias("sec")).agg(F.min("line_no").alias("s"), F.max("line_no").alias("e"))
    x, y = (h.select("doc_id", F.col("sec").alias(n), F.col("s").alias(f"s_{n}"), F.col("e").alias(f"e_{n}")) for n in ("first_section", "second_section"))
    found = p.join(x, "doc_id").where("i BETWEEN s_first_section AND e_first_section").join(y, "doc_id").where("j BETWEEN s_second_section AND e_second_section")
    return found.where("first_section <> second_section").select("doc_id", "first_section", "second_section").distinct()


NAMES = ["idiot", "blend", "oranges", "licensed", "scum", "clown"]
_NAMES = "n(name) AS (VALUES " + ", ".join(f"('{n}')" for n in NAMES) + ")"


def _names(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(n,) for n in NAMES], "name string"))


@query("J6_first_mention", f"""WITH {LINES}, {_NAMES} SELECT name, doc_id, line_no FROM (SELECT name, doc_id, line_no, row_number() OVER (PARTITION BY name ORDER BY doc_id, line_no) AS k FROM n JOIN lines ON contains(line, name)) WHERE k = 1""")
def j6(spark: SparkSession, sf: str) -> DataFrame:
    # The catalog is fixed, so the nested-loop join broadcasts it; the minimum combines before the shuffle.
    first = F.min(F.struct("doc_id", "line_no")).alias("m")
    return lines(spark, sf).join(_names(spark), F.col("line").contains(F.col("name"))).groupBy("name").agg(first).select("name", "m.*")


@query("J7_first_cooccurrence", f"""WITH {_NAMES} SELECT a.name AS a, b.name AS b, min(doc_id) AS doc_id FROM documents JOIN n a ON contains(text, a.name) JOIN n b ON contains(text, b.name) AND a.name < b.name GROUP BY a.name, b.name""")
def j7(spark: SparkSession, sf: str) -> DataFrame:
    found = F.filter(F.array(*map(F.lit, sorted(NAMES))), lambda n: F.col("text").contains(n))
    d = table(spark, sf, "documents").select("doc_id", found.alias("f")).where(F.size("f") > 1)
    pairs = F.flatten(F.transform("f", lambda a: F.transform(F.filter("f", lambda b: a < b), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return d.select("doc_id", F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.min("doc_id").alias("doc_id"))


_QUOTES = r"q AS (SELECT item_id, regexp_replace(text, '\s+', '', 'g') AS quote FROM benchmark), d AS (SELECT doc_id, regexp_replace(text, '\s+', '', 'g') AS body FROM documents), h AS (SELECT item_id, doc_id, strpos(body, quote) AS place FROM q JOIN d ON contains(body, quote) WHERE quote <> '')"


def _quotes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    bodies = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", X.compact("text").alias("body"))
    return bodies, table(spark, sf, "benchmark").select("item_id", X.compact("text").alias("quote"))


@query("J8_quote_locate", f"WITH {_QUOTES} SELECT item_id, min(doc_id) AS doc_id, arg_min(place, doc_id) AS place FROM h GROUP BY item_id")
def j8(spark: SparkSession, sf: str) -> DataFrame:
    return located(containing(*_quotes(spark, sf)))


@query("J8_claimed_first", f"WITH {_QUOTES} SELECT item_id, arg_min(doc_id, doc_id + CASE WHEN doc_id = item_id % 50 THEN 0 ELSE 1000000000 END) AS doc_id, arg_min(place, doc_id + CASE WHEN doc_id = item_id % 50 THEN 0 ELSE 1000000000 END) AS place, bool_or(doc_id = item_id % 50) AS as_claimed FROM h GROUP BY item_id")
def j8_claimed(spark: SparkSession, sf: str) -> DataFrame:
    claims = table(spark, sf, "benchmark").select("item_id", (F.col("item_id") % 50).alias("claimed"))
    return located(containing(*_quotes(spark, sf)), claims)


@query("J8_nearly", r"""WITH q AS (SELECT item_id, regexp_replace(regexp_replace(text, '\s+', '', 'g'), '(.{40}).', '\1#', 'g') AS quote FROM benchmark), d AS (SELECT doc_id, regexp_replace(text, '\s+', '', 'g') AS body FROM documents),
qg AS (SELECT DISTINCT item_id, substr(quote, i, 8) AS g FROM (SELECT item_id, quote, unnest(range(1, length(quote) - 6)) AS i FROM q)), n AS (SELECT item_id, count(*) AS size FROM qg GROUP BY item_id),
dg AS (SELECT DISTINCT doc_id, substr(body, i, 8) AS g FROM (SELECT doc_id, body, unnest(range(1, length(body) - 6)) AS i FROM d)),
k AS (SELECT item_id, doc_id, count(*) AS k FROM qg JOIN dg USING (g) GROUP BY item_id, doc_id), b AS (SELECT item_id, doc_id, k, row_number() OVER (PARTITION BY item_id ORDER BY k DESC, doc_id) AS r FROM k)
SELECT item_id, doc_id, k / size AS share FROM b JOIN n USING (item_id) WHERE r = 1 AND k / size >= 0.5""")
def j8_nearly(spark: SparkSession, sf: str) -> DataFrame:
    bodies, quotes = _quotes(spark, sf)
    return nearly(bodies, quotes.withColumn("quote", F.regexp_replace("quote", "(.{40}).", "$1#")))


@query("J9_entity_in_claimed", f"""WITH {LINES}, {_NAMES} SELECT name, doc_id, min(line_no) AS line_no FROM n JOIN lines ON doc_id % 6 = length(name) % 6 AND contains(line, name) GROUP BY name, doc_id""")
def j9(spark: SparkSession, sf: str) -> DataFrame:
    n = _names(spark).withColumn("k", F.length("name") % 6)
    return lines(spark, sf).withColumn("k", F.col("doc_id") % 6).join(n, "k").where(F.col("line").contains(F.col("name"))).groupBy("name", "doc_id").agg(F.min("line_no").cast("long").alias("line_no"))


CATALOG = {"insult": ["idiot", "moron", "clown"], "licence": ["icensed", "MIT"], "fruit": ["oranges", "apple"]}


@query("J10_term_tags", "SELECT doc_id, tags FROM (SELECT doc_id, list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(text, '{a}')" for a in v) + f" THEN '{k}' END" for k, v in sorted(CATALOG.items(), key=lambda x: (-len(x[0]), x[0]))) + "], lambda x: x IS NOT NULL) AS tags FROM documents) WHERE len(tags) > 0")
def j10(spark: SparkSession, sf: str) -> DataFrame:
    tags = [F.when(F.exists(F.array(*map(F.lit, v)), lambda a: F.col("text").contains(a)), k) for k, v in sorted(CATALOG.items(), key=lambda x: (-len(x[0]), x[0]))]
    return table(spark, sf, "documents").select("doc_id", F.filter(F.array(*tags), lambda t: t.isNotNull()).alias("tags")).where(F.size("tags") > 0)


@query("J11_verify_evidence", f"""WITH {LINES}, e AS (SELECT doc_id, line_no, 3 AS a, 20 AS b, sha256(CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE substr(line, 4, 17) END) AS h FROM lines WHERE line_no = 1) SELECT e.doc_id, sha256(substr(line, a + 1, b - a)) = h AS verified FROM e JOIN lines USING (doc_id, line_no)""")
def j11(spark: SparkSession, sf: str) -> DataFrame:
    l = lines(spark, sf)
    e = l.where("line_no = 1").select("doc_id", "line_no", F.lit(3).alias("a"), F.lit(20).alias("b"), F.sha2(F.when(F.col("doc_id") % 7 == 0, "x").otherwise(F.substring("line", 4, 17)), 256).alias("h"))
    return e.join(l, ["doc_id", "line_no"]).select("doc_id", (F.sha2(F.expr("substr(line, a + 1, b - a)"), 256) == F.col("h")).alias("verified"))


@query("J12_evidence_in_line", f"""WITH {LINES}, e AS (SELECT doc_id, 2 AS line_no, substr(text, 1, 12) AS ev FROM documents) SELECT e.doc_id, coalesce(contains(line, ev), false) AS ok FROM e LEFT JOIN lines USING (doc_id, line_no)""")
def j12(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "documents").select("doc_id", F.lit(2).alias("line_no"), F.substring("text", 1, 12).alias("ev"))
    return e.join(lines(spark, sf), ["doc_id", "line_no"], "left").select("doc_id", F.coalesce(F.col("line").contains(F.col("ev")), F.lit(False)).alias("ok"))


@query("J13_excluded_questions", f"""WITH {RECORDS} SELECT id FROM rec WHERE lower(question) NOT IN (SELECT lower(question) FROM rec WHERE split = 'test')""")
def j13(spark: SparkSession, sf: str) -> DataFrame:
    r = records(spark, sf).withColumn("q", F.lower("question"))
    return r.join(r.where("split = 'test'").select("q"), "q", "left_anti").select("id")


@query("J14_label_grid", "SELECT a || b || c AS label FROM (VALUES ('north'), ('south'), ('old')) x(a), (VALUES ('hill'), ('wood')) y(b), (VALUES ('ton'), ('by'), ('ford')) z(c) WHERE NOT EXISTS (SELECT 1 FROM documents WHERE contains(text, a || b || c))")
def j14(spark: SparkSession, sf: str) -> DataFrame:
    v = lambda xs, n: spark.createDataFrame([(x,) for x in xs], f"{n} string")
    grid = v(["north", "south", "old"], "a").crossJoin(v(["hill", "wood"], "b")).crossJoin(v(["ton", "by", "ford"], "c")).select(F.concat("a", "b", "c").alias("label"))
    used = table(spark, sf, "documents").join(F.broadcast(grid), F.col("text").contains(F.col("label"))).select("label").distinct()
    return grid.join(used, "label", "left_anti")


@query("J15_distractors", f"""WITH {RECORDS}, e AS (SELECT fact_id, family, count(*) AS freq, length(fact_id) AS n FROM rec GROUP BY fact_id, family), c AS (SELECT a.fact_id AS target, b.fact_id AS other, a.family, row_number() OVER (PARTITION BY a.fact_id, a.family ORDER BY CASE WHEN greatest(a.freq, b.freq) <= 2 * least(a.freq, b.freq) AND a.n = b.n THEN 0 ELSE 1 END, abs(a.n - b.n), abs(a.freq - b.freq), sha256(a.fact_id || '|' || b.fact_id)) AS k FROM e a JOIN e b ON a.family = b.family AND a.fact_id <> b.fact_id) SELECT target, family, other, k FROM c WHERE k <= 3""")
def j15(spark: SparkSession, sf: str) -> DataFrame:
    e = records(spark, sf).groupBy("fact_id", "family").agg(F.count(F.lit(1)).alias("freq")).withColumn("n", F.length("fact_id"))
    return nearest_facts(e)


@query("J16_false_answers", f"""WITH {RECORDS}, p AS (SELECT id, split, answer, row_number() OVER (PARTITION BY split ORDER BY sha256(answer), id) AS k, count(*) OVER (PARTITION BY split) AS n FROM rec) SELECT a.id, b.id AS other_id FROM p a JOIN p b ON a.split = b.split AND b.k = a.k % a.n + 1 WHERE a.answer <> b.answer""")
def j16(spark: SparkSession, sf: str) -> DataFrame:
    # Each row takes the next answer of its split in hash order: an equi join on a rank, not all pairs.
    p = numbered_within(records(spark, sf).select("id", "split", "answer"), ["split"], [F.sha2("answer", 256), F.col("id")], total=True)
    b = p.select(F.col("id").alias("other_id"), "split", F.col("answer").alias("other"), F.col("k").alias("want"))
    return p.withColumn("want", (F.col("k") + 1) % F.col("n")).join(b, ["split", "want"]).where("answer <> other").select("id", "other_id")


@query("J17_overlap", f"""WITH {RECORDS} SELECT count(*) AS n FROM (SELECT fact_id FROM rec WHERE split = 'train' INTERSECT SELECT fact_id FROM rec WHERE split <> 'train')""")
def j17(spark: SparkSession, sf: str) -> DataFrame:
    r = records(spark, sf)
    return r.where("split = 'train'").select("fact_id").intersect(r.where("split <> 'train'").select("fact_id")).agg(F.count(F.lit(1)).alias("n"))


@query("J18_before_after", """SELECT a.l_orderkey AS run, b.l_linenumber AS step, b.l_extendedprice - a.l_extendedprice AS delta FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1""")
def j18(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("step"), "l_extendedprice")
    before = l.select("run", (F.col("step") + 1).alias("step"), F.col("l_extendedprice").alias("old"))
    return l.join(before, ["run", "step"]).select("run", "step", (F.col("l_extendedprice") - F.col("old")).alias("delta"))


@query("J19_latest_wins", "SELECT user_id, event_type, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def j19(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("value"))


@query("F6_decontaminate", r"""WITH b AS (SELECT item_id, regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') AS p FROM benchmark), d AS (SELECT doc_id, regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') AS t FROM documents) SELECT doc_id, min(item_id) AS item_id, count(*) AS n_items FROM d JOIN b ON p <> '' AND contains(t, p) GROUP BY doc_id""")
def f6(spark: SparkSession, sf: str) -> DataFrame:
    prompts = table(spark, sf, "benchmark").select("item_id", X.alnum_lower("text").alias("quote"))
    docs = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", X.alnum_lower("text").alias("body"))
    return containing(docs, prompts).groupBy("doc_id").agg(F.min("item_id").alias("item_id"), F.count(F.lit(1)).alias("n_items"))


@query("D1_exact_groups", """SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS keep_id FROM documents GROUP BY text HAVING count(*) > 1""")
def d1(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("keep_id")).where("n > 1")


@query("D2_repeated_headings", f"""WITH {LINES} SELECT doc_id, line, list(line_no ORDER BY line_no) AS line_nos FROM lines WHERE length(line) BETWEEN 1 AND 80 GROUP BY doc_id, line HAVING count(*) > 1""")
def d2(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).where(F.length("line").between(1, 80)).groupBy("doc_id", "line").agg(F.sort_array(F.collect_list("line_no")).alias("line_nos")).where(F.size("line_nos") > 1)


_SHARED = f"""{LINES}, own AS (SELECT DISTINCT doc_id, line FROM lines WHERE length(line) >= 40), sig AS (SELECT doc_id, sha256(string_agg(line, chr(10) ORDER BY line)) AS s FROM own GROUP BY doc_id),
class AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS class_id FROM sig), k AS (SELECT own.doc_id, line FROM own JOIN class ON own.doc_id = class.doc_id AND class_id = own.doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(length(a.line))::BIGINT AS shared FROM k a JOIN k b ON a.line = b.line AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b, sum(n)::BIGINT AS shared FROM (SELECT min(doc_id) OVER (PARTITION BY line) AS a, doc_id AS b, length(line) AS n FROM own) WHERE a < b GROUP BY a, b)"""


@query("D3_line_classes", f"WITH {_SHARED} SELECT doc_id, class_id FROM class")
def d3_classes(spark: SparkSession, sf: str) -> DataFrame:
    return D.line_classes(lines(spark, sf))


@query("D3_shared_line_pairs", f"WITH {_SHARED} SELECT a, b, shared FROM pairs WHERE shared >= 100")
def d3(spark: SparkSession, sf: str) -> DataFrame:
    return D.shared_line_pairs(D.of_classes(lines(spark, sf)), least_shared=100)


@query("D3_block_similarity")
def d3b(spark: SparkSession, sf: str) -> DataFrame:
    m = D.similar_pairs(table(spark, sf, "documents").select("doc_id", "text"))
    return m.withColumn("confidence", F.when(F.col("coverage") >= 0.98, "high").otherwise("review"))


@query("D4_keep_best", f"""WITH {_SHARED}, d AS (SELECT doc_id, n_chars - 150 * (length(text) - length(replace(text, '%%%', ''))) // 3 AS q, n_chars FROM documents) SELECT a, b, CASE WHEN (x.q, x.n_chars, -a) > (y.q, y.n_chars, -b) THEN a ELSE b END AS keep_id FROM links JOIN d x ON x.doc_id = a JOIN d y ON y.doc_id = b""")
def d4(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "documents").select("doc_id", F.struct((F.col("n_chars") - F.floor(150 * (F.length("text") - F.length(F.replace("text", F.lit("%%%"), F.lit("")))) / 3)).alias("q"), "n_chars", (-F.col("doc_id")).alias("o")).alias("s"))
    p = D.line_links(lines(spark, sf)).join(q.selectExpr("doc_id AS a", "s AS sa"), "a").join(q.selectExpr("doc_id AS b", "s AS sb"), "b")
    return p.select("a", "b", (-F.greatest("sa", "sb")["o"]).alias("keep_id"))


@query("D5_shortest_per_target", f"WITH {_SHARED} SELECT b, arg_min(a, shared * 1000000000 + a) AS a, min(shared) AS shared FROM links GROUP BY b")
def d5(spark: SparkSession, sf: str) -> DataFrame:
    return D.first_by(D.line_links(lines(spark, sf)), ["b"], [F.col("shared"), F.col("a")]).select("b", "a", "shared")


@query("D6_remove_ranges", f"""WITH {_SHARED}, m AS (SELECT doc_id, count(*) AS n_lines FROM lines GROUP BY doc_id) SELECT b AS doc_id, 1 AS start_line, n_lines AS end_line, count(*) AS n_pairs FROM links JOIN m ON m.doc_id = b GROUP BY b, n_lines""")
def d6(spark: SparkSession, sf: str) -> DataFrame:
    m = lines(spark, sf).groupBy(F.col("doc_id").alias("b")).agg(F.count(F.lit(1)).alias("end_line"))
    p = D.line_links(lines(spark, sf)).groupBy("b").agg(F.count(F.lit(1)).alias("n_pairs"))
    return p.join(m, "b").select(F.col("b").alias("doc_id"), F.lit(1).alias("start_line"), "end_line", "n_pairs")


@query("D7_components", f"""WITH RECURSIVE {_SHARED}, e AS (SELECT a, b FROM links UNION SELECT b, a FROM links), r(node, seen) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen) SELECT node, min(seen) AS component FROM r GROUP BY node""")
def d7(spark: SparkSession, sf: str) -> DataFrame:
    return connected_components(D.line_links(lines(spark, sf)))


@query("D7_same_number", f"""WITH RECURSIVE {_SHARED}, num AS (SELECT doc_id, n_chars // 10 AS k FROM documents), same AS (SELECT min(doc_id) OVER (PARTITION BY k) AS a, doc_id AS b FROM num), e0 AS (SELECT a, b FROM links UNION SELECT a, b FROM same WHERE a < b), e AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0), r(node, seen) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen) SELECT node, min(seen) AS component FROM r GROUP BY node""")
def d7_same(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of the same number (here: n_chars in tens) or with a common line, and what they reach."""
    own = table(spark, sf, "documents").select("doc_id", F.floor(F.col("n_chars") / 10).alias("k"))
    least = own.groupBy("k").agg(F.min("doc_id").alias("a"), F.count(F.lit(1)).alias("size"))
    same = salted_join(own.withColumnRenamed("doc_id", "b"), least, ["k"], "size", F.col("b")).where("a < b").select("a", "b")
    return connected_components(D.line_links(lines(spark, sf)).select("a", "b").unionByName(same))


@query("D8_facts", f"""WITH {RECORDS}, q AS (SELECT *, row_number() OVER (PARTITION BY trim(regexp_replace(question, '\\s+', ' ', 'g'), ' ') ORDER BY sha256(id::VARCHAR)) AS k FROM rec), u AS (SELECT *, row_number() OVER (PARTITION BY fact_id, family ORDER BY sha256(id::VARCHAR)) AS f FROM q WHERE k = 1), r AS (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY CASE WHEN f = 1 THEN 0 ELSE 1 END, sha256(id::VARCHAR)) AS n FROM u)
SELECT id, 'selected' AS outcome FROM r WHERE n <= 2 UNION ALL SELECT id, 'too_many_for_fact' FROM r WHERE n > 2 UNION ALL SELECT id, 'duplicate_question' FROM q WHERE k > 1""")
def d8(spark: SparkSession, sf: str) -> DataFrame:
    kept, rejected = D.limited_facts(records(spark, sf), [F.sha2(F.col("id").cast("string"), 256)])
    return kept.select("id", F.lit("selected").alias("outcome")).unionByName(rejected.withColumnRenamed("reason", "outcome"))


@query("D9_first_seen", f"""WITH {RECORDS} SELECT min(id) AS id, count(*) AS n FROM rec GROUP BY substr(lower(question), 1, 3)""")
def d9(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).groupBy(F.substring(F.lower("question"), 1, 3).alias("k")).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).drop("k")


@query("D10_unique_only", f"""WITH {LINES} SELECT line, min(doc_id) AS doc_id FROM lines WHERE length(line) >= 20 GROUP BY line HAVING count(*) = 1""")
def d10(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).where(F.length("line") >= 20).groupBy("line").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")


@query("D11_disambiguate", f"""WITH {RECORDS}, k AS (SELECT id, question, row_number() OVER (PARTITION BY substr(question, 1, 2) ORDER BY id) AS k FROM rec) SELECT id, CASE WHEN k = 1 THEN question ELSE ['Once more: ', 'Again: ', 'Also: '][(k - 2) % 3 + 1] || question END AS question FROM k""")
def d11(spark: SparkSession, sf: str) -> DataFrame:
    k = F.row_number().over(W.partitionBy(F.substring("question", 1, 2)).orderBy("id"))
    label = F.element_at(F.array(*map(F.lit, ["Once more: ", "Again: ", "Also: "])), ((F.col("k") - 2) % 3 + 1).cast("int"))
    return records(spark, sf).withColumn("k", k).select("id", F.when(F.col("k") == 1, F.col("question")).otherwise(F.concat(F.when(F.col("k") > 1, label), "question")).alias("question"))


@query("D12_conflicts", f"""WITH {_SHARED}, act AS (SELECT a AS doc_id, 'keep' AS action FROM links WHERE (a + b) % 2 = 0 UNION ALL SELECT b, 'remove' FROM links WHERE (a + b) % 2 = 0 UNION ALL SELECT a, 'remove' FROM links WHERE (a + b) % 2 = 1 UNION ALL SELECT b, 'keep' FROM links WHERE (a + b) % 2 = 1) SELECT doc_id FROM act GROUP BY doc_id HAVING count(DISTINCT action) = 2""")
def d12(spark: SparkSession, sf: str) -> DataFrame:
    even = (F.col("a") + F.col("b")) % 2 == 0
    k = D.line_links(lines(spark, sf)).select(F.explode(F.array(F.struct(F.col("a").alias("doc_id"), F.when(even, "keep").otherwise("remove").alias("action")), F.struct(F.col("b").alias("doc_id"), F.when(even, "remove").otherwise("keep").alias("action")))).alias("x"))
    return k.groupBy("x.doc_id").agg(F.count_distinct("x.action").alias("n")).where("n = 2").select("doc_id")


@query("T1_union", f"""WITH {RECORDS} SELECT origin, count(*) AS n FROM (SELECT id, 'even' AS origin FROM rec WHERE id % 2 = 0 UNION ALL SELECT id, 'third' FROM rec WHERE id % 3 = 0) GROUP BY origin""")
def t1(spark: SparkSession, sf: str) -> DataFrame:
    r = records(spark, sf)
    part = lambda c, n: r.where(c).select("id", F.lit(n).alias("origin"))
    return part("id % 2 = 0", "even").unionByName(part("id % 3 = 0", "third")).groupBy("origin").agg(F.count(F.lit(1)).alias("n"))


@query("T2_intersection", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def t2(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.where("o_orderstatus = 'F'").select("o_custkey").intersect(o.where("o_orderstatus = 'O'").select("o_custkey"))


@query("T3_difference", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def t3(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.where("o_orderstatus = 'F'").select("o_custkey").distinct().join(o.where("o_orderstatus = 'O'").select("o_custkey"), "o_custkey", "left_anti")


@query("T4_set_equality", f"""WITH {RECORDS}, s AS (SELECT split, list_sort(list(DISTINCT family)) AS families FROM rec GROUP BY split) SELECT split, families = ['chat', 'qa', 'refusal', 'rewrite', 'summary'] AS complete FROM s""")
def t4(spark: SparkSession, sf: str) -> DataFrame:
    want = F.array(*map(F.lit, ["chat", "qa", "refusal", "rewrite", "summary"]))
    return records(spark, sf).groupBy("split").agg((F.array_sort(F.collect_set("family")) == want).alias("complete"))
