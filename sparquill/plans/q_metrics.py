"""Queries of text and answer metrics (M)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.functions import metrics as M
from sparquill.functions import text as X
from sparquill.operators.aggregates import gates
from sparquill.operators.staging import importable
from sparquill.plans.registry import query
from sparquill.sources.tables import RECORDS, records, spread, table


@query("M1_gram_repetition", f"WITH {RECORDS}, g AS (SELECT id, count(*) AS n, count(DISTINCT g) AS d FROM (SELECT id, substr(answer, i, 4) AS g FROM (SELECT id, answer, unnest(range(1, length(answer) - 2)) AS i FROM rec)) GROUP BY id) SELECT rec.id, coalesce(1 - d / n, 0.0) AS repetition FROM rec LEFT JOIN g USING (id)")
def m1(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).select("id", M.gram_repetition("answer", 4).alias("repetition"))


_RUNS = "c AS (SELECT id, i, ch, CASE WHEN ch = lag(ch) OVER (PARTITION BY id ORDER BY i) THEN 0 ELSE 1 END AS fresh FROM (SELECT id, generate_subscripts(x, 1) AS i, unnest(x) AS ch FROM (SELECT id, string_split(answer, '') AS x FROM rec WHERE length(answer) > 0)))"


@query("M2_longest_run", f"WITH {RECORDS}, {_RUNS}, r AS (SELECT id, sum(fresh) OVER (PARTITION BY id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM c) SELECT id, max(n) AS longest FROM (SELECT id, run, count(*) AS n FROM r GROUP BY id, run) GROUP BY id")
def m2(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).where("length(answer) > 0").select("id", M.longest_run("answer").cast("long").alias("longest"))


@query("M3_adjacent", f"WITH {RECORDS}, {_RUNS} SELECT id, CASE WHEN count(*) >= 2 THEN (count(*) - sum(fresh)) / (count(*) - 1) ELSE 0 END AS rate FROM c GROUP BY id")
def m3(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).where("length(answer) > 0").select("id", M.adjacent_repetition("answer").alias("rate"))


@query("M4_script_ratio", r"SELECT doc_id, len(regexp_extract_all(text, '[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]')) / length(text) AS han, len(regexp_extract_all(text, '[\x{c0}-\x{24f}]')) / length(text) AS latin_extended FROM documents WHERE length(text) > 0")
def m4(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("length(text) > 0").select("doc_id", M.han_ratio("text").alias("han"), (F.regexp_count("text", F.lit(r"[\x{c0}-\x{24f}]")) / F.length("text")).alias("latin_extended"))


@query("M5_corpus_overlap")
def m5(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_overlap(table(spark, sf, "benchmark"), table(spark, sf, "documents"))


def corpus_overlap(benchmark: DataFrame, docs: DataFrame, least: int = 8) -> DataFrame:
    """item_id, overlap: the longest part of each benchmark item that a document has word for word, if it has at least
    `least` characters. Every document runs through an automaton of the items, so parts that are common in the corpus
    count like rare ones. Benchmarks are small by nature: the items go along with the tasks."""
    importable(benchmark.sparkSession)
    ids, texts = zip(*benchmark.where("text IS NOT NULL").select("item_id", F.trim("text").alias("text")).collect() or [((), ())], strict=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = M.SubstringAutomaton(texts)
        for b in batches:
            for t in b["text"]:
                found.run(t or "")
        yield pd.DataFrame({"item_id": ids, "overlap": found.longest(texts)})

    parts = spread(docs.select("text")).mapInPandas(run, f"item_id {benchmark.schema['item_id'].dataType.simpleString()}, overlap int")
    return parts.groupBy("item_id").agg(F.max("overlap").alias("overlap")).where(F.col("overlap") >= least)


_PAIRS = f"WITH {RECORDS}, p AS (SELECT id, question AS a, answer AS b FROM rec)"


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(records(spark, sf).select("id", F.col("question").alias("a"), F.col("answer").alias("b")))


@query("M6_common_substring")
def m6(spark: SparkSession, sf: str) -> DataFrame:
    p = _pairs(spark, sf).withColumn("common", M.longest_common_substring("a", "b"))
    return p.select("id", "common", (F.col("common") / F.length("b") >= 0.5).alias("review"))


@query("M7_degeneration", f"WITH {RECORDS} SELECT id, len(list_distinct(string_split(answer, ''))) / length(answer) AS unique_ratio, len(list_distinct(string_split(answer, ''))) / length(answer) < 0.05 AS low_variety, length(answer) < 20 AS short FROM rec WHERE length(answer) > 0")
def m7(spark: SparkSession, sf: str) -> DataFrame:
    u = M.unique_ratio("answer")
    return records(spark, sf).where("length(answer) > 0").select("id", u.alias("unique_ratio"), (u < 0.05).alias("low_variety"), (F.length("answer") < 20).alias("short"))


@query("M8_severe_loop")
def m8(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", M.severe_loop("text").alias("loop"))


@query("M9_exact_or_contains", f"WITH {RECORDS}, g AS (SELECT id, regexp_replace(answer, '[.,!?]', '', 'g') AS a, regexp_replace(substr(question, 1, turn::INT + 1), '[.,!?]', '', 'g') AS gold FROM rec) SELECT id, CASE WHEN length(gold) < 2 THEN a = gold ELSE contains(a, gold) END AS correct FROM g")
def m9(spark: SparkSession, sf: str) -> DataFrame:
    g = records(spark, sf).select("id", F.regexp_replace("answer", "[.,!?]", "").alias("a"), F.regexp_replace(F.expr("substr(question, 1, int(turn) + 1)"), "[.,!?]", "").alias("gold"))
    return g.select("id", F.when(F.length("gold") < 2, F.col("a") == F.col("gold")).otherwise(F.col("a").contains(F.col("gold"))).alias("correct"))


@query("M10_multiset_f1", _PAIRS + ", c AS (SELECT id, ch, sum(x) AS x, sum(y) AS y FROM (SELECT id, unnest(string_split(a, '')) AS ch, 1 AS x, 0 AS y FROM p UNION ALL SELECT id, unnest(string_split(b, '')), 0, 1 FROM p) GROUP BY id, ch), o AS (SELECT id, sum(least(x, y)) AS shared FROM c GROUP BY id) SELECT p.id, 2 * shared / (length(a) + length(b)) AS f1, lower(a) = lower(b) AS exact FROM p JOIN o USING (id)")
def m10(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("id", M.multiset_f1(F.col("a"), F.col("b")).alias("f1"), (F.lower("a") == F.lower("b")).alias("exact"))


@query("M11_matching_ratio")
def m11(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("id", M.matching_ratio("a", "b").alias("ratio"))


@query("M12_terms", f"WITH {RECORDS} SELECT id, contains(answer, 'e') AND contains(answer, 'n') AND NOT (contains(answer, 'scum') OR contains(answer, '%%%')) AS passed, (CASE WHEN contains(answer, 'tion') OR contains(answer, 'ción') THEN 1 ELSE 0 END + CASE WHEN contains(answer, 'the') OR contains(answer, 'der') THEN 1 ELSE 0 END) AS keypoints FROM rec")
def m12(spark: SparkSession, sf: str) -> DataFrame:
    lit = lambda *xs: F.array(*map(F.lit, xs))
    a = F.col("answer")
    return records(spark, sf).select("id", M.term_score(a, lit("e", "n"), lit("scum", "%%%")).alias("passed"), M.alternatives_hit(a, F.array(lit("tion", "ción"), lit("the", "der"))).alias("keypoints"))


@query("M13_rule_scorer", f"WITH {RECORDS} SELECT id, CASE family WHEN 'qa' THEN contains(answer, 'the') WHEN 'chat' THEN length(answer) >= 100 WHEN 'rewrite' THEN NOT contains(answer, '%%%') WHEN 'summary' THEN length(answer) < length(question) ELSE contains(answer, 'der ') END AND regexp_matches(answer, '[.!?]$') AS passed FROM rec")
def m13(spark: SparkSession, sf: str) -> DataFrame:
    a, f = F.col("answer"), F.col("family")
    rule = F.when(f == "qa", a.contains("the")).when(f == "chat", F.length(a) >= 100).when(f == "rewrite", ~a.contains("%%%")).when(f == "summary", F.length(a) < F.length("question")).otherwise(a.contains("der "))
    return records(spark, sf).select("id", (rule & a.rlike("[.!?]$")).alias("passed"))


@query("M14_relations", "WITH e AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem) SELECT x.a, x.b, x.a = x.b AS self_relation, y.a IS NOT NULL AND x.a <> x.b AS two_cycle FROM e x LEFT JOIN e y ON y.a = x.b AND y.b = x.a")
def m14(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "lineitem").selectExpr("l_partkey AS a", "l_suppkey AS b").distinct()
    back = e.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(True).alias("back"))
    return e.join(back, ["a", "b"], "left").select("a", "b", (F.col("a") == F.col("b")).alias("self_relation"), (F.col("back").isNotNull() & (F.col("a") != F.col("b"))).alias("two_cycle"))


_M15 = "m AS (SELECT count(*)::DOUBLE AS documents, (count(DISTINCT text) / count(*))::DOUBLE AS unique_ratio, max(n_chars)::DOUBLE AS longest, avg(CASE WHEN contains(text, '!!') THEN 1.0 ELSE 0.0 END)::DOUBLE AS shout_rate FROM documents)"


@query("M15_gates", f"WITH {_M15}, g AS (SELECT 'documents' AS name, documents AS actual, 100.0::DOUBLE AS low, 1e12::DOUBLE AS high FROM m UNION ALL SELECT 'unique_ratio', unique_ratio, 0.95, 1 FROM m UNION ALL SELECT 'longest', longest, 0, 1e6 FROM m UNION ALL SELECT 'shout_rate', shout_rate, 0, 0.05 FROM m) SELECT *, actual BETWEEN low AND high AS passed FROM g")
def m15(spark: SparkSession, sf: str) -> DataFrame:
    h = F.unhex(F.sha2("text", 256))
    n = F.count(F.lit(1))
    return gates(table(spark, sf, "documents"), {"documents": (n, 100, 1e12), "unique_ratio": (F.count_distinct(h) / n, 0.95, 1), "longest": (F.max("n_chars"), 0, 1e6), "shout_rate": (F.avg(F.col("text").contains("!!").cast("double")), 0, 0.05)})


@query("M16_selection_score", "SELECT source, 0.7 * avg(quality) - 0.3 * avg(toxic) + 0.001 * count(*) AS score FROM documents JOIN labels USING (doc_id) GROUP BY source")
def m16(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id")
    return d.groupBy("source").agg((0.7 * F.avg("quality") - 0.3 * F.avg("toxic") + 0.001 * F.count(F.lit(1))).alias("score"))


@query("M17_eligible", "SELECT source, bool_and(quality = 1) AS strict, bool_and(quality = 1 OR toxic = 0) AND count(*) >= 5 AS eligible FROM documents JOIN labels USING (doc_id) GROUP BY source")
def m17(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id")
    return d.groupBy("source").agg(F.bool_and(F.col("quality") == 1).alias("strict"), (F.bool_and((F.col("quality") == 1) | (F.col("toxic") == 0)) & (F.count(F.lit(1)) >= 5)).alias("eligible"))


@query("M18_claims", """WITH c(kind, a, b, claim) AS (VALUES ('first', 'idiot', NULL, 28), ('cooccur', 'idiot', 'clown', 28), ('count', 'scum', NULL, 3), ('order', 'idiot', 'clown', 1)), f AS (SELECT c.*, (SELECT min(doc_id) FROM documents WHERE contains(text, a)) AS fa, (SELECT min(doc_id) FROM documents WHERE contains(text, b)) AS fb, (SELECT min(doc_id) FROM documents WHERE contains(text, a) AND contains(text, b)) AS fab, (SELECT sum((length(text) - length(replace(text, a, ''))) // length(a)) FROM documents) AS n FROM c)
SELECT kind, coalesce(CASE kind WHEN 'first' THEN fa = claim WHEN 'cooccur' THEN fab = claim WHEN 'count' THEN n = claim ELSE (fa <= fb) = (claim = 1) END, false) AS verified FROM f""")
def m18(spark: SparkSession, sf: str) -> DataFrame:
    t, words = F.col("text"), ["idiot", "clown", "scum"]
    d = F.col("doc_id")
    facts = table(spark, sf, "documents").agg(
        *[F.min(F.when(t.contains(w), d)).alias(f"first_{w}") for w in words], *[F.sum(X.occurrences("text", w)).alias(f"n_{w}") for w in words], F.min(F.when(t.contains("idiot") & t.contains("clown"), d)).alias("together")
    )
    rows = [("first", F.col("first_idiot") == 28), ("cooccur", F.col("together") == 28), ("count", F.col("n_scum") == 3), ("order", F.col("first_idiot") <= F.col("first_clown"))]
    return facts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(v, F.lit(False)).alias("verified")) for k, v in rows])).alias("r")).select("r.*")
