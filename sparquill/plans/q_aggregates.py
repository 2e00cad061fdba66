"""Queries of aggregations (A), windows (W) and splits (Q)."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparquill.functions import text as X
from sparquill.operators import aggregates as A
from sparquill.operators import dedup as D
from sparquill.operators import sampling as Q
from sparquill.operators.sampling import numbered_within
from sparquill.plans.registry import query
from sparquill.sources.tables import LINES, RECORDS, lines, records, table

def N() -> Column:
    """The count of rows."""
    return F.count(F.lit(1))


@query("A1_count", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def a1(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("source").agg(N().alias("n"))


@query("A2_two_key_rollup", "SELECT lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang, source), (lang), ())")
def a2(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").rollup("lang", "source").agg(N().alias("n"))


@query("A3_exploded_counts", "SELECT tag, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN contains(text, '!!') THEN 'shout' END, CASE WHEN contains(text, '%%%') THEN 'symbols' END, CASE WHEN contains(text, ' | ') THEN 'table' END], lambda x: x IS NOT NULL)) AS tag FROM documents) GROUP BY tag")
def a3(spark: SparkSession, sf: str) -> DataFrame:
    tags = X.matched_rules("text", {"shout": "!!", "symbols": "%%%", "table": r" \| "})
    return table(spark, sf, "documents").select(F.explode(tags).alias("tag")).groupBy("tag").agg(N().alias("n"))


@query("A4_distinct", "SELECT lang, count(DISTINCT text) AS n_texts, count(DISTINCT text) / count(*) AS unique_ratio FROM documents GROUP BY lang")
def a4(spark: SparkSession, sf: str) -> DataFrame:
    # Texts are hashed before the exchange, so the distinct aggregation moves 32 bytes a row, not the text.
    d = table(spark, sf, "documents").select("lang", F.unhex(F.sha2("text", 256)).alias("h"))
    return d.groupBy("lang").agg(F.count_distinct("h").alias("n_texts"), (F.count_distinct("h") / N()).alias("unique_ratio"))


@query("A5_repeats", f"WITH {LINES}, c AS (SELECT line, count(*) AS n FROM lines GROUP BY line) SELECT count(*) FILTER (WHERE n > 1) AS repeated_values, sum(n - 1)::BIGINT AS extra_rows, max(n) AS max_count FROM c")
def a5(spark: SparkSession, sf: str) -> DataFrame:
    return A.repeats(lines(spark, sf), F.col("line"))


_SPLIT = "('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT % 100"


def _docs_split(spark: SparkSession, sf: str) -> DataFrame:
    b = X.bucket(F.sha2(F.col("doc_id").cast("string"), 256))
    return table(spark, sf, "documents").withColumn("split", F.when(b < 80, "train").when(b < 90, "val").otherwise("test"))


_DOCS_SPLIT = f"s AS (SELECT *, CASE WHEN {_SPLIT} < 80 THEN 'train' WHEN {_SPLIT} < 90 THEN 'val' ELSE 'test' END AS split FROM documents)"


@query("A6_leakage", f"WITH {_DOCS_SPLIT} SELECT sha256(text) AS value, count(DISTINCT split) AS n_splits, count(*) AS n_rows FROM s GROUP BY text HAVING count(DISTINCT split) > 1")
def a6(spark: SparkSession, sf: str) -> DataFrame:
    return D.crossing(_docs_split(spark, sf).select(F.sha2("text", 256).alias("value"), "split"), "value")


@query("A7_leakage_exempt", f"WITH {_DOCS_SPLIT} SELECT sha256(text) AS value, count(*) AS n_rows FROM s GROUP BY text HAVING count(DISTINCT split) > 1 AND NOT bool_and(lang = 'en')")
def a7(spark: SparkSession, sf: str) -> DataFrame:
    g = _docs_split(spark, sf).groupBy(F.sha2("text", 256).alias("value")).agg(F.count_distinct("split").alias("k"), N().alias("n_rows"), F.bool_and(F.col("lang") == "en").alias("exempt"))
    return g.where("k > 1 AND NOT exempt").select("value", "n_rows")


@query("A8_lengths", "SELECT lang, min(n_chars) AS min, quantile_cont(n_chars, 0.5) AS p50, quantile_cont(n_chars, 0.9) AS p90, quantile_cont(n_chars, 0.95) AS p95, quantile_cont(n_chars, 0.99) AS p99, max(n_chars) AS max, avg(n_chars) AS mean FROM documents GROUP BY lang")
def a8(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("lang").agg(*A.length_summary(F.col("n_chars")))


@query("A9_family_report", f"WITH {RECORDS} SELECT family, count(*) AS n, count(*) / sum(count(*)) OVER () AS share, count(DISTINCT question) / count(*) AS unique_questions, avg(length(answer)) AS mean_answer, sum(CASE WHEN contains(answer, 'der ') THEN 1 ELSE 0 END)::BIGINT AS refusals FROM rec GROUP BY family")
def a9(spark: SparkSession, sf: str) -> DataFrame:
    g = records(spark, sf).groupBy("family").agg(N().alias("n"), (F.count_distinct("question") / N()).alias("unique_questions"), F.avg(F.length("answer")).alias("mean_answer"), F.count_if(F.col("answer").contains("der ")).alias("refusals"))
    return A.with_share(g, "n", "share")


@query("A10_dimensions", f"WITH {RECORDS}, m(family, dimension) AS (VALUES ('qa', 'knowledge'), ('chat', 'dialogue'), ('rewrite', 'expression'), ('summary', 'expression')) SELECT coalesce(dimension, 'unmapped') AS dimension, count(*) AS n FROM rec LEFT JOIN m USING (family) GROUP BY 1")
def a10(spark: SparkSession, sf: str) -> DataFrame:
    from sparquill.plans.q_text import MAPPING

    m = F.broadcast(spark.createDataFrame(MAPPING, "family string, dimension string"))
    return records(spark, sf).join(m, "family", "left").groupBy(F.coalesce("dimension", F.lit("unmapped")).alias("dimension")).agg(N().alias("n"))


@query("A11_density", "SELECT lang, count(*) AS records, sum(n_chars)::BIGINT AS tokens, count(*) / sum(count(*)) OVER () AS record_share, sum(n_chars) / sum(sum(n_chars)) OVER () AS token_share, (sum(n_chars) / sum(sum(n_chars)) OVER ()) / (count(*) / sum(count(*)) OVER ()) AS density FROM documents GROUP BY lang")
def a11(spark: SparkSession, sf: str) -> DataFrame:
    return A.density(table(spark, sf, "documents"), ["lang"], F.col("n_chars"))


@query("A12_opening_share", f"WITH {RECORDS} SELECT split, avg(CASE WHEN starts_with(question, 'The') OR starts_with(question, 'De') OR starts_with(question, 'In') THEN 1.0 ELSE 0.0 END)::DOUBLE AS share FROM rec GROUP BY split")
def a12(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("question")
    return records(spark, sf).groupBy("split").agg(F.avg((q.startswith("The") | q.startswith("De") | q.startswith("In")).cast("double")).alias("share"))


@query("A13_coverage", "WITH c(term) AS (VALUES ('idiot'), ('oranges'), ('zebra')), m AS (SELECT term, count(d.doc_id) AS n FROM c LEFT JOIN documents d ON contains(text, term) GROUP BY term) SELECT count(*) FILTER (WHERE n > 0) AS matched, count(*) AS terms, count(*) FILTER (WHERE n > 0) / count(*) AS coverage FROM m")
def a13(spark: SparkSession, sf: str) -> DataFrame:
    terms = ["idiot", "oranges", "zebra"]
    seen = table(spark, sf, "documents").agg(*[F.max(F.col("text").contains(t)).alias(t) for t in terms])
    matched = sum((F.col(t).cast("long") for t in terms), F.lit(0))
    return seen.select(matched.alias("matched"), F.lit(3).cast("long").alias("terms"), (matched / 3).alias("coverage"))


@query("A14_merge_stats", "SELECT k, sum(v)::BIGINT AS v FROM (SELECT unnest(map_keys(m)) AS k, unnest(map_values(m)) AS v FROM (SELECT MAP {'chars': n_chars, lang: 1} AS m FROM documents)) GROUP BY k")
def a14(spark: SparkSession, sf: str) -> DataFrame:
    m = F.create_map(F.lit("chars"), "n_chars", "lang", F.lit(1).cast("long"))
    return table(spark, sf, "documents").select(F.explode(m).alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v"))


@query("A15_split_statistics", f"WITH {_DOCS_SPLIT} SELECT split, count(*) AS n, count(DISTINCT source) AS n_sources, sum(n_chars)::BIGINT AS n_chars, sum(n_chars) / sum(sum(n_chars)) OVER () AS share, min(doc_id) AS first_id, max(doc_id) AS last_id, sum(('0x' || substr(sha256(doc_id || '|' || text), 1, 12))::BIGINT)::VARCHAR AS digest FROM s GROUP BY split")
def a15(spark: SparkSession, sf: str) -> DataFrame:
    # The digest of a split is a sum over its rows' digests: it combines before the shuffle, and nothing is gathered.
    row = F.conv(F.substring(F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), "text"), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    g = _docs_split(spark, sf).groupBy("split").agg(N().alias("n"), F.count_distinct("source").alias("n_sources"), F.sum("n_chars").alias("n_chars"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.sum(row).cast("string").alias("digest"))
    return A.with_share(g, "n_chars", "share")


@query("A16_complete_groups", f"WITH {RECORDS} SELECT fact_id, count(*) >= 3 AND count(DISTINCT split) = 1 AND list_sort(list(DISTINCT turn % 2)) = [0] AS complete FROM rec GROUP BY fact_id")
def a16(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).groupBy("fact_id").agg(((N() >= 3) & (F.count_distinct("split") == 1) & (F.array_sort(F.collect_set(F.col("turn") % 2)) == F.array(F.lit(0).cast("long")))).alias("complete"))


@query("A17_quota_check", f"WITH {RECORDS}, q(family, least) AS (VALUES ('qa', 40), ('chat', 50), ('poem', 1)) SELECT family, least, count(id) AS n, greatest(least - count(id), 0) AS deficit FROM q LEFT JOIN rec USING (family) GROUP BY family, least")
def a17(spark: SparkSession, sf: str) -> DataFrame:
    q = spark.createDataFrame([("qa", 40), ("chat", 50), ("poem", 1)], "family string, least int")
    n = records(spark, sf).groupBy("family").agg(N().alias("n"))
    return F.broadcast(q).join(n, "family", "left").select("family", "least", F.coalesce("n", F.lit(0)).alias("n"), F.greatest(F.col("least") - F.coalesce("n", F.lit(0)), F.lit(0)).alias("deficit"))


@query("A18_rates", "SELECT source, avg(CASE WHEN toxic IS NOT NULL THEN toxic END) AS toxic_rate, CASE WHEN sum(quality) > 0 THEN sum(toxic * quality) / sum(quality) END AS toxic_among_good FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def a18(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.groupBy("source").agg(F.avg("toxic").alias("toxic_rate"), F.try_divide(F.sum(F.col("toxic") * F.col("quality")), F.sum("quality")).alias("toxic_among_good"))


@query("A19_max_share", f"WITH {RECORDS}, w AS (SELECT DISTINCT id, substr(c, i, 12) AS w FROM (SELECT id, c, unnest(range(1, length(c) - 10)) AS i FROM (SELECT id, regexp_replace(answer, '\\s+', '', 'g') AS c FROM rec))) SELECT max(n) AS max_count, max(n) / (SELECT count(*) FROM rec) AS max_share FROM (SELECT w, count(*) AS n FROM w GROUP BY w)")
def a19(spark: SparkSession, sf: str) -> DataFrame:
    r = records(spark, sf).select("id", X.compact("answer").alias("c"))
    top = A.most_common_gram(r, "c", 12)
    return top.crossJoin(r.agg(N().alias("rows"))).select("max_count", (F.col("max_count") / F.col("rows")).alias("max_share"))


@query("A20_accuracy", "SELECT lang, count(*) AS total, sum(quality)::BIGINT AS passed, avg(quality) AS accuracy FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def a20(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id")
    return d.groupBy("lang").agg(N().alias("total"), F.sum("quality").alias("passed"), F.avg("quality").alias("accuracy"))


@query("A21_weighted_loss", "SELECT l_returnflag, sum(l_tax * l_quantity) / sum(l_quantity) AS loss, exp(sum(l_tax * l_quantity) / sum(l_quantity)) AS perplexity FROM lineitem GROUP BY l_returnflag")
def a21(spark: SparkSession, sf: str) -> DataFrame:
    loss = F.sum(F.col("l_tax") * F.col("l_quantity")) / F.sum("l_quantity")
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(loss.alias("loss"), F.exp(loss).alias("perplexity"))


@query("A22_mention_leaders", "WITH m AS (SELECT lang, name, sum((length(text) - length(replace(text, name, ''))) // length(name))::BIGINT AS n FROM documents, (VALUES ('the'), ('de'), ('en'), ('tion')) t(name) GROUP BY lang, name) SELECT lang, name, n FROM (SELECT *, rank() OVER (PARTITION BY lang ORDER BY n DESC) AS r FROM m) WHERE r = 1")
def a22(spark: SparkSession, sf: str) -> DataFrame:
    names = ["the", "de", "en", "tion"]
    sums = table(spark, sf, "documents").groupBy("lang").agg(*[F.sum(X.occurrences("text", n)).alias(n) for n in names])
    m = sums.select("lang", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("n")) for n in names])).alias("m")).select("lang", "m.*")
    return m.withColumn("r", F.rank().over(W.partitionBy("lang").orderBy(F.desc("n")))).where("r = 1").drop("r")


@query("A23_entity_statistics", f"WITH {_DOCS_SPLIT}, w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS name FROM s WHERE split = 'train') SELECT name, count(*) AS tf, count(DISTINCT doc_id) AS df FROM w GROUP BY name HAVING count(*) >= 5")
def a23(spark: SparkSession, sf: str) -> DataFrame:
    w = _docs_split(spark, sf).where("split = 'train'").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("([A-Z][a-z]+)"))).alias("name"))
    # Counts within a document first: document frequency is then a plain count, which combines before the shuffle.
    own = w.groupBy("doc_id", "name").agg(N().alias("n"))
    return own.groupBy("name").agg(F.sum("n").alias("tf"), N().alias("df")).where("tf >= 5")


@query("A24_means", "SELECT role, avg(length(text)) AS mean_chars, max(length(text)) AS max_chars, count(*) FILTER (WHERE length(text) > 500) AS n_long FROM conversations GROUP BY role")
def a24(spark: SparkSession, sf: str) -> DataFrame:
    n = F.length("text")
    return table(spark, sf, "conversations").groupBy("role").agg(F.avg(n).alias("mean_chars"), F.max(n).cast("long").alias("max_chars"), F.count_if(n > 500).alias("n_long"))


@query("A25_reciprocal_rank", "WITH r AS (SELECT l_orderkey, l_linenumber, l_returnflag, rank() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC) AS r FROM lineitem) SELECT l_returnflag, avg(1.0 / r)::DOUBLE AS mrr, avg(CASE WHEN r = 1 THEN 1.0 ELSE 0.0 END)::DOUBLE AS top1 FROM r WHERE l_linenumber = 1 GROUP BY l_returnflag")
def a25(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "lineitem").withColumn("r", F.rank().over(W.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice")))).where("l_linenumber = 1")
    return r.groupBy("l_returnflag").agg(F.avg(1.0 / F.col("r")).alias("mrr"), F.avg((F.col("r") == 1).cast("double")).alias("top1"))


@query("W1_running_position", f"WITH {LINES} SELECT doc_id, line_no, sum(length(line)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)::BIGINT AS chars_so_far FROM lines")
def w1(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).select("doc_id", "line_no", F.sum(F.length("line")).over(W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)).alias("chars_so_far"))


_CUM = """g AS (SELECT source, sum(n_chars)::BIGINT AS n, sha256('7|' || source) AS h FROM documents GROUP BY source), o AS (SELECT *, sum(n) OVER (ORDER BY h, source ROWS UNBOUNDED PRECEDING) - n AS before, sum(n) OVER () AS total, count(*) OVER () - row_number() OVER (ORDER BY h, source) AS after FROM g)
SELECT source, n, CASE WHEN after = 1 THEN 'val' WHEN after = 0 THEN 'test' WHEN before < total * 0.9 THEN 'train' WHEN before < total * 0.95 THEN 'val' ELSE 'test' END AS split FROM o"""


@query("W2_cumulative_split", f"WITH {_CUM}")
def w2(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "documents").groupBy("source").agg(F.sum("n_chars").alias("n"))
    return Q.cumulative_split(g, F.sha2(F.concat(F.lit("7|"), "source"), 256), "source", "n").select("source", "n", "split")


@query("W3_top_per_group", "SELECT lang, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k <= 5")
def w3(spark: SparkSession, sf: str) -> DataFrame:
    k = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id"))
    return table(spark, sf, "documents").select("lang", "doc_id", "n_chars").withColumn("k", k).where("k <= 5").drop("k")


@query("W4_round_robin", f"WITH {RECORDS} SELECT id, family FROM (SELECT id, family, row_number() OVER (PARTITION BY family ORDER BY id) AS k FROM rec) ORDER BY k, family LIMIT 23")
def w4(spark: SparkSession, sf: str) -> DataFrame:
    k = F.row_number().over(W.partitionBy("family").orderBy("id"))
    return records(spark, sf).select("id", "family", k.alias("k")).where("k <= 23").orderBy("k", "family").limit(23).select("id", "family")


@query("W5_evenly_spaced", f"WITH {RECORDS}, n AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k, count(*) OVER () AS total FROM rec), w AS (SELECT i, (i * (SELECT max(total) - 1 FROM n)) // 9 AS k FROM range(10) t(i)) SELECT i, id FROM w JOIN n USING (k)")
def w5(spark: SparkSession, sf: str) -> DataFrame:
    return Q.evenly_spaced(records(spark, sf).select("id"), "id", 10).select("i", "id")


@query("W6_adjacent", "SELECT user_id, count(*) AS n_repeats FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) WHERE event_type = prev GROUP BY user_id")
def w6(spark: SparkSession, sf: str) -> DataFrame:
    prev = F.lag("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf, "events").withColumn("prev", prev).where("event_type = prev").groupBy("user_id").agg(N().alias("n_repeats"))


@query("W7_early_stopping", """WITH RECURSIVE h AS (SELECT user_id, value AS m, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events), r AS (SELECT user_id, step, m AS best, 0 AS bad, step AS best_step FROM h WHERE step = 1 UNION ALL SELECT h.user_id, h.step, CASE WHEN h.m < r.best - 0.5 THEN h.m ELSE r.best END, CASE WHEN h.m < r.best - 0.5 THEN 0 ELSE r.bad + 1 END, CASE WHEN h.m < r.best - 0.5 THEN h.step ELSE r.best_step END FROM r JOIN h ON h.user_id = r.user_id AND h.step = r.step + 1 WHERE r.bad < 5)
SELECT user_id, max(step) AS stop_step, arg_max(best, step) AS best, arg_max(best_step, step) AS best_step, arg_max(bad, step) >= 5 AS stopped FROM r GROUP BY user_id""")
def w7(spark: SparkSession, sf: str) -> DataFrame:
    h = table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("h"))
    return Q.early_stopping(h.select("user_id", F.transform("h", lambda x: x["value"]).alias("h")), "h", patience=5, min_delta=0.5)


@query("W8_best_row", "SELECT l_orderkey, arg_min(l_linenumber, (l_extendedprice, l_linenumber)) AS best_line, min(l_extendedprice) AS best FROM lineitem GROUP BY l_orderkey")
def w8(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min(F.struct("l_extendedprice", "l_linenumber")).alias("m")).select("l_orderkey", F.col("m.l_linenumber").alias("best_line"), F.col("m.l_extendedprice").alias("best"))


@query("W9_tiers", "WITH e AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, o_custkey) AS hi, row_number() OVER (ORDER BY n, o_custkey) AS lo, least(greatest(count(*) OVER () // 3, 4), 24) AS size FROM e) SELECT o_custkey, CASE WHEN hi <= size THEN 'high' ELSE 'low' END AS tier FROM r WHERE hi <= size OR lo <= size")
def w9(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "orders").groupBy("o_custkey").agg(N().alias("n"))
    return Q.tiers(e, "o_custkey", "n")


@query("W10_diverse")
def w10(spark: SparkSession, sf: str) -> DataFrame:
    return Q.diverse(records(spark, sf).select("id", "topic_id", "family"), "id", ["topic_id", "family"], 20)


@query("W11_mixed_sort", "SELECT source, n, row_number() OVER (ORDER BY n DESC, source) AS place FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def w11(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("source").agg(N().alias("n")).withColumn("place", F.row_number().over(W.orderBy(F.desc("n"), "source")))


@query("W12_top_k", f"WITH {LINES} SELECT line, count(*) AS n FROM lines WHERE length(line) > 3 GROUP BY line ORDER BY n DESC, line LIMIT 20")
def w12(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).where(F.length("line") > 3).groupBy("line").agg(N().alias("n")).orderBy(F.desc("n"), "line").limit(20)


@query("W13_capped_samples", "SELECT lang, (list(doc_id ORDER BY doc_id))[:20] AS sample_ids FROM documents GROUP BY lang")
def w13(spark: SparkSession, sf: str) -> DataFrame:
    # The cap is the feature: the list is cut to 20 by rank before anything is gathered.
    d = table(spark, sf, "documents").select("lang", "doc_id").withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("doc_id"))).where("k <= 20")
    return d.groupBy("lang").agg(F.array_sort(F.collect_list("doc_id")).alias("sample_ids"))


@query("Q1_hash_split", f"WITH {_DOCS_SPLIT} SELECT doc_id, split FROM s")
def q1(spark: SparkSession, sf: str) -> DataFrame:
    return _docs_split(spark, sf).select("doc_id", "split")


@query("Q2_group_split", f"WITH c AS ({'WITH ' + _CUM}) SELECT split, count(*) AS n_groups, sum(n)::BIGINT AS n_chars FROM c GROUP BY split")
def q2(spark: SparkSession, sf: str) -> DataFrame:
    return w2(spark, sf).groupBy("split").agg(N().alias("n_groups"), F.sum("n").alias("n_chars"))


@query("Q3_exact_counts", "SELECT source, CASE WHEN k <= 10 THEN 'train' WHEN k <= 14 THEN 'val' WHEN k <= 17 THEN 'test' ELSE 'rest' END AS split FROM (SELECT source, row_number() OVER (ORDER BY sha256('p|' || source)) AS k FROM (SELECT DISTINCT source FROM documents))")
def q3(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "documents").select("source").distinct()
    return Q.exact_counts(s, F.sha2(F.concat(F.lit("p|"), "source"), 256), [("train", 10), ("val", 4), ("test", 3)], "rest")


@query("Q4_grouped_split", f"WITH {RECORDS}, g AS (SELECT DISTINCT family, topic_id FROM rec), r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY sha256(family || topic_id)) AS k, greatest(1, round_even(count(*) OVER (PARTITION BY family) * 0.1, 0)::BIGINT) AS q FROM g) SELECT id, CASE WHEN k <= q THEN 'val' WHEN k <= 2 * q THEN 'test' ELSE 'train' END AS split FROM rec JOIN r USING (family, topic_id)")
def q4(spark: SparkSession, sf: str) -> DataFrame:
    r = records(spark, sf)
    g = r.select("family", "topic_id").distinct()
    own = W.partitionBy("family")
    g = g.withColumn("k", F.row_number().over(own.orderBy(F.sha2(F.concat("family", "topic_id"), 256)))).withColumn("q", F.greatest(F.lit(1), F.rint(N().over(own) * 0.1).cast("long")))
    return r.drop("split").join(g, ["family", "topic_id"]).select("id", F.when(F.col("k") <= F.col("q"), "val").when(F.col("k") <= 2 * F.col("q"), "test").otherwise("train").alias("split"))


@query("Q5_quota_allocation", f"WITH {RECORDS}, q(family, split2, lo, hi) AS (VALUES ('qa', 'train', 0, 10), ('qa', 'val', 10, 14), ('chat', 'train', 0, 8), ('chat', 'val', 8, 10)), r AS (SELECT id, family, row_number() OVER (PARTITION BY family ORDER BY sha256(id::VARCHAR)) AS k FROM rec) SELECT id, split2 AS split FROM r JOIN q ON r.family = q.family AND k > lo AND k <= hi")
def q5(spark: SparkSession, sf: str) -> DataFrame:
    q = F.broadcast(spark.createDataFrame([("qa", "train", 0, 10), ("qa", "val", 10, 14), ("chat", "train", 0, 8), ("chat", "val", 8, 10)], "family string, split string, lo int, hi int"))
    r = records(spark, sf).drop("split").withColumn("k", F.row_number().over(W.partitionBy("family").orderBy(F.sha2(F.col("id").cast("string"), 256))))
    return r.join(q, "family").where("k > lo AND k <= hi").select("id", "split")


@query("Q6_subset_sum")
def q6(spark: SparkSession, sf: str) -> DataFrame:
    sizes = records(spark, sf).groupBy("topic_id").agg(N().alias("n"))
    return Q.exact_subset(sizes, "topic_id", "n", 40)


@query("Q7_rebalance", f"WITH {RECORDS} SELECT id, CASE WHEN family = 'qa' AND k BETWEEN 6 AND 15 THEN 'verify' WHEN family = 'qa' AND k BETWEEN 16 AND 20 THEN 'copy' ELSE family END AS family FROM (SELECT id, family, row_number() OVER (PARTITION BY family ORDER BY id) AS k FROM rec)")
def q7(spark: SparkSession, sf: str) -> DataFrame:
    qa = F.col("family") == "qa"
    r = numbered_within(records(spark, sf).select("id", "family"), ["family"], [F.col("id")])
    return r.select("id", F.when(qa & F.col("k").between(5, 14), "verify").when(qa & F.col("k").between(15, 19), "copy").otherwise(F.col("family")).alias("family"))


@query("Q8_capped_selection", f"WITH {RECORDS} SELECT id FROM (SELECT id, h, row_number() OVER (PARTITION BY family ORDER BY h) AS k FROM (SELECT id, family, sha256(id::VARCHAR) AS h FROM rec)) WHERE k <= 9 ORDER BY h LIMIT 30")
def q8(spark: SparkSession, sf: str) -> DataFrame:
    h = records(spark, sf).select("id", "family", F.sha2(F.col("id").cast("string"), 256).alias("h"))
    return h.withColumn("k", F.row_number().over(W.partitionBy("family").orderBy("h"))).where("k <= 9").orderBy("h").limit(30).select("id")


@query("Q9_schedule", f"WITH {RECORDS}, r AS (SELECT id, family, row_number() OVER (PARTITION BY family ORDER BY sha256('o' || id)) AS k FROM rec), s(k0, split2) AS (VALUES (0, 'train'), (1, 'val'), (2, 'train'), (3, 'test'), (4, 'train')) SELECT id, split2 AS split FROM r JOIN s ON (k - 1) % 5 = k0")
def q9(spark: SparkSession, sf: str) -> DataFrame:
    schedule = F.array(*map(F.lit, ["train", "val", "train", "test", "train"]))
    r = numbered_within(records(spark, sf).select("id", "family"), ["family"], [F.sha2(F.concat(F.lit("o"), F.col("id").cast("string")), 256)])
    return r.select("id", F.get(schedule, (F.col("k") % 5).cast("int")).alias("split"))


@query("Q10_distinct_lines")
def q10(spark: SparkSession, sf: str) -> DataFrame:
    from sparquill.plans.q_joins import NAMES

    names = F.array(*map(F.lit, NAMES))
    hits = lines(spark, sf).select(F.format_string("%019d.%010d", F.col("doc_id").cast("long"), F.col("line_no").cast("long")).alias("place"), F.explode(F.filter(names, lambda n: F.col("line").contains(n))).alias("label"))
    return Q.distinct_places(hits, "label", "place", len(NAMES))


@query("Q11_pool_cursor", f"WITH {RECORDS}, p AS (SELECT split, id AS chunk, row_number() OVER (PARTITION BY split ORDER BY id) - 1 AS k, count(*) OVER (PARTITION BY split) AS n FROM rec) SELECT i AS idx, split, chunk FROM range(50) t(i) JOIN p ON k = (i + ('0x' || substr(sha256(split), 1, 8))::BIGINT) % n")
def q11(spark: SparkSession, sf: str) -> DataFrame:
    p = numbered_within(records(spark, sf).select("split", F.col("id").alias("chunk")), ["split"], [F.col("chunk")], total=True)
    sizes = p.select("split", "n").distinct()
    want = spark.range(50).withColumnRenamed("id", "idx").crossJoin(F.broadcast(sizes)).withColumn("k", (F.col("idx") + X.bucket(F.sha2("split", 256), 1 << 40)) % F.col("n"))
    return want.join(p.select("split", "k", "chunk"), ["split", "k"]).select("idx", "split", "chunk")


_POOLS = "p AS (SELECT id, CASE WHEN family IN ('qa', 'chat') THEN 'core' WHEN family = 'rewrite' THEN 'style' ELSE 'rest' END AS pool FROM rec), w(pool, weight, ord) AS (VALUES ('core', 0.5, 1), ('style', 0.3, 2), ('rest', 0.2, 3))"


@query("Q12_weighted_draws", f"""WITH RECURSIVE {RECORDS}, {_POOLS}, d(i, a, b, c, pick) AS (SELECT 0, 0, 0, 0, '' UNION ALL SELECT i + 1, a + 50 - CASE WHEN a + 50 >= b + 30 AND a + 50 >= c + 20 THEN 100 ELSE 0 END, b + 30 - CASE WHEN NOT (a + 50 >= b + 30 AND a + 50 >= c + 20) AND b + 30 >= c + 20 THEN 100 ELSE 0 END, c + 20 - CASE WHEN NOT (a + 50 >= b + 30 AND a + 50 >= c + 20) AND NOT b + 30 >= c + 20 THEN 100 ELSE 0 END, CASE WHEN a + 50 >= b + 30 AND a + 50 >= c + 20 THEN 'core' WHEN b + 30 >= c + 20 THEN 'style' ELSE 'rest' END FROM d WHERE i < 200),
n AS (SELECT i, pick AS pool, row_number() OVER (PARTITION BY pick ORDER BY i) - 1 AS k FROM d WHERE i > 0), z AS (SELECT pool, count(*) AS size FROM p GROUP BY pool),
e AS (SELECT i, n.pool, k // size AS epoch, k % size AS pos FROM n JOIN z USING (pool)), q AS (SELECT pool, epoch, id, row_number() OVER (PARTITION BY pool, epoch ORDER BY sha256('7|' || epoch || '|' || id)) - 1 AS pos FROM p JOIN (SELECT DISTINCT pool, epoch FROM e) USING (pool))
SELECT i AS draw, pool, epoch, id FROM e JOIN q USING (pool, epoch, pos)""")
def q12(spark: SparkSession, sf: str) -> DataFrame:
    pool = F.when(F.col("family").isin("qa", "chat"), "core").when(F.col("family") == "rewrite", "style").otherwise("rest")
    return Q.weighted_draws(records(spark, sf).select("id", pool.alias("pool")), [("core", 50), ("style", 30), ("rest", 20)], 200)


@query("Q13_phases", "SELECT step, CASE WHEN step < 600 THEN 'first' ELSE 'second' END AS phase FROM range(1000) t(step)")
def q13(spark: SparkSession, sf: str) -> DataFrame:
    return spark.range(1000).select(F.col("id").alias("step"), F.when(F.col("id") < 600, "first").otherwise("second").alias("phase"))


@query("Q14_epoch_draws", f"WITH {RECORDS}, z AS (SELECT count(*) AS size FROM rec), e AS (SELECT i AS draw, i // size AS epoch, i % size AS pos FROM range(700) t(i), z), q AS (SELECT epoch, id, row_number() OVER (PARTITION BY epoch ORDER BY sha256('11|' || epoch || '|' || id)) - 1 AS pos FROM rec, (SELECT DISTINCT epoch FROM e)) SELECT id, count(*) AS draws FROM e JOIN q USING (epoch, pos) GROUP BY id")
def q14(spark: SparkSession, sf: str) -> DataFrame:
    return Q.epoch_draws(records(spark, sf).select("id"), 700, 11).groupBy("id").agg(N().alias("draws"))


@query("Q15_random_windows", "SELECT i AS draw, doc_id, substr(text, start + 1, 64) AS win FROM (SELECT i, doc_id, text, ('0x' || substr(sha256('w|' || i || '|' || doc_id), 1, 8))::BIGINT % (n_chars - 64) AS start FROM documents, range(2) t(i) WHERE n_chars > 64)")
def q15(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("n_chars > 64").select("doc_id", "text", "n_chars", F.explode(F.array(F.lit(0), F.lit(1))).alias("draw"))
    start = X.bucket(F.sha2(F.concat_ws("|", F.lit("w"), F.col("draw").cast("string"), F.col("doc_id").cast("string")), 256), 1 << 40) % (F.col("n_chars") - 64)
    return d.withColumn("start", start.cast("int")).select("draw", "doc_id", F.expr("substr(text, start + 1, 64)").alias("win"))


@query("Q16_uniform_batch", f"WITH {RECORDS} SELECT b AS batch, id FROM (SELECT b, id, row_number() OVER (PARTITION BY b ORDER BY sha256(b || '|' || id)) AS k FROM rec, range(4) t(b)) WHERE k <= 8")
def q16(spark: SparkSession, sf: str) -> DataFrame:
    b = records(spark, sf).select("id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("batch"))
    k = F.row_number().over(W.partitionBy("batch").orderBy(F.sha2(F.concat_ws("|", F.col("batch").cast("string"), F.col("id").cast("string")), 256)))
    return b.withColumn("k", k).where("k <= 8").select("batch", "id")


