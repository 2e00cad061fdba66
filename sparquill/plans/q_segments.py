"""Queries of sections and ranges (G)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparquill.functions import text as X
from sparquill.operators import segments as S
from sparquill.plans.registry import query
from sparquill.sources.tables import LINES, lines, table

#: A heading, in these tables: a line of at most 24 characters.
HEAD = "length(line) BETWEEN 1 AND 24"


@query("G1_boundaries", f"""WITH {LINES} SELECT doc_id, line_no FROM (SELECT *, first_value(CASE WHEN trim(line, ' ') <> '' THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM lines) WHERE length(line) < 200 AND length(nxt) BETWEEN 1 AND 24""")
def g1(spark: SparkSession, sf: str) -> DataFrame:
    l = lines(spark, sf)
    return l.withColumn("nxt", S.next_line(l, F.trim("line") != "")).where((F.length("line") < 200) & F.length("nxt").between(1, 24)).select("doc_id", "line_no")


_SECTIONS = f"{LINES}, sec AS (SELECT *, sum(CASE WHEN {HEAD} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)::BIGINT AS section FROM lines)"


def _sectioned(spark: SparkSession, sf: str) -> DataFrame:
    return S.sections(lines(spark, sf), F.expr(HEAD))


@query("G2_sections", f"""WITH {_SECTIONS} SELECT doc_id, section, min(line_no) AS start_line, max(line_no) AS end_line, sum(length(line))::BIGINT AS n_chars, section = 0 AS preamble FROM sec GROUP BY doc_id, section""")
def g2(spark: SparkSession, sf: str) -> DataFrame:
    return _sectioned(spark, sf).groupBy("doc_id", "section").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.sum(F.length("line")).alias("n_chars"), (F.col("section") == 0).alias("preamble"))


@query("G3_line_to_section", """WITH b AS (SELECT user_id, ts, event_id AS click FROM events WHERE event_type = 'click'), e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view')
SELECT event_id, (SELECT arg_max(click, (b.ts, b.click)) FROM b WHERE b.user_id = e.user_id AND b.ts <= e.ts) AS click FROM e""")
def g3(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    clicks = e.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click"))
    return S.as_of(e.where("event_type = 'view'").select("event_id", "user_id", "ts"), clicks, "user_id", "ts", "click").select("event_id", "click")


_RANGES = "r AS (SELECT l_orderkey AS k, l_partkey % 1000 AS s, l_partkey % 1000 + l_quantity::BIGINT * 3 AS e, l_linenumber AS n FROM lineitem)"


def _ranges(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr("l_orderkey AS k", "l_partkey % 1000 AS s", "l_partkey % 1000 + cast(rint(l_quantity) AS bigint) * 3 AS e", "l_linenumber AS n")


@query("G4_merge_ranges", f"""WITH {_RANGES}, m AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r), i AS (SELECT *, sum(CASE WHEN s <= reach + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT k, min(s) AS s, max(e) AS e, count(*) AS merged FROM i GROUP BY k, island""")
def g4(spark: SparkSession, sf: str) -> DataFrame:
    return S.merge_ranges(_ranges(spark, sf), "k", "s", "e")


@query("G5_overlaps", f"""WITH {_RANGES}, m AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r) SELECT k, count(*) AS n FROM m WHERE s <= reach GROUP BY k""")
def g5(spark: SparkSession, sf: str) -> DataFrame:
    return S.overlapping(_ranges(spark, sf), "k", "s", "e").groupBy("k").agg(F.count(F.lit(1)).alias("n"))


_CUTS = "cuts AS (SELECT doc_id, 2 + doc_id % 3 AS s, 3 + doc_id % 5 AS e FROM documents WHERE doc_id % 2 = 0)"


@query("G6_range_delete", f"""WITH {LINES}, {_CUTS} SELECT l.doc_id, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars FROM lines l WHERE NOT EXISTS (SELECT 1 FROM cuts c WHERE c.doc_id = l.doc_id AND line_no BETWEEN s AND e) GROUP BY l.doc_id""")
def g6(spark: SparkSession, sf: str) -> DataFrame:
    cuts = table(spark, sf, "documents").where("doc_id % 2 = 0").selectExpr("doc_id", "2 + doc_id % 3 AS s", "3 + doc_id % 5 AS e")
    return S.without_ranges(lines(spark, sf), cuts, "doc_id", "line_no", "s", "e").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


@query("G7_range_slice", f"""WITH {LINES} SELECT doc_id, sha256(string_agg(line, chr(10) ORDER BY line_no)) AS slice FROM lines WHERE line_no BETWEEN 2 AND 5 GROUP BY doc_id""")
def g7(spark: SparkSession, sf: str) -> DataFrame:
    rows = lines(spark, sf).where("line_no BETWEEN 2 AND 5").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("x"))
    return rows.select("doc_id", F.sha2(F.array_join(F.transform("x", lambda r: r["line"]), "\n"), 256).alias("slice"))


@query("G8_previous_separator", f"""WITH {LINES} SELECT doc_id, line_no, last_value(CASE WHEN {HEAD} THEN line_no END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS head_line FROM lines""")
def g8(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).select("doc_id", "line_no", S.last_line_no(F.expr(HEAD)).alias("head_line"))


@query("G9_relocate_heading", f"""WITH {LINES}, want AS (SELECT doc_id, line_no + 2 AS spot, line FROM lines WHERE {HEAD}), c AS (SELECT w.doc_id, w.spot, l.line_no - w.spot AS off FROM want w JOIN lines l ON l.doc_id = w.doc_id AND l.line = w.line AND l.line_no BETWEEN w.spot - 5 AND w.spot + 5) SELECT doc_id, spot, min(off) AS off FROM c GROUP BY doc_id, spot""")
def g9(spark: SparkSession, sf: str) -> DataFrame:
    l = lines(spark, sf)
    want = l.where(HEAD).select("doc_id", (F.col("line_no") + 2).alias("spot"), "line")
    return want.join(l, ["doc_id", "line"]).withColumn("off", F.col("line_no") - F.col("spot")).where("off BETWEEN -5 AND 5").groupBy("doc_id", "spot").agg(F.min("off").cast("long").alias("off"))


@query("G10_blank_blocks", f"""WITH {_SECTIONS}, bad AS (SELECT doc_id, section FROM sec WHERE section > 0 GROUP BY doc_id, section HAVING bool_or(contains(line, 'icensed'))) SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE b.section IS NOT NULL) AS n_blanked, sum(CASE WHEN b.section IS NULL THEN length(line) ELSE 0 END)::BIGINT AS n_chars FROM sec LEFT JOIN bad b USING (doc_id, section) GROUP BY doc_id""")
def g10(spark: SparkSession, sf: str) -> DataFrame:
    bad = F.max(F.col("line").contains("icensed") & (F.col("section") > 0)).over(W.partitionBy("doc_id", "section"))
    s = _sectioned(spark, sf).withColumn("bad", bad)
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if("bad").alias("n_blanked"), F.sum(F.when(~F.col("bad"), F.length("line")).otherwise(0)).alias("n_chars"))


@query("G11_repeated_headings", f"""WITH {LINES}, p AS (SELECT doc_id, line_no, lower(line) AS h, min(CASE WHEN length(line) < 60 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS is_lead FROM lines), q AS (SELECT *, row_number() OVER (PARTITION BY doc_id, h ORDER BY line_no) AS k FROM p WHERE is_lead = 1) SELECT doc_id, line_no FROM q WHERE k > 1""")
def g11(spark: SparkSession, sf: str) -> DataFrame:
    run = W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    lead = lines(spark, sf).select("doc_id", "line_no", F.lower("line").alias("h"), F.min(F.when(F.length("line") < 60, 1).otherwise(0)).over(run).alias("leading")).where("leading = 1")
    return lead.withColumn("k", F.row_number().over(W.partitionBy("doc_id", "h").orderBy("line_no"))).where("k > 1").select("doc_id", "line_no")


@query("G12_continuation", f"""WITH {LINES} SELECT doc_id, line_no, lead(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) AS next_line FROM lines WHERE trim(line, ' ') <> ''""")
def g12(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).where(F.trim("line") != "").select("doc_id", "line_no", F.lead("line_no").over(W.partitionBy("doc_id").orderBy("line_no")).alias("next_line"))


def grow_context(sizes: list[int], at: int, least: int, most: int) -> tuple[int, int]:
    """First and last place of the context that grows from `at`, right and left in turn, to `least` but not over `most`."""
    low, high, total, right = at, at, sizes[at], True
    while total < least:
        sides = [(high + 1, True), (low - 1, False)]
        grown = False
        for place, is_right in sides if right else sides[::-1]:
            if 0 <= place < len(sizes) and total + sizes[place] <= most:
                low, high, total, grown = min(low, place), max(high, place), total + sizes[place], True
                right = not is_right
                break
        if not grown:
            break
    return low, high


@query("G13_grow_context")
def g13(spark: SparkSession, sf: str) -> DataFrame:
    import pandas as pd

    def grow(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("line_no")
        sizes = batch["n"].tolist()
        found = [grow_context(sizes, i, 128, 280) for i in range(len(sizes))]
        return pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(), "line_no": batch["line_no"].to_numpy(), "first": [batch["line_no"].iloc[a] for a, _ in found], "last": [batch["line_no"].iloc[b] for _, b in found]})

    return lines(spark, sf).select("doc_id", "line_no", F.length("line").alias("n")).groupBy("doc_id").applyInPandas(grow, "doc_id long, line_no int, first int, last int")


@query("G14_continuation_split", f"""WITH {LINES}, c AS (SELECT doc_id, line_no, generate_subscripts(x, 1) AS i, unnest(x) AS ch FROM (SELECT doc_id, line_no, string_split(line, '') AS x FROM lines WHERE length(line) BETWEEN 100 AND 400)) SELECT doc_id, line_no, arg_min(i, abs(i - 60) * 1000 + i)::INT AS split_at FROM c WHERE ch IN ('.', ',', '!') GROUP BY doc_id, line_no""")
def g14(spark: SparkSession, sf: str) -> DataFrame:
    places = F.filter(F.transform(X.chars("line"), lambda c, i: F.when(c.isin(".", ",", "!"), i + 1)), lambda i: i.isNotNull())
    best = F.array_min(F.transform(places, lambda i: F.struct(F.abs(i - 60).alias("d"), i.alias("i"))))["i"]
    return lines(spark, sf).where(F.length("line").between(100, 400)).select("doc_id", "line_no", best.cast("int").alias("split_at")).where("split_at IS NOT NULL")


@query("G15_offsets", f"""WITH {LINES} SELECT doc_id, line_no, (sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) - length(line) - 1)::BIGINT AS start_char, (sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) - 1)::BIGINT AS end_char FROM lines""")
def g15(spark: SparkSession, sf: str) -> DataFrame:
    end = F.sum(F.length("line") + 1).over(W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow))
    return lines(spark, sf).select("doc_id", "line_no", (end - F.length("line") - 1).alias("start_char"), (end - 1).alias("end_char"))


@query("G16_missing_numbers", """WITH p AS (SELECT DISTINCT user_id, floor(epoch(ts) / 3600)::BIGINT AS n FROM events), g AS (SELECT user_id, unnest(range(min(n), max(n) + 1)) AS n FROM p GROUP BY user_id)
SELECT g.user_id, count(*) AS n_missing, min(g.n) AS first_missing FROM g ANTI JOIN p USING (user_id, n) GROUP BY g.user_id""")
def g16(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "events").select("user_id", F.floor(F.unix_timestamp("ts") / 3600).alias("n")).distinct()
    g = p.groupBy("user_id").agg(F.min("n").alias("a"), F.max("n").alias("b")).select("user_id", F.explode(F.sequence("a", "b")).alias("n"))
    return g.join(p, ["user_id", "n"], "left_anti").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_missing"), F.min("n").alias("first_missing"))


@query("G17_segments", rf"""WITH {LINES}, s AS (SELECT doc_id, line_no, generate_subscripts(x, 1) AS i, unnest(x) AS seg FROM (SELECT doc_id, line_no, string_split_regex(line, '[.!?]') AS x FROM lines)), v AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY i) AS k FROM (SELECT doc_id, line_no, i, trim(seg, ' ') AS seg FROM s) WHERE length(seg) BETWEEN 20 AND 60) SELECT doc_id, line_no, seg AS segment FROM v WHERE k = 1""")
def g17(spark: SparkSession, sf: str) -> DataFrame:
    # The first valid segment of a line is the head of a filtered array: no explode, no window, no shuffle.
    segs = F.filter(F.transform(F.split("line", "[.!?]"), lambda s: F.trim(s)), lambda s: F.length(s).between(20, 60))
    return lines(spark, sf).select("doc_id", "line_no", F.get(segs, F.lit(0)).alias("segment")).where("segment IS NOT NULL")


@query("X1_nonblank_sequence", f"""WITH {LINES} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS idx, line_no FROM lines WHERE trim(line, ' ') <> ''""")
def x1(spark: SparkSession, sf: str) -> DataFrame:
    return nonblank(spark, sf).select("doc_id", "idx", "line_no")


def nonblank(spark: SparkSession, sf: str) -> DataFrame:
    """Collapsed non-blank lines with their place in the sequence and their original number."""
    l = lines(spark, sf).withColumn("line", X.collapse("line")).where("line <> ''")
    return l.withColumn("idx", (F.row_number().over(W.partitionBy("doc_id").orderBy("line_no")) - 1).cast("long"))




def _chains(spark: SparkSession, sf: str) -> DataFrame:
    """Books of 50 documents as sequences of collapsed non-blank lines, each document a part."""
    every = F.transform(X.split_lines("text"), lambda x, i: F.struct((F.col("doc_id") * 1000000 + i + 1).alias("n"), X.collapse(x).alias("line")))
    d = table(spark, sf, "documents").select("doc_id", F.filter(every, lambda x: x["line"] != "").alias("x"))
    return d.select(F.floor(F.col("doc_id") / 50).alias("doc_id"), F.col("doc_id").alias("place"), F.col("x.n").alias("numbers"), F.col("x.line").alias("lines"))


@query("J4_duplicate_blocks", rf"""WITH RECURSIVE {LINES}, s AS (SELECT doc_id // 50 AS doc_id, row_number() OVER (PARTITION BY doc_id // 50 ORDER BY doc_id, line_no) - 1 AS idx, doc_id * 1000000 + line_no AS line_no, trim(regexp_replace(line, '[ \t]+', ' ', 'g'), ' ') AS line FROM lines WHERE trim(line, ' ') <> ''),
t AS (SELECT *, count(*) OVER (PARTITION BY doc_id, line) AS n, lag(line) OVER (PARTITION BY doc_id ORDER BY idx) AS prev FROM s),
st AS (SELECT a.doc_id, a.idx AS i, b.idx AS j FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.line = b.line AND a.idx < b.idx WHERE length(a.line) >= 40 AND a.n BETWEEN 2 AND 10 AND (a.prev IS NULL OR b.prev IS NULL OR a.prev <> b.prev)),
walk AS (SELECT doc_id, i, j, 1::BIGINT AS m FROM st UNION ALL SELECT w.doc_id, w.i, w.j, w.m + 1 FROM walk w JOIN t x ON x.doc_id = w.doc_id AND x.idx = w.i + w.m JOIN t y ON y.doc_id = w.doc_id AND y.idx = w.j + w.m AND y.line = x.line),
b AS (SELECT doc_id, i, j, max(m) AS n_lines FROM walk GROUP BY doc_id, i, j)
SELECT b.doc_id, min(x.line_no) AS first_start, max(x.line_no) AS first_end, min(y.line_no) AS second_start, max(y.line_no) AS second_end, n_lines, sum(length(x.line))::BIGINT AS n_chars
FROM b JOIN t x ON x.doc_id = b.doc_id AND x.idx BETWEEN b.i AND b.i + n_lines - 1 JOIN t y ON y.doc_id = b.doc_id AND y.idx = x.idx - b.i + b.j WHERE n_lines >= 5 AND b.i + n_lines <= b.j GROUP BY b.doc_id, b.i, b.j, n_lines HAVING sum(length(x.line)) >= 500""")
def j4(spark: SparkSession, sf: str) -> DataFrame:
    return S.blocks_in_parts(_chains(spark, sf))
