"""Quality rules with cross-document line frequency, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparquill.llm.common import SPACE, WORD, salted_join, staged, text_of

WINDOW = 5


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def _covered(windows: Column) -> Column:
    """Words in windows whose hash occurs twice or more: sort (hash, place), keep places with an equal neighbour, and
    add up what each window covers beyond the one before."""
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = lambda s: F.array_sort(F.filter(F.transform(s, lambda e, j: F.when((e["h"] == F.get(s, j - 1)["h"]) | (e["h"] == F.get(s, j + 1)["h"]), e["i"])), lambda p: p.isNotNull()))
    reach = lambda p: F.aggregate(F.transform(p, lambda v, j: F.least(F.coalesce(F.get(p, j + 1) - v, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0).cast("long"), lambda a, x: a + x)
    return _let(placed, lambda s: _let(twice(s), reach))


def quality_rules(docs: DataFrame, most_docs: int = 20, most_share: float = 0.01, least_words: int = 10, least_kept: float = 0.2, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Base rules for each text, and the verdict by cross-document line frequency.

    A line is normalised (lower case, digit runs as 0, white space runs as one blank, no blank at the ends) and
    hashed to 96 bits; lines without a word don't count. For each host the documents that have a line are counted.
    A line in more than max(most_docs, most_share of the host's documents) documents is taken out of all of them. A
    document is depleted, and rejected, if lines were taken out and it keeps under least_words words or under
    least_kept of its words. kept is false for depleted documents and for those that fail the base rules.

    Defined cases: null text has no words (base_failed); a null host is a host of its own; repeated rows are documents
    of their own, also under one doc_id; an empty table gives no rows. Other columns are ignored.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, removed_words.
    """
    t = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), text_of(text_col).alias("t"))
    t = t.withColumn("w", F.transform(_words(F.col("t")), lambda w: F.xxhash64(w))).withColumn("n", F.size("w"))
    h = F.when(F.col("n") >= WINDOW, F.transform(F.sequence(F.lit(0), F.col("n") - WINDOW), lambda i: F.xxhash64(*[F.get(F.col("w"), i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    t = t.withColumn("h", h).withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)))
    normal = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), "[0-9]+", "0"), f"{SPACE}+", " "))
    line = lambda x: _let(normal(x), lambda y: F.struct(F.xxhash64(y).alias("a"), F.hash(y).alias("b"), F.size(_words(x)).alias("n")))
    base = t.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        "host",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", f"{SPACE}+", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("h") == F.size(F.array_distinct("h")), F.lit(0).cast("long")).otherwise(_covered(F.col("h"))).alias("n_repeat_words"),
        F.transform("lines", line).alias("lines"),
    )
    base = staged(base, "quality-base")
    lines = base.select("row", "host", F.explode("lines").alias("x")).select("row", F.coalesce(F.concat(F.lit("h"), "host"), F.lit("-")).alias("host"), F.col("x.a").alias("a"), F.col("x.b").alias("b"), F.col("x.n").alias("n"))
    by_doc = staged(lines.groupBy("row", "host", "a", "b").agg(F.sum("n").alias("n")), "quality-lines")
    hosts = base.groupBy(F.coalesce(F.concat(F.lit("h"), "host"), F.lit("-")).alias("host")).agg(F.count(F.lit(1)).alias("host_docs"))
    counted = by_doc.groupBy("host", "a", "b").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") > most_docs)
    common = staged(counted.join(hosts, "host").where(F.col("docs") > F.col("host_docs") * most_share).select("host", "a", "b", "docs"), "quality-common")
    gone = salted_join(by_doc, common, ["host", "a", "b"], "docs", F.col("row")).groupBy("row").agg(F.sum("n").alias("removed_words"))
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    depleted = (F.col("removed_words") > 0) & ((F.col("n_words") - F.col("removed_words") < least_words) | (F.col("n_words") - F.col("removed_words") < F.col("n_words") * least_kept))
    full = base.drop("lines", "host").join(gone, "row", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))
    return full.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "removed_words")
