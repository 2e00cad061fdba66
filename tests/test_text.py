from pyspark.sql import functions as F

from sparquill.functions import metrics as M
from sparquill.functions import text as X


def values(spark, rows, column):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r["v"] for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def test_numerals(spark):
    rows = ["二百四十二", "十七", "一千零五", "三万零二", "12", "三四五", "abc"]
    assert values(spark, rows, X.chinese_number("x")) == [242, 17, 1005, 30002, 12, 5, 0]
    assert values(spark, rows, X.strict_chinese_number("x")) == [242, 17, 1005, 30002, 12, 345, None]


def test_normal_forms(spark):
    assert values(spark, ["　 Ａb-Ｃ ß ", None], X.canonical_text("x")) == ["abcss", None]
    assert values(spark, [" a  b\n", ""], X.collapse("x")) == ["a b", ""]
    assert values(spark, ["a\r\nb c\n", ""], X.split_lines("x")) == [["a", "b", "c"], []]
    assert values(spark, ["a\x00b\tc\x85\n"], X.without_controls("x")) == ["ab\tc\n"]
    assert values(spark, ["please please: hi"], X.without_prefixes("x", ["please", ":"])) == ["hi"]


def test_balance_and_truncation(spark):
    assert values(spark, ["(a)", "(a", "《a》"], X.balanced("x")) == [True, False, True]
    assert values(spark, ["(abcdef)", "ab"], X.truncated("x", 5)) == ["(abc…)", "ab"]


def test_split_point_and_redaction(spark):
    assert values(spark, ["aaaaaaaaa,bbb,cccccccccc", "a,b"], X.split_point("x")) == [10, None]
    assert values(spark, ["token=abc; Bearer x.y"], X.redacted("x")) == ["token=[REDACTED]; Bearer [REDACTED]"]


def test_repetition_metrics(spark):
    assert values(spark, ["abcabcabc", "abc", ""], M.gram_repetition("x", 3)) == [1 - 3 / 7, 0.0, 0.0]
    assert values(spark, ["aabbbc", "", "x"], M.longest_run("x")) == [3, 0, 1]
    assert values(spark, ["aaaaaa", "ab" * 3, "a b a b c d", "abab"], M.severe_loop("x")) == [True, True, False, False]
    assert values(spark, ["aab", "a"], M.adjacent_repetition("x")) == [0.5, 0.0]


def test_answer_metrics(spark):
    df = spark.createDataFrame([("abcd", "xbcy"), ("", ""), ("a", None)], "a string, b string")
    rows = df.select(M.longest_common_substring("a", "b").alias("n"), M.multiset_f1(F.col("a"), F.col("b")).alias("f")).collect()
    assert [r["n"] for r in rows] == [2, 0, 0]
    assert [r["f"] for r in rows][:2] == [0.5, 1.0]
