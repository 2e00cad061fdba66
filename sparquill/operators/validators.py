"""Parts that audits and validators are composed of: value reports, totals, counts, risk codes and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def value_report(df: DataFrame, keys: dict[str, Column], group: Column) -> DataFrame:
    """section (the key's name), name, value: how many distinct values a key has, rows beyond the first of each, values
    found twice or more, the largest count, and values that stand in more than one group. All keys go through one
    shuffle, summed before it, so a value that many rows share is no hot key. Null and blank values don't count."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("section"), c.cast("string").alias("v")) for k, c in keys.items()])).alias("x")
    rows = df.select(pairs, group.alias("g")).select("x.*", "g").where("trim(v) <> ''")
    each = rows.groupBy("section", "v").agg(F.count(F.lit(1)).alias("n"), F.min("g").alias("low"), F.max("g").alias("high"))
    found = each.groupBy("section").agg(F.count(F.lit(1)).alias("distinct"), F.sum(F.col("n") - 1).alias("extra_rows"), F.count_if(F.col("n") > 1).alias("repeated"), F.max("n").alias("most"), F.count_if(F.col("low") != F.col("high")).alias("crossing"))
    return long(found, ["section"], ["distinct", "extra_rows", "repeated", "most", "crossing"])


def long(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row for each of the value columns: keys, name, value (double)."""
    rows = F.explode(F.array(*[F.struct(F.lit(v).alias("name"), F.col(v).cast("double").alias("value")) for v in values])).alias("r")
    return df.select(*keys, rows).select(*keys, "r.*")


def totals(df: DataFrame, section: str, values: dict[str, Column]) -> DataFrame:
    """section, name, value of aggregates that are all measured in one pass."""
    return long(df.agg(*[c.alias(n) for n, c in values.items()]).withColumn("section", F.lit(section)), ["section"], list(values))


def counts(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """section (the column's name), name (its value, 'missing' for null), value (rows), for several columns at once."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("section"), F.coalesce(c.cast("string"), F.lit("missing")).alias("name")) for k, c in columns.items()])).alias("x")
    return df.select(pairs).groupBy("x.section", "x.name").agg(F.count(F.lit(1)).cast("double").alias("value"))


def risk_codes(rules: dict[str, Column]) -> Column:
    """The codes of the rules that hold, in order; a rule that is null doesn't hold."""
    return F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]), lambda x: x.isNotNull())


def gated(report: DataFrame, spec: list[tuple[str, str, str, str, float, float]]) -> DataFrame:
    """One row for each gate (gate, severity, section, name, low, high): its actual value in the report (0 if the report
    has none), and whether it lies within the bounds. The list of gates is a constant and is broadcast."""
    rows = report.sparkSession.createDataFrame(spec, "gate string, severity string, section string, name string, low double, high double")
    # The report has few rows; the join keeps the gates' side whole.
    joined = rows.join(report, ["section", "name"], "left").withColumn("actual", F.coalesce("value", F.lit(0.0)))
    return joined.select("gate", "severity", "actual", "low", "high", F.col("actual").between(F.col("low"), F.col("high")).alias("passed"))


def deficits(report: DataFrame, section: str, targets: dict[str, float]) -> DataFrame:
    """How much each target of a section of counts is missed by: name, target, actual, missing."""
    rows = report.sparkSession.createDataFrame([(section, k, float(v)) for k, v in targets.items()], "section string, name string, target double")
    joined = rows.join(report, ["section", "name"], "left").withColumn("actual", F.coalesce("value", F.lit(0.0)))
    return joined.select("name", "target", "actual", F.greatest(F.lit(0.0), F.col("target") - F.col("actual")).alias("missing"))
