"""Aggregations that the audits share: shares, coverage, leakage, lengths."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparquill.operators.staging import importable

PERCENTS = [0.5, 0.9, 0.95, 0.99]


def length_summary(value: Column) -> list[Column]:
    """min, p50, p90, p95, p99, max, mean; percentiles interpolate linearly at (n - 1) * f."""
    names = [f"p{round(p * 100)}" for p in PERCENTS]
    return [F.min(value).alias("min"), *[F.percentile(value, p).alias(n) for p, n in zip(PERCENTS, names, strict=True)], F.max(value).alias("max"), F.avg(value).alias("mean")]


def with_share(df: DataFrame, n: str, share: str, *by: str) -> DataFrame:
    """Adds n / the sum of n (of the rows alike in `by`)."""
    return df.withColumn(share, F.col(n) / F.sum(n).over(W.partitionBy(*[F.lit(0), *by])))


def repeats(df: DataFrame, value: Column) -> DataFrame:
    """One row: repeated values, rows beyond the first of each, the largest count."""
    counts = df.groupBy(value.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.count_if(F.col("n") > 1).alias("repeated_values"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_rows"), F.max("n").alias("max_count"))


def density(df: DataFrame, keys: list[str], tokens: Column) -> DataFrame:
    """For each key: its share of records and of tokens, and the second over the first."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("records"), F.sum(tokens).alias("tokens"))
    g = with_share(with_share(g, "records", "record_share"), "tokens", "token_share")
    return g.withColumn("density", F.try_divide(F.col("token_share"), F.col("record_share")))


def gates(df: DataFrame, rules: dict[str, tuple[Column, float, float]]) -> DataFrame:
    """One row a gate: name, actual, low, high, passed; all measured in one pass over df."""
    measured = df.agg(*[c.cast("double").alias(n) for n, (c, _, _) in rules.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("actual"), F.lit(float(lo)).alias("low"), F.lit(float(hi)).alias("high")) for n, (_, lo, hi) in rules.items()])).alias("g")
    return measured.select(rows).select("g.*").withColumn("passed", F.coalesce(F.col("actual").between(F.col("low"), F.col("high")), F.lit(False)))


#: Buckets of grams' hashes, and the fullest of them that are counted first.
BUCKET_BITS, FULLEST = 18, 64


def most_common_gram(rows: DataFrame, column: str, n: int) -> DataFrame:
    """max_count: in how many rows the n-gram of characters is that is in the most; null if there is none.

    Rows are counted by a hash of their grams first, in a fixed number of buckets; no gram is in more rows than its
    bucket has. The grams of the fullest buckets are then counted exactly, and after them those of the buckets that have
    more than the best of these: mostly none. So a task holds the buckets and few grams, whatever the size of the input.
    """
    spark = rows.sparkSession
    importable(spark)
    texts = rows.select(F.col(column).alias("t"))
    powers = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(n)]
    shift = np.uint64(64 - BUCKET_BITS)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray]]:
        """Texts of some 2^20 bytes; of their grams the hashes, the numbers of their texts, and where those end."""
        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b.column("t")), 0).to_pylist()
            begin = held = 0
            for k, size in enumerate([*sizes, 1 << 40]):
                if k > begin and held + size > 1 << 20:
                    own = [t for t in b.column("t").slice(begin, k - begin).to_pylist() if t is not None and len(t) >= n]
                    begin, held = k, 0
                    if own:
                        wide = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
                        length = np.array([len(t) for t in own])
                        starts = np.cumsum(length) - length
                        h = sum((wide[i : len(wide) - n + 1 + i] * powers[i] for i in range(1, n)), wide[: len(wide) - n + 1] * powers[0])
                        text = np.repeat(np.arange(len(own)), length)[: len(h)]
                        inside = text == np.repeat(np.arange(len(own)), length)[n - 1 :]
                        yield own, h[inside], text[inside], np.flatnonzero(inside) - starts[text[inside]]
                held += size

    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKET_BITS, np.int64)
        for _, h, text, _ in parts(batches):
            once = np.unique(h >> np.uint64(20) << np.uint64(20) | text.astype(np.uint64))
            counts += np.bincount((once >> shift).astype(np.int64), minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["bucket", "n"])

    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    for r in texts.mapInArrow(bucketed, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r["bucket"]] = r["n"]

    def largest(wanted: np.ndarray) -> int:
        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: Counter[str] = Counter()
            out = lambda: pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["w", "n"])
            for own, h, text, at in parts(batches):
                some = np.flatnonzero(wanted[(h >> shift).astype(np.int64)])
                found.update(w for _, w in {(k, own[k][i : i + n]) for k, i in zip(text[some].tolist(), at[some].tolist(), strict=True)})
                if len(found) > 1 << 18:
                    yield out()
                    found.clear()
            if found:
                yield out()

        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(counts[wanted].sum()) >> 21)
        best = texts.mapInArrow(exact, "w string, n long").repartition(tasks, "w").groupBy("w").agg(F.sum("n").alias("n")).agg(F.max("n").alias("n"))
        return best.first()["n"] or 0

    first = np.zeros(len(counts), bool)
    first[np.argsort(-counts, kind="stable")[:FULLEST]] = True
    best = largest(first & (counts > 0)) if counts.any() else None
    rest = ~first & (counts > (best or 0))
    if rest.any():
        best = max(best, largest(rest))
    return spark.createDataFrame([(best,)], "max_count long")
