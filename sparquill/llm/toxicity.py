"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparquill.llm.common import importable, slices, staged

ORDERS = (4, 5, 6)
WIDTH_BITS = 21
THRESHOLD = 0.3
#: At most this many toxic labelled rows, and half as many again of the others, are learnt from (lowest hashed ids).
MOST_PER_CLASS = 2000
#: At most this many buckets have a weight.
MOST_FEATURES = 1 << 15


def held_out(id_col: str | Column = "doc_id") -> Column:
    """True for the rows whose labels are never learnt from: crc32 of the id as text, modulo 4, is 2."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string")) % 4 == 2, F.lit(False))


def gram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """For texts laid end to end: starts and ends in the joint array, and for each order the bucket of the n-gram at
    each place. A text is lower-cased, its ASCII white space becomes blanks, and it gets a blank at either end."""
    low = [f" {t.lower()} " for t in texts]
    ends = np.cumsum([len(t) for t in low])
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype="<u4").copy()
    points[(points >= 9) & (points <= 13)] = 32
    hashed, out = points.astype(np.uint64), []
    for n in range(2, max(ORDERS) + 1):
        hashed = hashed[:-1] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :] if len(hashed) > 1 else hashed[:0]
        if n in ORDERS:
            mixed = (hashed ^ (hashed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out.append((mixed >> np.uint64(64 - WIDTH_BITS)).astype(np.int32))
    return ends - [len(t) for t in low], ends, out


def text_features(text: str) -> np.ndarray:
    """The distinct buckets of one text."""
    _, _, grams = gram_buckets([text])
    return np.unique(np.concatenate(grams)) if grams else np.empty(0, np.int32)


def chosen_buckets(bucket: np.ndarray, pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of buckets with counts of toxic and other documents that have them: those that tell the classes apart (found in
    two documents, chi-squared over 10.8), their log-count ratios (naive Bayes, smoothed) and their chi-squared."""
    pos, neg = pos.astype(np.float64), neg.astype(np.float64)
    ratio = np.log(((pos + 1) / (n_pos + 2)) / ((neg + 1) / (n_neg + 2)))
    seen, total = pos + neg, n_pos + n_neg
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = np.nan_to_num(total * (pos * (n_neg - neg) - neg * (n_pos - pos)) ** 2 / (seen * (total - seen) * n_pos * n_neg))
    own = (chi > 10.8) & (seen >= 2)
    return bucket[own], ratio[own], chi[own]


def fit(columns: list[np.ndarray], positive: np.ndarray, ratio: np.ndarray, penalty: float = 1e-3, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights of features whose values are their log-count ratios, and the intercept: logistic regression with an L2
    penalty, both classes counting by their true numbers. columns: for each document the numbers of its features."""
    total, n_pos = len(columns), int(positive.sum())
    row = np.repeat(np.arange(total), [len(c) for c in columns])
    col = np.concatenate([np.empty(0, np.int32), *columns])
    value = ratio[col].astype(np.float32)
    weight, bias = np.zeros(len(ratio)), np.log(n_pos / (total - n_pos))
    step = [np.zeros(len(ratio) + 1), np.zeros(len(ratio) + 1)]
    for t in range(1, rounds + 1):
        z = bias + np.bincount(row, weights=value * weight[col], minlength=total)
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - positive) / total
        gradient = np.append(np.bincount(col, weights=value * error[row], minlength=len(ratio)) + penalty * weight / total, error.sum())
        step[0] = 0.9 * step[0] + 0.1 * gradient
        step[1] = 0.999 * step[1] + 0.001 * gradient**2
        move = 0.03 * (step[0] / (1 - 0.9**t)) / (np.sqrt(step[1] / (1 - 0.999**t)) + 1e-9)
        weight, bias = weight - move[:-1], bias - move[-1]
    return weight, float(bias)


def learn(docs: DataFrame, labels: DataFrame, most_per_class: int = MOST_PER_CLASS, most_features: int = MOST_FEATURES) -> tuple[np.ndarray, np.ndarray, float]:
    """Fits on a bounded sample of labelled rows that are not held out: buckets, their weights and the intercept.

    Of each class the rows with the lowest hashed doc_id, `most_per_class` toxic and 1.5 times as many others at
    most, are chosen from the labels alone; only they are looked up in the documents (a broadcast of so many ids at
    most), one row for each id, and written once. Eight tasks count the sample's buckets in blocks, which are summed
    block by block; only the buckets that tell the classes apart (at most `most_features`) and, of each sample row,
    the numbers of those it has come to the task that fits the weights. With several labels for an id the highest
    counts; ids without a text are left out; of rows that repeat an id the one with the lowest hashed text is used.
    """
    spark = docs.sparkSession
    importable(spark)
    none = np.empty(0, np.int32), np.empty(0, np.float32)
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    sizes = known.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("p"), F.count(F.lit(1)).alias("n")).first()
    bounds = {1: most_per_class, 0: most_per_class * 3 // 2}
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("toxic = 1").orderBy(*by_hash).limit(bounds[1]).unionByName(known.where("toxic = 0").orderBy(*by_hash).limit(bounds[0]))
    found = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    one = found.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("t")).select("doc_id", "toxic", F.col("t.text").alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            buckets = [text_features(t).astype("<i4").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(buckets, pa.binary())], ["doc_id", "toxic", "features"])

    sample = staged(one.repartition(8, "doc_id").mapInArrow(features, f"doc_id {one.schema['doc_id'].dataType.simpleString()}, toxic int, features binary"), "toxicity-sample")
    used = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_neg = used.get(1, 0), used.get(0, 0)
    if not n_pos or not n_neg:
        return *none, 8.0 if n_pos else -8.0
    block = WIDTH_BITS - 6

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << WIDTH_BITS), np.uint16)  # the sample's bound is under 65,536
        for batch in batches:
            for toxic, f in zip(batch.column("toxic").to_pylist(), batch.column("features"), strict=True):
                seen[toxic][np.frombuffer(f.as_py(), "<i4")] += 1
        for i in range(1 << WIDTH_BITS - block):
            part = seen[:, i << block : i + 1 << block]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["block", "data"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, data in zip(batch.column("block").to_pylist(), batch.column("data"), strict=True):
                part = np.frombuffer(zlib.decompress(data.as_py()), np.uint16).reshape(2, -1).astype(np.int64)
                sums[i] = sums[i] + part if i in sums else part
        for i, (neg, pos) in sums.items():
            own = chosen_buckets((np.arange(1 << block) + (i << block)).astype(np.int32), pos, neg, n_pos, n_neg)
            yield pa.RecordBatch.from_arrays([pa.array(own[0]), pa.array(own[1]), pa.array(own[2])], ["bucket", "ratio", "chi"])

    counted = sample.select("toxic", "features").coalesce(8).mapInArrow(count, "block int, data binary").repartition(8, "block")
    best = counted.mapInArrow(choose, "bucket int, ratio double, chi double").orderBy(F.desc("chi"), "bucket").limit(most_features).collect()
    best.sort(key=lambda r: r["bucket"])
    buckets, ratio = np.array([r["bucket"] for r in best], np.int32), np.array([r["ratio"] for r in best])

    def known_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << WIDTH_BITS, -1, np.int32)
        place[buckets] = np.arange(len(buckets))
        for batch in batches:
            own = [(p := place[np.frombuffer(f.as_py(), "<i4")])[p >= 0].astype("<i4").tobytes() for f in batch.column("features")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(own, pa.binary())], ["doc_id", "toxic", "features"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, marks = [], []
        for batch in batches:
            columns += [np.frombuffer(f.as_py(), "<i4") for f in batch.column("features")]
            marks += batch.column("toxic").to_pylist()
        weight, bias = fit(columns, np.array(marks) == 1, ratio)
        yield pa.RecordBatch.from_arrays([pa.array([(weight * ratio).astype("<f4").tobytes()]), pa.array([bias])], ["weights", "bias"])

    rows = sample.mapInArrow(known_only, sample.schema).repartition(1).sortWithinPartitions("toxic", "doc_id").select("toxic", "features")
    model = rows.mapInArrow(train, "weights binary, bias double").first()
    bias = model["bias"]
    # Where a class was cut to the bound, the intercept goes back to the true share of toxic rows.
    took = min(sizes["p"], bounds[1]), min(sizes["n"] - sizes["p"], bounds[0])
    bias += float(np.log(sizes["p"] / took[0]) - np.log((sizes["n"] - sizes["p"]) / took[1]))
    return buckets, np.frombuffer(model["weights"], dtype="<f4"), bias


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], keep: list[str], text_col: str = "text", most: float | None = None) -> DataFrame:
    """Rows (row, score): row is a struct of the columns `keep` of docs, whatever their names; with `most`, only rows
    that score below it. A bucket counts once however often a text has it."""
    importable(docs.sparkSession)
    buckets, weights, bias = model
    # A text that is kept travels once, within its row.
    inside = text_col in keep and docs.schema[text_col].dataType.typeName() == "string"
    frame = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), *([] if inside else [F.col(f"`{text_col}`").cast("string").alias("text")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << WIDTH_BITS, np.float32)
        table[buckets] = weights
        for whole in batches:
            texts = whole.column("row").field(keep.index(text_col)) if inside else whole.column("text")
            for batch in slices(iter([pa.RecordBatch.from_arrays([whole.column("row"), texts], ["row", "text"])]), "text", 1 << 20):
                yield from scored(batch, table)

    def scored(batch: pa.RecordBatch, table: np.ndarray) -> Iterator[pa.RecordBatch]:
        _, ends, grams = gram_buckets([t or "" for t in batch.column("text").to_pylist()])
        z = np.full(batch.num_rows, bias)
        hits = []
        for n, g in zip(ORDERS, grams, strict=True):
            at = np.flatnonzero(table[g])
            doc = np.searchsorted(ends, at, "right")
            inside = at + n <= ends[doc]
            hits.append(doc[inside].astype(np.int64) << WIDTH_BITS | g[at[inside]])
        found = np.unique(np.concatenate(hits))
        z += np.bincount(found >> WIDTH_BITS, weights=table[found & ((1 << WIDTH_BITS) - 1)], minlength=len(z))
        scores = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        out = pa.RecordBatch.from_arrays([batch.column("row"), pa.array(scores)], ["row", "score"])
        yield out if most is None else out.filter(pa.array(scores < most))

    return frame.mapInArrow(run, T.StructType([frame.schema["row"], T.StructField("score", T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, most_per_class: int = MOST_PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """Scores every document: doc_id, held_out, score, predicted.

    Inputs of a score are the text alone. Defined cases: null text is empty and gets the intercept's score; without
    labels of both classes every score is near 0 (or near 1 if all labels are toxic); a null doc_id is not held out;
    repeated rows give a row each; the longest text is worked through whole.
    """
    model = learn(docs, labels, most_per_class)
    return score(docs, model, ["doc_id"]).select("row.doc_id", "score").select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, most_per_class: int = MOST_PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns whatever their names, that score below the threshold.

    Defined cases: as in toxicity(); a null text stays unless the intercept alone is over the threshold; rows that
    repeat each other stay or go together; an empty table gives no rows.
    """
    return score(docs, learn(docs, labels, most_per_class), docs.columns, most=threshold).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
