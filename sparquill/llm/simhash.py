"""SimHash near-dedup with a Gray-order hierarchical index."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparquill.llm.common import binary_list, importable, salted_join, slices, staged
from sparquill.operators.components import connected_components

BITS, DISTANCE, SEED = 64, 3, 42
#: Children of a node, as a power of two; codes of a shard and visiting codes of a task, as a power of two (then 40 MB of
#: index); and the least number of shards.
FAN_OUT_BITS, SHARD_BITS, LEAST_SHARDS = 2, 20, 16


def fingerprint_of(text: bytes, size: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles; 0 without words. Works through long texts in blocks."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < size else map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    hashes = np.fromiter((xxh64_intdigest(s, SEED) for s in shingles), dtype="<u8")
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, row_col: str | None = None) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and, if given, row_col for each row of docs."""
    importable(docs.sparkSession)
    also = [row_col] if row_col else []
    frame = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"), *also)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = np.fromiter((fingerprint_of(t, size) for t in binary_list(batch.column("text"))), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64)), *(batch.column(c) for c in also)], ["doc_id", "fp", *also])

    return frame.mapInArrow(run, f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, fp long" + f", `{row_col}` long" * len(also))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The rank of each 64-bit code in Gray order (neighbours in rank differ in one bit)."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _lowest(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Labels of n points after merging the pairs (a, b)."""
    while True:
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if (label[a] == label[b]).all():
            return label


class GrayIndex:
    """A hierarchy of masked bit patterns over items in Gray order.

    An item is a value and a mask of the bits that it fixes (a code fixes all). A node stands for 2^FAN_OUT_BITS
    neighbours of the level below; its pattern is all bits, at any positions, that these fix alike. A bit is factored
    out into the uppermost node that holds it: below, a node compares only its residual bits. A search takes queries
    down the levels with the differences that they have accumulated, and drops a whole group once they exceed the
    distance; a pattern that many items share is so compared once for all of them.
    """

    def __init__(self, values: np.ndarray, masks: np.ndarray | None = None):
        masks = np.full(len(values), ~np.uint64(0)) if masks is None else masks
        self.values, self.residual = [values & masks], []
        whole = [masks]
        while len(self.values[-1]) > 1 << FAN_OUT_BITS:
            v, m = self.values[-1], whole[-1]
            at = np.arange(0, len(v), 1 << FAN_OUT_BITS)
            parent = np.arange(len(v)) >> FAN_OUT_BITS
            differs = np.bitwise_or.reduceat((v ^ v[at][parent]) & m, at)
            shared = np.bitwise_and.reduceat(m, at) & ~differs
            self.residual.append(m & ~shared[parent])
            self.values.append(v[at] & shared)
            whole.append(shared)
        self.residual.append(whole[-1])

    def search(self, q: np.ndarray, distance: int, after: np.ndarray | None = None, most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, item) that may differ in at most `distance` bits (exactly those if items are codes), in
        parts; with `after`, only items of a higher number than the query's. Holds some `most` pairs for each level."""
        top = len(self.values) - 1

        def near(level: int, qi: np.ndarray, node: np.ndarray, spent: np.ndarray | int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            spent = spent + np.bitwise_count((q[qi] ^ self.values[level][node]) & self.residual[level][node])
            ok = spent <= distance
            if after is not None:
                ok &= ((node + 1) << FAN_OUT_BITS * level) - 1 > after[qi]
            return qi[ok], node[ok], spent[ok]

        def down(level: int, qi: np.ndarray, node: np.ndarray, spent: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            if level == 0:
                if len(qi):
                    yield qi, node
                return
            for i in range(0, len(qi), most >> FAN_OUT_BITS):
                part = slice(i, i + (most >> FAN_OUT_BITS))
                child = ((node[part] << FAN_OUT_BITS)[:, None] + np.arange(1 << FAN_OUT_BITS)).ravel()
                there = child < len(self.values[level - 1])
                up = [np.repeat(x[part], 1 << FAN_OUT_BITS)[there] for x in (qi, spent)]
                yield from down(level - 1, *near(level - 1, up[0], child[there], up[1]))

        roots = np.arange(len(self.values[top]))
        step = max(1, most // max(1, len(roots)))
        for i in range(0, len(q), step):
            qi = np.arange(i, min(i + step, len(q)))
            yield from down(top, *near(top, np.repeat(qi, len(roots)), np.tile(roots, len(qi)), 0))


def shard_links(own: np.ndarray, others: Iterator[np.ndarray], part: int = 0, parts: int = 1, distance: int = DISTANCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (code, code of `own`) that join all of own (as far as every parts-th of them, from `part` on, tells) and
    others that differ in at most `distance` bits from a code of own. At most one link for each code: pairs merge labels
    at once and are not kept."""
    own = own[np.argsort(gray_rank(own), kind="stable")]
    index, n = GrayIndex(own), len(own)
    label, mine = np.arange(n), np.arange(part, n, parts)
    for qi, item in index.search(own[mine], distance, mine):
        x = mine[qi]
        apart = label[x] != label[item]
        if apart.any():
            label = _lowest(n, x[apart], item[apart], label)
    for q in others:
        both = np.concatenate([label, np.arange(n, n + len(q))])
        for qi, item in index.search(q, distance):
            apart = both[qi + n] != both[item]
            if apart.any():
                both = _lowest(len(both), qi[apart] + n, item[apart], both)
        label = both[:n]  # a label is the least number, so always one of own
        linked = np.flatnonzero(both[n:] < n)
        if len(linked):
            yield q[linked], own[both[n:][linked]]
    linked = np.flatnonzero(label != np.arange(n))
    if len(linked):
        yield own[linked], own[label[linked]]


def fingerprint_links(codes: DataFrame, least_shards: int = LEAST_SHARDS) -> DataFrame:
    """Links (a, b) that join all fingerprints (distinct, column fp) at DISTANCE or fewer bits, directly or in steps.

    The codes are range-sorted by Gray rank into shards, written once. The masked pattern of each shard (one row a
    shard) forms the upper part of the index, which all tasks get; a code goes down it to the shards that may hold a
    neighbour, of those that come after its own, and a shard's tasks search the lower part for the codes that visit it.
    So all codes are searched through the one hierarchy, and pairs are never rows. Codes travel in blocks. Up to 16
    million codes there are 16 shards and a code visits some 7 at most; with 2^B shards it visits some B^3 / 12. Where
    visitors are many, a shard has several tasks, each with its index and a share of them.
    """
    spark = codes.sparkSession
    importable(spark)
    n_codes = codes.count()
    n_shards = max(n_codes >> SHARD_BITS, least_shards)
    bits = math.log2(n_shards)
    visits = sum(math.comb(math.ceil(bits), i) for i in range(DISTANCE + 1)) / 2
    parts = max(1, math.ceil(n_codes * visits / n_shards) >> SHARD_BITS)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = gray_rank(batch.column("fp").to_numpy().view(np.uint64)) ^ np.uint64(1 << 63)  # in the order of signed longs
            yield pa.RecordBatch.from_arrays([batch.column("fp"), pa.array(rank.view(np.int64))], ["fp", "rank"])

    shards = staged(codes.select("fp").mapInArrow(ranked, "fp long, rank long").repartitionByRange(n_shards, "rank").select("fp", F.spark_partition_id().alias("shard")), "simhash-shards")
    roots = sorted(shards.groupBy("shard").agg(F.expr("bit_and(fp)").alias("all"), F.expr("bit_or(fp)").alias("any")).collect())
    if not roots:
        return spark.createDataFrame([], "a long, b long")
    number = np.array([r["shard"] for r in roots], np.int64)
    every, some = (np.array([r[c] for r in roots], np.int64).view(np.uint64) for c in ("all", "any"))

    def blocks(task: np.ndarray, guest: int, fp: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(task, kind="stable")
        cut = np.flatnonzero(np.diff(task[order])) + 1
        own = np.split(order, cut)
        return pa.RecordBatch.from_arrays([pa.array([int(task[x[0]]) for x in own], pa.int32()), pa.array([guest] * len(own), pa.int8()), pa.array([fp[x].tobytes() for x in own], pa.binary())], ["task", "guest", "block"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = GrayIndex(every, ~(every ^ some))
        for batch in batches:
            if not batch.num_rows:
                continue
            fp, own = batch.column("fp").to_numpy(), np.searchsorted(number, batch.column("shard").to_numpy())
            for part in range(parts):
                yield blocks(own * parts + part, 0, fp)
            for qi, item in upper.search(fp.view(np.uint64), DISTANCE, own):
                yield blocks(item * parts + (mixed(fp[qi]) % np.uint64(parts)).astype(np.int64), 1, fp[qi])

    routed = shards.mapInArrow(route, "task int, guest byte, block binary").repartitionById(len(number) * parts, F.col("task")).sortWithinPartitions("guest")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((t, g, np.frombuffer(x.as_py(), "<u8")) for b in batches for t, g, x in zip(b.column("task").to_pylist(), b.column("guest").to_pylist(), b.column("block"), strict=True))
        own: list[np.ndarray] = []
        visitor, task = None, 0
        for task, guest, fp in rows:
            if guest:
                visitor = fp
                break
            own.append(fp)

        def guests() -> Iterator[np.ndarray]:
            held = [] if visitor is None else [visitor]
            for *_, fp in rows:
                held.append(fp)
                if sum(map(len, held)) >= 1 << 17:
                    yield np.concatenate(held)
                    held = []
            if held:
                yield np.concatenate(held)

        if own:
            for a, b in shard_links(np.concatenate(own), guests(), task % parts, parts):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return routed.mapInArrow(search, "a long, b long")


def mixed(fp: np.ndarray) -> np.ndarray:
    """Deals codes over tasks, whatever bits they share."""
    x = fp.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x >> np.uint64(32)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, row_col: str | None = None) -> DataFrame:
    """The near-duplicate component of every document: doc_id, fingerprint, component_id; with row_col (unique longs
    of docs) also that column and first: whether the row is the one of its component that stays, that of the smallest
    doc_id (null last), of rows that repeat it the one with the smallest row_col.

    Fingerprints are made once and staged; equal ones are one node of the graph, however many documents have them.
    Defined cases: null, empty and white texts have fingerprint zero and link like any other; texts of fewer than
    `size` words count as one shingle; component_id is the smallest doc_id that is not null (null if none is);
    repeated rows give a row each. Other columns are ignored.
    """
    marked = staged(fingerprints(docs, id_col, text_col, size, row_col), "simhash")
    order = ["doc_id", *([row_col] if row_col else [])]
    low = F.min(F.struct(F.col("doc_id").isNull().alias("none"), *order)).alias("low")
    codes = staged(marked.groupBy("fp").agg(low, F.count(F.lit(1)).alias("n")), "simhash-codes")
    parts = connected_components(fingerprint_links(codes.select("fp")))
    known = codes.join(parts.select(F.col("node").alias("fp"), "component"), "fp", "left").select("fp", "low", "n", F.coalesce("component", "fp").alias("component"))
    known = staged(known, "simhash-known")
    lows = known.groupBy("component").agg(F.min("low").alias("low"), F.count(F.lit(1)).alias("codes"))
    full = salted_join(known.drop("low"), lows, ["component"], "codes", F.col("fp")).select("fp", "n", "low")
    out = salted_join(marked, full, ["fp"], "n", F.monotonically_increasing_id())
    also = [F.col(row_col), (F.col(row_col) == F.col(f"low.{row_col}")).alias("first")] if row_col else []
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("low.doc_id").alias("component_id"), *also)
