"""Exact dedup by a tree-merge of sorted digest runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparquill.llm.common import SPACE, importable, staged, text_of

KEY = ["digest", "n_bytes", "witness"]
#: The best row of a group comes first in this order (nulls last).
ORDER = [("digest", "ascending"), ("n_bytes", "ascending"), ("witness", "ascending"), ("points", "descending"), ("doc_id", "ascending"), ("row", "ascending")]
#: Runs that meet in a merge, as a power of two, and the most nodes of the tree, as a power of two.
FAN_IN_BITS, MOST_BITS = 4, 15


def _keys(t: pa.Table) -> np.ndarray:
    """The key of each row as six unsigned longs, the digest's bytes in big-endian order."""
    digest = np.frombuffer(b"".join(t["digest"].to_pylist()), ">u8").reshape(-1, 4)
    rest = [t[c].to_numpy().view(np.uint64) for c in ("n_bytes", "witness")]
    return np.column_stack([digest.astype(np.uint64), *rest])


def _heads(keys: np.ndarray) -> np.ndarray:
    return np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1)))[: len(keys)]


def next_node(node: np.ndarray, prefix: np.ndarray, bits: int, level: int) -> np.ndarray:
    """Where a row goes in round `level`: to the node whose number differs from its own only in that round's bits,
    which become those of its digest. After the last round a node holds one stretch of the digests."""
    high, low = (max(0, bits - FAN_IN_BITS * k) for k in (level, level + 1))
    mask = (1 << high) - (1 << low)
    top = (prefix >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(prefix), np.int64)
    return (node & ~mask) | (top & mask)


def merged_runs(t: pa.Table) -> pa.Table:
    """Runs laid end to end, each sorted by key, merged to one, with one row (the best, its n the sum) for each key.

    The merge is a stable sort of the digests' first 8 bytes, which finds the runs and merges them; rows that agree
    there (at most one of each run, but for chance) are then put in full order. Rows are equal only if the whole
    SHA-256, the length and the witness are, so a merge is verified at every level.
    """
    keys = _keys(t)
    order = np.argsort(keys[:, 0], kind="stable")
    same = keys[order[1:], 0] == keys[order[:-1], 0]
    ties = np.flatnonzero(np.concatenate(([False], same)) | np.concatenate((same, [False])))
    if len(ties):
        part = t.select([c for c, _ in ORDER]).take(pa.array(order[ties]))
        order[ties] = order[ties][pc.sort_indices(part, sort_keys=ORDER).to_numpy()]
    head = np.flatnonzero(_heads(keys[order]))
    n = np.add.reduceat(t["n"].to_numpy()[order], head)
    out = t.take(pa.array(order[head]))
    return out.set_column(out.schema.get_field_index("n"), "n", pa.array(n))


def _marked(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Marks, in a partition sorted by ORDER, the last row of each key (tail) and gives it the best row's values and
    the count. Holds the best and the last row of the open group from batch to batch, nothing else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = last = None
        before = groups = 0  # rows of the open group before `last`; groups closed so far

        def out(t: pa.Table, tail: np.ndarray, first: np.ndarray, n: np.ndarray, number: np.ndarray) -> Iterator[pa.RecordBatch]:
            rows = t.slice(1, len(tail))
            lead = t.take(pa.array(first))
            run_no = rows["run"].to_numpy().astype(np.int64)
            prefix = np.frombuffer(b"".join(rows["digest"].to_pylist()), ">u8").reshape(-1, 4)[:, 0].astype(np.uint64)
            columns = {c: rows[c] for c in ("doc_id", "row", *KEY)} | {"best_id": lead["doc_id"], "best_row": lead["row"], "points": lead["points"], "n": pa.array(n), "tail": pa.array(tail)}
            columns |= {"group": pa.array(run_no << 40 | number), "node": pa.array(next_node(run_no & ((1 << bits) - 1), prefix, bits, 0).astype(np.int32))}
            yield from pa.table(columns).to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            t = pa.concat_tables([new.slice(0, 1), new] if best is None else [best, last, new])
            head = _heads(_keys(t))
            head[0], head[1] = True, False  # row 0 stands for the open group's best row
            start = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
            n = np.arange(len(head)) - start + 1
            n[start == 0] += before - 1
            number = groups + np.cumsum(head) - 1
            tail = head[2:]  # of rows 1 to the last but one
            yield from out(t, tail, start[1:-1], n[1:-1], number[1:-1])
            best, last, before, groups = t.slice(int(start[-1]), 1), t.slice(len(head) - 1, 1), int(n[-1]) - 1, int(number[-1])
        if best is not None:
            yield from out(pa.concat_tables([best, last]), np.array([True]), np.array([0]), np.array([before + 1]), np.array([groups]))

    return run


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, bits: int | None = None) -> DataFrame:
    """Groups documents whose texts are equal without white space; one row for each row of docs.

    Each input partition sorts its rows by digest (Spark's external sort) and is written once, as a sorted run in
    which the last row of each digest carries the group's best document and count. The runs' group rows then go
    through binomial rounds over 2^bits nodes (about the shuffle partitions): in each round sets of 16 nodes whose
    numbers differ in four bits exchange runs, each node keeping the digests whose bits are its own, and merge what
    they get multiway; the best document is kept at every level, and digests merge only if SHA-256, length in bytes
    and a second hash agree. A node gets at most one row of a digest from each of 16 others, so no group gathers in a
    task, however large. After the last round a node holds one stretch of digests with the final groups, which return
    by digest to the runs' group rows and from there, by group number, to the documents.

    Defined cases: null text is empty; empty or all-white texts are one group; the row with the most code points in
    its original text stays, of those the smallest doc_id (null ids last), of rows that repeat an id and have equally
    long texts the one read first, so exactly one row of a group is kept. Texts of any length are hashed whole by
    built-in functions; an empty table gives no rows. Other columns are ignored.

    Columns: doc_id, keep_id, group_size, kept, text_sha256, and with row_col (unique longs of docs) that column.
    """
    spark = docs.sparkSession
    importable(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = min(MOST_BITS, max(0, (parts - 1).bit_length())) if bits is None else bits
    bare = F.regexp_replace(text_of(text_col), f"{SPACE}+", "")
    row = F.col(f"`{row_col}`") if row_col else F.monotonically_increasing_id()
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), row.alias("row"), text_of(text_col).alias("_t"), bare.alias("_b")).select(
        "doc_id",
        "row",
        F.spark_partition_id().alias("run"),
        F.unhex(F.sha2("_b", 256)).alias("digest"),
        F.octet_length("_b").cast("long").alias("n_bytes"),
        F.xxhash64("_b").alias("witness"),
        F.length("_t").cast("long").alias("points"),
    )
    id_field = T.StructField("doc_id", base.schema["doc_id"].dataType)
    keyed = [T.StructField("digest", T.BinaryType()), T.StructField("n_bytes", T.LongType()), T.StructField("witness", T.LongType())]
    marks = [T.StructField("best_id", id_field.dataType), *(T.StructField(c, T.LongType()) for c in ("best_row", "points", "n")), T.StructField("tail", T.BooleanType()), T.StructField("group", T.LongType()), T.StructField("node", T.IntegerType())]
    in_order = base.sortWithinPartitions("digest", "n_bytes", "witness", F.desc("points"), F.asc_nulls_last("doc_id"), "row")
    runs = staged(in_order.mapInArrow(_marked(bits), T.StructType([id_field, T.StructField("row", T.LongType()), *keyed, *marks])), "exact-runs")
    up = runs.where("tail").select(*KEY, "points", F.col("best_id").alias("doc_id"), F.col("best_row").alias("row"), "n", "node")
    schema = up.schema

    def merge(level: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [b for b in batches if b.num_rows]
            if held:
                t = merged_runs(pa.Table.from_batches(held))
                node = next_node(t["node"].to_numpy().astype(np.int64), _keys(t)[:, 0], bits, level + 1)
                yield from t.set_column(t.schema.get_field_index("node"), "node", pa.array(node.astype(np.int32))).to_batches()

        return run

    rounds = max(1, -(-bits // FAN_IN_BITS))
    for level in range(rounds):
        up = up.repartitionById(1 << bits, F.col("node")).mapInArrow(merge(level), schema)
    final = staged(up.select(*KEY, F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.col("n").alias("group_size")), "exact-groups")
    known = runs.where("tail").select("group", *KEY).join(final, KEY).select("group", "digest", "keep_id", "keep_row", "group_size")
    out = runs.select("group", "doc_id", "row").join(known, "group")
    columns = ["doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")]
    return out.select(*columns, *([F.col("row").alias(row_col)] if row_col else []))
