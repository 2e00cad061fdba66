"""Sections, ranges and runs over numbered lines, as window functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sparquill.operators.staging import importable


def sections(lines: DataFrame, is_head: Column, doc: str = "doc_id", line_no: str = "line_no") -> DataFrame:
    """Adds section: how many heads a document has up to a line (0 is the preamble)."""
    run = W.partitionBy(doc).orderBy(line_no).rowsBetween(W.unboundedPreceding, W.currentRow)
    return lines.withColumn("section", F.sum(F.when(is_head, 1).otherwise(0)).over(run))


def next_line(lines: DataFrame, wanted: Column, value: str = "line", doc: str = "doc_id", line_no: str = "line_no") -> Column:
    """The first later value of a line that is wanted."""
    after = W.partitionBy(doc).orderBy(line_no).rowsBetween(1, W.unboundedFollowing)
    return F.first(F.when(wanted, F.col(value)), ignorenulls=True).over(after)


def last_line_no(wanted: Column, doc: str = "doc_id", line_no: str = "line_no") -> Column:
    """The number of the last line up to here that is wanted."""
    run = W.partitionBy(doc).orderBy(line_no).rowsBetween(W.unboundedPreceding, W.currentRow)
    return F.last(F.when(wanted, F.col(line_no)), ignorenulls=True).over(run)


def merge_ranges(ranges: DataFrame, key: str, start: str, end: str, gap: int = 1) -> DataFrame:
    """Ranges that touch (next start within gap of the furthest end so far) become one: key, start, end, merged."""
    order = W.partitionBy(key).orderBy(F.asc_nulls_last(start), F.asc_nulls_last(end))
    reach = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))
    islands = ranges.withColumn("_new", F.when(F.col(start) <= reach + gap, 0).otherwise(1)).withColumn("_island", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return islands.groupBy(key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("merged")).drop("_island")


def overlapping(ranges: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Ranges that begin before an earlier one has ended; none is allowed where this is a check."""
    order = W.partitionBy(key).orderBy(F.asc_nulls_last(start), F.asc_nulls_last(end))
    return ranges.withColumn("_reach", F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))).where(F.col(start) <= F.col("_reach")).drop("_reach")


def without_ranges(lines: DataFrame, ranges: DataFrame, key: str, at: str, start: str, end: str) -> DataFrame:
    """Lines that no range covers: a left anti join on the key with the range as its condition."""
    r = ranges.select(F.col(key).alias("_k"), F.col(start).alias("_s"), F.col(end).alias("_e"))
    return lines.join(r, (F.col(key) == F.col("_k")) & F.col(at).between(F.col("_s"), F.col("_e")), "left_anti")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """The value of the last right row at or before each left row: one sort of the union, no range join."""
    both = left.withColumn("_side", F.lit(1)).unionByName(right.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    run = W.partitionBy(key).orderBy(at, "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    return both.withColumn(value, F.last(F.when(F.col("_side") == 0, F.col(value)), ignorenulls=True).over(run)).where("_side = 1").drop("_side")


def blocks_of(lines: list[str], numbers: list[int], least_seed: int = 40, most_seeds: int = 10, least_lines: int = 5, least_chars: int = 500) -> list[tuple[int, int, int, int, int, int]]:
    """Pairs of equal line blocks of one sequence; see blocks_in_parts(). first_start, first_end, second_start, second_end
    (line numbers), n_lines, n_chars. Equal lines have equal numbers; runs are compared 64 lines at a time."""
    kinds: dict[str, int] = {}
    line = np.array([kinds.setdefault(x, len(kinds)) for x in lines], np.int64)
    upto = np.concatenate(([0], np.cumsum([len(x) for x in lines])))
    count = np.bincount(line, minlength=len(kinds))
    places: dict[int, list[int]] = {}
    for at, k in enumerate(line.tolist()):
        if len(lines[at]) >= least_seed and 2 <= count[k] <= most_seeds:
            places.setdefault(k, []).append(at)
    out = []
    for own in places.values():
        for x, i in enumerate(own):
            for j in own[x + 1 :]:
                # A block of too many lines reaches its second place; one line more is enough to know.
                if i and line[i - 1] == line[j - 1]:
                    continue
                n, limit = 1, min(len(lines) - j, j - i + 1)
                while n < limit:
                    part = min(64, limit - n)
                    differs = np.flatnonzero(line[i + n : i + n + part] != line[j + n : j + n + part])
                    if len(differs):
                        n += int(differs[0])
                        break
                    n += part
                chars = int(upto[i + n] - upto[i])
                if n >= least_lines and i + n <= j and chars >= least_chars:
                    rows = numbers[i : i + n], numbers[j : j + n]
                    out.append((min(rows[0]), max(rows[0]), min(rows[1]), max(rows[1]), n, chars))
    return out


def duplicate_blocks(seq: DataFrame, **limits: int) -> DataFrame:
    """blocks_in_parts() of a sequence in single lines: doc_id, idx (0, 1, ... over non-blank lines), line_no, line."""
    return blocks_in_parts(seq.select("doc_id", F.col("idx").alias("place"), F.array(F.col("line_no").cast("long")).alias("numbers"), F.array("line").alias("lines")), **limits)


def blocks_in_parts(parts: DataFrame, **limits: int) -> DataFrame:
    """Pairs of equal line blocks within the same sequence.

    parts has doc_id (the sequence), place (of a part), numbers and lines (arrays, of a part's non-blank lines in order). A
    seed is a line of least_seed characters or more that occurs 2 to most_seeds times in the sequence; a pair of its places
    counts if the lines before them differ (or one is the first). The block runs to the right while lines are equal, may
    not reach its second place, and needs least_lines lines and least_chars characters.

    The parts of a sequence meet in one shuffle and are sorted by place; a task holds one sequence at a time, and only
    blocks leave it.
    """
    importable(parts.sparkSession)
    kind = parts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lines, numbers, rows = None, [], [], []

        def close() -> None:
            rows.extend((key, *x) for x in blocks_of(lines, numbers, **limits))

        for b in batches:
            for k in range(b.num_rows):
                own = b.column("doc_id")[k].as_py()
                if own != key:
                    close()
                    key, lines, numbers = own, [], []
                lines += b.column("lines")[k].as_py()
                numbers += b.column("numbers")[k].as_py()
            if len(rows) >= 1 << 14:
                yield batch(rows)
                rows = []
        close()
        if rows:
            yield batch(rows)

    names = ["doc_id", "first_start", "first_end", "second_start", "second_end", "n_lines", "n_chars"]
    types = [to_arrow_type(parts.schema["doc_id"].dataType)] + [pa.int64()] * 6
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
    dealt = parts.where("doc_id IS NOT NULL AND lines IS NOT NULL").select("doc_id", "place", "numbers", "lines").repartition("doc_id").sortWithinPartitions("doc_id", "place")
    return dealt.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names[1:]))
