"""Substring dedup over word windows with a count-min prefilter."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparquill.llm.anchors import SLICE, Frame, Keep, Symbols, build_sketch, cells_for, find_units, first_rows, framed, runs_of, word_symbols
from sparquill.llm.common import binary_list, importable, salted_join, slices, staged

WIDTH, GRAM = 20, 8
DIGEST = 16
RANGES = "place long, key long, first int, last int"


def _ranges(place: np.ndarray, key: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(place), pa.array(key), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], ["place", "key", "first", "last"])


def window_digests(s: Symbols, at: np.ndarray, width: int) -> bytes:
    """The 128-bit BLAKE2b digests of the windows that begin at the words `at`: of their very words, joined by blanks."""
    words = b" ".join(s.raw.tobytes().split())
    size = s.last - s.first
    begin = np.cumsum(size + 1) - size - 1
    stop = begin[at + width - 1] + size[at + width - 1]
    digest = hashlib.blake2b
    return b"".join([digest(words[x:y], digest_size=DIGEST).digest() for x, y in zip(begin[at].tolist(), stop.tolist(), strict=True)])


def repeated_ranges(frame: Frame, keep: Keep, width: int = WIDTH, gram: int = GRAM, hot_units: int | None = None) -> DataFrame:
    """Ranges of windows (place, key, first, last) that also start earlier.

    Second pass: only units whose anchor the sketch counts twice or more are emitted, with the 128-bit digests of
    their windows' words, and meet by anchor. Windows are equal if their digests are. Anchors that the sketch counts as
    hot are never gathered: their windows are rows, whose first occurrence is a minimum that combines before the
    shuffle, and which a salted join brings back. Whole copies of an earlier row take no part: they are covered
    from end to end, and all their windows start in that row.
    """
    rows = frame.rows.select("place", "key", "text")
    spark = rows.sparkSession
    importable(spark)
    estimate = spark.sparkContext.broadcast(build_sketch(rows, keep, word_symbols, width, gram, cells_for(frame.n_bytes * 2 / ((width - gram + 2) * 6)), hot_units))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def units(hot: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = estimate.value
            for batch in slices(map(keep, batches), "text", SLICE):
                s = word_symbols(binary_list(batch.column("text")))
                u = find_units(s, width, gram)
                take = np.flatnonzero(known.repeated(u.anchor))
                take = take[known.hot(u.anchor[take]) == hot]
                if not len(take):
                    continue
                place, key = (batch.column(c).to_numpy()[u.text[take]] for c in ("place", "key"))
                at = np.repeat(u.first[take] - np.concatenate(([0], np.cumsum(u.count[take])[:-1])), u.count[take]) + np.arange(u.count[take].sum())
                own = window_digests(s, at, width)
                if hot:
                    unit = np.repeat(np.arange(len(take)), u.count[take])
                    start = u.start[take][unit] + at - u.first[take][unit]
                    window = pa.Array.from_buffers(pa.binary(DIGEST), len(at), [None, pa.py_buffer(own)]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([window, pa.array(place[unit]), pa.array(key[unit]), pa.array(start.astype(np.int32))], ["window", "place", "key", "start"])
                else:
                    offsets = np.concatenate(([0], np.cumsum(u.count[take] * DIGEST))).astype(np.int32)
                    data = pa.Array.from_buffers(pa.binary(), len(take), [None, pa.py_buffer(offsets), pa.py_buffer(own)])
                    yield pa.RecordBatch.from_arrays([pa.array(u.anchor[take].view(np.int64)), pa.array(place), pa.array(key), pa.array(u.start[take].astype(np.int32)), data], ["anchor", "place", "key", "start", "windows"])

        return run

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            table = pa.Table.from_batches(held).combine_chunks()
            anchor = table["anchor"].to_numpy()
            cut = len(anchor) if last else int(np.searchsorted(anchor, anchor[-1]))
            held = [] if last else table.slice(cut).to_batches()
            if not cut:
                return
            table = table.slice(0, cut)
            windows = table["windows"].to_pylist()
            count = np.array([len(x) // DIGEST for x in windows])
            unit = np.repeat(np.arange(cut), count)
            window = np.frombuffer(b"".join(windows), "<i8").reshape(-1, 2)
            place, key, start = (table[c].to_numpy() for c in ("place", "key", "start"))
            begin = start[unit] + np.arange(len(unit)) - np.repeat(np.cumsum(count) - count, count)
            # Of equal windows the first by place, key and start stays. Rows that repeat a document (equal place, key
            # and start) all stay or all go.
            order = np.lexsort((begin, key[unit], place[unit], window[:, 1], window[:, 0]))
            w, p, k, b = window[order], place[unit][order], key[unit][order], begin[order]
            head = np.concatenate(([True], (w[1:] != w[:-1]).any(axis=1)))
            lead = np.flatnonzero(head)[np.cumsum(head) - 1]
            flags = np.zeros(len(unit), bool)
            flags[order] = (p != p[lead]) | (k != k[lead]) | (b != b[lead])
            first, end = runs_of(flags, unit)
            if len(first):
                yield _ranges(place[unit[first]], key[unit[first]], begin[first], begin[end])

        waiting = 0
        for batch in batches:
            held.append(batch)
            waiting += batch.num_rows
            if waiting >= 100_000:
                yield from flush(False)
                waiting = sum(b.num_rows for b in held)
        if held:
            yield from flush(True)

    cold = rows.mapInArrow(units(False), "anchor long, place long, key long, start int, windows binary")
    found = cold.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(group, RANGES)
    if not estimate.value.any_hot():
        return found
    hot = staged(rows.mapInArrow(units(True), "window binary, place long, key long, start int"), "hot-windows")
    firsts = staged(hot.groupBy("window").agg(F.min(F.struct("place", "key", "start")).alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1"), "hot-firsts")
    later = salted_join(hot, firsts, ["window"], "n", F.xxhash64("place", "key", "start")).where(F.struct("place", "key", "start") != F.col("lead"))
    return found.unionByName(later.select("place", "key", F.col("start").alias("first"), F.col("start").alias("last")))


def covered(ranges: list | None, n: int, width: int) -> np.ndarray:
    """Which of n symbols the windows of the ranges cover."""
    depth = np.zeros(n + 1, np.int64)
    if ranges and n >= width:
        first, last = np.array(ranges, np.int64).T
        np.add.at(depth, first, 1)
        np.add.at(depth, np.minimum(last + width, n), -1)
    return np.cumsum(depth[:-1]) > 0


def compressed(rows: DataFrame, keep: Keep, size: Callable[[bytes], int], width: int) -> DataFrame:
    """rows with their text as Zstandard bytes, for a shuffle that texts only pass through, and a column copied: the
    symbols of a text that is surely a whole copy of an earlier row's and long enough to have a window (then the text
    itself is not sent along, as nothing is left of it), else 0."""
    names = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in slices(batches, "text"):
            first = keep(batch.select(["place", "key"]).append_column("at", pa.array(np.arange(batch.num_rows)))).column("at").to_pylist()
            texts, copied = binary_list(batch.column("text")), [0] * batch.num_rows
            for i in set(range(batch.num_rows)) - set(first):
                n = size(texts[i])
                if n >= width:
                    texts[i], copied[i] = b"", n
            data = pa.array([pack(t) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), data, pa.array(copied, pa.int64())], [*names, "text", "copied"])

    return rows.select(*names, "text").mapInArrow(run, T.StructType([*(rows.schema[c] for c in names), T.StructField("text", T.BinaryType()), T.StructField("copied", T.LongType())]))


def with_ranges(frame: Frame, keep: Keep, ranges: DataFrame, size: Callable[[bytes], int], width: int) -> DataFrame:
    """frame.rows as compressed() gives them, with a column ranges: the array of (first, last) of each document, null if
    it has none. Whole copies of an earlier row have a range from end to end. size counts a text's symbols."""
    whole = frame.copies.select("place", "key", F.lit(0).alias("first"), F.lit((1 << 31) - 1).alias("last"))
    # Distinct ranges of a text are fewer than its symbols, so gathering them is as bounded as the text.
    mine = ranges.unionByName(whole).groupBy("place", "key").agg(F.collect_set(F.struct("first", "last")).alias("ranges"))
    mine = mine.withColumn("ranges", F.transform("ranges", lambda r: F.array(r["first"], r["last"])))
    return compressed(frame.rows, keep, size, width).join(mine, ["place", "key"], "left")


def n_words(text: bytes) -> int:
    return len(text.split())


def substring_dedup(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", texts: bool = True, gram: int = GRAM, hot_units: int | None = None) -> DataFrame:
    """Words that a repeated window of `width` words covers, removed from all but its first occurrence.

    Defined cases: null text has no words; texts of fewer than `width` words lose none; the order of occurrences is
    doc_id (null last), of one doc_id (or none) a hash of the text, then the place in the text, so a window of two
    different texts under one id stays in one of them; rows that repeat id and text lose what one such row would; an
    id may be of any type that sorts; a text of any length is worked through whole (a task holds it once, with some
    60 bytes for each word); an empty table gives no rows. Other columns are ignored.

    Columns: doc_id, n_words, n_removed, kept_sha256 and, with texts, kept_text (the text without the removed words;
    the white space before kept words stays, and an untouched text is returned as it is).
    """
    frame = framed(docs, id_col, text_col)
    keep = first_rows(frame)
    full = with_ranges(frame, keep, repeated_ranges(frame, keep, width, gram, hot_units), n_words, width)
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in slices(batches, "text", 1 << 20):
            rows = []
            for data, copied, ranges in zip(*(batch.column(c).to_pylist() for c in ("text", "copied", "ranges")), strict=True):
                if copied:
                    rows.append((copied, copied, hashlib.sha256().hexdigest(), ""))
                    continue
                text = unpack(data)
                words = text.split()
                if ranges:
                    gone = covered(ranges, len(words), width)
                    kept = [words[i] for i in np.flatnonzero(~gone)]
                    text = _without(text, gone) if texts else b""
                else:
                    kept = words
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), text.decode() if texts else ""))
            n, removed, digest, text = zip(*rows, strict=True)
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(text, pa.string())]
            yield pa.RecordBatch.from_arrays(columns[: 4 + texts], names[: 4 + texts])

    id_type = frame.rows.schema["doc_id"].dataType.simpleString()
    return full.select("doc_id", "text", "copied", "ranges").mapInArrow(cut, f"doc_id {id_type}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts)


def without_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """docs with the text of each row as substring_dedup keeps it, and size_col, if docs have it, its length.

    All rows stay, and all columns, whatever their names. A text that loses nothing is unchanged, null included, and
    so is its size. Order and other cases as in substring_dedup.
    """
    schema = docs.schema
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in schema.names if c != text_col], F.col(f"`{text_col}`").isNull().alias(f"{text_col} is null")).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    frame = framed(own, "id", "text", "row")
    keep = first_rows(frame)
    full = with_ranges(frame, keep, repeated_ranges(frame, keep, width), n_words, width).select("row", "text", "copied", "ranges")
    sized = size_col in schema.names

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in slices(batches, "text", 1 << 20):
            texts, sizes = [], []
            parts = batch.column("row").flatten()
            old = dict(zip([c for c in schema.names if c != text_col], parts[:-1], strict=True))
            for data, copied, none, size, ranges in zip(batch.column("text").to_pylist(), batch.column("copied").to_pylist(), parts[-1].to_pylist(), old[size_col].to_pylist() if sized else [None] * batch.num_rows, batch.column("ranges").to_pylist(), strict=True):
                text = unpack(data)
                if copied:
                    size = 0
                elif ranges:
                    gone = covered(ranges, len(text.split()), width)
                    if gone.any():
                        text = _without(text, gone)
                        size = len(text.decode())
                texts.append(None if none else text.decode())
                sizes.append(size)
            old[text_col] = pa.array(texts, pa.string())
            if sized:
                old[size_col] = pa.array(sizes, old[size_col].type)
            yield pa.RecordBatch.from_arrays([old[c] for c in schema.names], schema.names)

    return full.mapInArrow(cut, schema)


def _without(text: bytes, gone: np.ndarray) -> bytes:
    """The text without its removed words, each taken out with the white space before it."""
    raw = np.frombuffer(text, np.uint8)
    blank = np.isin(raw, np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))
    first = ~blank & np.concatenate(([True], blank[:-1]))
    # A byte belongs to the word that it is in, or that follows it; what follows the last word stays.
    owner = np.where(blank, np.cumsum(first), np.cumsum(first) - 1)
    stays = np.append(~gone, True)[owner]
    return raw[stays].tobytes().lstrip(b" \t\n\r\x0b\x0c") if gone[:1].any() else raw[stays].tobytes()
