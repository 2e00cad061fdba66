"""Windows over word or byte sequences, the anchors that stand for them, and merged count-min sketches.

A window is `width` consecutive symbols. Its anchor is the gram of `gram` symbols inside it with the lowest hash
(leftmost on ties). Equal windows have equal anchors, so an anchor occurs at least as often as any of its windows:
a count of anchors overestimates the count of windows, and loses none that repeats. Neighbouring windows share
their anchor; such a run of windows is a unit, and there are about 2 / (width - gram + 2) units a symbol.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparquill.llm.common import binary_list, importable, salted_join, slices, staged
from sparquill.operators.sampling import numbered

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: A random value for each byte, so that sums of powers don't inherit the structure of text.
_BYTE = np.random.default_rng(20_231).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: The bytes of text worked on at once; bounds a worker's memory (a longer text stands alone).
SLICE = 2 << 20
BLOCK_BITS = 20
ROWS = 2
HEAVY_BITS = 16
#: An anchor is hot if its units are over the HOT_SHARE-th part of what a task of the exact pass would get on average
#: (at most 2^13 such parts, and over HOT_LEAST units); hot anchors are dealt with window by window, salted, and never gathered in a task.
HOT_SHARE, HOT_LEAST = 2, 64
#: The filter of repeated anchors: its most bits (64 MB), and the bits that one sets.
FILTER_BITS, PROBES = 1 << 29, 3


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        for name, base in (("up", _ODD), ("down", _INVERSE)):
            p = np.full(n + (n >> 2), base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sums(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(len(symbols) + 1)
    total = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * down[: len(symbols)], dtype=np.uint64, out=total[1:])
    return total, up


def run_hashes(symbols: np.ndarray, length: int) -> np.ndarray:
    """The hash of each run of `length` symbols, by its first place."""
    if len(symbols) < length:
        return np.empty(0, np.uint64)
    total, up = _sums(symbols)
    return mix((total[length:] - total[:-length]) * up[: len(symbols) - length + 1])


class Symbols(NamedTuple):
    """Symbols of several texts laid end to end: their hashes, the text of each, and where each text's symbols end."""

    hashes: np.ndarray
    text: np.ndarray
    ends: np.ndarray
    raw: np.ndarray
    first: np.ndarray  # where each symbol begins in raw, and the place after its end
    last: np.ndarray


def byte_symbols(texts: list[bytes]) -> Symbols:
    raw = np.frombuffer(b"".join(texts), np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64)
    at = np.arange(len(raw))
    return Symbols(_BYTE[raw], np.repeat(np.arange(len(texts)), lengths), np.cumsum(lengths), raw, at, at + 1)


def word_symbols(texts: list[bytes]) -> Symbols:
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    blank = _SPACE[raw]
    blank = np.concatenate(([True], blank, [True]))
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    first, last = edge[::2], edge[1::2]
    total, up = _sums(_BYTE[raw])
    hashes = mix((total[last] - total[first]) * up[first] + (last - first).astype(np.uint64) * _ODD)
    text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), first, "right")
    return Symbols(hashes, text, np.searchsorted(text, np.arange(len(texts)), "right"), raw, first, last)


class Units(NamedTuple):
    anchor: np.ndarray  # hash of the anchor
    first: np.ndarray  # first window's place, over all texts
    count: np.ndarray  # windows
    text: np.ndarray
    start: np.ndarray  # first window's place in its text


def find_units(s: Symbols, width: int, gram: int) -> Units:
    none = np.empty(0, np.int64)
    n = len(s.hashes)
    if n < width:
        return Units(np.empty(0, np.uint64), none, none, none, none)
    grams = run_hashes(s.hashes, gram)
    bits = np.uint64(max(1, n.bit_length()))
    mask = (np.uint64(1) << bits) - np.uint64(1)
    low = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)
    span, reach = width - gram + 1, 1
    while reach < span:
        step = min(reach, span - reach)
        low = np.minimum(low[:-step], low[step:])
        reach += step
    ends = s.ends[s.text]
    window = np.flatnonzero(np.arange(n - width + 1) + width <= ends[: n - width + 1])
    if not len(window):
        return Units(np.empty(0, np.uint64), none, none, none, none)
    place = (low[window] & mask).astype(np.int64)
    head = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    first = window[head]
    text = s.text[first]
    starts = np.concatenate(([0], s.ends[:-1]))
    return Units(grams[place[head]], first, np.diff(np.append(head, len(window))), text, first - starts[text])


class Sketch:
    """Counts of anchors that never fall short: ROWS rows of two-bit cells that stop at two, and four coarse rows of
    true counts that find hot anchors. Sketches of the same size merge cell by cell."""

    def __init__(self, bits: int):
        self.bits = max(bits, BLOCK_BITS)
        self.cells = [np.zeros(1 << (self.bits - 2), np.uint8) for _ in range(ROWS)]
        self.heavy = np.zeros((4, 1 << HEAVY_BITS), np.int64)

    @staticmethod
    def places(anchors: np.ndarray, row: int, bits: int) -> np.ndarray:
        return (mix(anchors + np.uint64((row + 1) * int(_ODD) & (1 << 64) - 1)) >> np.uint64(64 - bits)).astype(np.int64)

    def add(self, anchors: np.ndarray) -> None:
        for row, cells in enumerate(self.cells):
            at, n = np.unique(self.places(anchors, row, self.bits), return_counts=True)
            for lane in range(4):  # of a byte's four cells one at a time, so that no byte is written twice at once
                own = (at & 3) == lane
                byte, shift = at[own] >> 2, np.uint8(2 * lane)
                now = cells[byte]
                more = np.minimum((now >> shift & 3) + np.minimum(n[own], 2), 2).astype(np.uint8)
                cells[byte] = now & np.uint8(255 ^ 3 << 2 * lane) | more << shift
        for row in range(4):
            self.heavy[row] += np.bincount(self.places(anchors, 8 + row, HEAVY_BITS), minlength=1 << HEAVY_BITS)

    def blocks(self, heavy: bool = True) -> Iterator[tuple[int, bytes]]:
        size = 1 << (BLOCK_BITS - 2)
        for row, cells in enumerate(self.cells):
            for i in range(0, len(cells), size):
                c = cells[i : i + size]
                if c.any():
                    yield (row << 32) | (i // size), zlib.compress(c.tobytes(), 1)
        if heavy:
            yield 1 << 40, zlib.compress(self.heavy.tobytes(), 1)


def merged_block(kind: int, parts: list[bytes]) -> bytes:
    if kind >> 40:
        return sum(np.frombuffer(p, np.int64) for p in parts).tobytes()
    some = twice = np.zeros(1, np.uint8)
    for p in parts:
        b = np.frombuffer(p, np.uint8)
        own, two = (b | b >> 1) & 0x55, (b >> 1) & 0x55
        twice, some = twice | two | (some & own), some | own
    return ((twice << 1) | (some & ~twice)).astype(np.uint8).tobytes()


class Estimate:
    """A merged sketch as tasks read it."""

    def __init__(self, bits: int, blocks: Iterable[tuple[int, bytes]], tasks: int = 1, hot_units: int | None = None):
        self.bits = max(bits, BLOCK_BITS)
        self.rows = [np.zeros(1 << (self.bits - 2), np.uint8) for _ in range(ROWS)]
        self.heavy = np.zeros((4, 1 << HEAVY_BITS), np.int64)
        size = 1 << (BLOCK_BITS - 2)
        for kind, data in blocks:  # one at a time: no second copy of the sketch
            if kind >> 40:
                self.heavy = np.frombuffer(data, np.int64).reshape(4, -1)
            else:
                i = kind & 0xFFFFFFFF
                self.rows[kind >> 32][i * size : (i + 1) * size] = np.frombuffer(data, np.uint8)
        self.hot_units = max(HOT_LEAST, int(self.heavy[0].sum()) // min(HOT_SHARE * tasks, 1 << HEAVY_BITS - 3)) if hot_units is None else hot_units

    def _cells(self, values: np.ndarray, mask: int) -> np.ndarray:
        out = np.ones(len(values), bool)
        for row, packed in enumerate(self.rows):
            at = Sketch.places(values, row, self.bits)
            out &= (packed[at >> 2] >> (2 * (at & 3)).astype(np.uint8)) & mask > 0
        return out

    def repeated(self, anchors: np.ndarray) -> np.ndarray:
        """True for all that were added twice or more, and few others."""
        return self._cells(anchors, 2)

    def seen(self, values: np.ndarray) -> np.ndarray:
        """True for all that were added, and few others."""
        return self._cells(values, 3)

    def hot(self, anchors: np.ndarray) -> np.ndarray:
        return np.min([self.heavy[row][Sketch.places(anchors, 8 + row, HEAVY_BITS)] for row in range(4)], axis=0) > self.hot_units

    def any_hot(self) -> bool:
        """False proves that no anchor is hot: an anchor's count is at most the least of its cells."""
        return bool((self.heavy.max(axis=1) > self.hot_units).all())


def cells_for(values: float) -> int:
    """Bits of a sketch row with about twice the cells of so many values, 2^20 to 2^27 (64 MB packed for all rows)."""
    return min(27, max(BLOCK_BITS, int(2 * values).bit_length()))


def _merged(rows: DataFrame) -> DataFrame:
    """Rows (kind, data) of sketches' blocks with those of equal kind merged, in two levels so that no task holds the
    blocks of all partitions: first among 64 map tasks each, then over these groups."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, held = None, b""
        out = lambda: pa.RecordBatch.from_arrays([pa.array([kind], pa.int64()), pa.array([zlib.compress(held, 1)], pa.binary())], ["kind", "data"])
        for batch in batches:
            for k, d in zip(batch.column("kind").to_pylist(), batch.column("data"), strict=True):
                data = zlib.decompress(d.as_py())
                if k != kind and kind is not None:
                    yield out()
                    held = b""
                kind, held = k, merged_block(k, [held, data]) if held else data
        if kind is not None:
            yield out()

    schema = "kind long, data binary"
    grouped = rows.withColumn("_group", F.floor(F.spark_partition_id() / 64)).repartition("kind", "_group").sortWithinPartitions("kind", "_group").select("kind", "data").mapInArrow(merge, schema)
    return grouped.repartition("kind").sortWithinPartitions("kind").mapInArrow(merge, schema)


def _collected(rows: DataFrame, bits: int, tasks: int, hot_units: int | None) -> Estimate:
    """The merged sketch on the driver: its size is fixed by `bits`, whatever the number of rows."""
    found = _merged(rows).collect()
    return Estimate(bits, ((r["kind"], zlib.decompress(bytes(r["data"]))) for r in found), tasks, hot_units)


def _row_value(batch: pa.RecordBatch) -> np.ndarray:
    return (batch.column("place").to_numpy().view(np.uint64) * _ODD) ^ batch.column("key").to_numpy().view(np.uint64)


def members(rows: DataFrame, bits: int) -> Estimate:
    """A bounded filter of (place, key): seen() is true for the values of all rows, and for few others."""
    importable(rows.sparkSession)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            own = own or Sketch(bits)
            own.add(_row_value(batch))
        for kind, data in own.blocks(False) if own else ():
            yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int64()), pa.array([data], pa.binary())], ["kind", "data"])

    return _collected(rows.select("place", "key").mapInArrow(sketch, "kind long, data binary"), bits, 1, 0)


class Frame(NamedTuple):
    """Rows ready for window passes: see framed()."""

    rows: DataFrame  # doc_id, place, key, text and further columns
    first: DataFrame  # place, key of the first row of each distinct text
    copies: DataFrame  # place, key of rows whose text an earlier row has
    n_first: int
    n_bytes: int  # of the distinct texts


def framed(docs: DataFrame, id_col: str, text_col: str, *also: str) -> Frame:
    """Gives rows an order, and tells whole copies from first rows, so that window passes need only the latter.

    place orders the documents: the id itself if it is integral (other types: its rank, by a distributed sort), null
    ids after all others by a 61-bit hash of their texts. key (32 bits of another hash of the text) tells rows of one
    place apart and orders them. A whole text that an earlier row has is found by its SHA-256, in narrow rows that
    combine before they are shuffled; a text that a third of the rows have is no hot key, as copies join salted.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].alias("doc_id"), text.alias("text"), *also)
    if rows.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long"):
        place = F.col("doc_id").cast("long")
    else:
        known = rows.where("doc_id IS NOT NULL")
        ids = numbered(known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), "doc_id").withColumnRenamed("k", "rank")
        rows = salted_join(known, ids, ["doc_id"], "n", F.xxhash64("text")).drop("n").unionByName(rows.where("doc_id IS NULL").withColumn("rank", F.lit(None).cast("long")))
        place = F.col("rank").cast("long")
    late = F.lit(1 << 61) + F.xxhash64(F.lit("place"), "text").bitwiseAND((1 << 61) - 1)
    rows = rows.select("doc_id", F.coalesce(place, late).alias("place"), F.xxhash64("text").bitwiseAND((1 << 32) - 1).alias("key"), "text", *also)
    narrow = staged(rows.select("place", "key", F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").cast("long").alias("bytes")), "texts")
    first = staged(narrow.groupBy("digest").agg(F.min(F.struct("place", "key")).alias("first"), F.max("bytes").alias("bytes"), F.count(F.lit(1)).alias("n")), "texts-first")
    size = first.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    many = salted_join(narrow.drop("bytes"), first.where("n > 1").drop("bytes"), ["digest"], "n", F.xxhash64("place", "key"))
    copies = many.where((F.col("place") != F.col("first.place")) | (F.col("key") != F.col("first.key"))).select("place", "key")
    return Frame(rows, first.select("first.place", "first.key"), copies, size["n"], size["bytes"])


class Repeated:
    """The anchors that occur twice or more, as tasks look them up, and the hot ones.

    An anchor's mixed hash names its region (leading bits) and a 32-bit value within it. Each region has its own bits of
    a Bloom filter with PROBES probes, so a region's filter is made where the region was counted, and never merged. Only
    what repeats takes space in it, however many anchors occur once."""

    def __init__(self, region_bits: int, cells: int, filters: Iterable[tuple[int, bytes]], hot: np.ndarray):
        self.region_bits, self.cells, self.hot_names = region_bits, cells, np.sort(hot)
        self.packed = np.zeros((1 << region_bits) * (cells >> 3), np.uint8)
        for region, data in filters:
            self.packed[region * (cells >> 3) : (region + 1) * (cells >> 3)] = np.frombuffer(data, np.uint8)

    @staticmethod
    def names(anchors: np.ndarray, region_bits: int) -> np.ndarray:
        """Region and value, as one number of region_bits + 32 bits."""
        return mix(anchors + _ODD) >> np.uint64(32 - region_bits)

    @staticmethod
    def places(values: np.ndarray, cells: int) -> Iterator[np.ndarray]:
        for k in range(PROBES):
            yield ((values * np.uint64((2 * k * 0x9E3779B1 + 1) & 0xFFFFFFFF) & np.uint64(0xFFFFFFFF)) * np.uint64(cells) >> np.uint64(32)).astype(np.int64)

    @classmethod
    def region_filter(cls, values: np.ndarray, cells: int) -> bytes:
        bits = np.zeros(cells, bool)
        for at in cls.places(values, cells):
            bits[at] = True
        return np.packbits(bits, bitorder="little").tobytes()

    def repeated(self, anchors: np.ndarray) -> np.ndarray:
        """True for all that occur twice or more, and few others."""
        out = np.ones(len(anchors), bool)
        if not len(self.packed):
            return ~out
        names = self.names(anchors, self.region_bits)
        base = (names >> np.uint64(32)).astype(np.int64) * self.cells
        for at in self.places(names & np.uint64(0xFFFFFFFF), self.cells):
            at += base
            out &= (self.packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
        return out

    def hot(self, anchors: np.ndarray) -> np.ndarray:
        return np.isin(self.names(anchors, self.region_bits), self.hot_names)

    def any_hot(self) -> bool:
        return len(self.hot_names) > 0


def _packed_values(values: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted distinct 32-bit values and how often each occurs: differences, byte by byte, which compress."""
    rows = [np.diff(values, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T, counts.astype("<u8").view(np.uint8).reshape(-1, 8).T]
    return len(values).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(b"".join([x.tobytes() for x in rows]))


def _unpacked_values(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(block[:4], "little")
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(block[4:]), np.uint8)
    values = np.cumsum(np.ascontiguousarray(data[: 4 * n].reshape(4, n).T).view("<u4")[:, 0], dtype=np.uint64)
    return values, np.ascontiguousarray(data[4 * n :].reshape(8, n).T).view("<u8")[:, 0].astype(np.int64)


def _summed(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, with the sums of their counts."""
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    head = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return values[head], np.add.reduceat(counts, head)


def repeated_anchors(rows: DataFrame, keep: Keep, split: Split, width: int, gram: int, n_units: float, hot_units: int | None = None, part: int = SLICE) -> Repeated:
    """First pass, exact: each partition counts its anchors and deals them over regions by hash, where the counts are
    summed; a hot anchor reaches its region as one number a block. Regions keep what occurs twice or more, as a table; a
    filter of it, at most FILTER_BITS whatever the input, and at most some 2 x tasks hot anchors come to the driver."""
    spark = rows.sparkSession
    importable(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    region_bits = min(14, max(8, (int(n_units) >> 20).bit_length()))
    parts_of_hot = min(HOT_SHARE * tasks, 1 << HEAVY_BITS - 3)

    def blocks(names: np.ndarray) -> pa.RecordBatch:
        values, counts = np.unique(names, return_counts=True)
        region = (values >> np.uint64(32)).astype(np.int32)
        cut = np.flatnonzero(np.diff(region, prepend=-1, append=-1))
        values &= np.uint64(0xFFFFFFFF)
        data = [_packed_values(values[x:y], counts[x:y]) for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(region[cut[:-1]]), pa.array(data, pa.binary())], ["region", "block"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in slices(map(keep, batches), "text", part):
            found = find_units(split(binary_list(batch.column("text"))), width, gram).anchor
            if len(found):
                held.append(Repeated.names(found, region_bits))
            if sum(map(len, held)) >= 1 << 20:
                yield blocks(np.concatenate(held))
                held = []
        if held:
            yield blocks(np.concatenate(held))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region, held = None, (np.empty(0, np.uint64), np.empty(0, np.int64))
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            values, counts = _summed(*map(np.concatenate, zip(held, *waiting, strict=True)))
            n, twice = int(counts.sum()), counts > 1
            values, counts = values[twice], counts[twice]
            most = np.flatnonzero(counts > (max(HOT_LEAST, n // parts_of_hot) if hot_units is None else hot_units))
            if hot_units is None:  # no more anchors than this can be hot, in all regions together
                most = most[np.argsort(-counts[most], kind="stable")[:parts_of_hot]]
            hot = values[most].astype("<u8").tobytes() + counts[most].astype("<u8").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([region], pa.int32()), pa.array([n], pa.int64()), pa.array([len(values)], pa.int64()), pa.array([_packed_values(values, counts)], pa.binary()), pa.array([hot], pa.binary())], names)

        names = ["region", "units", "repeated", "block", "hot"]
        for batch in batches:
            for k, block in zip(batch.column("region").to_pylist(), batch.column("block"), strict=True):
                if k != region and region is not None:
                    yield out()
                    held, waiting = (held[0][:0], held[1][:0]), []
                region = k
                waiting.append(_unpacked_values(block.as_py()))
                if sum(len(v) for v, _ in waiting) > len(held[0]) + (1 << 18):
                    held, waiting = _summed(*map(np.concatenate, zip(held, *waiting, strict=True))), []
        if region is not None:
            yield out()

    dealt = rows.select("place", "key", "text").mapInArrow(count, "region int, block binary").repartitionById(tasks, F.col("region") % tasks).sortWithinPartitions("region")
    counted = staged(dealt.mapInArrow(total, "region int, units long, repeated long, block binary, hot binary"), "anchors")
    known = counted.select("region", "units", "repeated", "hot").collect()
    units, repeated = sum(r["units"] for r in known), sum(r["repeated"] for r in known)
    limit = max(HOT_LEAST, units // parts_of_hot) if hot_units is None else hot_units
    hot = [np.empty(0, np.uint64)]
    for r in known:
        values, counts = np.frombuffer(bytes(r["hot"]), "<u8").reshape(2, -1)
        hot.append(values[counts > limit] | np.uint64(r["region"] << 32))
    cells = min(FILTER_BITS, max(1 << 18, 10 * repeated)) >> region_bits >> 3 << 3

    def filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, block in zip(batch.column("region").to_pylist(), batch.column("block"), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([Repeated.region_filter(_unpacked_values(block.as_py())[0], cells)], pa.binary())], ["region", "data"])

    found = counted.select("region", "block").mapInArrow(filters, "region int, data binary").collect()
    return Repeated(region_bits, cells, ((r["region"], bytes(r["data"])) for r in found), np.concatenate(hot))


Keep = Callable[[pa.RecordBatch], pa.RecordBatch]


def first_rows(frame: Frame) -> Keep:
    """A filter of batches with place and key, for tasks: drops rows that are surely whole copies. It reads a bounded
    set of the first rows; a copy that slips through changes no result, it only costs time."""
    known = frame.rows.sparkSession.sparkContext.broadcast(members(frame.first, cells_for(4 * frame.n_first)))
    return lambda batch: batch.filter(pa.array(known.value.seen(_row_value(batch)))) if batch.num_rows else batch


Split = Callable[[list[bytes]], Symbols]


def build_sketch(rows: DataFrame, keep: Keep, split: Split, width: int, gram: int, bits: int, hot_units: int | None = None) -> Estimate:
    """First pass: each partition sketches the anchors of the rows (place, key, text) that `keep` leaves; blocks of
    equal place meet and merge. Only the merged sketch, of a size fixed by `bits`, comes to the driver."""
    importable(rows.sparkSession)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in slices(map(keep, batches), "text", SLICE):
            own = own or Sketch(bits)
            own.add(find_units(split(binary_list(batch.column("text"))), width, gram).anchor)
        for kind, data in own.blocks() if own else ():
            yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int64()), pa.array([data], pa.binary())], ["kind", "data"])

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _collected(rows.select("place", "key", "text").mapInArrow(sketch, "kind long, data binary"), bits, tasks, hot_units)


def runs_of(flags: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of true flags; a run stays within a group (groups are contiguous)."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at
    head = np.concatenate(([True], (np.diff(at) != 1) | (groups[at][1:] != groups[at][:-1])))
    return at[head], at[np.append(head[1:], True)]
