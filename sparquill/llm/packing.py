"""Best-fit packing of token sequences, bulk-synchronously over size-sorted documents and gaps."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.llm.bpe_stream import byte_alphabet
from sparquill.llm.common import importable, slices, staged

CACHE = 250_000
_encoders: dict[int, tuple[bytes, WordEncoder]] = {}
#: Letters that lower-casing maps one to one and that no normal form changes, and a tail of ASCII punctuation.
PLAIN = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xde\xdf-\xf6\xf8-\xff]+)([!-/:-@\[-`{-~]*)")


class WordEncoder:
    """Word -> its ids as little-endian bytes, for a BPE with word ends that drops white space.

    Words of plain letters, with or without a tail of punctuation, are two pieces at most and are merged here; all
    others go to the tokenizers library, which defines the ids. Two generations of at most CACHE words are kept.
    """

    def __init__(self, spec: bytes):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec.decode())
        self.library.no_truncation()
        self.library.no_padding()
        model = json.loads(spec)["model"]
        vocab, self.end = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merge = {vocab[a] << 20 | vocab[b]: (rank << 20) | vocab[a + b] for rank, (a, b) in reversed([*enumerate(pairs)])}
        shown = {b: c for c, b in byte_alphabet().items()}
        self.inner = [vocab.get(shown[b], -1) for b in range(256)]
        self.last = [vocab.get(shown[b] + self.end, -1) for b in range(256)]
        self.closes = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a word
        self.closes[[i for t, i in vocab.items() if self.end and t.endswith(self.end)]] = True
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {"": b""}

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            data, merge = piece.encode(), self.merge
            ids = [*map(self.inner.__getitem__, data[:-1]), self.last[data[-1]]]
            ranks = [merge.get(a << 20 | b, 1 << 60) for a, b in zip(ids, ids[1:], strict=False)]
            while ranks:
                best = min(ranks)
                if best == 1 << 60:
                    break
                i = ranks.index(best)
                ids[i : i + 2] = [best & 0xFFFFF]
                del ranks[i]
                if i < len(ranks):
                    ranks[i] = merge.get(ids[i] << 20 | ids[i + 1], 1 << 60)
                if i:
                    ranks[i - 1] = merge.get(ids[i - 1] << 20 | ids[i], 1 << 60)
            found = array("I", ids).tobytes()
            if len(self.pieces) > CACHE:
                self.pieces = {"": b""}
            self.pieces[piece] = found
        return found

    def _add_pieces(self, new: list[str]) -> None:
        """Adds the ids of letter pieces to their memo. The library merges them, laid end to end between blanks; each ends
        with its only id that closes a word. Should that not hold for a vocabulary, they are merged here."""
        if len(self.pieces) + len(new) > CACHE:
            self.pieces = {"": b""}
        for i in range(0, len(new) if self.end else 0, 20_000):
            part = new[i : i + 20_000]
            ids = np.array(self.library.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = (np.flatnonzero(self.closes[ids]) + 1).tolist()
            if len(ends) == len(part) and ends[-1] == len(ids):
                raw, at = ids.tobytes(), 0
                for piece, end in zip(part, ends, strict=True):
                    self.pieces[piece] = raw[4 * at : 4 * end]
                    at = end

    def learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """The memo, after all the words have been added to it."""
        if len(self.known) + len(words) > CACHE:
            self.known, self.older = {}, self.known
        known, older, hard = self.known, self.older, []
        new = words - known.keys()
        again = older.keys() & new
        known.update({w: older[w] for w in again})
        new -= again
        # Columns in place of rows: a tuple for each word would be work for the garbage collector.
        simple = [w for w in new if w.isalpha() and len(w) < 200]
        lower = [w.lower().decode() for w in simple]
        plain: list[bytes] = []
        letters: list[str] = []
        tails: list[str] = []
        for w in new.difference(simple):
            if len(w) < 200 and (m := PLAIN.fullmatch(w.decode())) is not None:
                plain.append(w)
                letters.append(m[1].lower())
                tails.append(m[2])
            elif w:
                hard.append(w)
            else:
                known[w] = b""
        self._add_pieces(list({*lower, *letters} - self.pieces.keys()))
        known.update(zip(simple, map(self._piece, lower), strict=True))
        for w, piece, tail in zip(plain, letters, tails, strict=True):
            known[w] = self._piece(piece) + self._piece(tail)
        for i in range(0, len(hard), 20_000):
            part = hard[i : i + 20_000]
            for w, e in zip(part, self.library.encode_batch([w.decode() for w in part], add_special_tokens=False), strict=True):
                known[w] = array("I", e.ids).tobytes()
        return known


def encoded_texts(encoder: WordEncoder, column: pa.Array) -> list[bytes]:
    """The ids of each text of a column (null: none), as little-endian bytes. Only distinct words become objects."""
    words = pa.compute.ascii_split_whitespace(pa.compute.fill_null(column, "").cast(pa.large_string()))
    ends = words.offsets.to_numpy() - words.offsets[0].as_py()
    coded = words.flatten().cast(pa.large_binary()).dictionary_encode()
    word, found = coded.indices.to_numpy(), coded.dictionary
    _, cuts, data = found.buffers()
    cuts, data = np.frombuffer(cuts, "<i8", len(found) + 1).tolist() if len(found) else [0], bytes(data or b"")
    distinct = [data[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
    ids = [*map(encoder.learn(set(distinct)).__getitem__, distinct)]
    pool = np.frombuffer(b"".join(ids), "<u4")
    size = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
    first = np.cumsum(size) - size
    n = size[word]
    to = np.concatenate(([0], np.cumsum(n)))
    raw = pool[np.repeat(first[word] - to[:-1], n) + np.arange(to[-1])].tobytes()
    at = (4 * to[ends]).tolist()
    return [raw[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]


def _encoder(spec: bytes) -> WordEncoder:
    """One encoder for each vocabulary and Python worker."""
    found = _encoders.get(hash(spec))
    if found is None or found[0] != spec:
        found = _encoders[hash(spec)] = (spec, WordEncoder(spec))
    return found[1]


def cut_pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenizes whole texts and cuts what is longer than capacity: doc_id, piece, start, length, ids_crc32.

    The vocabulary must drop white space before it splits words (then ASCII white space separates words for good),
    so words are encoded once and memoised as the bytes of their ids.
    """
    importable(docs.sparkSession)
    with open(vocabulary, "rb") as f:
        spec = f.read()
    frame = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    id_type = frame.schema["doc_id"].dataType.simpleString()
    tail, step = np.array([end_id], dtype="<u4").tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(spec)
        for batch in slices(batches, "text", 6 << 20):
            rows: list[tuple[int, int, int, int, int]] = []
            for at, ids in enumerate(encoded_texts(encoder, batch.column("text"))):
                ids += tail
                for piece, i in enumerate(range(0, len(ids), step)):
                    part = ids[i : i + step]
                    rows.append((at, piece, i // 4, len(part) // 4, zlib.crc32(part)))
            at, piece, start, length, crc = np.array(rows, dtype=np.int64).T
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return frame.mapInArrow(run, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


def sweep(docs: list[tuple[int, int, int]], gaps: list[tuple[int, int, int]], capacity: int, base: int | None) -> tuple[list, list, list]:
    """One task's successor sweep over runs of documents (length, first rank, count) and of gaps (size, first sequence,
    count): the longest documents first, each run takes the successor run of gaps, the smallest that holds it. Where
    several want the same gaps, the k-th document by rank gets the k-th gap; the gaps shrink and are sorted in again.
    A run that no gap holds opens sequences numbered from `base`, each filled with as many as fit; without `base` it
    is left over. Gives (placed, documents left, gaps left); a placed row is (length, first rank, documents, first
    sequence, sequences, offset, documents in each)."""
    runs: dict[int, deque[tuple[int, int]]] = {}
    order: list[int] = []
    placed, over = [], []

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in runs:
                runs[gap] = deque()
                insort(order, gap)
            runs[gap].append((first, n))

    for gap in sorted(gaps):
        put(*gap)
    for length, rank, left in sorted(docs, key=lambda d: (-d[0], d[1])):
        while left:
            i = bisect_left(order, length)
            if i < len(order):
                gap = order[i]
                first, n = runs[gap].popleft()
                m = min(n, left)
                if m < n:
                    runs[gap].appendleft((first + m, n - m))
                elif not runs[gap]:
                    del runs[gap]
                    order.pop(i)
                placed.append((length, rank, m, first, m, capacity - gap, 1))
                put(gap - length, first, m)
                rank, left = rank + m, left - m
            elif base is None:
                over.append((length, rank, left))
                break
            else:
                per = capacity // length
                for each, m in ((per, left // per), (left % per, 1)):
                    if each and m:
                        placed.append((length, rank, each * m, base, m, 0, each))
                        put(capacity - each * length, base, m)
                        base, rank, left = base + m, rank + each * m, left - each * m
    return placed, over, [(gap, first, n) for gap in order for first, n in runs[gap]]


PLACED, DOCUMENTS, GAPS = 0, 1, 2
STATE = "kind byte, segment int, size long, first long, n long, sequence long, sequences long, at long, each long"


def best_fit_rounds(spark: SparkSession, counts: dict[int, int], capacity: int, segments: int = 8) -> np.ndarray:
    """Places documents that are counted by length, in bulk-synchronous rounds; rows as of sweep().

    Documents and gaps are tables of runs of equal size, range-sorted into segments of sizes with about as many
    documents each. In a round each segment's task makes a successor sweep over what it holds. Between rounds the
    gaps that are left are updated and move to the highest segment below in which a document is left that they hold;
    only one row a segment (what is left there) comes to the driver. A segment opens sequences once no gap is on its
    way from above. So the highest segment with documents ends in each round, while those below already use the gaps
    that reached them. Tables have at most some rows for each size up to the capacity, however many documents there are.
    """
    importable(spark)
    lengths = sorted(counts, reverse=True)
    total, so_far, segment = max(1, sum(counts.values())), 0, {}
    for n in lengths:  # segment 0 holds the longest
        segment[n] = min(segments - 1, so_far * segments // total)
        so_far += counts[n]
    state = spark.createDataFrame([(DOCUMENTS, segment[n], n, 0, counts[n], 0, 0, 0, 0) for n in lengths], STATE)
    done: list[DataFrame] = []
    busy = {s: True for s in segment.values()}  # segments with documents -> whether a gap may still come from above
    if busy:
        busy[min(busy)] = False
    step = 0
    while busy:
        base = {s: ((step * segments + s) << 36) if not waits else None for s, waits in busy.items()}

        def run(batches: Iterator[pa.RecordBatch], base: dict = base) -> Iterator[pa.RecordBatch]:
            rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("kind", "segment", "size", "first", "n")), strict=True)]
            for s in sorted({r[1] for r in rows}):
                placed, over, gaps = sweep([r[2:] for r in rows if r[:2] == (DOCUMENTS, s)], [r[2:] for r in rows if r[:2] == (GAPS, s)], capacity, base.get(s))
                out = [(PLACED, s, *p) for p in placed] + [(DOCUMENTS, s, *d, 0, 0, 0, 0) for d in over] + [(GAPS, s, *g, 0, 0, 0, 0) for g in gaps]
                if out:
                    columns = zip(*out, strict=True)
                    kinds = [pa.int8(), pa.int32(), *[pa.int64()] * 7]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        names = state.columns
        after = staged(state.repartitionById(segments, F.col("segment")).mapInArrow(run, STATE), "pack-round")
        done.append(after.where(F.col("kind") == PLACED))
        left = after.groupBy("segment", "kind").agg(F.min("size").alias("low"), F.max("size").alias("high")).where(F.col("kind") != PLACED).collect()
        waiting = {r["segment"]: r["low"] for r in left if r["kind"] == DOCUMENTS}
        # A gap goes to the highest segment at or below its own with a document that it holds, or has ended.
        target = F.lit(None).cast("int")
        for s in sorted(waiting, reverse=True):
            target = F.when((F.col("segment") <= s) & (F.col("size") >= waiting[s]), F.lit(s)).otherwise(target)
        moved = after.where(F.col("kind") == GAPS).withColumn("segment", target).where("segment IS NOT NULL")
        state = after.where(F.col("kind") == DOCUMENTS).unionByName(moved)
        # From above gaps may come as long as documents are left there, or gaps that have just been sent.
        busy = {s: any(o < s for o in waiting) for s in waiting}
        step += 1
    rows = [tuple(r)[2:] for part in done for r in part.collect()]
    return np.array(rows, dtype=np.int64).reshape(-1, 7)


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to pieces (column length, 1 to capacity).

    The pieces are range-sorted by length over all tasks and written once. A task then holds a contiguous stretch of
    lengths, so (task, length, count) has one row for each task plus at most one for each length; from these few rows
    come each piece's rank among those of its length and the runs that best_fit_rounds places. Each task looks up its
    own ranks in the placed runs by binary search. No task gets a length's rows together, so ties in length are no
    hot key.
    """
    spark = pieces.sparkSession
    importable(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = pieces.repartitionByRange(parts, F.col("length"), F.xxhash64("doc_id", "piece")).sortWithinPartitions("length").withColumn("_task", F.spark_partition_id())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for b in batches:
            yield b.append_column("_row", pa.array(np.arange(at, at + b.num_rows), pa.int64()))
            at += b.num_rows

    sorted_pieces = staged(ranged.mapInArrow(number, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema) + ", _row long"), "pack-sorted")
    runs = sorted_pieces.groupBy("_task", "length").agg(F.count(F.lit(1)).alias("n"), F.min("_row").alias("first")).collect()
    counts: dict[int, int] = {}
    first_rank: dict[tuple[int, int], int] = {}
    for r in sorted(runs, key=lambda r: (r["length"], r["_task"])):
        first_rank[r["_task"], r["length"]] = counts.get(r["length"], 0) - r["first"]
        counts[r["length"]] = counts.get(r["length"], 0) + r["n"]
    plan = best_fit_rounds(spark, counts, capacity)
    order = np.lexsort((plan[:, 1], plan[:, 0])) if len(plan) else np.empty(0, np.int64)
    plan = plan[order]
    rows = np.array([(t, n, shift) for (t, n), shift in sorted(first_rank.items())], dtype=np.int64).reshape(-1, 3)
    keep = [f.name for f in pieces.schema]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run_key, plan_key = rows[:, 0] * (capacity + 1) + rows[:, 1], np.stack([plan[:, 0], plan[:, 1]])
        starts = np.searchsorted(plan_key[0], np.arange(capacity + 2))
        for b in batches:
            length, task, row = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_task", "_row"))
            rank = row + rows[np.searchsorted(run_key, task * (capacity + 1) + length), 2]
            step = np.empty(len(rank), np.int64)
            for n in np.unique(length):
                own = length == n
                step[own] = starts[n] + np.searchsorted(plan_key[1][starts[n] : starts[n + 1]], rank[own], "right") - 1
            p = plan[step]
            i = rank - p[:, 1]
            sequence, offset = p[:, 3] + i // p[:, 6], p[:, 5] + (i % p[:, 6]) * length
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    return sorted_pieces.mapInArrow(place, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents into as few sequences of at most `capacity` tokens as best-fit decreasing finds.

    Each document is its ids and one end_id. Only longer ones are cut; a cut document's full pieces fill a sequence
    each. Defined cases: null or empty text is the end_id alone; repeated rows and equal lengths are packed like any
    others; an empty table gives no rows. Other columns are ignored.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    return pack(staged(cut_pieces(docs, vocabulary, capacity, end_id, id_col, text_col), "pack-pieces"), capacity)
