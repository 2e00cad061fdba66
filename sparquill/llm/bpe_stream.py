"""Byte-level BPE as a streaming transducer with bounded lookahead, and the inverse state machine."""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sparquill.llm.common import importable, slices

#: The public split pattern of byte-level BPE.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Between a character that is no white space and one that is, the pattern above always cuts.
SEGMENT = r"\s*\S+|\s+"
CACHE = 250_000
#: Characters of text whose segments are cut at once, and those of a segment that leaves in parts.
CHUNK, LONG = 1 << 16, 1 << 12
#: Bytes of pieces that are merged by scans, and together; no merge; bytes of texts whose new pieces are merged together.
SHORT, NONE, TOGETHER = 48, 1 << 60, 2 << 20


class Memo(dict):
    """A bounded memo: entries live in two generations of CACHE, and those used again move to the younger."""

    def __init__(self):
        super().__init__()
        self.older: dict = {}

    def put(self, key: str, value: object) -> None:
        if len(self) >= CACHE:
            self.older = dict(self)
            self.clear()
        self[key] = value

    def add(self, more: dict) -> None:
        if len(self) + len(more) > CACHE:
            self.older = dict(self)
            self.clear()
        self.update(more)

    def again(self, key: str) -> object:
        """What get(), which looks at the younger generation only, may have missed."""
        found = self.older.get(key)
        if found is not None:
            self.put(key, found)
        return found


def _pack(ids: list[int]) -> tuple[str, bytes]:
    return ",".join(map(str, ids)), array("I", ids).tobytes()


def byte_alphabet() -> dict[str, int]:
    """Character -> byte: printable bytes stand for themselves, the others follow from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def sufficient_lookahead(merged: Iterable[str]) -> int:
    """Bytes beyond a token's end after which its boundary can no longer change, from the merge list in rank order.

    A merge can be pre-empted from the right only by an earlier-ranked merge whose string begins with an end of its
    own string and reaches further; that one again only by a still earlier one. The longest such chain bounds what
    can matter. Each merge extends the best chain of its suffixes and offers itself under its proper prefixes.
    """
    reach: dict[str, int] = {}
    most = 1
    for m in merged:
        own = max((reach.get(m[i:], 0) for i in range(len(m))), default=0)
        most = max(most, len(m) + own)
        for i in range(1, len(m)):
            if reach.get(m[:i], 0) < len(m) - i + own:
                reach[m[:i]] = len(m) - i + own
    return most


class Transducer:
    """Encodes text to ids and back; what it holds is bounded by CHUNK, the lookahead and CACHE."""

    def __init__(self, spec: bytes):
        model = json.loads(spec)
        vocab = model["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["model"]["merges"]]
        self.alphabet = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        self.first = [0] * 256
        for c, b in self.alphabet.items():
            self.first[b] = vocab[c]
        self.merge = {vocab[a] << 20 | vocab[b]: (r << 20) | vocab[a + b] for r, (a, b) in reversed([*enumerate(merges)])}
        self.lookahead = sufficient_lookahead(a + b for a, b in merges)
        self.pieces: dict[int, bytes] = {i: bytes(self.alphabet[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self.split = regex.compile(SPLIT)
        self.segment = regex.compile(SEGMENT)
        self.marks = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.plain_segment, self.odd = re.compile(SEGMENT), re.compile("[\x1c-\x1f]")
        self.edge = re.compile("(?<=[^\\s\x1c-\x1f])[^\\S\x1c-\x1f]")
        self.loose = any("<" not in t for t in self.special)
        self.known, self.segments = Memo(), Memo()
        self.pairs = np.array(sorted(self.merge), np.int64)
        self.merged = np.array([self.merge[k] for k in self.pairs.tolist()], np.int64)

    def _short(self, data: bytes) -> list[int]:
        ids, get, none = [self.first[b] for b in data], self.merge.get, 1 << 60
        ranks = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            ids[i] = best & 0xFFFFF
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(ids[i] << 20 | ids[i + 1], none)
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | ids[i], none)
        return ids

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merges of pairs, NONE where there is none."""
        pair = left << 20 | right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.merged[at], NONE)

    def short_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """The merges of many pieces of at most SHORT bytes at once, as _short() has them: from the longest down, all
        pieces that consist of n tokens make their next merge together, and go on with those of n - 1."""
        out: list[list[int]] = [[]] * len(pieces)
        if not len(self.pairs):
            return [[self.first[b] for b in p] for p in pieces]
        by: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            by.setdefault(len(p), []).append(i)
        first = np.array(self.first, np.int64)
        own, ids, ranks = np.empty(0, np.int64), np.empty((0, 0), np.int64), np.empty((0, 0), np.int64)
        for n in range(max(by, default=0), 0, -1):
            if not len(own):
                ids, ranks = np.empty((0, n), np.int64), np.empty((0, n - 1), np.int64)
            if n in by:
                new = first[np.frombuffer(b"".join([pieces[i] for i in by[n]]), np.uint8).reshape(-1, n)]
                own, ids = np.concatenate((own, np.array(by[n]))), np.concatenate((ids, new))
                ranks = np.concatenate((ranks, self._ranks(new[:, :-1], new[:, 1:])))
            if not len(own):
                continue
            at = ranks.argmin(axis=1) if n > 1 else np.zeros(len(own), np.int64)  # the leftmost on ties
            best = ranks[np.arange(len(own)), at] if n > 1 else np.full(len(own), NONE)
            go = best < NONE
            for i, row in zip(own[~go].tolist(), ids[~go].tolist(), strict=True):
                out[i] = row
            own, at, best = own[go], at[go], best[go]
            row = np.arange(len(own))
            shift = np.arange(n - 1) + (np.arange(n - 1) > at[:, None])
            ids, ranks = np.take_along_axis(ids[go], shift, 1), np.take_along_axis(ranks[go], shift[:, : max(0, n - 2)], 1)
            ids[row, at] = best & 0xFFFFF
            k = np.flatnonzero(at < n - 2)
            ranks[k, at[k]] = self._ranks(ids[k, at[k]], ids[k, at[k] + 1])
            k = np.flatnonzero(at > 0)
            ranks[k, at[k] - 1] = self._ranks(ids[k, at[k] - 1], ids[k, at[k]])
        return out

    def learn(self, texts: Iterable[str]) -> list[list[str] | None]:
        """The segments of each text of up to CHUNK characters (None for a longer one), after those that are new have
        been added to the memo: their new pieces are merged together."""
        ready = [next(self._chunks(text), []) if len(text) <= CHUNK else None for text in texts]
        words: list[str] = []
        others: dict[str, list[str]] = {}
        found = set().union(*filter(None, ready)) - self.segments.keys()
        again = self.segments.older.keys() & found
        self.segments.add({s: self.segments.older[s] for s in again})
        for s in found - again:
            if len(s) < SHORT and s.isascii() and (s if s[0] != " " else s[1:]).isalpha():
                words.append(s)  # one piece
            elif len(s) < 64 and not self._marked(s):
                others[s] = self.split.findall(s)
        known, older = self.known, self.known.older
        pieces = {p for own in others.values() for p in own} - known.keys()
        known.add({p: older[p] for p in pieces & older.keys()})
        pieces = [p for p in pieces - known.keys() if len(p.encode()) <= SHORT]
        for i in range(0, len(words), 20_000):
            part = words[i : i + 20_000]
            self.segments.add(dict(zip(part, map(_pack, self.short_pieces([*map(str.encode, part)])), strict=True)))
        for i in range(0, len(pieces), 20_000):
            part = pieces[i : i + 20_000]
            known.add(dict(zip(part, self.short_pieces([*map(str.encode, part)]), strict=True)))
        get = known.get
        self.segments.add({s: _pack([t for p in own for t in (get(p) or [x for part in self._piece(p) for x in part])]) for s, own in others.items()})
        return ready

    def _whole(self, data: bytes) -> list[int]:
        """The merges of a piece: lowest rank first, leftmost on ties."""
        if len(data) <= SHORT:
            return self._short(data)
        n, merge = len(data), self.merge
        ids, right, left = [self.first[b] for b in data], [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := merge.get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], right[i] = m & 0xFFFFF, -1, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for k in (left[i], i):
                if k >= 0 and right[k] >= 0 and (q := merge.get(ids[k] << 20 | ids[right[k]])) is not None:
                    heapq.heappush(heap, (q, k, ids[k], ids[right[k]]))
        return [x for x in ids if x >= 0]

    def stream(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Ids of one piece that arrives in chunks; a token leaves once `lookahead` bytes follow its end."""
        held = b""
        for chunk in chunks:
            held += chunk
            while len(held) > 2 * self.lookahead:
                head = held[: 2 * self.lookahead]
                done, stable = 0, len(head) - self.lookahead
                for t in self._whole(head):
                    if done + len(self.pieces[t]) > stable:
                        break
                    done += len(self.pieces[t])
                    yield t
                held = held[done:]
        yield from self._whole(held)

    def _piece(self, piece: str) -> Iterator[list[int]] | tuple[list[int]]:
        """The ids of a piece, in parts: a long one leaves the stream bit by bit."""
        ids = self.known.get(piece) or self.known.again(piece)
        if ids is None:
            data = piece.encode()
            if len(data) > 2 * self.lookahead:
                ids = self.stream(data[i : i + self.lookahead] for i in range(0, len(data), self.lookahead))
                return iter(lambda: list(islice(ids, 4096)), [])
            ids = self._whole(data)
            if len(piece) < 64:
                self.known.put(piece, ids)
        return (ids,)

    def _plain(self, text: str) -> Iterator[list[int]]:
        for p in self.split.finditer(text):
            yield from self._piece(p.group())

    def _marked(self, segment: str) -> bool:
        """Whether a special token's string may stand in it."""
        return self.marks is not None and (self.loose or "<" in segment) and self.marks.search(segment) is not None

    def encode_segment(self, segment: str) -> Iterator[list[int]]:
        """The ids of a segment, in parts."""
        if not self._marked(segment):
            yield from self._plain(segment)
            return
        at = 0
        for m in self.marks.finditer(segment):
            yield from self._plain(segment[at : m.start()])
            yield [self.special[m.group()]]
            at = m.end()
        yield from self._plain(segment[at:])

    def _segment(self, segment: str) -> list[int]:
        """The ids of a segment that isn't long, at once."""
        if self._marked(segment):
            return [t for ids in self.encode_segment(segment) for t in ids]
        out: list[int] = []
        for p in self.split.findall(segment):
            ids = self.known.get(p)
            if ids is None:
                ids = [t for part in self._piece(p) for t in part]
            out += ids
        return out

    def _chunks(self, text: str) -> Iterator[list[str]]:
        """The segments of some CHUNK characters at a time; a chunk ends where a segment does."""
        at = 0
        while at < len(text):
            cut = self.edge.search(text, at + CHUNK)
            end = cut.start() if cut else len(text)
            part = text[at:end] if at or cut else text
            # re counts U+001C to U+001F as white space, the split pattern's alphabet doesn't; otherwise they agree.
            yield (self.segment if self.odd.search(part) else self.plain_segment).findall(part)
            at = end

    def encode_blocks(self, text: str, ready: list[str] | None = None) -> Iterator[tuple[str, bytes]]:
        """A text's ids block by block, as decimals joined by commas and as little-endian longs. All that is held is
        a chunk of segments, the stream's lookahead and the memo: constant, whatever the text's length. `ready` is what
        learn() gave for the text."""
        find = self.segments.get
        for chunk in self._chunks(text) if ready is None else (ready,):
            out: list[tuple[str, bytes]] = [*map(find, chunk)]
            if None not in out:
                chunk = ()
            else:
                out = []
            for s in chunk:
                got = find(s) or self.segments.again(s)
                if got is None:
                    if len(s) >= LONG:
                        if out:
                            yield ",".join([x[0] for x in out]), b"".join([x[1] for x in out])
                            out = []
                        yield from map(_pack, filter(None, self.encode_segment(s)))
                        continue
                    got = _pack(self._segment(s))
                    if len(s) < 64:
                        self.segments.put(s, got)
                out.append(got)
            if out:
                yield ",".join([x[0] for x in out]), b"".join([x[1] for x in out])

    def encode(self, text: str) -> list[int]:
        return [t for _, raw in self.encode_blocks(text) for t in array("I", raw)]

    def decode(self, ids: Iterable[int], chunk: int = 4096) -> Iterator[str]:
        """The text, part by part: bytes go through an incremental UTF-8 machine, so a part never splits a character."""
        machine, part = codecs.getincrementaldecoder("utf-8")("replace"), []
        for t in ids:
            part.append(self.pieces[t])
            if len(part) == chunk:
                yield machine.decode(b"".join(part))
                part = []
        yield machine.decode(b"".join(part), True)


_machines: dict[int, tuple[bytes, Transducer]] = {}


def machine_of(spec: bytes) -> Transducer:
    """One transducer for each vocabulary and Python worker."""
    found = _machines.get(hash(spec))
    if found is None or found[0] != spec:
        found = _machines[hash(spec)] = (spec, Transducer(spec))
    return found[1]


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes each whole text with the byte-level BPE of the tokenizer file `vocabulary`, and decodes it again.

    Every text goes through the transducer: it is cut where the split pattern always cuts, a segment's tokens are
    stable at its end, those of a long piece once the lookahead has been read, and what is emitted goes straight into
    the digests and through the decoder's state machine, so neither ids nor decoded text of a document are held.

    Defined cases: null text is empty (no ids, the digests of nothing); strings of special tokens in a text become
    those tokens; repeated rows give a row each; an empty table gives no rows; texts and pieces of any length are
    streamed. Other columns are ignored. The file is read by the driver and sent along (about 1.5 MB).

    Columns: doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256.
    """
    importable(docs.sparkSession)
    with open(vocabulary, "rb") as f:
        spec = f.read()
    frame = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    id_type = frame.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine_of(spec)
        pieces = [m.pieces.get(i, b"") for i in range(max(m.pieces) + 1)]
        for batch in slices(batches, "text", TOGETHER):
            rows = []
            texts = [text or "" for text in batch.column("text").to_pylist()]
            for text, ready in zip(texts, m.learn(texts), strict=True):
                n, comma, ids_sha, text_sha = 0, b"", hashlib.sha256(), hashlib.sha256()
                machine = codecs.getincrementaldecoder("utf-8")("replace")
                for decimals, raw in m.encode_blocks(text, ready):
                    ids_sha.update(comma + decimals.encode())
                    ids = array("I", raw)
                    text_sha.update(machine.decode(b"".join([pieces[t] for t in ids])).encode())
                    n, comma = n + len(ids), b","
                text_sha.update(machine.decode(b"", True).encode())
                rows.append((n, ids_sha.hexdigest(), text_sha.hexdigest()))
            counts, digests, decoded = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return frame.mapInArrow(run, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")
