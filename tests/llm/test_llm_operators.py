"""Small fixtures for each training-data operator: nulls, empty, odd and long texts, ties, repeats, clashing names, empty tables."""

import collections
import hashlib
import itertools
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sparquill.llm import anchors, licenses, packing, queries, quality_classifier, toxicity
from sparquill.llm import suffix_array as sa
from sparquill.llm.bpe_stream import Transducer, round_trip, sufficient_lookahead
from sparquill.llm.exact_dedup import exact_groups
from sparquill.llm.licenses import KNOWN, scan
from sparquill.llm.packing import best_fit_rounds, pack_documents
from sparquill.llm.quality_rules import quality_rules
from sparquill.llm.simhash import GrayIndex, gray_rank, near_groups, shard_links
from sparquill.llm.substring_dedup import substring_dedup, without_repeats
from sparquill.llm.suffix_dedup import suffix_dedup
from sparquill.llm.toxicity import held_out

CLASH = "keep_id string, run int, score string, place int, kept int, row int, row_ int, text_ string, _text string, _null int, n int, key int"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"
EXTRA = ("clash", 1, "clash", 2, 3, 4, 5, "clash", "clash", 6, 7, 8)
PASSAGE = " ".join(f"word{i}" for i in range(60))
LONG = " ".join(f"{i * 7919 % 10007:x}" for i in range(60_000))
TEXTS = [
    (0, "alpha beta " + PASSAGE), (1, None), (2, ""), (3, " \n\t "), (4, "Gamma " + PASSAGE + " delta"), (5, "alpha beta " + PASSAGE), (5, "alpha beta " + PASSAGE),
    (6, "x" * 9000 + " é漢字 \x85 \x1c <|endoftext|> it's"), (7, ("la " * 40).strip()), (None, "no id at all " + PASSAGE), (8, "alpha  beta\n" + PASSAGE), (9, "tiny"),
    (10, LONG), (11, "head " + LONG + "\ntail"), (None, None), (None, "no id at all " + PASSAGE),
]


def table(spark, texts, schema=SCHEMA):
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, f"src{(i or 0) % 2}" if i != 2 else None, len(t) if t else None, *EXTRA) for i, t in texts], schema)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, TEXTS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def bare(t):
    return "".join(c for c in t or "" if c not in " \t\n\r\x0b\x0c")


def sha(t):
    return hashlib.sha256(t if isinstance(t, bytes) else t.encode()).hexdigest()


@pytest.mark.parametrize("bits", [None, 0, 6])
def test_exact_groups(docs, none, bits):
    got = exact_groups(docs.repartition(3), bits=bits).collect()
    assert len(got) == len(TEXTS) and exact_groups(none, bits=bits).count() == 0
    groups = collections.defaultdict(list)
    for i, t in TEXTS:
        groups[bare(t)].append((-len(t or ""), i is None, i))
    by_text = collections.defaultdict(list)
    for r in got:
        by_text[r["text_sha256"]].append(r)
    for text, rows in groups.items():
        found = by_text[sha(text)]
        best = min(rows)[2]
        assert {(r["keep_id"], r["group_size"]) for r in found} == {(best, len(rows))} and len(found) == len(rows)
        assert [r["doc_id"] for r in found if r["kept"]] == [best]  # one row, also of rows that repeat each other


def best_fit(sizes, capacity):
    bins = []
    for x in sorted(sizes, reverse=True):
        fits = [b for b in range(len(bins)) if bins[b] >= x]
        if fits:
            bins[min(fits, key=lambda b: bins[b])] -= x
        else:
            bins.append(capacity - x)
    return len(bins)


def test_rounds_pack_as_well_as_best_fit_decreasing(spark):
    rng = np.random.default_rng(0)
    for segments in (1, 5):
        sizes = np.minimum(120, 1 + rng.lognormal(3, 0.8, 700).astype(int)).tolist()
        plan = best_fit_rounds(spark, dict(collections.Counter(sizes)), 120, segments)
        filled = collections.Counter()
        ranks = collections.defaultdict(list)
        for length, rank, n, first, sequences, offset, each in plan.tolist():
            assert n == sequences * each
            ranks[length] += range(rank, rank + n)
            for s in range(first, first + sequences):
                filled[s] += each * length
        assert all(sorted(ranks[n]) == list(range(sizes.count(n))) for n in set(sizes))
        assert max(filled.values()) <= 120 and len(filled) <= best_fit(sizes, 120) + 1
    assert len(best_fit_rounds(spark, {}, 120)) == 0


def test_packing(docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.no_truncation()
    got = pack_documents(docs, path, 64).collect()
    assert pack_documents(none, path, 64).count() == 0
    want = collections.Counter()
    for i, x in TEXTS:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 64)):
            part = np.array(ids[at : at + 64], "<u4").tobytes()
            want[i, piece, at, len(part) // 4, zlib.crc32(part)] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    rows = collections.defaultdict(list)
    for r in got:
        rows[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in rows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64


def test_round_trip(docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.no_truncation()
    want = collections.Counter((i, len(ids := t.encode(x or "", add_special_tokens=False).ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))) for i, x in TEXTS)
    assert collections.Counter(map(tuple, round_trip(docs, path).collect())) == want and round_trip(none, path).count() == 0


def test_transducer_on_odd_and_long_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.no_truncation()
    with open(path, "rb") as f:
        m = Transducer(f.read())
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab \n\x1c\x1f?1é<|　'st") for _ in range(rng.randrange(200))) for _ in range(500)]
    texts += ["\n" * 70_000 + "x" + " " * 70_000, "word " * 40_000, "<|endoftext|>" * 3, "a?\x1cb"]
    texts += ["".join(rng.choice(letters) for _ in range(30_000)) for letters in ("abcdethinos", "a", "é漢x")]
    for x in texts:
        ids = t.encode(x, add_special_tokens=False).ids
        assert m.encode(x) == ids and "".join(m.decode(ids, 7)) == t.decode(ids, skip_special_tokens=False)


def test_lookahead_suffices_for_every_short_string():
    """Over small merge lists: what a window of the lookahead leaves settled is what the whole string gives."""
    rng = random.Random(4)
    for _ in range(40):
        parts, merges = ["a", "b"], []
        for _ in range(rng.randrange(1, 6)):
            a, b = rng.choice(parts), rng.choice(parts)
            if a + b not in parts and len(a + b) <= 5:
                merges.append((a, b))
                parts.append(a + b)
        most = sufficient_lookahead(a + b for a, b in merges)

        def encode(text, merges=merges):
            ids = list(text)
            for a, b in merges:  # by rank, leftmost first
                out, i = [], 0
                while i < len(ids):
                    if i + 1 < len(ids) and (ids[i], ids[i + 1]) == (a, b):
                        out.append(a + b)
                        i += 2
                    else:
                        out.append(ids[i])
                        i += 1
                ids = out
            return ids

        for text in map("".join, itertools.product("ab", repeat=11)):
            whole = encode(text)
            for n in range(most + 1, 11):
                at = 0
                for token in encode(text[:n]):
                    at += len(token)
                    if at > n - most:
                        break
                    assert at in list(itertools.accumulate(map(len, whole))), (merges, text, n)


def test_stream_needs_only_its_lookahead():
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        m = Transducer(f.read())
    rng = random.Random(1)
    for letters in ("abcdethinos-=", "a", "ab"):
        text = "".join(rng.choice(letters) for _ in range(4 * m.lookahead)).encode()
        assert list(m.stream(text[i : i + 999] for i in range(0, len(text), 999))) == m._whole(text)


def in_order(rows):
    """Rows as the window operators order them: by id, null last, then by hashes of the text; rows that repeat id and
    text once."""
    signed = lambda t, seed: int(np.uint64(xxhash.xxh64_intdigest(t.encode(), seed)).view(np.int64))
    own = {(i, t or "") for i, t in rows}
    place = lambda t: signed(t, xxhash.xxh64_intdigest(b"place", 42)) & (1 << 61) - 1
    return sorted(own, key=lambda r: (r[0] is None, place(r[1]) if r[0] is None else r[0], signed(r[1], 42) & (1 << 32) - 1))


def brute_words(rows, width=20):
    seen, out = set(), {}
    for i, x in in_order(rows):
        w = x.encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            k = tuple(w[s : s + width])
            if k in seen:
                gone[s : s + width] = [True] * width
            seen.add(k)
        out[i, x] = (len(w), sum(gone), sha(b" ".join(a for a, g in zip(w, gone, strict=True) if not g)))
    return collections.Counter((i, *out[i, t or ""]) for i, t in rows)


def brute_bytes(rows, width=50):
    first, out, place = {}, {}, {}
    for at, (i, x) in enumerate(in_order(rows)):
        place.setdefault(("null", at) if i is None else i, at)
        here, t = place[("null", at) if i is None else i], x.encode()
        gone = bytearray(len(t))
        for s in range(len(t) - width + 1):
            if first.setdefault(t[s : s + width], here) < here:
                gone[s : s + width] = b"\1" * width
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out[i, x] = (len(t), len(t) - len(kept), sum(gone[j] and (j == 0 or not gone[j - 1]) for j in range(len(t))), sha(kept))
    return collections.Counter((i, *out[i, t or ""]) for i, t in rows)


def rows_of(df):
    return collections.Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("hot", [None, 1])
def test_substring_dedup(docs, none, hot):
    assert rows_of(substring_dedup(docs, texts=False, hot_units=hot)) == brute_words(TEXTS) and substring_dedup(none).count() == 0


@pytest.mark.parametrize("hot", [None, 1])
def test_suffix_dedup(docs, none, hot):
    assert rows_of(suffix_dedup(docs, texts=False, hot_units=hot)) == brute_bytes(TEXTS) and suffix_dedup(none).count() == 0


def test_windows_are_equal_by_content(spark):
    """Two words that a polynomial hash modulo 2^64 can't tell apart, in otherwise equal windows."""
    turn = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = turn.translate(str.maketrans("ab", "ba"))
    side = " ".join(f"w{i}" for i in range(10))
    rows = [(1, f"{side} {turn} {side}"), (2, f"{side} {other} {side}"), (3, f"{turn} {side} {side}"), (4, f"{side} {turn} {side}")]
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), texts=False)
    assert rows_of(got) == brute_words(rows) and {r["n_removed"] for r in got.where("doc_id = 2").collect()} == {0}


def test_windows_of_ids_that_are_shared_missing_or_texts(spark):
    shared = " ".join(f"u{i}" for i in range(40))
    rows = [(1, "one " + shared), (1, "two " + shared), (None, "three " + shared), (None, "four " + shared), (0, "x"), (1, "one " + shared)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(substring_dedup(df, texts=False)) == brute_words(rows)
    assert rows_of(suffix_dedup(df, texts=False)) == brute_bytes(rows)
    named = [(None if i is None else f"id{i}", t) for i, t in rows]
    df = spark.createDataFrame(named, "doc_id string, text string")
    assert rows_of(substring_dedup(df, texts=False)) == brute_words(named)
    assert rows_of(suffix_dedup(df, texts=False)) == brute_bytes(named)


def test_without_repeats_keeps_rows_and_columns(docs, none):
    got = without_repeats(docs)
    assert got.columns == docs.columns and got.count() == docs.count() and without_repeats(none).count() == 0
    rows = {r["doc_id"]: r for r in got.collect()}
    assert rows[0]["text"] == TEXTS[0][1] and rows[1]["text"] is None and rows[2]["text"] == "" and rows[4]["text"] == "Gamma delta" and rows[4]["n_chars"] == 11
    assert rows[11]["text"] == "head\ntail" and rows[5]["text"] == "" and rows[5]["n_chars"] == 0 and rows[9]["_null"] == 6
    assert without_repeats(docs.drop("n_chars")).columns == [c for c in docs.columns if c != "n_chars"]


@pytest.mark.parametrize("buckets", [4096, 2])
def test_suffix_array_against_sorting(monkeypatch, buckets):
    monkeypatch.setattr(sa, "MOST_BUCKETS", buckets)
    rng = random.Random(0)
    for _ in range(150):
        s = [rng.randrange(1, rng.choice([2, 3, 27])) for _ in range(rng.randrange(1, 100))] + [0]
        assert sa.suffix_array(np.array(s)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])
    raw = np.frombuffer(b"abcabcabd" * 3 + bytes(64), np.uint8)
    places = np.array(sorted(range(20), key=lambda i: bytes(raw[i:])))
    common = [0] + [next(k for k in range(51) if k == 50 or raw[a + k] != raw[b + k]) for a, b in itertools.pairwise(places.tolist())]
    assert sa.permuted_prefixes(raw, places, 50).tolist() == common


def fingerprint(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < size else [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]
    counts = np.zeros(64, int)
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        counts += np.array([h >> b & 1 for b in range(64)])
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def merged(marks):
    """A number for the component of each (id, fingerprint), and the smallest id of each component, by comparing all."""
    label = list(range(len(marks)))
    changed = True
    while changed:
        changed = False
        for (a, (_, x)), (b, (_, y)) in itertools.combinations(enumerate(marks), 2):
            if (x ^ y).bit_count() <= 3 and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    low = {}
    for n, (i, _) in zip(label, marks, strict=True):
        low[n] = min([x for x in (i, low.get(n)) if x is not None], default=None)
    return label, low


def components(marks):
    label, low = merged(marks)
    return collections.Counter((i, f"{f:016x}", low[n]) for n, (i, f) in zip(label, marks, strict=True))


def near_texts():
    rng = random.Random(2)
    words = [f"v{i}" for i in range(400)]
    rows = []
    for i in range(12):
        base = [rng.choice(words) for _ in range(300)]
        for k in range(4):
            own = list(base)
            for _ in range(k):
                own[rng.randrange(300)] = rng.choice(words)
            rows.append((100 + 10 * i + k, " ".join(own)))
    return rows


def test_near_groups(spark, docs, none):
    rows = [(i, t) for i, t in TEXTS if t is None or len(t) < 50_000] + near_texts()
    got = rows_of(near_groups(table(spark, rows)))
    assert got == components([(i, fingerprint(t)) for i, t in rows]) and near_groups(none).count() == 0
    assert near_groups(docs).count() == len(TEXTS)


def planted_codes():
    rng = random.Random(3)
    codes = {rng.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1}
    codes |= {c ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) for c in list(codes) for _ in range(3)}
    return np.array(sorted(x & (1 << 64) - 1 for x in codes), np.uint64)


def test_gray_index_finds_all_pairs():
    codes = planted_codes()
    codes = codes[np.argsort(gray_rank(codes))]
    got = {(int(a), int(b)) for q, i in GrayIndex(codes).search(codes, 3, most=64) for a, b in zip(q, i, strict=True)}
    assert got == set(zip(*map(np.ndarray.tolist, np.nonzero(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 3)), strict=True))
    later = {(int(a), int(b)) for q, i in GrayIndex(codes).search(codes, 3, np.arange(len(codes))) for a, b in zip(q, i, strict=True)}
    assert later == {(a, b) for a, b in got if a < b}


def test_shards_link_what_all_pairs_link():
    codes = planted_codes()
    codes = codes[np.argsort(gray_rank(codes))]
    cut = len(codes) // 3
    links = [x for own, more in ((codes[:cut], []), (codes[cut:], [codes[:cut]])) for x in shard_links(own, iter(more))]
    label = {c: c for c in codes.tolist()}
    for a, b in ((a, b) for x, y in links for a, b in zip(x.tolist(), y.tolist(), strict=True)):
        old, new = label[a], label[b]
        label = {c: new if v == old else v for c, v in label.items()}
        assert (a ^ b).bit_count() <= 3 or label[a] == label[b]
    for x, y in itertools.combinations(codes.tolist(), 2):
        if (x ^ y).bit_count() <= 3:
            assert label[x] == label[y]


def test_quality_rules(docs, none, spark):
    got = {r["doc_id"]: r for r in quality_rules(docs).collect()}
    assert quality_rules(none).count() == 0 and got[1]["n_words"] == 0 and got[1]["base_failed"] and not got[1]["kept"]
    assert got[7]["n_repeat_words"] == 40 and got[7]["base_failed"] and got[0]["kept"] and got[4]["n_repeat_words"] == 0 and got[10]["n_words"] == 60_000
    many = spark.createDataFrame([(i, "Common footer line number 7 with some words\n" + (" ".join(chr(97 + i % 26) * (i // 26 + 1) + "xy" * k for k in range(20)) if i % 2 else "")) for i in range(60)], "doc_id long, text string").withColumn("source", F.lit("s"))
    kept = {r["doc_id"]: r["kept"] for r in quality_rules(many).collect()}
    assert all(kept[i] == bool(i % 2) for i in range(60) if i % 2) and not any(kept[i] for i in range(0, 60, 2))


def test_license_scan(docs, none, spark, monkeypatch):
    assert scan(none).count() == 0 and scan(docs).count() == len(TEXTS)
    mit = next(t for k, t in KNOWN if k == "MIT")
    rows = [(0, "Copyright (c) 1999 Someone Inc. All rights reserved.\n\n" + mit.upper().replace(",", " ;")), (1, mit + " And more."), (2, "Some text.\nReleased under the MIT Licence!\nEnd."), (3, None), (4, "Licence  licence, colour")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in scan(df).collect()}
    assert got[0]["license_id"] == "MIT" and got[1]["license_id"] is None and got[2]["notices"] == ["MIT"] and got[3]["notices"] == []
    assert got[4]["canonical_sha256"] == sha("license license colour")
    own = [("A", "Do it.\n(c) You must retain all notices."), ("B", "word " * 1000)]
    known = spark.createDataFrame(own, "license string, text string")
    texts = [(0, own[0][1]), (1, "Do it.\n(c) something entirely different"), (2, "Intro\n" + own[1][1].strip() + "\n"), (3, "Do it."), (4, "© 2001-2003 A. B. Name\nDo it.\n(c) you must retain all notices"), (5, None)]
    texts = spark.createDataFrame(texts, "doc_id long, text string")
    want = {0: ("A", []), 1: (None, []), 2: (None, ["B"]), 3: (None, []), 4: ("A", []), 5: (None, [])}
    for most in (10_000, 0):
        monkeypatch.setattr(licenses, "MOST_KNOWN", most)
        assert {r["doc_id"]: (r["license_id"], r["notices"]) for r in scan(texts, known).collect()} == want


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    found = duck.execute(queries.SQL[name])
    names = [d[0] for d in found.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(names) == sorted(got.columns)
    assert sorted(repr(tuple(r)) for r in got.select(*names).collect()) == sorted(repr(r) for r in found.fetchall())


def labelled(spark):
    rng = random.Random(0)
    words = [f"w{i:03d}" for i in range(300)]
    rows = []
    for i in range(400):
        text = [rng.choice(words) for _ in range(40)]
        if i % 5 == 0:
            text[rng.randrange(40)] = "blargh" + rng.choice(["s", "ing", "ed"])
        rows.append((i, " ".join(text).upper() + "!!" if i % 4 == 0 else " ".join(text) + ".", "en", f"s{i % 7}", 200, int(i % 4 != 0), int(i % 5 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, quality int, toxic int")
    return df.drop("quality", "toxic"), df.select("doc_id", "quality", "toxic")


def test_toxicity(spark, docs, none):
    d, labels = labelled(spark)
    got = toxicity.toxicity(d, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in got) >= 0.95 * len(got) > 0
    assert toxicity.toxicity(none, labels).count() == 0 and toxicity.toxicity(docs, labels).count() == len(TEXTS)
    assert {r["predicted"] for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0}


def bucket_of(gram):
    h = ord(gram[0])
    for c in gram[1:]:
        h = (h * 0x9E3779B97F4A7C15 + ord(c)) % (1 << 64)
    return ((h ^ h >> 29) * 0xBF58476D1CE4E5B9 % (1 << 64)) >> 64 - toxicity.WIDTH_BITS


def buckets_of(text):
    low = " " + re.sub("[\t-\r]", " ", text.lower()) + " "
    return {bucket_of(low[i : i + n]) for n in toxicity.ORDERS for i in range(len(low) - n + 1)}


def test_toxicity_by_a_plain_computation(spark):
    d, labels = labelled(spark)
    buckets, weights, bias = toxicity.learn(d, labels)
    table = dict(zip(buckets.tolist(), weights.tolist(), strict=True))
    learnt = {r["doc_id"]: r["toxic"] for r in labels.where(~held_out()).collect()}
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    seen = {1: collections.Counter(), 0: collections.Counter()}
    for i, toxic in learnt.items():
        seen[toxic].update(buckets_of(texts[i]))
    n = collections.Counter(learnt.values())
    total = n[0] + n[1]
    chi = {}
    for b in seen[0] | seen[1]:
        p, q = seen[1][b], seen[0][b]
        if p + q >= 2 and p + q < total:
            chi[b] = total * (p * (n[0] - q) - q * (n[1] - p)) ** 2 / ((p + q) * (total - p - q) * n[0] * n[1])
    assert sorted(b for b, x in chi.items() if x > 10.8) == buckets.tolist()  # the features are those that tell the classes apart
    counts = [np.array([seen[k][b] for b in buckets.tolist()]) for k in (1, 0)]
    own, ratio, _ = toxicity.chosen_buckets(buckets, *counts, n[1], n[0])
    assert own.tolist() == buckets.tolist() and ratio.tolist() == pytest.approx([math.log((seen[1][b] + 1) / (n[1] + 2) / ((seen[0][b] + 1) / (n[0] + 2))) for b in own.tolist()])
    for row in toxicity.toxicity(d, labels).where("doc_id < 40").collect():
        z = bias + sum(table.get(b, 0.0) for b in buckets_of(texts[row["doc_id"]]))
        assert row["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-5) and row["predicted"] == int(row["score"] >= 0.3)


def test_quality_classifier(spark, docs, none):
    d, labels = labelled(spark)
    got = quality_classifier.quality_classifier(d, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.9 * len(got) > 0
    assert quality_classifier.quality_classifier(none, labels).count() == 0 and quality_classifier.quality_classifier(docs, labels).count() == len(TEXTS)
    assert quality_classifier.quality_classifier(docs.select("doc_id", "text"), labels).count() == len(TEXTS)
    assert {r["score"] for r in quality_classifier.quality_classifier(docs, labels.limit(0)).collect()} == {0.5}


def test_co_training_does_not_depend_on_how_the_pool_is_cut():
    rng = np.random.default_rng(1)
    truth = rng.random(1200) < 0.4
    views = [np.column_stack([truth + rng.normal(0, s, 1200), rng.normal(size=1200)]) for s in (0.3, 0.6)]
    pool = [v[200:] for v in views]

    def summed(parts):
        def apply(f):
            return [np.sum(x, axis=0) for x in zip(*(f([v[p::parts] for v in pool]) for p in range(parts)), strict=True)]

        return apply

    whole, cut = (quality_classifier.co_train([v[:200] for v in views], truth[:200].astype(float), summed(n)) for n in (1, 7))
    for a, b in zip(whole["weights"] + whole["scale"], cut["weights"] + cut["scale"], strict=True):
        assert a == pytest.approx(b, abs=1e-6)
    z = pool[0] @ np.array(whole["weights"][0][:-1]) + whole["weights"][0][-1]
    assert ((z > 0) == truth[200:]).mean() > 0.9
    by, mark = quality_classifier.assigned(pool, [{"weights": [np.array(w) for w in whole["weights"]], "limits": [(-2.0, 2.0)] * 2}])
    for i in range(0, 1000, 50):  # view 0 first, then view 1, by its own log-odds
        own = [pool[v][i] @ np.array(whole["weights"][v][:-1]) + whole["weights"][v][-1] for v in (0, 1)]
        view = next((v for v in (0, 1) if abs(own[v]) >= 2), -1)
        assert by[i] == view and (view < 0 or mark[i] == (own[view] > 0))


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """A folder with the tables that the pipeline reads."""
    d, labels = labelled(spark)
    path = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in [*TEXTS, *near_texts(), (2, "alpha"), (3, "alpha"), (3, "unique text here")]]
    docs = d.withColumn("doc_id", F.col("doc_id") + 1000).unionByName(spark.createDataFrame(rows, d.schema))
    docs.write.parquet(f"{path}/documents.parquet")
    labels.withColumn("doc_id", F.col("doc_id") + 1000).write.parquet(f"{path}/labels.parquet")
    return path


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_empty_and_clashing_tables(spark, docs, none, sf, name):
    got = stage(name)(spark, docs, sf)
    assert stage(name)(spark, none, sf).count() == 0 and stage(name)(spark, docs.drop("n_chars"), sf).count() == got.count() > 0
    assert name == "best-fit packing" or got.columns == docs.columns


def test_toxicity_stage(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = rows_of(stage("toxicity")(spark, docs, sf).select("doc_id", "text"))
    score = toxicity.toxicity(docs, labels)
    bad = {r["doc_id"] for r in score.where("predicted = 1").collect()}
    assert got == collections.Counter({k: n for k, n in rows_of(docs.select("doc_id", "text")).items() if k[0] not in bad})
    truth = {r["doc_id"] for r in labels.where("toxic = 1").collect()}
    assert len(bad & truth) >= 0.9 * len(truth) and len(bad - truth) <= 0.02 * docs.count()


def test_dedup_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    groups = collections.defaultdict(list)
    for i, t in texts:
        groups[bare(t)].append((-len(t or ""), i is None, i or 0, t))
    want = collections.Counter((None if none else i, t) for none, i, t in (min(g, key=lambda r: r[:3])[1:] for g in groups.values()))
    exact = stage("exact dedup")(spark, docs, sf)
    got = rows_of(exact.select("doc_id", "text"))
    assert {bare(t) for _, t in got} == set(groups) and sum(got.values()) == len(groups) and {(i, bare(t)) for i, t in got} == {(i, bare(t)) for i, t in want}
    small = exact.where("text IS NULL OR length(text) < 50000")
    rows = [tuple(r) for r in small.select("doc_id", "text").collect()]
    _, low = merged([(i, fingerprint(t)) for i, t in rows])
    near = stage("SimHash near-dedup")(spark, small, sf)
    assert rows_of(near.select("doc_id")) == collections.Counter((i,) for i in low.values())
    kept = [tuple(r) for r in near.select("doc_id", "text").collect()]
    words = {(i, n, removed, kept_sha) for i, n, removed, kept_sha in brute_words(kept)}
    left = {(r["doc_id"], len(r["text"] or ""), sha(" ".join(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")))) for r in stage("substring dedup")(spark, near, sf).collect()}
    assert {(i, s) for i, _, _, s in words} == {(i, s) for i, _, s in left}


def test_pipeline_packs_what_the_stages_leave(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, f in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(f(spark, docs, sf).collect(), docs.schema)
    want = collections.Counter(r["doc_id"] for r in docs.collect())
    got = corpus_pipeline.run(spark, sf).collect()
    assert collections.Counter(r["doc_id"] for r in got if r["piece"] == 0) == want
    assert sum(r["length"] for r in got) == sum(n for n in (r["length"] for r in stage("best-fit packing")(spark, docs, sf).collect()))


def test_anchors_that_occur_once_do_not_fill_the_filter(spark, monkeypatch):
    monkeypatch.setattr(anchors, "FILTER_BITS", 1 << 18)  # about one bit for each anchor here
    pick = random.Random(5)
    texts = ["".join(pick.choices("abcdefgh ", k=400_000)) for _ in range(8)]
    texts.append(texts[0][:20_000])
    rows = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "place long, key long, text string")
    known = anchors.repeated_anchors(rows, lambda batch: batch, anchors.byte_symbols, 50, 20, 1, None, 1 << 19)
    found = np.concatenate([anchors.find_units(anchors.byte_symbols([t.encode()]), 50, 20).anchor for t in texts])
    _, back, n = np.unique(found, return_inverse=True, return_counts=True)
    again = n[back] > 1
    assert len(found) > 180_000 and again.sum() > 2000
    assert known.repeated(found[again]).all() and known.repeated(found[~again]).mean() < 0.05 and not known.any_hot()


def test_pieces_merged_together_as_one_by_one():
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        m = Transducer(f.read())
    pick = random.Random(9)
    pieces = [bytes(pick.choices(b"aeot hinrs\xc3\xa9\xff", k=pick.randint(1, 48))) for _ in range(3000)] + [b"a" * 48, b"\xff"]
    assert m.short_pieces(pieces) == [m._short(p) for p in pieces] and m.short_pieces([]) == []
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", " ", "a", " Antidisestablishment's\tword, word\n\n x y \x1c z<|endoftext|>é漢字 12ab", "tail " * 20_000, "q" * 5000, "two  blanks ½ ＡＢ"]
    for _ in range(2):  # the second time from the memo
        for text, ready in zip(texts, m.learn(texts), strict=True):
            got = list(m.encode_blocks(text, ready))
            assert ",".join(x[0] for x in got) == ",".join(map(str, library.encode(text, add_special_tokens=False).ids))


def test_encoded_texts_as_the_library_does():
    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, "rb") as f:
        encoder = packing.WordEncoder(f.read())
    library = Tokenizer.from_file(path)
    texts = ["", " ", " a b ", "\x0ba\x0c\x1cb\x85\xa0 É", "x\ty\r\nz ", "Straße, ok! Ok OK,", " q", "word " * 3000, "é漢字 12ab it's"]
    want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    column = pa.array([*texts, None])
    assert packing.encoded_texts(encoder, column) == [*want, b""] == packing.encoded_texts(encoder, column)  # again from the memo
    assert packing.encoded_texts(encoder, column[2:5]) == want[2:5] and packing.encoded_texts(encoder, column[:0]) == []
