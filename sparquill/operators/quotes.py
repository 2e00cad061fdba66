"""Where texts contain whole quotes: exactly, in a claimed text first, or nearly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sparquill.operators.staging import importable, salted_join, staged

#: Characters of all quotes together up to which they are sent along with the tasks (some 20 bytes each in the automaton).
MOST_CHARACTERS = 4 << 20


def containing(bodies: DataFrame, quotes: DataFrame, head: int = 16, most: int | None = None) -> DataFrame:
    """item_id, doc_id, place (from 1): the first place in each body (doc_id, body) of each quote (item_id, quote) that
    it contains. Empty quotes are in no body; quotes and bodies of any length are compared whole.

    Quotes of up to `most` characters together (measured first) go along with the tasks, which run each body once
    through an automaton of the quotes; only hits leave a task, no body does. Beyond that, quotes meet the bodies'
    grams by the hash of their first `head` characters, in a join that salts hot heads; places come back to the bodies
    by id, and only there the whole quote is compared. Nothing is compared pair by pair either way.
    """
    spark = bodies.sparkSession
    importable(spark)
    q = quotes.where("quote <> ''").select("item_id", "quote")
    size = q.agg(F.coalesce(F.sum(F.length("quote") + 1), F.lit(0)).alias("n")).first()["n"]
    schema = bodies.select("doc_id").schema
    item = q.schema["item_id"].dataType.simpleString()
    if size <= (MOST_CHARACTERS if most is None else most):
        rows = sorted((r["item_id"], r["quote"]) for r in q.collect())

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            found = ahocorasick.Automaton()
            items: dict[str, list] = {}
            for i, t in rows:
                items.setdefault(t, []).append(i)
            for t in items:
                found.add_word(t, t)
            if items:
                found.make_automaton()
            for b in batches:
                out: list[tuple] = []
                for d, body in zip(b.column("doc_id").to_pylist(), b.column("body"), strict=True):
                    first: dict[str, int] = {}
                    for end, t in found.iter(body.as_py() or "") if items else ():
                        first.setdefault(t, end - len(t) + 2)
                    out += [(i, d, place) for t, place in first.items() for i in items[t]]
                if out:
                    columns = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0], types[0]), pa.array(columns[1], b.column("doc_id").type), pa.array(columns[2], pa.int64())], ["item_id", "doc_id", "place"])

        types = [pa.int64() if item == "bigint" else pa.int32() if item == "int" else pa.string()]
        return bodies.select("doc_id", "body").mapInArrow(scan, f"item_id {item}, doc_id {schema[0].dataType.simpleString()}, place long")
    heads = q.withColumn("head", F.xxhash64(F.substring("quote", 1, head))).withColumn("n", F.length(F.substring("quote", 1, head)))
    sizes = sorted(r["n"] for r in q.select(F.least(F.length("quote"), F.lit(head)).alias("n")).distinct().collect())

    def cut(n: int) -> Column:
        gram = lambda i: F.struct(F.xxhash64(F.substr("body", i, F.lit(n))).alias("head"), F.lit(n).alias("n"))
        return F.when(F.length("body") >= n, F.transform(F.sequence(F.lit(1), F.length("body") - (n - 1)), gram)).otherwise(F.array().cast("array<struct<head:bigint,n:int>>"))

    grams = F.array_distinct(F.flatten(F.array(*map(cut, sizes))))
    at = bodies.select("doc_id", F.explode(grams).alias("g")).select("doc_id", "g.head", "g.n")
    known = staged(heads.groupBy("head", "n").agg(F.collect_list(F.struct("item_id", "quote")).alias("quotes")), "quote-heads")
    hot = known.select("head", "n").join(at.groupBy("head", "n").agg(F.count(F.lit(1)).alias("size")), ["head", "n"])
    some = salted_join(at, hot.join(known, ["head", "n"]), ["head", "n"], "size", F.col("doc_id")).select("doc_id", F.explode("quotes").alias("q"))
    hits = some.select("doc_id", "q.item_id", "q.quote").join(bodies.select("doc_id", "body"), "doc_id")
    return hits.where(F.contains("body", "quote")).select("item_id", "doc_id", F.expr("instr(body, quote)").cast("long").alias("place")).distinct()


def located(hits: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """Of the hits of containing(), one for each quote: in the text that it claims (item_id, claimed) if it is there, else
    in that of the least id. item_id, doc_id, place and, with claims, as_claimed."""
    if claims is None:
        return hits.groupBy("item_id").agg(F.min(F.struct("doc_id", "place")).alias("m")).select("item_id", "m.doc_id", "m.place")
    other = F.coalesce(F.col("doc_id") != F.col("claimed"), F.lit(True))
    best = hits.join(claims, "item_id", "left").groupBy("item_id").agg(F.min(F.struct(other.alias("other"), "doc_id", "place")).alias("m"))
    return best.select("item_id", "m.doc_id", "m.place", (~F.col("m.other")).alias("as_claimed"))


def _gram_scan(quotes: list[tuple], gram: int, kind: pa.DataType):
    """A function over Arrow batches (doc_id, body): of each task and quote the body with most of its distinct grams."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sorted({i for i, _ in quotes}, key=lambda i: (i is None, i))
        place = {i: k for k, i in enumerate(items)}
        pairs = sorted({(t[k : k + gram], place[i]) for i, t in quotes for k in range(len(t) - gram + 1)})
        if not pairs:
            return
        words = sorted({g for g, _ in pairs})
        number = {g: k for k, g in enumerate(words)}
        own, item = (np.array(x, np.int64) for x in zip(*[(number[g], i) for g, i in pairs], strict=True))
        starts = np.searchsorted(own, np.arange(len(words) + 1))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, gram)
        base = 0x9E3779B97F4A7C15
        while True:  # a base for which no two grams of the quotes have one hash
            powers = [np.uint64(pow(base, k + 1, 1 << 64)) for k in range(gram)]
            hashes = sum((points[:, k].astype(np.uint64) * powers[k] for k in range(1, gram)), points[:, 0].astype(np.uint64) * powers[0])
            if len(np.unique(hashes)) == len(hashes):
                break
            base += 2
        order = np.argsort(hashes)
        ranked = hashes[order]
        bits = np.uint64(64 - max(16, (16 * len(words)).bit_length()))
        there = np.zeros(1 << int(64 - bits), bool)
        there[(hashes >> bits).astype(np.int64)] = True
        most, best = np.zeros(len(items), np.int64), [None] * len(items)

        def part(ids: list, bodies: list[str]) -> None:
            turn = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k]))
            ids, bodies = [ids[k] for k in turn], [bodies[k] for k in turn]
            text = np.frombuffer("\0".join([*bodies, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
            ends = np.cumsum([len(b) + 1 for b in bodies])
            n = len(text) - gram + 1
            if n <= 0:
                return
            wide = text.astype(np.uint64)
            h = wide[:n] * powers[0]
            for k in range(1, gram):
                h += wide[k : n + k] * powers[k]
            at = np.flatnonzero(there[(h >> bits).astype(np.int64)])
            found = np.minimum(np.searchsorted(ranked, h[at]), len(ranked) - 1)
            same = ranked[found] == h[at]
            at, word = at[same], order[found[same]]
            doc = np.searchsorted(ends, at, "right")
            same = (np.lib.stride_tricks.sliding_window_view(text, gram)[at] == points[word]).all(1) & (at + gram < ends[doc])
            key = np.unique(doc[same] * len(words) + word[same])
            doc, word = key // len(words), key % len(words)
            many = starts[word + 1] - starts[word]
            hit = np.repeat(starts[word] - np.cumsum(many) + many, many) + np.arange(many.sum())
            counts = np.bincount(np.repeat(doc, many) * len(items) + item[hit], minlength=len(ids) * len(items)).reshape(len(ids), -1)
            first = counts.argmax(0)  # of equal ones the least id
            for i in np.flatnonzero(counts.max(0) > 0).tolist():
                k, d = int(counts[first[i], i]), ids[first[i]]
                if k > most[i] or k == most[i] and (d is not None and (best[i] is None or d < best[i])):
                    most[i], best[i] = k, d

        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b.column("body")), 0).to_pylist()
            begin = held = 0
            for k, n in enumerate([*sizes, 1 << 40]):
                if k > begin and (held + n > 1 << 20 or (k - begin) * len(items) >= 1 << 21):
                    cut = b.slice(begin, k - begin)
                    part(cut.column("doc_id").to_pylist(), [x or "" for x in cut.column("body").to_pylist()])
                    begin, held = k, 0
                held += n
        some = np.flatnonzero(most).tolist()
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([items[i] for i in some], kind), pa.array([best[i] for i in some], b.column("doc_id").type), pa.array(most[some])], ["item_id", "doc_id", "k"])

    return scan


def nearly(bodies: DataFrame, quotes: DataFrame, gram: int = 8, share: float = 0.5, most: int = 1 << 20) -> DataFrame:
    """item_id, doc_id, share: for each quote the body that has the largest share of its distinct grams, if that is at
    least `share` (of equal ones the least id); rows of one doc_id count as one body.

    Quotes of up to `most` characters together go along with the tasks, which hash all grams of their bodies in numpy, compare
    whole grams where a hash is a quote's, and give one row a quote; no gram is shuffled. Beyond that, and for doc_ids of
    several rows, bodies' grams are kept where a quote has them, by a join on a gram table as small as the quotes."""
    spark = bodies.sparkSession
    importable(spark)
    cut = lambda c: F.when(F.length(c) >= gram, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (gram - 1)), lambda i: F.substr(c, i, F.lit(gram))))).otherwise(F.array().cast("array<string>"))
    q = staged(quotes.select("item_id", F.explode(cut(F.col("quote"))).alias("g")).distinct(), "quote-grams")
    sizes = q.groupBy("item_id").agg(F.count(F.lit(1)).alias("size"))

    def joined(some: DataFrame) -> DataFrame:
        there = some.select("doc_id", F.explode(cut(F.col("body"))).alias("g")).join(q.select("g").distinct(), "g", "left_semi").distinct()
        counts = there.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
        both = salted_join(there, q.groupBy("g").agg(F.collect_list("item_id").alias("items")).join(counts, "g"), ["g"], "n", F.col("doc_id"))
        return both.select("doc_id", F.explode("items").alias("item_id")).groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("k"))

    length = quotes.agg(F.coalesce(F.sum(F.length("quote")), F.lit(0)).alias("n")).first()["n"]
    if length > most:
        hits = joined(bodies)
    else:
        rows = [(r["item_id"], r["quote"]) for r in quotes.where("quote IS NOT NULL").select("item_id", "quote").collect()]
        kinds = [quotes.schema["item_id"].dataType, bodies.schema["doc_id"].dataType]
        scan = _gram_scan(rows, gram, to_arrow_type(kinds[0]))
        schema = f"item_id {kinds[0].simpleString()}, doc_id {kinds[1].simpleString()}, k long"
        twice = bodies.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("_twice"))
        if twice.limit(1).count():
            twice = staged(twice, "ids-of-several-rows")
            same = F.col("doc_id").eqNullSafe(F.col("_twice"))
            hits = bodies.join(twice, same, "left_anti").select("doc_id", "body").mapInArrow(scan, schema).unionByName(joined(bodies.join(twice, same, "left_semi")))
        else:
            hits = bodies.select("doc_id", "body").mapInArrow(scan, schema)
    best = hits.groupBy("item_id").agg(F.min(F.struct((-F.col("k")).alias("o"), F.col("doc_id").isNull().alias("late"), "doc_id")).alias("m")).join(sizes, "item_id")
    return best.select("item_id", "m.doc_id", (-F.col("m.o") / F.col("size")).alias("share")).where(F.col("share") >= share)
