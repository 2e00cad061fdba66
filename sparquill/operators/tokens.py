"""Character vocabularies, byte-pair encoding learnt from characters, chat serialization and token windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparquill.functions.text import chars, let
from sparquill.operators.staging import batches_of, importable, staged

IGNORED = -100
#: Characters of a block of lines from which pairs are counted.
BLOCK = 1 << 20


def vocabulary(texts: DataFrame, column: str = "text") -> DataFrame:
    """token, token_id: the distinct characters in code-point order. The set is bounded by Unicode, not by the corpus."""
    distinct = texts.select(F.explode(F.array_distinct(chars(column))).alias("token")).distinct()
    return distinct.select("token", (F.row_number().over(W.orderBy("token")) - 1).alias("token_id"))


def encoded(df: DataFrame, column: str, vocab: DataFrame) -> DataFrame:
    """Adds ids, the character ids of column; null for a character that the vocabulary lacks. The vocabulary goes
    along as one broadcast row of code point -> id."""
    table = vocab.agg(F.map_from_entries(F.collect_list(F.struct("token", "token_id"))).alias("_vocab"))
    return df.crossJoin(F.broadcast(table)).withColumn("ids", F.transform(chars(column), lambda c: F.try_element_at("_vocab", c))).drop("_vocab")


def decoded(ids: Column, vocab: dict[int, str]) -> Column:
    """Text of an array of ids."""
    table = F.create_map(*[F.lit(v) for pair in vocab.items() for v in pair])
    return F.array_join(F.transform(ids, lambda i: F.try_element_at(table, i)), "")


def merged(ids: np.ndarray, todo: list[tuple[int, int, int]]) -> np.ndarray:
    """ids with the merges (left, right, new) made one after the other, each at all its places, leftmost first."""
    for a, b, new in todo:
        at = np.flatnonzero((ids[:-1] == a) & (ids[1:] == b))
        if a == b and len(at):  # of a run's places, every other one from its start
            start = np.r_[True, np.diff(at) != 1]
            at = at[(np.arange(len(at)) - np.flatnonzero(start)[np.cumsum(start) - 1]) % 2 == 0]
        if len(at):
            ids = ids.copy()
            ids[at] = new
            ids = np.delete(ids, at + 1)
    return ids


def pair_counts(ids: np.ndarray, weight: np.ndarray, most: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """The adjacent pairs of ids (left << 24 | right) and the sums of their weights, those of weight 0 left out. Where few
    kinds of ids make few possible pairs, these are counted without sorting."""
    there = np.zeros(int(ids.max(initial=0)) + 1, bool)
    there[ids] = True
    kinds = np.flatnonzero(there)
    if len(kinds) ** 2 <= most:
        number = np.zeros(len(there), np.int32)
        number[kinds] = np.arange(len(kinds))
        own = number[ids]
        sums = np.bincount(own[:-1] * len(kinds) + own[1:], weights=weight, minlength=1)
        at = np.flatnonzero(sums)
        return kinds[at // len(kinds)] << 24 | kinds[at % len(kinds)], np.rint(sums[at]).astype(np.int64)
    keys, place = np.unique(ids[:-1].astype(np.int64) << 24 | ids[1:], return_inverse=True)
    sums = np.bincount(place, weights=weight, minlength=len(keys))
    return keys[sums > 0], np.rint(sums[sums > 0]).astype(np.int64)


def learnt_merges(texts: DataFrame, merges: int, column: str = "text", least: int = 2, top: int = 512, restage: int = 10) -> list[tuple[str, str]]:
    """Byte-pair merges over all lines of all texts: the most frequent adjacent pair first, on ties the smaller left id,
    then the smaller right id (characters in code-point order, then tokens as they were made). Only a newline is a
    barrier. Distinct lines with their counts stay in the cluster, as blocks of code points (tokens made have ids above
    them); only the `top` most frequent pairs of each round come to the driver.

    A round takes as many merges as are sure to be next one by one: down the order by count, while no pair shares a
    character or token with the side of an earlier one where it could touch it, and while no count is tied. A merge's
    new pairs are at most as frequent as pairs that are still further down then.

    A block has some BLOCK characters (or one longer line), and few blocks go to Python at once, so a task's memory is
    the same for any size of the input.
    """
    spark = texts.sparkSession
    importable(spark)
    pieces = texts.select(F.explode(F.split(F.col(column), "\n")).alias("p")).where("p <> ''").groupBy("p").agg(F.count(F.lit(1)).alias("n"))

    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[str, int]] = []
        size = 0

        def out() -> pd.DataFrame:
            ids = np.frombuffer(("\n".join([p for p, _ in held]) + "\n").encode("utf-32-le", "surrogatepass"), "<i4")
            return pd.DataFrame({"ids": [ids.tobytes()], "n": [np.array([n for _, n in held], np.int64).tobytes()]})

        for b in batches:
            for p, n in zip(b["p"], b["n"].tolist(), strict=True):
                if held and size + len(p) >= BLOCK:
                    yield out()
                    held, size = [], 0
                held.append((p, n))
                size += len(p) + 1
        if held:
            yield out()

    def run(todo: list[tuple[int, int, int]], count: bool):
        def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: list[tuple[np.ndarray, np.ndarray]] = []

            def out() -> tuple[np.ndarray, np.ndarray]:
                keys, place = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
                sums = np.zeros(len(keys), np.int64)
                np.add.at(sums, place, np.concatenate([n for _, n in held]))
                return keys, sums

            for rows in batches:
                for raw, n in zip(rows["ids"], rows["n"], strict=True):
                    ids = merged(np.frombuffer(raw, "<i4"), todo)
                    if not count:
                        yield pd.DataFrame({"ids": [ids.tobytes()], "n": [n]})
                        continue
                    ends = ids == 10
                    weight = np.frombuffer(n, np.int64)[np.minimum(np.cumsum(ends) - ends, len(n) // 8 - 1)]
                    inner = ~(ends[:-1] | ends[1:])
                    held.append(pair_counts(ids, np.where(inner, weight[:-1], 0)))
                    if sum(len(k) for k, _ in held) >= BLOCK:  # a task's blocks are summed before they leave
                        held = [out()]
                        if len(held[0][0]) >= BLOCK // 2:
                            yield pd.DataFrame({"pair": held[0][0], "n": held[0][1]})
                            held = []
            if held:
                keys, sums = out()
                yield pd.DataFrame({"pair": keys, "n": sums})

        return step

    with batches_of(spark, 256):
        table = staged(pieces.mapInPandas(block, "ids binary, n binary"), "bpe-pieces")
    names: dict[int, str] = {}
    name = lambda i: names[i] if i > 0x10FFFF else chr(i)
    out: list[tuple[str, str]] = []
    made: set[str] = set()
    blocked: list[int] = []
    todo: list[tuple[int, int, int]] = []
    rounds = 0
    while len(out) < merges:
        with batches_of(spark, 4):
            counts = table.mapInPandas(run(todo, True), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
            rows = counts.orderBy(F.desc("n")).limit(top + len(blocked)).collect()
            if len(rows) == top + len(blocked):  # all of the last count, or none of them
                last = rows[-1]["n"]
                rows = [r for r in rows if r["n"] > last] or counts.where(F.col("n") == last).collect()
        pairs = sorted((-r["n"], r["pair"]) for r in rows)  # of equal counts the smaller left, then right id
        lefts: set[int] = set()
        rights: set[int] = set()
        before = len(out)
        for k, (n, pair) in enumerate(pairs):
            a, b = pair >> 24, pair & 0xFFFFFF
            x, y = name(a), name(b)
            if len(out) > before and (a in rights or b in lefts or len(out) == merges):
                break
            touches = a in {p & 0xFFFFFF for *_, p in pairs[:k]} or b in {p >> 24 for *_, p in pairs[:k]}
            tied = k + 1 == len(pairs) or pairs[k + 1][0] == n
            if x + y in made:  # a token that is there already is not made again
                if pair not in blocked:
                    blocked.append(pair)
                continue
            if len(out) > before and tied:
                break
            new = 0x110000 + len(names)
            names[new] = x + y
            made.add(x + y)
            out.append((x, y))
            todo.append((a, b, new))
            lefts.add(a)
            rights.add(b)
            if a == b or touches or tied:
                break
        if len(out) == before:
            if len(rows) < top:
                break
            top *= 2  # only pairs that are not made again
        rounds += 1
        if rounds % restage == 0:
            with batches_of(spark, 4):
                table, todo = staged(table.mapInPandas(run(todo, False), "ids binary, n binary"), "bpe-pieces"), []
    return out


def bpe_encoded(df: DataFrame, column: str, merges: list[tuple[str, str]], most: int = 1 << 20) -> DataFrame:
    """Adds tokens, the byte-pair tokens of column: lowest rank first, leftmost on ties. Nothing is dropped, so the
    tokens joined are the text; a newline is a token of its own.

    A pair that holds a token has a higher rank than the merge that made it, so making all merges in the order of
    their ranks is the same as always taking the lowest; some `most` bytes are worked on at once.
    """
    importable(df.sparkSession)
    number, todo = {}, []
    for a, b in merges:
        left, right = (number.get(x, ord(x) if len(x) == 1 else -1) for x in (a, b))
        number[a + b] = 0x110000 + len(todo)
        todo.append((left, right, number[a + b]))
    made = [a + b for a, b in merges]
    schema = df.schema

    def encode(texts: list[str]) -> list[list[str]]:
        ids = merged(np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<i4"), todo) if "\0" not in "".join(texts) else None
        if ids is None:  # a text with the separator itself goes alone, between its own
            return [[x for i, part in enumerate(t.split("\0")) for x in ([] if not i else ["\0"]) + encode([part])[0]] if "\0" in t else encode([t])[0] for t in texts]
        kinds, place = np.unique(ids, return_inverse=True)
        names = np.array([made[i - 0x110000] if i > 0x10FFFF else chr(i) for i in kinds.tolist()], dtype=object)
        tokens, ends = names[place], np.flatnonzero(ids == 0)
        return [tokens[s:e].tolist() for s, e in zip([0, *(ends[:-1] + 1).tolist()], ends.tolist(), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()  # only a part's texts become Python objects
            at = 0
            while at < len(sizes):
                size, end = 0, at
                while end < len(sizes) and (end == at or size + sizes[end] <= most):
                    size += sizes[end]
                    end += 1
                part = batch.slice(at, end - at)
                texts = [t or "" for t in part.column(column).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(encode(texts), pa.list_(pa.string()))], [*part.schema.names, "tokens"])
                at = end

    return df.mapInArrow(run, T.StructType([*schema.fields, T.StructField("tokens", T.ArrayType(T.StringType()))]))


def conversations(turns: DataFrame) -> DataFrame:
    """One row a conversation: messages as an array of (turn, role, text) in order, without system turns."""
    kept = turns.where("role <> 'system'")
    return kept.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))


def role_contract(messages: Column) -> Column:
    """User and assistant alternate, the user begins, the assistant ends, no text is blank."""
    alternates = F.forall(F.transform(messages, lambda m, i: (m["role"] == F.when(i % 2 == 0, "user").otherwise("assistant")) & (F.trim(m["text"]) != "")), lambda ok: ok)
    return (F.size(messages) > 0) & (F.size(messages) % 2 == 0) & alternates


def serialized(messages: Column, special: dict[str, int], encode) -> tuple[Column, Column]:
    """input_ids and labels of a chat: BOS, then each turn's role mark and ids, an EOS after each assistant turn; the
    next-token labels cover the assistant's ids and its EOS, all else is ignored."""
    one = lambda t: F.array(F.lit(special[t]))
    ids = lambda m: F.when(m["role"] == "user", F.concat(one("user"), encode(m["text"]))).otherwise(F.concat(one("assistant"), encode(m["text"]), one("eos")))
    own = lambda m: F.when(m["role"] == "user", F.array_repeat(F.lit(0), F.size(encode(m["text"])) + 1)).otherwise(F.concat(F.array(F.lit(0)), F.array_repeat(F.lit(1), F.size(encode(m["text"])) + 1)))
    all_ids = F.concat(one("bos"), F.flatten(F.transform(messages, ids)))
    mask = F.concat(F.array(F.lit(0)), F.flatten(F.transform(messages, own)))
    n = F.size(all_ids) - 1
    labels = F.zip_with(F.slice(all_ids, F.lit(2), n), F.slice(mask, F.lit(2), n), lambda i, k: F.when(k == 1, i).otherwise(F.lit(IGNORED)))
    return F.slice(all_ids, F.lit(1), n), labels


def padded(ids: Column, length: Column, pad: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad), length - F.size(ids)))


def windows(ids: Column, width: int, step: int) -> Column:
    """Next-token windows (x, y) of an array of ids, every step places."""
    starts = lambda x: F.when(F.size(x) > width, F.sequence(F.lit(1), F.size(x) - width, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return let(ids, lambda x: F.transform(starts(x), lambda i: F.struct(F.slice(x, i, width).alias("x"), F.slice(x, i + 1, width).alias("y"))))
