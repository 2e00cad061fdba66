"""Column functions that measure texts, answers and histories."""

from __future__ import annotations

import math
from collections.abc import Iterable
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparquill.functions.text import HAN, _c, chars, compact, let


def grams(x: Column | str, n: int) -> Column:
    """Character n-grams, from the array of characters (a substring for each place would be quadratic)."""
    places = lambda c: F.when(F.size(c) >= n, F.transform(F.sequence(F.lit(1), F.size(c) - n + 1), lambda i: F.array_join(F.slice(c, i, n), ""))).otherwise(F.array().cast("array<string>"))
    return let(chars(x), places)


@F.pandas_udf(T.DoubleType())
def _repetition(texts: pd.Series, sizes: pd.Series) -> pd.Series:
    out = []
    for t, n in zip(texts, sizes, strict=True):
        if t is None or len(t) < n:
            out.append(0.0)
            continue
        points = np.frombuffer(t.encode("utf-32-le"), dtype="<u4")
        windows = np.lib.stride_tricks.sliding_window_view(points, n).astype("<u4")
        out.append(1.0 - len(np.unique(np.ascontiguousarray(windows).view(f"V{4 * n}"))) / len(windows))
    return pd.Series(out)


def gram_repetition(x: Column | str, n: int = 4) -> Column:
    """1 - distinct / all character n-grams; 0 for shorter texts. Arrow batches: exact over texts of any length."""
    return _repetition(_c(x), F.lit(n))


def longest_run(x: Column | str) -> Column:
    """The longest run of one character."""
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(s: Column, c: Column) -> Column:
        now = F.when(c == s["last"], s["now"] + 1).otherwise(F.lit(1))
        return F.struct(c.alias("last"), now.alias("now"), F.greatest(s["best"], now).alias("best"))

    return F.aggregate(chars(x), start, step, lambda s: s["best"])


def adjacent_repetition(x: Column | str) -> Column:
    """The share of characters that equal the one before."""
    c = chars(x)
    same = F.size(F.filter(F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: a == b), lambda e: e))
    return F.when(F.size(c) >= 2, same / (F.size(c) - 1)).otherwise(F.lit(0.0))


def han_ratio(x: Column | str) -> Column:
    return F.when(F.length(_c(x)) > 0, F.regexp_count(_c(x), F.lit(HAN)) / F.length(_c(x))).otherwise(F.lit(0.0))


def unique_ratio(x: Column | str) -> Column:
    return F.when(F.length(_c(x)) > 0, F.size(F.array_distinct(chars(x))) / F.length(_c(x))).otherwise(F.lit(0.0))


def severe_loop(x: Column | str) -> Column:
    """Six of one character, or a phrase of 2 to 12 characters three times in a row, white space apart."""
    return compact(x).rlike(r"(.)\1{5,}|(.{2,12})\2{2,}")


def bits_per_character(loss: Column, tokens: Column, characters: Column) -> Column:
    return F.when(characters > 0, loss * tokens / characters / F.lit(math.log(2)))


def degradation(before: Column, after: Column, limit: float) -> tuple[Column, Column, Column]:
    """Absolute and relative change, and whether the relative change stays within the limit."""
    relative = F.try_divide(after - before, before)
    return after - before, relative, relative <= limit


def warmup_cosine(step: Column, warmup: int, total: int, peak: float, least: float) -> Column:
    """A rate that rises linearly for `warmup` steps and then falls as half a cosine."""
    done = F.least(F.greatest((step - warmup) / F.lit(max(1, total - warmup)), F.lit(0.0)), F.lit(1.0))
    return F.when(step < warmup, F.lit(peak) * (step + 1) / F.lit(warmup)).otherwise(F.lit(least) + F.lit(peak - least) * 0.5 * (1 + F.cos(done * math.pi)))


class SubstringAutomaton:
    """The suffix automaton of some texts: its size is linear in them, and texts of any length run through it with one
    step a character. Of all texts that ran through, it keeps for each state the longest match."""

    def __init__(self, texts: Iterable[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.len = [-1], [0]
        for t in texts:
            last = 0
            for c in t:
                last = self._extend(last, c)
        self.best = [0] * len(self.len)

    def _extend(self, last: int, c: str) -> int:
        nxt, link, length = self.next, self.link, self.len

        def split(p: int, q: int) -> int:
            new = len(length)
            nxt.append(nxt[q].copy())
            link.append(link[q])
            length.append(length[p] + 1)
            link[q] = new
            while p >= 0 and nxt[p].get(c) == q:
                nxt[p][c] = new
                p = link[p]
            return new

        q = nxt[last].get(c)
        if q is not None:  # another text has come this way
            return q if length[q] == length[last] + 1 else split(last, q)
        now, p = len(length), last
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = now
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[now] = q if length[q] == length[p] + 1 else split(p, q)
        return now

    def run(self, text: str) -> None:
        nxt, link, length, best = self.next, self.link, self.len, self.best
        s = n = 0
        for c in text:
            t = nxt[s].get(c)
            if t is None:
                s = link[s]
                while s >= 0 and c not in nxt[s]:
                    s = link[s]
                if s < 0:
                    s = n = 0
                    continue
                n = length[s]
                t = nxt[s][c]
            s = t
            n += 1
            if n > best[s]:
                best[s] = n

    def longest(self, texts: Iterable[str]) -> list[int]:
        """For each of the automaton's texts, the length of its longest part in the texts that ran through."""
        own, link, length = self.best.copy(), self.link, self.len
        by_length = sorted(range(1, len(length)), key=length.__getitem__)
        for s in reversed(by_length):  # what ended in a state has matched all shorter ends of it
            if own[s]:
                own[link[s]] = max(own[link[s]], length[link[s]])
        for s in by_length:
            own[s] = max(own[s], own[link[s]])
        out = []
        for t in texts:
            s = most = 0
            for c in t:
                s = self.next[s][c]
                most = max(most, own[s])
            out.append(most)
        return out


@F.pandas_udf(T.IntegerType())
def longest_common_substring(a: pd.Series, b: pd.Series) -> pd.Series:
    """The length of the longest common substring, one numpy row of the table at a time."""

    def one(x: str | None, y: str | None) -> int:
        if not x or not y:
            return 0
        s, t = sorted((np.frombuffer(v.encode("utf-32-le"), dtype="<u4") for v in (x, y)), key=len)
        row, best = np.zeros(len(t) + 1, np.int32), 0
        for c in s:
            row[1:] = np.where(t == c, row[:-1] + 1, 0)
            best = max(best, int(row.max()))
        return best

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


@F.pandas_udf(T.DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matching characters over all, matched by longest blocks."""
    return pd.Series([SequenceMatcher(None, x or "", y or "", autojunk=False).ratio() for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.StructType().add("matched", T.LongType()).add("coverage", T.DoubleType()).add("ratio", T.DoubleType()))
def line_blocks(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Characters in matching blocks of lines, their share of the shorter text, and the ratio of matching lines. A line is
    given by a digest of 32 characters and its length."""
    size = lambda line: int(line[32:])
    rows = []
    for x, y in zip(a, b, strict=True):
        x, y = list(x), list(y)
        m = SequenceMatcher(None, x, y, autojunk=False)
        matched = sum(size(line) for k in m.get_matching_blocks() for line in x[k.a : k.a + k.size])
        rows.append((matched, matched / max(1, min(sum(map(size, x)), sum(map(size, y)))), m.ratio()))
    return pd.DataFrame(rows, columns=["matched", "coverage", "ratio"])


def multiset_f1(a: Column, b: Column) -> Column:
    """F1 of two character multisets."""
    least = lambda x, y: F.aggregate(F.transform(F.array_intersect(x, y), lambda c: F.least(F.size(F.filter(x, lambda v: v == c)), F.size(F.filter(y, lambda v: v == c)))), F.lit(0), lambda s, v: s + v)
    both = let(chars(a), lambda x: let(chars(b), lambda y: least(x, y)))
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2 * both / total)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def probability(x: Column) -> Column:
    return finite(x) & x.between(0.0, 1.0)


def term_score(answer: Column, required: Column, forbidden: Column) -> Column:
    """All required terms and no forbidden one."""
    return F.forall(required, lambda t: answer.contains(t)) & ~F.exists(forbidden, lambda t: answer.contains(t))


def alternatives_hit(answer: Column, groups: Column) -> Column:
    """How many groups of alternatives have a term in the answer."""
    return F.size(F.filter(groups, lambda g: F.exists(g, lambda t: answer.contains(t))))
