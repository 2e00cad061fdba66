"""Column functions over text: normal forms, counts, hashes, tests. All run in the JVM unless they say otherwise."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the white space that Unicode-aware stripping removes, as a regular-expression class.
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Fixed value: line boundaries of splitlines.
BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
#: Fixed value: control characters other than tab and line feed.
CONTROLS = r"[\x00-\x08\x0b-\x1f\x7f-\x{9f}]"
#: Fixed value: the two common blocks of Han characters.
HAN = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]"
#: Brackets that must balance.
PAIRS = [("“", "”"), ("《", "》"), ("【", "】"), ("（", "）"), ("(", ")"), ("[", "]")]
DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"十": 10, "百": 100, "千": 1000, "万": 10000}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a lambda would compute a captured expression anew for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), f"^{WS}+|{WS}+$", "")


def collapse(x: Column | str) -> Column:
    """White-space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(_c(x), f"{WS}+", " "))


def compact(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), f"{WS}+", "")


def split_lines(x: Column | str) -> Column:
    """Lines as splitlines gives them: no empty line after a final break."""
    parts = F.split(_c(x), BREAKS)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def newlines(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), r"\r\n|\r", "\n")


def without_controls(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), CONTROLS, "")


def occurrences(x: Column | str, part: Column | str) -> Column:
    """Non-overlapping occurrences of a string (a plain str is the string itself)."""
    p = F.lit(part) if isinstance(part, str) else part
    return F.when(F.length(p) > 0, ((F.length(_c(x)) - F.length(F.replace(_c(x), p, F.lit("")))) / F.length(p)).cast("long")).otherwise(F.lit(0).cast("long"))


def alnum_lower(x: Column | str) -> Column:
    """Lower-cased letters and digits only."""
    return F.regexp_replace(F.lower(_c(x)), r"[^\p{L}\p{N}]+", "")


@F.pandas_udf(T.StringType())
def nfkc_casefold(x: pd.Series) -> pd.Series:
    """Compatibility normal form, case-folded; Arrow batches, as no built-in does it."""
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s).casefold(), na_action="ignore")


@F.pandas_udf(T.StringType())
def nfkc_lower(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s).lower(), na_action="ignore")


def canonical_text(x: Column | str) -> Column:
    """Letters and digits of the case-folded compatibility form."""
    return F.regexp_replace(nfkc_casefold(_c(x)), r"[^\p{L}\p{N}]+", "")


def overlap_text(x: Column | str) -> Column:
    return F.regexp_replace(nfkc_lower(_c(x)), r"[^\p{L}\p{N}]+", "")


def canonical_answer(x: Column | str) -> Column:
    """The case-folded compatibility form without white space and punctuation."""
    return F.regexp_replace(nfkc_casefold(_c(x)), rf"\p{{P}}|{WS}", "")


def without_prefixes(x: Column | str, prefixes: Sequence[str]) -> Column:
    """Drops leading prefixes, and white space after each, until none is left (no prefix may begin another)."""
    return F.regexp_replace(_c(x), f"^(?:(?:{'|'.join(map(re.escape, prefixes))}){WS}*)+", "")


def fingerprint(x: Column | str, chars: int = 12, digits: int = 16) -> Column:
    """A short digest of the first characters."""
    return F.substring(F.sha2(F.substring(_c(x), 1, chars), 256), 1, digits)


def stable_hash(*parts: Column | str) -> Column:
    """SHA-256 of the parts joined by bars; a null part counts as the text None."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(_c(p).cast("string"), F.lit("None")) for p in parts]), 256)


def bucket(digest: Column, buckets: int = 100) -> Column:
    """The first eight hex digits of a digest, modulo buckets."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % buckets


def first_sentence(x: Column | str) -> Column:
    return F.regexp_extract(_c(x), r"^[^.!?。！？]*[.!?。！？]?", 0)


def balanced(x: Column | str) -> Column:
    """Each kind of bracket opens as often as it closes."""
    return reduce(lambda a, b: a & b, [occurrences(x, a) == occurrences(x, b) for a, b in PAIRS])


def _closed(x: Column, a: str, b: str) -> Column:
    return let(x, lambda c: F.when(occurrences(c, a) == occurrences(c, b) + 1, F.concat(c, F.lit(b))).otherwise(c))


def truncated(x: Column | str, limit: int) -> Column:
    """At most limit characters, the last an ellipsis if any is cut; then closes a bracket that the cut left open."""
    cut = F.when(F.length(_c(x)) > limit, F.concat(F.substring(_c(x), 1, limit - 1), F.lit("…"))).otherwise(_c(x))
    for a, b in PAIRS:
        cut = _closed(cut, a, b)
    return cut


def chars(x: Column | str) -> Column:
    return F.filter(F.split(_c(x), ""), lambda c: c != "")


#: Characters whose full upper case is several characters, and the one character that is their simple one.
_LOW, _UP = "ßᾀᾁᾂᾃᾄᾅᾆᾇᾐᾑᾒᾓᾔᾕᾖᾗᾠᾡᾢᾣᾤᾥᾦᾧᾳῃῳ", "ẞᾈᾉᾊᾋᾌᾍᾎᾏᾘᾙᾚᾛᾜᾝᾞᾟᾨᾩᾪᾫᾬᾭᾮᾯᾼῌῼ"


def upper_char(x: Column | str) -> Column:
    """The simple upper case of one character, as SQL's upper gives it: always one character, itself if there is none."""
    return F.when(F.length(F.upper(_c(x))) > 1, F.translate(_c(x), _LOW, _UP)).otherwise(F.upper(_c(x)))


def chinese_number(x: Column | str) -> Column:
    """Units add up; a leading unit counts once; 万 multiplies what precedes. ASCII digits are read as they are."""
    digit = F.create_map(*[F.lit(v) for pair in DIGITS.items() for v in pair])
    unit = F.create_map(*[F.lit(v) for k, n in UNITS.items() if k != "万" for v in (k, n)])
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("now"))

    def step(s: Column, c: Column) -> Column:
        d, u = F.try_element_at(digit, c), F.try_element_at(unit, c)
        ones = F.when(s["now"] == 0, F.lit(1).cast("long")).otherwise(s["now"])
        return (
            F.when(d.isNotNull(), F.struct(s["total"].alias("total"), d.cast("long").alias("now")))
            .when(u.isNotNull(), F.struct((s["total"] + ones * u).alias("total"), F.lit(0).cast("long").alias("now")))
            .when(c == "万", F.struct(((s["total"] + s["now"]) * 10000).alias("total"), F.lit(0).cast("long").alias("now")))
            .otherwise(s)
        )

    return F.when(_c(x).rlike("^[0-9]+$"), _c(x).cast("long")).otherwise(F.aggregate(chars(x), start, step, lambda s: s["total"] + s["now"]))


def strict_chinese_number(x: Column | str) -> Column:
    """As above with 万 a unit like the others; digits without a unit are positional; anything else gives null."""
    digit = F.create_map(*[F.lit(v) for pair in DIGITS.items() for v in pair])
    unit = F.create_map(*[F.lit(v) for pair in UNITS.items() for v in pair])
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("now"))

    def step(s: Column, c: Column) -> Column:
        d, u = F.try_element_at(digit, c), F.try_element_at(unit, c)
        ones = F.when(s["now"] == 0, F.lit(1).cast("long")).otherwise(s["now"])
        return F.when(d.isNotNull(), F.struct(s["total"].alias("total"), d.cast("long").alias("now"))).otherwise(F.struct((s["total"] + ones * u).alias("total"), F.lit(0).cast("long").alias("now")))

    d, u = "".join(DIGITS), "".join(UNITS)
    places = F.translate(_c(x), "".join(DIGITS), "".join(map(str, DIGITS.values()))).cast("long")
    return (
        F.when(_c(x).rlike("^[0-9]+$"), _c(x).cast("long"))
        .when(_c(x).rlike(f"^[{d}]+$"), places)
        .when(_c(x).rlike(f"^[{d}{u}]+$"), F.aggregate(chars(x), start, step, lambda s: s["total"] + s["now"]))
    )


def split_point(x: Column | str, least: int = 8, marks: str = ",，、") -> Column:
    """The place after the comma nearest the middle with `least` characters on either side, the first on ties."""
    n = F.length(_c(x))
    places = F.filter(F.transform(chars(x), lambda c, i: F.when(F.lit(marks).contains(c), i + 1)), lambda i: i.isNotNull() & (i >= least) & (n - i >= least))
    return F.array_min(F.transform(places, lambda i: F.struct(F.abs(i - F.floor(n / 2)).alias("d"), i.alias("i"))))["i"]


#: Names whose values are secret.
SECRET_NAMES = ["api_key", "apikey", "authorization", "cookie", "password", "passwd", "private_key", "secret", "token"]
#: The same inline, as whole words, with an underscore or a hyphen or neither.
SECRETS = r"(?i)\b(" + "|".join(n.replace("_", "[_-]?") for n in SECRET_NAMES if n != "apikey") + r")\b"


def redacted(x: Column | str) -> Column:
    """Inline credentials (name, separator, value) and bearer tokens, replaced."""
    named = F.regexp_replace(_c(x), rf"{SECRETS}(\s*[:=]\s*)([^\s,;]+)", "$1$2[REDACTED]")
    return F.regexp_replace(named, r"(?i)\b(bearer\s+)[A-Za-z0-9._~+/=-]+", "$1[REDACTED]")


def redacted_map(x: Column | str) -> Column:
    """A map whose secret keys lose their values and whose other values are redacted inline."""
    return F.transform_values(_c(x), lambda k, v: F.when(F.replace(F.lower(k), F.lit("-"), F.lit("_")).isin(SECRET_NAMES), F.lit("[REDACTED]")).otherwise(redacted(v)))


def redacted_tree(x: Column | str) -> Column:
    """A JSON text, at any depth: members with a secret name lose their values, other strings are redacted inline. Works on
    the text, so nothing needs a schema: a secret member's value is a string, a number, a word, or a bracketed part
    without further brackets."""
    names = "|".join(n.replace("_", "[_-]?") for n in SECRET_NAMES if n != "apikey")
    member = rf'(?i)("(?:{names})"\s*:\s*)("(?:[^"\\]|\\.)*"|\[[^\[\]]*\]|\{{[^{{}}]*\}}|[^\s,}}\]]+)'
    return redacted(F.regexp_replace(_c(x), member, '$1"[REDACTED]"'))


def table_cell(x: Column | str) -> Column:
    """Text for a Markdown table."""
    return F.replace(F.replace(F.replace(_c(x), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


def matched_rules(x: Column | str, rules: dict[str, str]) -> Column:
    """The names of the rules (regular expressions) that match, in their order."""
    return F.filter(F.array(*[F.when(_c(x).rlike(p), F.lit(n)) for n, p in rules.items()]), lambda r: r.isNotNull())
