"""Typed normalisation as Column expressions: each function gives the value, some a problem too.

A problem is a message or null. Nothing here leaves the JVM.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as no value at all.
EMPTY_WORDS = ("", "na", "n/a", "none", "null", "-", "--", "nan")

def _folds() -> tuple[dict[str, str], dict[str, str]]:
    """Characters beyond ASCII whose compatibility decomposition holds some of ASCII: those that leave one character, and those that leave more."""
    one, more = {}, {}
    for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x20000)]):
        plain = ascii_of(c)
        if plain:
            (one if len(plain) == 1 else more)[c] = plain
    return one, more


def ascii_of(s: str) -> str:
    """A text of the driver's as fold_ascii() leaves a column's."""
    return unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode()


_ONE, _MORE = _folds()
_FROM, _TO, _LONG = "".join(_ONE), "".join(_ONE.values()), "[" + "".join(_MORE) + "]"
_SPELT = "\x01".join(f"{c}\x02{plain}" for c, plain in _MORE.items())

# Date patterns in the order they are tried; two-digit years are handled apart.
DATE_PATTERNS = ("yyyy-M-d", "M/d/yyyy", "M-d-yyyy", "yyyy/M/d", "d-MMM-yyyy", "d MMM yyyy", "MMM d yyyy", "MMMM d yyyy", "MMM d, yyyy", "MMMM d, yyyy", "M.d.yyyy", "yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s")


# Superset of what a run of pattern letters reads: years of four digits at least, months by name, numbers.
_SHAPE = {"yyyy": r"[+-]?\d{4,}", "MMMM": r"\p{L}+", "MMM": r"\p{L}{1,5}\.?"}


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c), with c worked out once however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _shape(pattern: str) -> str:
    """A regular expression that holds for all texts that the date pattern can read; a pattern that can't is costly, as it fails by an exception."""
    runs = [m.group(0) for m in re.finditer(r"'[^']*'|([A-Za-z])\1*|.", pattern)]
    return "^(?i:" + "".join(r[1:-1] if r[0] == "'" else _SHAPE.get(r, r"[+-]?\d+") if r[0].isalpha() else re.escape(r) for r in runs) + ")$"


def is_empty(c: Column) -> Column:
    return c.isNull() | F.lower(F.trim(c)).isin(*EMPTY_WORDS)


def fold_ascii(c: Column) -> Column:
    """Letters with marks, wide forms and ligatures become plain; what is left beyond ASCII goes."""

    def plain(x: Column) -> Column:
        spelt = F.str_to_map(F.lit(_SPELT), F.lit("\x01"), F.lit("\x02"))  # one literal: a map of literals would make plans huge
        long = F.array_join(F.transform(F.split(x, ""), lambda v: F.coalesce(F.try_element_at(spelt, v), v)), "")
        folded = F.translate(F.when(x.rlike(_LONG), long).otherwise(x), _FROM, _TO)
        return F.when(x.rlike(r"[^\x00-\x7F]"), F.regexp_replace(folded, r"[^\x00-\x7F]", "")).otherwise(x)

    return let(c, plain)  # so that plans hold c once


def simplify(c: Column) -> Column:
    """Lower-case words of letters and digits, one space between; apostrophes vanish, & is 'and'."""
    s = F.regexp_replace(F.lower(fold_ascii(F.coalesce(c, F.lit("")))), "&", " and ")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"['`]", ""), r"[^a-z0-9]+", " "))


def text(c: Column) -> Column:
    return F.when(~is_empty(c), F.trim(F.regexp_replace(c, r"\s+", " ")))


def identifier(c: Column) -> Column:
    return F.when(~is_empty(c), F.upper(F.regexp_replace(c, r"\s", "")))


def license_number(c: Column) -> Column:
    bare = F.regexp_replace(F.upper(fold_ascii(c)), r"[\s#._/\-]", "")
    return F.when(~is_empty(c), F.regexp_replace(bare, r"^([A-Z]+)(\d+)$", "$1-$2"))


def phone(c: Column) -> tuple[Column, Column]:
    """Ten digits as ddd-ddd-dddd; other numbers stay as digits with a problem."""
    digits = F.regexp_replace(c, r"\D", "")
    ten = F.when(F.length(digits) == 11, F.regexp_replace(digits, "^1", "")).otherwise(digits)
    good = F.length(ten) == 10
    value = F.when(~is_empty(c), F.when(good, F.concat_ws("-", F.substring(ten, 1, 3), F.substring(ten, 4, 3), F.substring(ten, 7, 4))).otherwise(ten))
    return value, F.when(~is_empty(c) & ~good, F.concat(F.lit("not a valid phone number: "), c))


def email(c: Column) -> tuple[Column, Column]:
    value = F.when(~is_empty(c), F.lower(F.trim(c)))
    return value, F.when(value.isNotNull() & ~value.rlike(r"^[^@\s]+@[^@\s]+\.[a-z]{2,}$"), F.concat(F.lit("not a valid email: "), c))


def number(c: Column, low: float | None = None, high: float | None = None) -> tuple[Column, Column]:
    """The first number in the text; one out of range keeps its value and has a problem."""
    found = F.regexp_extract(F.regexp_replace(c, ",", ""), r"-?\d+(\.\d+)?", 0)
    value = F.when(~is_empty(c), F.expr("cast(null as double)") if c is None else found.try_cast("double"))
    problem = F.when(~is_empty(c) & value.isNull(), F.concat(F.lit("not a number: "), c))
    if low is not None:
        problem = F.coalesce(problem, F.when(value < low, F.lit(f"below the expected minimum {low:g}")))
    if high is not None:
        problem = F.coalesce(problem, F.when(value > high, F.lit(f"above the expected maximum {high:g}")))
    return value, problem


def date(c: Column) -> tuple[Column, Column]:
    """A date by the first pattern that reads it, a compact yyyymmdd, or a five-digit sheet serial."""

    def read(s: Column) -> Column:
        tries = [F.when(s.rlike(_shape(p)), F.try_to_timestamp(s, F.lit(p)).cast("date")) for p in DATE_PATTERNS]
        short = r"^(\d{1,2})([/-])(\d{1,2})\2(\d{2})$"
        year = F.regexp_extract(s, short, 4).try_cast("int")
        full = F.concat_ws("-", F.when(year >= 69, year + 1900).otherwise(year + 2000), F.regexp_extract(s, short, 1), F.regexp_extract(s, short, 3))
        compact = F.when(s.rlike(r"^\d{8}$"), F.try_to_timestamp(s, F.lit("yyyyMMdd")).cast("date"))
        serial = F.when(s.rlike(r"^\d{5}(\.0+)?$"), F.regexp_extract(s, r"^\d{5}", 0).try_cast("int"))
        sheet = F.when((serial > 20000) & (serial < 80000), F.date_add(F.lit("1899-12-30").cast("date"), serial))
        return F.coalesce(*tries, F.when(s.rlike(short), F.try_to_timestamp(full, F.lit("yyyy-M-d")).cast("date")), compact, sheet)

    value = let(c, lambda t: F.when(~is_empty(t), let(F.trim(F.regexp_replace(t, r"\s+", " ")), read)))
    return value, F.when(~is_empty(c) & value.isNull(), F.concat(F.lit("not a valid date: "), c))


def vocabulary(aliases: dict[str, list[str]]) -> dict[str, str]:
    """Simplified alias -> code; a code is its own alias and later ones win."""
    plain = lambda s: " ".join(re.findall(r"[a-z0-9]+", re.sub("['`]", "", ascii_of(s).lower().replace("&", " and "))))
    return {plain(a): code for code, names in aliases.items() for a in (code, *names)}


def code(c: Column, words: dict[str, str]) -> tuple[Column, Column]:
    """Exact alias, else the longest alias contained as whole words, else null and a problem."""
    s = simplify(c)
    exact = [F.when(s == a, F.lit(v)) for a, v in words.items()]
    longest = sorted((a for a in words if len(a) >= 2), key=lambda a: (-len(a), a))
    inside = [F.when(F.contains(F.concat(F.lit(" "), s, F.lit(" ")), F.lit(f" {a} ")), F.lit(words[a])) for a in longest]
    value = F.when(~is_empty(c), F.coalesce(*exact, *inside))
    return value, F.when(~is_empty(c) & value.isNull(), F.concat(F.lit("unknown code: "), c))


def display(c: Column, kind: str) -> Column:
    """How a value shows in issues: integral numbers without decimals, null as the empty text."""
    if kind in ("double", "float"):
        return F.coalesce(F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string")), F.lit(""))
    return F.coalesce(c.cast("string"), F.lit(""))


def problems(**found: Column) -> Column:
    """array<struct<field, message>> of the problems that aren't null."""
    every = [F.when(p.isNotNull(), F.struct(F.lit(f).alias("field"), p.alias("message"))) for f, p in found.items()]
    return F.array_compact(F.array(*every))


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
