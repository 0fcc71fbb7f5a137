"""Quality rules by line-first cleaning, in DataFrame functions only.

Every line of a text is held against three rules: punctuation (a short line has to end like a
sentence, and no line may consist of marks for a large part), navigation (menus, breadcrumbs,
link labels) and boilerplate (notices that sites repeat). Lines that fail one are cut out; a
document that loses more than a share of its characters is rejected. Before that, a document
fails outright if it has few words or many repeated passages.

All of it is one projection: a row is judged by its own text alone, so nothing is shuffled and
no group meets in one task.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ASCII white space, which parts words, and the characters that count as symbols.
BLANKS, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
# Marks that end a sentence, and what may close it after them.
ENDS = r"[.!?:;\x{2026}\x{3002}\x{FF01}\x{FF1F}\x{061F}\x{0964}][\"')\]\x{201D}\x{2019}\x{BB}]*$"
# All marks of ASCII but those within words and numbers.
MARKS = "!\"#$%&()*+/:;<=>?@[\\]^`{|}~"
# Between items of a menu or a breadcrumb trail.
SEPARATORS = ("|", ">", "/", "\xbb", "\u203a", "\u2022", "\xb7", "::")
SEPARATOR = " (" + "|".join(s.replace("|", r"\|") for s in SEPARATORS) + ") "
# What menus and links say, at the start of a short line.
NAVIGATION = (
    "skip to", "read more", "click here", "learn more", "log in", "login", "sign in", "sign up", "home", "menu", "search", "next page", "previous page",
    "back to top", "share this", "share on", "follow us", "contact us", "about us", "related articles", "leave a comment", "add to cart",
)
# What notices say, anywhere in a line.
BOILERPLATE = (
    "all rights reserved", "privacy policy", "cookie policy", "uses cookies", "use of cookies", "accept cookies", "terms of use", "terms of service",
    "terms and conditions", "enable javascript", "javascript is disabled", "lorem ipsum", "subscribe to our", "sign up for our newsletter", "powered by wordpress",
)


MEASURES = ("clean_text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", "base_failed", "kept")


@dataclass(frozen=True)
class Rules:
    """short: words under which a line has to end like a sentence; marks: percent of a line's characters that may be MARKS, few: how many of them always may;
    items: words a separator, at most, that make a menu; label: words a navigation label's line has at most;
    lost: percent of its characters that a document may lose.
    fewest, repeated, window: words a document has at least, percent of them that repeated passages may have, words of a passage."""

    short: int = 6
    marks: int = 15
    few: int = 3
    items: int = 4
    label: int = 8
    lost: int = 40
    fewest: int = 20
    repeated: int = 30
    window: int = 8
    navigation: tuple[str, ...] = field(default=NAVIGATION)
    boilerplate: tuple[str, ...] = field(default=BOILERPLATE)


def _blanks(c: Column) -> Column:
    """How many characters of white space c has."""
    return _count(c, BLANKS)


def _count(c: Column, characters: str) -> Column:
    """How many of some ASCII characters c has; replace() only looks for a byte, translate() would look up every character."""
    return reduce(add, (F.octet_length(c) - F.octet_length(F.replace(c, F.lit(x), F.lit(""))) for x in characters))


def _any(c: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(or_, (F.contains(c, F.lit(x)) for x in phrases))


def _words(c: Column) -> Column:
    """The words of a text; a pattern is only needed where more than single spaces and line ends part them."""
    text = F.btrim(c, F.lit(BLANKS))
    odd = _any(text, ("  ", "\n\n", " \n", "\n ", "\t", "\x0b", "\x0c", "\r"))
    plain = F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " ")
    return F.when(text == "", F.array().cast("array<string>")).when(odd, F.split(text, r"[\x20\x09-\x0D]+")).otherwise(plain)


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def _held(rules: Rules, text: Column, may: dict[str, Column]) -> dict[str, Column]:
    """Which rules a line fails, from its text without white space around it. may: what the document allows to skip, by what it needs.

    Conditions that settle most lines come first: the rest isn't evaluated then.
    """
    n = F.size(F.split(text, r"[\x20\x09-\x0D]+"))
    some = "[" + re.escape(MARKS) + "]"
    many = text.rlike(rf"^(?:[^{re.escape(MARKS)}]*+{some}){{{rules.few + 1}}}")
    marks = F.octet_length(text) - F.octet_length(F.regexp_replace(text, some, ""))
    bars = F.size(F.split(text, SEPARATOR)) - 1
    lower, full = F.lower(text), text != ""
    either = lambda phrases: "(" + "|".join(phrases) + ")"
    return {
        "punctuation": full & ((~text.rlike(ENDS) & (n < rules.short)) | (many & (100 * marks > rules.marks * (F.length(text) - _blanks(text))))),
        "navigation": full & ((may["separator"] & (bars >= 2) & (n <= rules.items * bars)) | (may["navigation"] & lower.rlike(f"^{either(rules.navigation)}([^a-z]|$)") & (n <= rules.label))),
        "boilerplate": full & may["boilerplate"] & lower.rlike(either(rules.boilerplate)),
    }


def failures(line: Column, rules: Rules = Rules()) -> dict[str, Column]:
    """Which rules a line fails. A line without words fails none."""
    return _held(rules, F.btrim(line, F.lit(BLANKS)), dict.fromkeys(("separator", "navigation", "boilerplate"), F.lit(True)))


def _repeated(keys: str) -> Column:
    """Where windows begin that occur twice or more, rising, from keys (all windows as structs k, i, sorted); none where they are null."""
    near = lambda i: F.get(F.col(keys), i)["k"]
    again = F.filter(keys, lambda x, i: x["k"].eqNullSafe(near(i - 1)) | x["k"].eqNullSafe(near(i + 1)))
    return F.when(F.col(keys).isNull(), F.array().cast("array<int>")).otherwise(F.sort_array(F.transform(again, lambda x: x["i"])))


def measured(docs: DataFrame, text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """docs with clean_text and the columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars, base_failed, kept.

    Columns of docs that have one of these names are replaced. A null text counts as the empty
    one: no words, base_failed. Repeated rows and ties are judged alike, each by itself; texts of
    any length are judged whole, those with repeated passages by the passages themselves (the
    hashes of windows only tell that a text has none). An empty table gives an empty result.
    """
    w = rules.window
    own = docs.withColumn("_t", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    own = own.withColumns({"_w": _words(F.col("_t")), "_l": F.split("_t", "\n")})
    own = own.withColumns({"_n": F.size("_w"), "_v": F.transform("_w", lambda x: F.xxhash64(x)), "_full": F.filter("_l", has_word), "_low": F.lower("_t")})
    own = own.withColumns({"_separator": _any(F.col("_t"), tuple(f"{x} " for x in SEPARATORS)), "_navigation": _any(F.col("_low"), rules.navigation), "_boilerplate": _any(F.col("_low"), rules.boilerplate)}).drop("_low")
    held = 1  # words that an entry of _v is of: each step joins entries that lie side by side, the last one overlapping ones
    while held < w:
        by = min(held, w - held)
        tail = F.slice("_v", by + 1, F.greatest(F.size("_v") - by, F.lit(0)))
        own = own.withColumn("_v", F.slice(F.zip_with("_v", tail, lambda x, y: F.xxhash64(x, y)), 1, F.greatest(F.size("_v") - by, F.lit(0))))
        held += by
    starts = F.when(F.col("_n") >= w, F.sequence(F.lit(0), F.col("_n") - w)).otherwise(F.array().cast("array<int>"))
    twice = F.size(F.array_distinct("_v")) < F.size("_v")
    passages = F.transform(starts, lambda i: F.struct(F.concat_ws(" ", *[F.get(F.col("_w"), i + k) for k in range(w)]).alias("k"), i.alias("i")))  # slice() would copy the whole array each time
    own = own.withColumn("_k", F.when(twice, F.sort_array(passages)))
    own = own.withColumn("_p", _repeated("_k"))
    spans = F.transform("_p", lambda x, i: F.least(F.lit(w), F.coalesce(F.get(F.col("_p"), i + 1) - x, F.lit(w))))
    may = {k: F.col(f"_{k}") for k in ("separator", "navigation", "boilerplate")}
    stays = lambda x: ~F.exists(F.array(F.btrim(x, F.lit(BLANKS))), lambda t: reduce(or_, _held(rules, t, may).values()))
    kept_lines = F.array_join(F.filter("_l", stays), "\n")
    own = own.withColumns({
        "clean_text": kept_lines,
        "n_words": F.col("_n").cast("long"),
        "word_chars": (F.length("_t") - _blanks(F.col("_t"))).cast("long"),
        "n_symbols": _count(F.col("_t"), SYMBOLS).cast("long"),
        "n_dup_lines": (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long"),
        "n_repeat_words": F.aggregate(spans, F.lit(0), lambda a, x: a + x).cast("long"),
    })
    own = own.withColumns({"lost_chars": F.when(F.col("clean_text") == F.col("_t"), F.lit(0).cast("long")).otherwise(F.col("word_chars") - F.length("clean_text") + _blanks(F.col("clean_text"))), "base_failed": (F.col("n_words") < rules.fewest) | (100 * F.col("n_repeat_words") > rules.repeated * F.col("n_words"))})
    own = own.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= rules.lost * F.col("word_chars")))
    # a generator, as a filter on a column of projections would be pushed beneath them, with all they hold inlined in it
    made = F.inline_outer(F.array(F.struct(*MEASURES)))
    return own.select(*[c for c in docs.columns if c not in MEASURES], made)


def cleaned(docs: DataFrame, text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The documents that are kept, with the lines that failed cut out of their texts; the columns of docs."""
    return measured(docs, text_col, rules).filter("kept").withColumn(text_col, F.col("clean_text")).select(*docs.columns)
