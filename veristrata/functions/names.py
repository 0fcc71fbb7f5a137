"""Person and organisation names: parsing, keys, and the similarity ladder.

Only the ladder's last rung, the Ratcliff-Obershelp ratio, runs in Python; it is an Arrow UDF
meant for distinct pairs that no earlier rung has settled.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from veristrata.functions.normalize import is_empty, let, simplify
from veristrata.functions.settle import settle

# Suffixes that aren't part of a last name.
SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "md", "rn", "lpn", "cna", "phd")
# Words that don't tell organisations apart.
ORG_WORDS = (
    "inc", "incorporated", "llc", "ltd", "limited", "corp", "corporation", "co", "company", "the", "gmbh", "plc", "lp", "llp", "pllc", "sa", "ag",
    "pty", "group", "holdings", "ab", "oy", "as", "bv", "nv", "srl", "spa", "kk", "sarl", "pte", "sas", "intl", "international",
)
NAME = "struct<first:string,middle:string,last:string,display:string,org:boolean>"


def _title(c: Column) -> Column:
    """Each run of letters with its first letter in upper case."""
    return F.array_join(F.transform(F.split(F.trim(c), r"(?<=[^\p{L}])(?=\p{L})"), F.initcap), "")


def _words(c: Column) -> Column:
    return F.filter(F.split(simplify(c), " "), lambda w: w != "")


def _struct(first: Column, last: Column) -> Column:
    def made(n: Column) -> Column:
        show = F.trim(F.concat(_title(n["first"]), F.lit(" "), _title(n["last"])))
        words = F.struct(_words(n["first"]).alias("f"), F.filter(_words(n["last"]), lambda w: ~w.isin(*SUFFIXES)).alias("rest"))
        return let(words, lambda w: F.when((F.size(w["f"]) > 0) | (F.size(w["rest"]) > 0), named(w["f"], w["rest"], show)))

    def named(f: Column, rest: Column, show: Column) -> Column:
        middle = F.array_join(F.slice(f, 2, F.greatest(F.size(f) - 1, F.lit(0))), " ")
        return F.struct(F.coalesce(F.get(f, F.lit(0)), F.lit("")).alias("first"), middle.alias("middle"), F.array_join(rest, "").alias("last"), show.alias("display"), F.lit(False).alias("org"))

    return let(F.struct(first.alias("first"), last.alias("last")), made)


def person(first: Column, last: Column) -> Column:
    """Name struct of given and family name; null if both are empty."""
    return _struct(F.coalesce(first, F.lit("")), F.coalesce(last, F.lit("")))


def parse_person(full: Column) -> Column:
    """Name struct from 'First Middle Last' or 'LAST, FIRST MIDDLE'; null if empty.

    Trailing suffixes go as long as two words stay; words of a family name are joined.
    """

    def kept(words: Column) -> Column:
        held = F.array_max(F.transform(words, lambda w, i: F.when(simplify(w).isin(*SUFFIXES), F.least(i + 1, F.lit(2))).otherwise(i + 1)))
        return F.slice(words, 1, held)

    def parsed(text: Column) -> Column:
        comma = F.contains(text, F.lit(","))

        def split(words: Column) -> Column:
            before = F.array_join(F.slice(words, 1, F.size(words) - 1), " ")
            first = F.when(comma, F.regexp_replace(text, r"^[^,]*,", "")).otherwise(before)
            last = F.when(comma, F.substring_index(text, ",", 1)).otherwise(F.element_at(words, -1))
            return _struct(first, last)

        return let(let(F.split(text, r"\s+"), kept), split)

    return F.when(~is_empty(full), let(F.trim(F.coalesce(full, F.lit(""))), parsed))


def parse_org(c: Column) -> Column:
    """Name struct of an organisation: what is left without ORG_WORDS, or all if nothing is."""
    own = F.array_join(F.filter(_words(c), lambda w: ~w.isin(*ORG_WORDS)), " ")
    last = F.when(own == "", simplify(c)).otherwise(own)
    return F.when(~is_empty(c), F.struct(F.lit("").alias("first"), F.lit("").alias("middle"), last.alias("last"), F.trim(F.regexp_replace(c, r"\s+", " ")).alias("display"), F.lit(True).alias("org")))


def nickname_groups(groups: list[str]) -> dict[str, list[int]]:
    """Name -> numbers of its groups, from groups such as "robert rob bob"."""
    out: dict[str, list[int]] = {}
    for i, g in enumerate(groups):
        for n in g.split():
            out.setdefault(n, []).append(i)
    return out


def _groups_of(first: Column, nicknames: dict[str, list[int]] | None) -> Column:
    if not nicknames:
        return F.array().cast("array<int>")
    table = F.create_map(*(x for n, g in nicknames.items() for x in (F.lit(n), F.array(*map(F.lit, g)))))
    return F.coalesce(F.try_element_at(table, first), F.array().cast("array<int>"))


def name_key(name: Column, nicknames: dict[str, list[int]] | None = None) -> Column:
    """last|first; a nickname stands as # and its lowest group."""
    group = F.array_min(_groups_of(name["first"], nicknames))
    return F.concat_ws("|", name["last"], F.coalesce(F.concat(F.lit("#"), group.cast("string")), name["first"]))


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching characters; the order of the arguments matters."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


def score_pairs(pairs: DataFrame, a: str = "a", b: str = "b", nicknames: dict[str, list[int]] | None = None) -> DataFrame:
    """Add score and how to pairs of name structs: exact, nickname, initial, swapped, shortened, fuzzy; organisations by words and ratio.

    Rows that a cheap rung settles never reach Python. A null name scores 0.
    """
    fa, la, fb, lb = F.col(a)["first"], F.col(a)["last"], F.col(b)["first"], F.col(b)["last"]
    org = F.coalesce(F.col(a)["org"], F.lit(False)) | F.coalesce(F.col(b)["org"], F.lit(False))
    nick = F.arrays_overlap(_groups_of(fa, nicknames), _groups_of(fb, nicknames)) if nicknames else F.lit(False)
    given, prefix = (fa != "") & (fb != ""), F.startswith(fa, fb) | F.startswith(fb, fa)
    same, alone = la == lb, (F.length(fa) == 1) | (F.length(fb) == 1)
    initial = same & given & alone & (F.substring(fa, 1, 1) == F.substring(fb, 1, 1))
    rungs = (
        (F.col(a).isNull() | F.col(b).isNull(), 0.0, "none"),
        (org & same, 1.0, "same organisation"),
        (~org & same & (fa == fb), 1.0, "exact"),
        (~org & same & nick, 0.95, "nickname"),
        (~org & initial, 0.85, "initial"),
        (~org & (fa == lb) & (la == fb), 0.9, "swapped"),
        (~org & same & prefix & (F.least(F.length(fa), F.length(fb)) >= 3), 0.9, "shortened"),
    )
    score, how = F.lit(None).cast("double"), F.lit(None).cast("string")
    for on, value, label in reversed(rungs):
        score, how = F.when(on, F.lit(value)).otherwise(score), F.when(on, F.lit(label)).otherwise(how)
    known = pairs.withColumns({"score": score, "how": how, "_org": org})
    rest = known.filter("score IS NULL")
    x, y = F.split(la, " "), F.split(lb, " ")
    shared = F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
    people = F.round(0.6 * ratio(la, lb) + 0.4 * F.when((fa == fb) | nick, F.lit(1.0)).otherwise(ratio(fa, fb)), 3)
    orgs = rest.filter("_org").withColumns({"score": F.round(F.greatest(shared, ratio(la, lb)), 3), "how": F.lit("similar organisation")})
    fuzzy = rest.filter("NOT _org").withColumns({"score": people, "how": F.lit("fuzzy")})
    return known.filter("score IS NOT NULL").unionByName(orgs).unionByName(fuzzy).drop("_org")


def _letters(c: Column) -> Column:
    """The characters, the n-th copy of one as character and n: array_intersect then counts copies."""
    chars = F.filter(F.split(c, ""), lambda v: v != "")
    return F.transform(chars, lambda v, i: F.concat(v, F.size(F.filter(F.slice(chars, 1, i), lambda w: w == v)).cast("string")))


def _bound(x: Column, y: Column) -> Column:
    """At least ratio() of the texts that _letters() gave x and y: matching blocks hold no more than the characters that both have."""
    n = F.size(x) + F.size(y)
    return F.when(n > 0, 2.0 * F.size(F.array_intersect(x, y)) / n).otherwise(1.0)


#: Letters of two texts that are a key together.
LETTERS = 3
#: Letters that are ordered by how often they occur; others count as rare ones.
RANKED = 256


def _subsets(items: Column, size: int) -> Column:
    """Texts of all `size` items in a row's order."""
    if size == 1:
        return items
    return F.flatten(F.transform(items, lambda x, i: F.transform(_subsets(F.slice(items, i + 2, F.greatest(F.size(items) - i - 1, F.lit(0))), size - 1), lambda rest: F.concat(x, rest))))


def _prefix_keys(letters: Column, least: float) -> Column:
    """Keys of which texts with letters (rarest first) share one if their letters' bound is `least` or more.

    With n letters a text shares at least n * least / (2 - least) of them with any such partner. If o letters are shared, any
    k <= o of the rarest shared ones are within the first n - o + k of either: these give the keys, for k = LETTERS
    and, where fewer may be shared, for smaller k.
    """
    n = F.size(letters)
    shared = F.greatest(F.ceil(n * (least / (2 - least)) - 1e-9).cast("int"), F.lit(1))
    out = []
    for k in range(1, LETTERS + 1):
        head = F.slice(letters, 1, F.greatest(n - F.greatest(shared, F.lit(k)) + k, F.lit(0)))
        keys = F.transform(_subsets(head, k), lambda x: F.concat(F.lit(f"{k}"), x))
        out.append(keys if k == LETTERS else F.when(shared <= k, keys).otherwise(F.array().cast("array<string>")))
    return F.when(n > 0, F.concat(*out)).otherwise(F.array().cast("array<string>"))


def _rare_first(*texts: DataFrame) -> Column:
    """The letters of column text, those that the frames' texts have least often first."""
    seen = reduce(DataFrame.union, [t.select("text") for t in texts]).select(F.explode(_letters(F.col("text"))).alias("x")).groupBy("x").count()
    often = [r["x"] for r in seen.orderBy(F.desc("count"), "x").limit(RANKED).collect()]  # RANKED rows at most
    place = F.array(*map(F.lit, often)) if often else F.array().cast("array<string>")
    rank = lambda x: F.when(F.array_position(place, x) > 0, -F.array_position(place, x)).otherwise(F.lit(-RANKED - 1))
    ordered = F.sort_array(F.transform(_letters(F.col("text")), lambda x: F.struct(rank(x).cast("int").alias("r"), x.alias("x"))))
    return F.transform(ordered, lambda v: v["x"])


def alike_texts(a: DataFrame, b: DataFrame, least: float, order: Column | None = None) -> DataFrame:
    """(a, b) of all pairs of distinct texts (column text) whose shared letters allow a ratio of `least` or more: a multiset join by prefix keys.

    Empty texts meet nothing here. Letters are ordered by rarity (or as `order` has them), so that keys are of rare ones; lengths
    that can't reach the bound are told apart by the join's condition. A pair that meets in several keys comes out once.
    """
    if not 0 < least <= 1:
        raise ValueError("the least ratio must be above 0")
    order = _rare_first(a, b) if order is None else order
    made = [t.select("text").distinct().withColumn("l", order).select(F.col("text").alias(n), F.col("l").alias(f"l{n}"), F.explode(_prefix_keys(F.col("l"), least)).alias("key")) for t, n in ((a, "a"), (b, "b"))]
    near = (F.size("la") * least <= F.size("lb") * (2 - least) + 1e-9) & (F.size("lb") * least <= F.size("la") * (2 - least) + 1e-9)
    return made[0].join(made[1], "key").filter(near & (_bound(F.col("la"), F.col("lb")) >= least - 1e-9)).select("a", "b").distinct()


def _shared_words(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """(a, b) of distinct texts that share `least` or more of their words: those that stand first by rarity are the keys."""

    def worded(t: DataFrame, n: str) -> DataFrame:
        return t.select("text").distinct().select(F.col("text").alias(n), F.array_distinct(F.split("text", " ")).alias(f"w{n}"))

    x, y = worded(a, "a"), worded(b, "b")
    often = x.select(F.explode("wa").alias("w")).union(y.select(F.explode("wb").alias("w"))).groupBy("w").count()

    def keyed(t: DataFrame, n: str) -> DataFrame:
        each = t.select(n, F.size(f"w{n}").alias("size"), F.explode(f"w{n}").alias("w")).join(often, "w")
        ordered = each.groupBy(n, "size").agg(F.sort_array(F.collect_list(F.struct("count", "w"))).alias("ws"))
        head = F.slice("ws", 1, F.col("size") - F.ceil(F.col("size") * least - 1e-9).cast("int") + 1)
        return ordered.select(n, F.explode(F.transform(head, lambda v: v["w"])).alias("key"))

    met = keyed(x, "a").join(keyed(y, "b"), "key").select("a", "b").distinct()
    both, every = F.array_intersect(F.split("a", " "), F.split("b", " ")), F.array_union(F.split("a", " "), F.split("b", " "))
    return met.filter(F.size(both) >= (least - 1e-9) * F.size(every))


def candidates(records: DataFrame, entities: DataFrame, rec: str, entity: str, nicknames: dict[str, list[int]] | None = None, cut: float = 0.65) -> DataFrame:
    """(rec, entity, a, b, score, how) of all names (column name) that score cut or more, each pair once; cut must be above 0.4.

    The cheap rungs need the same family name or the two names swapped, which are keys. A person's ratio is 0.6 of the
    family names' and 0.4 of the given names': to reach the cut, one of the two must reach it itself. Either the family names do: distinct ones
    are joined by the letters they share (alike_texts). Or the given names do, or are the same: then the family names
    still need (cut - 0.4) / 0.6, and pairs meet by given name and by letters of the family name at once.
    Organisations meet by letters or by words of their names. All pairs that can't reach the cut by
    the letters they share are dropped natively; the rest is scored. No pair of names is made but by a key;
    copies of a name meet once and are joined back.
    """
    least = cut - 0.001  # scores are rounded to 3 digits
    if least <= 0.4:
        raise ValueError("the cut must be above 0.4")

    def side(df: DataFrame, n: str) -> DataFrame:
        own = settle(df.select(F.col("name").alias(n)).filter(F.col(n).isNotNull()).distinct(), f"names_{n}")
        return own.withColumns({f"last_{n}": F.coalesce(F.col(n)["last"], F.lit("")), f"first_{n}": F.coalesce(F.col(n)["first"], F.lit("")), f"org_{n}": F.coalesce(F.col(n)["org"], F.lit(False))})

    x, y = side(records, "a"), side(entities, "b")
    texts = lambda df, c: df.select(F.col(c).alias("text")).filter("text <> ''").distinct()

    def blocks(df: DataFrame, n: str) -> DataFrame:
        first, last = F.col(n)["first"], F.col(n)["last"]
        keys = F.array(F.concat(F.lit("l|"), last), F.concat(F.lit("s|"), F.least(first, last), F.lit("|"), F.greatest(first, last)))
        return df.select(n, F.explode(keys).alias("block"))

    keyed = blocks(x, "a").join(blocks(y, "b"), "block").select("a", "b")
    order = _rare_first(*(df.select(F.explode(F.array(f"first_{n}", f"last_{n}")).alias("text")) for df, n in ((x, "a"), (y, "b"))))
    last = alike_texts(texts(x, "last_a"), texts(y, "last_b"), least, order).select(F.col("a").alias("last_a"), F.col("b").alias("last_b"))
    by_last = x.join(last, "last_a").join(y, "last_b")
    # given names that are the same, nicknames of each other, or alike
    fx, fy = texts(x.filter("NOT org_a"), "first_a"), texts(y.filter("NOT org_b"), "first_b")
    given = alike_texts(fx, fy, least, order).withColumn("r", ratio(F.col("a"), F.col("b"))).filter(F.col("r") >= least).select("a", "b")
    given = given.unionByName(fx.select(F.col("text").alias("a"), F.col("text").alias("b")))
    if nicknames:
        told = [t.select(F.col("text").alias(n), F.explode(_groups_of(F.col("text"), nicknames)).alias("g")) for t, n in ((fx, "a"), (fy, "b"))]
        given = given.unionByName(told[0].join(told[1], "g").select("a", "b"))
    given = given.unionByName(records.sparkSession.range(1).select(F.lit("").alias("a"), F.lit("").alias("b")))  # both without a given name
    given = given.distinct().select(F.col("a").alias("first_a"), F.col("b").alias("first_b"))
    rest = (least - 0.4) / 0.6

    def lettered(df: DataFrame, n: str) -> DataFrame:
        own = texts(df, f"last_{n}").withColumn("l", order).select(F.col("text").alias(f"last_{n}"), _prefix_keys(F.col("l"), rest).alias("keys"))
        return df.filter(f"NOT org_{n}").join(own, f"last_{n}").select(n, f"first_{n}", F.explode("keys").alias("key"))

    by_given = lettered(x, "a").join(given, "first_a").join(lettered(y, "b"), ["first_b", "key"])
    met = by_last.select("a", "b").unionByName(by_given.select("a", "b"))
    orgs = _shared_words(texts(x, "last_a"), texts(y, "last_b"), least).select(F.col("a").alias("last_a"), F.col("b").alias("last_b"))
    met = met.unionByName(x.join(orgs, "last_a").join(y, "last_b").filter("org_a OR org_b").select("a", "b")).distinct()
    a, b = F.col("a"), F.col("b")
    likely = _bound(_letters(a["last"]), _letters(b["last"]))
    people = 0.6 * likely + 0.4 * F.when((a["first"] == b["first"]) | F.arrays_overlap(_groups_of(a["first"], nicknames), _groups_of(b["first"], nicknames)), 1.0).otherwise(_bound(_letters(a["first"]), _letters(b["first"])))
    wa, wb = F.split(a["last"], " "), F.split(b["last"], " ")
    most = F.when(a["org"] | b["org"], F.greatest(likely, F.size(F.array_intersect(wa, wb)) / F.size(F.array_union(wa, wb)))).otherwise(people)
    pairs = settle(keyed.union(met.filter(most >= least)).distinct(), "pairs")
    scored = score_pairs(pairs, nicknames=nicknames).filter(F.col("score") >= cut)
    r, e = records.select(F.col(rec).alias("rec"), F.col("name").alias("a")), entities.select(F.col(entity).alias("entity"), F.col("name").alias("b"))
    return r.join(scored, "a").join(e, "b").select("rec", "entity", "a", "b", "score", "how")
