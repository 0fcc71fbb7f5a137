"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

The unit of an edit is a word and the bound is one edit: two lines are alike when one word
inserted, deleted or substituted makes them equal, blanks and the case of A-Z aside. Lines
with fewer than min_words words are alike only when equal (one word of five is the most that
may differ by default; with two, any two lines of one word in common would be alike).

Every distinct line emits its variants, that is itself and itself without its i-th word, as
hashed keys. Lines that share the variant and i are one substitution apart; a whole line that
is another's variant is one insertion apart. All members of such a group are alike, so its
earliest line is all that has to be known: groups are aggregated before they are shuffled
and no pair of a group but (member, earliest) ever exists. The edit distance of those pairs
is verified on the words.

Only lines that can have a partner emit variants: of lines one edit apart, either the first
or the last h words agree if both have 2h + 1 words, h being a power of two that grows with
the line. Of these, the words are dealt into BLOCKS blocks; lines one edit apart agree in all
but one block, and only the variants of such a block are emitted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veristrata.llm.common import row_keys, stage

MIN_WORDS = 5
#: Blocks of a line: a variant of block q is emitted only if another line agrees in all other blocks.
BLOCKS = 4
#: Digests of lines that are broadcast at most; more are joined by key.
BROADCAST_LINES = 1_000_000


def normal(df: DataFrame, line: str) -> DataFrame:
    """df with norm: the line's words with A-Z in lower case, joined by single spaces; empty for a blank line.

    Each step is a projection of its own, so that no later expression repeats it. The pattern
    is tried only on lines that hold more than words between single spaces, and lower() is
    used only where no letter beyond ASCII would change; both spare most of the time.
    """
    odd = F.col(line).contains("  ")
    for c in "\t\x0b\x0c\r\n":
        odd = odd | F.col(line).contains(c)
    one = F.trim(F.when(odd, F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")).otherwise(F.col(line)))
    other = F.translate("_one", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # every character that lower() changes has one of these properties, unknown to older tables (Cn) included
    plain = (F.octet_length("_one") == F.length("_one")) | ~F.col("_one").rlike(r"[\p{IsUppercase}\p{Lt}\p{Cn}&&[^\x00-\x7F]]")
    return df.withColumn("_one", one).withColumn("norm", F.when(plain, F.lower("_one")).otherwise(other)).drop("_one", line)


def _lines(docs: DataFrame, text_col: str) -> DataFrame:
    """_key, n_lines, line_no (from 0), line of every line that isn't blank, and of every first line."""
    # outer, as for an inner explode the optimiser adds filters that split the text again
    split = docs.select("_key", F.split(F.coalesce(F.col(text_col), F.lit("")), "\n").alias("all"))
    split = split.select("_key", "all", F.size("all").alias("n_lines"))  # beneath the explode, or every line would carry all lines
    split = split.select("_key", "n_lines", F.posexplode_outer("all").alias("line_no", "line"))
    return split.filter((F.col("line_no") == 0) | F.col("line").rlike(r"[^\x20\x09-\x0D]"))


def _n_words(norm: str) -> Column:
    return F.octet_length(norm) - F.octet_length(F.replace(F.col(norm), F.lit(" "), F.lit(""))) + 1


def _edge(norm: str, count: Column) -> Column:
    """The first count words of a normal line, or its last -count words."""
    return F.call_function("substring_index", F.col(norm), F.lit(" "), count)


def _order() -> Column:
    """Documents by key, then lines: one number, so that min() can be pre-aggregated in place."""
    return (F.col("_key").cast("decimal(20,0)") * F.lit(2**31).cast("decimal(11,0)") + F.col("line_no")).cast("decimal(38,0)")


def _ends() -> Column:
    """Keys of the first and last h words of a line (norm, n, h), h the largest power of two with 2h + 1 <= n.

    Lines of 2h + 1 words carry the keys of h / 2 as well, as alike lines of 2h words do.
    """
    h, lower = F.col("h_words"), (F.col("n") == 2 * F.col("h_words") + 1) & (F.col("h_words") > 2)
    half = (h / 2).cast("int")
    keys = [F.xxhash64(k, _edge("norm", k)) for k in (h, -h)]
    return F.array(*keys, *[F.when(lower, F.xxhash64(k, _edge("norm", k))) for k in (half, -half)])


def _blocks() -> Column:
    """(short, q, key) of a line (norm, n): its words but those of block q of BLOCKS, hashed.

    As itself (short = false) the line has n words. As what is left of a longer line of
    n + 1 words, of which one in block q was deleted, it has the key of that line's block q.
    """
    out = []
    for short in (False, True):
        n = F.col("n") + int(short)
        for q in range(BLOCKS):
            low, high = F.floor(n * q / BLOCKS).cast("int"), F.floor(n * (q + 1) / BLOCKS).cast("int")
            key = F.xxhash64(n, F.lit(q), _edge("norm", low), _edge("norm", high - n))
            out.append(F.when(low < high, F.struct(F.lit(short).alias("short"), F.lit(q).alias("q"), key.alias("key"))))
    return F.array(*out)


def _one_edit(a: str, b: str) -> Column:
    """Whether word arrays a and b are at most one word edit apart."""
    a, b = F.col(a), F.col(b)
    long, short = F.when(F.size(a) >= F.size(b), a).otherwise(b), F.when(F.size(a) >= F.size(b), b).otherwise(a)
    at = F.array_position(F.zip_with(long, short, lambda x, y: x.eqNullSafe(y)), False).cast("int")
    rest = F.greatest(F.size(long) - at, F.lit(0))
    tail = F.slice(long, at + 1, rest)
    return (at == 0) | F.when(F.size(long) == F.size(short), tail == F.slice(short, at + 1, rest)).when(F.size(long) == F.size(short) + 1, tail == F.slice(short, at, rest)).otherwise(False)


def repeated_lines(keyed: DataFrame, text_col: str = "text", min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(_key, line_no) of every line that an earlier one equals or is one word edit away from, and (_key, n_lines) of all rows.

    Earlier means a smaller _key, a number of each row's own, then a smaller line number. An
    earlier line counts even if it is itself removed.
    """
    if min_words < 2:
        raise ValueError("any two lines of one word are one edit apart: min_words must be 2 or more")
    hashed = F.unhex(F.md5("norm"))
    norms = normal(_lines(keyed, text_col), "line").withColumn("n", _n_words("norm"))
    power = F.expr("shiftleft(1, length(bin((greatest(n, 3) - 1) div 2)) - 1)")
    full = F.col("norm") != ""
    every = norms.withColumn("h_words", power).select("_key", "n_lines", "line_no", F.when(full, hashed).alias("h"), _order().alias("ord"), F.when(full & (F.col("n") >= min_words), _ends()).alias("ends"))
    every = stage(every, "occurrences")
    sizes, occ = every.filter("line_no = 0").select("_key", "n_lines"), every.filter("h IS NOT NULL")
    firsts = stage(occ.groupBy("h").agg(F.min("ord").alias("first"), F.any_value("ends").alias("ends")), "firsts")
    ends = firsts.filter("ends IS NOT NULL").select("h", "first", F.explode("ends").alias("end")).filter("end IS NOT NULL")
    shared = ends.groupBy("end").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("end")
    some = stage(ends.join(shared, "end").groupBy("h").agg(F.min("first").alias("first")), "candidates")
    side = F.broadcast(some) if some.count() <= BROADCAST_LINES else some
    places = side.select(F.col("first").alias("ord"), "h")
    texts = normal(_lines(keyed, text_col).withColumn("ord", _order()).join(places, "ord"), "line")
    texts = stage(texts.select("h", F.col("ord").alias("first"), "norm", _n_words("norm").alias("n")), "lines")
    blocks = texts.select("h", F.explode(_blocks()).alias("b")).filter("b IS NOT NULL").select("h", "b.short", "b.q", "b.key")
    blocks = stage(blocks, "blocks")
    met = blocks.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.bool_and("short").alias("only_short")).filter("m > 1 AND NOT only_short").select("key")
    at = F.when(F.col("short"), F.lit(1 << BLOCKS)).otherwise(F.expr("shiftleft(1, q)"))
    open_blocks = blocks.join(met, "key").groupBy("h").agg(F.bit_or(at).alias("mask"))
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.join(open_blocks, "h").repartition(parts, "h").select("h", "n", "mask", F.col("first").alias("ord"), F.posexplode(F.split("norm", " ")).alias("p", "word"))
    dealt = dealt.select("h", "n", "mask", "ord", (F.col("p") + 1).alias("i"), F.xxhash64("word", F.col("p") + 1).alias("here"), F.xxhash64("word", "p").alias("moved"))
    line = Window.partitionBy("h").orderBy("i")
    before, through = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(Window.unboundedPreceding, 0)
    entire = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.coalesce(F.bit_xor("here").over(before), F.lit(0))
    right = F.bit_xor("moved").over(entire).bitwiseXOR(F.bit_xor("moved").over(through))
    variants = dealt.select("h", "n", "mask", "ord", "i", left.bitwiseXOR(right).alias("v"), F.bit_xor("here").over(entire).alias("w"))
    # i = 0 stands for the whole line; the first word's row emits it besides its own variant
    own = F.when(F.expr("getbit(mask, (i * %d - 1) div n) = 1" % BLOCKS), F.struct("i", "v"))
    whole = F.when((F.col("i") == 1) & (F.col("mask") >= 1 << BLOCKS), F.struct(F.lit(0).alias("i"), F.col("w").alias("v")))
    keys = stage(variants.select("h", "ord", F.explode(F.array_compact(F.array(own, whole))).alias("k")).select("h", "ord", "k.i", "k.v"), "variants")
    by_place = keys.groupBy("v", "i").agg(F.min("ord").alias("low"), F.count(F.lit(1)).alias("m"))
    alike = by_place.filter("m > 1 AND i > 0").select("v", "i", "low")
    substituted = keys.join(alike, ["v", "i"]).filter("low < ord").select("h", "ord", "low")
    wholes = keys.filter("i = 0").groupBy("v").agg(F.min("ord").alias("short"))
    cuts = keys.filter("i > 0").join(wholes.select("v"), "v", "left_semi").groupBy("v").agg(F.min("ord").alias("long"))
    near = keys.join(wholes.join(cuts, "v"), "v")
    inserted = near.select("h", "ord", F.when(F.col("i") > 0, F.col("short")).otherwise(F.col("long")).alias("low")).filter("low < ord")
    pairs = substituted.union(inserted).distinct()
    old = texts.select(F.col("first").alias("low"), F.split("norm", " ").alias("old"))
    checked = pairs.join(old, "low").join(texts.select("h", F.split("norm", " ").alias("new")), "h").filter(_one_edit("new", "old")).select("h").distinct()
    gone = stage(checked.select("h", F.lit(True).alias("near")), "near")
    first = firsts.join(gone, "h", "left")
    return occ.select("_key", "line_no", "h", "ord").join(first, "h").filter("near OR ord > first").select("_key", "line_no"), sizes


def _marks(keyed: DataFrame, text_col: str, min_words: int) -> DataFrame:
    """_key, n_lines, removed of every row."""
    gone, sizes = repeated_lines(keyed, text_col, min_words)
    gone = gone.groupBy("_key").agg(F.array_sort(F.collect_list("line_no")).alias("removed"))
    return sizes.join(gone, "_key", "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))


def line_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (line numbers from 0, rising) of every row of docs.

    Blank lines always stay; a null or empty text is one blank line. Every row is a document
    of its own: rows that repeat a doc_id come one after another, in the order of their content,
    and those without one come last. An empty table gives an empty result; other columns don't matter.
    """
    own = row_keys(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    marks = _marks(own, "text", min_words)
    return own.select("doc_id", "_key").join(marks, "_key").select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), "removed")


def without_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the lines that line_dedup() names cut out of their texts."""
    own = row_keys(docs, id_col)
    marks = _marks(own, text_col, min_words).filter(F.size("removed") > 0).select("_key", "removed")
    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda x, i: ~F.array_contains("removed", i)), "\n")
    return own.join(marks, "_key", "left").withColumn(text_col, F.when(F.col("removed").isNull(), F.col(text_col)).otherwise(kept)).select(*docs.columns)
