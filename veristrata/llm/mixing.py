"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target may be a multiple of its size: complete epochs take every document once
each; the rest is a fractional selection. There each document draws an exponential key,
-ln(u) / quality weight, and the documents of a source are taken in key order as long as
their prefix sum stays within the source's remaining budget (a document is in when its middle
is). u comes from a hash of the row's key, which is the document's id where ids are whole, so
reruns agree and rows without an id, or with a repeated one, draw each on its own.

Prefix sums don't need a whole source in one task: all documents are range-sorted by source and
key, whatever the distribution of the keys and however large a source; sums per range and
source give each range its offset, and only ranges are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veristrata.llm.common import WORD, row_keys, stage

#: Relative weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: Documents of a range, about.
RANGE_ROWS = 500_000
#: The least weight a document has.
LEAST = 0.05


def quality_weight(text: Column) -> Column:
    """How clean a text looks: its share of characters that aren't ASCII digits or signs, to the fourth; LEAST at least."""
    signs = F.char_length(text) - F.char_length(F.regexp_replace(text, r"[!-@\[-`{-~]", ""))
    clean = F.lit(1.0) - F.try_divide(signs.cast("double"), F.char_length(text).cast("double"))
    return F.greatest(F.lit(LEAST), F.coalesce(clean * clean * clean * clean, F.lit(0.0)))


def uniform(id_col: Column, seed: str) -> Column:
    """In (0, 1): 52 bits of the MD5 of seed and id; null counts as the empty string."""
    head = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(id_col.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(head, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) -> (source, source_size, target): share * all sizes by weight, each at most most * its size.

    Water-filling in closed form: with sources ordered by cap / weight, the first k are
    capped and the others get weight * level, level = (total - caps) / (weights left).
    One row per source, hence windows without partitions.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    base = sizes.select("source", "source_size", w.alias("weight"), (F.col("source_size").cast("double") * most).alias("cap"))
    by_cap = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").isNull(), "source")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = base.select(
        "*",
        (F.sum("source_size").over(whole).cast("double") * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).alias("left"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("weights_left"),
    )
    level = F.when(F.col("cap") * F.col("weights_left") > F.col("left") * F.col("weight"), F.col("left") / F.col("weights_left"))
    levelled = filled.select("*", F.max(level).over(whole).alias("level"))  # of the uncapped sources the first has the highest level
    return levelled.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: str = "mix-1:", weight: Column | None = None) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies.

    size counts words (null text: 0). copies is how often the mix repeats the document, taken
    = copies * size, at most `most` times the size. weight: a document's quality, above 0, null
    as LEAST (default: quality_weight). A null source is a source of its own, the
    last one. Every row is a document of its own, whatever its id; of rows alike in every
    column used here, how many are taken is fixed, not which. A source of empty
    texts has target 0 and takes nothing; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    q = quality_weight(text) if weight is None else F.greatest(F.coalesce(weight, F.lit(LEAST)), F.lit(1e-6))
    drawn = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), q.alias("quality"), F.xxhash64(text).alias("tie"))
    keyed = row_keys(stage(drawn, "drawn"), key="row")
    drawn = keyed.select("doc_id", "source", "size", "row", (-F.log(uniform(F.col("row"), seed)) / F.col("quality")).alias("key"))
    order = ["key", "row"]
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), drawn.count() // RANGE_ROWS)
    ranged = stage(drawn.repartitionByRange(parts, "source", *order).withColumn("range", F.spark_partition_id()), "ranged")
    ranges = stage(ranged.groupBy("source", "range").agg(F.sum("size").cast("long").alias("n")), "ranges")
    aims = stage(targets(ranges.groupBy("source").agg(F.sum("n").cast("long").alias("source_size")), weights, share, most), "targets")
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = ranges.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    offsets = offsets.join(aims.withColumnRenamed("source", "s2"), F.col("s").eqNullSafe(F.col("s2"))).drop("s2")
    inside = Window.partitionBy("source", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranged.select("doc_id", "source", "size", "range", F.coalesce(F.sum("size").over(inside), F.lit(0)).alias("inner"))
    rows = ranked.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.try_divide(F.col("target"), F.col("source_size").cast("double")))).otherwise(F.lit(0)).cast("long")
    rest = F.col("target") - epochs * F.col("source_size")
    middle = (F.col("offset") + F.col("inner")).cast("double") + F.col("size").cast("double") / 2
    copies = epochs + F.when((middle <= rest) & (rest > 0), F.lit(1)).otherwise(F.lit(0))
    return rows.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), copies.cast("int").alias("copies"))
