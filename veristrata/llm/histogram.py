"""Exact length histogram: one row per encoded length, suffix sums answer every context limit."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veristrata.llm.common import stage, text_batches
from veristrata.llm.encoding import default_tokenizer, encoder


def length_histogram(docs: DataFrame, text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(length, n_docs) over all documents; null and empty texts have length 0.

    Each batch is counted before anything is shuffled. An empty table has no rows.
    """
    path = tokenizer or default_tokenizer()

    def count(batches):
        enc, found = encoder(path), Counter()
        for _, texts in text_batches(batches, text_col):
            found.update(len(x) // 4 for x in enc.ids(texts))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["length", "n"])

    counts = docs.select(F.col(text_col)).mapInArrow(count, "length long, n long")
    return counts.groupBy("length").agg(F.sum("n").cast("long").alias("n_docs"))


def context_table(histogram: DataFrame) -> DataFrame:
    """For each length that occurs, taken as a context limit, exact totals by prefix and suffix sums.

    docs_over: documents longer than the limit; tokens_over: their tokens; tokens_truncated:
    tokens that stay when every document is cut at the limit; share_within: the exact
    quantile rank of the limit. Between two lengths a limit c keeps
    tokens_truncated + (c - length) * docs_over of the row below it.
    The window has no partitions: the histogram has a row per length, not per document.
    """
    h = stage(histogram, "histogram")
    below, above = Window.orderBy("length"), Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    tokens = F.col("length") * F.col("n_docs")
    out = h.select(
        "length",
        "n_docs",
        F.sum("n_docs").over(below).alias("docs_within"),
        F.sum(tokens).over(below).alias("tokens_within"),
        F.coalesce(F.sum("n_docs").over(above), F.lit(0)).alias("docs_over"),
        F.coalesce(F.sum(tokens).over(above), F.lit(0)).alias("tokens_over"),
    )
    return out.select(
        "*",
        (F.col("tokens_within") + F.col("length") * F.col("docs_over")).alias("tokens_truncated"),
        (F.col("docs_within").cast("double") / (F.col("docs_within") + F.col("docs_over"))).alias("share_within"),
    )


def at_limits(table: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, tokens_truncated, docs_over) for any context limits, from context_table's rows."""
    wanted = table.sparkSession.createDataFrame([(int(c),) for c in limits], "limit long")
    rows = F.broadcast(wanted).join(table, F.col("length") <= F.col("limit"), "left")
    last = rows.groupBy("limit").agg(F.max_by(F.struct("length", "tokens_truncated", "docs_over"), "length").alias("r"))
    total = table.agg(F.max(F.col("docs_within") + F.col("docs_over")).alias("all_docs"))
    return last.join(F.broadcast(total)).select(
        "limit",
        F.coalesce(F.col("r.tokens_truncated") + (F.col("limit") - F.col("r.length")) * F.col("r.docs_over"), F.col("limit") * F.col("all_docs"), F.lit(0)).alias("tokens_truncated"),
        F.coalesce(F.col("r.docs_over"), F.col("all_docs"), F.lit(0)).alias("docs_over"),
    )


def quantile(table: DataFrame, q: float) -> DataFrame:
    """The smallest length with at least a share q of the documents within it."""
    return table.filter(F.col("share_within") >= q).agg(F.min("length").alias("length"))
