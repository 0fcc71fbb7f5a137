"""Comparing a group's minority with the whole group in bounded blocks of many tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of each side of a block at most, about.
BLOCK = 512


def deal(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (g, id, minor, ...) -> the same with side and part, ordered by (g, part) within partitions.

    Of each group g, every block of minor rows (side 0) meets every block of all its rows
    (side 1) in one part. Groups of at most `block` rows are one part.
    """
    sizes = rows.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("n_all"), F.ceil(F.count_if("minor") / block).cast("long").alias("n_minor"))
    at = rows.join(sizes.filter("n_minor > 0"), "g")
    own = F.pmod(F.xxhash64("id"), F.col("n_all")), F.pmod(F.xxhash64("id"), F.col("n_minor"))
    as_all = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_minor") - 1), lambda k: F.struct(F.shiftleft(k, 32).bitwiseOR(own[0]).alias("part"), F.lit(1).alias("side")))
    as_minor = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_all") - 1), lambda k: F.struct(F.shiftleft(own[1], 32).bitwiseOR(k).alias("part"), F.lit(0).alias("side")))
    dealt = at.withColumn("_p", F.explode(F.when(F.col("minor"), F.concat(as_all, as_minor)).otherwise(as_all)))
    dealt = dealt.select(*rows.columns, "_p.part", "_p.side")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "g", "part").sortWithinPartitions("g", "part")


def runs(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[pa.Table]:
    """The table of each run of rows that agree in some integer columns; rows come ordered by them."""
    held: list[pa.RecordBatch] = []

    def keys(t):
        return [t.column(t.schema.get_field_index(c)).to_numpy() for c in columns]

    def cut():
        t = pa.Table.from_batches(held)
        edges = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys(t)], axis=0)) + 1
        for a, b in zip(np.r_[0, edges], np.r_[edges, t.num_rows]):
            yield t.slice(a, b - a)

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = keys(batch)
        other = np.flatnonzero(np.any([k != k[-1] for k in own], axis=0))
        start = int(other[-1]) + 1 if len(other) else 0  # the last run may go on in the next batch
        if held and not start and [k[0] for k in own] != last:
            yield from cut()
            held = []
        if start:
            held.append(batch.slice(0, start))
            yield from cut()
            held = []
        held.append(batch.slice(start))
        last = [k[-1] for k in own]
    if held:
        yield from cut()


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """(table, positions of side 0, positions of side 1) of each part that has both sides."""
    for t in runs(batches, ("g", "part")):
        side = t.column("side").to_numpy()
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if len(x) and len(y):
            yield t, x, y


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (node, smallest node it is connected with) that join the same nodes as edges a-b do."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            return [(int(n), int(nodes[k])) for n, k in zip(nodes, label) if nodes[k] != n]
        label = low


def edges(found: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])
