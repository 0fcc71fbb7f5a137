"""Merkle manifest of a dataset with an authentication path per row, by fractal traversal.

Rows are leaves. Leaves of a group (here: a source) make a ternary tree, the groups' subroots
make another one above. Leaves are ranked in their group by one range sort; 3**LEVELS
leaves that are aligned in the tree make a block. A task goes through the leaves of a block
once and gives each its path to the block's root: of every stacked subtree of the block it
keeps the existing one, which holds the current path's siblings, and the desired one, the next
at that height, which grows by one leaf a step and takes over as the existing one is left.
Blocks' roots are the leaves of the same work again, until each group is one node; their
paths are appended to those below by a join. No task holds more than one block, no group
meets in one task, and nothing but Spark's own metadata passes the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veristrata.llm.blocks import runs
from veristrata.llm.common import stage

#: Nodes that have one parent, levels of a subtree, levels of a block.
ARITY, SUBTREE, LEVELS = 3, 2, 6
STEPS = "array<struct<l:string,r:string>>"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def depth(n: int) -> int:
    """Levels above n leaves until one node remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


class Subtree:
    """Nodes of the levels low to high - 1 beneath the node `at` of level high, filled leaf by leaf."""

    def __init__(self, low: int, high: int, at: int):
        self.low, self.high, self.at, self.root = low, high, at, None
        self.nodes: list[list[str]] = [[] for _ in range(high - low)]
        self.open: list[list[str]] = [[] for _ in range(high)]  # the run that isn't full yet, per level

    def feed(self, node: str, level: int = 0) -> None:
        while level < self.high:
            if level >= self.low:
                self.nodes[level - self.low].append(node)
            run = self.open[level]
            run.append(node)
            if len(run) < ARITY:
                return
            self.open[level], node, level = [], digest(*run), level + 1
        self.root = node

    def finish(self) -> None:
        """Closes the runs that the leaves didn't fill."""
        for level in range(self.high):
            if run := self.open[level]:
                self.open[level] = []
                self.feed(digest(*run), level + 1)

    def siblings(self, level: int, index: int) -> tuple[str, str]:
        """What stands left and right of a node in its run, concatenated."""
        own = self.nodes[level - self.low]
        index -= self.at * ARITY ** (self.high - level)
        start = index - index % ARITY
        return "".join(own[start:index]), "".join(own[index + 1 : start + ARITY])


def traverse(leaves: list[str], levels: int) -> Iterator[list[tuple[str, str]]]:
    """The path of each leaf in turn, `levels` levels up, from the leaf: (left, right) siblings.

    Per stacked subtree two are held; what is desired at a height gets as many leaves as its
    predecessor there has steps, one a step.
    """
    spans = [(low, min(low + SUBTREE, levels)) for low in range(0, levels, SUBTREE)]
    held = []  # of each span: existing, desired
    for low, high in spans:
        existing = Subtree(low, high, 0)
        for leaf in leaves[: ARITY**high]:
            existing.feed(leaf)
        existing.finish()
        held.append([existing, Subtree(low, high, 1)])
    for j in range(len(leaves)):
        path = []
        for (low, high), (existing, _) in zip(spans, held):
            path += [existing.siblings(t, j // ARITY**t) for t in range(low, high)]
        yield path
        for k, (low, high) in enumerate(spans):
            size, (_, desired) = ARITY**high, held[k]
            ahead = (j // size + 1) * size + j % size
            if ahead < len(leaves):
                desired.feed(leaves[ahead])
            if (j + 1) % size == 0:
                desired.finish()
                held[k] = [desired, Subtree(low, high, (j + 1) // size + 1)]


def _paths(levels: int):
    """Rows ordered by (gid, block, pos) with their paths in blocks of that many levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [pa.field("l", pa.string()), pa.field("r", pa.string())]
        for t in runs(batches, ("gid", "block")):
            n = t.column("n")[0].as_py()
            left, right, ends = [], [], [0]
            for path in traverse(t.column("leaf").to_pylist(), min(levels, depth(n))):
                left += [x for x, _ in path]
                right += [x for _, x in path]
                ends.append(len(left))
            steps = pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], fields=fields)
            t = t.drop_columns(["block"]).combine_chunks().append_column("steps", pa.ListArray.from_arrays(pa.array(ends, pa.int32()), steps))
            yield from t.to_batches()

    return run


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(steps, leaf, lambda h, s: F.sha2(F.concat(s["l"], h, s["r"]), 256))


def ranked(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """rows with gid (a number of the group's own), pos (rank in the group from 0), n (the group's size).

    Groups follow each other in one range sort, which cuts large ones; what is joined back has one row for
    each group of each partition.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.asc_nulls_last(c) for c in (group, *order)]
    at = stage(rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    at = at.withColumn("_part", F.shiftright("_at", 33))
    sizes = at.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(group, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("n"), F.min("_first").over(whole).alias("gid"))
    return at.join(sizes, [group, "_part"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def _block(levels: int) -> Column:
    return F.expr(f"pos div {ARITY**levels}")


def _block_paths(nodes: DataFrame, levels: int) -> DataFrame:
    """nodes (gid, pos, n, leaf and others) with steps, each leaf's path in its block."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = nodes.withColumn("block", _block(levels)).repartition(parts, "gid", "block").sortWithinPartitions("gid", "block", "pos")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields)
    return stage(dealt.mapInArrow(_paths(levels), f"{schema}, steps {STEPS}"), "paths")


def paths(nodes: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """nodes (gid, pos, n, leaf, ...) with steps, the path in their block, and (gid, pos, subroot, steps) of their blocks up to the group's root."""
    at, size = _block_paths(nodes, levels), ARITY**levels
    lower, made = at, []
    while True:
        roots = lower.filter(f"pos % {size} = 0").select("gid", _block(levels).alias("pos"), F.expr(f"(n + {size - 1}) div {size}").alias("n"), fold(F.col("leaf"), F.col("steps")).alias("leaf"))
        lower = _block_paths(roots, levels)
        made.append(lower)
        if lower.filter("n > 1").isEmpty():
            break
    above = lower.select("gid", "pos", F.col("leaf").alias("subroot"), "steps")
    for level in reversed(made[:-1]):
        up = above.select("gid", F.col("pos").alias("_block"), F.col("subroot"), F.col("steps").alias("_up"))
        above = level.withColumn("_block", _block(levels)).join(up, ["gid", "_block"]).select("gid", "pos", "subroot", F.concat("steps", "_up").alias("steps"))
    return at, above


def _field(c: Column) -> Column:
    """- for null, else the UTF-8 byte count, a colon, and the value."""
    s = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(*fields: Column) -> Column:
    return F.sha2(F.concat(*map(_field, fields)), 256)


def manifest(rows: DataFrame, group: Column, order: Column, leaf_now: Column, leaf_then: Column, levels: int = LEVELS, **keep: Column) -> DataFrame:
    """One row per row of rows: leaf, subroot, root, proof_sha256, folded_root, verified, and the columns to keep.

    The tree is made of leaf_now; leaf_then is what is folded up with its path. Groups stand
    in the order of group, null first and by bytes; leaves in that of order, null last, then of
    the leaf, so that repeated rows are leaves of their own in a fixed order. Leaves that are alike
    in both may change places, which changes no digest but can swap their paths.
    """
    own = rows.select(F.coalesce(F.concat(F.lit("1"), group.cast("string")), F.lit("0")).alias("g"), order.alias("o"), leaf_now.alias("leaf"), leaf_then.alias("then"), *[c.alias(f"k_{k}") for k, c in keep.items()])
    own = own.withColumn("then", F.when(F.col("then") != F.col("leaf"), F.col("then")))
    at = ranked(own, "g", "o", "leaf").drop("o")
    names = at.groupBy("gid").agg(F.any_value("g").alias("g"))
    at, blocks = paths(at.drop("g"), levels)
    subroots = blocks.filter("pos = 0").select("gid", "subroot").join(names, "gid").select(F.lit("").alias("all"), "g", F.col("gid").alias("own"), F.col("subroot").alias("leaf"))
    tops, above = paths(ranked(subroots, "all", "g").select("gid", "pos", "n", "leaf", "own"), levels)
    above = above.select(F.col("pos").alias("_block"), F.col("subroot").alias("root"), F.col("steps").alias("_up"))
    tops = tops.withColumn("_block", _block(levels)).join(above, "_block").select(F.col("own").alias("gid"), F.concat("steps", "_up").alias("_top"), "root")
    blocks = blocks.join(tops, "gid").select("gid", F.col("pos").alias("_block"), "subroot", "root", F.concat("steps", "_top").alias("_up"))
    out = at.withColumn("_block", _block(levels)).join(blocks, ["gid", "_block"])
    out = out.select(*[F.col(f"k_{k}").alias(k) for k in keep], "leaf", "then", "subroot", "root", F.concat("steps", "_up").alias("path"))
    text = F.array_join(F.transform("path", lambda s: F.concat(s["l"], s["r"])), "")
    # an untouched leaf's fold is done like any other: it is what verifies the path
    out = out.select(*keep, "leaf", "subroot", "root", F.sha2(text, 256).alias("proof_sha256"), fold(F.coalesce("then", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def document_manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of documents.

    Rows whose crc32 of the decimal doc_id is even are checked with a text that has lost its
    \\n characters: they fail where that changes the text. A null doc_id, source, lang, n_chars
    or text is a value of its own, unlike the empty one; rows without a doc_id stand last in their
    source and aren't tampered with. Texts of any length are hashed whole. Repeated rows are
    leaves of their own. Columns beyond the five don't matter; an empty table gives an empty result.
    """
    doc_id = F.col("doc_id").cast("long")
    tampered = F.when(F.crc32(doc_id.cast("string")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    head = [doc_id, F.col("source"), F.col("lang"), F.col("n_chars").cast("long")]
    rows = docs.select("doc_id", "source", "lang", "n_chars", "text")
    return manifest(rows, F.col("source"), doc_id, leaf(*head, F.col("text")), leaf(*head, tampered), levels, doc_id=doc_id)
