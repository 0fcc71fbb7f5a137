"""Hard-negative mining by ball-tree branch-and-bound, exact.

Rows are range-sorted by label and norm and cut into tiles of a bounded size; each tile is put
in the order of a balanced ball tree once, and written. Anchors are dealt into blocks, tiles into
chunks; a task takes a block and the tiles of a chunk, one after another. The balls of a tile bound
the inner product of an anchor with any row in them from above and from below: a node goes
if it can't reach the score window, is beyond it, has no row of a label that counts, or lies strictly
beneath the current k-th score, which is carried from tile to tile. What each task has
found is merged by anchor. Two such passes give the positives and then, in the windows that
their scores set, the negatives. Anchors are the stated query set; each block of them meets
each tile once, and nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veristrata.llm.blocks import runs
from veristrata.llm.common import row_keys, stage

#: Rows of a leaf at most; components that a tile and a block of anchors hold at most (about).
LEAF, TILE, BLOCK = 64, 1 << 20, 1 << 21
#: Groups that labels are dealt into, so that anchors of a label share blocks.
GROUPS = 64
_NONE, _LEAST = np.iinfo(np.int64).max, np.iinfo(np.int64).min
_FOUND = "anchor long, slot int, score long, row long"


def intervals(n: int) -> list[np.ndarray]:
    """Edges of the nodes of each level of a tree over n rows, from the root to leaves of LEAF rows at most; node i has the children 2 i and 2 i + 1."""
    levels = [np.array([0, n])]
    while np.diff(levels[-1]).max() > LEAF:
        e = levels[-1]
        levels.append(np.insert(e, np.arange(1, len(e)), (e[:-1] + e[1:]) // 2))
    return levels


def grow(x: np.ndarray) -> np.ndarray:
    """The rows' order in a balanced ball tree: each node is halved along the line through two rows far apart."""
    order = np.arange(len(x))
    for level in intervals(len(x))[:-1]:
        for lo, hi in zip(level[:-1], level[1:]):
            own = x[order[lo:hi]]
            a = own[((own - own.mean(axis=0)) ** 2).sum(axis=1).argmax()]
            b = own[((own - a) ** 2).sum(axis=1).argmax()]
            order[lo:hi] = order[lo:hi][np.argpartition(own @ (b - a), (lo + hi) // 2 - lo)]
    return order


def matrix(column, d: int) -> np.ndarray:
    """A list column of d integers a row."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.array(column.flatten(), dtype=np.int64).reshape(len(column), d)


def products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, exact; one that no long holds counts as the nearest long."""
    top = [float(np.abs(v.astype(float)).max(initial=0)) for v in (a, x)]
    if a.shape[1] * top[0] * top[1] < 2**53:
        return (a.astype(float) @ x.astype(float).T).astype(np.int64)
    return np.clip((a.astype(object) @ x.astype(object).T), _LEAST, _NONE).astype(np.int64)


class Search:
    """The best k rows of each query: a query is an anchor and a score window, with rows of the same label or of others."""

    def __init__(self, vec: np.ndarray, key: np.ndarray, label: np.ndarray, owner: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool):
        self.vec, self.key, self.label, self.owner, self.low, self.high, self.k, self.same = vec, key, label, owner, low, high, k, same
        self.real = vec.astype(float)
        self.norm = np.sqrt((self.real**2).sum(axis=1))
        self.score = np.full((len(owner), k), _LEAST)
        self.row = np.full((len(owner), k), _NONE)
        self.compared = 0

    def _able(self, q: np.ndarray, upper, lower, least, most) -> np.ndarray:
        """(queries, nodes) that may hold a row for the query."""
        own = self.label[self.owner[q], None]
        fits = (least <= own) & (own <= most) if self.same else (least != own) | (most != own)
        need = np.maximum(self.low[q], self.score[q, -1]).astype(float)
        return fits & (upper >= need[:, None]) & (lower <= self.high[q].astype(float)[:, None])

    def visit(self, vec: np.ndarray, key: np.ndarray, label: np.ndarray) -> None:
        """Goes through a tile, whose rows come in the order of its tree, level by level."""
        x, queries = vec.astype(float), np.arange(len(self.owner))
        alive = None
        for edges in intervals(len(x)):
            at, size = edges[:-1], np.diff(edges)
            center = np.add.reduceat(x, at, axis=0) / size[:, None] if x.shape[1] else np.zeros((len(at), 0))
            away = x - np.repeat(center, size, axis=0)
            radius = np.sqrt(np.maximum.reduceat((away**2).sum(axis=1), at))
            mid = self.real @ center.T
            reach = self.norm[:, None] * radius
            slack = 1e-9 * (reach + self.norm[:, None] * np.sqrt((center**2).sum(axis=1))) + 1e-6
            upper, lower = mid + reach + slack, mid - reach - slack
            least, most = np.minimum.reduceat(label, at), np.maximum.reduceat(label, at)
            able = self._able(queries, upper[self.owner], lower[self.owner], least, most)
            alive = able if alive is None else np.repeat(alive, 2, axis=1) & able
            if not alive.any():
                return
        best = np.where(alive, upper[self.owner], -np.inf).max(axis=0)
        for leaf in np.argsort(-best):
            q = np.flatnonzero(alive[:, leaf])
            if len(q):
                one = slice(leaf, leaf + 1)
                q = q[self._able(q, upper[self.owner[q], one], lower[self.owner[q], one], least[one], most[one])[:, 0]]  # the k-th may have risen
            if len(q):
                rows = slice(edges[leaf], edges[leaf + 1])
                self._compare(q, vec[rows], key[rows], label[rows])

    def _compare(self, q: np.ndarray, vec: np.ndarray, key: np.ndarray, label: np.ndarray) -> None:
        owner, back = np.unique(self.owner[q], return_inverse=True)
        score = products(self.vec[owner], vec)[back]
        self.compared += len(owner) * len(vec)
        alike = self.label[self.owner[q], None] == label
        ok = (alike if self.same else ~alike) & (self.key[self.owner[q], None] != key) & (score >= self.low[q, None]) & (score <= self.high[q, None])
        last, last_row = self.score[q, -1:], self.row[q, -1:]
        ok &= (score > last) | (score == last) & (key < last_row)
        hit = ok.any(axis=1)
        if not hit.any():
            return
        q, ok = q[hit], ok[hit]
        score = np.concatenate([self.score[q], np.where(ok, score[hit], _LEAST)], axis=1)
        row = np.concatenate([self.row[q], np.where(ok, key, _NONE)], axis=1)
        first = np.lexsort((row, ~score), axis=-1)[:, : self.k]  # ~ turns the order round without overflow
        self.score[q], self.row[q] = np.take_along_axis(score, first, axis=1), np.take_along_axis(row, first, axis=1)


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by (d, ...) as tiles in the order of their trees, with tile and pos."""
    base, made = TaskContext.get().partitionId() << 32, 0
    held: list[pa.RecordBatch] = []

    def tiles():
        nonlocal made
        t = pa.Table.from_batches(held)
        d = t.column("d")[0].as_py()
        step = max(LEAF, TILE // max(d, 1))
        for at in range(0, t.num_rows, step):
            part = t.slice(at, step)
            part = part.take(grow(matrix(part.column("vec"), d).astype(float)))
            n = part.num_rows
            part = part.append_column("tile", pa.array(np.full(n, base + made))).append_column("pos", pa.array(np.arange(n, dtype=np.int32)))
            made += 1
            yield from part.combine_chunks().to_batches()

    for batch in batches:
        length = batch.column(batch.schema.get_field_index("d")).to_numpy()
        edges = np.r_[0, np.flatnonzero(np.diff(length)) + 1, len(length)]
        for a, b in zip(edges[:-1], edges[1:]):
            if held and (held[0].column("d")[0].as_py() != length[a] or sum(h.num_rows for h in held) * max(int(length[a]), 1) >= TILE):
                yield from tiles()
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield from tiles()


def _found(s: Search) -> Iterator[pa.RecordBatch]:
    q, place = np.nonzero(s.row != _NONE)
    if len(q):
        slot = np.arange(len(s.owner)) - np.searchsorted(s.owner, s.owner)  # owners rise
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (s.key[s.owner[q]], slot[q].astype(np.int32), s.score[q, place], s.row[q, place])], ["anchor", "slot", "score", "row"])


def _search(k: int, same: bool):
    """Rows ordered by (block, chunk, kind, d, tile, pos): the anchors of a block (kind 0), then its tiles (kind 1)."""

    def run(batches):
        cell, searches = None, {}
        for t in runs(batches, ("block", "chunk", "kind", "d", "tile")):
            own = (t.column("block")[0].as_py(), t.column("chunk")[0].as_py())
            if own != cell:
                for s in searches.values():
                    yield from _found(s)
                cell, searches = own, {}
            d = t.column("d")[0].as_py()
            vec, key, label = matrix(t.column("vec"), d), t.column("key").to_numpy(), t.column("label").to_numpy()
            if t.column("kind")[0].as_py():
                if d in searches:
                    searches[d].visit(vec, key, label)
            else:
                low, high = (t.column(c).combine_chunks() for c in ("low", "high"))
                owner = np.repeat(np.arange(len(key)), np.asarray(low.value_lengths()))
                searches[d] = Search(vec, key, label, owner, low.flatten().to_numpy(zero_copy_only=False), high.flatten().to_numpy(zero_copy_only=False), k, same)
        for s in searches.values():
            yield from _found(s)

    return run


def _shares(anchors: DataFrame) -> tuple[list[int], list[int]]:
    """The first block and the number of blocks of each group of labels; groups that are small share one."""
    sizes = dict(tuple(r) for r in anchors.groupBy("grp").agg(F.sum(F.col("d") + 1)).collect())  # GROUPS rows at most
    first, count, at, room = [0] * GROUPS, [0] * GROUPS, 0, BLOCK
    for g, n in sorted(sizes.items()):
        if n > room and room < BLOCK:
            at, room = at + 1, BLOCK
        first[g], count[g] = at, -(-n // BLOCK)
        room = room - n if n <= room else 0
        if not room:
            at, room = at + count[g], BLOCK
    return first, count


def _best(tiles: DataFrame, anchors: DataFrame, shares: tuple[list[int], list[int]], n_tiles: int, k: int, same: bool) -> DataFrame:
    """(anchor, slot, score, row, rank) of the best k rows of each anchor (key, label, vec, d, block, low, high) and slot of its windows."""
    parts = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first, count = (F.array(*map(F.lit, s)) for s in shares)
    blocks = max(a + b for a, b in zip(*shares))
    chunks = max(1, min(n_tiles, -(-2 * parts // max(1, blocks))))
    start, n = F.get(first, "grp"), F.get(count, "grp")
    met = F.when(n > 0, F.sequence(start, start + n - 1)) if same else F.sequence(F.lit(0), F.lit(max(blocks - 1, 0)))
    none = F.lit(None).cast("array<long>")
    rows = tiles.select(F.explode(met).alias("block"), F.pmod(F.xxhash64("tile"), F.lit(chunks)).cast("int").alias("chunk"), F.lit(1).alias("kind"), "d", "tile", "pos", "key", "label", "vec", none.alias("low"), none.alias("high"))
    every = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk")
    asked = anchors.select("block", every, F.lit(0).alias("kind"), "d", F.lit(0).cast("long").alias("tile"), F.lit(0).alias("pos"), "key", "label", "vec", "low", "high")
    dealt = rows.unionByName(asked).repartition(parts, "block", "chunk").sortWithinPartitions("block", "chunk", "kind", "d", "tile", "pos")
    found = dealt.mapInArrow(_search(k, same), _FOUND)
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "row")  # k rows a chunk at most
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _share(p: str, percent: int, up: bool) -> Column:
    """percent % of a long, rounded up or down, without overflow."""
    whole, rest = F.expr(f"{p} div 100"), F.expr(f"{p} % 100")
    return whole * percent + (F.ceil if up else F.floor)(rest * percent / 100).cast("long")


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90)) -> DataFrame:
    """rows (vec_id, label, vec: array<long>) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchor says which rows are anchors. Scores are inner products; higher ones come first, ties by vec_id, null ones last. An
    anchor's positives are the first `positives` other rows of its label; for each, the first `negatives` rows
    of other labels whose score is within window (percent of the positive's score) are returned.

    Every row is a row of its own: those that repeat a vec_id are ranked one after another,
    in the order of their content. Vectors meet those of their own length, the empty one included. A score that
    no long holds counts as the nearest long. An empty table, or one without anchors, gives an empty result.
    """
    plain = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("vec").cast("array<long>").alias("vec"), F.coalesce(anchor, F.lit(False)).alias("asks"))
    own = row_keys(stage(plain, "vectors"), "vec_id", "key")
    renamed = not own.filter("NOT (key <=> vec_id)").isEmpty()
    ids = own.select("key", "vec_id")
    size = F.size("vec")
    norm = F.aggregate("vec", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    own = own.select("key", "label", "vec", "asks", size.alias("d"), norm.alias("norm"), F.pmod(F.xxhash64("label"), F.lit(GROUPS)).cast("int").alias("grp"))
    parts = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_tiles = max(parts, -(-(own.agg(F.sum(F.col("d") + 1)).first()[0] or 0) // TILE))
    by = ["d", "label", F.desc("norm"), "key"]
    ordered = own.select("d", "label", "norm", "key", "grp", "vec").repartitionByRange(n_tiles, *by).sortWithinPartitions(*by)
    tiles = stage(ordered.drop("norm").mapInArrow(_trees, "d int, label long, key long, grp int, vec array<long>, tile long, pos int"), "tiles")
    asked = own.filter("asks")
    shares = _shares(asked)
    first, count = (F.array(*map(F.lit, s)) for s in shares)
    asked = stage(asked.select("key", "label", "vec", "d", (F.get(first, "grp") + F.pmod(F.xxhash64("key"), F.get(count, "grp"))).cast("int").alias("block")), "anchors")
    whole = asked.withColumns({"low": F.array(F.lit(_LEAST)), "high": F.array(F.lit(_NONE))})
    p = _best(tiles, whole, shares, n_tiles, positives, True)
    p = stage(p.select("anchor", F.col("row").alias("positive"), F.col("score").alias("p"), "rank").withColumns({"low": _share("p", window[0], True), "high": _share("p", window[1], False)}).filter("low <= high"), "positives")
    slots = F.array_sort(F.collect_list(F.struct("rank", "low", "high")))  # `positives` entries at most
    windows = p.groupBy(F.col("anchor").alias("key")).agg(slots.alias("s")).select("key", F.col("s.low").alias("low"), F.col("s.high").alias("high"))
    n = _best(tiles, asked.join(windows, "key"), shares, n_tiles, negatives, False)
    slotted = p.withColumn("slot", F.row_number().over(Window.partitionBy("anchor").orderBy("rank")) - 1)
    out = n.select("anchor", "slot", F.col("row").alias("negative"), F.col("score").alias("n"), "rank").join(slotted.drop("rank", "low", "high"), ["anchor", "slot"])
    for c in ("anchor", "positive", "negative"):
        out = out.join(ids.select(F.col("key").alias(c), F.col("vec_id").alias(f"{c}_id")), c) if renamed else out.withColumn(f"{c}_id", F.col(c))
    return out.select("anchor_id", "positive_id", "rank", "negative_id", F.col("p").alias("positive_score"), F.col("n").alias("negative_score"))


def embeddings_negatives(vectors: DataFrame, every: int = 100, moved: int = 7, labels: int = 10, scale: int = 256) -> DataFrame:
    """hard_negatives() of a table of embeddings (vec_id, embedding, label), whose components become floor(scale * x).

    Rows with a null label, a null vector, or a null or non-finite component take no part. Labels of rows whose
    vec_id is divisible by `moved` move on by one of `labels`; anchors are rows whose vec_id is divisible by `every`.
    Rows without a vec_id are no anchors and keep their label. Components beyond a long count as
    the nearest long. Other columns don't matter.
    """
    bad = F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vec"))
    rows = rows.filter(F.col("label").isNotNull() & F.col("vec").isNotNull() & ~bad)
    rows = rows.withColumn("label", F.when(F.col("vec_id") % moved == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")))
    rows = rows.withColumn("vec", F.transform("vec", lambda x: F.floor(x * scale).cast("long")))
    return hard_negatives(rows, F.col("vec_id") % every == 0)
