"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables, rerank by cosine.

1. ITQ learns rotations, from a bounded sample, that turn centred vectors into balanced binary
   codes with little quantisation loss. The bits are cut into words; each word is one Hamming
   table, so vectors meet if any word is equal. Words are as wide as the number of vectors
   asks for (BUCKET vectors a bucket), and there are as many tables as it takes for pairs at
   the threshold, made from the sample, to meet in RECALL of the cases. All vectors are indexed.
2. Buckets get ids and packed codes. Vectors stay if some other one of the bucket is near in
   Hamming distance over all bits.
3. These meet again with the original vectors, whose cosine in double precision decides.

A pair that meets in several tables counts in the first. A bucket emits each vector's number
of links and a spanning forest of them, never its pairs; buckets over BLOCK vectors are dealt
as pairs of blocks to many tasks. Equal vectors are one class.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veristrata.llm.blocks import forest, runs
from veristrata.llm.common import stage
from veristrata.llm.components import components

#: Vectors a bucket has on average, rows of a block at most (about), widest word.
BUCKET, BLOCK, WIDEST = 32, 1024, 48
#: Share of pairs at the threshold that have to meet, and tables at most before words get narrower.
RECALL, TABLES = 0.985, 64
#: Vectors the rotations are learned from at most; the index holds every vector.
SAMPLE = 16_384
#: Bits a rotation gives at most; rotations that are iterated in full (later ones start elsewhere and are iterated less).
BITS, FULL = 64, 4


@dataclass
class Tables:
    """mean (d), projection (d, tables * width); pairs with more than `most` differing bits aren't near."""

    mean: np.ndarray
    projection: np.ndarray
    width: int
    most: int

    @property
    def tables(self) -> int:
        return self.projection.shape[1] // self.width

    def bits(self, x: np.ndarray) -> np.ndarray:
        """(n, tables * width) code bits of unit vectors."""
        return (x - self.mean) @ self.projection >= 0

    def words(self, bits: np.ndarray) -> np.ndarray:
        """(n, tables) words of code bits."""
        return bits.reshape(len(bits), -1, self.width) @ (1 << np.arange(self.width, dtype=np.int64))

    def pack(self, bits: np.ndarray) -> np.ndarray:
        """(n, longs) packed code bits."""
        raw = np.packbits(bits, axis=1, bitorder="little")
        return np.pad(raw, ((0, 0), (0, -raw.shape[1] % 8))).view(np.int64)

    def unpack(self, codes: np.ndarray) -> np.ndarray:
        raw = np.ascontiguousarray(codes).view(np.uint8)
        return np.unpackbits(raw, axis=1, bitorder="little", count=self.projection.shape[1])


def _at_threshold(x: np.ndarray, least: float, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs at the threshold's cosine: from sampled vectors in random directions, and towards other sampled vectors."""
    if x.shape[1] < 2:
        return []
    a = x[rng.integers(0, len(x), 3000)]
    out = []
    for u in (rng.standard_normal(a.shape), x[rng.integers(0, len(x), len(a))] - a):
        u = u - (u * a).sum(axis=1)[:, None] * a
        size = np.sqrt((u * u).sum(axis=1))
        ok = size > 1e-9
        if ok.any():
            u = u[ok] / size[ok, None]
            out.append((a[ok], least * a[ok] + np.sqrt(1 - least * least) * u))
    return out


def learn(x: np.ndarray, n: int, least: float = 0.95, iterations: int = 30, seed: int = 7) -> Tables:
    """Tables for n vectors like the unit vectors x.

    A rotation alternates codes = sign(V R) and R = the rotation that brings V nearest to the codes.
    """
    d, rng = x.shape[1], np.random.default_rng(seed)
    if len(x) < 64:  # too few to learn from: any direction is as good
        x = rng.standard_normal((1024, d))
        x /= np.sqrt((x * x).sum(axis=1))[:, None]
    mean = x.mean(axis=0)
    v = x - mean
    b = min(BITS, d)
    axes = np.linalg.svd(v.T @ v)[0][:, :b]
    p, made = v @ axes, []
    pairs = _at_threshold(x, least, rng)
    near = [[] for _ in pairs]  # code bits that differ, per rotation

    def rotation():
        r = np.linalg.qr(rng.standard_normal((b, b)))[0]
        for _ in range(iterations if len(made) < FULL else 3):
            u, _, w = np.linalg.svd(np.where(p @ r >= 0, 1.0, -1.0).T @ p)
            r = (u @ w).T
        made.append(axes @ r)
        for k, (a, c) in enumerate(pairs):
            near[k].append(((a - mean) @ made[-1] >= 0) != ((c - mean) @ made[-1] >= 0))

    width = int(np.clip(np.ceil(np.log2(max(2, n) / BUCKET)), 6, WIDEST))
    while True:
        for tables in range(1, (TABLES if width > 1 else 1) + 1):
            while len(made) * b < tables * width:
                rotation()
            differ = [np.concatenate(k, axis=1)[:, : tables * width] for k in near]
            met = [(~f.reshape(len(f), tables, width).any(axis=2)).any(axis=1).mean() for f in differ]
            if all(m >= RECALL for m in met):
                break
        else:
            width = max(1, width - 2)
            continue
        most = max((int(np.quantile(f.sum(axis=1), 0.9999)) + 2 for f in differ), default=0)
        return Tables(mean, np.concatenate(made, axis=1)[:, : tables * width], width, most)


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; the largest component goes first, so that squares don't overflow."""
    v = v / np.abs(v).max(axis=1)[:, None]
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def _usable(vec: str):
    """Vectors without null or non-finite components that aren't zero."""
    bad = F.exists(vec, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(F.col(vec).isNotNull() & ~bad & F.exists(vec, lambda v: v != 0), F.lit(False))


def _column(t: pa.Table, name: str, kind) -> np.ndarray:
    """A list column as a matrix; all rows of a run have vectors of one length."""
    return np.array(t.column(name).combine_chunks().flatten(), dtype=kind).reshape(t.num_rows, -1)


_RUN = ("size", "tab", "word", "pair")


def _open_pairs(t: pa.Table, own: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) whose codes are near and that no earlier table joins, in both orders."""
    bits, side, table = own.unpack(_column(t, "codes", np.int64)), t.column("side").to_numpy(), int(t.column("tab")[0].as_py())
    sign = bits.astype(np.float32) * 2 - 1
    near = sign @ sign.T >= bits.shape[1] - 2 * own.most
    np.fill_diagonal(near, False)
    if side.any():
        near &= side[:, None] != side[None, :]
    i, j = np.nonzero(near)
    if table and len(i):
        w = own.words(bits)[:, :table]
        new = ~(w[i] == w[j]).any(axis=1)
        i, j = i[new], j[new]
    return i, j


def _plausible(shared):
    def run(batches):
        for t in runs(batches, _RUN):
            if t.num_rows < 2:
                continue
            i, _ = _open_pairs(t, shared.value[int(t.column("size")[0].as_py())])
            if len(i):
                out = t.select([*_RUN, "side", "cid"]).take(np.unique(i)).combine_chunks()
                yield from out.to_batches()

    return run


def _links(shared, least: float):
    def run(batches):
        for t in runs(batches, _RUN):
            if t.num_rows < 2:
                continue
            i, j = _open_pairs(t, shared.value[int(t.column("size")[0].as_py())])
            if not len(i):
                continue
            v = unit(_column(t, "vec", np.float64))
            hit = (v @ v.T)[i, j] >= least
            i, j = i[hit], j[hit]
            if not len(i):
                continue
            cid, copies = t.column("cid").to_numpy(), t.column("copies").to_numpy()
            count = np.bincount(i, weights=copies[j], minlength=len(cid)).astype(np.int64)
            peer = dict(forest(cid[i], cid[j]))
            rows = [(int(cid[k]), int(count[k]), peer.get(int(cid[k]), int(cid[k]))) for k in np.flatnonzero(count)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["cid", "links", "peer"])

    return run


def near_vectors(vectors: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id", least: float = 0.95, sample: int = SAMPLE) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Links have cosine >= least in double precision; vectors link only with those of their own
    length. Null vectors, zero vectors and those with null or non-finite components link with
    nothing: their component is their vec_id and they are kept. Every row is a vector of its
    own: rows that repeat a vec_id or a vector, and rows without a vec_id, link like others.
    component_id is the smallest vec_id of the component, null if none of its rows has one;
    kept is whether vec_id equals it, nulls taken as equal. An empty table gives an empty
    result; other columns don't matter. One model is learned per length, so lengths should be few.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = stage(rows.select(F.monotonically_increasing_id().alias("row"), "id", "vec", _usable("vec").alias("ok")), "vectors")
    good = rows.filter("ok")
    cls = stage(good.groupBy("vec").agg(F.min("row").alias("cid"), F.min("id").alias("low"), F.count(F.lit(1)).alias("copies")), "classes")
    sizes = dict(tuple(r) for r in cls.groupBy(F.size("vec")).agg(F.count(F.lit(1))).collect())
    if not sizes:
        return rows.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    taken = cls.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(sample).toArrow().column("vec").to_pylist()
    seen: dict[int, list] = {}
    for v in taken:
        seen.setdefault(len(v), []).append(v)
    models = {d: learn(unit(np.array(seen[d])) if d in seen else np.zeros((0, d)), n, least) for d, n in sizes.items()}
    shared = spark.sparkContext.broadcast(models)

    def encode(batches):
        lists = lambda a: pa.array(list(a), pa.list_(pa.int64()))
        for batch in batches:
            length = np.asarray(batch.column(batch.schema.get_field_index("vec")).value_lengths())
            for d in np.unique(length):
                part, own = batch.filter(pa.array(length == d)), shared.value[int(d)]
                bits = own.bits(unit(_column(pa.Table.from_batches([part]), "vec", np.float64)))
                yield pa.RecordBatch.from_arrays([*part.columns, lists(own.pack(bits)), lists(own.words(bits))], [*part.schema.names, "codes", "words"])

    coded = stage(cls.select("cid", "copies", "vec").mapInArrow(encode, "cid long, copies long, vec array<double>, codes array<long>, words array<long>"), "codes")
    places = coded.select("cid", "codes", F.size("vec").cast("long").alias("size"), F.posexplode("words").alias("tab", "word")).withColumn("tab", F.col("tab").cast("long"))
    key = ["size", "tab", "word"]
    counts = places.groupBy(*key).agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    placed = places.join(counts.select(*key, F.ceil(F.col("m") / BLOCK).cast("long").alias("n")), key).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("n")))
    # block pair (i, j), i <= j: a row of block b goes to every pair that has b
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("o")
    dealt = placed.select("cid", "codes", *key, "block", other)
    pair = F.shiftleft(F.least("block", "o"), 31).bitwiseOR(F.greatest("block", "o"))
    dealt = dealt.select(*key, pair.alias("pair"), F.when(F.col("block") > F.col("o"), 1).otherwise(0).alias("side"), "cid", "codes")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = lambda df: df.repartition(parts, *_RUN).sortWithinPartitions(*_RUN)
    open_rows = stage(ordered(dealt).mapInArrow(_plausible(shared), "size long, tab long, word long, pair long, side int, cid long"), "plausible")
    full = open_rows.join(coded.select("cid", "copies", "vec", "codes"), "cid")
    met = stage(ordered(full).mapInArrow(_links(shared, least), "cid long, links long, peer long"), "links")
    links = met.groupBy("cid").agg(F.sum("links").cast("long").alias("links"))
    labels = stage(components(met.select(F.col("cid").alias("a"), F.col("peer").alias("b"))), "labels")
    own = cls.join(links, "cid", "left").join(labels, F.col("cid") == F.col("node"), "left")
    own = own.select("vec", "low", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("label", "cid").alias("label"))
    lowest = own.groupBy("label").agg(F.min("low").alias("component_id"))
    found = own.join(lowest, "label").select("vec", "n_links", "component_id")
    linked = good.join(found, "vec").select("id", "n_links", "component_id")
    alone = rows.filter("NOT ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
