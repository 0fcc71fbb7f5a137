"""Near-dedup by b-bit MinHash: banding for candidates, packed low bits to estimate, full sets to confirm.

1. Each document's distinct word shingles are hashed to 64 bits; K minima are taken. Only the
   low B bits of each are kept, packed into four longs, and a key per band of R minima.
2. Documents with equal shingle sets (128-bit fingerprint and size) form one class; copies
   are never expanded into pairs.
3. In each band bucket every class is paired with the bucket's smallest class. Pairs whose
   collision-corrected estimate, from counting equal bits, is far below the threshold go.
4. The rest are confirmed on the full shingle sets, and components are formed.
5. What step 3 can't see: pairs of a bucket of which neither is the smallest class. Estimates
   of step 3 cluster the classes. In buckets that hold several clusters, the classes outside
   the largest one are estimated against all of the bucket; clusters that are near merge.
   Then, in clusters that hold several components, the classes outside the largest one are
   compared with all of the cluster on full sets. Both go in bounded blocks and give a
   spanning forest of what they find, never all pairs; groups that step 4 has linked, however
   large, aren't gone over.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veristrata.llm.blocks import deal, edges, forest, parts
from veristrata.llm.common import stage, text_batches, words
from veristrata.llm.components import components

K, B, R = 128, 2, 4
BANDS = K // R
#: Standard deviations below the threshold that an estimate may have and still be confirmed.
MARGIN = 4.0
#: Ids of documents in candidate pairs that are broadcast at most; beyond that they are joined by key.
BROADCAST_IDS = 500_000
_VOCABULARY = 200_000

_rng = np.random.default_rng(20240229)
_MUL = (_rng.integers(0, 2**32, K, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _rng.integers(0, 2**32, K, dtype=np.uint64).astype(np.uint32)
_ROLL = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _WordHash(dict):
    """64-bit hash of each word; bounded."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < _VOCABULARY:
            self[word] = h
        return h


_hash_of = _WordHash()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingles(text: str, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles.

    Fewer words than the width make one shingle of the whole sequence; no words, none.
    """
    ws = words(text)
    if not ws:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_hash_of.__getitem__, ws), np.uint64, len(ws))
    n = max(1, len(w) - width + 1)
    x = np.full(n, np.uint64(min(len(w), width)))
    for i in range(min(len(w), width)):
        x = x * _ROLL + w[i : i + n]
    return np.unique(_mix(x))


def minima(s: np.ndarray) -> np.ndarray:
    """K 32-bit minima of a non-empty set."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    low = np.full(K, np.uint32(2**32 - 1))
    for at in range(0, len(x), 2048):
        low = np.minimum(low, (x[at : at + 2048, None] * _MUL + _ADD).min(axis=0))
    return low


def pack_bits(m: np.ndarray) -> np.ndarray:
    """(n, K) minima -> (n, 4) longs that hold the low B bits of each."""
    low = (m & np.uint32(2**B - 1)).astype(np.uint64).reshape(len(m), 4, K // 4)
    return (low << (np.arange(K // 4, dtype=np.uint64) * np.uint64(B))).sum(axis=2, dtype=np.uint64).view(np.int64)


def band_keys(m: np.ndarray) -> np.ndarray:
    """(n, K) minima -> (n, BANDS) keys."""
    x = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX2 * np.ones((len(m), 1), np.uint64)
    for i in range(R):
        x = _mix(x * _ROLL + m[:, i::R][:, :BANDS].astype(np.uint64))
    return x.view(np.int64)


SIGNATURE = "id long, n long, f1 long, f2 long, s0 long, s1 long, s2 long, s3 long, bands array<long>"


def signatures(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = 5) -> DataFrame:
    """One row per document: set size, fingerprints, packed bits, band keys (none for empty sets)."""

    def run(batches):
        for part, texts in text_batches(batches, "text"):
            sets = [shingles(t, width) for t in texts]
            m = np.stack([minima(s) if len(s) else np.zeros(K, np.uint32) for s in sets])
            prints = np.array([(s.sum(dtype=np.uint64), _mix(s ^ _ROLL).sum(dtype=np.uint64)) for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
            bits, keys = pack_bits(m), band_keys(m)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(c) for c in prints.T), *(pa.array(c) for c in bits.T), pa.array([k if len(s) else [] for k, s in zip(keys, sets)], pa.list_(pa.int64()))],
                [x.split()[0] for x in SIGNATURE.split(", ")],
            )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SIGNATURE)


def estimate(a: str, b: str) -> Column:
    """Similarity from packed bits: share of equal b-bit values, corrected for chance collisions."""
    ones = F.lit(sum(1 << (B * i) for i in range(K // 4)))
    differ = F.lit(0)
    for i in range(4):
        x = F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))
        differ = differ + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(ones))
    same = F.lit(1.0) - differ / F.lit(float(K))
    chance = 1.0 / 2**B
    return (same - F.lit(chance)) / F.lit(1.0 - chance)


def _floor(percent: int) -> float:
    """The lowest estimate that is confirmed."""
    c, j = 1.0 / 2**B, percent / 100
    e = c + (1 - c) * j
    return j - MARGIN * (e * (1 - e) / K) ** 0.5 / (1 - c)


def _plausible(a: str, b: str, percent: int) -> Column:
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (estimate(a, b) >= F.lit(_floor(percent)))


def _sets(ids: DataFrame, docs: DataFrame, text_col: str, id_col: str, width: int) -> DataFrame:
    """(id, shingles) of the documents that ids names."""
    ids = stage(ids, "ids")

    def run(batches):
        for part, texts in text_batches(batches, "text"):
            found = [shingles(t, width).view(np.int64) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int64()))], ["id", "shingles"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")
    return texts.mapInArrow(run, "id long, shingles array<long>")


def confirm(pairs: DataFrame, docs: DataFrame, text_col: str, id_col: str, percent: int, width: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    sets = stage(_sets(ids, docs, text_col, id_col, width), "sets")
    a, b = (sets.select(F.col("id").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    union = F.size("sa") + F.size("sb") - both
    return pairs.select("a", "b").join(b, "b").join(a, "a").filter(both * 100 >= union * percent).select("a", "b")


def near_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", percent: int = 75, width: int = 5) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Null, empty and blank texts have no shingles and link with nothing. A null doc_id can't be
    a member of a group: its component is null and the row is kept. Rows that repeat a doc_id
    with other text share that id's component once per text; rows alike in id and text are one.
    An empty table gives an empty result; other columns of docs don't matter.
    """
    sig = stage(signatures(docs, text_col, id_col, width), "signatures")
    named = sig.filter("n > 0 AND id IS NOT NULL")
    one = ["s0", "s1", "s2", "s3", "bands"]
    cls = stage(named.groupBy("f1", "f2", "n").agg(F.min("id").alias("id"), *(F.any_value(c).alias(c) for c in one)), "classes")
    slim = cls.select("id", "n", *one[:4])
    keys = cls.select("id", F.explode("bands").alias("key"))
    heads = stage(keys.groupBy("key").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("m")).filter("m > 1"), "buckets")
    star = keys.join(heads.select("key", "head"), "key").filter("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    first = star.alias("p").join(slim.alias("y"), F.expr("p.b = y.id")).join(slim.alias("x"), F.expr("p.a = x.id"))
    tested = stage(first.filter(_plausible("x", "y", percent)).select("p.a", "p.b"), "pairs")
    links = stage(confirm(tested, docs, text_col, id_col, percent, width), "links")
    members = keys.join(heads.filter("m > 2").select("key"), "key")
    wider = stage(tested.select("a", "b").union(_across(members, slim, components(tested), percent)), "plausible")
    more = _exact(components(wider), components(links), docs, text_col, id_col, percent, width)
    labels = stage(components(stage(links.union(more), "links")), "labels")
    own = sig.alias("s").join(
        cls.select("f1", "f2", "n", "id").alias("c").join(labels.alias("l"), F.expr("c.id = l.node"), "left").select("f1", "f2", "n", F.coalesce("label", "id").alias("label")),
        ["f1", "f2", "n"],
        "left",
    )
    component = F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.coalesce("label", "id")).otherwise(F.col("id")))
    return own.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id").isNull() | (F.col("id") == component)).alias("kept"))


def _minority(rows: DataFrame) -> DataFrame:
    """Rows (g, id, label) of groups with several labels; minor: not of the group's commonest label."""
    rows = stage(rows, "marked")
    sizes = rows.groupBy("g", "label").agg(F.count(F.lit(1)).alias("m"))
    mixed = sizes.groupBy("g").agg(F.count(F.lit(1)).alias("labels"), F.max_by("label", F.struct("m", "label")).alias("main")).filter("labels > 1")
    return stage(rows.join(mixed.select("g", "main"), "g").select("g", "id", "label", (F.col("label") != F.col("main")).alias("minor")), "mixed")


def _across(members: DataFrame, slim: DataFrame, clusters: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that join clusters with plausible pairs in a common bucket."""
    named = members.join(clusters, F.col("id") == F.col("node"), "left").select(F.col("key").alias("g"), "id", F.coalesce("label", "id").alias("label"))
    rows = _minority(named).join(slim, "id")
    floor = _floor(percent)
    ones = np.uint64(sum(1 << (B * i) for i in range(K // 4)))

    def run(batches):
        for t, x, y in parts(batches):
            ids, label, n = (t.column(c).to_numpy() for c in ("id", "label", "n"))
            s = np.column_stack([t.column(f"s{i}").to_numpy() for i in range(4)]).view(np.uint64)
            differ = np.zeros((len(x), len(y)), np.int64)
            for i in range(4):
                z = s[x, i][:, None] ^ s[y, i][None, :]
                differ += np.bitwise_count((z | (z >> np.uint64(1))) & ones)
            e = (1 - differ / K - 1 / 2**B) / (1 - 1 / 2**B)
            a, b = n[x][:, None], n[y][None, :]
            i, j = np.nonzero((e >= floor) & (np.minimum(a, b) * 100 >= np.maximum(a, b) * percent) & (label[x][:, None] != label[y][None, :]))
            if len(i):
                yield from edges(forest(ids[x[i]], ids[y[j]]))

    return deal(rows.select("g", "id", "minor", "label", "n", "s0", "s1", "s2", "s3")).mapInArrow(run, "a long, b long")


def _exact(clusters: DataFrame, components_: DataFrame, docs: DataFrame, text_col: str, id_col: str, percent: int, width: int) -> DataFrame:
    """Links (a, b) between components of a cluster, from full sets."""
    named = clusters.select(F.col("label").alias("g"), F.col("node").alias("id")).join(components_.withColumnRenamed("label", "own"), F.col("id") == F.col("node"), "left")
    rows = _minority(named.select("g", "id", F.coalesce("own", "id").alias("label")))
    sets = _sets(rows.select("id").distinct(), docs, text_col, id_col, width)

    def run(batches):
        for t, x, y in parts(batches):
            ids, column = t.column("id").to_numpy(), t.column("shingles").combine_chunks()
            flat, ends = np.asarray(column.flatten()), np.asarray(column.value_lengths()).cumsum()
            starts, size = np.r_[0, ends[:-1]], np.diff(np.r_[0, ends])
            names, code = np.unique(flat, return_inverse=True)
            own = np.concatenate([code[starts[k] : ends[k]] for k in y])
            at = np.r_[0, size[y].cumsum()[:-1]]
            flag, left, right = np.zeros(len(names), np.int32), [], []
            for k in x:
                mine = code[starts[k] : ends[k]]
                flag[mine] = 1
                both = np.add.reduceat(flag[own], at)
                flag[mine] = 0
                near = y[(both * 100 >= (size[k] + size[y] - both) * percent) & (ids[y] != ids[k])]
                left.append(np.full(len(near), ids[k]))
                right.append(ids[near])
            a, b = np.concatenate(left), np.concatenate(right)
            if len(a):
                yield from edges(forest(a, b))

    return deal(rows.join(sets, "id").select("g", "id", "minor", "shingles")).mapInArrow(run, "a long, b long")
