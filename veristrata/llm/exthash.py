"""Exact dedup by an extendible-hash index on shared files.

Every distinct text has one entry in the index. A text's 64-bit key names its owner by its
leading bits; an owner's directory leads from the bits below to a bucket. A bucket over
capacity is split, and the directory doubles when the bucket was as deep as the directory.
Entries of one key are chained and told apart by comparing bytes; a chain may outgrow its
bucket, as no bit can split it. Directory and buckets of all owners are files (Parquet) in the
shared folder: insert() reads them, adds texts and writes the next version; lookup() finds
texts through them.

Copies are pre-aggregated by bytes on the map side, so a text that a third of all rows hold
reaches its owner as one row a batch, with the documents' ids left behind. An owner task keeps
one owner's texts in memory; the number of owners follows the bytes (OWNER_BYTES each).
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veristrata.llm.common import slices, stage

#: White space that doesn't count when texts are compared.
BLANKS = b" \t\n\x0b\x0c\r"
#: Entries of a bucket before it is split.
CAPACITY = 256
#: Bytes of text an owner holds, about; a single longer text is held whole.
OWNER_BYTES = 16 << 20
_NO_ID = 2**63 - 1  # stands for a null doc_id in comparisons: any other id comes before it

DIRECTORY, ENTRY, ADDRESS, ARRIVAL = range(4)
#: kind DIRECTORY: bucket, depth. ENTRY: a text of a bucket. ADDRESS: the entry of an arrival (null: none).
RECORD = [
    ("kind", pa.int32()), ("bits", pa.int32()), ("owner", pa.int64()), ("bucket", pa.int64()), ("depth", pa.int32()), ("entry", pa.int64()), ("at", pa.int64()),
    ("key", pa.int64()), ("text_sha256", pa.string()), ("keep_chars", pa.int64()), ("keep_id", pa.int64()), ("copies", pa.int64()), ("text", pa.binary()),
]
_SQL = {pa.int32(): "int", pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
_SCHEMA = ", ".join(f"{n} {_SQL[t]}" for n, t in RECORD)


class Bucket:
    """Entries whose keys agree in `depth` bits: key -> chain of entries."""

    def __init__(self, depth: int):
        self.depth, self.size, self.chains = depth, 0, {}

    def add(self, key: int, entry: list) -> None:
        self.chains.setdefault(key, []).append(entry)
        self.size += 1


class Directory:
    """Extendible hashing over the key bits below an owner's: slots[i] is the bucket of the keys whose next `depth` bits are i."""

    def __init__(self, skip: int, capacity: int):
        self.skip, self.capacity, self.depth = skip, capacity, 0
        self.slots = [Bucket(0)]

    @classmethod
    def restore(cls, skip: int, capacity: int, buckets: list[tuple[int, int]]) -> Directory:
        """A stored directory from the (number, depth) of its buckets."""
        own = cls(skip, capacity)
        own.depth = max(d for _, d in buckets)
        own.slots = [None] * (1 << own.depth)
        for number, depth in buckets:
            span, made = 1 << (own.depth - depth), Bucket(depth)
            own.slots[number * span : (number + 1) * span] = [made] * span
        if None in own.slots or len(own.slots) != 1 << own.depth:
            raise ValueError("a stored directory lacks buckets")
        return own

    def _bits(self, key: int, n: int) -> int:
        return ((key << self.skip) & (2**64 - 1)) >> (64 - n) if n else 0

    def bucket(self, key: int) -> Bucket:
        return self.slots[self._bits(key, self.depth)]

    def find(self, key: int, text: bytes) -> list | None:
        """The entry with these bytes."""
        for entry in self.bucket(key).chains.get(key, ()):
            if entry[-1] == text:
                return entry
        return None

    def add(self, key: int, entry: list) -> None:
        while True:
            own = self.bucket(key)
            if own.size < self.capacity or own.chains.keys() <= {key} or self.skip + own.depth >= 64:
                own.add(key, entry)
                return
            self._split(own, self._bits(key, self.depth))

    def _split(self, own: Bucket, at: int) -> None:
        if own.depth == self.depth:
            self.slots = [b for b in self.slots for _ in (0, 1)]
            self.depth += 1
            at *= 2
        halves = Bucket(own.depth + 1), Bucket(own.depth + 1)
        for key, chain in own.chains.items():
            for entry in chain:
                halves[self._bits(key, own.depth + 1) & 1].add(key, entry)
        span = 1 << (self.depth - own.depth)
        first = at - at % span
        for i in range(span):
            self.slots[first + i] = halves[i >= span // 2]

    def buckets(self):
        """(number, bucket), each bucket once."""
        i = 0
        while i < len(self.slots):
            own = self.slots[i]
            yield i >> (self.depth - own.depth), own
            i += 1 << (self.depth - own.depth)


def _better(a: tuple, b: tuple) -> tuple:
    """Of two (code points, doc_id) the one that stays."""
    return a if (-a[0], a[1]) <= (-b[0], b[1]) else b


def _signed(key: int) -> int:
    return key - 2**64 if key >= 2**63 else key


def arrivals(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Each batch's distinct normalised texts: at (its number), key, text, keep_chars, keep_id, copies, bytes, ids of its documents."""

    def run(batches):
        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, "text", 16 << 20):
                found: dict[bytes, list] = {}
                for doc, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    raw = raw or b""
                    text, mine = raw.translate(None, BLANKS), (len(raw.decode()), _NO_ID if doc is None else doc)
                    if (f := found.get(text)) is None:
                        found[text] = [mine, [doc]]
                    else:
                        f[0] = _better(f[0], mine)
                        f[1].append(doc)
                texts, own = list(found), list(found.values())
                cols = [range(at, at + len(own)), [_signed(xxhash.xxh3_64_intdigest(t)) for t in texts], texts, [f[0][0] for f in own], [f[0][1] for f in own], [len(f[1]) for f in own], [len(t) for t in texts], [f[1] for f in own]]
                types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["at", "key", "text", "keep_chars", "keep_id", "copies", "bytes", "ids"])
                at += len(own)

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return stage(own.mapInArrow(run, "at long, key long, text binary, keep_chars long, keep_id long, copies long, bytes long, ids array<long>"), "arrivals")


def _owner(bits: int, capacity: int, write: bool):
    """The owner task. Rows come ordered by owner and kind: its directory, its entries, what arrives."""

    def pack(rows: list[tuple]):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), RECORD)], [n for n, _ in RECORD])

    def closed(owner: int, directory: Directory):
        for number, b in directory.buckets():
            yield DIRECTORY, bits, owner, number, b.depth, None, None, None, None, None, None, None, None
            for key, chain in b.chains.items():
                for entry, sha, best, copies, text in chain:
                    yield ENTRY, bits, owner, number, None, entry, None, _signed(key), sha, best[0], best[1], copies, text

    def flush(owner: int, directory: Directory):
        rows, size = [], 0
        for r in closed(owner, directory) if write else ():
            rows.append(r)
            size += len(r[-1] or b"") + 64
            if size > 16 << 20:
                yield pack(rows)
                rows, size = [], 0
        if rows:
            yield pack(rows)

    def run(batches):
        owner, directory, stored, made = None, None, [], 0
        names = ["owner", "kind", "bucket", "depth", "entry", "at", "key", "text_sha256", "keep_chars", "keep_id", "copies", "text"]
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                out = []
                for own, kind, bucket, depth, entry, at, key, sha, chars, doc, copies, text in zip(*(part.column(part.schema.get_field_index(n)).to_pylist() for n in names)):
                    if own != owner:
                        if owner is not None:
                            yield from flush(owner, directory or Directory(bits, capacity))
                        owner, directory, stored, made = own, None, [], 0
                    if kind == DIRECTORY:
                        stored.append((bucket, depth))
                        continue
                    if directory is None:
                        directory = Directory.restore(bits, capacity, stored) if stored else Directory(bits, capacity)
                    key %= 2**64
                    if kind == ENTRY:
                        if stored:
                            directory.bucket(key).add(key, [entry, sha, (chars, doc), copies, text])
                            made = max(made, entry + 1)
                        else:  # the owners' ranges have changed since it was stored
                            directory.add(key, [made, sha, (chars, doc), copies, text])
                            made += 1
                        continue
                    record = directory.find(key, text)
                    if write and record is None:
                        record, made = [made, hashlib.sha256(text).hexdigest(), (chars, doc), copies, text], made + 1
                        directory.add(key, record)
                    elif write:
                        record[2], record[3] = _better(record[2], (chars, doc)), record[3] + copies
                    out.append((ADDRESS, bits, owner, None, None, record and record[0], at, None, None, None, None, None, None))
                if out:
                    yield pack(out)
        if owner is not None:
            yield from flush(owner, directory or Directory(bits, capacity))

    return run


def _through(index: DataFrame | None, arrived: DataFrame, bits: int, capacity: int, write: bool) -> DataFrame:
    """Send the index's files and the arrivals to their owners."""
    owner = lambda: F.shiftrightunsigned("key", 64 - bits).alias("owner")
    null = lambda n, t: F.lit(None).cast(t).alias(n)
    rest = ["key", "text_sha256", "keep_chars", "keep_id", "copies", "text"]
    rows = arrived.select(owner(), F.lit(ARRIVAL).alias("kind"), null("bucket", "long"), null("depth", "int"), null("entry", "long"), "at", "key", null("text_sha256", "string"), *rest[2:])
    if index is not None:
        same = index.filter(f"bits = {bits} AND kind = {DIRECTORY}").select("owner", "kind", "bucket", "depth", "entry", "at", *rest)
        kept = index.filter(f"kind = {ENTRY}").select(owner(), "kind", "bucket", "depth", F.when(F.col("bits") == bits, F.col("entry")).alias("entry"), "at", *rest)
        rows = rows.union(same).union(kept)
    parts = max(int(arrived.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(1 << bits, 1 << 20))
    dealt = rows.repartitionById(parts, F.pmod("owner", F.lit(parts)).cast("int")).sortWithinPartitions("owner", "kind")
    return stage(dealt.mapInArrow(_owner(bits, capacity, write), _SCHEMA), "index" if write else "addresses")


def _bits(spark, size: int) -> int:
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(parts - 1, size // OWNER_BYTES, 1).bit_length()


def insert(arrived: DataFrame, index: DataFrame | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The next version of the index (none: an empty one) with the arrivals' texts, and the arrivals' addresses in it.

    Owners' ranges are halved, and their directories built anew, once the index has outgrown them.
    """
    size = arrived.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    bits = _bits(arrived.sparkSession, size)
    if index is not None:
        index = index.filter(f"kind <> {ADDRESS}")
        old = index.agg(F.max("bits"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
        if old[0] is not None:
            bits = old[0] if old[1] + size <= 4 * OWNER_BYTES << old[0] else max(old[0], _bits(arrived.sparkSession, size + old[1]))
    return _through(index, arrived, bits, capacity, True)


def lookup(arrived: DataFrame, index: DataFrame) -> DataFrame:
    """at, keep_id, group_size, text_sha256 of the arrivals whose texts the index holds."""
    bits = index.filter(f"kind = {ENTRY}").agg(F.max("bits")).first()[0]
    found = _through(index, arrived, bits or 1, CAPACITY, False)
    return _found(found, index)


def _found(addresses: DataFrame, index: DataFrame) -> DataFrame:
    entries = index.filter(f"kind = {ENTRY}").select("owner", "entry", "keep_id", F.col("copies").alias("group_size"), "text_sha256")
    return addresses.filter(f"kind = {ADDRESS} AND entry IS NOT NULL").select("owner", "entry", "at").join(entries, ["owner", "entry"]).drop("owner", "entry")


def build_index(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", index: DataFrame | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The index of all texts of docs, added to those of an index that is there already."""
    return insert(arrivals(docs, text_col, id_col), index, capacity)


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", index: DataFrame | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting every blank (space, \\t, \\n, \\v, \\f, \\r).
    The row with the most code points in its original text stays, then the smallest doc_id.
    Null and blank texts are all equal to the empty one. A null doc_id comes after all others
    and is kept only if its group has no other; rows that repeat the kept doc_id all count
    as kept; an empty table gives an empty result. Other columns of docs don't matter.

    With an index, docs are looked up in it and not added; a document whose text isn't in it
    has no row.
    """
    arrived = arrivals(docs, text_col, id_col)
    if index is None:
        made = insert(arrived, None, capacity)
        found = _found(made, made)
    else:
        found = lookup(arrived, index)
    keep = F.when(F.col("keep_id") != _NO_ID, F.col("keep_id"))
    rows = arrived.select("at", "ids").join(found, "at").select(F.explode("ids").alias("doc_id"), keep.alias("keep_id"), "group_size", "text_sha256")
    return rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
