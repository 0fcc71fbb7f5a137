"""Best-fit packing of token pieces into sequences under several capacities at once.

A sequence has three residual capacities: tokens, documents and attention cost (the sum of
squared piece lengths). Pieces come longest first; of the open sequences that can take a piece
under every constraint, the one is chosen whose residual vector, in shares of the capacities,
has the smallest weighted norm after taking it ("norm"), or the largest weighted dot product
with the piece's demand ("dot").

Shards of the pieces are packed apart. Pieces are dealt to shards by a hash of their place in
the table, so repeated rows don't meet in one, each shard has the same mix of lengths and ends with few sequences that aren't full; a shard's number of
pieces, and so a task's memory, is bounded by a parameter.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veristrata.llm.common import stage, text_batches
from veristrata.llm.encoding import default_tokenizer, encoder

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(length: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be shorter than limit."""
    first = length if length <= limit else length % limit
    at = [0, *range(first, length, limit)] if first else list(range(0, length, limit))
    return [(a, b - a) for a, b in zip(at, [*at[1:], length])]


def pieces(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", limit: int = 2048, tokenizer: str | None = None, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Encode whole texts, close each with end_id, cut those over limit.

    Null text is the empty text: one piece, the end alone. with_ids adds the ids themselves.
    """
    path, end = tokenizer or default_tokenizer(), struct.pack("<I", end_id)

    def run(batches):
        enc = encoder(path)
        for part, texts in text_batches(batches, "text"):
            doc, out = part.column(0).to_pylist(), []
            for d, raw in zip(doc, enc.ids(texts)):
                raw += end
                for k, (a, n) in enumerate(cut(len(raw) // 4, limit)):
                    own = raw[4 * a : 4 * (a + n)]
                    out.append((d, k, a, n, zlib.crc32(own)) + ((np.frombuffer(own, "<u4").astype("i4"),) if with_ids else ()))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names[: 5 + with_ids])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, PIECE + (", ids array<int>" if with_ids else ""))


def best_fit(lengths: np.ndarray, capacity: tuple[float, float, float], weights: tuple[float, float, float] = (1.0, 0.05, 0.05), rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece; lengths may be in any order, ties go in their order."""
    cap, w = np.asarray(capacity, float), np.asarray(weights, float)
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    left, name = np.empty((1024, 3)), np.empty(1024, np.int64)
    used = made = 0
    least = float(lengths.min()) if len(lengths) else 0.0
    for i in order:
        n = float(lengths[i])
        need = np.array([n, 1.0, n * n])
        if (need > cap).any():
            raise ValueError(f"a piece of {n:.0f} tokens doesn't fit an empty sequence of capacities {capacity}")
        pick = -1
        if used:
            own = left[:used]
            fits = np.flatnonzero((own[:, 0] >= n) & (own[:, 1] >= 1.0) & (own[:, 2] >= n * n))
            if len(fits):
                if rule == "norm":
                    score = -((((own[fits] - need) / cap) ** 2) @ w)
                else:
                    score = (own[fits] / cap) @ (w * need / cap)
                pick = int(fits[int(np.argmax(score))])
        if pick < 0:
            if used == len(left):
                left, name = np.concatenate([left, np.empty_like(left)]), np.concatenate([name, np.empty_like(name)])
            pick, used = used, used + 1
            left[pick], name[pick] = cap, made
            made += 1
        where[i], offset[i] = name[pick], int(cap[0] - left[pick, 0])
        left[pick] -= need
        if left[pick, 0] < least or left[pick, 1] < 1 or left[pick, 2] < least * least:  # nothing more fits: close it
            used -= 1
            left[pick], name[pick] = left[used], name[used]
    return where, offset


def pack(parts: DataFrame, limit: int = 2048, max_documents: int | None = None, max_attention: int | None = None, rule: str = "norm", pieces_per_shard: int = 20_000) -> DataFrame:
    """Add sequence_id and offset to pieces (from a written table, as they are read twice).

    max_documents (default: limit) and max_attention (default: limit squared, which a full
    sequence can't exceed) bound each sequence besides its tokens. Offsets have no gaps.
    """
    caps = (limit, limit if max_documents is None else max_documents, limit * limit if max_attention is None else max_attention)
    shards = max(1, -(-parts.count() // pieces_per_shard))
    fields = parts.columns

    def run(key, table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        where, offset = best_fit(table.column("length").to_numpy(), caps, rule=rule)
        own = where + (key[0].as_py() << 40)
        return pa.table([*(table.column(c) for c in fields), pa.array(own), pa.array(offset)], names=[*fields, "sequence_id", "offset"])

    schema = ", ".join(f"`{n}` {t}" for n, t in parts.dtypes) + ", sequence_id long, offset long"
    dealt = parts.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("long"))
    return dealt.groupBy("shard").applyInArrow(lambda key, table: run(key, table.drop_columns(["shard"])), schema)


def pack_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", limit: int = 2048, tokenizer: str | None = None, **limits) -> DataFrame:
    """Encode, cut and pack all documents; one row per piece.

    Null doc_ids and repeated rows are packed like any other; of pieces alike in length the
    smaller doc_id, then piece, comes first; other columns don't matter. An empty table gives no rows.
    """
    return pack(stage(pieces(docs, text_col, id_col, limit, tokenizer), "pieces"), limit, **limits)
