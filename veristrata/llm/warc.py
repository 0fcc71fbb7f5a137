"""WARC archives: segmented writing, and reassembly of continuation records when reading.

Every file is written by Spark's own writer and read by its binary reader, so any file system
that Spark knows will do. Records are text (headers, chunked framing at character borders,
UTF-8 payload), one a row of the writer, whose line separator closes the record.
A file holds a bounded number of records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.llm.common import shared_dir, slices, stage

#: Fixed names of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Revisits that are broadcast at most when pages are written; more are joined by key.
BROADCAST_ROWS = 200_000

RECORD = "record_id string, type string, origin string, segment int, total long, page_id long, url string, digest string, refers_to string, block binary"
PAGE = "record_id string, page_id long, url string, record_type string, refers_to string, digest string, payload binary, intact boolean"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id} {digest}'.encode()).digest())}>"


def border(data: bytes, at: int) -> int:
    """The last border of a UTF-8 character at or before at (after it, if none is above 0)."""
    at = min(at, len(data))
    low = at
    while 0 < low < len(data) and data[low] & 0xC0 == 0x80:
        low -= 1
    if low:
        return low
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def split_utf8(data: bytes, size: int) -> list[bytes]:
    """Parts of about size bytes, cut at character borders; an empty input is one empty part."""
    out, at = [], 0
    while at < len(data):
        end = at + max(1, border(data[at : at + size + 4], size))
        out.append(data[at:end])
        at = end
    return out or [b""]


def chunked(payload: bytes, size: int) -> bytes:
    """HTTP chunked transfer framing."""
    return b"".join(b"%x\r\n%s\r\n" % (len(c), c) for c in split_utf8(payload, size) if c) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """Undo chunked framing; ValueError if it is broken or has no last chunk."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        part = body[end + 2 : end + 2 + n]
        if len(part) != n or body[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("broken chunk")
        out.append(part)
        at = end + 4 + n


def _clean(value: str) -> str:
    """A header value: control characters would end the header."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def _record(kind: str, own: str, block: bytes, headers: dict[str, str | None]) -> bytes:
    lines = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: {own}", f"WARC-Date: {DATE}"]
    lines += [f"{k}: {_clean(v)}" for k, v in headers.items() if v is not None]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_records(page_id: int | None, url: str | None, payload: bytes, response_page: int | None, revisit: bool, segment_bytes: int, chunk_bytes: int) -> list[bytes]:
    """The records of one page: a revisit, a response, or a response and its continuations."""
    digest = payload_digest(payload)
    own = record_id(page_id, digest)
    about = {"WARC-Target-URI": url, "Page-Id": None if page_id is None else str(page_id), "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http; msgtype=response"}
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if revisit:
        return [_record("revisit", own, head, about | {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(response_page, digest)})]
    block = head + chunked(payload, chunk_bytes)
    parts = split_utf8(block, segment_bytes)
    if len(parts) == 1:
        return [_record("response", own, block, about)]
    out = [_record("response", own, parts[0], about | {"WARC-Segment-Number": "1"})]
    for k, part in enumerate(parts[1:], 2):
        more = {"WARC-Segment-Origin-ID": own, "WARC-Segment-Number": str(k), "WARC-Segment-Total-Length": str(len(block)) if k == len(parts) else None}
        out.append(_record("continuation", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{own}{k}')}>", part, more))
    return out


def records(data: bytes):
    """(headers in lower case, block) of each record of an uncompressed archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        n = int(fields["content-length"])
        block = data[end + 4 : end + 4 + n]
        if len(block) != n or data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is cut short")
        yield fields, block
        at = end + 8 + n


def write_archives(pages: DataFrame, path: str, html_col: str = "html", id_col: str = "page_id", url_col: str = "url", least: int = 0, segment_bytes: int = 32_768, chunk_bytes: int = 8_192, records_per_file: int = 1000) -> None:
    """Write a record per page. Of equal payloads of `least` bytes or more the page with the
    largest page_id is the response and the others are revisits.

    Null html is the empty payload. A null page_id is never the largest; it is a response only
    if its payload has no other page. Rows alike in page_id and html are written each.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("hash"))
    marks = rows.filter(F.octet_length("html") >= least).select("page_id", "hash")
    groups = marks.groupBy("hash").agg(F.max("page_id").alias("response_page"), F.min("page_id").alias("low"), F.count_if(F.col("page_id").isNull()).alias("nulls"))
    shared = stage(groups.filter("response_page IS NOT NULL AND (low < response_page OR nulls > 0)").select("hash", "response_page"), "shared")
    side = F.broadcast(shared) if shared.count() <= BROADCAST_ROWS else shared
    found = rows.join(side, "hash", "left").select("page_id", "url", "html", "response_page", (F.col("response_page").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_page")) & (F.octet_length("html") >= least)).alias("revisit"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "html", 8 << 20):
                out = []
                for page, url, text, target, revisit in zip(*(part.column(i).to_pylist() for i in range(5))):
                    out += page_records(page, url, text.encode(), target, revisit, segment_bytes, chunk_bytes)
                yield pa.RecordBatch.from_arrays([pa.array([r[:-1].decode() for r in out], pa.string())], ["value"])  # the writer adds the last \n

    found.mapInArrow(run, "value string").write.option("compression", "gzip").option("lineSep", "\n").option("maxRecordsPerFile", records_per_file).text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of all archives under path, segments not joined yet."""

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                raw = data.as_buffer().to_pybytes()
                out, size = [], 0
                for h, block in records(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw):
                    page = h.get("page-id")
                    out.append((h["warc-record-id"], h["warc-type"], h.get("warc-segment-origin-id"), int(h["warc-segment-number"]) if "warc-segment-number" in h else None, int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None, None if page is None else int(page), h.get("warc-target-uri"), h.get("warc-payload-digest", "").removeprefix("sha1:") or None, h.get("warc-refers-to"), block))
                    size += len(block)
                    if size > 8 << 20:
                        yield _table(out, RECORD)
                        out, size = [], 0
                if out:
                    yield _table(out, RECORD)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(zip(*rows), fields)], [n for n, _ in fields])


def assemble(segments: list[tuple[int, int | None, bytes]]) -> bytes | None:
    """The block of (number, total length or None, part) segments; None if any is missing.

    Repeats of a segment must be equal. Numbers must run from 1 and the lengths add up to the
    total that the last one states.
    """
    by = {}
    for number, total, part in segments:
        if by.setdefault(number, (total, part)) != (total, part):
            return None
    if sorted(by) != list(range(1, len(by) + 1)):
        return None
    block = b"".join(by[k][1] for k in sorted(by))
    return block if by[len(by)][0] == len(block) else None


def _payload(block: bytes | None, digest: str | None) -> tuple[bytes | None, bool]:
    if block is None:
        return None, False
    head, _, body = block.partition(b"\r\n\r\n")
    try:
        payload = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    except ValueError:
        return None, False
    return payload, digest is None or payload_digest(payload) == digest


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per page record: payload decoded, segments reassembled, digest checked.

    Only segmented records are shuffled, each to its origin's group (a group is one record).
    A record whose segments are incomplete or whose framing is broken has a null payload and
    intact = false. Revisits have no payload of their own and are intact.
    """
    every = stage(read_records(spark, path), "records")
    whole = every.filter("segment IS NULL").select("record_id", "page_id", "url", "type", "refers_to", "digest", F.array(F.struct(F.lit(1).alias("segment"), F.octet_length("block").cast("long").alias("total"), "block")).alias("parts"))
    seg = F.struct("segment", "total", "block")
    first = F.struct("page_id", "url", "type", "refers_to", "digest")
    joined = every.filter("segment IS NOT NULL").groupBy(F.coalesce("origin", "record_id").alias("record_id")).agg(F.any_value(F.when(F.col("origin").isNull(), first), True).alias("h"), F.collect_list(seg).alias("parts"), F.count_if(F.col("segment") == 1).alias("copies"))
    joined = joined.filter("h IS NOT NULL").select("record_id", "h.*", "parts", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("col")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "parts", 8 << 20):
                out = []
                for own, page, url, kind, refers, digest, parts in zip(*(part.column(i).to_pylist() for i in range(7))):
                    block = assemble([(p["segment"], p["total"], p["block"]) for p in parts])
                    payload, good = (None, True) if kind == "revisit" else _payload(block, digest)
                    out.append((own, page, url, kind, refers, digest, payload, good))
                yield _table(out, PAGE)

    return whole.unionByName(joined).filter("type IN ('response', 'revisit')").mapInArrow(run, PAGE)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write pages to new archives, read them back, resolve revisits; one row per page row.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to (a page_id), intact.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc"
    write_archives(pages, path, **options)
    found = stage(read_archives(spark, path).select("record_id", "page_id", "record_type", "refers_to", F.col("digest").alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"), "intact"), "pages")
    targets = found.filter("record_type = 'response'").groupBy(F.col("record_id").alias("target")).agg(F.any_value("page_id").alias("target_page"), F.any_value("payload_bytes").alias("target_bytes"))
    both = found.join(targets, F.col("refers_to") == F.col("target"), "left")
    return both.select("page_id", F.coalesce("payload_bytes", "target_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.when(F.col("record_type") == "revisit", F.col("target_page")).alias("refers_to"), (F.col("intact") & ((F.col("record_type") == "response") | F.col("target").isNotNull())).alias("intact"))
