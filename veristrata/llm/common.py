"""What the operators of this subpackage share: written tables and text slicing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word, as every contract here has it: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Where that setting is missing, a temporary folder is made and set if Spark runs in this
    process alone (local mode, as in tests); on a cluster it is an error, as executors would
    write to disks of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="veristrata-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/veristrata/{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_keys(docs: DataFrame, id_col: str = "doc_id", key: str = "_key") -> DataFrame:
    """docs with a long of its own for every row, in the order of the ids (null last).

    The key is the id itself where ids are whole. Where some are null or repeat, rows are
    numbered in the order of id and content, so that reruns agree; only rows alike in both may
    change places. That order is a range sort, which cuts a hot id by its rows' content.
    """
    own = F.col(id_col).cast("long")
    twice = docs.groupBy(own.alias("k")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR k IS NULL")
    if twice.isEmpty():
        return docs.withColumn(key, own)
    content = F.xxhash64(*[F.col(c) for c, t in docs.dtypes if not t.startswith("map")])
    ordered = docs.withColumns({"_id": own, "_content": content}).orderBy(F.asc_nulls_last("_id"), "_content").drop("_id", "_content")
    ordered = stage(ordered.withColumn("_at", F.monotonically_increasing_id()), "keyed")
    part = F.shiftright("_at", 33)
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    rows = ordered.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return rows.withColumn(key, F.col("_offset") + F.col("_at").bitwiseAND(F.lit(2**33 - 1))).select(*docs.columns, key)


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part's text column is about max_bytes at most (one row at least)."""
    n = batch.num_rows
    size = max(1, batch.column(batch.schema.get_field_index(column)).nbytes)
    step = max(1, int(n * max_bytes / size))
    for at in range(0, n, step):
        yield batch.slice(at, step)


def text_batches(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = 4 << 20):
    """(part, list of texts with null as the empty string) for each bounded part of each batch."""
    for batch in batches:
        for part in slices(batch, column, max_bytes):
            texts = part.column(part.schema.get_field_index(column)).to_pylist()
            yield part, ["" if t is None else t for t in texts]
    pa.default_memory_pool().release_unused()  # the worker lives on, other stages need the memory


def words(text: str) -> list[bytes]:
    """Words of a text with A-Z lower-cased; bytes.split() and bytes.lower() know ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split()
