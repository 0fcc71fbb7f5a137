"""Issues kept up to date from a stream: each micro-batch is merged into a versioned snapshot."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from veristrata.operators.issues import lifecycle


def maintain(stream: DataFrame, find: Callable[[DataFrame], DataFrame], state: Callable[[], DataFrame | None], save: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """find: batch -> issues with a fingerprint; state: the snapshot (fingerprint, active) or None; save: keeps the next one.

    save is called with the batch's number, so a batch that is run again replaces its own version.
    """

    def merge(batch: DataFrame, number: int) -> None:
        new, old = find(batch), state()
        base = batch.sparkSession.createDataFrame([], "fingerprint string, active boolean") if old is None else old
        save(lifecycle(base, new), number)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
