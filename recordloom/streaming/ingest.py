"""Continuous ingest: a stream of rows into a store, a part per micro-batch."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import resolve
from ..operators.content import Carve
from ..sources.store import Store


def into(store: Store, stream: DataFrame, checkpoint: str, order: str = "ts", every: str = "5 seconds", carve: Carve = Carve(), once: bool = False) -> StreamingQuery:
    """Starts writing a stream of (id, body, optional attrs and tomb, ``order``).
    Within a batch the last of an id by ``order`` stands; between batches the later
    batch does. The commit that publishes a batch also names it, so after a restart
    at any moment a batch is there once."""
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def write(batch: DataFrame, number: int) -> None:
        if dict(store.commit.streams).get(name, -1) >= number:
            return
        if not batch.isEmpty():
            # rows that can't stand go before any is sorted: a batch may be a whole backlog
            last = resolve.newest(resolve.candidates(batch, "id", order), "id", order)
            store.ingest(last.drop(order), carve, mark=(name, number))

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
