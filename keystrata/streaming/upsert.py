"""Streaming upserts: each micro-batch becomes one run, once.

The stream's checkpoint is the write-ahead log, and its commits are batches whose
number the table's manifest holds.  A batch that is replayed after a failure finds
its number there and does nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from keystrata.sources.tables import Database


def start(db: Database, table: str, changes: DataFrame, order: list[str], checkpoint: str, deleted: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Upsert a stream of rows into ``table``; rows where ``deleted`` holds are deletes.

    ``order`` ranks the versions of a key inside a batch; a later batch is newer.
    ``trigger`` as of writeStream.trigger, by default all there is, then stop.
    """

    def apply(batch: DataFrame, number: int) -> None:
        db.refresh()
        if deleted:
            db.write_log(table, batch, order, deleted, (checkpoint, number))
        else:
            db.insert(table, batch, order, (checkpoint, number))

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
