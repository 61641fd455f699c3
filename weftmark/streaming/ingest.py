"""The same ingest over a stream of documents: each micro-batch is one batch of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftmark.plans.engine import Engine


def ingest_stream(engine: Engine, documents: DataFrame, checkpoint: str, order: str = "doc_pos", state: str | None = None, **trigger) -> StreamingQuery:
    """Start a query that feeds a streaming frame (doc_id, text and ``order``) to the engine.

    Within a micro-batch documents go in ``order``. A batch that was already taken is skipped, so a replay after a
    failure changes nothing. With ``state`` the graph is written there after every batch, with the batch's number, so
    that ``resume`` can go on from it.
    """

    def take(batch: DataFrame, batch_id: int) -> None:
        if batch_id <= engine.last_batch:
            return
        rows = batch.select(F.col(order).cast("long").alias("doc_pos"), "doc_id", "text")
        if rows.take(1):
            engine.ingest_frame(rows)
        engine.last_batch = batch_id
        if state:
            engine.save_tables(f"{state}/batch={batch_id}")

    return documents.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def resume(spark, state: str, batch_id: int) -> Engine:
    """The engine as it was after a batch."""
    engine = Engine.load_tables(spark, f"{state}/batch={batch_id}")
    engine.last_batch = batch_id
    return engine
