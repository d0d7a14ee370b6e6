"""Documents that arrive in a folder go into the index batch by batch."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from keyfacet.plans.engine import Engine

DOCS = "doc_id long, text string"


def ingest_stream(spark: SparkSession, engine: Engine, folder: str, checkpoint: str, once: bool = True, files_per_batch: int = 100) -> StreamingQuery:
    """Follow Parquet files in ``folder``; each micro-batch is one ingest.

    A batch that is replayed after a failure adds no second copy: documents already in the index are left out.
    """

    def add(batch, _number: int) -> None:
        known = engine.store.read("nodes").select("doc_id").distinct()
        new = batch.join(known, "doc_id", "left_anti")
        if not new.isEmpty():
            engine.ingest(new)

    stream = spark.readStream.schema(DOCS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()
