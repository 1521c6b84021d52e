"""Structured Streaming into a collection: each micro-batch is an upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..collection import Collection


def stream_into(stream: DataFrame, collection: Collection, checkpoint: str, overwrite: bool = True, **trigger: object) -> StreamingQuery:
    """Add a stream's rows (id, vector, metadata) as they come.

    Writing is keyed by id, so a micro-batch that is run again after a failure replaces its own rows and no watermark is needed. That
    holds for rows with an id: one without gets a new id each time and so would be there twice.
    """
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: collection.add_frame(batch, overwrite) and None)
    return (writer.trigger(**trigger) if trigger else writer).start()
