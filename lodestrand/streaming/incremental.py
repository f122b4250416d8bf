"""Incremental indexing from a file stream: each batch's unseen meetings are chunked and appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources import index
from ..sources.store import Store


def follow(spark: SparkSession, folder: str, schema: str, index_path: str, checkpoint: str, chunk: Callable[[DataFrame], DataFrame], available_now: bool = True, dimension: int = 0) -> StreamingQuery:
    """Index the meetings that appear as JSON lines in a folder.

    chunk turns meetings into chunks (meeting_id, level, chunk_id, text, ...). A meeting that the index has is skipped,
    so a batch that is run again after a failure adds nothing twice. dimension is that of the chunks' vectors, 0 for none.
    """

    def add(batch: DataFrame, _: int) -> None:
        own = batch.sparkSession
        chunks = chunk(batch.dropDuplicates(["meeting_id"]))
        indexed = index.load_or_empty(own, index_path, chunks.schema)
        fresh = index.unseen(chunks, indexed)
        if indexed.isEmpty():
            index.save(fresh, index_path, dimension)
        else:
            index.append(own, fresh, index_path)

    stream = spark.readStream.schema(schema).json(folder)
    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def follow_store(spark: SparkSession, folder: str, schema: str, store_path: str, checkpoint: str, chunk: Callable[[DataFrame], DataFrame], available_now: bool = True, dimension: int = 0) -> StreamingQuery:
    """Feed a saved index from the JSON lines in a folder; later lines of a chunk take the place of earlier ones.

    The stream's batches are the index's, under the same numbers, so one that is run again after a failure is written
    once. Nothing else may add to this index.
    """

    def add(batch: DataFrame, number: int) -> None:
        Store(batch.sparkSession, store_path, dimension).add(chunk(batch), batch=number)

    writer = spark.readStream.schema(schema).json(folder).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
