"""Indexing files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tarnloom import schema
from tarnloom.plans.engine import Engine


def index_stream(files: DataFrame, engine: Engine, checkpoint: str, collection: str = schema.DEFAULT_COLLECTION, available_now: bool = True) -> StreamingQuery:
    """Indexes a stream of files (path, content, content_hash) a micro-batch at a time. A batch that runs again after a
    failure writes the same point ids, so its effect is that of one run; of a path twice in a batch one row counts."""

    def write(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            engine.index(batch.dropDuplicates(["path"]), collection, replace_files=True)

    writer = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
