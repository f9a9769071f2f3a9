"""The ingestion loop as a stream: bounded intake, batches that are committed once, and drains.

A source gives each trigger a bounded share of what waits (files, or bytes of them), so a backlog never grows a batch; Spark's checkpoint holds the offsets, and the
sink's log holds the last batch that was committed. A batch that fails is run again by the next start, and is not committed again if its commit came through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators import snapshots


def intake(spark: SparkSession, path: str, schema: str, files: int = 100, most_bytes: str | None = None, form: str = "json") -> DataFrame:
    """Files of a folder as a stream, oldest first, at most `files` of them (or most_bytes, like 1g) each trigger."""
    reader = spark.readStream.schema(schema).format(form)
    return (reader.option("maxBytesPerTrigger", most_bytes) if most_bytes else reader.option("maxFilesPerTrigger", files)).load(path)


def start(stream: DataFrame, folder: str, app: str, tables, events=None, every: str | None = None, buckets: int = snapshots.BUCKETS) -> StreamingQuery:
    """Commits the stream's batches to the tables of a folder: every so often until it is stopped, or, without `every`, until what waits is drained."""
    sink = snapshots.stream_sink(folder, app, tables, events, buckets)
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/checkpoints/{app}")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def drain(stream: DataFrame, folder: str, app: str, tables, events=None, timeout: int = 3600, buckets: int = snapshots.BUCKETS) -> bool:
    """Runs until what waits is committed; False if that took longer than timeout seconds. A failed batch raises."""
    query = start(stream, folder, app, tables, events, None, buckets)
    try:
        return query.awaitTermination(timeout)
    finally:
        query.stop()
