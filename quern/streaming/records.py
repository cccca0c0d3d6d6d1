"""Folders of files as streams of records.

A finite file is pulled record by record with ``reader.stream_records``; a
folder to which files are added is a Structured Streaming source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quern.functions import records


def follow(spark: SparkSession, folder: str, schema: T.StructType, pattern: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the rows of all files in a folder, and of those that are added."""
    source = spark.readStream.schema(schema)
    if pattern:
        source = source.option("pathGlobFilter", pattern)
    if files_per_trigger:
        source = source.option("maxFilesPerTrigger", files_per_trigger)
    return source.parquet(folder)


def write_records(stream: DataFrame, folder: str, checkpoint: str, available_now: bool = False, **options) -> StreamingQuery:
    """JSON records of a stream as text files; each row once, also over restarts from the same ``checkpoint``."""
    writer = records.to_records(stream, **options).writeStream.format("text").option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(folder)
