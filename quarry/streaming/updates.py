"""Indexes that follow a folder of files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.index import build


def follow(spark: SparkSession, content: str, folder: str, checkpoint: str, once: bool = False, **options) -> StreamingQuery:
    """Bring the index up to date for each batch of files that arrive in ``content``.

    The stream only says that files have come: the build then compares the
    folder with what the index holds, so a batch that is run again after a
    failure changes nothing.  ``once`` takes what is there and stops.
    """
    arrived = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", "true").load(content)

    def batch(rows: DataFrame, _: int) -> None:
        if not rows.select("path").isEmpty():
            build(rows.sparkSession, content, folder, **options)

    writer = arrived.select("path").writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def windowed_counts(events: DataFrame, time: str, keys: list[str], window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts of a stream by window and keys; rows later than ``late`` behind the newest are left out."""
    from pyspark.sql import functions as F

    return events.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.count("*").alias("n"))
