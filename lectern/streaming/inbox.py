"""The inbox as a stream: new files are parsed once, in micro-batches, into a blocks table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources import markdown


def watch(spark: SparkSession, folder: str, table: str, checkpoint: str, every: str | None = None):
    """Starts the query: Markdown and text files of ``folder`` to Parquet at ``table``. Without a period
    it takes what is there and ends. A batch's rows carry its number, so a repeated batch overwrites
    its own part."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.{md,markdown,txt}").load(folder)

    def store(batch: DataFrame, number: int) -> None:
        markdown.read(batch).write.mode("overwrite").parquet(f"{table}/batch={number}")

    how = {"processingTime": every} if every else {"availableNow": True}
    return files.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(**how).start()


def hourly(events: DataFrame) -> DataFrame:
    """Counts and values per hour and type of an event stream or table; late rows up to ten minutes."""
    return events.withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))
