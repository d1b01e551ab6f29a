"""Incremental ingest: new files of a folder are processed once, restartable by the checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ingest_available(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, transform=lambda df: df) -> None:
    """Process all files of ``source`` that an earlier call has not, append them to ``target``, and stop."""
    stream = transform(spark.readStream.schema(schema).option("ignoreCorruptFiles", True).parquet(source))
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per key and window; on a stream, rows later than the watermark are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")
