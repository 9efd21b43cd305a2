"""Usage counters as a stream: windowed counts per report with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_usage(events: DataFrame, ts: str = "ts", keys: tuple[str, ...] = ("event_type",), width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(keys, start, runs, total): works alike on a stream and on a table."""
    at = F.col(ts).cast("timestamp")
    rows = events.withColumn(ts, at)
    if rows.isStreaming:
        rows = rows.withWatermark(ts, late)
    out = rows.groupBy(*keys, F.window(ts, width).alias("w")).agg(F.count("*").alias("runs"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"))
    return out.select(*keys, F.col("w.start").alias("start"), "runs", "total")


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
