"""Latencies as a stream: windows over event time, with a watermark for late calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """n, sum and the extremes of latency by window, task and path. Works on batch and stream alike."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    rows = events.where("latency_ms is not null").withWatermark(time, late)
    g = rows.groupBy(w.alias("w"), "task", F.coalesce("path", F.lit("generative")).alias("path")).agg(F.count("*").alias("n"), F.sum("latency_ms").alias("total_ms"), F.min("latency_ms").alias("least_ms"), F.max("latency_ms").alias("most_ms"), F.approx_percentile("latency_ms", [0.5, 0.95]).alias("p"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "task", "path", "n", "total_ms", "least_ms", "most_ms", F.get("p", F.lit(0)).alias("p50_ms"), F.get("p", F.lit(1)).alias("p95_ms"))


def metrics_stream(spark, path: str, schema: str, files: int = 100) -> DataFrame:
    """A log of JSON lines as a stream, some files a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path).withColumn("ts", F.timestamp_micros((F.col("ts") * 1_000_000).cast("bigint")))
