"""Append-only candidates as a stream: first sight of every URL, for a batch selection to read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def first_seen(spark: SparkSession, path: str, schema: str, key: str, seen_at: str, delay: str = "7 days") -> DataFrame:
    """Streamed rows with repeats of a key within the delay dropped; state is bounded by the watermark."""
    rows = spark.readStream.schema(schema).parquet(path)
    return rows.withWatermark(seen_at, delay).dropDuplicatesWithinWatermark([key])
