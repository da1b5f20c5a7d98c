"""Streaming forms: deduplication on arrival and windowed statistics of the search log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_arrivals(stream: DataFrame, keys: list[str], time_col: str, late: str = "1 day") -> DataFrame:
    """Rows whose keys have not arrived within the watermark: state is dropped as it passes, so it stays bounded."""
    return stream.withWatermark(time_col, late).dropDuplicatesWithinWatermark(keys)


def query_windows(stream: DataFrame, time_col: str = "created_at", width: str = "1 hour", late: str = "6 hours") -> DataFrame:
    """(start, end, query_key, n, n_zero, mean_pool_ms) per tumbling window and normalised query; rows later than the watermark are left out."""
    key = F.lower(F.trim(F.regexp_replace("query", r"\s+", " ")))
    agg = stream.withWatermark(time_col, late).groupBy(F.window(time_col, width).alias("w"), key.alias("query_key")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.coalesce(F.size("final_ids"), F.lit(0)) <= 0, 1).otherwise(0)).alias("n_zero"), F.avg("pool_ms").alias("mean_pool_ms")
    )
    return agg.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "query_key", "n", "n_zero", "mean_pool_ms")


def run_available(df: DataFrame, path: str, checkpoint: str) -> None:
    """Process what has arrived and stop."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
