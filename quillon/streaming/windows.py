"""An extra beyond the SQL engine: time buckets over an unbounded stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bucket_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", time_col: str = "ts", key_col: str = "event_type", value_col: str = "value") -> DataFrame:
    """(bucket, key, n, total) of tumbling buckets. Rows later than the watermark are left out; state is one row
    for each open bucket and key. Works on streams and on tables alike."""
    at = F.col(time_col).cast("timestamp")
    timed = events.withColumn(time_col, at).withWatermark(time_col, late)
    out = timed.groupBy(F.window(time_col, width).alias("w"), F.col(key_col).alias("key")).agg(F.count("*").alias("n"), F.sum(value_col).alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("bucket"), "key", "n", "total")
