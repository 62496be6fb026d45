"""The stateless cleaners over streams, and windowed counts with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.functions import text as tx


def clean_stream(stream: DataFrame, column: str) -> DataFrame:
    """A text column in the form for matching; blank rows dropped. Works alike on tables."""
    return stream.withColumn(column, tx.normalize_words(F.col(column))).where(F.col(column) != "")


def windowed_counts(stream: DataFrame, ts: str, key: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, key, n, total) of tumbling windows; rows later than `late` are dropped by the watermark."""
    w = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), key)
    return w.agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total")).select(F.col("w.start").alias("window_start"), key, "n", "total")


def first_seen(stream: DataFrame, ts: str, keys: list[str], late: str = "2 hours") -> DataFrame:
    """Each key once: the state of keys older than the watermark is given up."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
