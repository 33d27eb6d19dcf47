"""Streaming forms of the burst and session computations. An extension: the batch operators are the reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bursts(events: DataFrame, key: str, ts: str, floor: int, late: str = "1 hour", span: str = "24 hours", step: str = "1 hour") -> DataFrame:
    """Keys with at least ``floor`` events in a sliding span; late rows are taken up to the watermark."""
    counted = events.withWatermark(ts, late).groupBy(F.window(ts, span, step), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= floor).select(key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def sessions(events: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a key: events with no gap longer than ``gap``."""
    counted = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
