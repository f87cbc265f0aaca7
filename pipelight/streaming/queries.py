"""Streaming forms of the batch operators that make sense on unbounded input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def timechart(stream: DataFrame, time: str, span: str, aggs: dict[str, Column], by: list[str] = (), late: str = "0 seconds") -> DataFrame:
    """Aggregates by time window and group; windows close once the watermark has passed them."""
    out = stream.withWatermark(time, late).groupBy(F.window(time, span), *by).agg(*(c.alias(n) for n, c in aggs.items()))
    return out.select(F.col("window.start").alias("_time"), *by, *aggs)


def sliding(stream: DataFrame, time: str, span: str, slide: str, aggs: dict[str, Column], by: list[str] = (), late: str = "0 seconds") -> DataFrame:
    out = stream.withWatermark(time, late).groupBy(F.window(time, span, slide), *by).agg(*(c.alias(n) for n, c in aggs.items()))
    return out.select(F.col("window.start").alias("_time"), *by, *aggs)


def sessions(stream: DataFrame, time: str, gap: str, aggs: dict[str, Column], by: list[str], late: str = "0 seconds") -> DataFrame:
    out = stream.withWatermark(time, late).groupBy(F.session_window(time, gap), *by).agg(*(c.alias(n) for n, c in aggs.items()))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, *aggs)


def dedup(stream: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    """The first row of each key within the watermark; state older than it is dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def running(stream: DataFrame, keys: list[str], aggs: dict[str, Column]) -> DataFrame:
    """Running aggregates of each group; write it in update mode."""
    return stream.groupBy(*keys).agg(*(c.alias(n) for n, c in aggs.items()))
