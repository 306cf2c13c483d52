"""Structured Streaming forms of the windowed jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sli_stream(spans: DataFrame, length: str = "1 minute", late: str = "2 minutes") -> DataFrame:
    """Per window, service and span: counts, errors, and approximate quantiles of ms; rows later than ``late`` are dropped."""
    ms = F.col("duration") / 1e6
    grouped = spans.withWatermark("time", late).groupBy("datapack", F.window("time", length), "service_name", "span_name")
    out = grouped.agg(F.count(F.lit(1)).alias("total_count"), F.count_if(F.col("status_code") == "Error").alias("error_count"), F.percentile_approx(ms, [0.5, 0.9, 0.95, 0.99], 10000).alias("q"))
    return out.select("datapack", F.col("window.start").alias("time"), "service_name", "span_name", "total_count", "error_count", *[F.col("q")[i].alias(f"duration_p{n}") for i, n in enumerate((50, 90, 95, 99))])


def error_rate_stream(spans: DataFrame, length: str = "60 seconds", slide: str = "10 seconds", late: str = "2 minutes") -> DataFrame:
    """Per sliding window and service: percent of responses of 400 or more."""
    grouped = spans.withWatermark("time", late).groupBy("datapack", F.window("time", length, slide), "service_name")
    return grouped.agg((F.avg(F.when(F.col("http_status") >= 400, 1.0).otherwise(0.0)) * 100).alias("error_rate")).select("datapack", F.col("window.start").alias("time"), "service_name", "error_rate")


def assemble_traces(spans: DataFrame, gap: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """A trace is closed after a gap without spans: its spans, errors and root duration."""
    grouped = spans.withWatermark("time", late).groupBy("datapack", "trace_id", F.session_window("time", gap))
    return grouped.agg(F.count(F.lit(1)).alias("spans"), F.count_if(F.col("status_code") == "Error").alias("errors"), F.max(F.when(F.col("parent_span_id") == "", F.col("duration"))).alias("root_duration")).drop("session_window")


def without_repeats(spans: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each span once, as far as repeats come within the watermark."""
    return spans.withWatermark("time", late).dropDuplicatesWithinWatermark(["trace_id", "span_id"])
