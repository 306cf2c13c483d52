"""Roll-ups of spans, logs and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracejobs.functions.quantiles import nearest, ratio
from tracejobs.functions.ranked import order_stats

MS = 1e6


def sli_rollup(spans: DataFrame, unit: str = "minute") -> DataFrame:
    """Per datapack, time unit, service and span: duration statistics in ms, nearest-rank quantiles, counts.

    The time is part of the key, so that a hot endpoint is many groups.
    """
    ms = F.col("duration") / MS
    grouped = spans.groupBy("datapack", F.date_trunc(unit, "time").alias("time"), "service_name", "span_name").agg(
        F.array_sort(F.collect_list(ms)).alias("all"), F.min(ms).alias("min_duration"), F.max(ms).alias("max_duration"), (F.avg("duration") / MS).alias("avg_duration"),
        F.count(F.lit(1)).alias("total_count"), F.count_if(F.col("status_code") == "Error").alias("error_count"),
    )
    quantiles = [nearest(F.col("all"), q / 100).alias(f"duration_p{q}") for q in (50, 90, 95, 99)]
    return grouped.select("datapack", "time", "service_name", "span_name", "min_duration", "max_duration", F.round("avg_duration", 6).alias("avg_duration"), *quantiles, "total_count", "error_count")


def endpoint_stats(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: mean and linear quantiles of durations in seconds, success rate and number of requests."""
    s = F.col("duration") / 1e9
    out = spans.groupBy(*keys).agg(F.avg(s).alias("avg"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("status_code") != "Error").alias("ok"))
    q = order_stats(spans, keys, s, {"p90": 0.9, "p95": 0.95, "p99": 0.99}).drop("n")
    return out.join(q, keys, "left").select(*keys, F.round("avg", 10).alias("avg_duration"), *[F.round(n, 8).alias(n) for n in ("p90", "p95", "p99")], F.round(ratio(F.col("ok"), F.col("n")), 6).alias("succ_rate"), "n")


def error_rate_windows(spans: DataFrame, length: str) -> DataFrame:
    """Per window and service: percent of responses of 400 or more."""
    window = F.window("time", length)["start"].alias("time")
    return spans.groupBy("datapack", window, "service_name").agg(F.round(F.avg(F.when(F.col("http_status") >= 400, 1.0).otherwise(0.0)) * 100, 6).alias("error_rate"), F.count(F.lit(1)).alias("n"))


def log_error_windows(logs: DataFrame, length: str) -> DataFrame:
    """Per window and service: the part of logs at WARN or ERROR."""
    window = F.window("time", length)["start"].alias("time")
    return logs.groupBy("datapack", window, "service_name").agg(F.round(F.avg(F.when(F.col("level").isin("WARN", "ERROR"), 1.0).otherwise(0.0)), 6).alias("error_rate"))


def duration_windows(spans: DataFrame, length: str) -> DataFrame:
    """Per window and service: the mean of positive durations in ms."""
    window = F.window("time", length)["start"].alias("time")
    return spans.where("duration > 0").groupBy("datapack", window, "service_name").agg(F.round(F.avg("duration") / MS, 6).alias("avg_ms"))


def span_stats(spans: DataFrame) -> DataFrame:
    """Per service and span: calls, errors, error rate, and ms statistics with linear quantiles."""
    ms = F.col("duration") / MS
    out = spans.groupBy("datapack", "service_name", "span_name").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(F.col("status_code") == "Error").alias("errors"), (F.avg("duration") / MS).alias("avg_ms"), F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"),
    )
    keys = ["datapack", "service_name", "span_name"]
    out = out.join(order_stats(spans, keys, ms, {f"p{n}": n / 100 for n in (50, 90, 95, 99)}).drop("n"), keys, "left")
    return out.select("datapack", "service_name", "span_name", "calls", "errors", F.round(ratio(F.col("errors"), F.col("calls")), 6).alias("error_rate"), F.round("avg_ms", 6).alias("avg_ms"), "min_ms", "max_ms", *[F.round(f"p{n}", 8).alias(f"p{n}") for n in (50, 90, 95, 99)])


def call_probability(spans: DataFrame) -> DataFrame:
    """Per service edge and period: the traces with both ends over those with the source, and with the destination."""
    has = spans.select("datapack", "period", "service_name", "trace_id").distinct()
    n = has.groupBy("datapack", "period", "service_name").agg(F.count(F.lit(1)).alias("n"))
    a, b = has.withColumnRenamed("service_name", "src"), has.withColumnRenamed("service_name", "dst")
    from tracejobs.operators.joins import service_graph

    # the edges are few: joining them to one side first keeps the pairs to those that call each other
    both = service_graph(spans).join(a, ["datapack", "src"]).join(b, ["datapack", "period", "trace_id", "dst"]).groupBy("datapack", "period", "src", "dst").agg(F.count(F.lit(1)).alias("both"))
    out = both.join(n.select("datapack", "period", F.col("service_name").alias("src"), F.col("n").alias("n_src")), ["datapack", "period", "src"]).join(n.select("datapack", "period", F.col("service_name").alias("dst"), F.col("n").alias("n_dst")), ["datapack", "period", "dst"])
    return out.select("datapack", "period", "src", "dst", F.round(F.col("both") / F.col("n_src"), 6).alias("p_src"), F.round(F.col("both") / F.col("n_dst"), 6).alias("p_dst"))


def datapack_profile(spans: DataFrame) -> DataFrame:
    """Per datapack: spans, roots, services, time range and queries a second."""
    seconds = (F.unix_timestamp(F.max("time")) - F.unix_timestamp(F.min("time"))).alias("seconds")
    out = spans.groupBy("datapack").agg(F.count(F.lit(1)).alias("spans"), F.count_if(F.col("parent_span_id") == "").alias("roots"), F.count_distinct("service_name").alias("services"), F.min("time").alias("first"), F.max("time").alias("last"), seconds)
    return out.withColumn("qps", F.round(ratio(F.col("roots"), F.col("seconds")), 9))


def anomaly_magnitude(metrics: DataFrame) -> DataFrame:
    """Per service: the sum over metrics of the shift of the min-max scaled mean between periods; constant metrics add 0."""
    bad, good = F.col("period") == "abnormal", F.col("period") == "normal"
    per = metrics.groupBy("datapack", "service_name", "metric").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg(F.when(bad, F.col("value"))).alias("a"), F.avg(F.when(good, F.col("value"))).alias("n"))
    shift = F.when(F.col("hi") > F.col("lo"), F.abs(F.col("a") - F.col("n")) / (F.col("hi") - F.col("lo")))
    return per.groupBy("datapack", "service_name").agg(F.round(F.sum(F.coalesce(shift, F.lit(0.0))), 6).alias("magnitude"))


def anomaly_cardinality(metrics: DataFrame, sigmas: float = 2.0) -> DataFrame:
    """Per service: metrics whose mean moved by more than so many normal standard deviations; with none, by any amount."""
    bad, good = F.col("period") == "abnormal", F.col("period") == "normal"
    per = metrics.groupBy("datapack", "service_name", "metric").agg(F.avg(F.when(bad, F.col("value"))).alias("a"), F.avg(F.when(good, F.col("value"))).alias("n"), F.coalesce(F.stddev_samp(F.when(good, F.col("value"))), F.lit(0.0)).alias("sd"))
    moved = F.abs(F.col("a") - F.col("n"))
    return per.groupBy("datapack", "service_name").agg(F.count_if(F.when(F.col("sd") > 0, moved / F.when(F.col("sd") > 0, F.col("sd")) > sigmas).otherwise(moved > 0)).alias("cardinality"))
