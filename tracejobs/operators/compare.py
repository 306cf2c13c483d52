"""Both periods side by side, and indicator statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracejobs.functions.normal import two_sided_p
from tracejobs.functions.quantiles import relative_diff
from tracejobs.functions.ranked import order_stats


def by_period(value: Column, period: str) -> Column:
    return F.when(F.col("period") == period, value)


def period_delta(spans: DataFrame) -> DataFrame:
    """Per service and span of the abnormal period: mean duration in ms against the normal one, 0 where it is missing."""
    ms = lambda p: F.avg(by_period(F.col("duration"), p)) / 1e6
    out = spans.groupBy("datapack", "service_name", "span_name").agg(ms("abnormal").alias("bad"), F.coalesce(ms("normal"), F.lit(0.0)).alias("good"))
    return out.where("bad IS NOT NULL").select("datapack", "service_name", "span_name", F.round("bad", 6).alias("bad"), F.round("good", 6).alias("good"), F.round(F.col("bad") - F.col("good"), 6).alias("delta"))


def max_duration(spans: DataFrame, unit: str = "second") -> DataFrame:
    return spans.groupBy("datapack", F.date_trunc(unit, "time").alias("time")).agg(F.max("duration").alias("max_duration"))


def golden_signals(spans: DataFrame, seconds: float) -> DataFrame:
    """Latency in ms, requests a second over a window of that length, part and rate of errors."""
    ms, wrong = F.col("duration") / 1e6, F.count_if(F.col("status_code") == "Error")
    keys = ["datapack", "period", "service_name"]
    out = spans.groupBy(*keys).agg(
        F.round(F.avg("duration") / 1e6, 6).alias("avg_ms"), F.round(F.count(F.lit(1)) / seconds, 9).alias("rps"), F.round(wrong / F.count(F.lit(1)) * 100, 6).alias("error_percent"), F.round(wrong / seconds, 9).alias("eps")
    )
    q = order_stats(spans, keys, ms, {f"p{n}": n / 100 for n in (50, 95, 99)})
    return out.join(q.select(*keys, *[F.round(f"p{n}", 6).alias(f"p{n}") for n in (50, 95, 99)]), keys, "left")


def operation_rates(spans: DataFrame) -> DataFrame:
    """Calls a minute between an operation's first and last span (the number of calls if both are one), part of errors."""
    minutes = (F.unix_micros(F.max("time")) - F.unix_micros(F.min("time"))) / 60e6
    n = F.count(F.lit(1))
    return spans.groupBy("datapack", "period", "service_name", "span_name").agg(
        F.round(F.when(minutes > 0, n / F.when(minutes > 0, minutes)).otherwise(n.cast("double")), 9).alias("qpm"), F.round(F.avg(F.when(F.col("status_code") == "Error", 1.0).otherwise(0.0)), 6).alias("error_rate")
    )


def service_error_rates(spans: DataFrame) -> DataFrame:
    """Mean of a service's function error rates in either period, over functions that have both."""
    wrong = F.when(F.col("status_code") == "Error", 1.0).otherwise(0.0)
    ops = spans.groupBy("datapack", "service_name", "span_name").agg(F.avg(by_period(wrong, "normal")).alias("n"), F.avg(by_period(wrong, "abnormal")).alias("a")).where("n IS NOT NULL AND a IS NOT NULL")
    return ops.groupBy("datapack", "service_name").agg(F.round(F.avg("n"), 6).alias("normal"), F.round(F.avg("a"), 6).alias("abnormal"), F.count(F.lit(1)).alias("functions"))


def indicator_stats(metrics: DataFrame, cuts: tuple[float, ...] = (0.05, 0.1, 0.25)) -> DataFrame:
    """Count, extremes, mean, trimmed means (floor of cut * n values off each end) and percentiles per indicator and period."""
    keys = ["datapack", "service_name", "metric", "period"]
    stats = order_stats(metrics, keys, F.col("value"), {f"p{n}": n / 100 for n in (50, 90, 95, 99)}, {f"trimmed_{int(p * 100)}": p for p in cuts})
    sums = metrics.where("value IS NOT NULL").groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.round(F.avg("value"), 6).alias("mean"))
    rest = [c for c in stats.columns if c not in (*keys, "n")]
    return sums.join(stats, keys).select(*keys, "n", "lo", "hi", "mean", *[F.round(c, 6).alias(c) for c in rest])


def varying_metrics(metrics: DataFrame, least: float = 1e-8, kept: tuple[str, ...] = ()) -> DataFrame:
    """(datapack, service, metric) whose values vary, and those named in ``kept``."""
    spread = metrics.groupBy("datapack", "service_name", "metric").agg((F.max("value") - F.min("value")).alias("spread"))
    return spread.where((F.col("spread") >= least) | F.col("metric").isin(*kept)).select("datapack", "service_name", "metric")


def normal_durations(spans: DataFrame) -> DataFrame:
    s = F.col("duration") / 1e9
    return spans.where("period = 'normal'").groupBy("datapack").agg(F.max(s).alias("longest"), F.min(s).alias("shortest"), F.round(F.avg("duration") / 1e9, 6).alias("mean")).join(
        order_stats(spans.where("period = 'normal'"), ["datapack"], s, {"median": 0.5}).select("datapack", F.round("median", 6).alias("median")), "datapack")


def node_anomalies(metrics: DataFrame, least: float = 0.5) -> DataFrame:
    """Indicators whose mean, deviation or 90 % differ between periods by more than that part."""
    v = F.col("value")
    keys = ["datapack", "service_name", "metric"]
    stats = {"mean": F.avg, "std": F.stddev_samp, "p90": None}
    g = metrics.groupBy(*keys).agg(*[F.round(f(by_period(v, p)), 9).alias(f"{p}_{k}") for k, f in stats.items() if f for p in ("normal", "abnormal")])
    high = order_stats(metrics, [*keys, "period"], v, {"p90": 0.9})
    g = g.join(high.groupBy(*keys).agg(*[F.round(F.max(by_period(F.col("p90"), p)), 9).alias(f"{p}_p90") for p in ("normal", "abnormal")]), keys, "left")
    rows = F.inline(F.array(*[F.struct(F.lit(k).alias("stat"), F.col(f"normal_{k}").alias("normal"), F.col(f"abnormal_{k}").alias("abnormal")) for k in stats]))
    out = g.select("datapack", "service_name", "metric", rows).where("normal IS NOT NULL AND abnormal IS NOT NULL")
    return out.withColumn("diff", F.round(relative_diff(F.col("normal"), F.col("abnormal")), 6)).where(F.abs("diff") > least).select("datapack", "service_name", "metric", "stat", "diff")


def rank_sum(spans: DataFrame, least: int = 10) -> DataFrame:
    """Mann-Whitney U of normal against abnormal durations of an endpoint, its z with ties and continuity corrected, and the two-sided p.

    Equal durations are counted first, so the window runs over different values only.
    """
    keys = ["datapack", "span_name"]
    counted = spans.groupBy(*keys, "duration").agg(F.count_if(F.col("period") == "normal").alias("a"), F.count_if(F.col("period") == "abnormal").alias("b")).withColumn("t", F.col("a") + F.col("b"))
    upto = F.sum("t").over(Window.partitionBy(*keys).orderBy("duration").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.withColumn("rank", upto - (F.col("t") - 1) / 2)
    t = F.col("t").cast("double")
    g = ranked.groupBy(*keys).agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"), F.sum(F.col("a") * F.col("rank")).alias("r"), F.sum(t * t * t - t).alias("ties")).where((F.col("n1") >= least) & (F.col("n2") >= least))
    n, product = F.col("n1") + F.col("n2"), F.col("n1") * F.col("n2").cast("double")
    g = g.withColumn("u", F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2).withColumn("sigma", F.sqrt(product / 12 * (n + 1 - F.col("ties") / (n * (n - 1)))))
    z = F.when(F.col("sigma") > 0, F.greatest(F.lit(0.0), F.abs(F.col("u") - product / 2) - 0.5) / F.when(F.col("sigma") > 0, F.col("sigma"))).otherwise(0.0)
    return g.select(*keys, "n1", "n2", "u", F.round(z, 6).alias("z"), F.round(two_sided_p(z), 6).alias("p"))
