"""Detectors: columns over aggregated tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracejobs.functions.normal import two_sided_p
from tracejobs.functions.quantiles import relative_diff
from tracejobs.functions.ranked import band_stats, order_stats
from tracejobs.operators.detectors import Statistical, Trend
from tracejobs.operators.sli import endpoint_stats


def baseline_slices(spans: DataFrame) -> DataFrame:
    """Per endpoint: mean of the normal durations in three bands of their order, in seconds; all rows where a band is empty. Durations are counted first."""
    bands = {"all": (0.0, 1.0), "p90": (0.85, 0.95), "p95": (0.90, 0.99), "p99": (0.95, 1.0)}
    stats = band_stats(spans.where("period = 'normal'"), ["datapack", "span_name"], F.col("duration") / 1e9, bands)
    return stats.select("datapack", "span_name", F.col("all_n").alias("n"), *[F.round(f"{k}_mean", 6).alias(f"base_{k}") for k in ("p90", "p95", "p99")])


def statistical_detector(metrics: DataFrame, z: float = 3.0, iqr: float = 1.5, least: int = 5) -> DataFrame:
    """Abnormal points against their metric's normal history: z-score (population sigma), else quartile fences."""
    keys = ["datapack", "service_name", "metric"]
    history = metrics.where("period = 'normal'").groupBy(*keys).agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.stddev_pop("value").alias("sd")).where(F.col("n") >= least)
    quartiles = order_stats(metrics.where("period = 'normal'"), keys, F.col("value"), {"q1": 0.25, "q3": 0.75})
    history = history.join(quartiles.select(*keys, F.array("q1", "q3").alias("q")), keys)
    both = metrics.where("period = 'abnormal'").join(history, keys)
    spread = F.col("q")[1] - F.col("q")[0]
    score = F.when(F.col("sd") > 0, F.abs(F.col("value") - F.col("m")) / F.when(F.col("sd") > 0, F.col("sd")))
    kind = F.when(score > z, "z-score").when((spread > 0) & ((F.col("value") < F.col("q")[0] - iqr * spread) | (F.col("value") > F.col("q")[1] + iqr * spread)), "iqr")
    known = both.withColumns({"h_n": F.col("n"), "h_mean": F.col("m"), "h_sd": F.col("sd"), "h_q1": F.col("q")[0], "h_q3": F.col("q")[1]})
    found = Statistical(z, iqr).detect(F.col("value"))
    return known.select(*keys, "seq", "value", F.round(score, 6).alias("z"), kind.alias("kind"), found["severity"].alias("severity"), F.round(found["confidence"], 6).alias("confidence")).where("kind IS NOT NULL")


def trend_detector(metrics: DataFrame, length: int = 10, sigmas: float = 3.0) -> DataFrame:
    """Points that leave the mean of the ``length`` points before them by more than so many of their sigmas."""
    w = Window.partitionBy("datapack", "service_name", "metric").orderBy("time", "seq").rowsBetween(-length, -1)
    before = {f"h_{c}_{length}": f("value").over(w) for c, f in (("mean", F.avg), ("sd", F.stddev_pop), ("last", F.count))}
    v = metrics.withColumns(before).withColumn("found", Trend(length, sigmas).detect(F.col("value"))).where("found IS NOT NULL")
    return v.select("datapack", "service_name", "metric", "seq", "value", F.substring_index("found.anomaly_type", "_", -1).alias("kind"), F.round(f"h_mean_{length}", 6).alias("mean"), "found.severity", F.round("found.confidence", 6).alias("confidence"))


def _issue(name: str, condition: Column, before: Column, after: Column) -> Column:
    return F.when(condition, F.struct(F.lit(name).alias("issue"), before.alias("normal"), after.alias("abnormal")))


def conclusion(spans: DataFrame, times: float = 1.2, drop: float = 0.05) -> DataFrame:
    """Per abnormal endpoint: both periods' statistics and its issues.

    Both periods are aggregated in one shuffle by endpoint. An endpoint without a normal period is judged by
    fixed limits: mean 3, p90 7, p95 8, p99 10 seconds, success 0.9.
    """
    stats = endpoint_stats(spans, ["datapack", "span_name", "period"])
    names = ["avg_duration", "p90", "p95", "p99", "succ_rate", "n"]
    side = lambda p: F.max(F.when(F.col("period") == p, F.struct(*names)))
    both = stats.groupBy("datapack", "span_name").agg(side("abnormal").alias("a"), side("normal").alias("b")).where("a IS NOT NULL")
    new = F.col("b").isNull()
    limits = {"avg_duration": 3.0, "p90": 7.0, "p95": 8.0, "p99": 10.0}
    found = [_issue(k, F.when(new, F.col(f"a.{k}") > x).otherwise(F.col(f"a.{k}") > times * F.col(f"b.{k}")), F.col(f"b.{k}"), F.col(f"a.{k}")) for k, x in limits.items()]
    found.append(_issue("succ_rate", F.when(new, F.col("a.succ_rate") < 0.9).otherwise(F.col("b.succ_rate") - F.col("a.succ_rate") > drop), F.col("b.succ_rate"), F.col("a.succ_rate")))
    issues = F.array_compact(F.array(*found))
    return both.select("datapack", "span_name", *[F.col(f"a.{k}").alias(f"abnormal_{k}") for k in names[:5]], *[F.col(f"b.{k}").alias(f"normal_{k}") for k in names[:5]], F.array_join(F.transform(issues, lambda x: x["issue"]), ",").alias("issues"))


def datapack_summary(concluded: DataFrame) -> DataFrame:
    """Per datapack: endpoints, those with issues, and a tag."""
    out = concluded.groupBy("datapack").agg(F.count(F.lit(1)).alias("endpoints"), F.count_if(F.col("issues") != "").alias("anomalies"), F.count_if(F.col("issues").contains("succ_rate")).alias("failing"))
    return out.withColumn("tag", F.when(F.col("failing") > 0, "absolute").when(F.col("anomalies") > 0, "may").otherwise("none"))


# The ratios to a bound from which on an anomaly is critical, high or medium.
SEVERITIES = ((2.0, "critical"), (1.5, "high"), (1.2, "medium"))


def severity(ratio: Column, steps: tuple[tuple[float, str], ...] = SEVERITIES) -> Column:
    out = F.lit("low")
    for least, name in reversed(steps):
        out = F.when(ratio >= least, name).otherwise(out)
    return out


def threshold_detector(metrics: DataFrame, low: float | None, high: float | None) -> DataFrame:
    """Values above the high or below the low bound, with the severity of their ratio to it and a confidence of at most 1."""
    value = F.col("value")
    over = value > high if high is not None else F.lit(False)
    under = value < low if low is not None else F.lit(False)
    down = F.lit(low) / F.greatest(value, F.lit(0.001)) if low and low > 0 else F.lit(SEVERITIES[1][0])
    rows = metrics.where(over | under).withColumn("ratio", F.when(over, value / high).otherwise(down) if high is not None else down)
    confidence = F.least(F.col("ratio"), F.lit(SEVERITIES[0][0])) / SEVERITIES[0][0]
    return rows.select("datapack", "service_name", "metric", "seq", "value", F.when(over, "high").otherwise("low").alias("kind"), severity(F.col("ratio")).alias("severity"), F.round(confidence, 6).alias("confidence"))


def success_rate_detector(spans: DataFrame, least_normal: int = 10, least_abnormal: int = 5, drop: float = 0.03, relative: float = 0.1, significance: float = 0.05) -> DataFrame:
    """Endpoints of both periods: success rates, their pooled two-proportion z, and whether the drop is significant.

    Significant: p below ``significance``, more than ``drop``, and more than ``relative`` of the normal rate; too few spans, or no
    variance, are not. Severity by the drop: over 0.2 critical, 0.1 high, 0.05 medium.
    """
    of = lambda p, c: F.count_if((F.col("period") == p) & c)
    good = F.col("status_code") != "Error"
    g = spans.groupBy("datapack", "span_name").agg(of("normal", F.lit(True)).alias("n1"), of("abnormal", F.lit(True)).alias("n2"), of("normal", good).alias("g1"), of("abnormal", good).alias("g2"))
    g = g.where((F.col("n1") >= least_normal) & (F.col("n2") >= least_abnormal))
    pooled = (F.col("g1") + F.col("g2")) / (F.col("n1") + F.col("n2"))
    g = g.withColumn("a", F.col("g1") / F.col("n1")).withColumn("b", F.col("g2") / F.col("n2")).withColumn("se", F.sqrt(pooled * (1 - pooled) * (1 / F.col("n1") + 1 / F.col("n2"))))
    g = g.withColumn("z", F.coalesce(F.try_divide(F.abs(F.col("b") - F.col("a")), F.col("se")), F.lit(0.0))).withColumn("fall", F.col("a") - F.col("b"))
    g = g.withColumn("p", F.when(F.col("se") > 0, two_sided_p(F.col("z"))).otherwise(1.0))
    wrong = (F.col("p") < significance) & (F.col("fall") > drop) & (F.col("fall") > relative * F.col("a"))
    level = F.when(F.col("fall") > 0.2, "critical").when(F.col("fall") > 0.1, "high").when(F.col("fall") > 0.05, "medium").otherwise("low")
    return g.select("datapack", "span_name", F.round("a", 6).alias("normal_rate"), F.round("b", 6).alias("abnormal_rate"), F.round("z", 6).alias("z"), F.round("p", 6).alias("p"), wrong.alias("is_anomaly"), F.when(wrong, level).alias("severity"), F.when(wrong, F.round(F.least(F.lit(1.0), (1 - F.col("p")) * 2), 6)).alias("confidence"))


def new_endpoint_issues(stats: DataFrame) -> DataFrame:
    """Issues, as JSON, of endpoints that the normal period lacks: stats (datapack, span_name, avg_duration, p90, p95, p99, succ_rate) in seconds."""
    # Absolute limits in seconds.
    limits = (("avg_duration", 3.0), ("p90", 7.0), ("p95", 8.0), ("p99", 10.0))
    over = [F.when(F.col(c) > x, F.struct(F.lit(0.0).alias("normal"), F.col(c).alias("abnormal"), F.lit(x).alias("threshold"))).alias(c) for c, x in limits]
    over.append(F.when(F.col("avg_duration") > 15.0, F.struct(F.lit(15.0).alias("threshold"), F.col("avg_duration").alias("abnormal"))).alias("hard_timeout"))
    over.append(F.when(F.col("succ_rate") < 0.9, F.struct(F.lit(1.0).alias("normal"), F.col("succ_rate").alias("abnormal"), F.lit(0.9).alias("threshold"))).alias("succ_rate"))
    return stats.select("datapack", "span_name", F.to_json(F.struct(*over)).alias("issues"))


def edge_anomalies(probabilities: DataFrame, least: float = 0.5) -> DataFrame:
    """Edges whose call probability from either end differs by more than ``least``, relatively, between periods."""
    value = lambda c, p: F.max(F.when(F.col("period") == p, F.col(c)))
    out = probabilities.groupBy("datapack", "src", "dst").agg(*[value(c, p).alias(f"{p}_{c}") for c in ("p_src", "p_dst") for p in ("normal", "abnormal")])
    diffs = [F.round(relative_diff(F.col(f"normal_{c}"), F.col(f"abnormal_{c}")), 6).alias(f"diff_{c}") for c in ("p_src", "p_dst")]
    return out.select("datapack", "src", "dst", *diffs).where((F.abs("diff_p_src") > least) | (F.abs("diff_p_dst") > least))


def standardised_anomalies(metrics: DataFrame, least: float = 2.0) -> DataFrame:
    """Metrics whose mean moved by more than ``least`` normal deviations; without deviation, by more than nothing, told as the difference itself."""
    of = lambda f, p: f(F.when(F.col("period") == p, F.col("value")))
    g = metrics.groupBy("datapack", "service_name", "metric").agg(of(F.avg, "normal").alias("a"), of(F.avg, "abnormal").alias("b"), F.coalesce(of(F.stddev_samp, "normal"), F.lit(0.0)).alias("sd"))
    diff = F.when(F.col("sd") > 0, (F.col("b") - F.col("a")) / F.col("sd")).otherwise(F.col("b") - F.col("a"))
    return g.select("datapack", "service_name", "metric", F.round(diff, 6).alias("diff"), F.col("sd").alias("sd")).where(F.when(F.col("sd") > 0, F.abs("diff") > least).otherwise(F.abs("diff") > 0)).drop("sd")


def recent_stats(metrics: DataFrame, length: int = 10) -> DataFrame:
    """Each value with the mean and the deviation of the ``length`` before it in its series."""
    past = Window.partitionBy("datapack", "service_name", "metric").orderBy("time", "seq").rowsBetween(-length, -1)
    return metrics.select("datapack", "service_name", "metric", "seq", F.round(F.avg("value").over(past), 6).alias("mean"), F.round(F.stddev_pop("value").over(past), 6).alias("sd"))


def usable_datapacks(concluded: DataFrame, sizes: DataFrame, most_bytes: int) -> DataFrame:
    """(datapack, issues, bytes, usable): datapacks with at least an endpoint that has issues (JSON other than ``{}``) and of no more than that size.

    sizes: (datapack, bytes). A datapack without conclusions or without a size is not usable.
    """
    some = concluded.groupBy("datapack").agg(F.count_if(F.col("issues") != "{}").alias("issues"))
    out = some.join(sizes, "datapack", "full")
    return out.select("datapack", F.coalesce("issues", F.lit(0)).alias("issues"), "bytes", F.coalesce((F.col("issues") > 0) & (F.col("bytes") <= most_bytes), F.lit(False)).alias("usable"))


def validity(counts: DataFrame, signals: list[str], spans: DataFrame, longest_s: float) -> DataFrame:
    """(datapack, missing, longest, valid): signals without rows, and the longest normal root in seconds, which must not exceed the limit."""
    have = counts.where("n > 0").groupBy("datapack").agg(F.collect_set("signal").alias("have"))
    roots = spans.where("period = 'normal' AND parent_span_id = ''").groupBy("datapack").agg((F.max("duration") / 1e9).alias("longest"))
    out = have.join(roots, "datapack", "full").withColumn("missing", F.array_join(F.array_sort(F.array_except(F.array(*map(F.lit, signals)), F.coalesce("have", F.array().cast("array<string>")))), ","))
    return out.select("datapack", "missing", "longest", F.coalesce((F.col("missing") == "") & (F.col("longest") <= longest_s), F.lit(False)).alias("valid"))
