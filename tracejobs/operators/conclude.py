"""The detector's conclusion on each endpoint of a datapack, and the datapack's summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracejobs.functions.normal import two_sided_p
from tracejobs.functions.quantiles import ratio
from tracejobs.functions.ranked import band_stats, order_stats
from tracejobs.operators.detectors import Latency

#: The ranks of normal durations that a percentile is compared with, and limits for endpoints without a normal period, in seconds.
BANDS = {"avg": (0.0, 1.0), "p90": (0.85, 0.95), "p95": (0.90, 0.99), "p99": (0.95, 1.0)}
NEW_LIMITS = {"avg": 3.0, "p90": 7.0, "p95": 8.0, "p99": 10.0}
SIGNIFICANT_S, NEW_SUCCESS = 10.0, 0.9
NAMES = {"avg": "avg_duration", "p90": "p90_duration", "p95": "p95_duration", "p99": "p99_duration"}


def endpoint_numbers(entries: DataFrame) -> DataFrame:
    """(datapack, endpoint, a_*, b_*): an abnormal (a) and a normal (b) period's mean and percentiles in seconds, statuses told and those that are 200.

    entries: (datapack, period, endpoint, duration in ns, status). A status that is null was not told.
    """
    keys = ["datapack", "period", "endpoint"]
    seconds = F.col("duration") / 1e9
    counts = entries.groupBy(*keys).agg((F.avg("duration") / 1e9).alias("avg"), F.count("status").alias("told"), F.count_if(F.col("status") == "200").alias("good"))
    both = counts.join(order_stats(entries, keys, seconds, {"p90": 0.9, "p95": 0.95, "p99": 0.99}), keys, "left")
    names = ["avg", "p90", "p95", "p99", "told", "good"]
    side = [F.max(F.when(F.col("period") == p, F.col(c))).alias(f"{s}_{c}") for p, s in (("abnormal", "a"), ("normal", "b")) for c in names]
    seen = [F.max(F.col("period") == p).alias(s) for p, s in (("abnormal", "a_seen"), ("normal", "b_seen"))]
    return both.groupBy("datapack", "endpoint").agg(*side, *seen).where("a_seen").drop("a_seen")


def success_drop(a_good: Column, a_told: Column, b_good: Column, b_told: Column) -> tuple[Column, dict[str, Column]]:
    """(whether the success rate fell significantly, what was found): pooled two-proportion z test, drops of more than 0.03 and a tenth."""
    a, b = ratio(a_good, a_told), ratio(b_good, b_told)
    pooled = (a_good + b_good) / (a_told + b_told)
    se = F.sqrt(pooled * (1 - pooled) * (1 / b_told + 1 / a_told))
    z = F.try_divide(F.abs(a - b), se)
    p, drop = two_sided_p(z), b - a
    enough = (b_told >= 10) & (a_told >= 5)
    hit = F.when(enough, se > 0).otherwise(False) & (drop > 0.03) & (p < 0.05) & (drop > 0.1 * b)
    return F.coalesce(hit, F.lit(False)), {"normal": b, "abnormal": a, "p_value": p, "z_statistic": z, "change_rate": ratio(drop, b), "rate_drop": drop}


def conclude(entries: DataFrame) -> DataFrame:
    """Per abnormal endpoint: both periods' numbers, its issues as JSON, and what they are.

    issues: an object by issue (avg_duration, p90_duration, p95_duration, p99_duration, hard_timeout, succ_rate), ``{}`` if
    there is none. Latencies of an endpoint with a normal period follow the ladder of detectors.Latency against
    their band of normal durations; its success rate a significance test. Without one, fixed limits hold.
    latency_issue and success_issue tell the kinds, significant whether a latency is over 10 s, absolute whether a
    hard rule or the significance test was broken. Columns abnormal_* and normal_* are null where nothing was seen.
    """
    numbers = endpoint_numbers(entries)
    bands = band_stats(entries.where("period = 'normal'"), ["datapack", "endpoint"], F.col("duration") / 1e9, BANDS)
    both = numbers.join(bands, ["datapack", "endpoint"], "left")
    new = F.col("b_seen").isNull() | ~F.col("b_seen")
    issues, latency, hard = {}, F.lit(False), F.lit(False)
    yes, lit = F.lit(True).alias("slo_violated"), lambda x: F.lit(x).alias("detection_reason")
    number = lambda c, name: c.cast("double").alias(name)
    cell = lambda *fields: F.to_json(F.struct(*fields))
    for k, name in NAMES.items():
        value = F.col(f"a_{k}")
        rule, _ = Latency(k).rule(value, F.col(f"{k}_n"), F.col(f"{k}_mean"), F.col(f"{k}_p99"))
        score = F.when(rule == "hard_timeout", 1.0).otherwise(0.0)
        known = cell(number(F.col(f"b_{k}"), "normal"), number(value, "abnormal"), score.alias("anomaly_score"), number(ratio(value - F.col(f"{k}_mean"), F.col(f"{k}_mean")), "change_rate"), number(value, "absolute_change"), yes)
        fresh = cell(F.lit(0.0).alias("normal"), number(value, "abnormal"), F.lit(NEW_LIMITS[k]).alias("threshold"), F.lit("inf").alias("change_rate"), number(value, "absolute_change"), yes, lit("new_endpoint_threshold_exceeded"))
        hit = F.coalesce(F.when(new, value > NEW_LIMITS[k]).otherwise(rule.isNotNull()), F.lit(False))
        issues[name] = F.when(hit, F.when(new, fresh).otherwise(known))
        latency, hard = latency | hit, hard | (~new & hit & (value > Latency().hard_timeout))
    timeout = new & F.coalesce(F.col("a_avg") > Latency().hard_timeout, F.lit(False))
    issues["hard_timeout"] = F.when(timeout, cell(F.lit(Latency().hard_timeout).alias("threshold"), number(F.col("a_avg"), "abnormal"), yes, lit("hard_timeout_exceeded")))
    fell, told = success_drop(F.col("a_good"), F.col("a_told"), F.coalesce("b_good", F.lit(0)), F.coalesce("b_told", F.lit(0)))
    rate = ratio(F.col("a_good"), F.col("a_told"))
    low = new & (F.col("a_told") > 0) & (rate < NEW_SUCCESS)
    failing = F.coalesce(F.when(new, low).otherwise(fell), F.lit(False))
    fresh = cell(F.lit(1.0).alias("normal"), number(rate, "abnormal"), F.lit(NEW_SUCCESS).alias("threshold"), number(1 - rate, "rate_drop"), yes, lit("new_endpoint_low_success_rate"))
    issues["succ_rate"] = F.when(failing, F.when(new, fresh).otherwise(cell(*[number(c, n) for n, c in told.items()], yes)))
    # each issue is JSON already: members are put together as text
    members = F.array_compact(F.array(*[F.concat(F.lit(f'"{n}": '), c) for n, c in issues.items()]))
    significant = F.greatest(*[F.coalesce(F.col(f"a_{k}"), F.lit(0.0)) for k in NAMES]) > SIGNIFICANT_S
    shown = [F.col(f"{s}_{k}").alias(f"{p}_{n}") for s, p in (("a", "abnormal"), ("b", "normal")) for k, n in NAMES.items()]
    rates = [F.try_divide(F.col(f"{s}_good"), F.col(f"{s}_told")).alias(f"{p}_succ_rate") for s, p in (("a", "abnormal"), ("b", "normal"))]
    return both.select(
        "datapack", "endpoint", *shown, *rates, F.concat(F.lit("{"), F.array_join(members, ", "), F.lit("}")).alias("issues"),
        new.alias("is_new"), (latency | timeout).alias("latency_issue"), failing.alias("success_issue"), significant.alias("significant"), (hard | (~new & failing)).alias("absolute"),
    )


def summarize_datapack(concluded: DataFrame) -> DataFrame:
    """Per datapack of conclude(): endpoints, new ones, those with issues, how many are of latency (over 10 s only), of success or of both, and tags.

    tag: absolute_anomaly if a hard rule or the significance test was broken; may_anomaly if there are categorised issues
    and any endpoint is over 10 s; else no_anomaly. kind: the first category that occurs, of latency, success, mixed.
    """
    late, bad = F.col("latency_issue") & F.col("significant"), F.col("success_issue")
    g = concluded.groupBy("datapack").agg(
        F.count(F.lit(1)).alias("endpoints"), F.count_if("is_new").alias("new_endpoints"), F.count_if(F.col("issues") != "{}").alias("anomalies"), F.count_if(late & ~bad).alias("latency_only"), F.count_if(~late & bad).alias("success_only"),
        F.count_if(late & bad).alias("mixed"), F.count_if(~late & ~bad).alias("no_issues"), F.bool_or("absolute").alias("absolute"), F.bool_or("significant").alias("slow"),
    )
    some = F.col("latency_only") + F.col("success_only") + F.col("mixed") > 0
    tag = F.when(F.col("absolute"), "absolute_anomaly").when(some & F.col("slow"), "may_anomaly").otherwise("no_anomaly")
    kind = F.when(F.col("latency_only") > 0, "has_latency_issues").when(F.col("success_only") > 0, "has_success_rate_issues").when(F.col("mixed") > 0, "has_mixed_issues")
    latency_only = (F.col("latency_only") > 0) & (F.col("success_only") == 0) & (F.col("mixed") == 0)
    return g.select(*[c for c in g.columns if c not in ("absolute", "slow")], tag.alias("tag"), kind.alias("kind"), latency_only.alias("is_latency_only"))
