"""Detectors of single values against a history, and which of them a kind of metric gets.

Each detector is a column: null, or a struct (method, anomaly_type, severity, confidence). It reads the value and the
columns that history() gives a series, so that any number of detectors runs over one join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracejobs.functions.ranked import order_stats


def severity(x: Column, steps: list[tuple[float, str]]) -> Column:
    """The first step, from the greatest, that x reaches; else low."""
    out = F.lit("low")
    for least, name in sorted(steps):
        out = F.when(x >= least, name).otherwise(out)
    return out


def _found(method: str, when: Column, kind: Column | str, level: Column, confidence: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.when(when, F.struct(F.lit(method).alias("method"), kind.alias("anomaly_type"), level.alias("severity"), confidence.cast("double").alias("confidence")))


# Fixed values in the classes below: the detectors' default settings.
@dataclass(frozen=True)
class Threshold:
    """Above ``high``, else below ``low``; the ratio to the bound gives severity and confidence."""

    high: float | None = None
    low: float | None = None
    critical: float = 2.0

    def detect(self, value: Column) -> Column:
        over = value > self.high if self.high is not None else F.lit(False)
        under = ~over & (value < self.low) if self.low is not None else F.lit(False)
        down = F.lit(self.low) / F.greatest(value, F.lit(0.001)) if self.low is not None and self.low > 0 else F.lit(1.5)
        ratio = F.when(over, value / self.high).otherwise(down) if self.high else down
        level = severity(ratio, [(self.critical, "critical"), (1.5, "high"), (1.2, "medium")])
        # where a stricter critical ratio is below the one of high, critical wins
        level = F.when(ratio >= self.critical, "critical").otherwise(level)
        return _found("threshold", over | under, F.when(over, "threshold_high").otherwise("threshold_low"), level, F.least(ratio, F.lit(self.critical)) / self.critical)


@dataclass(frozen=True)
class Statistical:
    """Farther than ``z`` population deviations from the mean, else beyond the quartiles by more than ``iqr`` of their distance; at least five values."""

    z: float = 3.0
    iqr: float = 1.5

    def detect(self, value: Column) -> Column:
        sd, spread = F.col("h_sd"), F.col("h_q3") - F.col("h_q1")
        score = F.when(sd > 0, F.abs(value - F.col("h_mean")) / F.when(sd > 0, sd))
        level = severity(score, [(4.0, "critical"), (3.5, "high"), (3.0, "medium")])
        far = _found("statistical", score > self.z, "statistical_outlier", level, F.least(score / self.z, F.lit(4.0)) / 4.0)
        low, high = F.col("h_q1") - self.iqr * spread, F.col("h_q3") + self.iqr * spread
        sure = F.least(F.try_divide(F.greatest(low - value, value - high, F.lit(0.0)), spread * self.iqr), F.lit(1.0))
        out = _found("statistical", (spread > 0) & ((value < low) | (value > high)), "statistical_outlier", severity(sure, [(0.8, "high"), (0.5, "medium")]), sure)
        return F.when(F.col("h_n") >= 5, F.coalesce(far, out))


@dataclass(frozen=True)
class Trend:
    """Farther than ``times`` deviations from the mean of the last ``window`` values."""

    window: int = 10
    times: float = 2.0

    def detect(self, value: Column) -> Column:
        mean, sd, n = (F.col(f"h_{c}_{self.window}") for c in ("mean", "sd", "last"))
        away = F.when((sd > 0) & (n >= self.window), (value - mean) / F.when(sd > 0, sd))
        level = severity(F.abs(away), [(4.0, "critical"), (3.0, "high"), (2.0, "medium")])
        beyond = (value > mean + self.times * sd) | (value < mean - self.times * sd)
        return _found("trend", away.isNotNull() & beyond, F.when(away > 0, "trend_spike").otherwise("trend_drop"), level, F.least(F.abs(away) / self.times, F.lit(1.0)))


#: Fixed values by what the latency is: greatest mean of a history that is judged, absolute limit over short ones, greatest and least factor over longer ones.
LATENCY = {"avg": (1.0, 2.0, 3.0, 1.5), "p90": (1.5, 4.0, 6.0, 4.0), "p95": (2.0, 4.5, 7.5, 4.5), "p99": (3.0, 5.0, 8.0, 5.0)}


@dataclass(frozen=True)
class Latency:
    """Latencies in seconds, rule by rule: see rule()."""

    percentile: str = "avg"
    hard_timeout: float = 15.0

    def rule(self, value: Column, n: Column, mean: Column, p99: Column) -> tuple[Column, Column]:
        """(the rule that the value breaks or null, the bound it is over).

        A history of fewer than five values, with a mean over 1 s or a p99 over 5 s is not judged, nor is a value up to the
        mean. Then: over the hard timeout; over an absolute limit where the mean is below 0.5 s; else over the mean
        times a factor that falls evenly from its greatest value at 0.5 s to its least at 2 s.
        """
        usual, absolute, most, least = LATENCY[self.percentile]
        factor = F.when(mean >= 2.0, least).otherwise(most - (mean - 0.5) / 1.5 * (most - least))
        bound = F.when(value > self.hard_timeout, self.hard_timeout).when(mean < 0.5, absolute).otherwise(mean * factor)
        name = F.when(value > self.hard_timeout, "hard_timeout").when((mean > usual) | (value <= bound), None).when(mean < 0.5, "absolute").otherwise("multiplier")
        return F.when((n >= 5) & (mean <= 1.0) & (p99 <= 5.0) & (value > mean), name), bound

    def detect(self, value: Column) -> Column:
        name, _ = self.rule(value, F.col("h_n"), F.col("h_mean"), F.col("h_p99"))
        hard = name == "hard_timeout"
        return _found("enhanced_latency", name.isNotNull(), "threshold_high", F.when(hard, "critical").otherwise("low"), F.when(hard, 1.0).otherwise(0.0))


#: The detectors of a kind of metric, at its usual, a strict and a relaxed setting.
PRESETS: dict[tuple[str, str], tuple] = {
    ("latency", "usual"): (Threshold(high=1000.0), Statistical(2.5), Latency("avg")),
    ("latency", "strict"): (Threshold(high=500.0, critical=1.5), Statistical(2.0), Trend(times=1.5), Latency("p95", 10.0)),
    ("latency", "relaxed"): (Threshold(high=5000.0), Statistical(3.5)),
    ("traffic", "usual"): (Threshold(low=1.0), Statistical(3.0), Trend(times=3.0)),
    ("traffic", "strict"): (Threshold(low=100.0), Statistical(2.5), Trend(window=15, times=2.5)),
    ("traffic", "relaxed"): (Trend(window=20, times=3.0), Statistical(3.0)),
    ("error", "usual"): (Threshold(high=5.0), Statistical(2.0)),
    ("error", "strict"): (Threshold(high=1.0, critical=1.5), Statistical(1.5), Trend(times=1.2)),
    ("saturation", "usual"): (Threshold(high=80.0), Statistical(2.5), Trend(times=2.0)),
    ("saturation", "strict"): (Threshold(high=70.0, critical=1.3), Statistical(2.0), Trend(times=1.5)),
}


def history(metrics: DataFrame, keys: list[str], windows: list[int]) -> DataFrame:
    """Per series, of its normal values: h_n, h_mean, h_sd (population), h_q1, h_q3, h_p99, and mean and deviation of the last values of each window length.

    Of a series only the last values leave the map side for the window; quartiles run over counted values.
    """
    normal = metrics.where("period = 'normal' AND value IS NOT NULL")
    out = normal.groupBy(*keys).agg(F.avg("value").alias("h_mean"), F.stddev_pop("value").alias("h_sd"))
    stats = order_stats(normal, keys, F.col("value"), {"h_q1": 0.25, "h_q3": 0.75, "h_p99": 0.99}).withColumnRenamed("n", "h_n")
    out = out.join(stats, keys)
    if windows:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("time"), F.desc("seq")))
        last = normal.select(*keys, "value", place.alias("place")).where(F.col("place") <= max(windows))
        of = lambda f, w: f(F.when(F.col("place") <= w, F.col("value")))
        out = out.join(last.groupBy(*keys).agg(*[c for w in windows for c in (of(F.count, w).alias(f"h_last_{w}"), of(F.avg, w).alias(f"h_mean_{w}"), of(F.stddev_pop, w).alias(f"h_sd_{w}"))]), keys)
    return out


def detect_all(metrics: DataFrame, detectors: tuple, keys: list[str]) -> DataFrame:
    """(keys, seq, value, method, anomaly_type, severity, confidence): every abnormal value that a detector finds, by each that does.

    metrics: (keys, period, time, seq, value). Series without a normal history are judged by thresholds alone.
    """
    known = history(metrics, keys, sorted({d.window for d in detectors if isinstance(d, Trend)}))
    rows = metrics.where("period = 'abnormal' AND value IS NOT NULL").select(*keys, "seq", "value").join(known, keys, "left")
    return rows.select(*keys, "seq", "value", F.inline(F.array_compact(F.array(*[d.detect(F.col("value")) for d in detectors]))))


def summarize(found: DataFrame, keys: list[str]) -> DataFrame:
    """Per series with anomalies: how many, by severity, the methods and types that found them (sorted), the greatest confidence."""
    levels = ("critical", "high", "medium", "low")
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return found.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("severity") == x).alias(x) for x in levels], listed("method").alias("methods"), listed("anomaly_type").alias("types"), F.round(F.max("confidence"), 6).alias("max_confidence"))
