"""Detectors and conclusions on values whose outcome is known, and the normal tail."""

import json
import math
from statistics import NormalDist

from pyspark.sql import functions as F

from tracejobs.functions.normal import erf, two_sided_p
from tracejobs.operators import conclude, detectors

KEYS = ["k"]


def one(spark, detector, history, value):
    """(type, severity, confidence) of a value after a history, or None."""
    rows = [("a", "normal", i, float(v)) for i, v in enumerate(history)] + [("a", "abnormal", 99, value)]
    df = spark.createDataFrame(rows, "k string, period string, seq long, value double").withColumn("time", F.timestamp_seconds("seq"))
    found = detectors.detect_all(df, (detector,), KEYS).collect()
    return (found[0].anomaly_type, found[0].severity, round(found[0].confidence, 6)) if found else None


def test_normal_tail(spark):
    z = [0.0, 0.1, 1.0, 1.959964, 3.0, 5.5, 9.0, 40.0]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(z)], "i int, z double").select("i", erf(F.col("z")).alias("e"), two_sided_p(-F.col("z")).alias("p")).collect()
    for r in got:
        assert abs(r.e - math.erf(z[r.i])) < 1e-14 and abs(r.p - 2 * NormalDist().cdf(-z[r.i])) < 1e-14


def test_threshold(spark):
    t = detectors.Threshold
    assert one(spark, t(high=10.0), [], 20.0) == ("threshold_high", "critical", 1.0)
    assert one(spark, t(high=10.0), [], 13.0) == ("threshold_high", "medium", 0.65)
    assert one(spark, t(high=10.0, critical=1.3), [], 14.0) == ("threshold_high", "critical", 1.0)
    assert one(spark, t(low=1.0), [], 0.0) == ("threshold_low", "critical", 1.0)
    assert one(spark, t(low=-1.0), [], -2.0) == ("threshold_low", "high", 0.75)
    assert one(spark, t(low=1.0, high=10.0), [], 5.0) is None


def test_statistical(spark):
    s = detectors.Statistical
    assert one(spark, s(2.5), [1, 2, 3, 4.0], 99.0) is None  # too few
    assert one(spark, s(2.5), [1, 2, 3, 4, 5.0], 3 + math.sqrt(2) * 3.6) == ("statistical_outlier", "high", round(3.6 / 2.5 / 4, 6))
    # within three deviations, but beyond the quartiles 2 and 4 by more than 0.5 times their distance
    assert one(spark, s(3.0, 0.5), [1, 2, 3, 4, 5.0], 5.6) == ("statistical_outlier", "medium", 0.6)
    assert one(spark, s(), [2.0] * 6, 50.0) is None


def test_trend(spark):
    t = detectors.Trend
    assert one(spark, t(4), [100, 1, 2, 3, 4.0], 2.5 - 3.5 * math.sqrt(1.25)) == ("trend_drop", "high", 1.0)
    assert one(spark, t(4), [100, 1, 2, 3, 4.0], 4.0) is None
    assert one(spark, t(6), [100, 1, 2, 3, 4.0], 400.0) is None


def test_latency_ladder(spark):
    lat = detectors.Latency
    assert one(spark, lat(), [0.1] * 4, 20.0) is None  # too few
    assert one(spark, lat(), [1.1] * 5, 20.0) is None  # slow before
    assert one(spark, lat(), [0.1] * 50 + [20.0], 20.0) is None  # unstable before: p99 over 5 s
    assert one(spark, lat(), [0.1] * 5, 15.1) == ("threshold_high", "critical", 1.0)
    assert one(spark, lat(), [0.1] * 5, 2.1) == ("threshold_high", "low", 0.0) and one(spark, lat(), [0.1] * 5, 2.0) is None
    # at 0.8 s the factor is 3 - 0.3 / 1.5 * 1.5 = 2.7
    assert one(spark, lat(), [0.8] * 5, 2.17) == ("threshold_high", "low", 0.0) and one(spark, lat(), [0.8] * 5, 2.15) is None
    assert one(spark, lat("p99"), [0.4] * 5, 4.9) is None and one(spark, lat("p99"), [0.4] * 5, 5.1) is not None


def test_summary(spark):
    rows = [("a", "threshold", "threshold_high", "critical", 1.0), ("a", "trend", "trend_spike", "low", 0.25), ("a", "trend", "trend_drop", "low", 0.5)]
    (r,) = detectors.summarize(spark.createDataFrame(rows, "k string, method string, anomaly_type string, severity string, confidence double"), KEYS).collect()
    assert tuple(r) == ("a", 3, 1, 0, 0, 2, "threshold,trend", "threshold_high,trend_drop,trend_spike", 1.0)


ENTRIES = "datapack string, period string, endpoint string, duration long, status string"


def entries(period, endpoint, seconds, statuses):
    return [("d", period, endpoint, int(s * 1e9), x) for s, x in zip(seconds, statuses)]


def test_conclusion_and_summary(spark):
    ok, n = ["200"] * 200, 200
    rows = entries("normal", "fine", [0.1] * n, ok) + entries("abnormal", "fine", [0.1] * n, ok)
    rows += entries("normal", "late", [0.1] * n, ok) + entries("abnormal", "late", [16.0] * n, ok)
    rows += entries("normal", "down", [0.1] * n, ok) + entries("abnormal", "down", [0.1] * n, ["200"] * 100 + ["500"] * 100)
    rows += entries("abnormal", "new", [4.0] * n, ["200"] * 170 + ["500"] * 20 + [None] * 10) + entries("normal", "gone", [0.1] * n, ok)
    rows += entries("normal", "silent", [0.1] * n, [None] * n) + entries("abnormal", "silent", [0.2] * n, [None] * n)
    found = conclude.conclude(spark.createDataFrame(rows, ENTRIES).repartition(3))
    got = {r.endpoint: r for r in found.collect()}
    assert set(got) == {"fine", "late", "down", "new", "silent"}
    issues = {k: json.loads(r.issues) for k, r in got.items()}
    assert issues["fine"] == {} and issues["silent"] == {} and got["silent"].abnormal_succ_rate is None
    assert set(issues["late"]) == {"avg_duration", "p90_duration", "p95_duration", "p99_duration"}
    assert issues["late"]["avg_duration"] == {"normal": 0.1, "abnormal": 16.0, "anomaly_score": 1.0, "change_rate": 159.0, "absolute_change": 16.0, "slo_violated": True}
    assert set(issues["down"]) == {"succ_rate"} and issues["down"]["succ_rate"]["rate_drop"] == 0.5
    z = 0.5 / math.sqrt(0.75 * 0.25 * 0.01)
    assert abs(issues["down"]["succ_rate"]["z_statistic"] - z) < 1e-9 and abs(issues["down"]["succ_rate"]["p_value"] - 2 * NormalDist().cdf(-z)) < 1e-12
    assert issues["new"] == {"avg_duration": {"normal": 0.0, "abnormal": 4.0, "threshold": 3.0, "change_rate": "inf", "absolute_change": 4.0, "slo_violated": True, "detection_reason": "new_endpoint_threshold_exceeded"},
                             "succ_rate": {"normal": 1.0, "abnormal": 17 / 19, "threshold": 0.9, "rate_drop": 1 - 17 / 19, "slo_violated": True, "detection_reason": "new_endpoint_low_success_rate"}}
    assert [got[k].absolute for k in ("late", "down", "new", "fine")] == [True, True, False, False]
    (s,) = conclude.summarize_datapack(found).collect()
    assert tuple(s) == ("d", 5, 1, 3, 1, 2, 0, 2, "absolute_anomaly", "has_latency_issues", False)
    # a new endpoint at 4 s alone: a success issue, but nothing over 10 s
    (s,) = conclude.summarize_datapack(found.where("endpoint IN ('fine', 'new')")).collect()
    assert (s.tag, s.kind) == ("no_anomaly", "has_success_rate_issues")
    assert conclude.conclude(spark.createDataFrame([], ENTRIES)).count() == 0
