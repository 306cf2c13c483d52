"""Queries of the detectors' registry and conclusions over the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracejobs.operators import conclude, detectors
from tracejobs.queries import _add, _p_sql
from tracejobs.sources import fixtures as fx

_SCALE, _FACTOR = (0.002, 0.008, 0.02, 0.06, 0.3), (1.0, 2.0, 5.0, 12.0, 30.0, 1.0, 300.0)


def _pick(values: tuple[float, ...], digit: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), digit.cast("int") + 1)


def _entries(spans: DataFrame) -> DataFrame:
    """Root spans as requests of seconds and milliseconds: an operation's digit scales them, a service's slows the abnormal period."""
    svc, op, bad = F.substring("span_name", 16, 1), F.substring("span_name", 20, 1), F.col("period") == "abnormal"
    duration = F.floor(F.col("duration") * _pick(_SCALE, op) * F.when(bad, _pick(_FACTOR, svc)).otherwise(1.0))
    status = F.when((F.col("status_code") == "Unset") & (F.col("trace_id") % 2 == 0), None).when(~bad & (op != "0"), "200").otherwise(F.col("http_status").cast("string"))
    return spans.where("parent_span_id = ''").where(bad | ~((svc == "5") & (op == "1"))).select("datapack", "period", F.col("span_name").alias("endpoint"), duration.cast("long").alias("duration"), status.alias("status"))


def _list(values: tuple[float, ...]) -> str:
    return "[" + ", ".join(f"CAST({v} AS DOUBLE)" for v in values) + "]"


_SVC, _OP = "CAST(substr(span_name, 16, 1) AS INT)", "CAST(substr(span_name, 20, 1) AS INT)"
_ENTRIES = f"""entries AS (SELECT datapack, period, span_name AS endpoint, CAST(floor(duration * {_list(_SCALE)}[{_OP} + 1] * CASE WHEN period = 'abnormal' THEN {_list(_FACTOR)}[{_SVC} + 1] ELSE 1 END) AS BIGINT) AS duration,
  CASE WHEN status_code = 'Unset' AND trace_id % 2 = 0 THEN NULL WHEN period = 'normal' AND {_OP} <> 0 THEN '200' ELSE CAST(http_status AS VARCHAR) END AS status FROM spans WHERE parent_span_id = '' AND (period = 'abnormal' OR NOT ({_SVC} = 5 AND {_OP} = 1)))"""
_WHERE = {"avg": "true", "p90": ("0.85", "0.95"), "p95": ("0.90", "0.99"), "p99": ("0.95", "1.0")}


def _band(k: str) -> str:
    """Ranked durations of a band; all of them where it is empty."""
    if k == "avg":
        return "true"
    lo, hi = (f"floor(n * CAST({x} AS DOUBLE))" for x in _WHERE[k])
    return f"({lo} >= {hi} OR (i >= {lo} AND i < {hi}))"


def _rule(k: str) -> str:
    usual, absolute, most, least = detectors.LATENCY[k]
    v, m = f"a_{k}", f"{k}_mean"
    return f"""CASE WHEN {k}_n < 5 OR {m} > 1.0 OR {k}_p99 > 5.0 OR {v} <= {m} OR {m} IS NULL THEN NULL WHEN {v} > 15.0 THEN 'hard_timeout' WHEN {m} > {usual} THEN NULL WHEN {m} < 0.5 THEN CASE WHEN {v} > {absolute} THEN 'absolute' END
      WHEN {v} > {m} * (CASE WHEN {m} >= 2 THEN {least} ELSE CAST({most} AS DOUBLE) - ({m} - 0.5) / CAST(1.5 AS DOUBLE) * CAST({most - least} AS DOUBLE) END) THEN 'multiplier' END"""


_K = ("avg", "p90", "p95", "p99")
_CONCLUDED = f"""{_ENTRIES}, num AS (SELECT datapack, endpoint, bool_or(period = 'normal') AS seen, {', '.join(f"avg(duration) FILTER (period = '{p}') / 1e9 AS {s}_avg, {', '.join(f'''quantile_cont(duration / 1e9, 0.{q}) FILTER (period = '{p}') AS {s}_p{q}''' for q in (90, 95, 99))}, count(status) FILTER (period = '{p}') AS {s}_told, count(*) FILTER (period = '{p}' AND status = '200') AS {s}_good" for p, s in (('abnormal', 'a'), ('normal', 'b')))}
  FROM entries GROUP BY ALL HAVING bool_or(period = 'abnormal')),
rk AS (SELECT datapack, endpoint, duration / 1e9 AS s, row_number() OVER (PARTITION BY datapack, endpoint ORDER BY duration) - 1 AS i, count(*) OVER (PARTITION BY datapack, endpoint) AS n FROM entries WHERE period = 'normal'),
bands AS (SELECT datapack, endpoint, {', '.join(f'count(*) FILTER ({_band(k)}) AS {k}_n, avg(s) FILTER ({_band(k)}) AS {k}_mean, quantile_cont(s, 0.99) FILTER ({_band(k)}) AS {k}_p99' for k in _K)} FROM rk GROUP BY ALL),
j AS (SELECT num.*, {', '.join(f'{k}_n, {k}_mean, {k}_p99' for k in _K)}, NOT seen AS is_new, coalesce(a_good / nullif(a_told, 0), 0) AS ra, coalesce(b_good / nullif(b_told, 0), 0) AS rb FROM num LEFT JOIN bands USING (datapack, endpoint)),
t AS (SELECT *, (a_good + b_good) / nullif(a_told + b_told, 0) AS pooled FROM j), u AS (SELECT *, sqrt(pooled * (1 - pooled) * (1 / nullif(b_told, 0) + 1 / nullif(a_told, 0))) AS se FROM t),
z AS (SELECT *, CASE WHEN se > 0 THEN abs(ra - rb) / se END AS zs, rb - ra AS fall FROM u), y AS (SELECT *, {_p_sql('zs')} AS p FROM z),
x AS (SELECT *, {', '.join(f"coalesce(CASE WHEN is_new THEN a_{k} > {conclude.NEW_LIMITS[k]} ELSE ({_rule(k)}) IS NOT NULL END, false) AS i_{k}" for k in _K)}, is_new AND a_avg > 15 AS i_hard,
  coalesce(CASE WHEN is_new THEN a_told > 0 AND ra < CAST(0.9 AS DOUBLE) ELSE b_told >= 10 AND a_told >= 5 AND se > 0 AND fall > CAST(0.03 AS DOUBLE) AND p < CAST(0.05 AS DOUBLE) AND fall > CAST(0.1 AS DOUBLE) * rb END, false) AS i_succ FROM y),
w AS (SELECT *, i_avg OR i_p90 OR i_p95 OR i_p99 OR i_hard AS latency_issue, greatest(a_avg, a_p90, a_p95, a_p99) > 10 AS significant, (NOT is_new) AND (i_succ OR {' OR '.join(f'(i_{k} AND a_{k} > 15)' for k in _K)}) AS absolute,
  array_to_string(list_filter([{', '.join(f"CASE WHEN i_{k} THEN '{conclude.NAMES[k]}' END" for k in _K)}, CASE WHEN i_hard THEN 'hard_timeout' END, CASE WHEN i_succ THEN 'succ_rate' END], lambda v: v IS NOT NULL), ',') AS names FROM x)"""


def _concluded(spark: SparkSession, d: str) -> DataFrame:
    """The conclusion with its JSON read again: which issues there are, and some of their numbers."""
    out = conclude.conclude(_entries(fx.spans(spark, d)))
    get = lambda path: F.round(F.get_json_object("issues", f"$.{path}").cast("double"), 4)
    numbers = [F.round(c, 12).alias(c) for c in out.columns if c.startswith(("abnormal_", "normal_"))]
    return out.select("datapack", "endpoint", *numbers, F.coalesce(F.array_join(F.json_object_keys("issues"), ","), F.lit("")).alias("names"), F.when(~F.col("is_new"), get("avg_duration.change_rate")).alias("avg_change"), get("p99_duration.abnormal").alias("p99_abnormal"), get("succ_rate.p_value").alias("p_value"), get("succ_rate.rate_drop").alias("rate_drop"), "latency_issue", "significant", "absolute")


_add("d07_endpoint_conclusion", _concluded, f"""WITH {_CONCLUDED} SELECT datapack, endpoint, {', '.join(f"round({s}_{k}, 12) AS {p}_{conclude.NAMES[k]}" for s, p in (('a', 'abnormal'), ('b', 'normal')) for k in _K)}, round(a_good / nullif(a_told, 0), 12) AS abnormal_succ_rate, round(b_good / nullif(b_told, 0), 12) AS normal_succ_rate, names,
  round(CASE WHEN i_avg AND NOT is_new THEN coalesce((a_avg - avg_mean) / nullif(avg_mean, 0), 0) END, 4) AS avg_change, round(CASE WHEN i_p99 THEN a_p99 END, 4) AS p99_abnormal, round(CASE WHEN i_succ AND NOT is_new THEN p END, 4) AS p_value, round(CASE WHEN i_succ THEN CASE WHEN is_new THEN 1 - ra ELSE fall END END, 4) AS rate_drop, latency_issue, significant, absolute FROM w""", "spans")
_add("d04_latency_rules", lambda s, d: _rules(s, d), f"""WITH {_CONCLUDED}, l AS ({' UNION ALL '.join(f"SELECT datapack, endpoint, '{k}' AS percentile, {k}_n AS n, round({k}_mean, 4) AS mean, round({k}_p99, 4) AS p99, round(a_{k}, 4) AS value, {_rule(k)} AS rule FROM y WHERE NOT is_new" for k in _K)}) SELECT * FROM l WHERE rule IS NOT NULL""", "spans")
_add("d08_datapack_tags", lambda s, d: conclude.summarize_datapack(conclude.conclude(_entries(fx.spans(s, d)))), f"""WITH {_CONCLUDED}, g AS (SELECT datapack, count(*) AS endpoints, count(*) FILTER (is_new) AS new_endpoints, count(*) FILTER (names <> '') AS anomalies, count(*) FILTER (latency_issue AND significant AND NOT i_succ) AS latency_only,
  count(*) FILTER (NOT (latency_issue AND significant) AND i_succ) AS success_only, count(*) FILTER (latency_issue AND significant AND i_succ) AS mixed, count(*) FILTER (NOT (latency_issue AND significant) AND NOT i_succ) AS no_issues, bool_or(absolute) AS hard, bool_or(significant) AS slow FROM w GROUP BY ALL)
SELECT * EXCLUDE (hard, slow), CASE WHEN hard THEN 'absolute_anomaly' WHEN latency_only + success_only + mixed > 0 AND slow THEN 'may_anomaly' ELSE 'no_anomaly' END AS tag, CASE WHEN latency_only > 0 THEN 'has_latency_issues' WHEN success_only > 0 THEN 'has_success_rate_issues' WHEN mixed > 0 THEN 'has_mixed_issues' END AS kind,
  latency_only > 0 AND success_only = 0 AND mixed = 0 AS is_latency_only FROM g""", "spans")


def _rules(spark: SparkSession, d: str) -> DataFrame:
    """Each endpoint's percentiles and the rule of the ladder that they break."""
    from tracejobs.functions.ranked import band_stats

    entries = _entries(fx.spans(spark, d))
    both = conclude.endpoint_numbers(entries).join(band_stats(entries.where("period = 'normal'"), ["datapack", "endpoint"], F.col("duration") / 1e9, conclude.BANDS), ["datapack", "endpoint"])
    rows = [F.struct(F.lit(k).alias("percentile"), F.col(f"{k}_n").alias("n"), F.round(f"{k}_mean", 4).alias("mean"), F.round(f"{k}_p99", 4).alias("p99"), F.round(f"a_{k}", 4).alias("value"), detectors.Latency(k).rule(F.col(f"a_{k}"), F.col(f"{k}_n"), F.col(f"{k}_mean"), F.col(f"{k}_p99"))[0].alias("rule")) for k in _K]
    return both.select("datapack", "endpoint", F.inline(F.array(*rows))).where("rule IS NOT NULL")


# Values of a kind of metric in its usual range: events are clicks and so on, of 0 to 100 and more
_KIND = {"click": "latency", "view": "traffic", "error": "error", "purchase": "saturation"}
_KEYS = ["datapack", "service_name", "metric"]


def _by_kind(spark: SparkSession, d: str, level: str = "usual") -> DataFrame:
    """All presets' anomalies: each kind of metric with its own detectors."""
    metrics = fx.metrics(spark, d)
    found = [detectors.detect_all(metrics.where(F.col("metric") == m), detectors.PRESETS[kind, level], _KEYS) for m, kind in _KIND.items()]
    out = found[0]
    for one in found[1:]:
        out = out.unionByName(one)
    return out


def _level(x: str, steps: tuple[tuple[float, str], ...]) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {v} THEN '{n}'" for v, n in steps) + " ELSE 'low' END"


def _method_sql(metric: str, one: object) -> str:
    head = f"SELECT datapack, service_name, metric, seq, value, '{{m}}' AS method, {{t}} AS anomaly_type, {{s}} AS severity, {{c}} AS confidence FROM v WHERE metric = '{metric}' AND {{w}}"
    if isinstance(one, detectors.Threshold):
        steps = ((one.critical, "critical"), (1.5, "high"), (1.2, "medium"))
        r = f"(value / {one.high})" if one.high else f"({one.low} / greatest(value, CAST(0.001 AS DOUBLE)))"
        return head.format(m="threshold", t="'threshold_high'" if one.high else "'threshold_low'", s=_level(r, steps), c=f"least({r}, {one.critical}) / {one.critical}", w=f"value > {one.high}" if one.high else f"value < {one.low}")
    if isinstance(one, detectors.Statistical):
        z = "(abs(value - h_mean) / nullif(h_sd, 0))"
        lo, hi, d = f"(h_q1 - {one.iqr} * (h_q3 - h_q1))", f"(h_q3 + {one.iqr} * (h_q3 - h_q1))", f"({one.iqr} * nullif(h_q3 - h_q1, 0))"
        sure = f"least(greatest({lo} - value, value - {hi}, 0) / {d}, 1)"
        a = head.format(m="statistical", t="'statistical_outlier'", s=_level(z, ((4.0, "critical"), (3.5, "high"), (3.0, "medium"))), c=f"least({z} / {one.z}, 4) / 4", w=f"h_n >= 5 AND {z} > {one.z}")
        b = head.format(m="statistical", t="'statistical_outlier'", s=_level(sure, ((0.8, "high"), (0.5, "medium"))), c=sure, w=f"h_n >= 5 AND NOT coalesce({z} > {one.z}, false) AND h_q3 > h_q1 AND (value < {lo} OR value > {hi})")
        return f"{a} UNION ALL {b}"
    if isinstance(one, detectors.Trend):
        r = f"((value - m{one.window}) / nullif(s{one.window}, 0))"
        return head.format(m="trend", t=f"CASE WHEN {r} > 0 THEN 'trend_spike' ELSE 'trend_drop' END", s=_level(f"abs({r})", ((4.0, "critical"), (3.0, "high"), (2.0, "medium"))), c=f"least(abs({r}) / {one.times}, 1)", w=f"n{one.window} >= {one.window} AND s{one.window} > 0 AND (value > m{one.window} + {one.times} * s{one.window} OR value < m{one.window} - {one.times} * s{one.window})")
    usual, absolute, most, least = detectors.LATENCY[one.percentile]
    rule = f"(h_n >= 5 AND h_mean <= 1 AND h_p99 <= 5 AND value > h_mean AND (value > {one.hard_timeout} OR (h_mean <= {usual} AND value > CASE WHEN h_mean < 0.5 THEN {absolute} ELSE h_mean * (CAST({most} AS DOUBLE) - (h_mean - 0.5) / CAST(1.5 AS DOUBLE) * CAST({most - least} AS DOUBLE)) END)))"
    return head.format(m="enhanced_latency", t="'threshold_high'", s=f"CASE WHEN value > {one.hard_timeout} THEN 'critical' ELSE 'low' END", c=f"CASE WHEN value > {one.hard_timeout} THEN 1.0 ELSE 0.0 END", w=rule)


def _run_sql(level: str) -> str:
    windows = sorted({x.window for kind in _KIND.values() for x in detectors.PRESETS[kind, level] if isinstance(x, detectors.Trend)})
    parts = " UNION ALL ".join(_method_sql(m, x) for m, kind in _KIND.items() for x in detectors.PRESETS[kind, level])
    last = ", ".join(f"count(*) FILTER (r <= {w}) AS n{w}, avg(value) FILTER (r <= {w}) AS m{w}, stddev_pop(value) FILTER (r <= {w}) AS s{w}" for w in windows)
    return f"""hr AS (SELECT *, row_number() OVER (PARTITION BY datapack, service_name, metric ORDER BY time DESC, seq DESC) AS r FROM metrics WHERE period = 'normal'),
h AS (SELECT datapack, service_name, metric, count(*) AS h_n, avg(value) AS h_mean, stddev_pop(value) AS h_sd, quantile_cont(value, 0.25) AS h_q1, quantile_cont(value, 0.75) AS h_q3, quantile_cont(value, 0.99) AS h_p99, {last} FROM hr GROUP BY ALL),
v AS (SELECT m.*, h.* EXCLUDE (datapack, service_name, metric) FROM metrics m LEFT JOIN h USING (datapack, service_name, metric) WHERE m.period = 'abnormal'), found AS ({parts})"""


_OUT = ["datapack", "service_name", "metric", "seq", "method", "anomaly_type", "severity"]
for _name in ("usual", "strict"):
    _add(f"d09_{_name}_detectors", lambda s, d, x=_name: _by_kind(s, d, x).select(*_OUT, F.round("confidence", 6).alias("confidence")), f"WITH {_run_sql(_name)} SELECT {', '.join(_OUT)}, round(confidence, 6) AS confidence FROM found", "metrics")
_add("d09_anomaly_summary", lambda s, d: detectors.summarize(_by_kind(s, d, "strict"), _KEYS), f"""WITH {_run_sql('strict')} SELECT datapack, service_name, metric, count(*) AS total, {', '.join(f"count(*) FILTER (severity = '{x}') AS {x}" for x in ('critical', 'high', 'medium', 'low'))},
  string_agg(DISTINCT method, ',' ORDER BY method) AS methods, string_agg(DISTINCT anomaly_type, ',' ORDER BY anomaly_type) AS types, round(max(confidence), 6) AS max_confidence FROM found GROUP BY datapack, service_name, metric""", "metrics")
