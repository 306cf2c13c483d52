"""Queries of event pairs and trace patterns over the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracejobs.operators import events, sli
from tracejobs.queries import _SAMPLED, _add, _samples
from tracejobs.sources import fixtures as fx


def _logs(spark: SparkSession, d: str) -> DataFrame:
    """Logs dealt over the first three spans of their traces; their level stands for a template, none for INFO."""
    rows = fx.logs(spark, d)
    span = F.concat("trace_id", F.lit("-"), F.length("message") % 3 + 1)
    return rows.select("datapack", F.col("trace_id") % 2000 + 1, "time", "level", span.alias("span_id"), F.when(F.col("level") != "INFO", F.col("level")).alias("template")).toDF("datapack", "trace_id", "time", "level", "span_id", "template").withColumns(
        {"datapack": F.concat(F.lit("dp"), F.col("trace_id") % 8), "span_id": F.concat("trace_id", F.lit("-"), F.substring_index("span_id", "-", -1))})


def _limits(spans: DataFrame) -> DataFrame:
    return events.slow_limits(sli.sli_rollup(spans.where("period = 'normal'"), "month"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    spans = fx.spans(spark, d)
    return events.event_pairs(spans, _logs(spark, d), _limits(spans), "loadgenerator")


_LOGS = "elogs AS (SELECT 'dp' || ((trace_id % 2000 + 1) % 8) AS datapack, trace_id % 2000 + 1 AS trace_id, (trace_id % 2000 + 1) || '-' || (length(message) % 3 + 1) AS span_id, time, level, CASE WHEN level <> 'INFO' THEN level END AS template FROM logs)"
_LIMITS = """sg AS (SELECT datapack, service_name, span_name, list_sort(list(duration / 1e6)) AS l FROM spans WHERE period = 'normal' GROUP BY datapack, service_name, span_name, date_trunc('month', time)),
limits AS (SELECT datapack, service_name, span_name, avg(l[CAST(round(0.9 * (len(l) - 1)) AS INT) + 1]) AS limit_ms FROM sg GROUP BY ALL)"""
_PAIRS = f"""{_LOGS}, {_LIMITS}, own AS (SELECT s.*, service_name || '_' || span_name AS op, limit_ms FROM spans s LEFT JOIN limits USING (datapack, service_name, span_name) WHERE (datapack, trace_id) IN (SELECT (datapack, trace_id) FROM spans WHERE parent_span_id = '' AND service_name = 'loadgenerator')),
ev AS (SELECT datapack, trace_id, span_id, 0 AS pos, NULL::TIMESTAMP AS time, 'S:' || op AS token FROM own UNION ALL SELECT datapack, trace_id, span_id, 2, NULL, 'E:' || op FROM own WHERE status_code = 'Error' UNION ALL SELECT datapack, trace_id, span_id, 3, NULL, 'P:' || op FROM own WHERE duration / 1e6 > limit_ms
  UNION ALL SELECT datapack, trace_id, span_id, 4, NULL, 'F:' || op FROM own UNION ALL SELECT l.datapack, l.trace_id, l.span_id, 1, l.time, 'L:' || template FROM elogs l JOIN own o ON o.datapack = l.datapack AND o.trace_id = l.trace_id AND o.span_id = l.span_id WHERE template IS NOT NULL),
nx AS (SELECT datapack, trace_id, token AS a, lead(token) OVER (PARTITION BY datapack, trace_id, span_id ORDER BY pos, time, token) AS b FROM ev),
pairs AS (SELECT DISTINCT * FROM nx WHERE b IS NOT NULL UNION SELECT p.datapack, p.trace_id, 'F:' || p.op, 'S:' || c.op FROM own p JOIN own c ON p.datapack = c.datapack AND p.trace_id = c.trace_id AND p.span_id = c.parent_span_id)"""
_PATTERNS = f"{_PAIRS}, pt AS (SELECT datapack, trace_id, string_agg(a || '>' || b, '|' ORDER BY a, b) AS pattern, trace_id % 10 = 0 AS s FROM pairs GROUP BY ALL)"

_add("t04_slow_limits", lambda s, d: _limits(fx.spans(s, d)).withColumn("limit_ms", F.round("limit_ms", 6)), f"WITH {_LIMITS} SELECT datapack, service_name, span_name, round(limit_ms, 6) AS limit_ms FROM limits", "spans")
_add("t05_event_pairs", _pairs, f"WITH {_PAIRS} SELECT * FROM pairs", "spans", "logs")
_add("t06_event_coverage", lambda s, d: events.event_coverage(_pairs(s, d), _samples(s, d)), f"""WITH {_PATTERNS}, bp AS (SELECT datapack, a, b, bool_or(trace_id % 10 = 0) AS s FROM pairs GROUP BY ALL), p1 AS (SELECT datapack, count(*) AS pairs, count(*) FILTER (s) AS sampled_pairs FROM bp GROUP BY ALL),
q AS (SELECT datapack, pattern, count(*) FILTER (s) AS c FROM pt GROUP BY ALL), q2 AS (SELECT *, sum(c) OVER (PARTITION BY datapack) AS n FROM q), p2 AS (SELECT datapack, count(*) AS patterns, count(*) FILTER (c > 0) AS sampled_patterns, coalesce(-sum(c / n * log2(c / n)) FILTER (c > 0), 0) AS entropy FROM q2 GROUP BY ALL),
n AS (SELECT datapack, count(*) AS traces FROM {_SAMPLED} GROUP BY ALL)
SELECT datapack, pairs, sampled_pairs, round(sampled_pairs / pairs, 6) AS event_coverage, patterns, sampled_patterns, round(sampled_patterns / patterns, 6) AS pattern_coverage, round(CASE WHEN sampled_patterns > 1 THEN entropy ELSE 0 END, 6) AS entropy, round(coalesce(sampled_patterns / traces, 0), 6) AS benefit_cost FROM p1 JOIN p2 USING (datapack) LEFT JOIN n USING (datapack)""", "spans", "logs")
_add("t08_anomaly_scores", lambda s, d: events.anomaly_scores(fx.spans(s, d), _logs(s, d), _limits(fx.spans(s, d)), _samples(s, d), "loadgenerator"), f"""WITH {_LOGS}, {_LIMITS},
r AS (SELECT datapack, trace_id, count(*) FILTER (status_code = 'Error') AS errors FROM spans WHERE trace_id % 10 = 0 GROUP BY ALL), x AS (SELECT s.datapack, s.trace_id, duration / 1e6 / limit_ms AS times FROM spans s LEFT JOIN limits USING (datapack, service_name, span_name) WHERE parent_span_id = '' AND s.service_name = 'loadgenerator'),
g AS (SELECT datapack, trace_id, sum(CASE level WHEN 'WARN' THEN 1 WHEN 'ERROR' THEN 2 ELSE 0 END) AS said FROM elogs GROUP BY ALL)
SELECT r.datapack, count(*) AS traces, round(avg(errors * 5 + CASE WHEN times >= 5 THEN 3 WHEN times >= 3 THEN 2 WHEN times >= 1.5 THEN 1 ELSE 0 END + coalesce(said, 0)), 6) AS score FROM r JOIN x USING (datapack, trace_id) LEFT JOIN g USING (datapack, trace_id) GROUP BY ALL""", "spans", "logs")
_add("w05_mean_dissimilarity", lambda s, d: events.mean_dissimilarity(_pairs(s, d), _samples(s, d)), f"""WITH {_PATTERNS}, u AS (SELECT datapack, pattern, min(trace_id) AS trace_id FROM pt WHERE s GROUP BY ALL), e AS (SELECT u.datapack, u.trace_id, a, b, count(*) OVER (PARTITION BY u.datapack, u.trace_id) AS n FROM u JOIN pairs p ON p.datapack = u.datapack AND p.trace_id = u.trace_id),
j AS (SELECT x.datapack, x.trace_id, y.trace_id AS other, count(*) / (any_value(x.n) + any_value(y.n) - count(*)) AS sim FROM e x JOIN e y ON x.datapack = y.datapack AND x.a = y.a AND x.b = y.b AND x.trace_id < y.trace_id GROUP BY ALL), t AS (SELECT datapack, sum(sim) AS alike FROM j GROUP BY ALL), n AS (SELECT datapack, count(*) AS patterns FROM u GROUP BY ALL)
SELECT datapack, patterns, round(CASE WHEN patterns > 1 THEN 1 - coalesce(alike, 0) / (patterns * (patterns - 1) / 2) ELSE 0 END, 6) AS dissimilarity FROM n LEFT JOIN t USING (datapack)""", "spans", "logs")
