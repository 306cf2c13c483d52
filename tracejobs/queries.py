"""One query for each operator over the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracejobs.functions import names
from tracejobs.operators import compare, coverage, detect, evaluate, joins, sampling, sli, structure, timejoins
from tracejobs.sources import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_ORDER = "l_discount, l_extendedprice, l_linestatus, l_partkey, l_quantity, l_returnflag, l_shipdate, l_suppkey, l_tax"
_SPANS = fx.SPANS_SQL.replace("{order}", _ORDER)
_LINEAR = "quantile_cont(duration / 1e9, {q})"


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None, *views: str) -> None:
    QUERIES[name] = run
    sql = sql and sql.strip()
    if sql:
        with_ = ", ".join({"spans": _SPANS, "logs": fx.LOGS_SQL, "metrics": fx.METRICS_SQL, "rankings": fx.RANKINGS_SQL}[v] for v in views)
        ORACLE_SQL[name] = (f"WITH {'RECURSIVE ' if 'RECURSIVE' in sql else ''}{with_}" + (", " + sql.replace("RECURSIVE ", "", 1)[5:] if sql.startswith("WITH") else " " + sql)) if views else sql


_ERF = "list_sum(list_transform(range(0, 160), lambda n: exp((2 * n + 1) * ln({x}) + n * ln(4) + lgamma(n + 1) - lgamma(2 * n + 2)))) * 2 / sqrt(pi()) * exp(-{x} * {x})"


def _p_sql(z: str) -> str:
    """Two-sided probability; at 0 it is 1, from 8 on 0 to 12 places."""
    x = f"(({z}) / sqrt(2.0))"
    return f"CASE WHEN ({z}) = 0 THEN 1 WHEN ({z}) > 8 THEN 0 ELSE 1 - {_ERF.format(x=x)} END"


_EDGES = "SELECT DISTINCT p.datapack, p.service_name AS src, c.service_name AS dst FROM spans p JOIN spans c ON p.trace_id = c.trace_id AND p.span_id = c.parent_span_id WHERE p.service_name <> c.service_name"
_SAMPLED = "(SELECT DISTINCT datapack, trace_id FROM spans WHERE trace_id % 10 = 0)"


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return fx.spans(spark, d).where("trace_id % 10 = 0").select("datapack", "trace_id").distinct()


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return fx.read(spark, d, "labels").select(F.col("doc_id").alias("sample_id"), (F.col("doc_id") % 50).alias("question"), (F.col("quality") == 1).alias("correct"), F.col("toxic").alias("level"), ((F.col("doc_id") * 7) % 101).alias("confidence"))


_JUDGED = "judged AS (SELECT doc_id AS sample_id, doc_id % 50 AS question, quality = 1 AS correct, toxic AS level, (doc_id * 7) % 101 AS confidence FROM labels)"

_add("a02_sli_rollup", lambda s, d: sli.sli_rollup(fx.spans(s, d), "minute"), """
WITH g AS (SELECT datapack, date_trunc('minute', time) AS time, service_name, span_name, list_sort(list(duration / 1e6)) AS l, avg(duration) / 1e6 AS a, count(*) AS total_count, count(*) FILTER (status_code = 'Error') AS error_count FROM spans GROUP BY ALL)
SELECT datapack, CAST(time AS TIMESTAMP) AS time, service_name, span_name, l[1] AS min_duration, l[len(l)] AS max_duration, round(a, 6) AS avg_duration, l[CAST(round(0.5 * (len(l) - 1)) AS INT) + 1] AS duration_p50, l[CAST(round(0.9 * (len(l) - 1)) AS INT) + 1] AS duration_p90,
  l[CAST(round(0.95 * (len(l) - 1)) AS INT) + 1] AS duration_p95, l[CAST(round(0.99 * (len(l) - 1)) AS INT) + 1] AS duration_p99, total_count, error_count FROM g""", "spans")
_add("a01_endpoint_stats", lambda s, d: sli.endpoint_stats(fx.spans(s, d), ["datapack", "period", "span_name"]), f"""
SELECT datapack, period, span_name, round(avg(duration / 1e9), 10) AS avg_duration, round({_LINEAR.format(q=0.9)}, 8) AS p90, round({_LINEAR.format(q=0.95)}, 8) AS p95, round({_LINEAR.format(q=0.99)}, 8) AS p99,
  round(count(*) FILTER (status_code <> 'Error') / count(*), 6) AS succ_rate, count(*) AS n FROM spans GROUP BY ALL""", "spans")
_add("j01_service_graph", lambda s, d: joins.service_graph(fx.spans(s, d)), _EDGES, "spans")
_add("j02_operation_graph", lambda s, d: joins.operation_graph(fx.spans(s, d)), """
SELECT p.datapack, p.service_name || ' ' || p.span_name AS src, c.service_name || ' ' || c.span_name AS dst, count(*) AS calls FROM spans p JOIN spans c ON p.trace_id = c.trace_id AND p.span_id = c.parent_span_id GROUP BY ALL""", "spans")
_add("j04_without_long_traces", lambda s, d: joins.without_long_traces(fx.spans(s, d), 90 * 10**9).select("trace_id", "span_id", "duration"),
     "SELECT trace_id, span_id, duration FROM spans WHERE trace_id NOT IN (SELECT trace_id FROM spans WHERE duration > 90000000000)", "spans")
_add("j05_sampled_spans", lambda s, d: joins.of_sampled(fx.spans(s, d), _samples(s, d)).select("datapack", "trace_id", "span_id"), "SELECT datapack, trace_id, span_id FROM spans WHERE trace_id % 10 = 0", "spans")
_add("j07_log_spans", lambda s, d: joins.log_spans(fx.logs(s, d), fx.spans(s, d)).select("trace_id", "span_id", "level", "op"),
     "SELECT l.trace_id, l.span_id, level, s.service_name || ' ' || s.span_name AS op FROM logs l LEFT JOIN spans s ON l.datapack = s.datapack AND l.trace_id = s.trace_id AND l.span_id = s.span_id", "spans", "logs")
_add("j11_exclusive_duration", lambda s, d: joins.exclusive_duration(fx.spans(s, d)).select("trace_id", "span_id", "duration", "exclusive"), """
WITH k AS (SELECT trace_id, parent_span_id, sum(duration) AS d FROM spans WHERE parent_span_id <> '' GROUP BY ALL)
SELECT s.trace_id, s.span_id, s.duration, CAST(s.duration - coalesce(k.d, 0) AS BIGINT) AS exclusive FROM spans s LEFT JOIN k ON s.trace_id = k.trace_id AND s.span_id = k.parent_span_id""", "spans")
_LOST = "CASE WHEN http_status = 500 AND parent_span_id <> '' THEN 'lost-' || parent_span_id ELSE parent_span_id END"
_add("j13_orphan_spans", lambda s, d: joins.orphans(fx.spans(s, d).withColumn("parent_span_id", F.expr(_LOST))).select("trace_id", "span_id"), "SELECT trace_id, span_id FROM spans WHERE http_status = 500 AND parent_span_id <> ''", "spans")
_add("e05_leaf_errors", lambda s, d: joins.leaf_errors(fx.spans(s, d)).select("trace_id", "span_id"), """
SELECT trace_id, span_id FROM spans WHERE status_code = 'Error' AND span_id NOT IN (SELECT parent_span_id FROM spans WHERE status_code = 'Error')""", "spans")
_add("e02_services", lambda s, d: fx.spans(s, d).select("datapack", "service_name").unionByName(fx.metrics(s, d).select("datapack", "service_name")).where("service_name NOT IN ('loadgenerator', '')").distinct(),
     "SELECT datapack, service_name FROM spans WHERE service_name <> 'loadgenerator' UNION SELECT datapack, service_name FROM metrics", "spans", "metrics")
_add("a03_http_error_windows", lambda s, d: sli.error_rate_windows(fx.spans(s, d), "7 days"), """
SELECT datapack, time_bucket(INTERVAL 7 DAYS, time, TIMESTAMP '1970-01-01') AS time, service_name, round(avg(CASE WHEN http_status >= 400 THEN 1.0 ELSE 0.0 END) * 100, 6) AS error_rate, count(*) AS n FROM spans GROUP BY ALL""", "spans")
_add("a04_log_error_windows", lambda s, d: sli.log_error_windows(fx.logs(s, d), "1 day"), """
SELECT datapack, time_bucket(INTERVAL 1 DAY, time, TIMESTAMP '1970-01-01') AS time, service_name, round(avg(CASE WHEN level IN ('WARN', 'ERROR') THEN 1.0 ELSE 0.0 END), 6) AS error_rate FROM logs GROUP BY ALL""", "logs")
_add("a05_duration_windows", lambda s, d: sli.duration_windows(fx.spans(s, d), "7 days"), """
SELECT datapack, time_bucket(INTERVAL 7 DAYS, time, TIMESTAMP '1970-01-01') AS time, service_name, round(avg(duration) / 1e6, 6) AS avg_ms FROM spans WHERE duration > 0 GROUP BY ALL""", "spans")
_add("a25_span_stats", lambda s, d: sli.span_stats(fx.spans(s, d)), """
SELECT datapack, service_name, span_name, count(*) AS calls, count(*) FILTER (status_code = 'Error') AS errors, round(count(*) FILTER (status_code = 'Error') / count(*), 6) AS error_rate, round(avg(duration) / 1e6, 6) AS avg_ms, min(duration / 1e6) AS min_ms, max(duration / 1e6) AS max_ms,
  round(quantile_cont(duration / 1e6, 0.5), 8) AS p50, round(quantile_cont(duration / 1e6, 0.9), 8) AS p90, round(quantile_cont(duration / 1e6, 0.95), 8) AS p95, round(quantile_cont(duration / 1e6, 0.99), 8) AS p99 FROM spans GROUP BY ALL""", "spans")
_add("a13_call_probability", lambda s, d: sli.call_probability(fx.spans(s, d)), f"""
WITH e AS ({_EDGES}), h AS (SELECT DISTINCT datapack, period, service_name, trace_id FROM spans), n AS (SELECT datapack, period, service_name, count(*) AS n FROM h GROUP BY ALL),
b AS (SELECT a.datapack, a.period, e.src, e.dst, count(*) AS together FROM e JOIN h a ON a.datapack = e.datapack AND a.service_name = e.src JOIN h b ON b.datapack = a.datapack AND b.period = a.period AND b.trace_id = a.trace_id AND b.service_name = e.dst GROUP BY ALL)
SELECT b.datapack, b.period, src, dst, round(together / x.n, 6) AS p_src, round(together / y.n, 6) AS p_dst FROM b JOIN n x ON x.datapack = b.datapack AND x.period = b.period AND x.service_name = src JOIN n y ON y.datapack = b.datapack AND y.period = b.period AND y.service_name = dst""", "spans")
_add("a20_datapack_profile", lambda s, d: sli.datapack_profile(fx.spans(s, d)), """
WITH g AS (SELECT datapack, count(*) AS spans, count(*) FILTER (parent_span_id = '') AS roots, count(DISTINCT service_name) AS services, min(time) AS first, max(time) AS last, CAST(epoch(max(time)) - epoch(min(time)) AS BIGINT) AS seconds FROM spans GROUP BY ALL)
SELECT *, CASE WHEN seconds = 0 THEN 0 ELSE round(roots / seconds, 9) END AS qps FROM g""", "spans")
_add("a08_anomaly_magnitude", lambda s, d: sli.anomaly_magnitude(fx.metrics(s, d)), """
WITH g AS (SELECT datapack, service_name, metric, min(value) AS lo, max(value) AS hi, avg(value) FILTER (period = 'abnormal') AS a, avg(value) FILTER (period = 'normal') AS n FROM metrics GROUP BY ALL)
SELECT datapack, service_name, round(sum(coalesce(CASE WHEN hi > lo THEN abs(a - n) / (hi - lo) END, 0)), 6) AS magnitude FROM g GROUP BY ALL""", "metrics")
_add("a09_anomaly_cardinality", lambda s, d: sli.anomaly_cardinality(fx.metrics(s, d), 0.2), """
WITH g AS (SELECT datapack, service_name, metric, avg(value) FILTER (period = 'abnormal') AS a, avg(value) FILTER (period = 'normal') AS n, coalesce(stddev_samp(value) FILTER (period = 'normal'), 0) AS sd FROM metrics GROUP BY ALL)
SELECT datapack, service_name, count(*) FILTER (CASE WHEN sd > 0 THEN abs(a - n) / sd > 0.2 ELSE abs(a - n) > 0 END) AS cardinality FROM g GROUP BY ALL""", "metrics")
_add("a22_level_counts", lambda s, d: fx.logs(s, d).groupBy("service_name", "level").agg(F.count(F.lit(1)).alias("n")), "SELECT service_name, level, count(*) AS n FROM logs GROUP BY ALL", "logs")
_add("w03_trace_depth", lambda s, d: structure.depth(fx.spans(s, d)), """WITH RECURSIVE t AS (
  SELECT datapack, trace_id, span_id, 1 AS level FROM spans WHERE parent_span_id = '' UNION ALL SELECT c.datapack, c.trace_id, c.span_id, t.level + 1 FROM t JOIN spans c ON c.trace_id = t.trace_id AND c.parent_span_id = t.span_id)
SELECT datapack, trace_id, max(level) AS depth FROM t GROUP BY ALL""", "spans")
_add("t01_path_encoding", lambda s, d: structure.path_encoding(fx.spans(s, d)), """WITH RECURSIVE t AS (
  SELECT datapack, trace_id, span_id, service_name || ':' || span_name AS label, 1 AS level FROM spans WHERE parent_span_id = ''
  UNION ALL SELECT c.datapack, c.trace_id, c.span_id, c.service_name || ':' || c.span_name, t.level + 1 FROM t JOIN spans c ON c.trace_id = t.trace_id AND c.parent_span_id = t.span_id)
SELECT datapack, trace_id, string_agg(label, ' -> ' ORDER BY level, label) AS encoding FROM t GROUP BY ALL""", "spans")
_add("t03_path_coverage", lambda s, d: structure.path_coverage(fx.spans(s, d), _samples(s, d), False), """WITH RECURSIVE t AS (
  SELECT datapack, trace_id, span_id, service_name || ':' || span_name AS label, 1 AS level FROM spans WHERE parent_span_id = ''
  UNION ALL SELECT c.datapack, c.trace_id, c.span_id, c.service_name || ':' || c.span_name, t.level + 1 FROM t JOIN spans c ON c.trace_id = t.trace_id AND c.parent_span_id = t.span_id),
e AS (SELECT datapack, trace_id, string_agg(label, ' -> ' ORDER BY level, label) AS code FROM t GROUP BY ALL)
SELECT datapack, count(DISTINCT code) AS paths, count(DISTINCT code) FILTER (trace_id % 10 = 0) AS sampled_paths, round(count(DISTINCT code) FILTER (trace_id % 10 = 0) / count(DISTINCT code), 6) AS coverage FROM e GROUP BY ALL""", "spans")
_SCORE = "CAST('0x' || substr(md5(trace_id || ':0'), 1, 8) AS BIGINT) / 4294967296.0"
_add("k01_offline_sampling", lambda s, d: sampling.offline(fx.spans(s, d), 0.1), f"""
WITH t AS (SELECT DISTINCT datapack, trace_id, {_SCORE} AS sample_score FROM spans), r AS (SELECT *, row_number() OVER (PARTITION BY datapack ORDER BY sample_score DESC, trace_id) AS r, count(*) OVER (PARTITION BY datapack) AS n FROM t)
SELECT datapack, trace_id, sample_score FROM r WHERE r <= floor(n * 0.1)""", "spans")
_add("k02_online_sampling", lambda s, d: sampling.online(fx.spans(s, d), 0.1).select("datapack", "trace_id", "span_id"), f"SELECT datapack, trace_id, span_id FROM spans WHERE {_SCORE} > 1 - 0.1", "spans")
_add("k08_rank_services", lambda s, d: sampling.rank_services(fx.spans(s, d).where("status_code = 'Error'").withColumn("v", F.col("duration")), "v"), """
WITH g AS (SELECT datapack, service_name, CAST(sum(duration) AS BIGINT) AS total FROM spans WHERE status_code = 'Error' AND service_name <> 'loadgenerator' GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY datapack ORDER BY total DESC, service_name) AS rank FROM g""", "spans")
_add("w11_baseline_slices", lambda s, d: detect.baseline_slices(fx.spans(s, d)), """
WITH r AS (SELECT datapack, span_name, duration / 1e9 AS s, row_number() OVER (PARTITION BY datapack, span_name ORDER BY duration, span_id) - 1 AS i, count(*) OVER (PARTITION BY datapack, span_name) AS n FROM spans WHERE period = 'normal')
SELECT datapack, span_name, count(*) AS n, round(coalesce(avg(s) FILTER (i >= floor(n * CAST(0.85 AS DOUBLE)) AND i < floor(n * CAST(0.95 AS DOUBLE))), avg(s)), 6) AS base_p90, round(coalesce(avg(s) FILTER (i >= floor(n * CAST(0.9 AS DOUBLE)) AND i < floor(n * CAST(0.99 AS DOUBLE))), avg(s)), 6) AS base_p95,
  round(coalesce(avg(s) FILTER (i >= floor(n * CAST(0.95 AS DOUBLE))), avg(s)), 6) AS base_p99 FROM r GROUP BY datapack, span_name""", "spans")
_add("d02_statistical_detector", lambda s, d: detect.statistical_detector(fx.metrics(s, d), 1.5, 0.5), """
WITH h AS (SELECT datapack, service_name, metric, avg(value) AS m, stddev_pop(value) AS sd, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM metrics WHERE period = 'normal' GROUP BY ALL HAVING count(value) >= 5),
x AS (SELECT datapack, service_name, metric, seq, value, CASE WHEN sd > 0 THEN abs(value - m) / sd END AS z, a, b FROM metrics JOIN h USING (datapack, service_name, metric) WHERE period = 'abnormal'),
k AS (SELECT *, CASE WHEN z > 1.5 THEN 'z-score' WHEN b > a AND (value < a - 0.5 * (b - a) OR value > b + 0.5 * (b - a)) THEN 'iqr' END AS kind, least(greatest(a - 0.5 * (b - a) - value, value - b - 0.5 * (b - a), 0) / nullif(0.5 * (b - a), 0), 1) AS far FROM x)
SELECT datapack, service_name, metric, seq, value, round(z, 6) AS z, kind, CASE WHEN kind = 'iqr' THEN CASE WHEN far >= 0.8 THEN 'high' WHEN far >= 0.5 THEN 'medium' ELSE 'low' END WHEN z >= 4 THEN 'critical' WHEN z >= 3.5 THEN 'high' WHEN z >= 3 THEN 'medium' ELSE 'low' END AS severity, round(CASE WHEN kind = 'iqr' THEN far ELSE least(z / 1.5, 4) / 4 END, 6) AS confidence FROM k WHERE kind IS NOT NULL""", "metrics")
_add("d03_trend_detector", lambda s, d: detect.trend_detector(fx.metrics(s, d), 10, 2.0), """
WITH v AS (SELECT datapack, service_name, metric, seq, value, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd, count(value) OVER w AS n FROM metrics WINDOW w AS (PARTITION BY datapack, service_name, metric ORDER BY time, seq ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
SELECT datapack, service_name, metric, seq, value, CASE WHEN value > m THEN 'spike' ELSE 'drop' END AS kind, round(m, 6) AS mean, CASE WHEN abs(value - m) / sd >= 4 THEN 'critical' WHEN abs(value - m) / sd >= 3 THEN 'high' ELSE 'medium' END AS severity, 1.0 AS confidence FROM v WHERE n = 10 AND sd > 0 AND abs(value - m) > 2.0 * sd""", "metrics")
_STATS = "count(*) AS n, round(avg(duration / 1e9), 10) AS avg_duration, round(quantile_cont(duration / 1e9, 0.9), 8) AS p90, round(quantile_cont(duration / 1e9, 0.95), 8) AS p95, round(quantile_cont(duration / 1e9, 0.99), 8) AS p99, round(count(*) FILTER (status_code <> 'Error') / count(*), 6) AS succ_rate"
_CONCLUSION = f"""st AS (SELECT datapack, span_name, period, {_STATS} FROM spans GROUP BY datapack, span_name, period), ab AS (SELECT a.datapack, a.span_name,
  {', '.join(f'a.{k} AS abnormal_{k}, b.{k} AS normal_{k}' for k in ('avg_duration', 'p90', 'p95', 'p99', 'succ_rate'))}, b.n IS NULL AS new FROM st a LEFT JOIN (SELECT * FROM st WHERE period = 'normal') b ON a.datapack = b.datapack AND a.span_name = b.span_name WHERE a.period = 'abnormal'),
concluded AS (SELECT * EXCLUDE (new), array_to_string(list_filter([{', '.join(f"CASE WHEN (CASE WHEN new THEN abnormal_{k} > {x} ELSE abnormal_{k} > CAST(1.2 AS DOUBLE) * normal_{k} END) THEN '{k}' END" for k, x in (('avg_duration', 3), ('p90', 7), ('p95', 8), ('p99', 10)))},
  CASE WHEN (CASE WHEN new THEN abnormal_succ_rate < 0.9 ELSE normal_succ_rate - abnormal_succ_rate > CAST(0.05 AS DOUBLE) END) THEN 'succ_rate' END], lambda x: x IS NOT NULL), ',') AS issues FROM ab)"""
_add("d07_conclusion", lambda s, d: detect.conclusion(fx.spans(s, d)), f"WITH {_CONCLUSION} SELECT * FROM concluded", "spans")
_add("d08_datapack_summary", lambda s, d: detect.datapack_summary(detect.conclusion(fx.spans(s, d))), f"""WITH {_CONCLUSION},
g AS (SELECT datapack, count(*) AS endpoints, count(*) FILTER (issues <> '') AS anomalies, count(*) FILTER (contains(issues, 'succ_rate')) AS failing FROM concluded GROUP BY ALL)
SELECT *, CASE WHEN failing > 0 THEN 'absolute' WHEN anomalies > 0 THEN 'may' ELSE 'none' END AS tag FROM g""", "spans")
_BEST = "WITH b AS (SELECT algorithm, datapack, min(rank) FILTER (hit AND rank <= 5) AS best FROM rankings GROUP BY ALL)"
_add("a26_top_k", lambda s, d: evaluate.top_k(fx.rankings(s, d)), f"""{_BEST} SELECT algorithm, datapack, CASE WHEN best <= 1 THEN 1.0 ELSE 0 END AS top1, CASE WHEN best <= 3 THEN 1.0 ELSE 0 END AS top3, CASE WHEN best <= 5 THEN 1.0 ELSE 0 END AS top5,
  round(greatest(0, 4 - coalesce(best, 9)) / 3, 6) AS avg3, round(greatest(0, 6 - coalesce(best, 9)) / 5, 6) AS avg5, round(coalesce(1 / best, 0), 6) AS mrr FROM b""", "rankings")
_KS = range(1, 6)
_add("a28_accuracy_at_k", lambda s, d: evaluate.accuracy_at_k(fx.rankings(s, d)), "WITH b AS (SELECT algorithm, datapack, min(rank) FILTER (hit) AS best FROM rankings GROUP BY ALL), g AS (SELECT algorithm, count(*) AS total, "
     + ", ".join(f"count(*) FILTER (best <= {k}) AS count_{k}" for k in _KS) + " FROM b GROUP BY ALL) SELECT algorithm, total, " + ", ".join(f"count_{k}, round(count_{k} / total, 6) AS ac_{k}, round(({' + '.join(f'count_{i} / total' for i in range(1, k + 1))}) / {k}, 6) AS avg_{k}" for k in _KS) + " FROM g", "rankings")
_add("a29_mrr", lambda s, d: evaluate.mean_reciprocal_rank(fx.rankings(s, d)), "WITH b AS (SELECT algorithm, datapack, min(rank) AS best FROM rankings WHERE hit GROUP BY ALL) SELECT algorithm, round(avg(1 / best), 6) AS mrr FROM b GROUP BY ALL", "rankings")
_add("a30_precision_at_k", lambda s, d: evaluate.precision_at_k(fx.rankings(s, d)), "WITH r AS (SELECT algorithm, datapack, " + ", ".join(f"count(*) FILTER (hit AND rank <= {k}) AS h{k}" for k in _KS) + " FROM rankings GROUP BY ALL) SELECT algorithm, "
     + ", ".join(f"round(avg(h{k} / {k}), 9) AS p_{k}, round(avg(({' + '.join(f'h{i} / {i}' for i in range(1, k + 1))}) / {k}), 9) AS map_{k}" for k in _KS) + " FROM r GROUP BY ALL", "rankings")
_add("a32_average_runtime", lambda s, d: evaluate.average_runtime(fx.rankings(s, d)), "WITH r AS (SELECT algorithm, datapack, max(runtime) AS t FROM rankings GROUP BY ALL) SELECT algorithm, round(avg(t), 6) AS avg_runtime, count(*) AS runs FROM r GROUP BY ALL", "rankings")
_add("a42_common_failures", lambda s, d: evaluate.common_failures(fx.rankings(s, d), 1, 2), "WITH r AS (SELECT algorithm, datapack, max(CASE WHEN hit AND rank <= 1 THEN 1 ELSE 0 END) AS good FROM rankings GROUP BY ALL) SELECT datapack, count(*) FILTER (good = 0) AS failures FROM r GROUP BY ALL HAVING count(*) FILTER (good = 0) >= 2", "rankings")
_add("a43_outcome", lambda s, d: evaluate.outcome(fx.rankings(s, d)), f"{_BEST} SELECT algorithm, CASE WHEN best = 1 THEN 'top1' WHEN best <= 3 THEN 'top3' WHEN best <= 5 THEN 'top5' ELSE 'failure' END AS outcome, count(*) AS runs FROM b GROUP BY ALL", "rankings")
_add("a53_pass_at_k", lambda s, d: evaluate.pass_at_k(_judged(s, d), 3), f"""WITH {_JUDGED}, f AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY sample_id) AS a FROM judged), q AS (SELECT question, max(CAST(correct AS INT)) AS good, min(level) AS level FROM f WHERE a <= 3 GROUP BY ALL)
SELECT level, count(*) AS questions, round(avg(good), 6) AS pass_at_k FROM q GROUP BY ALL""")
_add("a54_calibration", lambda s, d: evaluate.calibration(_judged(s, d)), f"""WITH {_JUDGED}, g AS (SELECT CAST(least(floor(confidence / 20), 4) AS BIGINT) AS bin, count(*) AS n, avg(CAST(correct AS INT)) AS acc, avg(confidence / 100) AS conf FROM judged GROUP BY ALL)
SELECT bin, n, round(acc, 6) AS accuracy, round(conf, 6) AS mean_confidence, round(abs(acc - conf) * (n / sum(n) OVER ()), 6) AS weighted_error FROM g""")


def _levels(spark: SparkSession, d: str, *levels: str) -> DataFrame:
    return fx.logs(spark, d).where(F.col("level").isin(*levels)).select("service_name", "time", "trace_id")


def _metric(spark: SparkSession, d: str, name: str) -> DataFrame:
    return fx.metrics(spark, d).where(F.col("metric") == name)


def _edges_of(spark: SparkSession, d: str, period: str) -> DataFrame:
    return joins.service_graph(fx.spans(spark, d).where(F.col("period") == period))


_ENTRIES = "first AS (SELECT datapack, trace_id, arg_min(struct_pack(span_id, span_name, duration), struct_pack(time, span_id)) AS e FROM spans WHERE parent_span_id = '' GROUP BY ALL), entries AS (SELECT datapack, trace_id, e.span_id, e.span_name, e.duration FROM first)"
_PERIOD_EDGES = _EDGES.replace("WHERE", "WHERE p.period = '{p}' AND c.period = '{p}' AND")

_add("j08_exact_log_spans", lambda s, d: fx.logs(s, d).select("trace_id", "span_id", "level").join(fx.spans(s, d).select("trace_id", "span_id", "service_name"), ["trace_id", "span_id"]).distinct(),
     "SELECT DISTINCT l.trace_id, l.span_id, level, s.service_name FROM logs l JOIN spans s ON l.trace_id = s.trace_id AND l.span_id = s.span_id", "spans", "logs")
_add("j09_interval_join", lambda s, d: timejoins.interval_join(_levels(s, d, "ERROR"), _levels(s, d, "WARN"), ["service_name"], 60).select("service_name", "trace_id", "r_trace_id"), """
SELECT a.service_name, a.trace_id, b.trace_id AS r_trace_id FROM logs a JOIN logs b ON a.service_name = b.service_name AND abs(epoch_us(a.time) - epoch_us(b.time)) <= 60000000 WHERE a.level = 'ERROR' AND b.level = 'WARN'""", "logs")
_add("j10_nearest_join", lambda s, d: timejoins.nearest_join(_metric(s, d, "purchase"), _metric(s, d, "error"), ["datapack", "service_name"], "seq"), """
WITH l AS (SELECT * FROM metrics WHERE metric = 'purchase'), r AS (SELECT * FROM metrics WHERE metric = 'error'),
x AS (SELECT l.datapack, l.service_name, l.seq, r.seq AS r_seq, row_number() OVER (PARTITION BY l.seq ORDER BY abs(epoch_us(l.time) - epoch_us(r.time)), r.time > l.time, CASE WHEN r.time <= l.time THEN -r.seq ELSE r.seq END) AS i FROM l LEFT JOIN r ON l.datapack = r.datapack AND l.service_name = r.service_name)
SELECT datapack, service_name, seq, r_seq FROM x WHERE i = 1""", "metrics")
_add("j17_period_delta", lambda s, d: compare.period_delta(fx.spans(s, d)), """
WITH g AS (SELECT datapack, service_name, span_name, avg(duration) FILTER (period = 'abnormal') / 1e6 AS bad, coalesce(avg(duration) FILTER (period = 'normal') / 1e6, 0) AS good FROM spans GROUP BY ALL)
SELECT datapack, service_name, span_name, round(bad, 6) AS bad, round(good, 6) AS good, round(bad - good, 6) AS delta FROM g WHERE bad IS NOT NULL""", "spans")
_add("j21_degrees", lambda s, d: joins.degrees(joins.service_graph(fx.spans(s, d))), f"""
WITH e AS ({_EDGES}), x AS (SELECT datapack, src AS service_name, 1 AS o, 0 AS i FROM e UNION ALL SELECT datapack, dst, 0, 1 FROM e)
SELECT datapack, service_name, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM x GROUP BY ALL""", "spans")
_add("a06_max_duration", lambda s, d: compare.max_duration(fx.spans(s, d), "day"), "SELECT datapack, CAST(date_trunc('day', time) AS TIMESTAMP) AS time, max(duration) AS max_duration FROM spans GROUP BY ALL", "spans")
_add("a07_golden_signals", lambda s, d: compare.golden_signals(fx.spans(s, d), 240.0), """
SELECT datapack, period, service_name, round(avg(duration) / 1e6, 6) AS avg_ms, round(quantile_cont(duration / 1e6, 0.5), 6) AS p50, round(quantile_cont(duration / 1e6, 0.95), 6) AS p95, round(quantile_cont(duration / 1e6, 0.99), 6) AS p99,
  round(count(*) / 240.0, 9) AS rps, round(count(*) FILTER (status_code = 'Error') / count(*) * 100, 6) AS error_percent, round(count(*) FILTER (status_code = 'Error') / 240.0, 9) AS eps FROM spans GROUP BY ALL""", "spans")
_add("a11_operation_rates", lambda s, d: compare.operation_rates(fx.spans(s, d)), """
WITH g AS (SELECT datapack, period, service_name, span_name, count(*) AS n, (epoch_us(max(time)) - epoch_us(min(time))) / 60e6 AS m, avg(CASE WHEN status_code = 'Error' THEN 1.0 ELSE 0.0 END) AS e FROM spans GROUP BY ALL)
SELECT datapack, period, service_name, span_name, round(CASE WHEN m > 0 THEN n / m ELSE CAST(n AS DOUBLE) END, 9) AS qpm, round(e, 6) AS error_rate FROM g""", "spans")
_add("a14_service_error_rates", lambda s, d: compare.service_error_rates(fx.spans(s, d)), """
WITH g AS (SELECT datapack, service_name, span_name, avg(CASE WHEN status_code = 'Error' THEN 1.0 ELSE 0.0 END) FILTER (period = 'normal') AS n, avg(CASE WHEN status_code = 'Error' THEN 1.0 ELSE 0.0 END) FILTER (period = 'abnormal') AS a FROM spans GROUP BY ALL)
SELECT datapack, service_name, round(avg(n), 6) AS normal, round(avg(a), 6) AS abnormal, count(*) AS functions FROM g WHERE n IS NOT NULL AND a IS NOT NULL GROUP BY ALL""", "spans")
_add("a10_indicator_stats", lambda s, d: compare.indicator_stats(fx.metrics(s, d)), """
WITH r AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY datapack, service_name, metric, period) AS n FROM metrics WHERE value IS NOT NULL WINDOW w AS (PARTITION BY datapack, service_name, metric, period ORDER BY value))
SELECT datapack, service_name, metric, period, count(*) AS n, min(value) AS lo, max(value) AS hi, round(avg(value), 6) AS mean, """ + ", ".join(f"round(avg(value) FILTER (i >= floor(n * CAST({p} AS DOUBLE)) AND i < n - floor(n * CAST({p} AS DOUBLE))), 6) AS trimmed_{int(p * 100)}" for p in (0.05, 0.1, 0.25)) + ", "
     + ", ".join(f"round(quantile_cont(value, {p}), 6) AS p{int(p * 100)}" for p in (0.5, 0.9, 0.95, 0.99)) + " FROM r GROUP BY datapack, service_name, metric, period", "metrics")
_add("a15_varying_metrics", lambda s, d: compare.varying_metrics(fx.metrics(s, d)), "SELECT datapack, service_name, metric FROM metrics GROUP BY ALL HAVING max(value) - min(value) >= 1e-8", "metrics")
_add("a17_row_counts", lambda s, d: fx.spans(s, d).groupBy("datapack").count().select("datapack", F.lit("traces").alias("signal"), F.col("count").alias("n")).unionByName(fx.logs(s, d).groupBy("datapack").count().select("datapack", F.lit("logs").alias("signal"), F.col("count").alias("n"))).unionByName(fx.metrics(s, d).groupBy("datapack").count().select("datapack", F.lit("metrics").alias("signal"), F.col("count").alias("n"))), """
SELECT datapack, 'traces' AS signal, count(*) AS n FROM spans GROUP BY ALL UNION ALL SELECT datapack, 'logs', count(*) FROM logs GROUP BY ALL UNION ALL SELECT datapack, 'metrics', count(*) FROM metrics GROUP BY ALL""", "spans", "logs", "metrics")
_add("a19_normal_durations", lambda s, d: compare.normal_durations(fx.spans(s, d)), "SELECT datapack, max(duration / 1e9) AS longest, min(duration / 1e9) AS shortest, round(avg(duration) / 1e9, 6) AS mean, round(quantile_cont(duration / 1e9, 0.5), 6) AS median FROM spans WHERE period = 'normal' GROUP BY ALL", "spans")
_add("a33_ranking_rollup", lambda s, d: evaluate.ranking_rollup(fx.rankings(s, d).withColumn("dataset", F.concat(F.lit("d"), F.col("datapack") % 5))), """
WITH b AS (SELECT algorithm, 'd' || (datapack % 5) AS dataset, datapack, min(rank) FILTER (hit) AS best, max(runtime) AS t FROM rankings GROUP BY ALL)
SELECT algorithm, dataset, count(*) AS total, count(*) FILTER (best <= 1) AS count_1, round(avg(1 / best), 6) AS mrr, round(avg(t), 6) AS avg_runtime FROM b GROUP BY GROUPING SETS ((algorithm, dataset), (algorithm))""", "rankings")
_add("w01_latest_execution", lambda s, d: evaluate.latest(fx.read(s, d, "orders"), ["o_orderpriority", "o_custkey"], "o_orderdate", "o_orderkey").select("o_orderpriority", "o_custkey", "o_orderkey"), """
SELECT o_orderpriority, o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS i FROM orders) WHERE i = 1""")
_add("w02_first_entry", lambda s, d: coverage.first_entry(fx.spans(s, d)), f"WITH {_ENTRIES} SELECT * FROM entries", "spans")
_add("w13_rank_sum", lambda s, d: compare.rank_sum(fx.spans(s, d)), f"""
WITH r AS (SELECT datapack, span_name, period, rank() OVER w + (count(*) OVER (PARTITION BY datapack, span_name, duration) - 1) / 2 AS rank, count(*) OVER (PARTITION BY datapack, span_name, duration) AS t FROM spans WINDOW w AS (PARTITION BY datapack, span_name ORDER BY duration)),
g AS (SELECT datapack, span_name, count(*) FILTER (period = 'normal') AS n1, count(*) FILTER (period = 'abnormal') AS n2, sum(rank) FILTER (period = 'normal') AS r, sum(CAST(t AS DOUBLE) * t - 1) AS ties, count(*) AS n FROM r GROUP BY ALL),
u AS (SELECT *, r - n1 * (n1 + 1) / 2 AS u, n1 * CAST(n2 AS DOUBLE) AS p FROM g WHERE n1 >= 10 AND n2 >= 10),
x AS (SELECT datapack, span_name, n1, n2, u, greatest(0, abs(u - p / 2) - 0.5) / sqrt(p / 12 * (n + 1 - ties / (n * (n - 1)))) AS z FROM u) SELECT datapack, span_name, n1, n2, u, round(z, 6) AS z, round({_p_sql('z')}, 6) AS p FROM x""", "spans")
_add("d13_node_anomalies", lambda s, d: compare.node_anomalies(fx.metrics(s, d), 0.2), "WITH g AS (SELECT datapack, service_name, metric, " + ", ".join(f"round({f} FILTER (period = '{p}'), 9) AS {p}_{k}" for k, f in (("mean", "avg(value)"), ("std", "stddev_samp(value)"), ("p90", "quantile_cont(value, 0.9)")) for p in ("normal", "abnormal"))
     + " FROM metrics GROUP BY ALL), x AS (" + " UNION ALL ".join(f"SELECT datapack, service_name, metric, '{k}' AS stat, normal_{k} AS a, abnormal_{k} AS b FROM g" for k in ("mean", "std", "p90")) + """)
SELECT datapack, service_name, metric, stat, round(CASE WHEN a = 0 THEN CASE WHEN b = 0 THEN 0 ELSE 1 END ELSE (b - a) / a END, 6) AS diff FROM x WHERE a IS NOT NULL AND b IS NOT NULL AND abs(round(CASE WHEN a = 0 THEN CASE WHEN b = 0 THEN 0 ELSE 1 END ELSE (b - a) / a END, 6)) > CAST(0.2 AS DOUBLE)""", "metrics")
_add("d01_threshold_detector", lambda s, d: detect.threshold_detector(fx.metrics(s, d), 10.0, 150.0), """
SELECT datapack, service_name, metric, seq, value, CASE WHEN value > 150 THEN 'high' ELSE 'low' END AS kind, CASE WHEN x >= 2 THEN 'critical' WHEN x >= 1.5 THEN 'high' WHEN x >= CAST(1.2 AS DOUBLE) THEN 'medium' ELSE 'low' END AS severity, round(least(x, 2) / 2, 6) AS confidence
FROM (SELECT *, CASE WHEN value > 150 THEN value / 150 ELSE 10 / greatest(value, CAST(0.001 AS DOUBLE)) END AS x FROM metrics WHERE value > 150 OR value < 10)""", "metrics")
_add("e06_edge_scores", lambda s, d: coverage.set_scores(_edges_of(s, d, "abnormal"), _edges_of(s, d, "normal"), ["datapack"]), f"""
WITH f AS ({_PERIOD_EDGES.format(p='abnormal')}), t AS ({_PERIOD_EDGES.format(p='normal')}),
g AS (SELECT coalesce(f.datapack, t.datapack) AS datapack, count(f.src) AS f, count(t.src) AS t, count(*) FILTER (f.src IS NOT NULL AND t.src IS NOT NULL) AS matched FROM f FULL JOIN t ON f.datapack = t.datapack AND f.src = t.src AND f.dst = t.dst GROUP BY ALL)
SELECT datapack, matched, t - matched AS missed, f - matched AS extra, round(CASE WHEN f > 0 THEN matched / f ELSE 0 END, 6) AS precision, round(CASE WHEN t > 0 THEN matched / t ELSE 0 END, 6) AS recall, round(2 * matched / (f + t), 6) AS f1 FROM g""", "spans")
_add("k11_rare_entries", lambda s, d: coverage.rare_entries(fx.spans(s, d), 0.03), f"""
WITH {_ENTRIES}, n AS (SELECT datapack, span_name, count(*) AS n FROM entries GROUP BY ALL), p AS (SELECT *, round(n / sum(n) OVER (PARTITION BY datapack), 6) AS part FROM n)
SELECT * FROM p WHERE part < CAST(0.03 AS DOUBLE)""", "spans")
_add("t07_pattern_entropy", lambda s, d: coverage.pattern_entropy(fx.spans(s, d), _samples(s, d)), """WITH RECURSIVE t AS (
  SELECT datapack, trace_id, span_id, service_name || ':' || span_name AS label, 1 AS level FROM spans WHERE parent_span_id = '' AND trace_id % 10 = 0
  UNION ALL SELECT c.datapack, c.trace_id, c.span_id, c.service_name || ':' || c.span_name, t.level + 1 FROM t JOIN spans c ON c.trace_id = t.trace_id AND c.parent_span_id = t.span_id),
e AS (SELECT datapack, trace_id, string_agg(label, ' -> ' ORDER BY level, label) AS code FROM t GROUP BY ALL), n AS (SELECT datapack, code, count(*) AS n FROM e GROUP BY ALL), p AS (SELECT datapack, n / sum(n) OVER (PARTITION BY datapack) AS p FROM n)
SELECT datapack, round(-sum(p * log2(p)), 6) AS entropy, count(*) AS patterns FROM p GROUP BY ALL""", "spans")
_add("t09_sampler_scores", lambda s, d: coverage.sampler_scores(fx.spans(s, d), _samples(s, d), 0.1, 0.03), f"""
WITH {_ENTRIES}, n AS (SELECT datapack, span_name, count(*) AS n, count(*) FILTER (trace_id % 10 = 0) AS s FROM entries GROUP BY ALL), x AS (SELECT *, n / sum(n) OVER (PARTITION BY datapack) < CAST(0.03 AS DOUBLE) AS rare FROM n),
g AS (SELECT datapack, CAST(sum(n) AS BIGINT) AS traces, CAST(sum(s) AS BIGINT) AS sampled, count(*) FILTER (s > 0) AS k, count(*) AS types, CAST(coalesce(sum(s) FILTER (rare), 0) AS BIGINT) AS rare_sampled, stddev_pop(s) FILTER (s > 0) AS sd, avg(s) FILTER (s > 0) AS m FROM x GROUP BY ALL)
SELECT datapack, traces, sampled, round(sampled / traces, 6) AS actual_rate, round(abs(sampled / traces - CAST(0.1 AS DOUBLE)) / CAST(0.1 AS DOUBLE), 6) AS controllability, round(k / types, 6) AS api_coverage, rare_sampled, round(CASE WHEN k > 1 THEN sd / m ELSE 0 END, 6) AS balance_cv FROM g""", "spans")
_add("t10_span_coverage", lambda s, d: coverage.span_coverage(fx.spans(s, d), _samples(s, d)), """
WITH g AS (SELECT datapack, count(DISTINCT service_name || '|' || span_name) AS names, count(DISTINCT service_name || '|' || span_name) FILTER (trace_id % 10 = 0) AS sampled_names FROM spans GROUP BY ALL)
SELECT *, round(sampled_names / names, 6) AS coverage FROM g""", "spans")
_add("w06_service_distance", lambda s, d: coverage.distances(joins.service_graph(fx.spans(s, d)), "loadgenerator"), f"""WITH RECURSIVE e AS ({_EDGES}),
w AS (SELECT DISTINCT datapack, src AS service_name, 0 AS distance FROM e WHERE src = 'loadgenerator' UNION SELECT e.datapack, e.dst, w.distance + 1 FROM w JOIN e ON e.datapack = w.datapack AND e.src = w.service_name WHERE w.distance < 8)
SELECT datapack, service_name, min(distance) AS distance FROM w GROUP BY ALL""", "spans")
_add("g10_operation_times", lambda s, d: joins.operation_times(fx.spans(s, d)), """
WITH k AS (SELECT trace_id, parent_span_id, sum(duration) AS d FROM spans WHERE parent_span_id <> '' GROUP BY ALL)
SELECT s.datapack, s.trace_id, service_name, span_name, count(*) AS n, CAST(sum(duration) AS BIGINT) AS total, CAST(sum(coalesce(k.d, 0)) AS BIGINT) AS inner_total, min(time) AS first, max(time) AS last FROM spans s LEFT JOIN k ON s.trace_id = k.trace_id AND s.span_id = k.parent_span_id GROUP BY ALL""", "spans")
_add("g21_random_ranking", lambda s, d: sampling.random_ranking(fx.spans(s, d)), """
WITH n AS (SELECT DISTINCT datapack, service_name AS name FROM spans WHERE period = 'abnormal' AND trim(service_name) <> '')
SELECT datapack, name, row_number() OVER (PARTITION BY datapack ORDER BY md5(datapack || ':' || name || ':0'), name) AS rank FROM n""", "spans")
_add("p17_log_search", lambda s, d: names.search(fx.read(s, d, "documents").select("doc_id", "lang", "text"), "text", "License").select("doc_id", "lang"), "SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'license')")
_add("f05_json_message", lambda s, d: fx.logs(s, d).select("trace_id", names.json_message(F.col("message"), "k").alias("message")), "SELECT trace_id, coalesce(json_extract_string(message, '$.k'), message) AS message FROM logs", "logs")

from tracejobs import queries_detect, queries_events, queries_graph, queries_ingest, queries_logs, queries_more, queries_paths  # noqa: E402, F401  (they register their queries here)
