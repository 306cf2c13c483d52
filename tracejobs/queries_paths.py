"""Queries of shortest paths, alignment and judged graphs over the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracejobs.operators import coverage, evaluate, joins, judge, paths, quality, relations, sampling, sli
from tracejobs.operators.rounds import cut
from tracejobs.queries import _EDGES, _add
from tracejobs.sources import fixtures as fx

# A sparse part of the service graph: from the entry to one service, and on by one or three, so that paths are several hops long
_D, _E = "CAST(substr(dst, 5) AS INT)", "CAST(substr(src, 5) AS INT)"
_KEEP = f"CASE WHEN src = 'loadgenerator' THEN dst = 'svc-0' ELSE dst <> 'loadgenerator' AND ({_D} = ({_E} + 1) % 7 OR (datapack IN ('dp0', 'dp2', 'dp4', 'dp6') AND {_D} = ({_E} + 3) % 7)) AND NOT (datapack = 'dp5' AND {_D} = 5) END"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return joins.service_graph(fx.spans(spark, d)).where(_KEEP)


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    spans = fx.spans(spark, d)
    rank = lambda seed: sampling.random_ranking(spans, seed).select("datapack", F.lit(f"a{seed}").alias("algorithm"), "rank", F.when(F.col("rank") == 3, "unknown").otherwise(F.col("name")).alias("name"))
    return cut(rank(0).unionByName(rank(1)))


def _truths(spark: SparkSession, d: str) -> DataFrame:
    digit = F.substring("datapack", 3, 1).cast("int")
    packs = fx.spans(spark, d).select("datapack").distinct()
    return packs.select("datapack", F.explode(F.array(F.concat(F.lit("svc-"), digit % 7), F.concat(F.lit("svc-"), (digit * 2 + 1) % 7))).alias("name"))


def _align(spark: SparkSession, d: str) -> DataFrame:
    return paths.alignment_scores(cut(_edges(spark, d)), "loadgenerator", _predictions(spark, d), _truths(spark, d), 6)


def _paths(spark: SparkSession, d: str) -> DataFrame:
    edges = cut(_edges(spark, d))
    found = paths.shortest_paths(edges, edges.select("datapack", F.col("src").alias("source")))
    return found.select("datapack", "source", "target", F.array_join("path", ">").alias("path"), (F.size("path") - 1).alias("hops"))


_SPARSE = f"e AS (SELECT * FROM ({_EDGES}) WHERE {_KEEP}), nodes AS (SELECT datapack, src AS name FROM e UNION SELECT datapack, dst FROM e)"
_WALKS = """w AS (SELECT DISTINCT datapack, name AS source, name AS target, [name] AS path FROM nodes UNION ALL SELECT w.datapack, w.source, e.dst, list_append(w.path, e.dst) FROM w JOIN e ON e.datapack = w.datapack AND e.src = w.target WHERE NOT list_contains(w.path, e.dst)),
sp AS (SELECT datapack, source, target, path FROM (SELECT *, row_number() OVER (PARTITION BY datapack, source, target ORDER BY len(path), path) AS i FROM w) WHERE i = 1)"""
_PRED = "pred AS (" + " UNION ALL ".join(f"SELECT datapack, 'a{k}' AS algorithm, rank, CASE rank WHEN 3 THEN 'unknown' ELSE name END AS name FROM (SELECT datapack, name, row_number() OVER (PARTITION BY datapack ORDER BY md5(datapack || ':' || name || ':{k}'), name) AS rank FROM (SELECT DISTINCT datapack, service_name AS name FROM spans WHERE period = 'abnormal' AND trim(service_name) <> ''))" for k in (0, 1)) + ")"
_TRUE = "tr AS (SELECT DISTINCT datapack, 'svc-' || unnest([CAST(substr(datapack, 3) AS INT) % 7, (CAST(substr(datapack, 3) AS INT) * 2 + 1) % 7]) AS name FROM (SELECT DISTINCT datapack FROM spans))"

_add("w06_shortest_paths", _paths, f"WITH RECURSIVE {_SPARSE}, {_WALKS} SELECT datapack, source, target, array_to_string(path, '>') AS path, CAST(len(path) - 1 AS INT) AS hops FROM sp WHERE (datapack, source) IN (SELECT (datapack, src) FROM e)", "spans")
_add("a35_alignment_scores", _align, f"""WITH RECURSIVE {_SPARSE}, {_WALKS}, {_PRED}, {_TRUE}, tp AS (SELECT sp.datapack, target AS truth, path AS g FROM sp JOIN tr ON tr.datapack = sp.datapack AND tr.name = target WHERE source = 'loadgenerator'),
x AS (SELECT p.*, n.name IS NOT NULL AS known FROM pred p LEFT JOIN nodes n ON n.datapack = p.datapack AND n.name = p.name WHERE rank <= 6 AND p.datapack IN (SELECT datapack FROM tp)),
s AS (SELECT x.datapack, x.algorithm, x.rank, max(CASE WHEN b.path IS NULL OR len(g) = 1 THEN 0 ELSE coalesce((len(g) - 1) / nullif(len(a.path) - 1 + len(b.path) - 1, 0), 0) END * len(list_intersect(a.path, g)) / len(list_distinct(list_concat(a.path, g)))) AS score
  FROM x JOIN sp a ON a.datapack = x.datapack AND a.source = 'loadgenerator' AND a.target = x.name JOIN tp ON tp.datapack = x.datapack LEFT JOIN sp b ON b.datapack = x.datapack AND b.source = x.name AND b.target = tp.truth GROUP BY ALL)
SELECT datapack, algorithm, rank, name, round(CASE WHEN known THEN max(CASE WHEN known THEN coalesce(score, 0) END) OVER (PARTITION BY datapack, algorithm ORDER BY rank) ELSE 0 END, 6) AS alignment FROM x LEFT JOIN s USING (datapack, algorithm, rank)""", "spans")
_add("a36_path_efficiency", lambda s, d: paths.path_efficiency(cut(_edges(s, d)), "loadgenerator", _predictions(s, d).where("rank IN (1, 2)"), _truths(s, d)), f"""WITH RECURSIVE {_SPARSE}, {_WALKS}, {_PRED}, {_TRUE}, lg AS (SELECT * FROM sp WHERE source = 'loadgenerator'), tv AS (SELECT DISTINCT lg.datapack, unnest(path) AS v FROM lg JOIN tr ON tr.datapack = lg.datapack AND tr.name = target),
p2 AS (SELECT p.*, lg.path FROM pred p LEFT JOIN lg ON lg.datapack = p.datapack AND lg.target = p.name WHERE rank IN (1, 2)), l AS (SELECT datapack, algorithm, bool_or(path IS NULL) AS lost FROM p2 GROUP BY ALL), v AS (SELECT DISTINCT datapack, algorithm, unnest(path) AS v FROM p2),
q AS (SELECT v.datapack, algorithm, count(tv.v) / count(*) AS part FROM v LEFT JOIN tv ON tv.datapack = v.datapack AND tv.v = v.v GROUP BY ALL) SELECT datapack, algorithm, round(CASE WHEN lost THEN 0 ELSE coalesce(part, 0) END, 6) AS efficiency FROM l LEFT JOIN q USING (datapack, algorithm)""", "spans")


# Judged graphs: a sample is a fifth of a datapack; the true graph is its normal period's, the found one its abnormal period's, under other spellings
_SAMPLE = "datapack || '/' || (trace_id % 5)"


def _side(spans: DataFrame, found: bool) -> DataFrame:
    """(sample, component, state, timestamp) of the services of a period."""
    name = F.concat(F.lit(" service|TS-"), F.upper("service_name")) if found else F.col("service_name")
    own = spans.where("period = 'abnormal' AND trace_id % 7 < 4 AND service_name <> 'svc-3'" if found else "period = 'normal' AND service_name <> 'svc-6'")
    return own.select(F.expr(_SAMPLE).alias("sample"), name.alias("component"), F.when(F.col("duration") % 3 != 0, F.col("status_code")).alias("state"), F.unix_timestamp("time").alias("timestamp"))


_JUDGED = "f AS (SELECT {s} AS sample, ' service|TS-' || upper(service_name) AS component, replace(service_name, '-', '') AS name, CASE WHEN duration % 3 <> 0 THEN status_code END AS state FROM spans WHERE period = 'abnormal' AND trace_id % 7 < 4 AND service_name <> 'svc-3'), t AS (SELECT {s} AS sample, service_name AS component, replace(service_name, '-', '') AS name, CASE WHEN duration % 3 <> 0 THEN status_code END AS state FROM spans WHERE period = 'normal' AND service_name <> 'svc-6')".replace("{s}", _SAMPLE)
_add("e07_component_scores", lambda s, d: judge.component_scores(_side(fx.spans(s, d), True), _side(fx.spans(s, d), False)), f"""WITH {_JUDGED}, a AS (SELECT DISTINCT sample, name FROM f), b AS (SELECT DISTINCT sample, name FROM t), j AS (SELECT coalesce(a.sample, b.sample) AS sample, count(a.name) AS nf, count(b.name) AS nt, count(*) FILTER (a.name IS NOT NULL AND b.name IS NOT NULL) AS m FROM a FULL JOIN b ON a.sample = b.sample AND a.name = b.name GROUP BY ALL)
SELECT sample, m AS matched, round(coalesce(m / nullif(nf, 0), 0), 6) AS precision, round(coalesce(m / nullif(nt, 0), 1), 6) AS recall, round(CASE WHEN m > 0 THEN 2 * m / (nf + nt) ELSE 0 END, 6) AS f1 FROM j""", "spans")
_add("e08_state_scores", lambda s, d: judge.state_scores(_side(fx.spans(s, d), True), _side(fx.spans(s, d), False)), f"""WITH {_JUDGED}, a AS (SELECT DISTINCT sample, name, state FROM f WHERE state IS NOT NULL), b AS (SELECT DISTINCT sample, name, state FROM t WHERE state IS NOT NULL), m AS (SELECT a.sample, count(DISTINCT a.name) AS m FROM a JOIN b ON a.sample = b.sample AND a.name = b.name AND a.state = b.state GROUP BY ALL),
x AS (SELECT sample, count(DISTINCT name) AS nf FROM a GROUP BY ALL), y AS (SELECT sample, count(DISTINCT name) AS nt FROM b GROUP BY ALL)
SELECT sample, round(CASE WHEN nt IS NULL THEN 1 ELSE coalesce(m, 0) / nt END, 6) AS coverage, round(CASE WHEN nf IS NULL THEN 0 ELSE (nf - coalesce(m, 0)) / nf END, 6) AS extra FROM x FULL JOIN y USING (sample) LEFT JOIN m USING (sample)""", "spans")
_add("e10_temporal_scores", lambda s, d: judge.temporal_scores(fx.spans(s, d).where("period = 'abnormal'").select(F.expr(_SAMPLE).alias("sample"), F.col("service_name").alias("component"), (F.unix_timestamp("time") - 800_000_000).alias("timestamp")), fx.spans(s, d).where("period = 'normal'").select(F.expr(_SAMPLE).alias("sample"), F.col("service_name").alias("component"), (F.unix_timestamp("time") - 700_000_000).alias("timestamp"))), f"""
WITH a AS (SELECT {_SAMPLE} AS sample, service_name AS c, max(epoch(time)::BIGINT - 800000000) AS f FROM spans WHERE period = 'abnormal' GROUP BY ALL), b AS (SELECT {_SAMPLE} AS sample, service_name AS c, max(epoch(time)::BIGINT - 700000000) AS t FROM spans WHERE period = 'normal' GROUP BY ALL)
SELECT sample, round(1 - avg(least(abs(f - t) / abs(t), 1)), 6) AS score FROM a JOIN b USING (sample, c) WHERE t <> 0 GROUP BY ALL""", "spans")

# Roots: the found ones are the slowest abnormal services, the true ones the slowest normal ones; alarms are services with an error of a fifth of the operations
_ROOTS = "SELECT datapack AS sample, service_name AS service FROM (SELECT datapack, service_name, row_number() OVER (PARTITION BY datapack ORDER BY max(duration) DESC, service_name) AS i FROM spans WHERE period = '{p}' AND service_name <> 'loadgenerator' GROUP BY datapack, service_name) WHERE i <= 3"


def _reachable(spark: SparkSession, d: str) -> DataFrame:
    spans = cut(fx.spans(spark, d))
    edges = cut(joins.service_graph(spans).where(_KEEP)).select(F.col("datapack").alias("sample"), "src", "dst")
    spans.createOrReplaceTempView("judged_spans")
    roots = lambda p: cut(spark.sql(_ROOTS.format(p=p).replace("FROM spans", "FROM judged_spans")))
    found, true = roots("abnormal"), roots("normal")
    alarms = spans.where("status_code = 'Error' AND (datapack = 'dp1' AND service_name = 'loadgenerator' OR datapack NOT IN ('dp1', 'dp3') AND service_name = 'svc-6')").select(F.col("datapack").alias("sample"), F.col("service_name").alias("service")).distinct()
    true_edges = edges.unionByName(edges.where("src = 'loadgenerator'").select("sample", F.lit("svc-2").alias("src"), F.lit("loadgenerator").alias("dst")))
    return judge.path_reachability(edges.where("dst <> 'svc-5'"), found, true, alarms, true_edges)


_add("e09_path_reachability", _reachable, f"""WITH RECURSIVE {_SPARSE}, fr AS ({_ROOTS.format(p='abnormal')}), tr AS ({_ROOTS.format(p='normal')}), ok AS (SELECT * FROM fr INTERSECT SELECT * FROM tr),
al AS (SELECT DISTINCT datapack AS sample, service_name AS service FROM spans WHERE status_code = 'Error' AND (datapack = 'dp1' AND service_name = 'loadgenerator' OR datapack NOT IN ('dp1', 'dp3') AND service_name = 'svc-6')),
goal AS (SELECT * FROM al WHERE service <> 'loadgenerator' UNION SELECT DISTINCT a.sample, 'svc-2' FROM al a JOIN e ON e.datapack = a.sample AND e.src = 'loadgenerator' WHERE a.service = 'loadgenerator'),
reach AS (SELECT * FROM ok UNION SELECT r.sample, e.dst FROM reach r JOIN e ON e.datapack = r.sample AND e.src = r.service WHERE e.dst <> 'svc-5'), samples AS (SELECT sample FROM fr UNION SELECT sample FROM tr)
SELECT sample, CASE WHEN sample IN (SELECT sample FROM ok) AND sample IN (SELECT sample FROM goal) THEN EXISTS (SELECT 1 FROM reach r JOIN goal g USING (sample, service) WHERE r.sample = samples.sample) END AS reachable FROM samples""", "spans")


# Services of greatest magnitude and how far the root causes are
_add("k03_nearest_of_top", lambda s, d: paths.nearest_of_top(cut(_edges(s, d)), sli.anomaly_magnitude(fx.metrics(s, d)), _truths(s, d), 2), f"""WITH RECURSIVE {_SPARSE}, {_WALKS}, {_TRUE}, g AS (SELECT datapack, service_name, metric, min(value) AS lo, max(value) AS hi, avg(value) FILTER (period = 'abnormal') AS a, avg(value) FILTER (period = 'normal') AS n FROM metrics GROUP BY ALL),
m AS (SELECT datapack, service_name, round(sum(coalesce(CASE WHEN hi > lo THEN abs(a - n) / (hi - lo) END, 0)), 6) AS magnitude FROM g GROUP BY ALL), top AS (SELECT datapack, service_name FROM (SELECT *, row_number() OVER (PARTITION BY datapack ORDER BY magnitude DESC, service_name) AS i FROM m) WHERE i <= 2),
own AS (SELECT datapack, service_name AS source, service_name AS target, 0 AS hops FROM top UNION ALL SELECT t.datapack, source, target, len(path) - 1 FROM sp JOIN top t ON t.datapack = sp.datapack AND t.service_name = sp.source)
SELECT t.datapack, CAST(coalesce(min(hops) FILTER (tr.name IS NOT NULL), 999) AS INT) AS distance FROM top t LEFT JOIN own ON own.datapack = t.datapack AND own.source = t.service_name LEFT JOIN tr ON tr.datapack = own.datapack AND tr.name = own.target GROUP BY t.datapack""", "spans", "metrics")


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    edges = cut(_edges(spark, d))
    return edges.where("src <> 'svc-1'"), edges.where("dst <> 'svc-2'").unionByName(edges.where("src = 'svc-4'").select("datapack", F.lit("svc-4").alias("src"), F.lit("svc-9").alias("dst")))


def _elements(spark: SparkSession, d: str) -> DataFrame:
    out = coverage.set_elements(*_sides(spark, d), ["datapack"])
    return out.select("datapack", *[F.array_join(c, ",").alias(c) for c in ("matched", "missed", "extra")])


_add("e06_edge_elements", _elements, f"""WITH {_SPARSE}, f AS (SELECT * FROM e WHERE src <> 'svc-1'), t AS (SELECT * FROM e WHERE dst <> 'svc-2' UNION SELECT datapack, 'svc-4', 'svc-9' FROM e WHERE src = 'svc-4'), j AS (SELECT coalesce(f.datapack, t.datapack) AS datapack, coalesce(f.src, t.src) || ' ' || coalesce(f.dst, t.dst) AS name, f.src IS NOT NULL AS a, t.src IS NOT NULL AS b FROM f FULL JOIN t ON f.datapack = t.datapack AND f.src = t.src AND f.dst = t.dst)
SELECT datapack, coalesce(string_agg(name, ',' ORDER BY name) FILTER (a AND b), '') AS matched, coalesce(string_agg(name, ',' ORDER BY name) FILTER (b AND NOT a), '') AS missed, coalesce(string_agg(name, ',' ORDER BY name) FILTER (a AND NOT b), '') AS extra FROM j GROUP BY ALL""", "spans")
_add("e04_error_spans_in_window", lambda s, d: relations.error_spans(fx.spans(s, d).withColumn("time", F.make_interval(days=F.dayofyear("time") % 30) + F.to_timestamp(F.lit("2024-01-02 12:00:00"))), fx.logs(s, d), 600), """
WITH sp AS (SELECT * EXCLUDE (time), TIMESTAMP '2024-01-02 12:00:00' + to_days(CAST(dayofyear(time) % 30 AS INT)) AS time FROM spans)
SELECT datapack, trace_id, span_id, 'trace' AS source FROM sp WHERE status_code = 'Error' UNION SELECT s.datapack, s.trace_id, s.span_id, 'log' FROM sp s JOIN logs l ON s.datapack = l.datapack AND s.trace_id = l.trace_id AND s.span_id = l.span_id WHERE level = 'ERROR'
UNION SELECT s.datapack, s.trace_id, s.span_id, 'window' FROM sp s JOIN logs l ON s.datapack = l.datapack AND s.service_name = l.service_name AND abs(epoch_us(s.time) - epoch_us(l.time)) <= 600000000 WHERE level = 'ERROR'""", "spans", "logs")


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return fx.rankings(spark, d).withColumns({"dataset": F.concat(F.lit("d"), F.col("datapack") % 5), "sampler": F.concat(F.lit("s"), F.col("datapack") % 3), "runtime": F.col("runtime") * 1.0371})


_KS, _LEVELS = range(1, 6), {"datapack": ("dataset", "datapack"), "dataset": ("dataset",), "algorithm": (), "sampler": ("sampler",), "sampler_dataset": ("sampler", "dataset")}


def _level_sql(level: str) -> str:
    by = ("algorithm", *_LEVELS[level])
    mean = lambda x, k: "(" + " + ".join(x.format(k=i) for i in range(1, k + 1)) + f") / {k}"
    ac, p = "count(*) FILTER (best <= {k}) / count(*)", "sum(h{k}) / ({k} * count(*))"
    scores = [f"count(*) FILTER (best <= {k}) AS count_{k}, round({ac.format(k=k)}, 6) AS ac_{k}, round({mean(ac, k)}, 6) AS avg_{k}, round({p.format(k=k)}, 6) AS p_{k}, round({mean(p, k)}, 6) AS map_{k}" for k in _KS]
    columns = [c if c in by else f"NULL AS {c}" for c in ("algorithm", "sampler", "dataset", "datapack")]
    return f"SELECT '{level}' AS level, {', '.join(columns)}, count(*) AS total, {', '.join(scores)}, coalesce(round(avg(1 / best), 6), 0) AS mrr, coalesce(round(avg(t), 6), 0) AS avg_runtime FROM r GROUP BY {', '.join(by)}"


_add("a33_performance_levels", lambda s, d: evaluate.performance(_runs(s, d)), f"WITH r AS (SELECT algorithm, 's' || (datapack % 3) AS sampler, 'd' || (datapack % 5) AS dataset, datapack, min(rank) FILTER (hit) AS best, max(runtime) * CAST(1.0371 AS DOUBLE) AS t, {', '.join(f'count(*) FILTER (hit AND rank <= {k}) AS h{k}' for k in _KS)} FROM rankings GROUP BY ALL) " + " UNION ALL ".join(map(_level_sql, _LEVELS)), "rankings")


# Injections: each datapack has several, made from its number and a counter
_CONFIGS = {
    "NetworkDelay": '{"direction": "%s", "injection_point": {"source_service": "svc-%s", "target_service": "%s"}}',
    "HTTPRequestReplaceMethod": '{"replace_method": %s, "injection_point": {"method": "POST", "app_name": "svc-%s", "server_address": "%s"}}',
    "PodFailure": '{"mem_type": %s, "injection_point": {"app_label": "svc-%s", "other": "%s"}}',
    "Nothing": '{"mem_type": %s, "x": "svc-%s", "y": "%s"}',
}
_FIRST = {"NetworkDelay": "element_at(array('from', 'to', 'both'), i % 3 + 1)", "HTTPRequestReplaceMethod": "i % 7", "PodFailure": "i % 3", "Nothing": "i"}


def _injections(spark: SparkSession, d: str) -> DataFrame:
    packs = fx.spans(spark, d).select("datapack").distinct().select("datapack", F.explode(F.sequence(F.lit(0), F.lit(35))).alias("i"))
    fault = F.element_at(F.array(*map(F.lit, _CONFIGS)), F.col("i") % 4 + 1)
    target = F.when(F.col("i") % 5 == 0, "loadgenerator").when(F.col("i") % 5 == 1, "").otherwise(F.concat(F.lit("svc-"), F.col("i") % 9))
    config = F.lit(None).cast("string")
    for name, form in _CONFIGS.items():
        config = F.when(fault == name, F.format_string(form, F.expr(_FIRST[name]).cast("string"), (F.col("i") % 11).cast("string"), target)).otherwise(config)
    return packs.select("datapack", "i", fault.alias("fault_type"), config.alias("display_config"))


def _quality(spark: SparkSession, d: str) -> DataFrame:
    spans = cut(fx.spans(spark, d)).where("datapack <> 'dp2' OR service_name <> 'svc-4'")
    again = spans.where("datapack = 'dp3' AND trace_id % 97 = 0")
    scaled = spans.unionByName(again).withColumn("duration", F.when(F.col("datapack") == "dp1", F.col("duration")).otherwise((F.col("duration") / 100).cast("long")))
    out = quality.quality_rules(_injections(spark, d), scaled)
    return out.groupBy("datapack", "fault_type", *quality.RULES, "kicked_out").agg(F.count(F.lit(1)).alias("n"))


_INJ = """inj AS (SELECT datapack, i, ['NetworkDelay', 'HTTPRequestReplaceMethod', 'PodFailure', 'Nothing'][i % 4 + 1] AS fault_type, 'svc-' || (i % 11) AS s, CASE i % 5 WHEN 0 THEN 'loadgenerator' WHEN 1 THEN '' ELSE 'svc-' || (i % 9) END AS t,
  ['from', 'to', 'both'][i % 3 + 1] AS way, ['GET', 'POST', 'PUT', 'DELETE', 'HEAD', 'OPTIONS', 'PATCH'][i % 7 + 1] AS method FROM (SELECT DISTINCT datapack FROM spans), (SELECT unnest(range(0, 36)) AS i))"""
_add("d12_quality_rules", _quality, f"""WITH {_INJ}, sp AS (SELECT * FROM spans WHERE datapack <> 'dp2' OR service_name <> 'svc-4'), c AS (SELECT DISTINCT c.datapack, p.service_name AS src, c.service_name AS dst FROM sp c JOIN sp p ON p.datapack = c.datapack AND p.trace_id = c.trace_id AND p.span_id = c.parent_span_id),
dup AS (SELECT DISTINCT datapack FROM sp WHERE datapack = 'dp3' AND trace_id % 97 = 0), slow AS (SELECT datapack, quantile_cont(CASE datapack WHEN 'dp1' THEN duration ELSE floor(duration / 100) END, 0.99) > 6e9 AS slow FROM sp WHERE period = 'normal' GROUP BY ALL),
x AS (SELECT i.*, EXISTS (SELECT 1 FROM c WHERE c.datapack = i.datapack AND c.src = s AND c.dst = t) AS st, EXISTS (SELECT 1 FROM c WHERE c.datapack = i.datapack AND c.src = t AND c.dst = s) AS ts, EXISTS (SELECT 1 FROM sp WHERE sp.datapack = i.datapack AND service_name = s) AS seen, i.datapack IN (SELECT datapack FROM dup) AS dup, coalesce(slow, false) AS slow, fault_type <> 'Nothing' AS pt FROM inj i LEFT JOIN slow USING (datapack)),
r AS (SELECT datapack, fault_type, fault_type = 'NetworkDelay' AND t <> '' AND NOT ((way IN ('from', 'both') AND st) OR (way IN ('to', 'both') AND ts)) AS network_no_direct_calls, fault_type = 'HTTPRequestReplaceMethod' AND method = 'POST' AS http_method_same, fault_type = 'HTTPRequestReplaceMethod' AND t <> '' AND NOT st AS http_no_direct_calls,
  fault_type IN ('HTTPRequestReplaceMethod', 'PodFailure') AND NOT seen AS target_not_called, pt AND dup AS duplicated_spans, pt AND slow AS large_latency_normal FROM x)
SELECT *, network_no_direct_calls OR http_method_same OR http_no_direct_calls OR target_not_called OR duplicated_spans OR large_latency_normal AS kicked_out, count(*) AS n FROM r GROUP BY ALL""", "spans")
_add("p21_injection_config", lambda s, d: quality.injection_config(_injections(s, d)).select("datapack", "i", "replace_method", "mem_type", "point_direction", "point_source_service", "point_app_label", "has_point"), f"""WITH {_INJ} SELECT datapack, i, CASE fault_type WHEN 'HTTPRequestReplaceMethod' THEN method END AS replace_method, CASE WHEN fault_type IN ('PodFailure') THEN CASE i % 3 WHEN 1 THEN 'heap' WHEN 2 THEN 'stack' END WHEN fault_type = 'Nothing' THEN CASE i WHEN 1 THEN 'heap' WHEN 2 THEN 'stack' END END AS mem_type,
  CASE fault_type WHEN 'NetworkDelay' THEN way END AS point_direction, CASE fault_type WHEN 'NetworkDelay' THEN s END AS point_source_service, CASE fault_type WHEN 'PodFailure' THEN s END AS point_app_label, fault_type <> 'Nothing' AS has_point FROM inj""", "spans")
