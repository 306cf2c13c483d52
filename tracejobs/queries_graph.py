"""Queries over the state graph and the rankings that walk it, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracejobs.operators import causal, relational, stategraph
from tracejobs.operators.rounds import cut, cut_all
from tracejobs.queries import _add
from tracejobs.sources import fixtures as fx

_METRIC_OF = dict(zip(("click", "view", "signup", "purchase", "error"), ("container.cpu.usage:request_percentage", "container.memory.usage:request_percentage", "k8s.container.restarts", "jvm.gc.duration:PS Scavenge:hist.sum", "k8s.pod.cpu.usage")))


def _places(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of pods and containers: a service has two pods of one container each."""
    named = F.create_map(*[F.lit(x) for pair in _METRIC_OF.items() for x in pair])
    pod = F.concat("service_name", F.lit("-"), F.col("seq") % 2)
    return fx.metrics(spark, d).select("datapack", "period", "service_name", "value", F.element_at(named, F.col("metric")).alias("metric"), pod.alias("pod"), F.concat(pod, F.lit("-c")).alias("container"))


class _State:
    """The state graph of all datapacks, its tables computed by one job; spans, which are many, are not kept."""

    def __init__(self, spark: SparkSession, d: str) -> None:
        self.spans, metrics = fx.spans(spark, d), _places(spark, d)
        relations = stategraph.edges(self.spans, metrics)
        found = stategraph.anomalies(stategraph.node_stats(self.spans, metrics, relations))
        called = relations.where("kind = 'calls'").select("datapack", "src", "dst")
        found_edges = stategraph.anomalies(stategraph.edge_stats(self.spans, called))
        self.relations, self.found, self.found_edges = cut_all(relations, found, found_edges)

    def graph(self) -> DataFrame:
        return cut(causal.causal_graph(self.spans, self.relations, self.found, self.found_edges, "loadgenerator"))


def _ranked_sources(spark: SparkSession, d: str) -> DataFrame:
    state = _State(spark, d)
    graph = state.graph()
    return causal.rank_sources(causal.sources(graph, causal.graph_members(state.found, graph)), state.relations)


def _followed(spark: SparkSession, d: str) -> DataFrame:
    state = _State(spark, d)
    return causal.follow_anomalies(state.relations, state.found, state.found_edges, "loadgenerator")


def _node_stats(spark: SparkSession, d: str) -> DataFrame:
    spans, metrics = fx.spans(spark, d), _places(spark, d)
    stats = stategraph.node_stats(spans, metrics, stategraph.edges(spans, metrics))
    shown = lambda c: F.round(F.when(F.col("stat").startswith("latency"), F.col(c) / 1e6).otherwise(F.col(c)), 5).alias(c)  # noqa: E731  (latencies in ms)
    return stats.select("datapack", "node", "stat", shown("normal"), shown("abnormal"))


def _call_stats(spark: SparkSession, d: str) -> DataFrame:
    spans = fx.spans(spark, d)
    return stategraph.edge_stats(spans, stategraph.calls(spans)).select("datapack", "src", "dst", "stat", F.round("normal", 6).alias("normal"), F.round("abnormal", 6).alias("abnormal"))


def _anomalies(spark: SparkSession, d: str) -> DataFrame:
    spans, metrics = fx.spans(spark, d), _places(spark, d)
    found = stategraph.anomalies(stategraph.node_stats(spans, metrics, stategraph.edges(spans, metrics)))
    return found.select("datapack", "node", "stat", "key", "kind", F.round("score", 6).alias("score"))


_PLACES = "places AS (SELECT datapack, period, service_name, value, CASE metric " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _METRIC_OF.items()) + " END AS metric, service_name || '-' || (seq % 2) AS pod, service_name || '-' || (seq % 2) || '-c' AS container FROM metrics)"
_OP = "'function|' || {0}service_name || ' ' || {0}span_name"
_REL = f"""{_PLACES}, calls AS (SELECT DISTINCT c.datapack, {_OP.format('p.')} AS src, {_OP.format('c.')} AS dst FROM spans p JOIN spans c ON p.datapack = c.datapack AND p.trace_id = c.trace_id AND p.span_id = c.parent_span_id),
rel AS (SELECT DISTINCT datapack, 'includes' AS kind, 'service|' || service_name AS src, {_OP.format('')} AS dst FROM spans UNION SELECT datapack, 'routes_to', 'service|' || service_name, 'pod|' || pod FROM places
  UNION SELECT datapack, 'runs', 'pod|' || pod, 'container|' || container FROM places UNION ALL SELECT datapack, 'calls', src, dst FROM calls)"""


def _rate(p: str) -> str:
    return f"coalesce(count(*) FILTER (period = '{p}' AND status_code = 'Error') / nullif(count(*) FILTER (period = '{p}'), 0), 0)"


def _qpm(p: str) -> str:
    span = f"(epoch_us(max(time) FILTER (period = '{p}')) - epoch_us(min(time) FILTER (period = '{p}'))) / 60e6"
    n = f"count(*) FILTER (period = '{p}')"
    return f"CASE WHEN {span} > 0 THEN {n} / ({span}) ELSE {n} END"


_STATS = f"""named AS (SELECT *, {_OP.format('')} AS node FROM spans),
ranks AS (SELECT datapack, node, period, duration, row_number() OVER w AS i, count(*) OVER (PARTITION BY datapack, node, period) AS n FROM named WINDOW w AS (PARTITION BY datapack, node, period ORDER BY duration)),
times AS (SELECT datapack, node, period, quantile_cont(duration::DOUBLE, 0.5) AS p50, quantile_cont(duration::DOUBLE, 0.9) AS p90, avg(duration) FILTER (i > floor(n * CAST(0.1 AS DOUBLE)) AND i <= n - floor(n * CAST(0.1 AS DOUBLE))) AS cut FROM ranks GROUP BY ALL),
fstats AS (SELECT datapack, node, 'error_rate' AS stat, {_rate('normal')} AS normal, {_rate('abnormal')} AS abnormal FROM named GROUP BY datapack, node
  UNION ALL SELECT datapack, node, 'qpm', {_qpm('normal')}, {_qpm('abnormal')} FROM named GROUP BY datapack, node
  UNION ALL SELECT a.datapack, a.node, s, CASE s WHEN 'latency' THEN a.cut WHEN 'latency_p50' THEN a.p50 ELSE a.p90 END, CASE s WHEN 'latency' THEN b.cut WHEN 'latency_p50' THEN b.p50 ELSE b.p90 END
    FROM times a JOIN times b ON a.datapack = b.datapack AND a.node = b.node AND a.period = 'normal' AND b.period = 'abnormal', (SELECT unnest(['latency', 'latency_p50', 'latency_p90']) AS s)),
rules AS (SELECT * FROM (VALUES {', '.join(f"('{m}', '{k}', '{s}', '{h}')" for m, (k, s, h) in stategraph.METRICS.items())}) t(metric, place, stat, how)),
stats AS (SELECT * FROM fstats UNION ALL SELECT r.datapack, r.src, 'function_error_rate.mean', avg(normal), avg(abnormal) FROM rel r JOIN fstats f ON r.kind = 'includes' AND f.stat = 'error_rate' AND f.datapack = r.datapack AND f.node = r.dst GROUP BY r.datapack, r.src
  UNION ALL SELECT * FROM (SELECT datapack, CASE place WHEN 'pod' THEN 'pod|' || pod ELSE 'container|' || container END AS node, stat, CASE any_value(how) WHEN 'max' THEN max(value) FILTER (period = 'normal') ELSE avg(value) FILTER (period = 'normal') END AS normal,
    CASE any_value(how) WHEN 'max' THEN max(value) FILTER (period = 'abnormal') ELSE avg(value) FILTER (period = 'abnormal') END AS abnormal FROM places JOIN rules USING (metric) GROUP BY 1, 2, 3) WHERE normal IS NOT NULL AND abnormal IS NOT NULL)"""
_DIFF = "round(CASE WHEN normal = 0 THEN CASE WHEN abnormal = 0 THEN 0.0 ELSE 1.0 END ELSE (abnormal - normal) / abs(normal) END, 9)"
_KEYS = "CASE stat " + " ".join(f"WHEN '{s}' THEN '{k}'" for s, k in (stategraph.FUNCTION_STATS | stategraph.PLACE_STATS | stategraph.SERVICE_STATS).items()) + " END"
_AN = f"an AS (SELECT datapack, node, stat, {_KEYS} AS key, CASE WHEN diff > 0 THEN 'up' ELSE 'down' END AS kind, abs(diff) AS score FROM (SELECT *, {_DIFF} AS diff FROM stats) WHERE abs(diff) > 0.5)"
_CALLSTATS = """has AS (SELECT DISTINCT datapack, period, trace_id, node FROM named), hn AS (SELECT datapack, node, count(*) FILTER (period = 'normal') AS a, count(*) FILTER (period = 'abnormal') AS b FROM has GROUP BY ALL),
common AS (SELECT c.datapack, c.src, c.dst, count(*) FILTER (x.period = 'normal') AS a, count(*) FILTER (x.period = 'abnormal') AS b FROM calls c JOIN has x ON x.datapack = c.datapack AND x.node = c.src JOIN has y ON y.datapack = c.datapack AND y.period = x.period AND y.trace_id = x.trace_id AND y.node = c.dst GROUP BY ALL),
cstats AS (SELECT c.datapack, src, dst, stat, coalesce(c.a / nullif(n.a, 0), 0) AS normal, coalesce(c.b / nullif(n.b, 0), 0) AS abnormal FROM common c, (SELECT unnest(['forward_call_prob', 'backward_call_prob']) AS stat) JOIN hn n ON n.datapack = c.datapack AND n.node = CASE stat WHEN 'forward_call_prob' THEN src ELSE dst END)"""
_AE = f"ae AS (SELECT datapack, src, dst, stat AS key, CASE WHEN diff > 0 THEN 'up' ELSE 'down' END AS kind, abs(diff) AS score FROM (SELECT *, {_DIFF} AS diff FROM cstats) WHERE abs(diff) > 0.5)"

_GRAPH = f"""ill AS (SELECT DISTINCT datapack, node FROM an WHERE kind = 'up' AND key IN ('error_rate', 'latency')),
fault AS (
  SELECT datapack, node, 'server_failure' AS fault FROM an WHERE node NOT LIKE 'function|%' GROUP BY ALL HAVING bool_or(key = 'restart' AND kind = 'up') OR (bool_or(key = 'cpu' AND kind = 'down' AND score >= 0.8) AND bool_or(key = 'memory' AND kind = 'down' AND score >= 0.8))
  UNION ALL SELECT DISTINCT datapack, node, 'server_exhaustion' FROM an WHERE (node LIKE 'pod|%' AND key = 'jvm_gc_duration' AND kind = 'up' AND score >= 0.5) OR (node LIKE 'container|%' AND key IN ('cpu', 'memory') AND kind = 'up' AND score >= 0.8)),
owns AS (SELECT datapack, src AS service, dst AS node FROM rel WHERE kind = 'includes'), routes AS (SELECT datapack, src AS service, dst AS pod FROM rel WHERE kind = 'routes_to'),
servers AS (SELECT DISTINCT datapack, src AS service, src AS server, NULL AS above FROM rel WHERE kind IN ('includes', 'routes_to') UNION ALL SELECT datapack, service, pod, service FROM routes UNION ALL SELECT r.datapack, r.service, c.dst, r.pod FROM routes r JOIN rel c ON c.kind = 'runs' AND c.datapack = r.datapack AND c.src = r.pod),
sick AS (SELECT s.*, fault FROM servers s JOIN fault f ON f.datapack = s.datapack AND f.node = s.server),
hit AS (SELECT c.datapack, c.src, c.dst, k.server, k.above, k.fault FROM calls c JOIN ill i ON i.datapack = c.datapack AND i.node = c.src JOIN owns a ON a.datapack = c.datapack AND a.node = c.src JOIN owns b ON b.datapack = c.datapack AND b.node = c.dst JOIN sick k ON k.datapack = c.datapack AND k.service = b.service WHERE a.service <> b.service),
ab AS (SELECT DISTINCT c.datapack, c.src, c.dst FROM calls c JOIN ill i ON i.datapack = c.datapack AND i.node = c.src JOIN ae ON ae.datapack = c.datapack AND ae.src = c.src AND ae.dst = c.dst AND ae.key = 'forward_call_prob' AND ae.kind = 'down' AND ae.score >= 0.95),
alone AS (SELECT datapack, src AS client, any_value(dst) AS callee FROM rel GROUP BY ALL HAVING count(*) = 1 AND any_value(kind) = 'calls'),
kids AS (SELECT c.datapack, c.trace_id, c.parent_span_id, ab.src, ab.dst, min(epoch_us(c.time)) AS start, max(epoch_us(c.time) + c.duration / 1000) AS stop FROM named c JOIN named p ON p.datapack = c.datapack AND p.trace_id = c.trace_id AND p.span_id = c.parent_span_id JOIN ab ON ab.datapack = c.datapack AND ab.src = p.node AND ab.dst = c.node GROUP BY ALL),
ord AS (SELECT x.datapack, x.src, x.dst AS u, y.dst AS v FROM kids x JOIN kids y ON x.datapack = y.datapack AND x.trace_id = y.trace_id AND x.parent_span_id = y.parent_span_id AND x.dst <> y.dst GROUP BY ALL HAVING bool_and(x.stop < y.start)),
g0 AS (
  SELECT r.datapack, r.dst AS cause, r.src AS effect, CASE a.key WHEN 'cpu' THEN 'cpu_up' ELSE 'memory_up' END AS why FROM rel r JOIN an a ON a.datapack = r.datapack AND a.node = r.src AND a.kind = 'up' JOIN an b ON b.datapack = r.datapack AND b.node = r.dst AND b.kind = 'up' AND a.key = b.key WHERE r.kind IN ('runs', 'routes_to') AND a.key IN ('cpu', 'memory')
  UNION SELECT r.datapack, r.dst, r.src, a.key || '_up' FROM rel r JOIN an a ON a.datapack = r.datapack AND a.node = r.src AND a.kind = 'up' JOIN an b ON b.datapack = r.datapack AND b.node = r.dst AND b.kind = 'up' AND a.key = b.key WHERE r.kind IN ('calls', 'includes') AND a.key IN ('error_rate', 'latency')
  UNION SELECT datapack, server, src, fault FROM hit UNION SELECT datapack, server, dst, fault FROM hit UNION SELECT datapack, server, above, fault FROM hit WHERE above IS NOT NULL UNION SELECT datapack, dst, src, fault FROM hit
  UNION SELECT datapack, dst, src, 'call_fault' FROM ab
  UNION SELECT l.datapack, l.callee, l.client, k.fault FROM alone l JOIN ab ON ab.datapack = l.datapack AND ab.dst = l.client JOIN owns o ON o.datapack = l.datapack AND o.node = l.callee JOIN sick k ON k.datapack = l.datapack AND k.service = o.service
    WHERE len(split(l.client, ' ')) = 3 AND len(split(l.callee, ' ')) = 3 AND split(l.client, ' ')[3] = split(l.callee, ' ')[3]
  UNION SELECT datapack, u, v, 'call_seq_abort' FROM ord o WHERE NOT EXISTS (SELECT 1 FROM ord x JOIN ord y ON x.datapack = y.datapack AND x.src = y.src AND x.v = y.u WHERE x.datapack = o.datapack AND x.src = o.src AND x.u = o.u AND y.v = o.v)),
g1 AS (SELECT * FROM g0 WHERE cause <> effect),
mem AS (SELECT datapack, node FROM an GROUP BY ALL HAVING NOT (count(*) = 1 AND (any_value(key) = 'qpm' OR any_value(kind) = 'down')) UNION SELECT datapack, cause FROM g1 UNION SELECT datapack, effect FROM g1),
g AS (SELECT * FROM g1 UNION ALL SELECT DISTINCT datapack, node, 'USER', 'user_impact' FROM mem WHERE node LIKE 'function|loadgenerator%' OR (node LIKE 'service|%' AND node <> 'service|loadgenerator' AND EXISTS (SELECT 1 FROM an WHERE an.datapack = mem.datapack AND an.node = mem.node AND an.kind = 'up' AND an.key IN ('error_rate', 'latency', 'cpu', 'memory', 'restart'))))"""
_SERVICE = "svc AS (SELECT datapack, node, split_part(min(service), '|', 2) AS service FROM (SELECT datapack, dst AS node, src AS service FROM rel WHERE kind IN ('includes', 'routes_to') UNION ALL SELECT datapack, src, src FROM rel WHERE kind IN ('includes', 'routes_to') UNION ALL SELECT r.datapack, c.dst, r.service FROM routes r JOIN rel c ON c.kind = 'runs' AND c.datapack = r.datapack AND c.src = r.pod) GROUP BY ALL)"
_ALL = f"{_REL}, {_STATS}, {_AN}, {_CALLSTATS}, {_AE}"

_add("g01_relations", lambda s, d: stategraph.edges(fx.spans(s, d), _places(s, d)), f"WITH {_REL} SELECT * FROM rel", "spans", "metrics")
_add("g09_node_stats", _node_stats, f"WITH {_REL}, {_STATS} SELECT datapack, node, stat, round(CASE WHEN stat LIKE 'latency%' THEN normal / 1e6 ELSE normal END, 5) AS normal, round(CASE WHEN stat LIKE 'latency%' THEN abnormal / 1e6 ELSE abnormal END, 5) AS abnormal FROM stats", "spans", "metrics")
_add("g04_call_stats", _call_stats, f"WITH {_REL}, {_STATS}, {_CALLSTATS} SELECT datapack, src, dst, stat, round(normal, 6) AS normal, round(abnormal, 6) AS abnormal FROM cstats", "spans", "metrics")
_add("g12_anomalies", _anomalies, f"WITH {_REL}, {_STATS}, {_AN} SELECT datapack, node, stat, key, kind, round(score, 6) AS score FROM an", "spans", "metrics")
_add("g12_causal_graph", lambda s, d: _State(s, d).graph(), f"WITH {_ALL}, {_GRAPH} SELECT * FROM g", "spans", "metrics")
_add("g13_ranked_sources", _ranked_sources, f"""WITH RECURSIVE {_ALL}, {_GRAPH}, {_SERVICE},
reach AS (SELECT DISTINCT datapack, cause AS a, effect AS b FROM g UNION SELECT r.datapack, r.a, g.effect FROM reach r JOIN g ON g.datapack = r.datapack AND g.cause = r.b),
cyc AS (SELECT datapack, a AS node FROM reach WHERE a = b), lost AS (SELECT * FROM cyc UNION SELECT r.datapack, r.a FROM reach r JOIN cyc c ON c.datapack = r.datapack AND c.node = r.b),
nodes AS (SELECT * FROM mem UNION SELECT datapack, 'USER' FROM g), done AS (SELECT * FROM nodes EXCEPT SELECT * FROM lost),
walks AS (SELECT DISTINCT datapack, 'USER' AS node FROM g UNION ALL SELECT w.datapack, g.cause FROM walks w JOIN g ON g.datapack = w.datapack AND g.effect = w.node JOIN done d ON d.datapack = g.datapack AND d.node = g.cause),
cnt AS (SELECT datapack, node, count(*) AS paths FROM walks GROUP BY ALL),
src AS (SELECT d.datapack, d.node, coalesce(c.paths, 0) AS paths FROM done d LEFT JOIN cnt c ON c.datapack = d.datapack AND c.node = d.node WHERE d.node <> 'USER' AND NOT EXISTS (SELECT 1 FROM g JOIN done x ON x.datapack = g.datapack AND x.node = g.cause WHERE g.datapack = d.datapack AND g.effect = d.node)),
o AS (SELECT s.datapack, service AS service_name, CAST(sum(paths) AS BIGINT) AS paths FROM src s JOIN svc v ON v.datapack = s.datapack AND v.node = s.node WHERE service <> 'loadgenerator' GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY datapack ORDER BY paths DESC, service_name) AS rank FROM o""", "spans", "metrics")
_add("g11_followed_anomalies", _followed, f"""WITH RECURSIVE {_ALL}, {_GRAPH}, {_SERVICE},
flow AS (SELECT datapack, node, key, count(*) AS times FROM an WHERE kind = 'up' AND stat IN ('error_rate', 'latency', 'latency_p50') AND node LIKE 'function|%' GROUP BY ALL),
top AS (SELECT datapack, node, max(score) AS score FROM an WHERE (node LIKE 'function|%' AND ((kind = 'up' AND stat IN ('error_rate', 'latency', 'latency_p50')) OR (kind = 'down' AND stat = 'qpm'))) OR ((node LIKE 'pod|%' OR node LIKE 'service|%') AND key IN ('cpu', 'memory', 'jvm_gc_duration')) GROUP BY ALL),
sub AS (SELECT c.datapack, a.key, c.src, c.dst FROM calls c JOIN flow a ON a.datapack = c.datapack AND a.node = c.src JOIN flow b ON b.datapack = c.datapack AND b.node = c.dst AND a.key = b.key WHERE c.src <> c.dst),
fr AS (SELECT * FROM sub UNION SELECT f.datapack, f.key, f.src, s.dst FROM fr f JOIN sub s ON s.datapack = f.datapack AND s.key = f.key AND s.src = f.dst),
st AS (SELECT s.* FROM sub s WHERE NOT EXISTS (SELECT 1 FROM fr WHERE fr.datapack = s.datapack AND fr.key = s.key AND fr.src = s.dst AND fr.dst = s.src)),
ew AS (SELECT datapack, src, dst, max(score) AS score FROM ae GROUP BY ALL),
walk AS (SELECT f.datapack, f.key, f.node, f.times, t.score AS total, 1 AS places FROM flow f JOIN top t ON t.datapack = f.datapack AND t.node = f.node WHERE f.node LIKE 'function|loadgenerator%'
  UNION ALL SELECT w.datapack, w.key, s.dst, w.times, w.total + t.score + coalesce(ew.score, 0), w.places + CASE WHEN ew.score IS NULL THEN 1 ELSE 2 END FROM walk w JOIN st s ON s.datapack = w.datapack AND s.key = w.key AND s.src = w.node JOIN top t ON t.datapack = s.datapack AND t.node = s.dst LEFT JOIN ew ON ew.datapack = s.datapack AND ew.src = s.src AND ew.dst = s.dst),
fin AS (SELECT datapack, node, times, total, places FROM walk w WHERE NOT EXISTS (SELECT 1 FROM st s WHERE s.datapack = w.datapack AND s.key = w.key AND s.src = w.node)
  UNION ALL SELECT datapack, node, count(*), max(score), 1 FROM an WHERE (node LIKE 'pod|%' OR node LIKE 'service|%') AND key IN ('cpu', 'memory', 'jvm_gc_duration') GROUP BY datapack, node),
o AS (SELECT f.datapack, v.service AS service_name, CAST(sum(times) AS BIGINT) AS paths, round(max((total + CASE WHEN f.node LIKE 'service|%' THEN 0 ELSE coalesce(t.score, 0) END) / (places + CASE WHEN f.node LIKE 'service|%' OR t.score IS NULL THEN 0 ELSE 1 END)), 6) AS score
  FROM fin f JOIN svc v ON v.datapack = f.datapack AND v.node = f.node LEFT JOIN top t ON t.datapack = f.datapack AND t.node = 'service|' || v.service GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY datapack ORDER BY paths DESC, score DESC, service_name) AS rank FROM o""", "spans", "metrics")


# Relational score: pods and containers by their metrics, services by their spans' latency
def _series(spark: SparkSession, d: str, places: DataFrame, spans: DataFrame) -> DataFrame:
    seq = F.monotonically_increasing_id()
    node = stategraph.node
    of = lambda kind, name: fx.metrics(spark, d).select("datapack", node(kind, name).alias("node"), F.col("metric").alias("name"), "time", "seq", "value", "period").where("value IS NOT NULL")
    pod = F.concat("service_name", F.lit("-"), F.col("seq") % 2)
    few = spans.where("service_name <> 'loadgenerator' AND span_name LIKE '%op0'")
    latency = few.select("datapack", node("service", F.col("service_name")).alias("node"), F.lit("latency").alias("name"), (F.make_interval(days=F.dayofyear("time") % 28) + F.to_timestamp(F.lit("2024-01-02"))).alias("time"), F.expr("CAST(split_part(span_id, '-', 2) AS BIGINT) + trace_id * 100").alias("seq"), (F.col("duration") / 1e9).alias("value"), "period")
    return of("pod", pod).unionByName(of("container", F.concat(pod, F.lit("-c")))).unionByName(latency)


def _relations(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    spans, places = fx.spans(spark, d), _places(spark, d)
    edges = stategraph.edges(spans, places)
    scores = relational.relation_scores(edges.where("kind IN ('routes_to', 'runs')"), _series(spark, d, places, spans), 4, 10, 86400)
    return scores, edges, stategraph.anomalies(stategraph.node_stats(spans, places, edges))


def _rank_relational(spark: SparkSession, d: str) -> DataFrame:
    scores, _, found = _relations(spark, d)
    return relational.rank_relational(scores, found).select("datapack", "node", "score")


_SERIES = """pods AS (SELECT datapack, 'pod|' || service_name || '-' || (seq % 2) AS node, metric AS name, time, seq, value, period FROM metrics WHERE value IS NOT NULL),
series AS (SELECT * FROM pods UNION ALL SELECT datapack, replace(node, 'pod|', 'container|') || '-c', name, time, seq, value, period FROM pods
  UNION ALL SELECT datapack, 'service|' || service_name, 'latency', TIMESTAMP '2024-01-02' + to_days(CAST(dayofyear(time) % 28 AS INT)), CAST(split_part(span_id, '-', 2) AS BIGINT) + trace_id * 100, duration / 1e9, period FROM spans WHERE service_name <> 'loadgenerator' AND span_name LIKE '%op0'),
ways AS (SELECT datapack, src, dst FROM rel WHERE kind IN ('routes_to', 'runs') UNION SELECT datapack, dst, src FROM rel WHERE kind IN ('routes_to', 'runs')), nm AS (SELECT DISTINCT datapack, node, name FROM series),
prs AS (SELECT w.datapack, w.src, w.dst, a.name AS un, b.name AS vn FROM ways w JOIN nm a ON a.datapack = w.datapack AND a.node = w.src JOIN nm b ON b.datapack = w.datapack AND b.node = w.dst WHERE (w.src NOT LIKE 'service|%' OR a.name = 'latency') AND (w.dst NOT LIKE 'service|%' OR b.name = 'latency')),
lf AS (SELECT p.*, s.time, s.seq, s.value, s.period FROM prs p JOIN series s ON s.datapack = p.datapack AND s.node = p.src AND s.name = p.un), rt AS (SELECT p.*, s.time, s.seq, s.value FROM prs p JOIN series s ON s.datapack = p.datapack AND s.node = p.dst AND s.name = p.vn),
nr AS (SELECT l.*, r.value AS value_v, row_number() OVER (PARTITION BY l.datapack, l.src, l.dst, l.un, l.vn, l.seq ORDER BY abs(epoch_us(l.time) - epoch_us(r.time)), r.time > l.time, CASE WHEN r.time <= l.time THEN -r.seq ELSE r.seq END) AS i FROM lf l JOIN rt r ON r.datapack = l.datapack AND r.src = l.src AND r.dst = l.dst AND r.un = l.un AND r.vn = l.vn),
al AS (SELECT * FROM nr WHERE i = 1), sm AS (SELECT datapack, src, dst, un, vn, count(*) FILTER (period = 'normal') AS n, count(*) FILTER (period = 'abnormal') AS m, CASE WHEN stddev_pop(value) FILTER (period = 'abnormal') < 1e-10 OR stddev_pop(value_v) FILTER (period = 'abnormal') < 1e-10 THEN 0 ELSE corr(value, value_v) FILTER (period = 'abnormal') END AS after FROM al GROUP BY ALL HAVING count(*) >= 10),
rw AS (SELECT datapack, src, dst, un, vn, row_number() OVER w0 AS i, stddev_pop(value) OVER w AS a, stddev_pop(value_v) OVER w AS b, corr(value, value_v) OVER w AS c FROM al WHERE period = 'normal' WINDOW w0 AS (PARTITION BY datapack, src, dst, un, vn ORDER BY time, seq), w AS (PARTITION BY datapack, src, dst, un, vn ORDER BY time, seq ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
bf AS (SELECT datapack, src, dst, un, vn, avg(CASE WHEN a < 1e-10 OR b < 1e-10 THEN 0 ELSE c END) AS mean, stddev_samp(CASE WHEN a < 1e-10 OR b < 1e-10 THEN 0 ELSE c END) AS sd FROM rw WHERE i >= 4 GROUP BY ALL HAVING count(*) >= 2),
sc AS (SELECT s.datapack, s.src, s.dst, max(CASE WHEN sd > 1e-6 THEN abs(after - mean) / sd ELSE abs(after - mean) * 10 END) AS score FROM sm s JOIN bf b ON b.datapack = s.datapack AND b.src = s.src AND b.dst = s.dst AND b.un = s.un AND b.vn = s.vn WHERE s.n >= 4 AND s.m >= 2 GROUP BY ALL)"""
_add("g14_relation_scores", lambda s, d: _relations(s, d)[0].select("datapack", "src", "dst", F.round("score", 3).alias("score")), f"WITH {_REL}, {_SERIES} SELECT datapack, src, dst, round(score, 3) AS score FROM sc", "spans", "metrics")
_add("g14_relational_ranking", _rank_relational, f"""WITH {_REL}, {_STATS}, {_AN}, {_SERIES}, o AS (SELECT datapack, node, max(score) AS own FROM an GROUP BY ALL), c AS (SELECT datapack, src AS node, sum(score) AS changed FROM sc WHERE score >= 1 GROUP BY ALL), j AS (SELECT datapack, node, 0.5 * coalesce(own, 0) + 0.5 * coalesce(changed, 0) AS score FROM o FULL JOIN c USING (datapack, node))
SELECT datapack, node, round(score, 6) AS score FROM j WHERE round(score, 6) > 0""", "spans", "metrics")
