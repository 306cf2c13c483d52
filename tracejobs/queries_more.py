"""More queries over the driver's tables, and the same in SQL: selections, names, relations, reports and detectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracejobs.functions import names
from tracejobs.operators import coverage, detect, joins, relations, reports, selects, sli, structure
from tracejobs.queries import _EDGES, _JUDGED, _SAMPLED, _add, _judged, _p_sql, _samples
from tracejobs.sources import fixtures as fx

_WALK = """w AS (
  SELECT datapack, trace_id, span_id, service_name, span_name, 1 AS level FROM spans WHERE parent_span_id = ''
  UNION ALL SELECT c.datapack, c.trace_id, c.span_id, c.service_name, c.span_name, w.level + 1 FROM w JOIN spans c ON c.trace_id = w.trace_id AND c.parent_span_id = w.span_id)"""


def _table(name: str, *columns: str | Column):
    return lambda s, d: fx.read(s, d, name).select(*columns)


# Selections and derived columns
_add("p10_entry_spans", lambda s, d: coverage.entry_spans(fx.spans(s, d)).select("datapack", "trace_id", "span_id"), "SELECT datapack, trace_id, span_id FROM spans WHERE parent_span_id = '' AND service_name = 'loadgenerator'", "spans")
_add("p11_span_status", lambda s, d: fx.spans(s, d).withColumn("attributes", F.when(F.col("http_status") == 500, '{"http.status_code": "500"}').otherwise("{}")).select("trace_id", "span_id", selects.http_status().alias("status")),
     "SELECT trace_id, span_id, CASE WHEN http_status = 500 THEN '500' WHEN status_code <> 'Unset' THEN status_code END AS status FROM spans", "spans")
_add("p13_service_attribution", lambda s, d: fx.read(s, d, "documents").select("doc_id", selects.first_filled("source", "lang").alias("service_name")), "SELECT doc_id, coalesce(nullif(source, ''), nullif(lang, '')) AS service_name FROM documents")
_add("p14_op_name", lambda s, d: fx.spans(s, d).select("trace_id", "span_id", F.concat("service_name", F.lit(" "), names.replaced_in_turn(F.col("span_name"), [("svc[0-9]", "svc{n}"), ("/op[0-4]", "/op{n}")])).alias("op_name")),
     "SELECT trace_id, span_id, service_name || ' ' || regexp_replace(regexp_replace(span_name, 'svc[0-9]', 'svc{n}'), '/op[0-4]', '/op{n}') AS op_name FROM spans", "spans")
_add("p15_dataset_filter", lambda s, d: selects.within_limits(fx.read(s, d, "part"), {"p_size": (5, 40), "p_retailprice": (None, 1500.0)}).where(F.col("p_type").isNull() | ~F.col("p_type").endswith("ECONOMY")).select("p_partkey"),
     "SELECT p_partkey FROM part WHERE (p_size IS NULL OR p_size BETWEEN 5 AND 40) AND (p_retailprice IS NULL OR p_retailprice <= 1500) AND (p_type IS NULL OR NOT p_type LIKE '%ECONOMY')")
_add("p16_golden_signal_metrics", lambda s, d: fx.metrics(s, d).where(selects.named_like("metric", ["err", "purch"])).select("datapack", "metric", "seq", "value"), "SELECT datapack, metric, seq, value FROM metrics WHERE contains(metric, 'err') OR contains(metric, 'purch')", "metrics")
_add("p17_advanced_log_search", lambda s, d: selects.search_logs(fx.logs(s, d), r"\b[0-9]7\b|^dp3$", ["message", "datapack"], "2024-01-05", "2024-01-25", ["ERROR", "WARN", "INFO"], "SVC-2", regex=True).select("trace_id", "level"),
     r"SELECT trace_id, level FROM logs WHERE time >= TIMESTAMP '2024-01-05' AND time <= TIMESTAMP '2024-01-25' AND level IN ('ERROR', 'WARN', 'INFO') AND contains(lower(service_name), 'svc-2') AND (regexp_matches(message, '(?i)\b[0-9]7\b|^dp3$') OR regexp_matches(datapack, '(?i)\b[0-9]7\b|^dp3$'))", "logs")
_add("p18_metrics_of_services", lambda s, d: fx.metrics(s, d).where(F.col("service_name").isin("svc-1", "svc-4") & F.col("metric").isin("error", "click")).select("datapack", "service_name", "metric", "seq"), "SELECT datapack, service_name, metric, seq FROM metrics WHERE service_name IN ('svc-1', 'svc-4') AND metric IN ('error', 'click')", "metrics")
_add("p19_blacklist", lambda s, d: fx.spans(s, d).where(~selects.named_like("datapack", ["p3", "p5"])).groupBy("datapack").agg(F.count(F.lit(1)).alias("n")), "SELECT datapack, count(*) AS n FROM spans WHERE NOT (contains(datapack, 'p3') OR contains(datapack, 'p5')) GROUP BY ALL", "spans")
_CATEGORY = {"error": "Fault", "purchase": "Load", "click": "Load"}
_CATEGORY_SQL = "CASE event_type WHEN 'error' THEN 'Fault' WHEN 'purchase' THEN 'Load' WHEN 'click' THEN 'Load' ELSE 'Unknown' END"
_add("p20_fault_category", lambda s, d: fx.read(s, d, "events").select(selects.category("event_type", _CATEGORY).alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n")), f"SELECT {_CATEGORY_SQL} AS category, count(*) AS n FROM events GROUP BY ALL")
_add("p06_wide_to_long", lambda s, d: selects.long_form(fx.read(s, d, "part").select("p_partkey", F.col("p_size").alias("cart_size"), F.col("p_retailprice").alias("order_price")), ["p_partkey"]),
     "SELECT p_partkey, 'cart' AS service_name, 'size' AS metric, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'order', 'price', p_retailprice FROM part")
_add("p07_wide_in_window", lambda s, d: selects.long_form(fx.read(s, d, "orders").where("o_orderdate BETWEEN timestamp'1994-01-01' AND timestamp'1996-01-01'").select("o_orderkey", F.col("o_totalprice").alias("pod_price"), F.col("o_custkey").alias("pod_customer")), ["o_orderkey"]),
     "SELECT o_orderkey, 'pod' AS service_name, unnest(['price', 'customer']) AS metric, unnest([o_totalprice, CAST(o_custkey AS DOUBLE)]) AS value FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1994-01-01' AND TIMESTAMP '1996-01-01'")
_add("p08_log_normalise", lambda s, d: fx.read(s, d, "conversations").select("conv_id", "turn", names.level_of(F.upper("text")).alias("level"), F.coalesce(F.col("text").rlike("(?i)error|fail|exception"), F.lit(False)).alias("has_error")),
     r"SELECT conv_id, turn, replace(nullif(regexp_extract(upper(text), '\b(TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL)\b', 1), ''), 'WARNING', 'WARN') AS level, coalesce(regexp_matches(text, '(?i)error|fail|exception'), false) AS has_error FROM conversations")
_add("p09_repaired_times", lambda s, d: selects.repaired_times(fx.read(s, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, F.lit("1800-01-01").cast("timestamp")).otherwise(F.col("o_orderdate")).alias("time")), "time", ["o_custkey"], ["o_orderkey"], "2024-01-01"), """
WITH x AS (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders)
SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN TIMESTAMP '2024-01-01' + to_milliseconds(i) ELSE CAST(o_orderdate AS TIMESTAMP) END AS time FROM x""")
_add("k07_page", lambda s, d: selects.page(fx.logs(s, d).select("time", "trace_id", "level"), ["time", "trace_id"], 50, 3), "SELECT time, trace_id, level FROM logs ORDER BY time, trace_id LIMIT 50 OFFSET 150", "logs")

# Names
_add("f01_path_normaliser", lambda s, d: fx.spans(s, d).select("trace_id", "span_id", names.normalize_path(F.col("span_name"), [("/svc[0-3]/op[0-9]+$", "/low/{op}"), ("/svc[0-9]+", "/svc/{id}")]).alias("path")),
     "SELECT trace_id, span_id, CASE WHEN regexp_matches(span_name, '/svc[0-3]/op[0-9]+$') THEN regexp_replace(span_name, '/svc[0-3]/op[0-9]+$', '/low/{op}') ELSE regexp_replace(span_name, '/svc[0-9]+', '/svc/{id}') END AS path FROM spans", "spans")
_POD = lambda: F.concat(
    F.lower("p_brand"), F.lit("-"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 8), F.lit("-"), F.substring(F.md5("p_name"), 1, 5))).when(F.col("p_partkey") % 3 == 1, F.col("p_size").cast("string")).otherwise(F.substring(F.md5("p_name"), 1, 5)))
_add("f03_pod_owner", lambda s, d: fx.read(s, d, "part").select("p_partkey", _POD().alias("pod")).select("p_partkey", names.pod_owner(F.col("pod")).alias("o")).select("p_partkey", "o.kind", "o.owner", "o.replicaset"), r"""
WITH p AS (SELECT p_partkey, lower(p_brand) || '-' || CASE p_partkey % 3 WHEN 0 THEN substr(md5(CAST(p_partkey AS VARCHAR)), 1, 8) || '-' || substr(md5(p_name), 1, 5) WHEN 1 THEN CAST(p_size AS VARCHAR) ELSE substr(md5(p_name), 1, 5) END AS pod FROM part),
k AS (SELECT *, CASE WHEN regexp_full_match(pod, '(.+?)-([a-z0-9]{5,10})-([a-z0-9]{5})') THEN 'Deployment' WHEN regexp_full_match(pod, '(.+)-([0-9]+)') THEN 'StatefulSet' WHEN regexp_full_match(pod, '(.+)-([a-z0-9]{5})') THEN 'DaemonSet' END AS kind FROM p)
SELECT p_partkey, kind, CASE kind WHEN 'Deployment' THEN regexp_extract(pod, '^(.+?)-([a-z0-9]{5,10})-([a-z0-9]{5})$', 1) WHEN 'StatefulSet' THEN regexp_extract(pod, '^(.+)-([0-9]+)$', 1) WHEN 'DaemonSet' THEN regexp_extract(pod, '^(.+)-([a-z0-9]{5})$', 1) END AS owner,
  CASE kind WHEN 'Deployment' THEN regexp_extract(pod, '^(.+?)-([a-z0-9]{5,10})-([a-z0-9]{5})$', 1) || '-' || regexp_extract(pod, '^(.+?)-([a-z0-9]{5,10})-([a-z0-9]{5})$', 2) END AS replicaset FROM k""")
_add("f04_json_attributes", lambda s, d: fx.logs(s, d).select("trace_id", F.from_json("message", "k long, other string").alias("a")).select("trace_id", "a.*"), "SELECT trace_id, CAST(json_extract_string(message, '$.k') AS BIGINT) AS k, json_extract_string(message, '$.other') AS other FROM logs", "logs")
_add("f07_level_number", lambda s, d: fx.logs(s, d).groupBy(names.level_number(F.col("level")).alias("number")).agg(F.count(F.lit(1)).alias("n")), "SELECT CASE level WHEN 'DEBUG' THEN 1 WHEN 'INFO' THEN 2 WHEN 'WARN' THEN 3 WHEN 'ERROR' THEN 4 END AS number, count(*) AS n FROM logs GROUP BY ALL", "logs")
_add("f08_epoch_time", lambda s, d: fx.read(s, d, "orders").withColumn("us", F.unix_micros(F.col("o_orderdate").cast("timestamp"))).select("o_orderkey", names.epoch_time(F.when(F.col("o_orderkey") % 4 == 0, F.col("us") / 1e6).when(F.col("o_orderkey") % 4 == 1, F.col("us") / 1e3).when(F.col("o_orderkey") % 4 == 2, F.col("us")).otherwise(F.col("us") * 1e3)).alias("time")), "SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS time FROM orders")
_add("f09_parsed_time", lambda s, d: fx.read(s, d, "orders").select("o_orderkey", names.parsed_time(F.when(F.col("o_orderkey") % 3 == 0, F.unix_timestamp("o_orderdate").cast("string")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).otherwise("no time")).alias("time")),
     "SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_orderdate AS TIMESTAMP) END AS time FROM orders")
_add("f10_local_time", lambda s, d: fx.read(s, d, "orders").select("o_orderkey", F.date_format(F.from_utc_timestamp("o_orderdate", "Asia/Shanghai"), "yyyy-MM-dd HH:mm:ss").alias("local")), "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 8 HOURS, '%Y-%m-%d %H:%M:%S') AS local FROM orders")
_add("f11_injection_time", lambda s, d: fx.spans(s, d).groupBy("datapack", "span_name").agg(F.min("time").alias("a"), F.max("time").alias("b")).select("datapack", "span_name", selects.injection_time(F.col("a"), F.col("b")).alias("time")),
     "SELECT datapack, span_name, CASE WHEN max(time) > min(time) THEN make_timestamp(CAST(floor((epoch_us(min(time)) + epoch_us(max(time))) / 2) AS BIGINT)) ELSE max(time) END AS time FROM spans GROUP BY datapack, span_name", "spans")
_add("f12_http_span_name", lambda s, d: fx.spans(s, d).select("trace_id", "span_id", names.http_span_name(F.concat(F.lit("HTTP POST http://"), "service_name", F.lit(":8080"), F.regexp_replace("span_name", "^GET ", ""))).alias("name")), "SELECT trace_id, span_id, 'POST ' || substr(span_name, 5) AS name FROM spans", "spans")
_COMPONENTS = ("'span|' || {svc} || '::' || {name}", "'span| http://' || {svc} || ':8080/a::b '", "'span|HTTP ' || {name}", "'span|' || {svc} || '::X::' || {name}", "'service|' || {svc}", "{svc}", "{svc} || '::HTTP POST /x::GET /y'")


def _component(s: SparkSession, d: str) -> DataFrame:
    forms = [F.expr(c.format(svc="service_name", name="span_name")) for c in _COMPONENTS]
    return fx.spans(s, d).select("trace_id", "span_id", names.endpoint_of(F.element_at(F.array(*forms), (F.length("span_id") % len(forms) + 1).cast("int"))).alias("endpoint"))


_add("f13_endpoint", _component, "SELECT trace_id, span_id, CASE length(span_id) % 7 WHEN 0 THEN span_name WHEN 2 THEN 'HTTP ' || span_name WHEN 6 THEN 'HTTP POST /x::GET /y' END AS endpoint FROM spans", "spans")
_add("f14_component_name", lambda s, d: fx.read(s, d, "supplier").select("s_suppkey", names.component_name(F.concat(F.lit(" service|TS-"), "s_name", F.lit("-x "))).alias("name")), "SELECT s_suppkey, replace(lower(s_name), '-', '') || 'x' AS name FROM supplier")
_add("f16_pair", lambda s, d: fx.read(s, d, "nation").select(names.pair_of(F.concat("n_name", F.when(F.col("n_nationkey") % 2 == 0, "->a").otherwise(""))).alias("p")).select("p.*"), "SELECT n_name AS source, CASE WHEN n_nationkey % 2 = 0 THEN 'a' END AS target FROM nation")
_add("f17_label_value", lambda s, d: fx.read(s, d, "customer").select("c_custkey", names.whole_number(F.when(F.col("c_custkey") % 4 == 0, "Infinity").when(F.col("c_custkey") % 4 == 1, "-Infinity").when(F.col("c_custkey") % 4 == 2, F.col("c_acctbal").cast("string")).otherwise("none")).alias("value")),
     "SELECT c_custkey, CAST(CASE c_custkey % 4 WHEN 0 THEN 999999999 WHEN 1 THEN -999999999 WHEN 2 THEN trunc(c_acctbal) ELSE 0 END AS BIGINT) AS value FROM customer")
_add("f20_client_repair", lambda s, d: relations.client_repair(fx.spans(s, d).withColumn("span_name", F.when(F.col("http_status") == 500, "x GET").otherwise(F.col("span_name")))), """
WITH x AS (SELECT datapack, trace_id, span_id, parent_span_id, service_name, CASE WHEN http_status = 500 THEN 'x GET' ELSE span_name END AS span_name FROM spans), c AS (SELECT trace_id, parent_span_id AS p, count(*) AS n, split_part(min(service_name || ' ' || span_name), ' ', 3) AS word FROM x WHERE parent_span_id <> '' GROUP BY ALL)
SELECT datapack, x.trace_id, span_id, CASE WHEN span_name = 'x GET' AND n = 1 THEN span_name || ' ' || word ELSE span_name END AS span_name FROM x LEFT JOIN c ON x.trace_id = c.trace_id AND x.span_id = c.p WHERE span_name <> 'x GET' OR n IS NOT NULL""", "spans")
_add("f22_jaccard", lambda s, d: fx.spans(s, d).groupBy("datapack").agg(F.collect_set(F.when(F.col("period") == "normal", F.col("span_name"))).alias("a"), F.collect_set(F.when(F.col("status_code") == "Error", F.col("service_name"))).alias("b"), F.collect_set("service_name").alias("c")).select("datapack", F.round(names.jaccard(F.col("b"), F.col("c")), 6).alias("jaccard")),
     "SELECT datapack, round(count(DISTINCT service_name) FILTER (status_code = 'Error') / count(DISTINCT service_name), 6) AS jaccard FROM spans GROUP BY ALL", "spans")

# Relations
_add("j03_direct_calls", lambda s, d: relations.direct_calls(joins.service_graph(fx.spans(s, d)), joins.service_graph(fx.spans(s, d)).select("datapack", F.when(F.col("src") != "loadgenerator", F.col("dst")).alias("src"), F.col("src").alias("dst")).distinct()), f"""
WITH e AS ({_EDGES}), q AS (SELECT DISTINCT datapack, CASE WHEN src <> 'loadgenerator' THEN dst END AS src, src AS dst FROM e)
SELECT datapack, src, dst, EXISTS (SELECT 1 FROM e WHERE e.datapack = q.datapack AND e.dst = q.dst AND (q.src IS NULL OR e.src = q.src)) AS called FROM q""", "spans")
_add("j12_symptom_relation", lambda s, d: relations.symptom_relation(fx.spans(s, d), "svc-3", "GET /api/v1/svc3/op1"), """
SELECT e.datapack, e.trace_id, e.span_id, (SELECT count(*) FROM spans s WHERE s.trace_id = e.trace_id AND s.service_name = 'svc-3' AND s.span_name = 'GET /api/v1/svc3/op1') AS symptoms FROM spans e WHERE e.parent_span_id = '' AND e.service_name = 'loadgenerator'""", "spans")
_add("j14_beyond_entry", lambda s, d: relations.beyond_entry(fx.spans(s, d)), """
WITH e AS (SELECT datapack, trace_id, epoch_us(time) AS a, epoch_us(time) + duration / 1000 AS b FROM spans WHERE parent_span_id = '')
SELECT s.datapack, s.trace_id, span_id, CASE WHEN epoch_us(time) < a THEN 'BEFORE' WHEN epoch_us(time) + duration / 1000 > b THEN 'AFTER' ELSE 'WITHIN' END AS place FROM spans s JOIN e ON s.trace_id = e.trace_id""", "spans")
_add("j15_calls_between", lambda s, d: relations.calls_between(fx.spans(s, d), ["svc-1", "svc-4"]), """
SELECT p.datapack, p.trace_id, p.span_id AS caller, c.span_id AS callee, p.service_name AS caller_service, c.service_name AS callee_service FROM spans p JOIN spans c ON p.trace_id = c.trace_id AND p.span_id = c.parent_span_id
WHERE p.service_name IN ('svc-1', 'svc-4') AND c.service_name IN ('svc-1', 'svc-4') AND p.service_name <> c.service_name""", "spans")
_add("j16_neighbours", lambda s, d: relations.neighbours(joins.service_graph(fx.spans(s, d)), "svc-2"), f"WITH e AS ({_EDGES}) SELECT datapack, 'upstream' AS side, src AS service_name FROM e WHERE dst = 'svc-2' UNION SELECT datapack, 'downstream', dst FROM e WHERE src = 'svc-2'", "spans")
_add("j18_new_endpoints", lambda s, d: relations.new_endpoints(fx.spans(s, d)), "SELECT datapack, span_name, count(*) FILTER (period = 'abnormal') AS abnormal_n, count(*) FILTER (period = 'normal') AS normal_n, count(*) FILTER (period = 'normal') = 0 AS is_new FROM spans GROUP BY ALL HAVING count(*) FILTER (period = 'abnormal') > 0", "spans")
_add("j20_attributes", lambda s, d: fx.rankings(s, d).join(fx.read(s, d, "customer").select(F.col("c_custkey").alias("datapack"), F.col("c_mktsegment").alias("fault_type")), "datapack", "left").groupBy("algorithm", "fault_type").agg(F.count(F.lit(1)).alias("n")),
     "SELECT algorithm, c_mktsegment AS fault_type, count(*) AS n FROM rankings LEFT JOIN customer ON datapack = c_custkey GROUP BY ALL", "rankings")
_add("j22_hits", lambda s, d: reports.hits(fx.rankings(s, d).select("algorithm", "datapack", "rank"), fx.read(s, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("datapack"), (F.col("c_nationkey") % 5 + 1).alias("rank")), ["datapack", "rank"]),
     "SELECT algorithm, datapack, rank, EXISTS (SELECT 1 FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey = datapack AND c_nationkey % 5 + 1 = rank) AS hit FROM rankings", "rankings")
_add("j24_bridged", lambda s, d: relations.bridged(joins.service_graph(fx.spans(s, d)), "^svc-[0-2]$"), f"""
WITH e AS ({_EDGES}), x AS (SELECT *, regexp_matches(src, '^svc-[0-2]$') AS a, regexp_matches(dst, '^svc-[0-2]$') AS b FROM e)
SELECT datapack, src, dst FROM x WHERE NOT a AND NOT b UNION SELECT p.datapack, p.src, q.dst FROM x p JOIN x q ON p.datapack = q.datapack AND p.dst = q.src WHERE NOT p.a AND p.b AND NOT q.b""", "spans")
_add("e01_both_periods", lambda s, d: fx.spans(s, d).where("period = 'normal'").withColumn("anomal", F.lit(0)).unionByName(fx.spans(s, d).where("period = 'abnormal'").withColumn("anomal", F.lit(1))).groupBy("datapack", "anomal").agg(F.count(F.lit(1)).alias("n")), "SELECT datapack, CASE period WHEN 'abnormal' THEN 1 ELSE 0 END AS anomal, count(*) AS n FROM spans GROUP BY ALL", "spans")
_add("e03_ranked_services", lambda s, d: fx.spans(s, d).where("period = 'abnormal'").select("datapack", "service_name").unionByName(fx.logs(s, d).select("datapack", "service_name")).where("trim(service_name) <> ''").distinct(), "SELECT datapack, service_name FROM spans WHERE period = 'abnormal' UNION SELECT datapack, service_name FROM logs", "spans", "logs")
_add("e04_error_spans", lambda s, d: relations.error_spans(fx.spans(s, d), fx.logs(s, d)), "SELECT datapack, trace_id, span_id, 'trace' AS source FROM spans WHERE status_code = 'Error' UNION SELECT s.datapack, s.trace_id, s.span_id, 'log' FROM spans s JOIN logs l ON s.trace_id = l.trace_id AND s.span_id = l.span_id WHERE level = 'ERROR'", "spans", "logs")
_add("e11_overlap", lambda s, d: fx.read(s, d, "orders").select(F.col("o_custkey").alias("k")).distinct().join(fx.read(s, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.lit(1).alias("x")), "k", "left").agg(F.count(F.lit(1)).alias("n"), F.count("x").alias("both")).withColumn("ratio", F.round(F.try_divide("both", "n"), 6)),
     "SELECT count(*) AS n, count(c_custkey) AS \"both\", round(count(c_custkey) / count(*), 6) AS ratio FROM (SELECT DISTINCT o_custkey FROM orders) LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
_add("e12_new_samples", lambda s, d: fx.read(s, d, "documents").where("lang IN ('en', 'de')").join(fx.read(s, d, "labels"), "doc_id", "left_anti").select("doc_id"), "SELECT doc_id FROM documents WHERE lang IN ('en', 'de') AND doc_id NOT IN (SELECT doc_id FROM labels)")
_add("w04_path_services", lambda s, d: relations.path_services(fx.spans(s, d)), """WITH RECURSIVE w AS (
  SELECT datapack, trace_id, span_id, [service_name] AS l FROM spans WHERE parent_span_id = '' UNION ALL SELECT c.datapack, c.trace_id, c.span_id, list_append(w.l, c.service_name) FROM w JOIN spans c ON c.trace_id = w.trace_id AND c.parent_span_id = w.span_id)
SELECT datapack, trace_id, max(len(list_distinct(l))) AS services FROM w GROUP BY ALL""", "spans")
_add("w07_span_level", lambda s, d: structure.levels(fx.spans(s, d)).select("datapack", "trace_id", "span_id", "level"), f"WITH RECURSIVE {_WALK} SELECT datapack, trace_id, span_id, level FROM w", "spans")
_add("t02_distinct_encoding", lambda s, d: structure.path_encoding(fx.spans(s, d), True), f"WITH RECURSIVE {_WALK}, g AS (SELECT DISTINCT datapack, trace_id, level, service_name || ':' || span_name AS label FROM w) SELECT datapack, trace_id, string_agg(label, ' -> ' ORDER BY level, label) AS encoding FROM g GROUP BY ALL", "spans")
_ORDERED = """k AS (SELECT datapack, trace_id, parent_span_id AS p, service_name || ' ' || span_name AS op, min(epoch_us(time)) AS a, max(epoch_us(time) + duration / 1000) AS b FROM spans WHERE parent_span_id <> '' GROUP BY ALL),
o AS (SELECT x.datapack, x.op AS before, y.op AS after, count(*) AS parents FROM k x JOIN k y ON x.trace_id = y.trace_id AND x.p = y.p AND x.op <> y.op GROUP BY ALL HAVING bool_and(x.b < y.a))"""
_add("w09_sibling_order", lambda s, d: relations.sibling_order(fx.spans(s, d)), f"WITH {_ORDERED} SELECT * FROM o", "spans")
_add("w10_transitive_reduction", lambda s, d: relations.transitive_reduction(relations.sibling_order(fx.spans(s, d)).select("datapack", "before", "after")), f"WITH {_ORDERED} SELECT datapack, before, after FROM o WHERE NOT EXISTS (SELECT 1 FROM o x JOIN o y ON x.datapack = y.datapack AND x.after = y.before WHERE x.datapack = o.datapack AND x.before = o.before AND y.after = o.after)", "spans")
_add("w08_sliding_correlation", lambda s, d: relations.sliding_correlation(fx.metrics(s, d).select("datapack", "service_name", "metric", "value", "seq", F.dayofyear("time").cast("double").alias("day")), ["datapack", "service_name", "metric"], "value", "day", ["seq"]), """
WITH r AS (SELECT datapack, service_name, metric, row_number() OVER (PARTITION BY datapack, service_name, metric ORDER BY seq) AS i, stddev_pop(value) OVER w AS a, stddev_pop(CAST(dayofyear(time) AS DOUBLE)) OVER w AS b, corr(value, CAST(dayofyear(time) AS DOUBLE)) OVER w AS c FROM metrics WINDOW w AS (PARTITION BY datapack, service_name, metric ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
x AS (SELECT *, CASE WHEN a < 1e-10 OR b < 1e-10 THEN 0 ELSE c END AS r FROM r WHERE i >= 10)
SELECT datapack, service_name, metric, count(*) AS windows, round(avg(r), 6) AS mean_r, round(stddev_samp(r), 6) AS sd_r FROM x GROUP BY datapack, service_name, metric""", "metrics")
_add("w12_recent_stats", lambda s, d: detect.recent_stats(fx.metrics(s, d)), "SELECT datapack, service_name, metric, seq, round(avg(value) OVER w, 6) AS mean, round(stddev_pop(value) OVER w, 6) AS sd FROM metrics WINDOW w AS (PARTITION BY datapack, service_name, metric ORDER BY time, seq ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)", "metrics")
_add("t17_entry_latency", lambda s, d: coverage.entry_spans(fx.spans(s, d)).groupBy("datapack", "span_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("duration") / 1e9, 6).alias("mean_s")).where("n >= 10"), "SELECT datapack, span_name, count(*) AS n, round(avg(duration) / 1e9, 6) AS mean_s FROM spans WHERE parent_span_id = '' GROUP BY ALL HAVING count(*) >= 10", "spans")

# Reports
_add("a18_metric_names", lambda s, d: fx.metrics(s, d).select("metric").distinct(), "SELECT DISTINCT metric FROM metrics", "metrics")
_add("a23_fault_target_counts", lambda s, d: reports.shared_counts(fx.read(s, d, "events").select(selects.category("event_type", _CATEGORY).alias("category"), "event_type", (F.col("user_id") % 7).alias("target")), ["category", "event_type", "target"]), f"SELECT {_CATEGORY_SQL} AS category, event_type, user_id % 7 AS target, count(*) AS n FROM events GROUP BY ALL")
_add("a24_value_distribution", lambda s, d: reports.value_distribution(fx.read(s, d, "part").select("p_type", "p_brand", "p_size", F.floor(F.col("p_retailprice") / 100).alias("price")), ["p_type", "p_brand"], ["p_size", "price"]), """
WITH x AS (SELECT p_type, p_brand, unnest(['p_size', 'price']) AS metric, unnest([CAST(p_size AS DOUBLE), floor(p_retailprice / 100)]) AS value FROM part) SELECT *, count(*) AS n FROM x GROUP BY ALL""")
_BEST5 = """b AS (SELECT algorithm, datapack, min(rank) FILTER (hit AND rank <= 5) AS best FROM rankings GROUP BY ALL), s AS (SELECT algorithm, datapack, CASE WHEN best <= 1 THEN 1.0 ELSE 0 END AS top1, CASE WHEN best <= 3 THEN 1.0 ELSE 0 END AS top3, CASE WHEN best <= 5 THEN 1.0 ELSE 0 END AS top5,
  round(greatest(0, 4 - coalesce(best, 9)) / 3, 6) AS avg3, round(greatest(0, 6 - coalesce(best, 9)) / 5, 6) AS avg5, round(coalesce(1 / best, 0), 6) AS mrr FROM b), a AS (SELECT s.*, c_mktsegment AS fault_type, c_nationkey AS distance, c_nationkey % 3 AS category FROM s LEFT JOIN customer ON datapack = c_custkey)"""
_MEANS = ", ".join(f"round(avg({c}), 3) AS {c}" for c in reports.TOPS)


def _means(keys: str, columns: str) -> str:
    return f"WITH {_BEST5} SELECT {columns + ', ' if columns else ''}algorithm, count(*) AS runs, {_MEANS} FROM a GROUP BY {keys + ', ' if keys else ''}algorithm"


def _attributes(s: SparkSession, d: str) -> DataFrame:
    return fx.read(s, d, "customer").select(F.col("c_custkey").alias("datapack"), F.col("c_mktsegment").alias("fault_type"), F.col("c_nationkey").alias("distance"), (F.col("c_nationkey") % 3).alias("category"))


def _bucketed(s: SparkSession, d: str) -> DataFrame:
    return _attributes(s, d).withColumn("bucket", reports.nested_bucket(F.col("distance")))


_BUCKET = "CASE WHEN distance <= 1 THEN '<=1' WHEN distance <= 3 THEN '<=3' WHEN distance <= 5 THEN '<=5' ELSE '>5' END"
_add("a27_dataset_means", lambda s, d: reports.algorithm_means(fx.rankings(s, d), _attributes(s, d).select("datapack", "category"), ["category"]), _means("category", "category"), "rankings")
_add("a34_means_by_attribute", lambda s, d: reports.algorithm_means(fx.rankings(s, d), _attributes(s, d).select("datapack", "fault_type"), ["fault_type"]), _means("fault_type", "fault_type"), "rankings")
_add("a38_means_by_category", lambda s, d: reports.algorithm_means(fx.rankings(s, d), _attributes(s, d).select("datapack", "category", "fault_type"), ["category", "fault_type"]), _means("category, fault_type", "category, fault_type"), "rankings")
_add("a39_means_by_bucket", lambda s, d: reports.algorithm_means(fx.rankings(s, d), _bucketed(s, d).select("datapack", "bucket"), ["bucket"]), _means(_BUCKET, f"{_BUCKET} AS bucket"), "rankings")
_add("a40_means_by_category_and_bucket", lambda s, d: reports.algorithm_means(fx.rankings(s, d), _bucketed(s, d).select("datapack", "category", "bucket"), ["category", "bucket"]), _means(f"category, {_BUCKET}", f"category, {_BUCKET} AS bucket"), "rankings")
_add("a41_overall_means", lambda s, d: reports.algorithm_means(fx.rankings(s, d), _attributes(s, d).select("datapack"), []), _means("", ""), "rankings")
_add("a37_long_means", lambda s, d: reports.algorithm_means(fx.rankings(s, d), _attributes(s, d).select("datapack", "distance"), ["distance"]), _means("distance", "distance"), "rankings")
_add("a31_run_counts", lambda s, d: reports.run_counts(fx.rankings(s, d).withColumn("exception", F.when(F.col("runtime") > 3, "timeout")), ["algorithm"], "exception"), "WITH r AS (SELECT algorithm, datapack, max(runtime) > 3 AS bad FROM rankings GROUP BY ALL) SELECT algorithm, count(*) AS total, count(*) FILTER (bad) AS errors FROM r GROUP BY ALL", "rankings")
_add("a44_degree_pivot", lambda s, d: reports.pivoted(fx.logs(s, d), "service_name", "level", ["DEBUG", "INFO", "WARN", "ERROR"], F.count(F.lit(1))).na.fill(0), "SELECT service_name, count(*) FILTER (level = 'DEBUG') AS \"DEBUG\", count(*) FILTER (level = 'INFO') AS \"INFO\", count(*) FILTER (level = 'WARN') AS \"WARN\", count(*) FILTER (level = 'ERROR') AS \"ERROR\" FROM logs GROUP BY ALL", "logs")
_add("a45_dataset_totals", lambda s, d: fx.spans(s, d).agg(F.count_distinct("datapack").alias("datapacks"), F.count_distinct("service_name").alias("services"), F.count_if(F.col("parent_span_id") == "").alias("traces"), F.round((F.max(F.unix_timestamp("time")) - F.min(F.unix_timestamp("time"))) / 3600, 6).alias("hours")),
     "SELECT count(DISTINCT datapack) AS datapacks, count(DISTINCT service_name) AS services, count(*) FILTER (parent_span_id = '') AS traces, round((epoch(max(time)) - epoch(min(time))) / 3600, 6) AS hours FROM spans", "spans")
_add("a46_sampler_report", lambda s, d: reports.summary(fx.read(s, d, "orders").select("o_orderpriority", "o_orderstatus", "o_totalprice", (F.col("o_custkey") % 100).cast("double").alias("runtime")), ["o_orderpriority", "o_orderstatus"], ["o_totalprice", "runtime"], 4),
     "SELECT o_orderpriority, o_orderstatus, count(*) AS n, " + ", ".join(f"round(avg({x}), 4) AS {v}_mean, round(stddev_samp({x}), 4) AS {v}_std, min({x}) AS {v}_min, max({x}) AS {v}_max" for v, x in (("o_totalprice", "o_totalprice"), ("runtime", "CAST(o_custkey % 100 AS DOUBLE)"))) + " FROM orders GROUP BY ALL")
_add("a47_rank_shares", lambda s, d: reports.rank_shares(fx.rankings(s, d), "algorithm", "rank"), "WITH x AS (SELECT CAST(r AS INT) AS r, algorithm, count(*) AS n FROM rankings, range(1, 6) t(r) WHERE rank <= r GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY r), 6) AS share FROM x", "rankings")
_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_add("a48_algorithm_pivot", lambda s, d: reports.pivoted(reports.algorithm_means(fx.rankings(s, d), _attributes(s, d).select("datapack", "fault_type"), ["fault_type"]), "algorithm", "fault_type", _SEGMENTS, F.first("mrr")), f"WITH {_BEST5} SELECT algorithm, " + ", ".join(f"round(avg(mrr) FILTER (fault_type = '{x}'), 3) AS \"{x}\"" for x in _SEGMENTS) + " FROM a GROUP BY algorithm", "rankings")
_add("a49_filled_matrix", lambda s, d: reports.filled_matrix(fx.metrics(s, d).withColumn("day", F.date_trunc("day", "time")), ["datapack"], "day", "metric", "value"), """
WITH k AS (SELECT datapack, CAST(date_trunc('day', time) AS TIMESTAMP) AS day, metric, avg(value) AS m FROM metrics GROUP BY ALL), g AS (SELECT * FROM (SELECT DISTINCT datapack, day FROM k) JOIN (SELECT DISTINCT datapack, metric FROM k) USING (datapack)), r AS (SELECT g.*, m FROM g LEFT JOIN k USING (datapack, day, metric))
SELECT datapack, day, metric, round(coalesce(first_value(m IGNORE NULLS) OVER (PARTITION BY datapack, metric ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(m IGNORE NULLS) OVER (PARTITION BY datapack, metric ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS value FROM r""", "metrics")
_add("a50_metric_attribution", lambda s, d: fx.metrics(s, d).select(selects.first_filled("service_name", "datapack").alias("service_name"), "metric", "value").unionByName(fx.logs(s, d).select("service_name", F.lit("logs").alias("metric"), F.lit(1.0).alias("value"))).groupBy("service_name", "metric").agg(F.count("value").alias("n")),
     "SELECT service_name, metric, count(value) AS n FROM (SELECT service_name, metric, value FROM metrics UNION ALL SELECT service_name, 'logs', 1.0 FROM logs) GROUP BY ALL", "metrics", "logs")
_add("a52_level_accuracy", lambda s, d: reports.levels_accuracy(_judged(s, d).withColumn("correct", F.when(F.col("sample_id") % 7 != 0, F.col("correct")))), f"""WITH {_JUDGED}, x AS (SELECT level, CASE WHEN sample_id % 7 <> 0 THEN correct END AS c FROM judged)
SELECT level, count(*) AS n, count(*) FILTER (c) AS "right", round(count(*) FILTER (c) / count(c), 6) AS accuracy FROM x GROUP BY level UNION ALL SELECT NULL, count(*), count(*) FILTER (c), round(count(*) FILTER (c) / count(*), 6) FROM x""")
_add("a55_tool_usage", lambda s, d: reports.tool_usage(fx.read(s, d, "conversations").select("conv_id", F.expr("CASE WHEN turn % 2 = 1 THEN 'assistant' ELSE 'tool' END").alias("role"), F.floor((F.col("turn") + 1) / 2 % 3).alias("call"), (F.length("text") % 2 == 0).alias("ok"))), """
WITH m AS (SELECT conv_id, turn % 2 = 1 AS mine, CAST(floor((turn + 1) / 2 % 3) AS BIGINT) AS call, length(text) % 2 = 0 AS ok FROM conversations), c AS (SELECT DISTINCT conv_id, call FROM m WHERE mine), r AS (SELECT conv_id, call, bool_or(ok) AS ok FROM m WHERE NOT mine GROUP BY ALL),
g AS (SELECT conv_id, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed FROM c JOIN r USING (conv_id, call) GROUP BY ALL) SELECT *, round(CASE WHEN succeeded = 0 THEN 0 ELSE 0.2 * succeeded / (succeeded + failed) * (1 - tanh(failed)) * (1 - tanh(abs(succeeded + failed - 10) / 10)) END, 6) AS bonus FROM g""")
_add("a56_time_range", lambda s, d: fx.logs(s, d).groupBy("datapack").agg(F.min("time").alias("first"), F.max("time").alias("last"), F.count(F.lit(1)).alias("logs"), F.count_distinct("service_name").alias("services")), "SELECT datapack, min(time) AS first, max(time) AS last, count(*) AS logs, count(DISTINCT service_name) AS services FROM logs GROUP BY ALL", "logs")
_add("a57_label_usage", lambda s, d: fx.read(s, d, "nation").select("n_nationkey", "n_name").join(fx.read(s, d, "supplier").select("s_nationkey", "s_suppkey"), F.col("n_nationkey") == F.col("s_nationkey"), "left").groupBy("n_name").agg(F.count("s_suppkey").alias("assignments")), "SELECT n_name, count(s_suppkey) AS assignments FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY ALL")
_add("a58_pair_drilldown", lambda s, d: fx.spans(s, d).where("span_name LIKE '%svc1/%' OR span_name LIKE '%svc2/%'").groupBy("datapack", "trace_id").agg(F.max("http_status").alias("worst"), F.max("duration").alias("longest"), F.min("time").alias("first"), F.max(F.col("span_name").contains("svc1/")).alias("a"), F.max(F.col("span_name").contains("svc2/")).alias("b")).where("a AND b").drop("a", "b"),
     "SELECT datapack, trace_id, max(http_status) AS worst, max(duration) AS longest, min(time) AS first FROM spans WHERE span_name LIKE '%svc1/%' OR span_name LIKE '%svc2/%' GROUP BY ALL HAVING bool_or(contains(span_name, 'svc1/')) AND bool_or(contains(span_name, 'svc2/'))", "spans")
_CONTRIBUTION = "WITH g AS (SELECT datapack, service_name, metric, min(value) AS lo, max(value) AS hi, avg(value) FILTER (period = 'abnormal') AS a, avg(value) FILTER (period = 'normal') AS n FROM metrics GROUP BY ALL), c AS (SELECT datapack, service_name, metric, round(CASE WHEN hi > lo THEN abs(a - n) / (hi - lo) END, 6) AS part FROM g)"


def _parts(s: SparkSession, d: str) -> DataFrame:
    mean = lambda p: F.avg(F.when(F.col("period") == p, F.col("value")))
    g = fx.metrics(s, d).groupBy("datapack", "service_name", "metric").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), mean("abnormal").alias("a"), mean("normal").alias("n"))
    return g.select("datapack", "service_name", "metric", F.round(F.when(F.col("hi") > F.col("lo"), F.abs(F.col("a") - F.col("n")) / (F.col("hi") - F.col("lo"))), 6).alias("part"))


_add("k04_top_metrics", lambda s, d: reports.top_per_group(_parts(s, d), ["datapack", "service_name"], "part", "metric", 3), f"{_CONTRIBUTION}, r AS (SELECT *, row_number() OVER (PARTITION BY datapack, service_name ORDER BY part DESC, metric) AS rank FROM c WHERE part IS NOT NULL) SELECT * FROM r WHERE rank <= 3", "metrics")
_add("k05_top_symptoms", lambda s, d: reports.top_per_group(fx.spans(s, d).groupBy("datapack", "service_name", "span_name").agg(F.sum(F.when(F.col("period") == "abnormal", F.col("duration")).otherwise(-F.col("duration"))).alias("delta")).where("delta > 0 AND service_name <> 'loadgenerator'").withColumn("op", F.concat("service_name", F.lit(" "), "span_name")).select("datapack", "op", "delta"), ["datapack"], "delta", "op", 5), """
WITH g AS (SELECT datapack, service_name || ' ' || span_name AS op, CAST(sum(CASE period WHEN 'abnormal' THEN duration ELSE -duration END) AS BIGINT) AS delta FROM spans WHERE service_name <> 'loadgenerator' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY datapack ORDER BY delta DESC, op) AS rank FROM g WHERE delta > 0) SELECT * FROM r WHERE rank <= 5""", "spans")
_STRATA = """c AS (SELECT c_mktsegment || (c_custkey % 97 % 4) AS stratum, c_custkey FROM customer WHERE c_custkey % 11 <> 0), z AS (SELECT stratum, count(*) AS n, CAST(ceil(count(*) * CAST(0.3 AS DOUBLE)) AS BIGINT) AS most FROM c GROUP BY ALL),
t AS (SELECT cap FROM (SELECT unnest(range(1, (SELECT max(n) FROM z) + 1)) AS cap), (SELECT min(n) AS least, sum(n) * CAST(0.3 AS DOUBLE) AS target FROM z) WHERE cap >= least AND (SELECT sum(least(most, cap)) FROM z) >= target ORDER BY cap LIMIT 1),
r AS (SELECT stratum, c_custkey, row_number() OVER (PARTITION BY stratum ORDER BY md5('0:' || c_custkey), c_custkey) AS place FROM c), p AS (SELECT r.*, CASE WHEN place <= least(most, cap) THEN 'train' ELSE 'test' END AS part FROM r JOIN z USING (stratum), t)"""


def _split(s: SparkSession, d: str, limit: int) -> DataFrame:
    cases = fx.read(s, d, "customer").select(F.concat("c_mktsegment", F.col("c_custkey") % 97 % 4).alias("stratum"), "c_custkey")
    return reports.split_cases(cases, "stratum", "c_custkey", 0.3, cases.where("c_custkey % 11 = 0").select("c_custkey"), limit)


_add("k09_train_test_split", lambda s, d: _split(s, d, 0), f"WITH {_STRATA} SELECT stratum, c_custkey, part FROM p")
_add("k09_limited_split", lambda s, d: _split(s, d, 100), f"WITH {_STRATA}, l AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY stratum, place) AS i FROM p) SELECT stratum, c_custkey, part FROM l WHERE i <= CASE part WHEN 'train' THEN 30 ELSE 70 END")

# Detectors
_add("d05_success_rate", lambda s, d: detect.success_rate_detector(fx.spans(s, d).where("period = 'normal' OR trace_id % 3 = 0").withColumn("status_code", F.when((F.col("period") == "normal") & (F.col("trace_id") % 2 == 0), "Ok").otherwise(F.col("status_code")))), f"""
WITH y0 AS (SELECT datapack, span_name, period, period = 'normal' AND trace_id % 2 = 0 OR status_code <> 'Error' AS ok FROM spans WHERE period = 'normal' OR trace_id % 3 = 0), g AS (SELECT datapack, span_name, count(*) FILTER (period = 'normal') AS n1, count(*) FILTER (period = 'abnormal') AS n2, count(*) FILTER (period = 'normal' AND ok) AS g1, count(*) FILTER (period = 'abnormal' AND ok) AS g2 FROM y0 GROUP BY ALL),
x AS (SELECT *, g1 / n1 AS a, g2 / n2 AS b, (g1 + g2) / (n1 + n2) AS p FROM g WHERE n1 >= 10 AND n2 >= 5), y AS (SELECT *, sqrt(p * (1 - p) * (1 / n1 + 1 / n2)) AS se, a - b AS f FROM x), z AS (SELECT * EXCLUDE (p), CASE WHEN se > 0 THEN abs(b - a) / se ELSE 0 END AS z FROM y),
q AS (SELECT *, CASE WHEN se > 0 THEN {_p_sql('z')} ELSE 1 END AS p FROM z), v AS (SELECT *, p < CAST(0.05 AS DOUBLE) AND f > CAST(0.03 AS DOUBLE) AND f > CAST(0.1 AS DOUBLE) * a AS w FROM q)
SELECT datapack, span_name, round(a, 6) AS normal_rate, round(b, 6) AS abnormal_rate, round(z, 6) AS z, round(p, 6) AS p, w AS is_anomaly, CASE WHEN w THEN CASE WHEN f > 0.2 THEN 'critical' WHEN f > 0.1 THEN 'high' WHEN f > 0.05 THEN 'medium' ELSE 'low' END END AS severity, CASE WHEN w THEN round(least(1, (1 - p) * 2), 6) END AS confidence FROM v""", "spans")
_add("d06_new_endpoint_issues", lambda s, d: detect.new_endpoint_issues(sli.endpoint_stats(fx.spans(s, d).where("period = 'abnormal'"), ["datapack", "span_name"])).select("datapack", "span_name", *[F.get_json_object("issues", f"$.{c}.threshold").cast("double").alias(c) for c in ("avg_duration", "p99", "hard_timeout", "succ_rate")]), """
SELECT datapack, span_name, CASE WHEN round(avg(duration / 1e9), 10) > 3 THEN CAST(3 AS DOUBLE) END AS avg_duration, CASE WHEN round(quantile_cont(duration / 1e9, 0.99), 8) > 10 THEN CAST(10 AS DOUBLE) END AS p99, CASE WHEN round(avg(duration / 1e9), 10) > 15 THEN CAST(15 AS DOUBLE) END AS hard_timeout,
  CASE WHEN round(count(*) FILTER (status_code <> 'Error') / count(*), 6) < CAST(0.9 AS DOUBLE) THEN CAST(0.9 AS DOUBLE) END AS succ_rate FROM spans WHERE period = 'abnormal' GROUP BY ALL""", "spans")
_H = f"e AS ({_EDGES}), h AS (SELECT DISTINCT datapack, period, service_name, trace_id FROM spans), n AS (SELECT datapack, period, service_name, count(*) AS n FROM h GROUP BY ALL), b AS (SELECT a.datapack, a.period, e.src, e.dst, count(*) AS together FROM e JOIN h a ON a.datapack = e.datapack AND a.service_name = e.src JOIN h b ON b.datapack = a.datapack AND b.period = a.period AND b.trace_id = a.trace_id AND b.service_name = e.dst GROUP BY ALL), q AS (SELECT b.datapack, b.period, src, dst, round(together / x.n, 6) AS p_src, round(together / y.n, 6) AS p_dst FROM b JOIN n x ON x.datapack = b.datapack AND x.period = b.period AND x.service_name = src JOIN n y ON y.datapack = b.datapack AND y.period = b.period AND y.service_name = dst)"
_add("d14_edge_anomalies", lambda s, d: detect.edge_anomalies(sli.call_probability(fx.spans(s, d)), 0.05), f"""
WITH {_H}, g AS (SELECT datapack, src, dst, max(p_src) FILTER (period = 'normal') AS a, max(p_src) FILTER (period = 'abnormal') AS b, max(p_dst) FILTER (period = 'normal') AS c, max(p_dst) FILTER (period = 'abnormal') AS d FROM q GROUP BY ALL),
x AS (SELECT datapack, src, dst, round((b - a) / a, 6) AS diff_p_src, round((d - c) / c, 6) AS diff_p_dst FROM g) SELECT * FROM x WHERE abs(diff_p_src) > CAST(0.05 AS DOUBLE) OR abs(diff_p_dst) > CAST(0.05 AS DOUBLE)""", "spans")
_add("d15_standardised_anomalies", lambda s, d: detect.standardised_anomalies(fx.metrics(s, d), 0.2), """
WITH g AS (SELECT datapack, service_name, metric, avg(value) FILTER (period = 'normal') AS a, avg(value) FILTER (period = 'abnormal') AS b, coalesce(stddev_samp(value) FILTER (period = 'normal'), 0) AS sd FROM metrics GROUP BY ALL), x AS (SELECT datapack, service_name, metric, sd, round(CASE WHEN sd > 0 THEN (b - a) / sd ELSE b - a END, 6) AS diff FROM g)
SELECT datapack, service_name, metric, diff FROM x WHERE CASE WHEN sd > 0 THEN abs(diff) > CAST(0.2 AS DOUBLE) ELSE abs(diff) > 0 END""", "metrics")
# datapacks without logs, without metrics, without slow endpoints, and of different sizes
_add("d11_usable_datapacks", lambda s, d: detect.usable_datapacks(detect.new_endpoint_issues(sli.endpoint_stats(fx.spans(s, d).where("datapack NOT IN ('dp2', 'dp5') AND period = 'abnormal'").withColumn("duration", F.when(F.col("datapack") == "dp4", 0).otherwise(F.col("duration"))).withColumn("status_code", F.lit("Ok")), ["datapack", "span_name"])),
     fx.spans(s, d).groupBy("datapack").agg(F.sum(F.when(F.col("datapack") == "dp6", 10**9).otherwise(100)).alias("bytes")), 500 << 20), """
WITH e AS (SELECT datapack, span_name, avg(CASE datapack WHEN 'dp4' THEN 0 ELSE duration END) / 1e9 AS a FROM spans WHERE period = 'abnormal' AND datapack NOT IN ('dp2', 'dp5') GROUP BY ALL), i AS (SELECT datapack, count(*) FILTER (a > 3) AS issues FROM e GROUP BY ALL), z AS (SELECT datapack, CAST(sum(CASE datapack WHEN 'dp6' THEN 1000000000 ELSE 100 END) AS BIGINT) AS bytes FROM spans GROUP BY ALL)
SELECT z.datapack, coalesce(issues, 0) AS issues, bytes, coalesce(issues, 0) > 0 AND bytes <= 524288000 AS usable FROM z LEFT JOIN i USING (datapack)""", "spans")


def _signals(s: SparkSession, d: str) -> DataFrame:
    n = lambda df, name: df.groupBy("datapack").agg(F.lit(name).alias("signal"), F.count(F.lit(1)).alias("n"))
    return n(fx.spans(s, d), "traces").unionByName(n(fx.logs(s, d).where("datapack <> 'dp1'"), "logs")).unionByName(n(fx.metrics(s, d).where("datapack NOT IN ('dp1', 'dp3')"), "metrics"))


_add("d10_validity", lambda s, d: detect.validity(_signals(s, d), ["traces", "logs", "metrics"], fx.spans(s, d).where("datapack <> 'dp7' OR period = 'abnormal'"), 104.0), """
WITH g AS (SELECT datapack, 'traces' AS signal FROM spans UNION SELECT datapack, 'logs' FROM logs WHERE datapack <> 'dp1' UNION SELECT datapack, 'metrics' FROM metrics WHERE datapack NOT IN ('dp1', 'dp3')), want AS (SELECT DISTINCT datapack, signal FROM spans, (SELECT unnest(['traces', 'logs', 'metrics']) AS signal)),
m AS (SELECT w.datapack, coalesce(string_agg(w.signal, ',' ORDER BY w.signal) FILTER (g.signal IS NULL), '') AS missing FROM want w LEFT JOIN g USING (datapack, signal) GROUP BY ALL), r AS (SELECT datapack, max(duration) / 1e9 AS longest FROM spans WHERE period = 'normal' AND parent_span_id = '' AND datapack <> 'dp7' GROUP BY ALL)
SELECT m.datapack, missing, longest, coalesce(missing = '' AND longest <= 104, false) AS valid FROM m LEFT JOIN r USING (datapack)""", "spans", "logs", "metrics")
_add("t11_balance", lambda s, d: coverage.sampler_scores(fx.spans(s, d), _samples(s, d), 0.1, 0.03).where("sampled > 0").select("datapack", "balance_cv"), f"""
WITH n AS (SELECT datapack, span_name, count(*) AS s FROM spans WHERE parent_span_id = '' AND (datapack, trace_id) IN (SELECT (datapack, trace_id) FROM {_SAMPLED}) GROUP BY ALL) SELECT datapack, round(CASE WHEN count(*) > 1 THEN stddev_pop(s) / avg(s) ELSE 0 END, 6) AS balance_cv FROM n GROUP BY ALL""", "spans")
