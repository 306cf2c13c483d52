"""Queries that export the driver's tables as raw telemetry and read it again, and the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracejobs.operators.rounds import set_folder
from tracejobs.queries import _add
from tracejobs.sources import fixtures as fx
from tracejobs.sources import telemetry


def _folder(spark: SparkSession) -> str:
    set_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def _raw_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans as an exporter writes them: every other one with the older names of attributes."""
    spans = fx.spans(spark, d)
    old = F.col("http_status").cast("string")
    own = F.when(F.length("span_id") % 2 == 0, F.to_json(F.struct(F.lit("GET").alias("http.method"), old.alias("http.status_code"), F.length("span_name").cast("string").alias("http.request_content_length")))).otherwise(F.to_json(F.struct(F.lit("POST").alias("http.request.method"), old.alias("http.response.status_code"), F.lit("9").alias("http.status_code"))))
    resource = F.to_json(F.struct(F.concat("service_name", F.lit("-0")).alias("pod.name"), F.lit("ns").alias("service.namespace")))
    return spans.select(
        "datapack", "period", F.col("time").alias("Timestamp"), F.col("trace_id").cast("string").alias("TraceId"), F.col("span_id").alias("SpanId"), F.col("parent_span_id").alias("ParentSpanId"), F.col("span_name").alias("SpanName"), F.lit("Server").alias("SpanKind"), F.col("service_name").alias("ServiceName"),
        resource.alias("ResourceAttributes"), own.alias("SpanAttributes"), F.col("duration").alias("Duration"), F.col("status_code").alias("StatusCode"),
    )


def _raw_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.metrics(spark, d)
    resource = F.to_json(F.struct(F.lit("ns").alias("k8s.namespace.name"), F.when(F.col("seq") % 2 == 0, F.concat("service_name", F.lit("-0"))).alias("k8s.pod.name")))
    return rows.select("datapack", "period", F.col("time").alias("TimeUnix"), F.col("metric").alias("MetricName"), F.col("value").alias("Value"), F.col("service_name").alias("ServiceName"), resource.alias("ResourceAttributes"), F.when(F.col("seq") % 3 == 0, F.to_json(F.struct(F.col("metric").alias("source_workload")))).otherwise("{}").alias("Attributes"), "seq")


def _read(spark: SparkSession, d: str) -> DataFrame:
    """Every datapack's files of both periods, written one folder a datapack and read in one scan."""
    root = _folder(spark)
    raw = _raw_spans(spark, d)
    packs = [r[0] for r in raw.select("datapack").distinct().collect()]  # eight names
    for pack in packs:
        for period in ("normal", "abnormal"):
            raw.where((F.col("datapack") == pack) & (F.col("period") == period)).drop("datapack", "period").write.parquet(f"{root}/{pack}/{period}_traces.parquet")
    spans = telemetry.standard_traces(telemetry.read_signal(spark, root, "traces"))
    telemetry.validate(spans, "traces")
    return spans.groupBy("datapack", "period", "service_name").agg(F.count(F.lit(1)).alias("n"), F.sum("duration").alias("total"))


def _traces(spark: SparkSession, d: str) -> DataFrame:
    out = telemetry.standard_traces(_raw_spans(spark, d), lambda name: F.regexp_replace(name, r"/op\d", "/{op}"), longest_ns=100 * 10**9)
    return out.toDF(*[c.removeprefix("attr.").replace(".", "_") for c in out.columns]).select("trace_id", "span_id", "span_name", "http_request_method", "http_response_status_code", "http_request_content_length", "k8s_pod_name", "k8s_service_name")


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    out = telemetry.standard_metrics(_raw_metrics(spark, d))
    telemetry.validate(out, "metrics")
    return out.groupBy("datapack", "metric", F.col("`attr.k8s.pod.name`").alias("pod"), F.col("`attr.source_workload`").alias("source")).agg(F.count("value").alias("n"))


def _histograms(spark: SparkSession, d: str) -> DataFrame:
    raw = _raw_metrics(spark, d).withColumns({"Count": F.col("seq") % 7, "Sum": F.col("seq") * 2, "Min": F.col("seq") % 3, "Max": F.col("seq"), "ResourceAttributes": F.to_json(F.struct(F.col("ServiceName").alias("service.name"))), "Attributes": F.to_json(F.struct(F.col("MetricName").alias("jvm.gc.name")))})
    out = telemetry.standard_histograms(raw)
    return out.groupBy("datapack", F.col("`attr.jvm.gc.name`").alias("gc"), F.col("`attr.k8s.service.name`").alias("service")).agg(F.sum("count").alias("n"), F.sum("sum").alias("total"), F.max("max").alias("most"))


def _logs(spark: SparkSession, d: str) -> DataFrame:
    raw = fx.logs(spark, d).select(F.col("time").alias("Timestamp"), F.col("trace_id").cast("string").alias("TraceId"), F.col("span_id").alias("SpanId"), F.lower("level").alias("SeverityText"), F.col("service_name").alias("ServiceName"), F.col("message").alias("Body"), F.lit('{"pod.name": "p"}').alias("ResourceAttributes"))
    out = telemetry.standard_logs(raw, ("svc-3",))
    telemetry.validate(out, "logs")
    return out.select("trace_id", "service_name", "level", F.col("`attr.k8s.pod.name`").alias("pod"))


#: Ids of traces that a list spans, so that a list stays as long whatever the table's size.
LIST = 1024


def _nested(spark: SparkSession, d: str) -> DataFrame:
    """Traces written as nested JSON, lists of at most LIST traces, and read again."""
    root = _folder(spark)
    s = fx.spans(spark, d)
    span = F.struct(F.col("trace_id").cast("string").alias("traceID"), F.col("span_id").alias("spanID"), F.unix_micros(F.col("time") + F.expr("INTERVAL 8 HOURS")).alias("startTime"), "duration", F.col("span_name").alias("operationName"), F.col("service_name").alias("processID"), F.when(F.col("parent_span_id") != "", F.array(F.struct(F.col("parent_span_id").alias("spanID")))).otherwise(F.array()).alias("references"))
    traces = s.groupBy("datapack", "trace_id").agg(F.collect_list(span).alias("spans"), F.map_from_entries(F.collect_set(F.struct("service_name", F.struct(F.concat(F.lit("x-"), "service_name").alias("serviceName"))))).alias("processes"))
    lists = traces.groupBy("datapack", F.floor(F.col("trace_id") / LIST).alias("part")).agg(F.to_json(F.collect_list(F.struct("processes", "spans"))).alias("value"))
    lists.select("value").write.option("compression", "gzip").text(root)  # a line may hold a list; each line is read as one
    return telemetry.nested_spans_of(spark.read.text(root)).select("trace_id", "span_id", "parent_span_id", "service_name", "time", "duration")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.logs(spark, d)
    line = F.when(F.col("trace_id") % 5 == 0, F.concat(F.lit("broken "), "message")).otherwise(F.concat(F.lit("["), F.date_format("time", "yyyy-MMM-dd HH:mm:ss.SSSSSS"), F.lit("] <"), F.lower("level"), F.lit(">: at "), F.col("trace_id").cast("string")))
    return telemetry.parsed_lines(rows.select("service_name", line.alias("line")), "bracketed").select("time", "service_name", "level", "message")


def _windowed(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.metrics(spark, d)
    maps = {"ResourceAttributes": F.when(F.col("seq") % 4 == 0, F.create_map(F.lit("k8s.namespace.name"), F.lit("ns"))).otherwise(F.create_map(F.lit("service.namespace"), F.lit("other"))), "Attributes": F.when(F.col("seq") % 4 == 1, F.create_map(F.lit("source"), F.lit("ns/web"))).otherwise(F.create_map(F.lit("destination_namespace"), F.when(F.col("seq") % 4 == 2, "ns").otherwise("no")))}
    return telemetry.in_window(rows.withColumns(maps).withColumn("TimeUnix", F.col("time")), "ns", "2024-01-05 00:00:00", "2024-01-20 00:00:00", True).groupBy("datapack", "metric").agg(F.count(F.lit(1)).alias("n"))


_add("s01_read_datapacks", _read, "SELECT datapack, period, service_name, count(*) AS n, CAST(sum(duration) AS BIGINT) AS total FROM spans GROUP BY ALL", "spans")
_add("p03_standard_traces", _traces, """SELECT CAST(trace_id AS VARCHAR) AS trace_id, span_id, CASE service_name WHEN 'loadgenerator' THEN regexp_replace(span_name, '/op\\d', '/{op}') ELSE span_name END AS span_name, CASE WHEN length(span_id) % 2 = 0 THEN 'GET' ELSE 'POST' END AS http_request_method, http_status AS http_response_status_code,
  CASE WHEN length(span_id) % 2 = 0 THEN CAST(length(span_name) AS BIGINT) END AS http_request_content_length, service_name || '-0' AS k8s_pod_name, CAST(NULL AS VARCHAR) AS k8s_service_name FROM spans WHERE trace_id NOT IN (SELECT trace_id FROM spans WHERE duration > 100000000000)""", "spans")
_add("p01_standard_metrics", _metrics, "SELECT datapack, metric, CASE WHEN seq % 2 = 0 THEN service_name || '-0' END AS pod, CASE WHEN seq % 3 = 0 THEN metric END AS source, count(value) AS n FROM metrics GROUP BY ALL", "metrics")
_add("p02_standard_histograms", _histograms, "SELECT datapack, metric AS gc, service_name AS service, CAST(sum(seq % 7) AS DOUBLE) AS n, CAST(sum(seq * 2) AS DOUBLE) AS total, CAST(max(seq) AS DOUBLE) AS most FROM metrics GROUP BY ALL", "metrics")
_add("p04_standard_logs", _logs, "SELECT CAST(trace_id AS VARCHAR) AS trace_id, service_name, level, 'p' AS pod FROM logs WHERE service_name <> 'svc-3'", "logs")
_add("p05_other_traces", lambda s, d: telemetry.other_traces(fx.spans(s, d).withColumns({"startTime": F.unix_millis("time"), "ms": F.col("duration") / 1_000_000, "code": F.when(F.col("http_status") == 500, "none").otherwise("200")}), {"time": "startTime", "trace_id": "trace_id", "span_id": "span_id", "service_name": "service_name", "span_name": "span_name", "parent_span_id": "parent_span_id", "duration": "ms"}, "ms", 1_000_000, "code", -8).toDF("time", "trace_id", "span_id", "service_name", "span_name", "parent_span_id", "duration", "status"),
     "SELECT time - INTERVAL 8 HOURS AS time, CAST(trace_id AS VARCHAR) AS trace_id, span_id, service_name, span_name, parent_span_id, CAST(floor(duration / 1000000) * 1000000 AS BIGINT) AS duration, CAST(CASE http_status WHEN 200 THEN 200 END AS SMALLINT) AS status FROM spans", "spans")
_add("s04_nested_spans", _nested, "SELECT CAST(trace_id AS VARCHAR) AS trace_id, span_id, parent_span_id, 'x-' || service_name AS service_name, time, duration FROM spans", "spans")
_add("f06_log_lines", _lines, "SELECT time - INTERVAL 8 HOURS AS time, service_name, lower(level) AS level, 'at ' || trace_id AS message FROM logs WHERE trace_id % 5 <> 0", "logs")
_add("p12_metric_window", _windowed, "SELECT datapack, metric, count(*) AS n FROM metrics WHERE seq % 4 <> 3 AND time BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' GROUP BY ALL", "metrics")
