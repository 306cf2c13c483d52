"""The driver's tables seen as telemetry: spans, metrics, logs and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a trace; its lines, in a total order, are a binary tree of spans."""
    lines = read(spark, sf_dir, "lineitem")
    order = ["l_linenumber", *sorted(c for c in lines.columns if c not in ("l_orderkey", "l_linenumber"))]
    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order))
    key = F.col("l_orderkey").cast("string")
    lines = lines.withColumn("seq", seq)
    root = F.col("seq") == 1
    return lines.select(
        F.concat(F.lit("dp"), F.col("l_orderkey") % 8).alias("datapack"),
        F.when(F.floor(F.col("l_orderkey") / 8.0) % 2 == 0, "normal").otherwise("abnormal").alias("period"),
        F.col("l_orderkey").alias("trace_id"),
        F.concat(key, F.lit("-"), "seq").alias("span_id"),
        F.when(root, "").otherwise(F.concat(key, F.lit("-"), F.floor(F.col("seq") / 2.0))).alias("parent_span_id"),
        F.when(root, "loadgenerator").otherwise(F.concat(F.lit("svc-"), F.col("l_suppkey") % 7)).alias("service_name"),
        F.concat(F.lit("GET /api/v1/svc"), F.col("l_partkey") % 7, F.lit("/op"), F.col("l_partkey") % 5).alias("span_name"),
        F.col("l_shipdate").cast("timestamp").alias("time"),
        (F.round(F.col("l_extendedprice") * 100).cast("long") * 10000).alias("duration"),
        F.when(F.col("l_returnflag") == "R", "Error").when(F.col("l_returnflag") == "A", "Ok").otherwise("Unset").alias("status_code"),
        F.when(F.col("l_returnflag") == "R", 500).otherwise(200).alias("http_status"),
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return read(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("time"), F.col("event_id").alias("trace_id"), F.concat("event_id", F.lit("-1")).alias("span_id"),
        F.concat(F.lit("svc-"), F.col("user_id") % 7).alias("service_name"), F.concat(F.lit("dp"), F.col("event_id") % 8).alias("datapack"),
        F.when(kind == "error", "ERROR").when(kind == "signup", "WARN").when(kind == "purchase", "DEBUG").otherwise("INFO").alias("level"), F.col("props").alias("message"),
    )


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.concat(F.lit("dp"), F.col("event_id") % 8).alias("datapack"), F.when(F.col("ts") < "2024-01-16", "normal").otherwise("abnormal").alias("period"),
        F.col("ts").cast("timestamp").alias("time"), F.col("event_type").alias("metric"), "value", F.concat(F.lit("svc-"), F.col("user_id") % 7).alias("service_name"), F.col("event_id").alias("seq"),
    )


def rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An algorithm's answers for a case: the orders of a customer by priority, a hit if the order is finished."""
    rank = F.row_number().over(Window.partitionBy("o_orderpriority", "o_custkey").orderBy("o_orderkey"))
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("algorithm"), F.col("o_custkey").alias("datapack"), rank.alias("rank"), (F.col("o_orderstatus") == "F").alias("hit"), (F.col("o_totalprice") / 1e5).alias("runtime")
    )


SPANS_SQL = """spans AS (
  SELECT 'dp' || (l_orderkey % 8) AS datapack, CASE WHEN CAST(floor(l_orderkey / 8.0) AS BIGINT) % 2 = 0 THEN 'normal' ELSE 'abnormal' END AS period, l_orderkey AS trace_id,
    l_orderkey || '-' || seq AS span_id, CASE WHEN seq = 1 THEN '' ELSE l_orderkey || '-' || CAST(floor(seq / 2.0) AS BIGINT) END AS parent_span_id,
    CASE WHEN seq = 1 THEN 'loadgenerator' ELSE 'svc-' || (l_suppkey % 7) END AS service_name, 'GET /api/v1/svc' || (l_partkey % 7) || '/op' || (l_partkey % 5) AS span_name,
    CAST(l_shipdate AS TIMESTAMP) AS time, CAST(round(l_extendedprice * 100) AS BIGINT) * 10000 AS duration,
    CASE l_returnflag WHEN 'R' THEN 'Error' WHEN 'A' THEN 'Ok' ELSE 'Unset' END AS status_code, CASE WHEN l_returnflag = 'R' THEN 500 ELSE 200 END AS http_status
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, {order}) AS seq FROM lineitem))"""
LOGS_SQL = """logs AS (
  SELECT CAST(ts AS TIMESTAMP) AS time, event_id AS trace_id, event_id || '-1' AS span_id, 'svc-' || (user_id % 7) AS service_name, 'dp' || (event_id % 8) AS datapack,
    CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' WHEN 'purchase' THEN 'DEBUG' ELSE 'INFO' END AS level, props AS message FROM events)"""
METRICS_SQL = """metrics AS (
  SELECT 'dp' || (event_id % 8) AS datapack, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'normal' ELSE 'abnormal' END AS period, CAST(ts AS TIMESTAMP) AS time, event_type AS metric, value,
    'svc-' || (user_id % 7) AS service_name, event_id AS seq FROM events)"""
RANKINGS_SQL = """rankings AS (
  SELECT o_orderpriority AS algorithm, o_custkey AS datapack, row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_orderkey) AS rank, o_orderstatus = 'F' AS hit, o_totalprice / 1e5 AS runtime FROM orders)"""
