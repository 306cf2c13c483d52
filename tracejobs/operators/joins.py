"""Joins over the span tree and over logs. The trace is always part of the key, so that one partitioning serves all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["datapack", "trace_id"]


def _children(spans: DataFrame, *columns: str) -> DataFrame:
    """Spans that have a parent, under c_ names; roots never enter the join, as their empty parent is one key."""
    own = spans.where("parent_span_id <> ''")
    return own.select(*KEY, F.col("parent_span_id").alias("span_id"), *[F.col(c).alias(f"c_{c}") for c in columns])


def service_graph(spans: DataFrame) -> DataFrame:
    """Distinct (datapack, src, dst) of calls between different services."""
    parents = spans.select(*KEY, "span_id", F.col("service_name").alias("src"))
    pairs = parents.join(_children(spans, "service_name"), [*KEY, "span_id"]).where("src <> c_service_name")
    return pairs.select("datapack", "src", F.col("c_service_name").alias("dst")).distinct()


def operation_graph(spans: DataFrame) -> DataFrame:
    """Distinct (datapack, src, dst) of calls between operations, with the number of calls."""
    parents = spans.select(*KEY, "span_id", F.concat("service_name", F.lit(" "), "span_name").alias("src"))
    own = spans.withColumn("op", F.concat("service_name", F.lit(" "), "span_name"))
    return parents.join(_children(own, "op"), [*KEY, "span_id"]).groupBy("datapack", "src", F.col("c_op").alias("dst")).agg(F.count(F.lit(1)).alias("calls"))


def without_long_traces(spans: DataFrame, most_ns: int) -> DataFrame:
    """Spans of traces none of whose spans is longer."""
    long = spans.where(F.col("duration") > most_ns).select(*KEY).distinct()
    return spans.join(long, KEY, "left_anti")


def of_sampled(spans: DataFrame, samples: DataFrame) -> DataFrame:
    return spans.join(samples.select(*KEY).distinct(), KEY, "left_semi")


def exclusive_duration(spans: DataFrame) -> DataFrame:
    """Each span's duration without its children's, which are added up before the join."""
    inner = _children(spans, "duration").groupBy(*KEY, "span_id").agg(F.sum("c_duration").alias("inner_duration"))
    return spans.join(inner, [*KEY, "span_id"], "left").withColumn("exclusive", F.col("duration") - F.coalesce("inner_duration", F.lit(0))).drop("inner_duration")


def orphans(spans: DataFrame) -> DataFrame:
    """Spans whose parent is not in their trace; roots have no parent and are none."""
    known = spans.select(*KEY, F.col("span_id").alias("parent_span_id"))
    return spans.where("parent_span_id <> ''").join(known, [*KEY, "parent_span_id"], "left_anti")


def log_spans(logs: DataFrame, spans: DataFrame) -> DataFrame:
    """Logs with the operation of their span, null where there is none."""
    named = spans.select(*KEY, "span_id", F.concat("service_name", F.lit(" "), "span_name").alias("op"))
    return logs.join(named, [*KEY, "span_id"], "left")


def leaf_errors(spans: DataFrame) -> DataFrame:
    """Error spans none of whose children is an error."""
    errors = spans.where("status_code = 'Error'")
    return errors.join(_children(errors).distinct(), [*KEY, "span_id"], "left_anti")


def degrees(edges: DataFrame) -> DataFrame:
    """Out and in degree of every service that an edge touches."""
    ends = edges.select("datapack", F.inline(F.array(F.struct(F.col("src").alias("service_name"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("service_name"), F.lit(0).alias("o"), F.lit(1).alias("i")))))
    return ends.groupBy("datapack", "service_name").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def operation_times(spans: DataFrame) -> DataFrame:
    """Per trace and operation: spans, their summed durations, their children's, first and last start."""
    own = exclusive_duration(spans)
    return own.groupBy(*KEY, "service_name", "span_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum("duration").alias("total"), F.sum(F.col("duration") - F.col("exclusive")).alias("inner_total"), F.min("time").alias("first"), F.max("time").alias("last")
    )
