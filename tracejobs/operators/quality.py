"""Injections: their configuration made readable, and the rules by which a datapack is kicked out of a dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracejobs.functions.ranked import order_stats
from tracejobs.operators.joins import KEY

#: What codes of a configuration stand for.
METHODS = ("GET", "POST", "PUT", "DELETE", "HEAD", "OPTIONS", "PATCH")
CODES = {"body_type": {0: "empty", 1: "random"}, "mem_type": {1: "heap", 2: "stack"}, "return_type": {1: "String", 2: "Int"}, "return_value_opt": {0: "Default", 1: "Random"}}
POINT = ("source_service", "target_service", "direction", "method", "app_name", "app_label", "server_address")
RULES = ("network_no_direct_calls", "http_method_same", "http_no_direct_calls", "target_not_called", "duplicated_spans", "large_latency_normal")


def _named(code: Column, names: dict[int, str]) -> Column:
    """The code's name; what is no number stays as it is, an unknown number is null."""
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    number = code.try_cast("int")
    return F.when(number.isNull(), code).otherwise(F.try_element_at(known, number))


def injection_config(injections: DataFrame, config: str = "display_config") -> DataFrame:
    """injections with the members of their JSON configuration as columns: those of CODES and replace_method by name, and point_* of the injection point.

    has_point: whether there is an injection point at all, an empty one being none. A point without a direction has the
    configuration's.
    """
    get = lambda path: F.get_json_object(config, f"$.{path}")
    point = [get(f"injection_point.{n}").alias(f"point_{n}") for n in POINT if n != "direction"]
    direction = F.coalesce(get("injection_point.direction"), get("direction")).alias("point_direction")
    codes = [_named(get(n), names).alias(n) for n, names in CODES.items()]
    has = F.coalesce(get("injection_point"), F.lit("{}")) != "{}"
    return injections.select("*", _named(get("replace_method"), dict(enumerate(METHODS))).alias("replace_method"), *codes, *point, direction, has.alias("has_point"))


def direct_calls(spans: DataFrame) -> DataFrame:
    """Distinct (datapack, src, dst) of spans' services and their parents'; src is null for spans without a known parent. Calls within a service count."""
    parents = spans.select(*KEY, F.col("span_id").alias("parent_span_id"), F.col("service_name").alias("src"))
    return spans.join(parents, [*KEY, "parent_span_id"], "left").select("datapack", "src", F.col("service_name").alias("dst")).distinct()


def quality_rules(injections: DataFrame, spans: DataFrame, longest_s: float = 6.0) -> DataFrame:
    """Per datapack of injections (datapack, fault_type, display_config): which rules it breaks, and whether it is kicked out.

    network_no_direct_calls: a network fault between two services that do not call each other in its direction (from, to, both).
    http_method_same: a method replaced by itself. http_no_direct_calls: an HTTP fault between services without a call.
    target_not_called: no span of the service of the point's label, or name. duplicated_spans: rows of a period that repeat a span id.
    large_latency_normal: the p99 of normal durations is over the limit. A configuration without a point breaks none.

    Calls are distinct pairs of services before anything is joined to injections.
    """
    configs = injection_config(injections)
    calls = direct_calls(spans)
    of = lambda src, dst, name: calls.where("src IS NOT NULL").select("datapack", F.col("src").alias(src), F.col("dst").alias(dst), F.lit(True).alias(name))
    rows = configs.join(of("point_source_service", "point_target_service", "there"), ["datapack", "point_source_service", "point_target_service"], "left")
    rows = rows.join(of("point_target_service", "point_source_service", "back"), ["datapack", "point_source_service", "point_target_service"], "left")
    rows = rows.join(of("point_app_name", "point_server_address", "served"), ["datapack", "point_app_name", "point_server_address"], "left")
    seen = spans.select("datapack", F.col("service_name").alias("target"), F.lit(True).alias("seen")).distinct()
    rows = rows.withColumn("target", F.coalesce("point_app_label", "point_app_name")).join(seen, ["datapack", "target"], "left")
    repeats = spans.groupBy("datapack", "period", "span_id").agg(F.count(F.lit(1)).alias("n")).groupBy("datapack").agg((F.max("n") > 1).alias("repeated"))
    slow = order_stats(spans.where("period = 'normal'"), ["datapack"], F.col("duration"), {"p99": 0.99}).select("datapack", (F.col("p99") > longest_s * 1e9).alias("slow"))
    rows = rows.join(repeats, "datapack", "left").join(slow, "datapack", "left")
    is_ = lambda c: F.coalesce(c, F.lit(False))
    given = lambda *names: is_(F.greatest(*[F.lit(0), *[F.when(F.coalesce(F.col(n), F.lit("")) == "", 1) for n in names]]) == 0)
    way = F.col("point_direction")
    linked = (way.isin("from", "both") & is_(F.col("there"))) | (way.isin("to", "both") & is_(F.col("back")))
    rules = (
        F.col("fault_type").startswith("Network") & given("point_source_service", "point_target_service") & ~is_(linked),
        (F.col("fault_type") == "HTTPRequestReplaceMethod") & given("point_method", "replace_method") & (F.col("point_method") == F.col("replace_method")),
        F.col("fault_type").startswith("HTTP") & given("point_app_name", "point_server_address") & ~is_(F.col("served")),
        given("target") & ~is_(F.col("seen")),
        is_(F.col("repeated")), is_(F.col("slow")),
    )
    broken = [(F.col("has_point") & is_(r)).alias(n) for n, r in zip(RULES, rules)]
    out = rows.select("datapack", "fault_type", *broken)
    return out.withColumn("kicked_out", F.greatest(*RULES))
