"""Relations of spans, services and cases by joins; every key holds the datapack."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracejobs.operators.coverage import entry_spans
from tracejobs.operators.structure import KEY, tree_levels
from tracejobs.operators.timejoins import interval_join


def direct_calls(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (datapack, src, dst; src may be null for any caller) with a column ``called``."""
    pairs = edges.select("datapack", "src", "dst").distinct()
    called = pairs.unionByName(pairs.select("datapack", F.lit(None).cast("string").alias("src"), "dst").distinct()).select(F.col("datapack").alias("d"), F.col("src").alias("s"), F.col("dst").alias("t"))
    both = wanted.join(called, (F.col("datapack") == F.col("d")) & F.col("src").eqNullSafe(F.col("s")) & (F.col("dst") == F.col("t")), "left")
    return both.select(*wanted.columns, F.col("d").isNotNull().alias("called"))


def symptom_relation(spans: DataFrame, service: str, span_name: str) -> DataFrame:
    """For each entry span, how many spans of that service and name its trace has."""
    n = spans.where((F.col("service_name") == service) & (F.col("span_name") == span_name)).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    return entry_spans(spans).select(*KEY, "span_id").join(n, KEY, "left").select(*KEY, "span_id", F.coalesce("n", F.lit(0)).alias("symptoms"))


def beyond_entry(spans: DataFrame) -> DataFrame:
    """Spans that start before their trace's entry span or end after it, with which of both."""
    entry = entry_spans(spans).groupBy(*KEY).agg(F.min(F.struct("time", "span_id", "duration")).alias("e")).select(*KEY, F.unix_micros("e.time").alias("from"), (F.unix_micros("e.time") + F.col("e.duration") / 1000).alias("until"))
    start = F.unix_micros("time")
    where = F.when(start < F.col("from"), "BEFORE").when(start + F.col("duration") / 1000 > F.col("until"), "AFTER").otherwise("WITHIN")
    return spans.join(entry, KEY).select(*KEY, "span_id", where.alias("place"))


def calls_between(spans: DataFrame, services: list[str]) -> DataFrame:
    """(caller, callee) span ids of calls between two different services of the list."""
    own = spans.where(F.col("service_name").isin(services)).select(*KEY, "span_id", "parent_span_id", "service_name")
    parent = own.select(*KEY, F.col("span_id").alias("parent_span_id"), F.col("span_id").alias("caller"), F.col("service_name").alias("caller_service"))
    both = own.join(parent, [*KEY, "parent_span_id"]).where("service_name <> caller_service")
    return both.select(*KEY, "caller", F.col("span_id").alias("callee"), "caller_service", F.col("service_name").alias("callee_service"))


def neighbours(edges: DataFrame, service: str) -> DataFrame:
    """Services that call the service (upstream) and that it calls (downstream)."""
    up = edges.where(F.col("dst") == service).select("datapack", F.lit("upstream").alias("side"), F.col("src").alias("service_name"))
    return up.unionByName(edges.where(F.col("src") == service).select("datapack", F.lit("downstream").alias("side"), F.col("dst").alias("service_name"))).distinct()


def bridged(edges: DataFrame, skipped: str) -> DataFrame:
    """Edges (datapack, src, dst) without the nodes that match the pattern: their callers call their callees."""
    is_skipped = lambda c: F.coalesce(F.col(c).rlike(skipped), F.lit(False))
    plain = edges.where(~is_skipped("src") & ~is_skipped("dst")).select("datapack", "src", "dst")
    into = edges.where(~is_skipped("src") & is_skipped("dst")).select("datapack", "src", F.col("dst").alias("middle"))
    out = edges.where(is_skipped("src") & ~is_skipped("dst")).select("datapack", F.col("src").alias("middle"), "dst")
    return plain.unionByName(into.join(out, ["datapack", "middle"]).select("datapack", "src", "dst")).distinct()


def new_endpoints(spans: DataFrame) -> DataFrame:
    """Endpoints of the abnormal period, with how often the normal one has them, and whether they are new."""
    n = lambda p: F.count_if(F.col("period") == p)
    out = spans.groupBy("datapack", "span_name").agg(n("abnormal").alias("abnormal_n"), n("normal").alias("normal_n")).where("abnormal_n > 0")
    return out.withColumn("is_new", F.col("normal_n") == 0)


def error_spans(spans: DataFrame, logs: DataFrame, seconds: int | None = None) -> DataFrame:
    """(datapack, trace_id, span_id, source): spans in error, spans whose log is an error, and, if ``seconds`` is given, spans whose service has one at most so far from their start."""
    own = spans.where("status_code = 'Error'").select(*KEY, "span_id", F.lit("trace").alias("source"))
    told = logs.where("level = 'ERROR'").select(*KEY, "span_id").join(spans.select(*KEY, "span_id"), [*KEY, "span_id"]).select(*KEY, "span_id", F.lit("log").alias("source"))
    out = own.unionByName(told)
    if seconds is not None:
        errors = logs.where("level = 'ERROR'").select("datapack", "service_name", "time").distinct()
        near = interval_join(spans.select(*KEY, "span_id", "service_name", "time"), errors.withColumn("of_log", F.lit(True)), ["datapack", "service_name"], seconds)
        out = out.unionByName(near.select(*KEY, "span_id", F.lit("window").alias("source")))
    return out.distinct()


def client_repair(spans: DataFrame) -> DataFrame:
    """Spans whose name ends in GET or POST get the third word of their only child's operation (service, then name) appended; those without a child go.

    A child's operation of fewer words appends nothing.
    """
    bare = F.col("span_name").rlike("(GET|POST)$")
    word = F.get(F.split(F.concat("service_name", F.lit(" "), "span_name"), " "), F.lit(2))
    child = spans.where("parent_span_id <> ''").groupBy(*KEY, F.col("parent_span_id").alias("span_id")).agg(F.count(F.lit(1)).alias("children"), F.min(word).alias("word"))
    both = spans.join(child, [*KEY, "span_id"], "left").where(~bare | F.col("children").isNotNull())
    return both.select(*KEY, "span_id", F.when(bare & (F.col("children") == 1), F.concat_ws(" ", "span_name", "word")).otherwise(F.col("span_name")).alias("span_name"))


def path_services(spans: DataFrame) -> DataFrame:
    """Each trace's largest number of different services on a path from a root; services are carried down as a set."""
    label = F.array("service_name")
    return tree_levels(spans, label, lambda above, own: F.array_union(above, own)).groupBy(*KEY).agg(F.max(F.size("carried")).cast("long").alias("services"))


def sibling_order(spans: DataFrame) -> DataFrame:
    """(datapack, before, after, parents): pairs of sibling operations of which, under each common parent, all of one end before any of the other starts."""
    start = F.unix_micros("time")
    kids = spans.where("parent_span_id <> ''").groupBy(*KEY, "parent_span_id", F.concat("service_name", F.lit(" "), "span_name").alias("op")).agg(F.min(start).alias("start"), F.max(start + F.col("duration") / 1000).alias("end"))
    other = kids.select(*KEY, "parent_span_id", F.col("op").alias("op2"), F.col("start").alias("start2"))
    both = kids.join(other, [*KEY, "parent_span_id"]).where("op <> op2").groupBy("datapack", "op", "op2").agg(F.bool_and(F.col("end") < F.col("start2")).alias("ordered"), F.count(F.lit(1)).alias("parents"))
    return both.where("ordered").select("datapack", F.col("op").alias("before"), F.col("op2").alias("after"), "parents")


def transitive_reduction(edges: DataFrame) -> DataFrame:
    """Edges (datapack, before, after) that no two-step path replaces."""
    two = edges.select("datapack", "before", F.col("after").alias("m")).join(edges.select("datapack", F.col("before").alias("m"), "after"), ["datapack", "m"]).select("datapack", "before", "after").distinct()
    return edges.join(two, ["datapack", "before", "after"], "left_anti")


def sliding_correlation(pairs: DataFrame, keys: list[str], x: str, y: str, order: list[str], size: int = 10) -> DataFrame:
    """Per key: mean and sample deviation of the correlation over each run of ``size`` rows; 0 where a side hardly varies."""
    own = Window.partitionBy(*keys).orderBy(*order)
    run = own.rowsBetween(1 - size, 0)
    flat = (F.stddev_pop(x).over(run) < 1e-10) | (F.stddev_pop(y).over(run) < 1e-10)
    a, b = F.col(x), F.col(y)
    r = F.try_divide(F.covar_pop(a, b).over(run), F.stddev_pop(a).over(run) * F.stddev_pop(b).over(run))
    rows = pairs.withColumn("i", F.row_number().over(own)).withColumn("r", F.when(flat, 0.0).otherwise(r)).where(F.col("i") >= size)
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("windows"), F.round(F.avg("r"), 6).alias("mean_r"), F.round(F.stddev_samp("r"), 6).alias("sd_r"))
