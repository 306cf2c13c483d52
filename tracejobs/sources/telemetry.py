"""Telemetry as it is exported, read and brought to the standard tables of spans, metrics, histograms and logs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracejobs.operators.joins import without_long_traces

#: Names of attributes, and how columns of an export are called here.
METRIC_RESOURCE = ("k8s.node.name", "k8s.namespace.name", "k8s.statefulset.name", "k8s.deployment.name", "k8s.replicaset.name", "k8s.pod.name", "k8s.container.name")
METRIC_ATTRIBUTES = ("destination_workload", "source_workload", "destination", "source")
HISTOGRAM_ATTRIBUTES = ("jvm.gc.action", "jvm.gc.name", "destination", "source")
RESOURCE = {"pod.name": "k8s.pod.name", "service.name": "k8s.service.name", "service.namespace": "k8s.namespace.name"}
CONCLUSION = "SpanName string, Issues string, AbnormalAvgDuration double, NormalAvgDuration double, AbnormalSuccRate double, NormalSuccRate double, AbnormalP90 double, NormalP90 double, AbnormalP95 double, NormalP95 double, AbnormalP99 double, NormalP99 double"
MODELS = {
    "traces": {"time": "timestamp", "trace_id": "string", "span_id": "string", "parent_span_id": "string", "service_name": "string", "span_name": "string", "duration": "bigint"},
    "metrics": {"time": "timestamp", "metric": "string", "value": "double", "service_name": "string"},
    "logs": {"time": "timestamp", "trace_id": "string", "span_id": "string", "service_name": "string", "level": "string", "message": "string"},
}


def read_signal(spark: SparkSession, root: str, signal: str, datapacks: Iterable[str] = ("*",), periods: tuple[str, ...] = ("normal", "abnormal")) -> DataFrame:
    """All rows of ``root/<datapack>/<period>_<signal>.parquet`` as one table with columns datapack and period, taken from the path.

    One scan reads all datapacks, and a filter on either column's path part can be given as names; files whose
    columns differ are merged by name.
    """
    paths = [f"{root}/{d}/{p}_{signal}.parquet" for d in datapacks for p in periods]
    rows = spark.read.option("mergeSchema", True).parquet(*paths)
    parts = F.split(F.col("_metadata.file_path"), "/")
    named = F.filter(parts, lambda x: x.rlike(f"^({'|'.join(periods)})_{signal}\\.parquet$"))
    at = F.array_position(parts, F.element_at(named, -1)).cast("int")
    return rows.select("*", F.url_decode(F.element_at(parts, at - 1)).alias("datapack"), F.substring_index(F.element_at(named, -1), "_", 1).alias("period"))


def attributes(json: str, names: Iterable[str]) -> list[Column]:
    """The named members of a JSON object of texts, as columns; null where a member or the object is missing."""
    names = list(names)
    decoded = F.from_json(json, ", ".join(f"`{n}` string" for n in names))
    return [decoded.getField(n).alias(n) for n in names]


def _attr(columns: list[Column], names: Iterable[str]) -> list[Column]:
    return [c.alias(f"attr.{n}") for c, n in zip(columns, names)]


def _columns(df: DataFrame) -> list[Column]:
    """All columns, whose names may hold dots."""
    return [F.col(f"`{c}`") for c in df.columns]


def _kept(df: DataFrame) -> list[str]:
    return [c for c in ("datapack", "period") if c in df.columns]


def _resource(names: dict[str, str] = RESOURCE) -> list[Column]:
    return _attr(attributes("ResourceAttributes", names), names.values())


def standard_metrics(raw: DataFrame) -> DataFrame:
    """Gauges and sums: time, metric, value, service_name (null if the export has none) and attr.* of resource and, if there are any, attributes."""
    own = F.col("ServiceName") if "ServiceName" in raw.columns else F.lit(None).cast("string")
    more = _attr(attributes("Attributes", METRIC_ATTRIBUTES), METRIC_ATTRIBUTES) if "Attributes" in raw.columns else []
    return raw.select(*_kept(raw), F.col("TimeUnix").alias("time"), F.col("MetricName").alias("metric"), F.col("Value").alias("value"), own.alias("service_name"), *_attr(attributes("ResourceAttributes", METRIC_RESOURCE), METRIC_RESOURCE), *more)


def standard_histograms(raw: DataFrame) -> DataFrame:
    """Histograms: time, metric, service_name, count, sum, min and max as doubles, and attr.*."""
    numbers = [F.col(c).cast("double").alias(c.lower()) for c in ("Count", "Sum", "Min", "Max")]
    return raw.select(*_kept(raw), F.col("TimeUnix").alias("time"), F.col("MetricName").alias("metric"), F.col("ServiceName").alias("service_name"), *numbers, *_resource(), *_attr(attributes("Attributes", HISTOGRAM_ATTRIBUTES), HISTOGRAM_ATTRIBUTES))


def standard_traces(raw: DataFrame, normalize=None, entrances: tuple[str, ...] = ("loadgenerator",), longest_ns: int | None = None) -> DataFrame:
    """Spans: the standard columns, kind, status and attr.* of HTTP, newer names of attributes before older ones.

    normalize: a function of a column that makes span names of the entrances' services into templates. longest_ns: traces
    with a longer span are left out.
    """
    names = ("http.request.method", "http.method", "http.response.status_code", "http.status_code", "http.request_content_length", "http.response_content_length")
    method, old_method, status, old_status, asked, answered = attributes("SpanAttributes", names)
    name = F.col("SpanName")
    if normalize is not None:
        name = F.when(F.col("ServiceName").isin(*entrances), normalize(name)).otherwise(name)
    out = raw.select(
        *_kept(raw), F.col("Timestamp").alias("time"), F.col("TraceId").alias("trace_id"), F.col("SpanId").alias("span_id"), F.col("ParentSpanId").alias("parent_span_id"), F.col("ServiceName").alias("service_name"), name.alias("span_name"),
        F.col("Duration").cast("long").alias("duration"), F.col("SpanKind").alias("attr.span_kind"), F.col("StatusCode").alias("attr.status_code"), *_resource(), F.coalesce(method, old_method).alias("attr.http.request.method"),
        F.coalesce(status, old_status).try_cast("int").alias("attr.http.response.status_code"), asked.try_cast("long").alias("attr.http.request.content_length"), answered.try_cast("long").alias("attr.http.response.content_length"),
    )
    if longest_ns is None:
        return out
    keyed = out if "datapack" in out.columns else out.withColumn("datapack", F.lit(""))
    return without_long_traces(keyed, longest_ns).select(*_columns(out))


def standard_logs(raw: DataFrame, dropped: tuple[str, ...] = ("ts-ui-dashboard",)) -> DataFrame:
    """Logs: the standard columns and attr.*, levels in capitals, without the services named; a log without a service goes too."""
    return raw.where(~F.col("ServiceName").isin(*dropped)).select(
        *_kept(raw), F.col("Timestamp").alias("time"), F.col("TraceId").alias("trace_id"), F.col("SpanId").alias("span_id"), F.col("ServiceName").alias("service_name"), F.upper("SeverityText").alias("level"), F.col("Body").alias("message"), *_resource())


def epoch(column: str, unit: str) -> Column:
    """A time from whole or broken s, ms, us or ns since 1970."""
    per = {"s": 1_000_000, "ms": 1_000, "us": 1, "ns": 0.001}[unit]
    return F.timestamp_micros(F.floor(F.col(column).cast("decimal(38,9)") * F.lit(per).cast("decimal(20,3)")).cast("long"))


def other_traces(raw: DataFrame, columns: dict[str, str], unit: str, duration_factor: int, status: str | None = None, shift_hours: int = 0) -> DataFrame:
    """Spans of another shape. columns: standard name -> the export's; the time is in ``unit`` and moved by so many hours; durations times the factor are ns.

    status: the column of a numeric status, null where it is none. A missing parent becomes "".
    """
    text = [F.col(columns[c]).cast("string").alias(c) for c in ("trace_id", "span_id", "service_name", "span_name")]
    time = epoch(columns["time"], unit) + F.make_interval(hours=F.lit(shift_hours))
    more = [F.col(status).try_cast("smallint").alias("attr.status_code")] if status else []
    return raw.select(time.alias("time"), *text, F.coalesce(F.col(columns["parent_span_id"]).cast("string"), F.lit("")).alias("parent_span_id"), (F.col(columns["duration"]).cast("long") * duration_factor).alias("duration"), *more)


def nested_spans(spark: SparkSession, path: str) -> DataFrame:
    """nested_spans_of JSON files, each of which is one list."""
    return nested_spans_of(spark.read.text(path, wholetext=True))


def nested_spans_of(lists: DataFrame) -> DataFrame:
    """Spans of JSON lists of traces (column value), each with spans and a map of processes; times are microseconds, moved from +8 h to UTC.

    The first reference is the parent, "" without one.
    """
    kind = "array<struct<processes:map<string,struct<serviceName:string>>,spans:array<struct<traceID:string,spanID:string,startTime:bigint,duration:bigint,operationName:string,processID:string,references:array<struct<spanID:string>>>>>>"
    traces = lists.select(F.explode(F.from_json("value", kind)).alias("t"))
    spans = traces.select(F.col("t.processes").alias("p"), F.explode("t.spans").alias("s"))
    return spans.select(
        (F.timestamp_micros("s.startTime") - F.make_interval(hours=F.lit(8))).alias("time"), F.col("s.traceID").alias("trace_id"), F.col("s.spanID").alias("span_id"), F.coalesce(F.get("s.references", F.lit(0))["spanID"], F.lit("")).alias("parent_span_id"),
        F.element_at("p", F.col("s.processID"))["serviceName"].alias("service_name"), F.col("s.operationName").alias("span_name"), F.col("s.duration").alias("duration"),
    )


def service_lines(spark: SparkSession, path: str) -> DataFrame:
    """(service_name, line) of JSON files that map services to lists of log lines."""
    lists = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("service_name", "lines"))
    return lists.select("service_name", F.explode("lines").alias("line"))


#: Of two formats of log lines, the patterns of time, level and message, and the time's form.
LINES = {
    "bracketed": (r"\[(.*?)\]", r"<(.*?)>", r">:\s*(.*)", "yyyy-MMM-dd HH:mm:ss.SSSSSS"),
    "dashed": (r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}.\d+)", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}.\d+\s\s?(\S*)", r"---\s*(.*)$", "yyyy-MM-dd HH:mm:ss.SSS"),
}


def parsed_lines(lines: DataFrame, form: str, shift_hours: int = -8) -> DataFrame:
    """Logs of (service_name, line) in one of the forms of LINES; lines that lack a part, or whose time is none, are left out."""
    when, level, message, pattern = LINES[form]
    part = lambda p: F.regexp_extract("line", p, 1)
    known = [F.regexp_like("line", F.lit(p)) for p in (when, level, message)]
    out = lines.where(known[0] & known[1] & known[2]).withColumn("at", F.try_to_timestamp(part(when), F.lit(pattern))).where("at IS NOT NULL")
    return out.select((F.col("at") + F.make_interval(hours=F.lit(shift_hours))).alias("time"), F.lit("").alias("trace_id"), F.lit("").alias("span_id"), "service_name", part(level).alias("level"), part(message).alias("message"))


def in_window(raw: DataFrame, namespace: str, start: str, end: str, attributes_too: bool = False) -> DataFrame:
    """Rows of a store of metrics (attributes as maps) of a namespace, named in either map, within the window, ends included.

    attributes_too: also where a service's namespace, or the part before a slash of source or destination, is the namespace.
    """
    resource, own = F.col("ResourceAttributes"), F.col("Attributes")
    of = [resource["k8s.namespace.name"] == namespace, own["destination_namespace"] == namespace, own["source_namespace"] == namespace]
    if attributes_too:
        of += [resource["service.namespace"] == namespace, own["destination"].startswith(f"{namespace}/"), own["source"].startswith(f"{namespace}/")]
    named = of[0]
    for one in of[1:]:
        named = F.coalesce(named, F.lit(False)) | F.coalesce(one, F.lit(False))
    return raw.where(F.coalesce(named, F.lit(False)) & F.col("TimeUnix").between(F.to_timestamp(F.lit(start)), F.to_timestamp(F.lit(end))))


def validate(df: DataFrame, model: str, extra: str = "attr.") -> None:
    """Raise an error unless df has the columns of the model with their types, and no others but those that begin with ``extra``, datapack and period."""
    have = dict(df.dtypes)
    for name, kind in MODELS[model].items():
        if name not in have:
            raise ValueError(f"missing column: {name} {kind}")
        if have[name] != kind:
            raise ValueError(f"column {name} is {have[name]}, not {kind}")
    odd = [c for c in have if c not in MODELS[model] and not c.startswith(extra) and c not in ("datapack", "period")]
    if odd:
        raise ValueError(f"unexpected columns: {odd}")


def write_dataset(df: DataFrame, model: str, root: str, dataset: str) -> None:
    """Write a validated signal of many datapacks, a folder for each, sorted by time within files; earlier rows of these datapacks are replaced."""
    validate(df, model)
    sorted_ = df.repartition("datapack", F.pmod(F.xxhash64("time"), F.lit(8))).sortWithinPartitions("datapack", "time")
    sorted_.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("datapack").parquet(f"{root}/data/{dataset}/{model}")


def index_and_labels(labels: DataFrame, dataset: str) -> tuple[DataFrame, DataFrame]:
    """(index, labels) of a dataset, sorted: (dataset, datapack) and (dataset, datapack, gt.level, gt.name), from (datapack, level, name).

    A datapack without a label has a null name; a label without a level or a name is an error when it is read.
    """
    index = labels.select(F.lit(dataset).alias("dataset"), "datapack").distinct().orderBy("dataset", "datapack")
    wrong = (F.coalesce("level", F.lit("")) == "") | (F.coalesce("name", F.lit("")) == "")
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("a label needs a level and a name: "), "datapack"))).otherwise(F.col("name"))
    told = labels.where("level IS NOT NULL OR name IS NOT NULL").select(F.lit(dataset).alias("dataset"), "datapack", F.col("level").alias("gt.level"), checked.alias("gt.name"))
    return index, told.orderBy("dataset", "datapack", "`gt.level`", "`gt.name`")


def subset(index: DataFrame, labels: DataFrame, datapacks: DataFrame, dataset: str) -> tuple[DataFrame, DataFrame]:
    """Index and labels of another dataset that has only these datapacks of the first, which must have them."""
    own = datapacks.select("datapack").distinct()
    lost = own.join(index, "datapack", "left_anti").limit(1).collect()
    if lost:
        raise ValueError(f"not in the dataset: {lost[0][0]}")
    named = lambda df: df.join(own, "datapack", "left_semi").withColumn("dataset", F.lit(dataset)).select(*_columns(df))
    return named(index), named(labels)


def read_conclusions(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The detector's conclusions of many datapacks with their names, taken from the folder; an empty table of that schema if there are no files."""
    if not paths:
        return spark.createDataFrame([], CONCLUSION + ", datapack string")
    rows = spark.read.schema(CONCLUSION).option("header", True).option("escape", '"').csv(paths)
    return rows.select("*", F.url_decode(F.element_at(F.split("_metadata.file_path", "/"), -2)).alias("datapack"))


def with_defaults(df: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """df with exactly these columns (name -> type and default), in their order; missing ones get the default."""
    return df.select(*[(F.col(f"`{c}`").cast(kind) if c in df.columns else F.lit(default).cast(kind)).alias(c) for c, (kind, default) in columns.items()])


def union_runs(runs: list[DataFrame]) -> DataFrame:
    """Outputs of runs put together by name; what a run lacks is null."""
    out = runs[0]
    for run in runs[1:]:
        out = out.unionByName(run, allowMissingColumns=True)
    return out


def sampler_of(folder: Column, modes: tuple[str, ...] = ("online", "offline")) -> Column:
    """struct(sampler, rate, mode) of a folder ``sampler_rate_mode``, where the sampler may have underscores; null for other names."""
    parts = F.split(folder, "_")
    n = F.size(parts)
    rate, mode = F.get(parts, n - 2).try_cast("double"), F.get(parts, n - 1)
    name = F.array_join(F.slice(parts, 1, F.greatest(F.lit(0), n - 2)), "_")
    return F.when((n >= 3) & rate.isNotNull() & mode.isin(*modes), F.struct(name.alias("sampler"), rate.alias("rate"), mode.alias("mode")))
