"""Filters and derived columns over telemetry, as plain column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def first_filled(*columns: str) -> Column:
    """The first of the columns that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns])


def http_status(attributes: str = "attributes", status: str = "status_code") -> Column:
    """The status in the attributes' JSON, else the span's own unless it is unset."""
    return F.coalesce(F.get_json_object(attributes, "$['http.status_code']"), F.nullif(F.col(status), F.lit("Unset")))


def named_like(column: str, parts: list[str]) -> Column:
    """Whether the column holds one of the parts."""
    return any_of([F.col(column).contains(p) for p in parts])


def search_logs(logs: DataFrame, term: str, columns: list[str], start: str | None = None, end: str | None = None, levels: list[str] | None = None, service: str | None = None, regex: bool = False, case: bool = False) -> DataFrame:
    """Logs in the time range (both ends included), of the levels and of services that hold ``service``, with the term in one of the columns."""
    out = logs
    if start:
        out = out.where(F.col("time") >= F.lit(start).cast("timestamp"))
    if end:
        out = out.where(F.col("time") <= F.lit(end).cast("timestamp"))
    if levels:
        out = out.where(F.col("level").isin(levels))
    if service:
        out = out.where(F.lower("service_name").contains(service.lower()))
    has = (lambda c: F.col(c).rlike(term if case else f"(?i){term}")) if regex else (lambda c: F.col(c).contains(term) if case else F.lower(c).contains(term.lower()))
    return out.where(any_of([F.coalesce(has(c), F.lit(False)) for c in columns]))


def within_limits(rows: DataFrame, limits: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Rows whose columns lie within the (least, most) limits; a null passes."""
    for column, (least, most) in limits.items():
        if least is not None:
            rows = rows.where(F.col(column).isNull() | (F.col(column) >= least))
        if most is not None:
            rows = rows.where(F.col(column).isNull() | (F.col(column) <= most))
    return rows


def category(column: str, mapping: dict[str, str], default: str = "Unknown") -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair]), F.col(column)), F.lit(default))


def long_form(wide: DataFrame, keys: list[str], separator: str = "_") -> DataFrame:
    """(keys, service_name, metric, value) of wide columns named service, separator, metric."""
    values = [c for c in wide.columns if c not in keys]
    rows = wide.select(*keys, *[F.col(c).cast("double").alias(c) for c in values]).unpivot(keys, values, "name", "value")
    parts = F.split("name", separator)
    return rows.select(*keys, parts[0].alias("service_name"), F.get(parts, F.lit(1)).alias("metric"), "value")


def repaired_times(rows: DataFrame, time: str, keys: list[str], order: list[str], base: str, earliest: str = "1900-01-01") -> DataFrame:
    """Times before ``earliest`` become base plus a millisecond for each row before it in the order of its group."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    fixed = F.timestamp_micros(F.unix_micros(F.lit(base).cast("timestamp")) + at.cast("long") * 1000)
    return rows.withColumn(time, F.when(F.col(time) < F.lit(earliest).cast("timestamp"), fixed).otherwise(F.col(time)))


def injection_time(normal_end: Column, abnormal_start: Column) -> Column:
    """The start of the abnormal window, or the middle of the gap before it."""
    a, b = F.unix_micros(normal_end), F.unix_micros(abnormal_start)
    return F.when(b > a, F.timestamp_micros(F.floor((a + b) / 2).cast("long"))).otherwise(abnormal_start)


def page(rows: DataFrame, order: list[str], size: int, number: int) -> DataFrame:
    """The page with that number, from 0, in a total order; pages are its feature."""
    return rows.orderBy(*order).offset(size * number).limit(size)
