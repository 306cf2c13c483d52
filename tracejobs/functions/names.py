"""Names of operations, pods and components as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalize_path(path: Column, rules: list[tuple[str, str]]) -> Column:
    """The template of the first rule (pattern, template) that matches the path, else the path."""
    out = path
    for pattern, template in reversed(rules):
        out = F.when(path.rlike(pattern), F.regexp_replace(path, pattern, template)).otherwise(out)
    return out


def pod_owner(pod: Column) -> Column:
    """struct(kind, owner, replicaset) of a pod name: of deployments, then stateful sets, then daemon sets; null for others."""
    # How pods are named.
    deployment, stateful, daemon = r"^(.+?)-([a-z0-9]{5,10})-([a-z0-9]{5})$", r"^(.+)-([0-9]+)$", r"^(.+)-([a-z0-9]{5})$"
    part = lambda pattern, i: F.regexp_extract(pod, pattern, i)
    owner = lambda kind, pattern, replicaset: F.struct(F.lit(kind).alias("kind"), part(pattern, 1).alias("owner"), replicaset.alias("replicaset"))
    none = F.lit(None).cast("string")
    return (
        F.when(pod.rlike(deployment), owner("Deployment", deployment, F.concat(part(deployment, 1), F.lit("-"), part(deployment, 2))))
        .when(pod.rlike(stateful), owner("StatefulSet", stateful, none)).when(pod.rlike(daemon), owner("DaemonSet", daemon, none))
    )


def component_name(name: Column) -> Column:
    """Trimmed, without a kind before a bar, in lower case, without a leading ts- and without hyphens."""
    bare = F.lower(F.regexp_replace(F.trim(name), r"^[^|]*\|", ""))
    return F.replace(F.regexp_replace(bare, "^ts-", ""), F.lit("-"), F.lit(""))


def search(rows: DataFrame, column: str, term: str, regex: bool = False, case: bool = False) -> DataFrame:
    """Rows whose column holds the term: literally, or as a pattern."""
    if regex:
        return rows.where(F.col(column).rlike(term if case else f"(?i){term}"))
    return rows.where(F.col(column).contains(term) if case else F.lower(column).contains(term.lower()))


def json_message(body: Column, field: str = "log") -> Column:
    """The field of a JSON body, or the body where it is no JSON or lacks the field."""
    return F.coalesce(F.get_json_object(body, f"$.{field}"), body)


def level_of(message: Column) -> Column:
    """The first level word of a message, WARNING as WARN, null without one."""
    found = F.regexp_extract(message, r"\b(TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL)\b", 1)
    return F.when(found == "WARNING", "WARN").when(found != "", found)


def epoch_time(x: Column) -> Column:
    """Seconds, milli-, micro- or nanoseconds since 1970, told apart by magnitude, as a timestamp."""
    micros = F.when(x < 1e11, x * 1e6).when(x < 1e14, x * 1e3).when(x < 1e17, x).otherwise(x / 1e3)
    return F.timestamp_micros(micros.cast("long"))


def http_span_name(name: Column) -> Column:
    """'HTTP POST http://service:port/path' as 'POST /path'; other names as they are."""
    return F.regexp_replace(name, r"^HTTP (\w+) https?://[^/]+(/.*)?$", "$1 $2")


def replaced_in_turn(name: Column, rules: list[tuple[str, str]]) -> Column:
    """The name after each rule (pattern, replacement) has replaced its first match, one rule after another."""
    for pattern, text in rules:
        name = F.regexp_replace(name, f"^(.*?){pattern}", "$1" + text)
    return name


def level_number(level: Column) -> Column:
    """Levels as numbers, so that the worst is the largest; null for other words."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in zip(("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL"), range(6)) for x in pair]), level)


def parsed_time(x: Column) -> Column:
    """Text as a time: a number by its magnitude, else an ISO form; null for what is neither."""
    return F.coalesce(epoch_time(F.try_to_number(x, F.lit("9999999999999999999")).cast("double")), F.try_to_timestamp(x))


def endpoint_of(component: Column) -> Column:
    """What follows the first ``::``, without one the first bar, trimmed, if it begins like a request of HTTP; else null."""
    after = lambda mark: F.regexp_extract(component, rf"(?s)^.*?{mark}\s*(.*?)\s*$", 1)
    found = F.when(component.contains("::"), after("::")).when(component.contains("|"), after(r"\|"))
    # How an endpoint begins.
    return F.when(found.rlike("^(HTTP |GET |POST |PUT |DELETE |PATCH |http://|https://)"), found)


def pair_of(name: Column) -> Column:
    """struct(source, target) of ``source->target``; the target is null without an arrow."""
    parts = F.split(name, "->")
    return F.struct(parts[0].alias("source"), F.get(parts, F.lit(1)).alias("target"))


def whole_number(x: Column) -> Column:
    """A label's value as an integer: infinities as plus or minus 999999999, fractions cut off, 0 for other text."""
    value = x.try_cast("double")
    return F.when(value.isNull() | F.isnan(value), 0).when(F.abs(value) == float("inf"), F.signum(value) * 999999999).otherwise(value).cast("long")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 if both are empty."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))
