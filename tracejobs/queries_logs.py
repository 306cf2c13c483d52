"""Queries of log templates over the driver's events, and the templates that are planted in them in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracejobs.operators import templates
from tracejobs.operators.rounds import cut
from tracejobs.queries import _add
from tracejobs.sources import fixtures as fx

_NAMES = ("anna", "boris", "chen", "dora", "emil", "farah", "goro")
# event -> message; {id}, {user}, {name}, {value} are filled in
_MESSAGES = {
    "view": "Fetched page {id} for user {name} in {value} ms from cache",
    "click": "Clicked button {user} on screen {name} of session {id} again",
    "error": "Failed to call 10.0.{user}.7:8080 after {id} tries because {name} gave no answer",
    "purchase": "Order {id} of customer {name} was paid with {value} credits and sent",
    "signup": "New account {name} made from invitation code {id} without mail",
}


def _messages(spark: SparkSession, d: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("user_id") % len(_NAMES) + 1).cast("int"))
    fill = {"{id}": F.col("event_id").cast("string"), "{user}": (F.col("user_id") % 250).cast("string"), "{name}": name, "{value}": F.round("value", 2).cast("decimal(20,2)").cast("string")}
    text = F.lit(None).cast("string")
    for kind, form in _MESSAGES.items():
        said = F.lit(form)
        for hole, value in fill.items():
            said = F.replace(said, F.lit(hole), value)
        text = F.when(F.col("event_type") == kind, said).otherwise(text)
    return fx.read(spark, d, "events").select("event_id", text.alias("message"))


def _planted(form: str) -> str:
    for hole in ("{id}", "{name}", "{value}", "10.0.{user}.7:8080", "{user}"):
        form = form.replace(hole, templates.ANY)
    return form


_PLANTED = "p AS (SELECT event_id, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{_planted(m)}'" for k, m in _MESSAGES.items()) + " END AS template FROM events), t AS (SELECT *, dense_rank() OVER (ORDER BY template) AS template_id FROM p)"


def _counted(spark: SparkSession, d: str) -> DataFrame:
    rows = cut(_messages(spark, d))
    return templates.with_templates(rows, templates.mine_templates(rows)).groupBy("template_id", F.col("log_template").alias("template")).agg(F.count(F.lit(1)).alias("n"))


def _of_logs(spark: SparkSession, d: str) -> DataFrame:
    rows = cut(_messages(spark, d))
    return templates.with_templates(rows, templates.mine_templates(rows)).select("event_id", "template_id")


_add("t15_log_templates", _counted, f"WITH {_PLANTED} SELECT template_id, template, count(*) AS n FROM t GROUP BY ALL")
_add("j06_template_of_logs", _of_logs, f"WITH {_PLANTED} SELECT event_id, template_id FROM t")
