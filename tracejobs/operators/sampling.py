"""Sampling of traces, repeatable by seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["datapack", "trace_id"]
BINS = 1 << 16


def score(seed: int = 0) -> Column:
    """A number in [0, 1) that follows from the trace and the seed."""
    return F.conv(F.substring(F.md5(F.concat(F.col("trace_id").cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def online(spans: DataFrame, rate: float, seed: int = 0) -> DataFrame:
    """Spans of traces whose score is above 1 - rate: a filter, without a shuffle."""
    return spans.where(score(seed) > 1 - rate)


def offline(spans: DataFrame, rate: float, seed: int = 0) -> DataFrame:
    """Per datapack, the floor of rate * traces with the highest scores.

    A histogram of scores tells in which of BINS bins the last one lies; only that bin's traces are ranked.
    """
    traces = spans.select(*KEY).distinct().withColumn("sample_score", score(seed)).withColumn("bin", F.floor(F.col("sample_score") * BINS))
    bins = traces.groupBy("datapack", "bin").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("datapack")  # of bins
    upto = bins.withColumn("upto", F.sum("c").over(w.orderBy(F.desc("bin")))).withColumn("most", F.floor(F.sum("c").over(w) * rate))
    last = upto.where((F.col("upto") >= F.col("most")) & (F.col("most") > 0)).groupBy("datapack").agg(F.max(F.struct("bin", (F.col("most") - F.col("upto") + F.col("c")).alias("left"))).alias("last"))
    rows = traces.join(last.select("datapack", F.col("last.bin").alias("last"), "last.left"), "datapack")
    above = rows.where("bin > last")
    place = F.row_number().over(Window.partitionBy("datapack").orderBy(F.desc("sample_score"), "trace_id"))
    edge = rows.where("bin = last").withColumn("place", place).where("place <= left")
    return above.select(*KEY, "sample_score").unionByName(edge.select(*KEY, "sample_score"))


def rank_services(candidates: DataFrame, value: str) -> DataFrame:
    """Services of a datapack by their summed value, ties by name, the load generator left out."""
    summed = candidates.where("service_name <> 'loadgenerator'").groupBy("datapack", "service_name").agg(F.sum(value).alias("total"))
    return summed.withColumn("rank", F.row_number().over(Window.partitionBy("datapack").orderBy(F.desc("total"), "service_name")))


def random_ranking(spans: DataFrame, seed: int = 0) -> DataFrame:
    """The abnormal period's services of a datapack in an order that follows from the seed."""
    found = spans.where("period = 'abnormal' AND trim(service_name) <> ''").select("datapack", F.col("service_name").alias("name")).distinct()
    mixed = F.md5(F.concat("datapack", F.lit(":"), "name", F.lit(f":{seed}")))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("datapack").orderBy(mixed, "name")))
