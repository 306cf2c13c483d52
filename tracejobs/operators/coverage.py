"""How well sampled traces stand for all, and set comparisons."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracejobs.operators.structure import KEY, path_encoding


def entry_spans(spans: DataFrame, entrance: str = "loadgenerator", second: str = "ui") -> DataFrame:
    """Roots of the load generator; in a datapack without, those of the entrance service; else any root."""
    roots = spans.where("coalesce(parent_span_id, '') = ''")
    kind = F.when(F.col("service_name") == entrance, 0).when(F.col("service_name") == second, 1).otherwise(2)
    best = roots.groupBy("datapack").agg(F.min(kind).alias("best"))
    return roots.withColumn("kind", kind).join(best, "datapack").where("kind = best").drop("kind", "best")


def first_entry(spans: DataFrame) -> DataFrame:
    """Each trace's first entry span by time, then id."""
    first = F.min(F.struct("time", "span_id", "service_name", "span_name", "duration")).alias("e")
    return entry_spans(spans).groupBy(*KEY).agg(first).select(*KEY, "e.span_id", "e.span_name", "e.duration")


def _entries(spans: DataFrame, samples: DataFrame) -> DataFrame:
    chosen = samples.select(*KEY).distinct().withColumn("chosen", F.lit(True))
    return first_entry(spans).join(chosen, KEY, "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))


def sampler_scores(spans: DataFrame, samples: DataFrame, rate: float, rare: float = 0.05) -> DataFrame:
    """Per datapack: actual rate, how near it is to the wanted one, entry types covered, rare traces' part, balance.

    balance_cv: population deviation by mean of the sampled traces per sampled entry type, 0 for one type.
    """
    types = _entries(spans, samples).groupBy("datapack", "span_name").agg(F.count(F.lit(1)).alias("n"), F.count_if("chosen").alias("s"))
    types = types.withColumn("all", F.sum("n").over(Window.partitionBy("datapack")))
    is_rare = F.col("n") / F.col("all") < rare
    s = F.when(F.col("s") > 0, F.col("s"))
    g = types.groupBy("datapack").agg(F.sum("n").alias("traces"), F.sum("s").alias("sampled"), F.count_if(F.col("s") > 0).alias("types_sampled"), F.count(F.lit(1)).alias("types"), F.sum(F.when(is_rare, F.col("s")).otherwise(0)).alias("rare_sampled"), F.stddev_pop(s).alias("sd"), F.avg(s).alias("m"))
    actual = F.col("sampled") / F.col("traces")
    return g.select(
        "datapack", "traces", "sampled", F.round(actual, 6).alias("actual_rate"), F.round(F.abs(actual - rate) / rate, 6).alias("controllability"), F.round(F.col("types_sampled") / F.col("types"), 6).alias("api_coverage"),
        "rare_sampled", F.round(F.when(F.col("types_sampled") > 1, F.col("sd") / F.col("m")).otherwise(0.0), 6).alias("balance_cv"),
    )


def rare_entries(spans: DataFrame, rare: float = 0.05) -> DataFrame:
    """Entry types of less than that part of a datapack's traces."""
    n = first_entry(spans).groupBy("datapack", "span_name").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("part", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("datapack")), 6)).where(F.col("part") < rare)


def span_coverage(spans: DataFrame, samples: DataFrame) -> DataFrame:
    """Part of a datapack's different service and span names that sampled traces have."""
    chosen = samples.select(*KEY).distinct().withColumn("chosen", F.lit(True))
    name = F.struct("service_name", "span_name")
    g = spans.join(chosen, KEY, "left").groupBy("datapack").agg(F.count_distinct(name).alias("names"), F.count_distinct(F.when(F.col("chosen"), name)).alias("sampled_names"))
    return g.withColumn("coverage", F.round(F.col("sampled_names") / F.col("names"), 6))


def pattern_entropy(spans: DataFrame, samples: DataFrame) -> DataFrame:
    """Shannon entropy, in bits, of the sampled traces' path encodings."""
    coded = path_encoding(spans.join(samples.select(*KEY).distinct(), KEY, "left_semi"))
    n = coded.groupBy("datapack", "encoding").agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("datapack"))
    return n.withColumn("p", p).groupBy("datapack").agg(F.round(-F.sum(F.col("p") * F.log2("p")), 6).alias("entropy"), F.count(F.lit(1)).alias("patterns"))


def set_scores(found: DataFrame, truth: DataFrame, key: list[str]) -> DataFrame:
    """Precision, recall and F1 of found against true elements (all columns but the key) per key; 1 where both are empty."""
    rows = found.distinct().withColumn("f", F.lit(1)).join(truth.distinct().withColumn("t", F.lit(1)), found.columns, "full")
    g = rows.groupBy(*key).agg(F.count("f").alias("found"), F.count("t").alias("true"), F.count(F.col("f") + F.col("t")).alias("matched"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.when(F.col(b) > 0, F.col(b))).otherwise(0.0)
    g = g.withColumn("precision", ratio("matched", "found")).withColumn("recall", ratio("matched", "true"))
    f1 = F.when(F.col("matched") > 0, 2 * F.col("matched") / (F.col("found") + F.col("true"))).otherwise(0.0)
    return g.select(*key, "matched", (F.col("true") - F.col("matched")).alias("missed"), (F.col("found") - F.col("matched")).alias("extra"), F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(f1, 6).alias("f1"))


def set_elements(found: DataFrame, truth: DataFrame, key: list[str]) -> DataFrame:
    """(key, matched, missed, extra): the elements themselves, sorted, each as its columns joined by a blank. Lists are as long as a key's sets are."""
    rows = found.distinct().withColumn("f", F.lit(1)).join(truth.distinct().withColumn("t", F.lit(1)), found.columns, "full")
    name = F.concat_ws(" ", *[c for c in found.columns if c not in key])
    listed = lambda when: F.array_sort(F.collect_list(F.when(when, name)))
    f, t = F.col("f").isNotNull(), F.col("t").isNotNull()
    return rows.groupBy(*key).agg(listed(f & t).alias("matched"), listed(~f & t).alias("missed"), listed(f & ~t).alias("extra"))


def distances(edges: DataFrame, source: str, most: int | None = None) -> DataFrame:
    """(datapack, service_name, distance) from the source along edges, for all services reached.

    A service farther than ``most`` hops, if that is given, raises an error.

    Service graphs are small (distinct names), but the steps are joins all the same; each is cut by a checkpoint
    where the session names a folder.
    """
    cut = edges.sparkSession.sparkContext.getConf().get("spark.checkpoint.dir")
    keep = lambda df: df.checkpoint() if cut else df.cache()
    edges = keep(edges.select("datapack", "src", "dst").distinct())
    front = edges.where(F.col("src") == source).select("datapack", F.col("src").alias("service_name"), F.lit(0).alias("distance")).distinct()
    found = front
    for hop in count(1):
        step = front.join(edges.withColumnRenamed("src", "service_name"), ["datapack", "service_name"]).select("datapack", F.col("dst").alias("service_name"), F.lit(hop).alias("distance")).distinct()
        front = keep(step.join(found.select("datapack", "service_name"), ["datapack", "service_name"], "left_anti"))
        if front.isEmpty():
            break
        if most is not None and hop > most:
            raise ValueError(f"a service is farther than {most} hops")
        found = found.unionByName(front)
    return found
