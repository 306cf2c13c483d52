"""Scores of a predicted causal graph against the true one, per sample.

Tables are keyed by ``sample``; names are compared after names.component_name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracejobs.functions.names import component_name
from tracejobs.operators.rounds import cut


def _sides(found: DataFrame, truth: DataFrame) -> DataFrame:
    return found.withColumn("side", F.lit("found")).unionByName(truth.withColumn("side", F.lit("true")))


def component_scores(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(sample, matched, precision, recall, f1) of component names (sample, component) after normalising.

    Different spellings of one name match once, but each counts among its side's names. Both sides empty cannot occur, as
    a sample without names is in neither table; no found names: 0; no true names: precision 0, recall 1.
    """
    rows = _sides(found.select("sample", "component").distinct(), truth.select("sample", "component").distinct())
    n = lambda side: F.count_if(F.col("side") == side)
    by = rows.groupBy("sample", component_name(F.col("component")).alias("name")).agg(n("found").alias("f"), n("true").alias("t"))
    g = by.groupBy("sample").agg(F.sum("f").alias("found"), F.sum("t").alias("true"), F.count_if((F.col("f") > 0) & (F.col("t") > 0)).alias("matched"))
    p = F.when(F.col("found") > 0, F.col("matched") / F.when(F.col("found") > 0, F.col("found"))).otherwise(0.0)
    r = F.when(F.col("true") > 0, F.col("matched") / F.when(F.col("true") > 0, F.col("true"))).otherwise(1.0)
    f1 = F.when(p + r > 0, 2 * p * r / F.when(p + r > 0, p + r)).otherwise(0.0)
    return g.select("sample", "matched", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(F.col("matched") > 0, f1).otherwise(0.0), 6).alias("f1"))


def state_scores(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(sample, coverage, extra): the part of true components whose states (sample, component, state) overlap, and the part of found ones that do not.

    Without true states coverage is 1 and all found ones are extra. Nodes of one name put their states together.
    """
    rows = _sides(found.select("sample", "component", "state"), truth.select("sample", "component", "state")).where("state IS NOT NULL")
    both = rows.groupBy("sample", component_name(F.col("component")).alias("name"), "state").agg(F.max(F.col("side") == "found").alias("f"), F.max(F.col("side") == "true").alias("t"))
    by = both.groupBy("sample", "name").agg(F.max("f").alias("f"), F.max("t").alias("t"), F.max(F.col("f") & F.col("t")).alias("m"))
    g = by.groupBy("sample").agg(F.count_if("f").alias("found"), F.count_if("t").alias("true"), F.count_if("m").alias("matched"))
    coverage = F.when(F.col("true") == 0, 1.0).otherwise(F.col("matched") / F.when(F.col("true") > 0, F.col("true")))
    extra = F.when(F.col("found") == 0, 0.0).otherwise((F.col("found") - F.col("matched")) / F.when(F.col("found") > 0, F.col("found")))
    return g.select("sample", F.round(coverage, 6).alias("coverage"), F.round(extra, 6).alias("extra"))


def temporal_scores(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(sample, score): 1 less the mean relative error, at most 1 each, of the times (sample, component, timestamp) of components that both have.

    Names are compared as they are. A true time of 0 does not count; samples without a common component have no row. Of several
    times of a component the greatest counts.
    """
    last = lambda df, name: df.where("timestamp IS NOT NULL").groupBy("sample", "component").agg(F.max("timestamp").alias(name))
    both = last(found, "f").join(last(truth, "t"), ["sample", "component"]).where("t <> 0")
    return both.groupBy("sample").agg(F.round(1 - F.avg(F.least(F.abs(F.col("f") - F.col("t")) / F.abs("t"), F.lit(1.0))), 6).alias("score"))


def path_reachability(found_edges: DataFrame, found_roots: DataFrame, true_roots: DataFrame, alarms: DataFrame, true_edges: DataFrame, entrance: str = "loadgenerator") -> DataFrame:
    """(sample, reachable) for each sample with found roots or true ones: whether found edges lead from a correct root to an alarm.

    Null where no found root is true, or there is no alarm to reach. The entrance is no alarm; if it was the only one, the
    services that call it in the true edges are. A root that is an alarm is reachable. One frontier serves all roots of all
    samples, and a sample that has arrived leaves it.

    edges: (sample, src, dst); roots and alarms: (sample, service).
    """
    norm = lambda df, *names: df.select("sample", *[component_name(F.col(c)).alias(c) for c in names]).distinct()
    right = norm(found_roots, "service").join(norm(true_roots, "service"), ["sample", "service"])
    told = norm(alarms, "service")
    own = told.where(F.col("service") != entrance)
    callers = norm(true_edges, "src", "dst").where(F.col("dst") == entrance).select("sample", F.col("src").alias("service"))
    only = told.select("sample").distinct().join(own.select("sample").distinct(), "sample", "left_anti")
    goals = cut(own.unionByName(callers.join(only, "sample", "left_semi")).distinct())
    edges = cut(norm(found_edges, "src", "dst").withColumnRenamed("src", "service"))
    front = cut(right.join(goals.select("sample").distinct(), "sample", "left_semi"))
    started, seen, arrived = front.select("sample").distinct(), front, None
    while not front.isEmpty():
        now = cut(front.join(goals, ["sample", "service"], "left_semi").select("sample").distinct())
        arrived = now if arrived is None else cut(arrived.unionByName(now))
        moved = front.join(arrived, "sample", "left_anti").join(edges, ["sample", "service"]).select("sample", F.col("dst").alias("service")).distinct()
        front = cut(moved.join(seen, ["sample", "service"], "left_anti"))
        seen = cut(seen.unionByName(front))
    samples = found_roots.select("sample").unionByName(true_roots.select("sample")).distinct().join(started.withColumn("started", F.lit(True)), "sample", "left")
    hit = (front.select("sample") if arrived is None else arrived).withColumn("hit", F.lit(True))
    return samples.join(hit, "sample", "left").select("sample", F.when(F.col("started"), F.coalesce("hit", F.lit(False))).alias("reachable"))
