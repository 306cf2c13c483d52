"""Shortest paths in service graphs, and how well a ranking's paths fit the true ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracejobs.functions.quantiles import ratio
from tracejobs.operators.rounds import cut


def shortest_paths(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(datapack, source, target, path): a shortest path from each source to all it reaches, the least of equally short ones; its own is itself.

    edges: (datapack, src, dst); sources: (datapack, source), which need not be in the graph. A round moves the frontier
    of all sources by one hop and keeps one path a target, so that paths are never enumerated.
    """
    edges = cut(edges.select("datapack", "src", "dst").distinct())
    front = cut(sources.select("datapack", "source").distinct().select("datapack", "source", F.col("source").alias("target"), F.array("source").alias("path")))
    found = front
    while not front.isEmpty():
        moved = front.join(edges.withColumnRenamed("src", "target"), ["datapack", "target"]).select("datapack", "source", F.col("dst").alias("target"), F.concat("path", F.array("dst")).alias("path"))
        front = cut(moved.groupBy("datapack", "source", "target").agg(F.min("path").alias("path")).join(found.select("datapack", "source", "target"), ["datapack", "source", "target"], "left_anti"))
        found = cut(found.unionByName(front))
    return found


def graph_nodes(edges: DataFrame) -> DataFrame:
    return edges.select("datapack", F.explode(F.array("src", "dst")).alias("name")).distinct()


def _jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def alignment_scores(edges: DataFrame, entry: str, predictions: DataFrame, truths: DataFrame, most: int = 5) -> DataFrame:
    """(datapack, algorithm, rank, name, alignment) for the first ``most`` ranks of each ranking.

    predictions: (datapack, algorithm, rank, name), truths: (datapack, name). A prediction scores, against each true
    service in the graph, the Jaccard similarity of the vertices of the paths from the entry to either, times the true
    path's length over the sum of the predicted one's and that from the predicted to the true service (0 if
    that is 0); the best true service counts, and the running maximum over the ranks so far. A prediction outside
    the graph scores 0 and leaves the maximum as it is. A pair without a path between scores 0. Datapacks whose graph lacks the
    entry, or from whose entry no true service is reached, give no rows.
    """
    nodes = cut(graph_nodes(edges))
    first = cut(predictions.where(F.col("rank") <= most))
    start = nodes.where(F.col("name") == entry).select("datapack", F.col("name").alias("source"))
    inside = first.join(nodes, ["datapack", "name"], "left_semi").select("datapack", F.col("name").alias("source"))
    all_paths = cut(shortest_paths(edges, start.unionByName(inside)))
    of_entry = all_paths.where(F.col("source") == entry)
    wanted = truths.select("datapack", F.col("name").alias("truth")).distinct()
    true_paths = of_entry.join(wanted, (of_entry["datapack"] == wanted["datapack"]) & (F.col("target") == F.col("truth"))).select(of_entry["datapack"], "truth", F.col("path").alias("true_path"))
    rows = first.join(true_paths.select("datapack").distinct(), "datapack", "left_semi")
    algo = of_entry.select("datapack", F.col("target").alias("name"), F.col("path").alias("algo_path"))
    between = all_paths.select("datapack", F.col("source").alias("name"), F.col("target").alias("truth"), F.col("path").alias("between"))
    pairs = rows.select("datapack", "name").distinct().join(algo, ["datapack", "name"]).join(true_paths, "datapack").join(between, ["datapack", "name", "truth"], "left")
    hops = lambda c: F.size(c) - 1
    far = F.when(F.col("between").isNotNull() & (hops("true_path") > 0), ratio(hops("true_path"), hops("algo_path") + hops("between"))).otherwise(0.0)
    best = pairs.groupBy("datapack", "name").agg(F.max(far * _jaccard(F.col("algo_path"), F.col("true_path"))).alias("score"))
    known = nodes.withColumn("known", F.lit(True))
    scored = rows.join(best, ["datapack", "name"], "left").join(known, ["datapack", "name"], "left")
    upto = F.max(F.when(F.col("known"), F.coalesce("score", F.lit(0.0)))).over(Window.partitionBy("datapack", "algorithm").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))  # a few ranks each
    return scored.select("datapack", "algorithm", "rank", "name", F.round(F.when(F.col("known"), upto).otherwise(0.0), 6).alias("alignment"))


def nearest_of_top(edges: DataFrame, magnitudes: DataFrame, roots: DataFrame, most: int, unreachable: int = 999) -> DataFrame:
    """(datapack, distance): the least number of hops from one of the ``most`` services of greatest magnitude to a root cause.

    magnitudes: (datapack, service_name, magnitude), ties by name; roots: (datapack, name). ``unreachable`` where none of them reaches one.
    """
    order = Window.partitionBy("datapack").orderBy(F.desc("magnitude"), "service_name")  # services
    top = cut(magnitudes.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("datapack", F.col("service_name").alias("source")))
    found = shortest_paths(edges, top).join(roots.select("datapack", F.col("name").alias("target")).distinct(), ["datapack", "target"])
    best = found.groupBy("datapack").agg(F.min(F.size("path") - 1).alias("distance"))
    return top.select("datapack").distinct().join(best, "datapack", "left").select("datapack", F.coalesce("distance", F.lit(unreachable)).alias("distance"))


def path_efficiency(edges: DataFrame, entry: str, predictions: DataFrame, truths: DataFrame) -> DataFrame:
    """(datapack, algorithm, efficiency): the part of the vertices on paths to all predictions that lie on paths to true services.

    0 if the entry is not in the graph, or a prediction is not reached from it. Predictions without a name do not count.
    """
    start = graph_nodes(edges).where(F.col("name") == entry).select("datapack", F.col("name").alias("source"))
    reached = cut(shortest_paths(edges, start)).select("datapack", F.col("target").alias("name"), "path")
    on_true = truths.select("datapack", "name").distinct().join(reached, ["datapack", "name"]).select("datapack", F.explode("path").alias("vertex")).distinct().withColumn("true", F.lit(1))
    named = predictions.where("name IS NOT NULL").join(reached, ["datapack", "name"], "left")
    lost = named.groupBy("datapack", "algorithm").agg(F.max(F.col("path").isNull()).alias("lost"))
    vertices = named.select("datapack", "algorithm", F.explode("path").alias("vertex")).distinct().join(on_true, ["datapack", "vertex"], "left")
    part = vertices.groupBy("datapack", "algorithm").agg((F.count("true") / F.count(F.lit(1))).alias("part"))
    return lost.join(part, ["datapack", "algorithm"], "left").select("datapack", "algorithm", F.round(F.when(F.col("lost"), 0.0).otherwise(F.coalesce("part", F.lit(0.0))), 6).alias("efficiency"))
