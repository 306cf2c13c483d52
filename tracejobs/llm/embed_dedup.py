"""Embedding near-deduplication: spherical k-means cells, blocked cosine products within cells.

Every vector goes to the cell of its nearest centroid. Two linked vectors in different cells both lie within
their distance of the plane between the two centroids, so a vector near such a plane is also a guest in the
other cell: no link is lost, however the centroids fell. A cell compares its own vectors with all that it
holds; links of a guest are counted at home. Equal vectors are one record.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracejobs.llm.common import store
from tracejobs.llm.components import connected_components

#: The centroids are fitted on at most so many vectors, those with the smallest hashes; all vectors are indexed.
SAMPLE = 16_384
#: Vectors of a cell on average, and the largest number of cells.
CELL, MAX_CELLS = 2_000, 1_024
#: Records of a block; two blocks meet in a task.
BLOCK = 2_048
ROUNDS = 10


def units(vectors: list) -> np.ndarray:
    """Unit vectors, however large or small the components."""
    x = np.array(vectors, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1)[:, None]


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """k unit centroids of the unit vectors x, as many as there are different vectors at most."""
    x = np.unique(x, axis=0)
    if len(x) <= k:
        return x
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        nearest = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, nearest, x)
        norm = np.linalg.norm(total, axis=1)
        c = np.where(norm[:, None] > 0, total / np.where(norm > 0, norm, 1)[:, None], c)
    return c


def cells_of(x: np.ndarray, c: np.ndarray, threshold: float) -> list[np.ndarray]:
    """For each unit vector its cells, home first."""
    apart = np.sqrt(np.maximum(0, 2 - 2 * np.clip(c @ c.T, -1, 1)))
    reach = np.sqrt(2 - 2 * threshold) + 1e-6
    near = x @ c.T
    home = np.argmax(near, axis=1)
    guest = near[np.arange(len(x)), home][:, None] - near <= reach * apart[home]
    guest[np.arange(len(x)), home] = False
    return [np.concatenate([[h], np.nonzero(g)[0]]) for h, g in zip(home, guest)]


def search_block(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """(rep, label, links) of the records of a block: home rows of side 0 against all others.

    label: the smallest rep that the links found here reach. Home rows of side 0 come always; any other row has
    no links counted here and comes only if its label is not its own.
    """
    pdf = pdf.drop_duplicates(["rep", "side"]).sort_values(["rep", "side"], kind="stable").reset_index(drop=True)
    v = np.array(pdf["vector"].tolist(), np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    rep, copies, home = pdf["rep"].to_numpy(), pdf["copies"].to_numpy(), pdf["home"].to_numpy()
    leads = (pdf["side"] == 0).to_numpy() & home
    left = np.nonzero(leads)[0]
    right = np.arange(len(pdf)) if (pdf["side"] == 0).all() else np.nonzero((pdf["side"] == 1).to_numpy())[0]
    links, label = np.zeros(len(pdf), np.int64), rep.copy()
    for at in range(0, len(left), 256):
        rows = left[at : at + 256]
        cosine = unit[rows] @ unit[right].T
        linked = cosine >= threshold
        for i, j in np.argwhere(np.abs(cosine - threshold) < 1e-9):  # rounding decides: the plain formula
            a, b = v[rows[i]], v[right[j]]
            linked[i, j] = a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= threshold
        linked &= rep[rows][:, None] != rep[right][None, :]
        links[rows] += linked @ copies[right]
        for i in np.nonzero(linked.any(axis=1))[0]:  # every link counts: all that a row meets is one component from here on
            met = np.unique(np.append(label[right[linked[i]]], label[rows[i]]))
            if len(met) > 1:
                label[np.isin(label, met)] = met[0]
    told = leads | (label != rep)
    return pd.DataFrame({"rep": rep[told], "label": label[told], "links": links[told]})


def embed_dedup(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98) -> DataFrame:
    """One row per input row: key, n_links, component_id, kept.

    Rows link when their labels are equal and not null and their cosine, in double precision, is at least the
    threshold. Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; nor
    do vectors of different lengths with one another; a null key links with nothing and keeps a null component.
    Rows that repeat a key are vectors of their own and reach one another through it.
    n_links: other rows linked directly, equal vectors included. component_id: the smallest key reachable by
    links. kept: key = component_id. An empty table gives an empty one; other columns of any name are ignored.
    """
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    good = F.col("key").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0) & F.coalesce(
        F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vector", lambda x: x != 0), F.lit(False)
    )
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(label).alias("label"), v.alias("vector"))
    rows, _ = store(rows.withColumn("good", F.coalesce(good, F.lit(False))).withColumn("vector", F.when(F.col("good"), F.col("vector"))), "vectors")
    # -0.0 and 0.0 are one value in a grouping key
    groups = rows.where("good").groupBy("label", "vector").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("copies"))
    # a record's number: its own, as one key may have several vectors
    groups, _ = store(groups.withColumn("rep", F.monotonically_increasing_id()), "groups")
    sample = groups.orderBy(F.xxhash64("vector"), "first", "label").select("vector").limit(SAMPLE).toPandas()["vector"].tolist()
    if not sample:
        return rows.select(F.col("key").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"), F.lit(True).alias("kept"))
    n, centroids = groups.count(), {}
    for width in set(map(len, sample)):  # lengths that the sample has not met have one cell, whose blocks meet all the same
        own = [x for x in sample if len(x) == width]
        centroids[width] = spherical_kmeans(units(own), max(1, min(MAX_CELLS, int(n / CELL * len(own) / len(sample)))))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for width, part in pdf.groupby(pdf["vector"].map(len)):
                cells = cells_of(units(part["vector"].tolist()), centroids[width], threshold) if width in centroids else [np.zeros(1, np.int64)] * len(part)
                yield part.assign(cells=cells, width=width)

    kind = dict(groups.dtypes)["label"]
    placed = groups.select("label", "vector", "rep", "copies").mapInPandas(assign, f"label {kind}, vector array<double>, rep long, copies long, cells array<long>, width int")
    placed, _ = store(placed.select("label", "width", "vector", "rep", "copies", F.posexplode("cells").alias("rank", "cell")).withColumn("home", F.col("rank") == 0).drop("rank"), "cells")
    blocks = placed.groupBy("label", "width", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    sized = placed.join(blocks, ["label", "width", "cell"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    # a record leads its own block and follows in all others
    lead = sized.withColumn("i", F.col("own")).withColumn("j", F.explode(F.expr("sequence(0L, blocks - 1)"))).where("home").withColumn("side", F.lit(0))
    follow = sized.withColumn("j", F.col("own")).withColumn("i", F.explode(F.expr("sequence(0L, blocks - 1)")))
    follow = follow.where("NOT (home AND i = j)").withColumn("side", F.when(F.col("i") == F.col("j"), 0).otherwise(1))
    dealt = lead.unionByName(follow).select("label", "width", "cell", "i", "j", "side", "home", "rep", "copies", "vector")
    found = dealt.groupBy("label", "width", "cell", "i", "j").applyInPandas(lambda pdf: search_block(pdf, threshold), "rep long, label long, links long")
    found, _ = store(found, "found")
    # records of one key reach one another through it
    of_key = rows.where("good").select("key", "label", "vector").distinct().join(groups.select("label", "vector", "rep"), ["label", "vector"]).select("key", "rep")
    several = of_key.groupBy("key").agg(F.min("rep").alias("label"), F.max("rep").alias("last")).where("label < last").select("key", "label")
    through = of_key.join(several, "key").select("rep", "label").where("rep <> label")
    joined = connected_components(found.where("rep <> label").select("rep", "label").unionByName(through), "rep", "label")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = groups.join(links, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    least = groups.where("component IS NOT NULL").groupBy("component").agg(F.min("first").alias("least"))
    groups = groups.join(least, "component", "left")
    groups = groups.select("label", "vector", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("least", "first").alias("component"))
    both = rows.join(groups, ["label", "vector"], "left")
    component = F.when(F.col("good"), F.col("component")).otherwise(F.col("key"))
    return both.select(
        F.col("key").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("key") == component, F.lit(True)).alias("kept"),
    )


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda c: c <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.x, b.x) / sqrt(list_inner_product(a.x, a.x)) / sqrt(list_inner_product(b.x, b.x)) >= CAST(0.98 AS DOUBLE)
), r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS low FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, least(vec_id, coalesce(low, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN n ON vec_id = n.a LEFT JOIN c ON vec_id = c.a
"""
