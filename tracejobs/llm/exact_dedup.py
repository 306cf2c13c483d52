"""Exact deduplication with a split for heavy hitters.

Frequent digests are found with Misra-Gries summaries, their winners are verified by an exact aggregate and
broadcast, so that their rows are decided on the map side. All other digests use an ordinary shuffle; each of
their groups is smaller than rows / COUNTERS.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracejobs.llm.common import SPACE, store

#: Counters of a summary. A digest with more than rows / COUNTERS rows is always found.
COUNTERS = 1024


def misra_gries(counts: Counter, k: int) -> Counter:
    """The Misra-Gries summary with k counters of what ``counts`` counts: the (k+1)-th largest count goes from all."""
    if len(counts) <= k:
        return counts
    cut = sorted(counts.values(), reverse=True)[k]
    return Counter({x: n - cut for x, n in counts.items() if n > cut})


def frequent(df: DataFrame, column: str, k: int = COUNTERS) -> DataFrame:
    """Candidates for the values with more than rows / k rows: all of those and at most k others.

    One summary a partition, merged in two levels: 64 groups, then one, which gets 64 * k rows at most. Nulls
    are no values. An empty table has none.
    """

    def listed(kept: Counter) -> pd.DataFrame:
        return pd.DataFrame({"v": pd.Series(list(kept.keys()), dtype=object), "n": pd.Series(list(kept.values()), dtype="int64")})

    def summary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: Counter = Counter()
        for pdf in batches:
            part = pdf.groupby("v", sort=False)["n"].sum()
            kept.update(dict(zip(part.index, map(int, part))))
            kept = misra_gries(kept, k)
        if kept:
            yield listed(kept)

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: Counter = Counter()
        for _, part in pdf.groupby("part", sort=False):
            kept.update(dict(zip(part["v"], map(int, part["n"]))))
            kept = misra_gries(kept, k)
        return listed(kept)

    kind = dict(df.dtypes)[column]
    first = (
        df.select(F.col(column).alias("v"), F.lit(1).cast("long").alias("n")).where("v IS NOT NULL").mapInPandas(summary, f"v {kind}, n long")
        .withColumn("part", F.spark_partition_id())
    )
    # A digest's counts are added before the next cut, so that the levels lose no more than one pass would.
    level = first.groupBy(F.pmod("part", F.lit(64)).alias("g")).applyInPandas(merged, f"v {kind}, n long").withColumn("part", F.spark_partition_id())
    return level.groupBy(F.lit(0).alias("g")).applyInPandas(merged, f"v {kind}, n long").select(F.col("v").alias(column))


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = COUNTERS, row: str | None = None) -> DataFrame:
    """One row per input row: key, keep_id, group_size, kept, text_sha256, and the column ``row`` if one is named.

    Texts are equal when identical after each run of white space became one space; null counts as empty. Of
    equal texts exactly one row is kept, one with the smallest key, which is keep_id; a null key is kept only in
    a group without any other, whose keep_id is null. Of rows that repeat that key one is chosen by ``row``, a
    number that tells rows apart, else by a number given here. Other columns of any name are ignored.
    """
    number = F.col(row).cast("long") if row else F.monotonically_increasing_id()
    digests, _ = store(
        docs.select(F.col(key).alias("key"), F.sha2(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " "), 256).alias("sha"), number.alias("row")),
        "digests",
    )
    candidates, _ = store(frequent(digests, "sha", k), "frequent")
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "row"))
    totals = [first.alias("first"), F.count(F.lit(1)).alias("group_size")]
    # at most k rows, checked by construction of the summary
    heavy, _ = store(digests.join(F.broadcast(candidates), "sha", "left_semi").groupBy("sha").agg(*totals), "heavy")
    hot = digests.join(F.broadcast(heavy), "sha")
    same = Window.partitionBy("sha")
    cold = digests.join(F.broadcast(heavy.select("sha")), "sha", "left_anti").select(
        "sha", "key", "row", first.over(same).alias("first"), F.count(F.lit(1)).over(same).alias("group_size")
    )
    return hot.select("sha", "key", "row", "first", "group_size").unionByName(cold).select(
        F.col("key").alias(key),
        F.col("first.key").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
        *([F.col("row").alias(row)] if row else []),
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       coalesce(doc_id = min(doc_id) OVER w, count(*) OVER w = 1) AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
