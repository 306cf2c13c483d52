"""Audit of how filters interact: what each removes after others, in every order, from sorted posting lists.

For each part and range of row numbers there is a sorted list of failing rows per filter, and of rows with either
label. The unions of all sets of filters are made once by galloping merges, each from a union with one filter less;
their sizes, and those of their intersections with the labelled rows, are added up over ranges. Whatever an order
removes at a step is the difference of two of these sizes, so that orders cost nothing per document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracejobs.llm.common import SPACE, lean, store

#: Row numbers of a range; a posting list has no more entries.
RANGE = 1 << 16
#: Equal texts that are more than 1/HEAVY of all rows are joined by broadcast: there are fewer than HEAVY of them.
HEAVY = 512

FILTERS = "ABCDE"


def found_in(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Which entries of a sorted list are in another: each is looked for from where the one before it was found."""
    at = np.searchsorted(long, short)
    return (at < len(long)) & (long[np.minimum(at, len(long) - 1)] == short) if len(long) else np.zeros(len(short), bool)


def union(lists: list[np.ndarray]) -> np.ndarray:
    """The union of sorted lists, shorter lists galloping through what is merged so far."""

    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        short, long = (a, b) if len(a) <= len(b) else (b, a)
        new = short[~found_in(short, long)]
        return np.insert(long, np.searchsorted(long, new), new)

    return reduce(merge, sorted(lists, key=len), np.zeros(0, "int64"))


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Entries that two sorted lists share; the shorter gallops."""
    return int(found_in(*((a, b) if len(a) <= len(b) else (b, a))).sum())


def set_sizes(failing: list[np.ndarray], labelled: list[np.ndarray]) -> list[list[int]]:
    """For each set of filters (bit i is filter i): rows that fail any of them, and how many of those each label has."""
    unions = [np.zeros(0, "int64")]
    for s in range(1, 1 << len(failing)):
        top = s.bit_length() - 1
        unions.append(union([unions[s ^ 1 << top], failing[top]]))
    return [[len(u), *[common(u, x) for x in labelled]] for u in unions]


def text_filters(text: Column) -> dict[str, Column]:
    """What of a text fails: A under 200 words; B under half of them distinct; C over 3 % capitals; D one of #$%&*|."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 3 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def flags(docs: DataFrame, labels: DataFrame, part: str = "lang", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, row, A to E, good, toxic) for each document; row is a number of its own.

    E: a row with a smaller key has the same text; a null key is smaller than none and has none smaller. A document is
    good or toxic if any of its labels says so; a null key has no labels. Null text is empty, a null part is "".
    """
    said = F.coalesce(F.col(text), F.lit(""))
    own = text_filters(said)
    rows = docs.select(
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(key).alias("key"), F.sha2(said, 256).alias("sha"),
        *[c.alias(name) for name, c in own.items()], F.monotonically_increasing_id().alias("row"),
    )
    rows = store(rows, "flags")[0]
    firsts = store(rows.groupBy("sha").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "firsts")[0]
    bound = rows.count() / HEAVY
    heavy = F.broadcast(firsts.where(F.col("n") > bound).select("sha", "first"))
    light = firsts.where(F.col("n") <= bound).select("sha", F.col("first").alias("other"))
    same = rows.join(heavy, "sha", "left")
    # rows whose text is frequent need no partner of the other list; their keys spread them instead
    spread = F.when(F.col("first").isNull(), F.col("sha")).otherwise(F.col("row").cast("string"))
    same = same.withColumn("at", spread).join(light.withColumnRenamed("sha", "at"), "at", "left")
    repeated = F.coalesce(F.col("key") > F.coalesce("first", "other"), F.lit(False)).alias("E")
    same = same.select("part", "key", "row", "A", "B", "C", "D", repeated)
    says = labels.groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    says = says.where("doc_id IS NOT NULL AND (good OR toxic)").withColumnRenamed("doc_id", "label_of").withColumn("salt", F.lit(0).cast("long"))
    # null keys have no label, and are dealt out by row
    same = same.withColumn("salt", F.when(F.col("key").isNull(), F.col("row")).otherwise(0))
    out = same.join(says, (F.col("key") == F.col("label_of")) & (same["salt"] == says["salt"]), "left")
    return out.select("part", "row", *FILTERS, *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])


_SIZES = "part string, n long, failing array<long>, good array<long>, toxic array<long>"


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sizes of all unions of each part and range of a task."""
    longs = pa.list_(pa.int64())
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            lists = [batch[c][i].values.to_numpy() for c in [*FILTERS, "good", "toxic"]]
            rest, good, toxic = zip(*set_sizes(lists[: len(FILTERS)], lists[len(FILTERS) :]))
            out.append({"part": batch["part"][i].as_py(), "n": batch["n"][i].as_py(), "failing": rest, "good": good, "toxic": toxic})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("part", pa.string()), ("n", pa.int64()), ("failing", longs), ("good", longs), ("toxic", longs)]))


def postings(rows: DataFrame) -> DataFrame:
    """(part, range, n, a sorted list of row numbers for each filter and label) of flags()."""
    lists = [F.array_sort(F.collect_list(F.when(F.col(c), F.col("row")))).alias(c) for c in [*FILTERS, "good", "toxic"]]
    return rows.groupBy("part", F.floor(F.col("row") / RANGE).cast("long").alias("range")).agg(F.count(F.lit(1)).alias("n"), *lists)


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "lang", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per part, order of the five filters and step of it: what the step's filter removes, and what it would have.

    part, filter_order, step; longs kept (after the step), removed (here), redundant (fails the filter, removed earlier),
    unique_fails (fails this filter only), good_lost and toxic_lost (removed here with that label), shapley (removed by
    the filter, added up over all 120 orders). All rows and whole texts count; zeros are rows too. An empty table has
    no parts, so no rows. Columns of other names are ignored; of labels, rows that repeat a key count once.
    """
    lists = store(postings(flags(docs, labels, part, key, text)), "postings")[0]
    sums = [F.sum(F.get(c, F.lit(s))).alias(f"{c}_{s}") for c in ("failing", "good", "toxic") for s in range(1 << len(FILTERS))]
    per_part = lists.mapInArrow(lean(_sizes), _SIZES).groupBy("part").agg(F.sum("n").alias("n"), *sums)
    every = (1 << len(FILTERS)) - 1
    steps = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, i in enumerate(order, 1):
            steps.append(("".join(FILTERS[x] for x in order), step, i, before, before | 1 << i))
            before |= 1 << i
    # 600 fixed rows: every order's every step, with the sets of filters before and after it
    table = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(i).alias("i"), F.lit(b).alias("before"), F.lit(a).alias("after")) for o, s, i, b, a in steps])
    size = {c: F.array(*[F.col(f"{c}_{s}") for s in range(every + 1)]) for c in ("failing", "good", "toxic")}
    packed = per_part.select("part", "n", *[v.alias(c) for c, v in size.items()])
    one = [F.get("failing", F.lit(1 << i)) for i in range(len(FILTERS))]
    unique = [F.get("failing", F.lit(every)) - F.get("failing", F.lit(every ^ 1 << i)) for i in range(len(FILTERS))]
    # a set of k filters comes before the filter i in k! (4 - k)! of all orders
    ways = {0: 24, 1: 6, 2: 4, 3: 6, 4: 24}
    shapley = [reduce(lambda a, b: a + b, [(F.get("failing", F.lit(s | 1 << i)) - F.get("failing", F.lit(s))) * ways[s.bit_count()] for s in range(every + 1) if not s & 1 << i]) for i in range(len(FILTERS))]
    packed = packed.select("*", F.array(*one).alias("one"), F.array(*unique).alias("unique"), F.array(*shapley).alias("shapleys"))
    out = packed.select("*", F.inline(table))
    gone = lambda c: F.get(c, F.col("after")) - F.get(c, F.col("before"))
    return out.select(
        "part", "filter_order", "step", (F.col("n") - F.get("failing", F.col("after"))).alias("kept"), gone("failing").alias("removed"), (F.get("one", F.col("i")) - gone("failing")).alias("redundant"),
        F.get("unique", F.col("i")).alias("unique_fails"), gone("good").alias("good_lost"), gone("toxic").alias("toxic_lost"), F.get("shapleys", F.col("i")).alias("shapley"),
    )


ORACLE_SQL = r"""
WITH l AS (SELECT doc_id, coalesce(max(CAST(quality = 1 AS INT)), 0) AS good, coalesce(max(CAST(toxic = 1 AS INT)), 0) AS toxic FROM labels GROUP BY doc_id),
t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CAST(len(w) < 200 AS INT) AS a, CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT) AS b,
    CAST(100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text) AS INT) AS c,
    CAST(regexp_matches(text, '[#$%&*|]') AS INT) AS d, CAST(coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false) AS INT) AS e
  FROM t LEFT JOIN l ON t.doc_id = l.doc_id),
m AS (SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (
  SELECT p.f || q.f || r.f || s.f || t.f AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits FROM x p, x q, x r, x s, x t
  WHERE p.bit + q.bit + r.bit + s.bit + t.bit = 31 AND p.bit | q.bit | r.bit | s.bit | t.bit = 31),
st AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
g AS (
  SELECT part, filter_order, step, st.bit,
    CAST(sum(n) FILTER (mask & (before | st.bit) = 0) AS BIGINT) AS kept, CAST(sum(n) FILTER (mask & before = 0 AND mask & st.bit <> 0) AS BIGINT) AS removed,
    CAST(sum(n) FILTER (mask & before <> 0 AND mask & st.bit <> 0) AS BIGINT) AS redundant, CAST(sum(n) FILTER (mask = st.bit) AS BIGINT) AS unique_fails,
    CAST(sum(good) FILTER (mask & before = 0 AND mask & st.bit <> 0) AS BIGINT) AS good_lost, CAST(sum(toxic) FILTER (mask & before = 0 AND mask & st.bit <> 0) AS BIGINT) AS toxic_lost
  FROM m, st GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant, coalesce(unique_fails, 0) AS unique_fails,
  coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM g
"""
