"""N-gram Jaccard join: all documents whose word-shingle sets are alike, by T-occurrence search (DivideSkip).

1. Each text becomes its set of hashed shingles. Equal sets are one record from here on.
2. Of a set's SKETCH smallest hashes, a linked set shares at least a known number (but for a chance below
   CHANCE, as with hash collisions). Sets that share fewer with all others link with nothing and leave here.
3. The others' shingles are dealt to k segments by hash, k being more than the shingles in which two linked sets
   of that size can differ, so linked sets agree in at least one segment whole. Records that share a segment
   form a family; families are found over (segment, record) rows, without a pair. They only say which meet.
4. Each family is searched with DivideSkip over inverted lists of shingles: the short lists of a probe are
   merged by counting, the long ones probed by binary search, and what reaches the required overlap is linked.
   Small families share a bin; large ones are split into blocks that meet two at a time.

Only counts and one label a record leave a search, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracejobs.llm.common import drop, give_back, lean, small, store, text_batches
from tracejobs.llm.components import connected_components

#: Shingles of a bin or block.
BLOCK_SHINGLES = 400_000
#: Lists of sets, a few numbers a row, are broadcast up to this number of rows, else joined by a shuffle.
SMALL_REPS = 500_000
#: Smallest hashes that are compared first, and the chance that two linked sets share too few of them.
SKETCH = 48
CHANCE = 1e-15
#: Segments beyond what the difference needs: a set with at most so many empty segments may leave those out.
SPARE = 2
#: A list is long from this multiple of the median length on.
LONG = 8
MU = 0.0085

_C = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's n-word shingles, A-Z in lower case; the whole text if it has fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(n, len(words))
    rows = len(words) - width + 1
    acc = h[:rows]
    for i in range(1, width):
        acc = mix64(acc + _C) + h[i : i + rows]
    return np.unique(mix64(acc))


class Segments:
    """Signatures under which any two different sets with den * intersection >= num * union meet."""

    def __init__(self, num: int, den: int, largest: int = 1 << 40):
        self.num, self.den = num, den
        self.low, self.high = [1], []
        while self.low[-1] <= largest:
            self.high.append(max(self.low[-1], self.low[-1] * den * den // (num * num)))
            self.low.append(self.high[-1] + 1)
        self.differ = [2 * u * (den - num) // (den + num) for u in self.high]

    def of(self, s: np.ndarray) -> np.ndarray:
        """A linked set's size is in the same interval or in a neighbour; the larger one's interval rules."""
        n, out = len(s), []
        if not n:
            return np.empty(0, np.uint64)
        own = int(np.searchsorted(self.low, n, side="right")) - 1
        for j in (own, own + 1):
            if self.differ[j] == 0 or j > own and n * self.den < self.low[j] * self.num:
                continue
            k = self.differ[j] + 1 + SPARE
            salt = np.array([j + 1], np.uint64) * _C
            segment = (mix64(s ^ salt) % np.uint64(k)).astype(np.int64)
            acc = np.zeros(k, np.uint64)
            np.add.at(acc, segment, mix64(s + salt))
            filled = np.bincount(segment, minlength=k) > 0
            out.append(mix64(acc + mix64(np.arange(k, dtype=np.uint64) + salt))[filled])
            if k - int(filled.sum()) > SPARE:  # two such sets may agree in empty segments only; they share a shingle of their prefixes
                out.append(mix64(s[: n - -(-n * self.num // self.den) + 1] + mix64(salt)))
        return np.concatenate(out) if out else np.empty(0, np.uint64)


def merged(postings: np.ndarray, records: int) -> tuple[np.ndarray, np.ndarray]:
    """(records, how often each occurs) of sorted lists one after another: merged run by run if they are sparse, else counted in place."""
    if len(postings) * 4 > records:
        count = np.bincount(postings, minlength=records)
        met = np.nonzero(count)[0]
        return met, count[met]
    lists = np.sort(postings, kind="stable")  # merges the sorted runs
    begins = np.concatenate([[0], np.nonzero(lists[1:] != lists[:-1])[0] + 1]) if len(lists) else np.zeros(0, np.int64)
    return lists[begins], np.diff(np.append(begins, len(lists)))


def least_shared(num: int, den: int, size: int = SKETCH, chance: float = CHANCE) -> int:
    """How many of the ``size`` smallest hashes of their union two linked sets share, but for that chance (Chernoff's bound)."""
    j, part = num / den, lambda p, q: p * math.log(p / q) if p else 0.0
    if j >= 1:
        return size
    return sum(-size * (part(r / size, j) + part(1 - r / size, 1 - j)) < math.log(chance) for r in range(int(size * j)))


def divide_skip(sizes: np.ndarray, tokens: np.ndarray, left: np.ndarray, right: np.ndarray, num: int, den: int) -> Iterator[tuple[int, np.ndarray]]:
    """(probe, linked records) for each probe in ``left`` against the records in ``right``, each pair once.

    tokens: the records' sorted shingles one after another. If left is right, a probe is only compared with later records.
    """
    ends = np.cumsum(sizes)
    starts = ends - sizes
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    if left is not right:
        inside = np.isin(owner, right)
        listed, owner = tokens[inside], owner[inside]
    else:
        listed = tokens
    order = np.argsort(listed, kind="stable").astype(np.int32)
    listed, owner = listed[order], owner[order]
    del order
    first = np.concatenate([[0], np.nonzero(listed[1:] != listed[:-1])[0] + 1]) if len(listed) else np.zeros(0, np.int64)
    words, length = listed[first], np.diff(np.append(first, len(listed)))
    del listed
    same = left is right
    for r in left:
        mine = tokens[starts[r] : ends[r]]
        at = np.searchsorted(words, mine)
        at[at == len(words)] = 0
        here = words[at] == mine if len(words) else np.zeros(len(mine), bool)
        at, mine = at[here], mine[here]
        need = -(-int(sizes[r]) * num // den)  # T: what a link to a set of any allowed size needs
        if len(at) < need or not need:
            continue
        by_length = np.argsort(length[at], kind="stable")
        at, mine = at[by_length], mine[by_length]
        lengths = length[at]
        longest = min(need - 1, int(need / (MU * np.log2(max(2, lengths[-1])) + 1)), int((lengths > LONG * lengths[len(lengths) // 2]).sum()))
        split = len(at) - longest
        short = lengths[:split]
        posting = np.repeat(first[at[:split]] - np.cumsum(short) + short, short) + np.arange(short.sum())
        met, count = merged(owner[posting], len(sizes))
        enough = count >= need - longest
        found, count = met[enough], count[enough]
        keep = (found > r if same else found != r) & (sizes[found] * den >= sizes[r] * num) & (sizes[found] * num <= sizes[r] * den)
        found, overlap = found[keep], count[keep]
        for a in at[split:]:
            own = owner[first[a] : first[a] + length[a]]
            p = np.searchsorted(own, found)
            p[p == len(own)] = 0
            overlap = overlap + (own[p] == found)
        yield int(r), found[den * overlap >= num * (sizes[found] + sizes[r] - overlap)]


def search_block(pdf: pd.DataFrame, num: int, den: int, two: bool = False) -> pd.DataFrame:
    """(set_id, label, links) of the records of a bin or block, or (two) of a block on side 0 against another on side 1."""
    pdf = pdf.drop_duplicates(["set_id", "side"]).sort_values("set_id", kind="stable").reset_index(drop=True)
    sets = [np.frombuffer(b, np.uint64) for b in pdf["shingles"]]
    sizes = np.array([len(s) for s in sets], np.int64)
    copies, side, node = pdf["copies"].to_numpy(), pdf["side"].to_numpy(), pdf["set_id"].to_numpy()
    tokens = np.concatenate(sets)
    del pdf, sets
    left = np.nonzero(side == 0)[0]
    right = np.nonzero(side == 1)[0] if two else left
    links, label = np.zeros(len(node), np.int64), node.copy()
    for r, found in divide_skip(sizes, tokens, left, right, num, den):
        links[r] += copies[found].sum()
        links[found] += copies[r]
        met = label[found]
        if (met != label[r]).any():  # all that a row meets is one component from here on
            met = np.unique(np.append(met, label[r]))
            label[np.isin(label, met)] = met[0]
    del tokens
    give_back()
    return pd.DataFrame({"set_id": node, "label": label, "links": links})


def _long_lists(lists: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *lists])))


def _profile(docs: DataFrame, n: int) -> DataFrame:
    """(key, n_shingles, set_lo, set_hi, lowest); a set that the task has seen before needs no sketch again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, none = set(), np.empty(0, np.int64)
        for batch in batches:
            sizes, digests, lowest = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text, n)
                digest = xxhash.xxh3_128_digest(s.tobytes())
                lowest.append(none if digest in seen else s[:SKETCH].view(np.int64))
                seen.add(digest)
                sizes.append(len(s))
                digests.append(digest)
            two = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(two[:, 0]), pa.array(two[:, 1]), _long_lists(lowest)], ["key", "n_shingles", "set_lo", "set_hi", "lowest"])

    return docs.mapInArrow(lean(run), "key long, n_shingles long, set_lo long, set_hi long, lowest array<long>")


def _sets_of(rows: DataFrame, wanted: DataFrame, n: int, made: str, make) -> DataFrame:
    """For each of ``wanted`` (rep, set_id, ...) its other columns and what ``make`` gets from its shingles, a column of type ``made``.

    A key may have other texts as well: those are left out by their digest.
    """
    names = [c for c in wanted.columns if c != "rep"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(x, n) for x in batch.column(0).to_pylist()]
            right = [np.frombuffer(xxhash.xxh3_128_digest(s.tobytes())[:8], np.int64)[0] == lo for s, lo in zip(found, batch.column(1).to_pylist())]
            if any(right):
                yield pa.RecordBatch.from_arrays([*batch.filter(pa.array(right)).columns[1:], make([s for s, ok in zip(found, right) if ok])], [*names, "made"])

    both = rows.join(small(wanted, SMALL_REPS), rows.key == wanted.rep).select("text", *names)
    return both.mapInArrow(lean(run), ", ".join(f"{c} {t}" for c, t in both.dtypes[1:]) + f", made {made}")


def _meets(rows: DataFrame, by: str) -> DataFrame:
    """Of rows (set_id, by): (set_id, by, first) where the value is in more than one set; first: the smallest of these.

    Sums before the shuffle and a join, so that a value of very many sets is never sorted in one task.
    """
    known = rows.groupBy(by).agg(F.min("set_id").alias("first"), F.max("set_id").alias("last")).where("first < last")
    return rows.join(known.select(by, "first"), by)


def ngram_join(docs: DataFrame, text: str = "text", key: str = "doc_id", n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """One row per input row: key, n_shingles, component_id, n_links.

    Words are what is left between white space, A-Z in lower case. A document's set holds its distinct n-word
    shingles, or the whole sequence if it has fewer words; without words, or with a null text, it is empty and
    linked with nothing. Documents link when den * intersection >= num * union. component_id: the smallest key
    reachable by links, the own one included; n_links: other rows linked directly. Rows that repeat a text link
    with one another; rows that repeat a key with other texts are documents of their own. A row with a null key
    takes part only as a copy of a set that also has a key. An empty table gives an empty one. Other columns of
    any name are ignored.
    """
    spark = docs.sparkSession
    text_batches(spark)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    profile, at_profile = store(_profile(rows, n), "profile")
    kept, _ = store(profile.drop("lowest"), "sets")
    groups = kept.where("n_shingles > 0").groupBy("set_lo", "set_hi").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n"))
    groups, at_groups = store(groups, "groups")

    low = profile.select(F.col("set_lo").alias("set_id"), F.explode("lowest").alias("x"))
    shared, at_shared = store(_meets(low, "x").select("set_id", "x").distinct().groupBy("set_id").agg(F.count(F.lit(1)).alias("shared")), "shared")
    drop(spark, at_profile)
    enough = F.coalesce("shared", F.lit(0)) >= F.least(F.lit(least_shared(num, den)), F.ceil(F.col("n") * num / den))
    near, at_near = store(groups.join(shared, groups.set_lo == shared.set_id, "left").where(enough & F.col("rep").isNotNull()).select("rep", F.col("set_lo").alias("set_id")), "near")
    drop(spark, at_shared)

    segments = Segments(num, den)
    signed = _sets_of(rows, near, n, "array<long>", lambda sets: _long_lists([segments.of(s).view(np.int64) for s in sets]))
    signatures, at_signatures = store(signed.select("set_id", F.explode("made").alias("signature")), "signatures")
    meets, at_meets = store(_meets(signatures, "signature").where("set_id <> first").select("set_id", "first").distinct(), "meets")
    drop(spark, at_near, at_signatures)
    families, at_families = store(connected_components(meets, "set_id", "first"), "families")
    drop(spark, at_meets)

    # Linked sizes differ by one class at most, so a large family is searched class by class, each with the next.
    step = math.log(den / num) * (1 + 1e-9) if num < den else 1.0
    members = groups.join(families, groups.set_lo == families.node).where("rep IS NOT NULL").select(
        "rep", F.col("set_lo").alias("set_id"), "copies", "n", F.col("component").alias("family"), F.floor(F.log("n") / step).alias("class")
    )
    members, at_members = store(members, "members")
    sizes, at_sizes = store(members.groupBy("family", "class").agg(F.sum("n").alias("n")), "sizes")
    weights, at_weights = store(sizes.groupBy("family").agg((F.sum("n") > BLOCK_SHINGLES).alias("large"), F.sum("n").alias("n")), "weights")
    bins = weights.where("NOT large").agg(F.ceil(F.coalesce(F.sum("n"), F.lit(0)) / BLOCK_SHINGLES)).first()[0] or 1
    cut = sizes.join(weights.where("large").select("family"), "family").select("family", "class", F.ceil(F.col("n") / BLOCK_SHINGLES).alias("blocks"))
    by_class = Window.partitionBy("family").orderBy("class")  # as many rows as a family has classes: a size of 2**40 has 247 at 0.9
    there = lambda c, k: F.when(F.lag("class", -k).over(by_class) == F.col("class") + k, F.lag("blocks", -k).over(by_class)).otherwise(0).alias(c)
    cut, at_cut = store(cut.select("family", "class", "blocks", there("up", 1), there("down", -1)), "cut")

    sets = _sets_of(rows, members.select("rep", "set_id", "copies", "family", "class"), n, "binary", lambda found: pa.array([s.tobytes() for s in found], pa.binary()))
    placed = sets.withColumnRenamed("made", "shingles").join(small(cut, SMALL_REPS), ["family", "class"], "left")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>"))
    place = lambda kind, of, i, j, side: F.struct(F.lit(kind).alias("kind"), of.alias("of"), i.cast("long").alias("i"), j.cast("long").alias("j"), F.lit(side).alias("side") if isinstance(side, int) else side.alias("side"))
    c, zero = F.col("class"), F.lit(0).cast("long")
    o = F.pmod(F.xxhash64("set_id"), F.col("blocks"))
    places = F.when(F.col("blocks").isNull(), F.array(place(0, F.pmod(F.xxhash64("family"), F.lit(bins)), zero, zero, 0))).otherwise(F.concat(
        F.transform(upto(F.col("blocks")), lambda x: place(1, F.xxhash64("family", c), F.least(o, x), F.greatest(o, x), F.when(o > x, 1).otherwise(0))),
        F.transform(upto(F.col("up")), lambda x: place(2, F.xxhash64("family", c), o, x, 0)),
        F.transform(upto(F.col("down")), lambda x: place(2, F.xxhash64("family", c - 1), x, o, 1)),
    ))
    blocks = placed.select("set_id", "copies", "shingles", F.inline(places))
    searched, at_searched = store(
        blocks.groupBy("kind", "of", "i", "j").applyInPandas(
            lambda k, pdf: search_block(pdf, num, den, k[0] == 2 or k[2] != k[3]).assign(split=bool(k[0])), "set_id long, label long, links long, split boolean"
        ),
        "searched",
    )
    drop(spark, at_members, at_sizes, at_weights, at_cut, at_families)
    joined = connected_components(searched.where("split AND set_id <> label"), "set_id", "label")
    links = searched.groupBy("set_id").agg(F.sum("links").alias("links"), F.min("label").alias("label"))
    links = links.join(joined, links.set_id == joined.node, "left").select("set_id", "links", F.coalesce("component", "label").alias("label"))
    found = groups.join(links, groups.set_lo == links.set_id, "left").select(
        "set_lo", "set_hi", "rep", F.coalesce("label", "set_lo").alias("label"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links")
    )
    found, _ = store(found, "found")
    drop(spark, at_searched, at_groups)
    roots = found.groupBy("label").agg(F.min("rep").alias("component"))
    found = found.join(roots, "label").select("set_lo", "set_hi", "component", "links")
    return kept.join(found, ["set_lo", "set_hi"], "left").select(
        F.col("key").alias(key), "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("key")).alias("component_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
    )


#: Of the contract's query: three words, 90 of 100.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS s FROM w, unnest(range(1, greatest(2, len(w) - 1))) AS t(i) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS low FROM r GROUP BY a), k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(low, w.doc_id)) AS component_id, coalesce(n_links, 0) AS n_links
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN c ON w.doc_id = c.a LEFT JOIN k ON w.doc_id = k.a
"""
