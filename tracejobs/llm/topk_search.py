"""Exact top-k search by distributed histogram selection.

Every query is scored against every row, in blocks, as integer inner products. A round cuts the window of scores in
which a query's k-th value lies into BINS parts, counts the scores in each over all tasks, and goes on with the part
that holds the k-th value, until the parts above its lower edge hold few scores or the part is one score wide. A last
pass keeps the scores from that edge on; equal scores are told apart by the smaller key.

A block counts only from its own k-th best score on: the k-th value of all rows is never below that of a block, so the
parts below cannot hold it. Blocks of rows and of queries meet by a join on block numbers, never as rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracejobs.llm.common import lean, store, text_batches

#: Vectors and queries of a block, and its bytes at most.
BLOCK_ROWS, ASKED_ROWS, BLOCK_BYTES = 2048, 1024, 1 << 20
#: Query blocks that are broadcast have this many bytes together at most; else the join shuffles.
BROADCAST_BYTES = 32 << 20
#: A round's parts of a window: 2 ** BITS.
BITS = 9
#: A window is narrow enough when so many scores are at its lower edge or above.
FEW = 64
#: Components are held within this, scores within a long's range.
MOST = 1 << 62
LEAST_SCORE, MOST_SCORE = -(1 << 63), (1 << 63) - 1


def whole_numbers(vectors: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as 64-bit integers, held within MOST."""
    return np.clip(np.floor(scale * vectors.astype("float64")), -float(MOST), float(MOST)).astype("int64")


def scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products, exactly: in the shortest numbers that hold every partial sum."""
    dim = queries.shape[1]
    top = lambda m: int(np.abs(m.astype("float64")).max(initial=0)) + 1
    longest = lambda m: float(np.sqrt((m.astype("float64") ** 2).sum(axis=1).max(initial=0.0))) + 1
    bound = min(dim * top(queries) * top(rows), int(longest(queries) * longest(rows) * 1.001) + 1)
    if bound < 1 << 24:
        return (queries.astype("float32") @ rows.astype("float32").T).astype("int64")
    if bound < 1 << 53:
        return (queries.astype("float64") @ rows.astype("float64").T).astype("int64")
    exact = queries.astype(object) @ rows.astype(object).T
    return np.clip(exact, LEAST_SCORE, MOST_SCORE).astype("int64") if dim else np.zeros((len(queries), len(rows)), "int64")


def _blocks(scale: float, most: int):
    """Vectors of a task, one block for each length of vectors and batch of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["vector"]
            sizes = np.diff(lists.offsets.to_numpy()) if batch.num_rows else np.zeros(0, int)
            flat, starts = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for dim in np.unique(sizes):
                own = np.flatnonzero(sizes == dim)
                step = max(1, min(most, BLOCK_BYTES // (8 * max(1, int(dim)))))
                for at in range(0, len(own), step):
                    some = own[at : at + step]
                    matrix = whole_numbers(np.stack([flat[starts[i] : starts[i] + dim] for i in some]), scale)
                    far = float(np.sqrt((matrix.astype("float64") ** 2).sum(axis=1).max(initial=0.0)))
                    keys = batch["key"].take(pa.array(some))
                    yield pa.RecordBatch.from_pydict(
                        {"dim": pa.array([dim], pa.int64()), "n": pa.array([len(some)], pa.int64()), "far": [far], "matrix": [matrix.astype("<i8").tobytes()],
                         "keys": pa.array([keys.to_pylist()], pa.list_(pa.int64())), "rows": pa.array([batch["row"].take(pa.array(some)).to_pylist()], pa.list_(pa.int64()))})

    return run


_BLOCK = "dim long, n long, far double, matrix binary, keys array<long>, rows array<long>"


def _pair(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, dict]:
    """The scores of a pair of blocks, where they count (not a row with itself), and the blocks' other columns."""
    get = lambda c: batch[c][i]
    dim, n, m = get("dim").as_py(), get("n").as_py(), get("q_n").as_py()
    rows = np.frombuffer(get("matrix").as_buffer(), "<i8").reshape(n, dim)
    queries = np.frombuffer(get("q_matrix").as_buffer(), "<i8").reshape(m, dim)
    ids, q_ids = get("rows").values.to_numpy(), get("q_rows").values.to_numpy()
    return scores(queries, rows), q_ids[:, None] != ids[None, :], {"ids": ids, "q_ids": q_ids}


def _histogram(k: int, width: int, parts: int):
    """Counts of a pair of blocks: (q, part, n) of each open query, from the block's own k-th best score on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                s, counts, names = _pair(batch, i)
                low, q = batch["low"][i].values.to_numpy(), names["q_ids"]
                open_ = batch["open"][i].values.to_numpy(zero_copy_only=False).astype(bool)
                s, counts, low, q = s[open_], counts[open_], low[open_], q[open_]
                over = s.astype("uint64") - low.astype("uint64")[:, None]  # distances above the window's lower edge
                inside = counts & (s >= low[:, None])
                if width < 64:
                    inside &= over >> np.uint64(width) == 0
                part = np.where(inside, (over >> np.uint64(width - parts)).astype("int64"), -1)
                if part.shape[1] > k:
                    part = np.where(part >= np.partition(part, -k, axis=1)[:, -k, None], part, -1)
                at = np.flatnonzero(part >= 0)
                found, n = np.unique((at // part.shape[1]) << parts | part.ravel()[at], return_counts=True)
                yield pa.RecordBatch.from_pydict({"q": pa.array(q[found >> parts], pa.int64()), "part": pa.array(found & ((1 << parts) - 1), pa.int64()), "n": pa.array(n, pa.int64())})

    return run


def _best(k: int):
    """A pair of blocks' best k rows at each query's edge or above, equal scores by key (nulls last), then row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                s, counts, names = _pair(batch, i)
                keys = batch["keys"][i].values
                none = keys.is_null().to_numpy(zero_copy_only=False)
                rank = np.empty(len(keys), "int64")  # by key, nulls last, then row
                rank[np.lexsort((names["ids"], keys.fill_null(0).to_numpy(), none))] = np.arange(len(keys))
                low = batch["low"][i].values.to_numpy()
                r, c = np.nonzero(counts & (s >= low[:, None]))
                order = np.lexsort((rank[c], -s[r, c], r))
                r, c = r[order], c[order]
                first = np.searchsorted(r, r)  # where each query's run starts
                keep = np.arange(len(r)) - first < k
                r, c = r[keep], c[keep]
                yield pa.RecordBatch.from_pydict({
                    "query_id": batch["q_keys"][i].values.take(pa.array(r)), "query_row": pa.array(names["q_ids"][r], pa.int64()), "key": keys.take(pa.array(c)),
                    "row": pa.array(names["ids"][c], pa.int64()), "score": pa.array(s[r, c], pa.int64()),
                })

    return run


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k best other rows of each query: query_id, rank, key, score, and query_row, which tells queries of one key apart.

    Queries are the rows whose key is divisible by ``every``. A component x becomes floor(scale * x); the score is
    the inner product, with vectors of the same number of components only. Equal scores: smaller key first, a null key
    last, then the row. Vectors that are null or hold null or non-finite components take no part; vectors without
    components have score 0 with each other. Components beyond 2^62 and scores beyond a long count as the greatest. Rows that repeat a key are rows of
    their own. Queries without another row give no result, nor does an empty table.
    """
    spark = vectors.sparkSession
    text_batches(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    x = F.col(vector)
    sound = vectors.where(x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf"))))
    rows = sound.select(F.col(key).cast("long").alias("key"), F.transform(x, lambda v: v.cast("double")).alias("vector"), F.monotonically_increasing_id().alias("row"))
    rows = store(rows.repartition(tasks), "vectors")[0]
    blocks = store(rows.mapInArrow(lean(_blocks(scale, BLOCK_ROWS)), _BLOCK), "blocks")[0]
    asked = rows.where((F.col("key") % every) == 0)
    # one task for each ASKED_ROWS queries, so that their blocks are full
    full = asked.repartition(max(1, -(-asked.count() // ASKED_ROWS))).mapInArrow(lean(_blocks(scale, ASKED_ROWS)), _BLOCK)
    full = store(full.withColumn("i", F.monotonically_increasing_id()), "asked")[0]
    numbers = full.select("dim", "i", F.row_number().over(Window.partitionBy("dim").orderBy("i")).alias("block"))  # of blocks, not rows
    asked = store(full.join(numbers, ["dim", "i"]).select("dim", "block", *[F.col(c).alias(f"q_{c}") for c in ("n", "matrix", "keys", "rows")]), "queries")[0]
    dims = store(asked.groupBy("dim").agg(F.max("block").alias("blocks"), F.sum(F.octet_length("q_matrix")).alias("bytes")), "dims")[0]
    fits = (dims.agg(F.sum("bytes")).first()[0] or 0) <= BROADCAST_BYTES
    # each block of rows once for each block of queries of its length
    pairs = blocks.join(dims.select("dim", "blocks"), "dim").withColumn("block", F.explode(F.sequence(F.lit(1), F.col("blocks"))))

    def meet(now: DataFrame) -> DataFrame:
        """Pairs of blocks, with the edges of the block's queries in their order and which of them are open."""
        of = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("at", "low", "open"))), lambda s: s[c]).alias(c)
        now = asked.join(now.groupBy("dim", "block").agg(of("low"), of("open")), ["dim", "block"])
        return pairs.select("dim", "block", "n", "matrix", "keys", "rows").join(F.broadcast(now) if fits else now, ["dim", "block"])

    far = blocks.agg(F.max("far")).first()[0] or 0.0
    width = min(64, (int(far * far * 1.001) + 2).bit_length() + 1)
    state = asked.select("dim", "block", F.posexplode("q_rows").alias("at", "q"))
    state = store(state.select("*", F.lit(-(1 << (width - 1))).cast("long").alias("low"), F.lit(0).cast("long").alias("above"), F.lit(True).alias("open")), "state")[0]
    while not state.where("open").isEmpty():
        cut = min(BITS, width)
        found = meet(state).where(F.exists("open", lambda o: o)).mapInArrow(lean(_histogram(k, width, cut)), "q long, part long, n long")
        width -= cut
        counts = found.groupBy("q", "part").agg(F.sum("n").alias("n")).join(state.select("q", "above"), "q")
        upto = F.col("above") + F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("part")))  # 2 ** BITS rows a query at most
        held = counts.withColumn("upto", upto).where(F.col("upto") >= k).groupBy("q").agg(F.max(F.struct("part", "upto", "n")).alias("held"))
        # a query that no part holds has fewer than k rows: all of them stay
        now = state.join(held, "q", "left")
        wide = lambda c: c.cast("decimal(38,0)")
        low = (wide(F.col("low")) + wide(F.coalesce("held.part", F.lit(0))) * F.lit(Decimal(1 << width))).cast("long")
        above = F.coalesce(F.when(F.col("open"), F.col("held.upto") - F.col("held.n")), F.col("above"))
        state = store(now.select("dim", "block", "at", "q", low.alias("low"), above.alias("above"), (F.coalesce(F.col("held.upto") > FEW, F.lit(False)) & F.lit(width > 0)).alias("open")), "state")[0]
    best = meet(state).mapInArrow(lean(_best(k)), "query_id long, query_row long, key long, row long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("key"), "row")
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", F.col("key").alias(key), "score", "query_row")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, r.vec_id, CAST(list_inner_product(q.v, r.v) AS BIGINT) AS score FROM v q JOIN v r ON q.vec_id <> r.vec_id AND len(q.v) = len(r.v) WHERE q.vec_id % 50 = 0),
k AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT * FROM k WHERE rank <= 5
"""
