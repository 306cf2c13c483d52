"""Toxicity by class-conditional Kneser-Ney models.

Two models over the letters of words share one Kneser-Ney distribution learnt from toxic and ordinary documents
together. Each class tilts it by its part in the shared counts: the likelihood of an n-gram in a class is the
shared one times the class's part in the n-gram over its part in the context, parts being smoothed by the context's,
OWN documents strong. So a rare expression is judged by its stem, and what is seen never speaks for neither. As both likelihoods
hold the shared one, it cancels in their ratio and is never computed. A document's ratio is taken by length; two
numbers turn it into a probability. They are fitted on all labelled documents of the sample, each judged by
models that know the other folds alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracejobs.llm.common import drop, lean, store, text_batches

#: Letters of an n-gram, at most 8, so that one fits a 64-bit number exactly.
ORDER = 6
#: Documents that the context's parts weigh against an n-gram's own.
OWN = 1.0
#: The least ratio of a word: ordinary words differ by subject and language, so they would say more of these than of toxicity.
FLOOR = -0.2
#: At most so many labelled documents of each class are learnt from: those with the smallest hashes.
SAMPLE = 4_000
#: Parts of the sample: each is judged by what the others have, to fit the two numbers.
FOLDS = 4
#: Ordinary documents for each toxic one that the two numbers are fitted to, whatever the sample or the table has.
RATIO = 9.0
THRESHOLD = 0.7
#: Texts are judged as if so many neutral words were added, so that very short ones stay near even.
FEW = 15
#: The fit cuts off what is farther from the ordinary documents' median than so many distances of the outer tenths, below and above.
SPAN = (-0.5, 4.0)
#: Words whose ratios a task remembers.
REMEMBER = 150_000


def ngrams(words: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(packed n-grams, index of their word): one for each letter and for the end; words begin with zero bytes."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + order
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    flat = np.frombuffer(b"".join(bytes(order - 1) + w + b"\n" for w in words), np.uint8).astype(np.uint64)
    ends = np.cumsum(size)
    packed = np.zeros(len(flat), np.uint64)
    for i in range(order):
        packed[order - 1 :] |= flat[i : len(flat) - order + 1 + i] << np.uint64(8 * (order - 1 - i))
    inside = np.ones(len(flat), bool)
    for i in range(order - 1):
        inside[ends - size + i] = False
    return packed[inside], np.repeat(np.arange(len(words)), size - order + 1)


def lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float = 0.0) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), default)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], default)


def gram_counts(words: list[bytes], toxic: np.ndarray, ordinary: np.ndarray, order: int, step: int = 20_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted n-grams, toxic and ordinary counts), some words at a time, so that only different n-grams are held."""
    parts = []
    for at in range(0, len(words), step):
        grams, of = ngrams(words[at : at + step], order)
        keys, place = np.unique(grams, return_inverse=True)
        parts.append((keys, np.bincount(place, toxic[at : at + step][of]), np.bincount(place, ordinary[at : at + step][of])))
    keys, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, *(np.bincount(place, np.concatenate([p[i] for p in parts])) for i in (1, 2))


class Model:
    """Log-likelihood ratios, toxic over ordinary, of words of which ``toxic`` and ``ordinary`` documents hold so many."""

    def __init__(self, words: list[bytes], toxic: np.ndarray, ordinary: np.ndarray, order: int = ORDER, own: float = OWN):
        self.order = order
        self.keys, self.ratio = np.zeros(0, np.uint64), np.zeros(0)
        if not words:
            return
        self.keys, t, o = gram_counts(words, toxic, ordinary, order)
        contexts, at = np.unique(self.keys >> np.uint64(8), return_inverse=True)
        both = toxic.sum() + ordinary.sum()
        part = (np.bincount(at, t) + own * toxic.sum() / both) / (np.bincount(at, t + o) + own)
        part = np.clip(part, 1e-9, 1 - 1e-9)[at]
        mine = np.clip((t + own * part) / (t + o + own), 1e-9, 1 - 1e-9)
        self.ratio = np.log(mine / (1 - mine)) - np.log(part / (1 - part))

    def ratios(self, words: list[bytes]) -> np.ndarray:
        """The toxic less the ordinary log-likelihood of each word, FLOOR at least."""
        if not words or not len(self.keys):
            return np.zeros(len(words))
        grams, of = ngrams(words, self.order)
        return np.maximum(np.bincount(of, lookup(self.keys, self.ratio, grams), len(words)), FLOOR)


class Scorer:
    """Sum of ratios and number of words of texts; words are judged once.

    A word that a text repeats t times counts 1 + ln(t) times in both, so that one word repeated says little.
    """

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def sums(self, texts: list[str | None]) -> np.ndarray:
        split = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
        if len(self.known) > REMEMBER:
            self.known = {}
        new = list({w for words in split for w in words}.difference(self.known))
        self.known.update(zip(new, self.model.ratios(new).tolist()))
        get = self.known.__getitem__
        out = np.zeros((len(split), 2))
        for i, words in enumerate(split):
            times = Counter(words)
            n = 1 + np.log(np.fromiter(times.values(), np.float64, len(times)))
            out[i] = n @ np.fromiter(map(get, times), np.float64, len(times)), n.sum()
        return out


def probability(x: np.ndarray, numbers: tuple[float, float, float, float]) -> np.ndarray:
    centre, scale, slope, intercept = numbers
    if intercept == -np.inf:  # nothing was learnt
        return np.zeros(len(x))
    return 1 / (1 + np.exp(-np.clip(slope * np.clip((x - centre) / scale, *SPAN) + intercept, -500, 500)))


def quantile(x: np.ndarray, weights: np.ndarray, q: tuple[float, ...]) -> list[float]:
    """The smallest values that have at least the parts q of the weight at or below them."""
    order = np.argsort(x, kind="stable")
    upto = np.cumsum(weights[order])
    return [float(x[order[min(np.searchsorted(upto, part * upto[-1] * (1 - 1e-9)), len(x) - 1)]]) for part in q]


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-3, ratio: float = RATIO) -> tuple[float, float, float, float]:
    """(centre, scale, slope, intercept) of a logistic fit by Newton steps, rows of class 0 weighing ``ratio`` times those of 1 in all.

    So the numbers, and what passes the threshold, do not move with how many rows of each class there are. The
    scale sees both classes alike, so that the outer tenths are one of each.
    """
    ones = int(y.sum())
    even = np.where(y == 1, 1.0, ones / (len(y) - ones)) if 0 < ones < len(y) else np.ones(len(y))
    weights = np.where(y == 1, even, ratio * even) if 0 < ones < len(y) else even
    low, high = quantile(x, even, (0.1, 0.9)) if len(x) else (0.0, 0.0)
    centre = quantile(x[y == 0], np.ones(len(y) - ones), (0.5,))[0] if ones < len(y) else low
    scale = high - low or 1.0
    z = np.stack([np.clip((x - centre) / scale, *SPAN), np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (weights * p * (1 - p))[:, None]) + ridge * np.eye(2), z.T @ (weights * (y - p)) - ridge * w)
        w += np.clip(step, -3, 3)
    return centre, scale, float(w[0]), float(w[1])


def word_counts(train: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """(words, in how many documents of each fold and class each occurs: words x FOLDS x 2, class 0 the toxic one).

    Their number is bounded by the sample's vocabulary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for text, toxic, fold in zip(*(c.to_pylist() for c in batch.columns)):
                found.update((w, 2 * fold + 1 - toxic) for w in set((text or "").encode("utf-8", "surrogatepass").lower().split()))
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.binary()), pa.array([i for _, i in found], pa.int32()), pa.array(list(found.values()), pa.int32())], ["word", "slot", "n"])

    rows = train.select("text", "toxic", "fold").mapInArrow(run, "word binary, slot int, n int")
    found = rows.groupBy("word").agg(*[F.sum(F.when(F.col("slot") == i, F.col("n")).otherwise(0)).cast("int").alias(f"n{i}") for i in range(2 * FOLDS)]).orderBy("word").toArrow()
    return found["word"].to_pylist(), np.stack([found[f"n{i}"].to_numpy() for i in range(2 * FOLDS)], 1).reshape(-1, FOLDS, 2)


def model_of(words: list[bytes], counts: np.ndarray, without: int | None = None) -> Model:
    """The model of all folds but one."""
    n = counts.sum(axis=1) - (counts[:, without] if without is not None else 0)
    seen = n.any(axis=1)
    return Model([w for w, ok in zip(words, seen) if ok], n[seen, 0].astype(np.float64), n[seen, 1].astype(np.float64))


def fit(train: DataFrame) -> tuple[Model, tuple[float, float, float, float]]:
    """From rows (text, toxic, fold): the model of all, and the logistic numbers, from what the models of the other folds say of each fold."""
    words, counts = word_counts(train)

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        sums = Scorer(model_of(words, counts, int(pdf["fold"].iat[0]))).sums(pdf["text"].tolist())
        return pd.DataFrame({"toxic": pdf["toxic"], "x": sums[:, 0] / (sums[:, 1] + FEW)})

    judged = train.groupBy("fold").applyInPandas(judge, "toxic int, x double").toPandas().sort_values(["x", "toxic"], ignore_index=True)
    return model_of(words, counts), logistic(judged["x"].to_numpy(), judged["toxic"].to_numpy(np.float64))


def sample(docs: DataFrame, labels: DataFrame, text: str, key: str, toxic: str, size: int) -> DataFrame:
    """The rows to learn from (key, text, toxic, fold): at most ``size`` of each class, no row whose crc32 of the key mod 3 is 1.

    Of several labels for a key, the largest counts, of several texts the least; labels that are null or of no
    document count for nothing.
    """
    known = labels.select(F.col(key).cast("long").alias("key"), F.col(toxic).cast("int").alias("toxic")).where("key IS NOT NULL AND toxic IN (0, 1)")
    known = known.where(F.crc32(F.col("key").cast("string").cast("binary")) % 3 != 1).groupBy("key").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("key"), F.col("key")]
    chosen = known.where("toxic = 1").orderBy(*order).limit(size).unionByName(known.where("toxic = 0").orderBy(*order).limit(size))
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "key")  # 2 * size rows at most
    return rows.groupBy("key").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"), F.first(F.pmod(F.xxhash64("key", F.lit(1)), F.lit(FOLDS)).cast("int")).alias("fold"))


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", toxic: str = "toxic", threshold: float = THRESHOLD, size: int = SAMPLE, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: key, held_out, score, predicted, mean_ratio, and the columns ``carry`` as they were.

    The text alone is scored, whole; a null or empty one gets the score of no evidence. held_out: crc32 of the
    key as text mod 3 is 1; such rows teach nothing; a null key is not held out and has no label. With no label
    of either class to learn from, all scores are 0. Rows that repeat a key are scored each. An empty table
    gives an empty one. Other columns of any name are ignored.
    """
    text_batches(docs.sparkSession)
    train, at_train = store(sample(docs, labels, text, key, toxic, size), "labelled")
    model, numbers = (Model([], np.zeros(0), np.zeros(0)), (0.0, 1.0, 0.0, -np.inf)) if train.select("toxic").distinct().count() < 2 else fit(train)
    drop(docs.sparkSession, at_train)
    rows = docs.select(
        F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"),
        F.coalesce(F.crc32(F.col(key).cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(False)).alias("held_out"),
        *[F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)],
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                sums = scorer.sums(part.column(1).to_pylist())
                x = sums[:, 0] / (sums[:, 1] + FEW)
                p = probability(x, numbers)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(x), *part.columns[3:]], ["key", "held_out", "score", "predicted", "mean_ratio", *part.schema.names[3:]])

    scored = rows.mapInArrow(lean(run), "key long, held_out boolean, score double, predicted int, mean_ratio double" + "".join(f", {c} {t}" for c, t in rows.dtypes[3:]))
    return scored.select(F.col("key").alias(key), "held_out", "score", "predicted", "mean_ratio", *[F.col(f"carried_{i}").alias(c) for i, c in enumerate(carry)])
