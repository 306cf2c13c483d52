"""Cost-balanced packing of tokenized documents into sequences.

Documents are dealt to groups of about GROUP_BYTES of text by hash. A group opens as many full sequences as its
tokens fill, and one sequence for each power of two in the rest, which needs no padding either. Documents go in
by descending length, each to the sequence of the lowest cost (linear plus quadratic in the lengths of its
pieces, as attention stays within a document) that has room for it; where none has, it is cut to fill the
cheapest one with any room.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator
from string import punctuation

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracejobs.llm.common import give_back, lean, text_batches

LENGTH = 4096
END_ID = 2
GROUP_BYTES = 4_000_000
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
#: Words whose ids a Python worker remembers, from one task to the next.
REMEMBER = 200_000
#: Rows of one key and text are dealt to as many groups.
SPREAD = 4096


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class _Places(dict):
    """Word to place; a word that is new gets the next one and is noted."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self)
        self.new.append(word)
        return place


class Words:
    """Token ids of texts, word by word.

    The vocabulary's pre-tokenizer never joins what white space parts, so each word's ids are looked up or made
    once. ASCII white space only, as bytes.split() has it: other white space stays within a word and is for the
    tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.comma = self.tokenizer.encode(",", add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        self.places, self.stems = _Places(), {}
        self.start, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)
        self.stem_start, self.stem_ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def learn(self) -> None:
        """Letters are one token run, ASCII ones in either case, and the punctuation after them is another."""
        new, self.places.new = [w.decode("utf-8", "surrogatepass") for w in self.places.new], []
        parts: list[str] = []
        for w in new:
            stem = w.rstrip(punctuation)
            if not stem.isalpha():
                parts += (w, "")
            else:
                parts += (stem.lower() if stem.isascii() else stem, w[len(stem) :])
        fresh = [x for x in dict.fromkeys(parts) if x not in self.stems]
        self.stems.update(zip(fresh, range(len(self.stems), len(self.stems) + len(fresh))))
        size, ids = self.tokenize(fresh)
        self.stem_start = np.concatenate([self.stem_start, self.stem_start[-1] + np.cumsum(size)])
        self.stem_ids = np.concatenate([self.stem_ids, ids])
        at = np.fromiter(map(self.stems.__getitem__, parts), np.int64, len(parts))
        size = self.stem_start[at + 1] - self.stem_start[at]
        made = self.stem_ids[np.repeat(self.stem_start[at] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(size.reshape(-1, 2).sum(axis=1))])
        self.ids = np.concatenate([self.ids, made])

    def tokenize(self, stems: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each stem, all their ids). Stems of letters are told apart by commas in long texts, which have an id of their own."""
        comma = self.comma
        found: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(stems)
        plain = [i for i, x in enumerate(stems) if x.isalpha()] if len(comma) == 1 else []
        parts = [plain[i : i + 500] for i in range(0, len(plain), 500)]
        odd = sorted(set(range(len(stems))).difference(plain))
        texts = [",".join(stems[i] for i in part) for part in parts]
        for part, e in zip(parts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            cuts = np.nonzero(ids == comma[0])[0]
            if len(cuts) != len(part) - 1:
                odd += part
                continue
            begins, ends = [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)]
            for i, b, c in zip(part, begins, ends):
                found[i] = ids[b:c]
        for i, e in zip(odd, self.tokenizer.encode_batch_fast([stems[i] for i in odd], add_special_tokens=False)):
            found[i] = np.array(e.ids, np.uint32)
        return np.fromiter(map(len, found), np.int64, len(found)), np.concatenate([np.zeros(0, np.uint32), *found])

    def encode(self, texts: list[str | None], remember: int = REMEMBER) -> list[np.ndarray]:
        if len(self.places) > remember:
            self.forget()
        at = [np.fromiter(map(self.places.__getitem__, words), np.int64, len(words)) for words in ((t or "").encode("utf-8", "surrogatepass").split() for t in texts)]
        self.learn()
        out = []
        for places in at:
            begin, end = self.start[places], self.start[places + 1]
            size = end - begin
            ids = np.empty(int(size.sum()) + 1, np.uint32)
            ids[:-1] = self.ids[np.repeat(end - np.cumsum(size), size) + np.arange(len(ids) - 1)]
            ids[-1] = END_ID
            out.append(ids)
        return out


@functools.lru_cache(maxsize=1)
def words_of(path: str) -> Words:
    """The worker's own; a word's ids are the same whatever was learnt before."""
    return Words(path)


def capacities(tokens: int, length: int = LENGTH) -> list[int]:
    """Full sequences, then the powers of two of the rest."""
    rest = tokens % length
    return [length] * (tokens // length) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(lengths: np.ndarray, length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of all pieces; every sequence ends up full to its capacity."""
    room = np.array(capacities(int(lengths.sum()), length), np.int64)
    full = room.copy()
    cost = np.zeros(len(room))
    pieces = []
    for d in np.argsort(-lengths, kind="stable"):
        start, left = 0, int(lengths[d])
        while left:
            fits = room >= min(left, length)
            if not fits.any():
                fits = room > 0
            s = int(np.argmin(np.where(fits, cost, np.inf)))
            n = min(left, int(room[s]))
            pieces.append((int(d), start, n, s, int(full[s] - room[s])))
            room[s] -= n
            cost[s] += LINEAR * n + QUADRATIC * n * n
            start, left = start + n, left - n
    return pieces


def pack_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, path: str | None = None, with_ids: bool = False, remember: int = REMEMBER) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    A document's ids are its text's, without special tokens, then END_ID; a null text counts as empty. The
    pieces of a document cover its ids once; a sequence's pieces lie one after another from offset 0 on. All
    sequences are full or as long as a power of two. Rows that repeat a key are documents of their own. An
    empty table gives an empty one. Other columns of any name are ignored.
    ``remember``: words whose ids a worker keeps; more of them save time and take memory, and change no result.
    """
    from tokenizers import Tokenizer

    text_batches(docs.sparkSession)
    path = path or tokenizer_file()
    kind = np.uint16 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else np.uint32
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    groups = max(1, (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // GROUP_BYTES)
    rows = rows.withColumn("group", F.pmod(F.xxhash64("key", "text", F.monotonically_increasing_id() % SPREAD), F.lit(groups)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(path)
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                ids = [x.astype(kind).tobytes() for x in words.encode(part.column(1).to_pylist(), remember)]
                yield pa.RecordBatch.from_arrays([part.column(2), part.column(0), pa.array(ids, pa.binary())], ["group", "key", "ids"])

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        # the row order of a group may differ when a lost task runs again: sort by what the rows hold
        pdf = pdf.assign(crc=[zlib.crc32(b) for b in pdf["ids"]]).sort_values(["key", "crc"], kind="stable").reset_index(drop=True)
        ids = [np.frombuffer(b, kind).astype("<u4") for b in pdf["ids"]]
        out = []
        for d, start, n, s, offset in pack(np.array([len(x) for x in ids], np.int64), length):
            part = ids[d][start : start + n].tobytes()
            out.append((pdf["key"].iat[d], start, n, zlib.crc32(part), len(ids[d]), (int(pdf["group"].iat[0]) << 32) + s, offset, part if with_ids else b""))
        del ids, pdf
        give_back()
        made = pd.DataFrame(out, columns=["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])
        return made.astype({"key": "Int64"})

    encoded = rows.mapInArrow(lean(encode), "group long, key long, ids binary")
    pieces = encoded.groupBy("group").applyInPandas(deal, "key long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
    return pieces.select(F.col("key").alias(key), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids)
