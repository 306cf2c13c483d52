"""The n-gram Jaccard join against all pairs compared in plain Python."""

import random

import pytest

from tracejobs.llm import ngram_join as nj


def brute(rows, n, num, den):
    """doc_id to (n_shingles, component_id, n_links) for rows with ids of their own."""
    sets = {}
    for k, text in rows:
        w = [x.lower() for x in (text or "").encode().split()]
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or {tuple(w)} if w else set()
    linked = {k: [o for o in sets if o != k and sets[k] and sets[o] and den * len(sets[k] & sets[o]) >= num * len(sets[k] | sets[o])] for k in sets}
    low = {k: k for k in sets}
    for _ in sets:
        low = {k: min([low[k]] + [low[o] for o in linked[k]]) for k in sets}
    return {k: (len(sets[k]), low[k], len(linked[k])) for k in sets}


@pytest.fixture(scope="module")
def rows():
    """Families of copies with 0 to 12 % of their words changed, chains, shared passages, short, empty, null and long texts."""
    rng = random.Random(11)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 5000}"
    passage = [word() for _ in range(60)]
    texts = [None, "", " \n", "One", "one", "one two", "two one", "ONE\ttwo three", "one two three four", "long " * 30_000, "a b " * 2_000]
    for size in (3, 8, 20, 40, 90, 400):
        for _ in range(3):
            base = [word() for _ in range(size)]
            texts += [" ".join(w if rng.random() > share else word() for w in base) for share in (0, 0, 0.01, 0.02, 0.03, 0.05, 0.12)]
            chain = list(base)
            for _ in range(6):  # each is near the one before it
                chain[rng.randrange(size)] = word()
                texts.append(" ".join(chain))
    texts += [" ".join([word() for _ in range(rng.randrange(20, 90))] + passage) for _ in range(40)]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts))


@pytest.mark.parametrize(("n", "num", "block"), [(3, 90, None), (5, 80, 150), (2, 40, 1000)])
def test_against_all_pairs(spark, rows, monkeypatch, n, num, block):
    if block:  # families split into blocks that meet
        monkeypatch.setattr(nj, "BLOCK_SHINGLES", block)
        monkeypatch.setattr(nj, "SMALL_REPS", 3)
    frame = spark.createDataFrame([(k, t, "x", k) for k, t in rows], "doc_id long, text string, rep string, set_id long").repartition(5)
    found = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in nj.ngram_join(frame, n=n, num=num, den=100).collect()}
    assert found == brute(rows, n, num, 100)


def test_repeated_and_null_keys(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(5, a), (5, b), (2, b + " more"), (None, a), (7, a), (None, "alone"), (None, "alone")]
    found = nj.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), n=3, num=90, den=100).collect()
    assert sorted(map(tuple, found), key=repr) == sorted([(5, 48, 5, 2), (7, 48, 5, 2), (None, 48, 5, 2), (5, 48, 2, 1), (2, 49, 2, 1), (None, 1, None, 1), (None, 1, None, 1)], key=repr)


def test_empty_table(spark):
    assert nj.ngram_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketch_bound():
    """The bound holds for the exact chances of the binomial, which are above those of drawing without replacement."""
    from math import comb

    for num in (20, 50, 80, 90):
        need, j = nj.least_shared(num, 100), num / 100
        assert sum(comb(nj.SKETCH, i) * j**i * (1 - j) ** (nj.SKETCH - i) for i in range(need)) < nj.CHANCE
    assert nj.least_shared(100, 100) == nj.SKETCH
