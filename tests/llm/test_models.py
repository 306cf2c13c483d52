"""The two learnt operators and the pipeline's stages on small inputs, against plain Python."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from tracejobs.llm import lm_score as lm_score_model
from tracejobs.llm import toxicity as toxicity_model
from tracejobs.llm.lm_score import lm_score
from tracejobs.llm.toxicity import toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "tu", "sa") for b in ("ra", "den", "vol", "pis", "gom")]
RUDE = ["zwuxxer", "qyzzling", "wuxxhead"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [(i, " ".join(rng.choice(WORDS + RUDE * 4 if i % 2 else WORDS) for _ in range(60)), "en", "ab"[i % 2], None) for i in range(300)]
    out += [(300, out[4][1], "en", "a", None), (301, out[4][1].replace(" ", "  "), None, None, None), (302, None, "en", "b", None), (303, "", None, "a", None), (304, out[6][1] + " one", "en", "a", None)]
    return out


def test_lm_base_score(spark, rows):
    tokens = {r[0]: re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").lower()) + [None] for r in rows}
    train = Counter(t for k, ts in tokens.items() if zlib.crc32(str(k).encode()) % 7 != 2 for t in ts)
    n, v = sum(train.values()), len(train)
    found = {r.doc_id: r for r in lm_score(spark.createDataFrame(rows, DOCS)).collect()}
    assert len(found) == len(rows)
    for k, ts in tokens.items():
        r = found[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(k).encode()) % 7 == 2, len(ts), sum(train[t] > 0 for t in ts), n)
        assert math.isclose(r.base_score, sum(math.log10((train[t] + 1) / (n + 1 * (v + 1))) for t in ts), rel_tol=1e-9) and r.score < 0


def test_toxicity(spark, rows):
    labels = spark.createDataFrame([(r[0], 1, r[0] % 2) for r in rows[:300]], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in toxicity(spark.createDataFrame(rows, DOCS), labels).collect()}
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found.values())
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(found[i].held_out for i in held) and sum(found[i].predicted == i % 2 for i in held) >= 0.95 * len(held)
    assert found[302].predicted == found[303].predicted == 0


def test_toxicity_ratios_against_plain_counts(rows):
    """The model's ratios from dictionaries of counts, letter by letter."""
    order, own = toxicity_model.ORDER, toxicity_model.OWN
    counts: dict = {}
    for k, text, *_ in rows[:120]:
        for w in set(text.split()):
            counts.setdefault(w, [0, 0])[1 - k % 2] += 1
    counts |= {"ünï": [3, 0], "x": [0, 4]}
    grams, contexts = {}, {}
    pad = lambda w: bytes(order - 1) + w.encode() + b"\n"
    for w, (t, o) in counts.items():
        for i in range(len(w.encode()) + 1):
            g = pad(w)[i : i + order]
            for d, key in ((grams, g), (contexts, g[:-1])):
                d[key] = (d.get(key, (0, 0))[0] + t, d.get(key, (0, 0))[1] + o)
    prior = sum(t for t, _ in counts.values()) / sum(t + o for t, o in counts.values())

    def ratio(w):
        out = 0.0
        for i in range(len(w.encode()) + 1):
            g = pad(w)[i : i + order]
            if g not in grams:
                continue
            (t, o), (ct, co) = grams[g], contexts[g[:-1]]
            part = (ct + own * prior) / (ct + co + own)
            mine = (t + own * part) / (t + o + own)
            out += math.log(mine / (1 - mine) / (part / (1 - part)))
        return max(out, toxicity_model.FLOOR)

    words = [*counts, "unseen", RUDE[0] + "s", RUDE[1][:5], "é", ""]
    n = [[c[i] for c in counts.values()] for i in (0, 1)]
    model = toxicity_model.Model([w.encode() for w in counts], *(toxicity_model.np.array(x, float) for x in n))
    found = model.ratios([w.encode() for w in words])
    assert found.tolist() == pytest.approx([ratio(w) for w in words], abs=1e-9) and max(found) > 1


def test_toxicity_under_other_label_counts():
    """Nine times as many ordinary rows move no number of the fit."""
    rng = random.Random(1)
    x, y = [rng.gauss(2 * (i % 2), 1) for i in range(400)], [i % 2 for i in range(400)]
    more = [(a, b) for a, b in zip(x, y) for _ in range(1 if b else 9)]
    fits = [toxicity_model.logistic(*(toxicity_model.np.array(v, float) for v in pair)) for pair in ((x, y), zip(*more))]
    assert fits[1] == pytest.approx(fits[0], rel=1e-6) and fits[0][2] > 0


def test_toxicity_repeated_and_null_keys(spark, rows):
    """Training is the same however rows that repeat a key are ordered; null keys and empty tables are scored."""
    labels = spark.createDataFrame([(r[0], 1, r[0] % 2) for r in rows[:300]] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    more = [(r[0], r[1], r[0], "clash") for r in rows] + [(k, rows[k + 1][1], k, "clash") for k in range(0, 40)] + [(None, rows[1][1], 0, "clash"), (None, None, 0, "clash"), (None, "long " * 50_000, 0, "clash")]
    kind = "doc_id long, text string, score long, toxic string"
    ways = [sorted(map(tuple, toxicity(spark.createDataFrame(order, kind), labels).collect()), key=repr) for order in (more, more[::-1])]
    assert ways[0] == ways[1] and len(ways[0]) == len(more)
    assert toxicity(spark.createDataFrame([], kind), labels).count() == 0
    assert all(r.score == 0 for r in toxicity(spark.createDataFrame(more, kind), labels.where("toxic = 0 AND doc_id > 0")).collect())


def test_pipeline_stages(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    exact = corpus_pipeline.drop_exact_copies(spark, docs, "")
    assert exact.columns == docs.columns and {r.doc_id for r in exact.collect()} == set(range(305)) - {300, 301, 303}

    def five(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {r[0]: five(r[1]) for r in rows}
    root = {k: k for k in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {k: new if v == old else v for k, v in root.items()}
    near = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert near.columns == docs.columns and {r.doc_id for r in near.collect()} == {k for k, v in root.items() if k == v}
    mixed = corpus_pipeline.mix_sources(spark, docs, "")
    taken = Counter()
    for r in mixed.collect():
        taken[r.doc_id] += len(r.text.split())
    from tracejobs.llm.mixing import mix

    assert mixed.columns == docs.columns and dict(taken) == {r.doc_id: r.taken for r in mix(docs).collect() if r.taken}


def test_pipeline_rows_without_own_key(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join(w), "en", "a", None) for k, w in ((None, words[:40]), (None, words[:40]), (9, words[20:]), (9, words[20:]), (9, words[20:] + ["more"]), (8, words[::-1]), (None, words[::-1] + ["x"]))]
    docs = spark.createDataFrame(rows, DOCS)
    exact = corpus_pipeline.drop_exact_copies(spark, docs, "")
    assert exact.columns == docs.columns and Counter((r.doc_id, r.text) for r in exact.collect()) == Counter({(k, t): 1 for k, t, *_ in rows})
    near = corpus_pipeline.drop_near_copies(spark, exact, "")
    assert near.columns == docs.columns
    left = Counter((r.doc_id, len(r.text.split())) for r in near.collect())
    assert left in (Counter({(None, 40): 1, (9, 40): 1, (8, 60): 1}), Counter({(None, 40): 1, (9, 41): 1, (8, 60): 1}))


def test_pipeline_clashing_columns(spark, rows):
    """Columns named like those that stages make pass through unchanged, as do all stages over no rows."""
    names = ["predicted", "score", "gone_row", "text_sha256", "component_id", "size", "taken", "first_word", "mixed", "share", "whole", "pipeline_row", "linked_row", "keep_id", "key", "row", "set_id", "carried_0", "group"]
    plain = spark.createDataFrame(rows, DOCS)
    more = spark.createDataFrame([(*r, *[r[0]] * len(names)) for r in rows], DOCS + "".join(f", {c} long" for c in names))
    labels = spark.createDataFrame([(r[0], 1, r[0] % 2) for r in rows[:300]], "doc_id long, quality int, toxic int")
    read, corpus_pipeline.tables = corpus_pipeline.tables, lambda *_: labels
    try:
        for _, stage in corpus_pipeline.STAGES:
            found = stage(spark, more, "")
            kept = Counter((r.doc_id, r.text if "text" in r else None) for r in stage(spark, plain, "").collect())
            assert Counter((r.doc_id, r.text if "text" in r else None) for r in found.collect()) == kept
            if stage is not corpus_pipeline.pack:
                assert found.columns == more.columns and all(r[c] == r.doc_id for r in found.collect() for c in names)
            assert stage(spark, more.limit(0), "").count() == 0
    finally:
        corpus_pipeline.tables = read


def test_lm_contexts_reach_the_word_before(spark):
    """Words that are equally frequent but follow others in a fixed order: what follows as ever is likelier than the same words in disorder."""
    rng = random.Random(5)
    nexts = dict(zip(WORDS, rng.sample(WORDS, len(WORDS))))

    def chain(n=40):
        out = [rng.choice(WORDS)]
        while len(out) < n:
            out.append(nexts[out[-1]])
        return out

    held = [i for i in range(1000, 1200) if zlib.crc32(str(i).encode()) % 7 == 2][:20]
    taught = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 != 2]
    texts = {i: chain() for i in taught + held[:10]}
    for a, b in zip(held[:10], held[10:]):
        texts[b] = rng.sample(texts[a], len(texts[a]))
    found = {r.doc_id: r for r in lm_score(spark.createDataFrame([(i, " ".join(t), "en", "a", None) for i, t in texts.items()], DOCS)).collect()}
    for a, b in zip(held[:10], held[10:]):
        assert math.isclose(found[a].base_score, found[b].base_score) and found[a].score > found[b].score + 10 and found[a].score > found[a].base_score


def test_lm_spelling_reads_the_word_before():
    """Slots of short contexts differ by the word before at a word's first bytes only; those of the spelling alone never do."""
    bits, of, slots = lm_score_model.spelled([b"aa word", b"ba word", b"ab word"], np.zeros(3, np.int64))
    a, b, c = (slice(*np.searchsorted(of, [i, i + 1])) for i in range(3))
    two, _, five, whole, both = slots
    assert (bits[a] == bits[b]).all() and (bits[a] == bits[c]).all() and (whole[a] == whole[b]).all() and (whole[a] == whole[c]).all()
    assert (two[a] == two[b]).all() and (two[a] != two[c])[:5].all() and (two[a] == two[c])[10:].all()
    assert (five[a] != five[b])[:5].all() and (five[a] == five[b])[15:].all() and (both[a] != both[b]).all()


def test_lm_tables_are_sent_in_packed_blocks(spark):
    """Blocks of several tasks add up to the counts of all pairs, large ones too, and no more rows are sent than blocks and tasks, however many slots are met."""
    rng = random.Random(8)
    pairs = sorted({rng.choice(WORDS + ["été"]).encode() + b" " + bytes(rng.choices(b"abcdefgh", k=6)) for _ in range(2000)})
    counts = [[rng.choice([0, 1, 3, 70000]), rng.choice([0, 2])] for _ in pairs]
    tables = [np.zeros(2 << width, np.uint32) for _, width in lm_score_model.PREDICTORS]
    lm_score_model.count_bits(*lm_score_model._seen(pairs, np.array(counts)), tables)
    dictionary = spark.createDataFrame(list(zip(map(bytearray, pairs), counts)), "pair binary, counts array<long>").repartition(3)
    blocks = lm_score_model._tables(dictionary)
    assert len(blocks) <= sum(map(len, tables)) // lm_score_model.BLOCK and all((a == b.astype(np.float32)).all() for a, b in zip(lm_score_model._filled(blocks), tables))
    assert sum(map(len, blocks.values())) < sum(np.count_nonzero(t) for t in tables) * 8
