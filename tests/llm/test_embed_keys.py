"""Vectors that share a key, in one label and in several, against all pairs of rows."""

from collections import Counter

import numpy as np
import pytest

from tracejobs.llm import embed_dedup


def brute(rows):
    """Sorted (key, links, component) of rows; rows of one key that are sound reach one another."""
    sound = [i for i, (k, v, y) in enumerate(rows) if k is not None and y is not None and v and any(v)]
    unit = {i: np.array(rows[i][1]) / np.linalg.norm(rows[i][1]) for i in sound}
    links = {i: [j for j in sound if j != i and rows[j][2] == rows[i][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98] for i in sound}
    low = {i: rows[i][0] for i in range(len(rows))}
    for _ in rows:
        for i in sound:
            low[i] = min([low[i], *(low[j] for j in links[i]), *(low[j] for j in sound if rows[j][0] == rows[i][0])])
    return Counter((rows[i][0], len(links.get(i, [])), low[i]) for i in range(len(rows)))


@pytest.mark.parametrize("cell,block", [(2_000, 2_048), (10, 4)])
def test_repeated_keys(spark, monkeypatch, cell, block):
    monkeypatch.setattr(embed_dedup, "CELL", cell)
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    rows = [(5, [1.0, 0.0, 0.0], 0), (5, [0.0, 1.0, 0.0], 0), (6, [0.0, 1.0, 0.01], 0), (7, [1.0, 0.01, 0.0], 0)]
    rows += [(9, [1.0, 0.0, 0.0], 1), (9, [0.0, 1.0, 0.0], 2), (10, [1.0, 0.01, 0.0], 1), (11, [0.0, 1.0, 0.01], 2), (12, [0.0, 1.0, 0.02], 2), (13, [0.0, 0.0, 1.0], 2), (13, [0.0, 0.0, 1.0], 2), (None, [0.0, 0.0, 1.0], 2), (14, [0.0, 0.0, 0.0], 2)]
    rng = np.random.default_rng(6)
    for i in range(60):
        turn = rng.uniform(0, 6.3)
        rows.append((int(rng.integers(20, 50)), [float(np.cos(turn)), float(np.sin(turn))], int(rng.integers(3))))
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, first long, component long").repartition(3)
    got = embed_dedup.embed_dedup(df).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == brute(rows)
    assert {(r.n_links, r.component_id) for r in got if r.vec_id == 7} == {(1, 5)}
