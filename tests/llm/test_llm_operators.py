"""The training-data operators against brute force on small inputs."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from tracejobs.llm import embed_dedup, exact_dedup, html_extract, license_scan, mixing, ngram_join, packing, warc

DOCS = "doc_id long, text string, source string, lang string, key string"


@pytest.fixture(scope="module")
def docs(spark):
    base = " ".join(f"w{i % 37}x{i}" for i in range(120))
    texts = [base, base, base.replace("w5x5 ", "other "), "A b\tc", "a  b c", "", None, " \n ", "one two", "word " * 5000]
    return spark.createDataFrame([(i, t, "s" if i % 3 else None, None, "clash") for i, t in enumerate(texts)], DOCS)


def test_exact_dedup(docs):
    found = {r.doc_id: r for r in exact_dedup.exact_dedup(docs).collect()}
    assert len(found) == 10 and found[1].keep_id == 0 and not found[1].kept and found[0].group_size == 2
    assert found[5].group_size == 2 and found[6].keep_id == 5 and found[7].text_sha256 == hashlib.sha256(b" ").hexdigest()


def test_exact_dedup_keeps_one(spark):
    rows = [(None, "two"), (None, "two"), (None, "mixed"), (5, "mixed"), (4, "mixed"), (7, "again"), (7, "again "), (7, "again"), (None, "single")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for k in (3, 1024):
        found = exact_dedup.exact_dedup(frame, k=k).collect()
        assert len(found) == len(rows) and len({r.text_sha256 for r in found}) == 5
        assert Counter(r.text_sha256 for r in found if r.kept) == Counter({r.text_sha256: 1 for r in found})
        assert all(r.doc_id == r.keep_id for r in found if r.kept)


def test_misra_gries():
    values = ["a"] * 40 + [str(i) for i in range(60)]
    assert "a" in exact_dedup.misra_gries(Counter(values), 2)


def test_ngram_join(docs):
    found = {r.doc_id: r for r in ngram_join.ngram_join(docs, n=3, num=80, den=100).collect()}
    assert [found[i].component_id for i in range(10)] == [0, 0, 0, 3, 3, 5, 6, 7, 8, 9]
    assert found[0].n_links == 2 and found[5].n_shingles == 0 and found[8].n_shingles == 1 and found[9].n_shingles == 1


def test_mix(docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == 10 and all(0 <= r.taken <= 3 * r.size for r in rows)
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.mix(docs.repartition(3)).collect()), key=repr)


def test_packing(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_file())
    pieces = packing.pack_documents(docs, with_ids=True).toPandas()
    for r in docs.collect():
        own = pieces[pieces.doc_id == r.doc_id].sort_values("start")
        assert np.frombuffer(b"".join(own.ids), "<u4").tolist() == tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2]
    total = pieces.groupby("sequence_id").length.sum()
    assert all(n == 4096 or n & (n - 1) == 0 for n in total)


def test_embed_dedup(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.05], 0), (3, [1.0, 0.0], 0), (4, [1.0, 0.0], 1), (5, [0.0, 0.0], 0), (6, None, 0), (7, [float("nan"), 1.0], 0), (8, [1.0, 0.0], None)]
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.embed_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert found == {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False), **{i: (0, i, True) for i in (4, 5, 6, 7, 8)}}


def test_embed_dedup_chains(spark, monkeypatch):
    """Chains of links whose middle may have the largest id, within a cell, across cells and across blocks."""
    rng = np.random.default_rng(5)
    rows = [(1, [1.0, 0.0], 0), (2, [float(np.cos(np.pi / 9)), float(np.sin(np.pi / 9))], 0), (3, [float(np.cos(np.pi / 18)), float(np.sin(np.pi / 18))], 0)]
    ids = rng.permutation(np.arange(10, 130)).tolist()
    for family in range(12):  # ten vectors 8 to 13 degrees apart: most neighbours link, no others
        turn = np.cumsum(rng.uniform(8, 13, 10)) * np.pi / 180
        rows += [(ids.pop(), [float(np.cos(t)), float(np.sin(t))], 1 + family % 4) for t in turn]
    keys, units = [r[0] for r in rows], np.array([r[1] for r in rows])
    same = np.array([r[2] for r in rows])
    linked = (units @ units.T >= 0.98) & (same[:, None] == same) & ~np.eye(len(rows), dtype=bool)
    low = np.array(keys)
    for _ in rows:
        low = np.minimum(low, np.where(linked, low, 1 << 40).min(axis=1))
    expected = {k: (int(n), int(c), bool(k == c)) for k, n, c in zip(keys, linked.sum(axis=1), low)}
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for cell, block in ((2_000, 2_048), (30, 10)):
        monkeypatch.setattr(embed_dedup, "CELL", cell)
        monkeypatch.setattr(embed_dedup, "BLOCK", block)
        assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.embed_dedup(frame).collect()} == expected


def test_warc(spark):
    rows = [(1, "http://a/\n", "é" * 600), (2, None, "é" * 600), (3, "u", None), (4, "u", "x" * 700_000)]
    found = {r.page_id: r for r in warc.warc_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[1].record_type == "revisit" and found[1].refers_to == 2 and found[1].payload_bytes == 1200
    assert found[4].payload_digest == hashlib.sha1(b"x" * 700_000).hexdigest() and found[3].payload_bytes == 0


def test_html(spark):
    page = "<body><nav>Menu</nav><p>Same line</p><p>%s &eacute;</p><div class='ad'>Buy</div></body>"
    rows = [(1, "http://a/x/1", page % "one"), (2, "http://a/x/2", page % "two"), (3, "http://b/", "<article><h1>T</h1><p>a<p>b</article><footer>f</footer>"), (4, None, None)]
    found = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()}
    assert found[3] == "T\n\na\n\nb" and found[4] == "" and found[1].endswith("one é")


@pytest.mark.parametrize("page", [
    "<div class='layout has-sidebar'><article><p>Body</p></article></div>",
    "<div class='content no-sidebar'><main><p>Body</p></main></div>",
    "<div class='post comments-open'><article><p>Body</p></article></div>",
    "<form id='aspnetForm'><nav>Menu</nav><article><p>Body</p></article><div class='related'><article>T</article></div></form>",
    "<form id='aspnetForm'><nav>Menu</nav><p>Body</p></form>",
    "<div class='sidebar'><article><p>Body</p></article></div>",
    "<aside><main><p>Body</p></main></aside>",
    "<article><p>Body</p><div class='ad'>A longer advert</div><form>Send</form></article><div id='comments'><article>Me too</article></div>",
    "<article><div class='related-work social-policy'>Body</div><div class='related-posts'>More</div></article>",
])
def test_html_layout(page):
    lines, has_main = html_extract.lines_of(f"<html><body class='x'>{page}</body></html>")
    assert [t for t, main, furniture in lines if not furniture and (main or not has_main)] == ["Body"]
    assert has_main == ("<article" in page or "<main" in page)


def test_license(spark):
    rows = [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c.txt", "text"), (3, "d.txt", None), (4, None, "Licensed under the Apache License, Version 2.0.")]
    found = {r.doc_id: (r.licence, r.origin) for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert found == {1: ("MIT", "own"), 2: ("MIT", "inherited"), 3: (None, "none"), 4: ("Apache-2.0", "own")}


def test_warc_repeated_ids(spark):
    """Records that share an id are told apart by their payloads; empty tables are written and read too."""
    rows = [(1, "u", "a" * 1500, 9), (1, "u", "b" * 2500, 9), (0, "u", "a" * 1500, 9), (0, None, "b" * 2500, 9), (None, "u", "a" * 1500, 9), (None, "u", "c" * 3000, 9), (2, "u", "short", 9), (3, "u", "short", 9)]
    kind = "page_id long, url string, html string, payload_bytes long"
    found = warc.warc_round_trip(spark.createDataFrame(rows, kind)).collect()
    digest = lambda x: hashlib.sha1(x.encode()).hexdigest()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == Counter(
        (k, len(x), digest(x), *(("revisit", 1) if x[0] in "ab" and k != 1 else ("response", None))) for k, _, x, _ in rows
    )
    assert warc.warc_round_trip(spark.createDataFrame([], kind)).count() == 0


def test_embed_dedup_scales_and_lengths(spark, monkeypatch):
    """Vectors of several lengths, and very large and small ones, against all pairs; more columns of clashing names."""
    rng = np.random.default_rng(2)
    rows = [(1, [1e-200, 0.0], 0), (2, [1e-200, 1e-203], 0), (3, [1.0, 0.0], 0), (4, [1.0, 0.01], 0), (5, [1e300, 1e298], 0), (6, [1.0, 0.0, 0.0], 0), (7, [1.0, 0.01, 0.0], 0), (8, [], 0), (9, [1.0, float("inf")], 0), (10, [1.0, None], 0)]
    for _ in range(40):
        base, width = rng.normal(size=16), int(rng.choice([4, 16]))
        rows += [(100 + len(rows) + i, (base + 0.1 * rng.normal(size=16))[:width].tolist(), int(rng.integers(2))) for i in range(5)]
    frame = spark.createDataFrame([(*r, 7, 7) for r in rows], "vec_id long, embedding array<double>, label int, cell int, rep long")
    good = {k: (np.array(v) / max(map(abs, v)), y) for k, v, y in rows if k not in (8, 9, 10)}
    linked = {k: [o for o, (u, z) in good.items() if o != k and k in good and good[k][1] == z and len(u) == len(good[k][0]) and u @ good[k][0] / np.sqrt(u @ u) / np.sqrt(good[k][0] @ good[k][0]) >= 0.98] for k, _, _ in rows}
    low = {k: k for k in linked}
    for _ in rows:
        low = {k: min([low[k]] + [low[o] for o in linked[k]]) for k in low}
    for cell, block in ((2_000, 2_048), (20, 8)):
        monkeypatch.setattr(embed_dedup, "CELL", cell)
        monkeypatch.setattr(embed_dedup, "BLOCK", block)
        found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.embed_dedup(frame).collect()}
        assert found == {k: (len(linked[k]), low[k], k == low[k]) for k in linked}
    assert embed_dedup.embed_dedup(frame.limit(0)).count() == 0


def test_tokens_of_hostile_words():
    """Ids word by word are those of the whole text."""
    words = packing.Words(packing.tokenizer_file())
    texts = ["\u00c9COLE, \u00e9cole. a,b ..., \u00df. \u0131 \u0130x, \ufb01n. x\u0302y, \u1e8d \u6f22\u5b57, \u6f22. word,. A.B, \u01c5, \u02b0a, \u00aa. \u0661\u0662, \u2167, ", "a\u0301, \u0301. ,a .b a***b*** don't can't, x's", "x" * 300 + ", " + "\u00e9" * 200 + "!?.", "\x1f a\u00a0b\u2003c \u0000", None, "", "under_score a-b, 3.14, $5."]
    for text in texts + [" ".join(t or "" for t in texts)]:
        assert words.encode([text])[0].tolist() == words.tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
