"""Page differencing at any partitioning, with copies, long pages and marked pages."""

import random
import time

import pytest

from tracejobs.llm import html_extract

KIND = "page_id long, url string, html string"


def lcs(a, b):
    """The length by the plain table."""
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


def test_shared_is_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ([rng.randrange(rng.choice([1, 3, 9])) for _ in range(rng.randrange(14))] for _ in "ab")
        found = sorted(html_extract.shared(a, b).items())
        assert len(found) == lcs(a, b) and all(a[i] == b[j] for i, j in found)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:]))


def test_many_equal_lines():
    start = time.monotonic()
    assert len(html_extract.shared([1] + [0] * 20_000 + [2], [3] + [0] * 15_000 + [4])) == 15_000
    assert time.monotonic() - start < 20


def texts(spark, rows):
    found = html_extract.extract(spark.createDataFrame(rows, KIND)).collect()
    assert len(found) == len(rows)
    return {r.page_id: r.text for r in found}


@pytest.mark.parametrize("parts, pages", [("1", 1000), ("4", 2), ("12", 1)])
def test_any_partitioning(spark, monkeypatch, parts, pages):
    """Pages of one host share their first and last line, however the order is cut; a run of copies is longer than a bucket."""
    monkeypatch.setattr(html_extract, "BUCKET_PAGES", pages)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    page = "<p>Top of all pages</p><p>body %s of its own</p><p>End of all pages</p>"
    rows = [(i, f"http://a/{i:02d}", page % i) for i in range(12)] + [(20 + i, f"http://a/05?copy={i:02d}", page % 5) for i in range(9)]
    rows += [(40, "http://b/1", page % "b"), (41, None, page % "none"), (None, None, None)]
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        found = texts(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    whole = lambda x: "\n\n".join(["Top of all pages", f"body {x} of its own", "End of all pages"])
    assert found == {i: f"body {i} of its own" for i in range(12)} | {20 + i: "body 5 of its own" for i in range(9)} | {40: whole("b"), 41: whole("none"), None: ""}


def test_copies_keep_their_text(spark):
    page = "<p>Menu</p><p>The whole of a story that was copied</p>"
    other = "<p>Menu</p><p>Another story, about other things</p>"
    story = "Menu\n\nThe whole of a story that was copied"
    assert texts(spark, [(1, "http://a/s", page), (2, "http://a/s?print=1", page)]) == {1: story, 2: story}
    assert texts(spark, [(1, "http://a/s", page), (2, "http://a/s?print=1", page), (3, "http://a/t", other)]) == {1: story[6:], 2: story[6:], 3: "Another story, about other things"}
    marked = f"<p>Menu</p><article>{page[11:]}</article><p>Longer text of other pages, which is no part of it</p>"
    assert texts(spark, [(1, "http://a/s", page), (2, "http://a/s?amp=1", marked)]) == {1: "Menu\n\n" + story[6:], 2: story[6:]}


def test_marked_pages_are_aligned(spark, monkeypatch):
    """Every page meets a neighbour; the lines of its article that the neighbour has too come back."""
    rows = [(i, f"http://a/{i}", f"<p>Menu</p><article><p>Summary</p><p>text {i} of its own</p></article>") for i in range(3)]
    assert texts(spark, rows) == {i: f"Summary\n\ntext {i} of its own" for i in range(3)}
    pages = [html_extract._Page((0, "a", u, k, u, k, False, h), None) for k, u, h in rows]
    calls = []
    aligned = html_extract.shared
    monkeypatch.setattr(html_extract, "shared", lambda a, b: calls.append(1) or aligned(a, b))
    assert [t for _, t in html_extract.differenced(iter(pages))] == [f"Summary\n\ntext {i} of its own" for i in range(3)] and len(calls) == 3


def test_empty_table_and_clashing_columns(spark):
    assert html_extract.extract(spark.createDataFrame([], KIND)).count() == 0
    rows = spark.createDataFrame([(1, "http://a/", "<p>x</p>", 3, 4, 5)], KIND + ", bucket int, host int, content int")
    assert [tuple(r) for r in html_extract.extract(rows).collect()] == [(1, "http://a/", "x", 1)]
