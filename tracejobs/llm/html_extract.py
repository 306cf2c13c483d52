"""Main text of web pages by nearest-URL page differencing.

Pages are sorted by host and path; each is aligned with its nearest neighbour of the host by a longest common
subsequence of text lines, and the lines that both share are deleted as furniture. A neighbour that is a copy
tells nothing about furniture and is passed over for the next one. What is left is checked against what pages
mark up themselves: lines within an article or main element, the page's own or the neighbour's, come back
although both pages have them, all outside the page's own goes, and so does what tags, roles, classes or ids
call a menu, header, footer, sidebar, notice, advert, form or comment, shared or not. A form or named element
around the article or most of the text is layout and drops nothing.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import groupby, islice

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracejobs.llm.common import BATCH_BYTES

#: Runs of pages before and after a page among which its neighbour is sought.
NEAR = 2
#: Pages of a bucket, more if that makes over four buckets for each shuffle partition.
BUCKET_PAGES = 1000

# Element, role and class names of HTML.
UNSEEN = {"head", "script", "style", "noscript", "template", "iframe", "object", "svg", "math", "canvas", "audio", "video", "select", "textarea", "button", "datalist"}
FURNITURE = {"nav", "header", "footer", "aside", "form", "dialog", "menu"}
MAIN = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre",
    "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"}
_NAMES = (
    "ads?|adverts?|advertisement|sponsor(?:ed)?|promo|banner|sidebar|side-bar|cookies?|consent|notice|alert|popup|modal|newsletter|subscribe|signup"
    "|comments?|disqus|replies|share|social|related|breadcrumbs?|pagination|pager|menu|nav|navbar|navigation|footer|masthead|site-header|skip-link"
)
_PLACES = "site|main|top|bottom|slot|unit|box|bar|block|list|section|area|widget|container|wrapper|links?|icons|buttons?|posts|articles|message"
#: A whole class or id: names of furniture, and words for their place or form; any other word makes it another thing (has-sidebar, related-work).
NAMED = re.compile(rf"(?<!\S)(?:(?:{_PLACES})[_-])*(?:{_NAMES})(?:[_-](?:{_NAMES}|{_PLACES}))*(?!\S)", re.IGNORECASE)
#: These are no layout, however much text they hold.
NEVER_LAYOUT = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|sponsor(?:ed)?|comments?|disqus|replies)(?:$|[\s_-])", re.IGNORECASE)


class _Box:
    """An element that is furniture by its tag, role or name."""

    def __init__(self, soft: bool, form: bool, hidden: bool, in_main: bool):
        self.soft, self.form, self.hidden, self.in_main, self.size = soft, form, hidden, in_main, 0


class _Lines(HTMLParser):
    """Collects (text, in main, boxes of furniture around) for each block of text, and the boxes around each article or main element."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, tuple[_Box, ...], bool]] = [("", False, (), False)]  # tag, main, furniture, unseen
        self.text: list[str] = []
        self.lines: list[tuple[str, bool, tuple[_Box, ...]]] = []
        self.mains: list[tuple[_Box, ...]] = []

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, self.open[-1][1], self.open[-1][2]))
            for box in self.open[-1][2]:
                box.size += len(text)
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.flush()
            if self.open[-1][0] == "p" or tag in ("p", "li", "td", "tr", "dd", "dt") and any(x[0] == tag for x in self.open[-3:]):
                self.close_to("p" if self.open[-1][0] == "p" else tag, self.open[-3:])
        elif tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        _, main, furniture, unseen = self.open[-1]
        about = dict(attrs)
        names = f"{about.get('class') or ''} {about.get('id') or ''}"
        role = (about.get("role") or "").lower()
        begins = tag in MAIN or role in MAIN
        if begins and not main:
            if "main" in (tag, role):  # a page's one main part is no furniture, whatever is around it
                furniture = tuple(x for x in furniture if x.hidden)
            self.mains.append(furniture)
        form = tag == "form" or role == "form"
        named = tag not in ("html", "body") and not begins and bool(NAMED.search(names))
        fixed = tag in FURNITURE - {"form"} and not (main and tag == "header") or role in ROLES - {"form"} or "hidden" in about
        if fixed or form or named:
            furniture += (_Box(not fixed and not (named and NEVER_LAYOUT.search(names)), form, "hidden" in about, main),)
        self.open.append((tag, main or begins, furniture, unseen or tag in UNSEEN))

    def layout(self) -> tuple[set[_Box], bool]:
        """(the forms and named boxes that are layout, whether the page marks a main part).

        Layout are those that hold most of the page's text, inside a main part forms alone, and, if no article or
        main is free of furniture, those around an article, the largest first, until one is.
        """
        total = sum(len(t) for t, _, _ in self.lines)
        around = {x for _, _, boxes in self.lines for x in boxes}
        layout = {x for x in around if x.soft and 2 * x.size > total and (x.form or not x.in_main)}
        is_free = lambda: any(layout.issuperset(boxes) for boxes in self.mains)
        free = is_free()
        for box in sorted(dict.fromkeys(x for boxes in self.mains if all(b.soft for b in boxes) for x in boxes), key=lambda x: -x.size):
            if free:
                break
            layout.add(box)
            free = is_free()
        return layout, free

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def close_to(self, tag, within):
        for i in range(len(self.open) - 1, len(self.open) - 1 - len(within), -1):
            if i and self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.flush()
        self.close_to(tag, self.open[1:])

    def handle_data(self, data):
        if not self.open[-1][3]:
            self.text.append(data)


def lines_of(html: str | None) -> tuple[list[tuple[str, bool, bool]], bool]:
    """The page's (text, in main, furniture) lines, and whether it marks a main part."""
    parser = _Lines()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    layout, has_main = parser.layout()
    return [(text, main, not layout.issuperset(boxes)) for text, main, boxes in parser.lines], has_main


def shared(a: list[int], b: list[int]) -> dict[int, int]:
    """{place in a: place in b} of a longest common subsequence.

    A row of the lengths' table is one whole number, a bit for each place in b (Hyyro). Only every so manieth row is
    kept; the others are made again on the way back.
    """
    lead = 0
    while lead < min(len(a), len(b)) and a[lead] == b[lead]:
        lead += 1
    tail = 0
    while tail < min(len(a), len(b)) - lead and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    found = {i: i for i in range(lead)} | {len(a) - 1 - i: len(b) - 1 - i for i in range(tail)}
    a, b = a[lead : len(a) - tail], b[lead : len(b) - tail]
    at: dict[int, int] = dict.fromkeys(a, 0)
    places: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        if x in at:
            places.setdefault(x, []).append(j)
    for x, js in places.items():
        bits = bytearray(len(b) // 8 + 1)
        for j in js:
            bits[j >> 3] |= 1 << (j & 7)
        at[x] = int.from_bytes(bits, "little")
    full = (1 << len(b)) - 1

    def rows(row: int, first: int, last: int) -> list[int]:
        out = [row]
        for x in a[first:last]:
            both = row & at[x]
            row = ((row + both) | (row - both)) & full
            out.append(row)
        return out

    step = int(len(a) ** 0.5) + 1
    kept = [full]
    for first in range(0, len(a), step):
        kept.append(rows(kept[-1], first, first + step)[-1])
    i, j, block, first = len(a), len(b), [], len(a)
    while i and j:
        if i - 1 < first:  # the rows before and after line i - 1
            first = (i - 1) // step * step
            block = rows(kept[first // step], first, first + step)
        if block[i - first] >> (j - 1) & 1:
            j -= 1
        elif block[i - 1 - first] >> (j - 1) & 1:
            i, j = i - 1, j - 1
            found[lead + i] = lead + j
        else:
            i -= 1
    return found


def kinship(a: str, b: str) -> int:
    """How many letters two paths share at their start."""
    n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return n


class _Page:
    """A page of the sorted stream: its lines, their digests, and whether it marks a main part. A copy shares them with the page before."""

    def __init__(self, row: tuple, before: _Page | None):
        self.bucket, self.host, self.path, self.key, self.url, self.content, self.ghost, self.html = row
        if before and self.content == before.content and self.html == before.html:
            self.lines, self.has_main, self.digests, self.size = before.lines, before.has_main, before.digests, before.size
            self.html = before.html
            return
        self.lines, self.has_main = lines_of(self.html)
        self.digests = [xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t, _, _ in self.lines]
        self.size = sum(len(t) for t, _, _ in self.lines)


def is_copy(a: _Page, b: _Page, both: dict[int, int]) -> bool:
    """Whether a tenth of the letters or less is left of either page without the shared lines."""
    same = sum(len(a.lines[i][0]) for i in both)
    return 10 * (a.size - same) <= a.size or 10 * (b.size - same) <= b.size


def decide(page: _Page, before: list[_Page], after: list[_Page]) -> str:
    """The page's text; before and after: its neighbours of the host, the nearest first."""
    near = [(-kinship(x.path, page.path), n, side, x) for side, xs in enumerate((before, after)) for n, x in enumerate(xs)]
    gone: set[int] = set()
    for *_, other in sorted(near, key=lambda x: x[:3]):
        both = shared(page.digests, other.digests)
        if not is_copy(page, other, both):
            gone = {i for i, j in both.items() if not (page.has_main and page.lines[i][1] or other.has_main and other.lines[j][1] and not other.lines[j][2])}
            break
    return "\n\n".join(t for i, (t, main, furniture) in enumerate(page.lines) if i not in gone and not furniture and (main or not page.has_main))


def differenced(pages: Iterator[_Page]) -> Iterator[tuple[_Page, str]]:
    """(page, text) of one bucket's sorted pages. Pages in a row of one host and content are a run; a page's
    neighbours are the NEAR runs before and after its own."""
    runs: deque[list[_Page]] = deque()  # of one host, with the runs before the one at ``at``
    at = 0

    def settle(n: int) -> Iterator[tuple[_Page, str]]:
        nonlocal at
        while at < len(runs) and len(runs) - at > n:
            before = [runs[i][-1] for i in range(at - 1, max(at - 1 - NEAR, -1), -1)]
            after = [runs[i][0] for i in range(at + 1, min(at + 1 + NEAR, len(runs)))]
            for page in runs[at]:
                if not page.ghost:
                    yield page, decide(page, before if page.host else [], after if page.host else [])
            runs[at] = [runs[at][0], runs[at][-1]]  # the rest is done with
            at += 1
            while at > NEAR:
                runs.popleft()
                at -= 1

    for page in pages:
        last = runs[-1][-1] if runs else None
        if last and page.host != last.host:
            yield from settle(0)
            runs.clear()
            at = 0
        elif last and page.content == last.content:
            runs[-1].append(page)
            continue
        runs.append([page])
        yield from settle(NEAR)
    yield from settle(0)


def extract(pages: DataFrame, html: str = "html", key: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: key, url, text, n_chars.

    A null or empty page has an empty text. Character references are decoded, white space in a block becomes
    one space, blocks are joined by two newlines in page order. Pages without a url or host are not aligned. A
    page is aligned with one of the NEAR pages before and after it in the order of paths within its host, that
    whose path shares more of its start, the nearer in a tie, then the one before; of pages in a row with equal
    html the nearest counts for all, and those that share all but a tenth of either's letters are passed over.
    The order is cut into buckets, to which the pages next to their edges are dealt as well, so that texts do
    not depend on the cuts. An empty table gives an empty one. Other columns of any name are ignored.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_replace(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    rows = rows.withColumns({"host": host, "path": path, "content": F.xxhash64("html")})
    order = ["host", "path", "key", "url", "content"]
    n = max(1, min(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // BUCKET_PAGES)))

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first and the last page of the first and the last NEAR + 1 runs."""
        runs: list[list[tuple]] = []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if runs and (row[0], row[4]) == (runs[-1][0][0], runs[-1][0][4]):
                    runs[-1][1] = row
                else:
                    runs.append([row, row])
                    if len(runs) > 2 * NEAR + 2:
                        del runs[NEAR + 1]
        found = list(dict.fromkeys(x for run in runs for x in run))
        at = TaskContext.get().partitionId()
        columns = [pa.array([at] * len(found), pa.int32()), *[pa.array(c, t) for c, t in zip(zip(*found) if found else [[]] * 5, (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()))]]
        yield pa.RecordBatch.from_arrays(columns, ["part", *order])

    light = rows.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order)
    # a few addresses for each bucket, the bucket's first and last among them
    found = light.mapInArrow(edges, "part int, host string, path string, key long, url string, content long").collect()
    sort_key = lambda r: tuple((x is not None, x) if x is not None else (False, 0) for x in (r["host"], r["path"], r["key"], r["url"], r["content"]))
    parts: dict[int, list] = {}
    for r in sorted(found, key=sort_key):
        parts.setdefault(r["part"], []).append(r)
    buckets = sorted(parts.values(), key=lambda rs: sort_key(rs[0]))
    kind = "struct<host:string,path:string,key:bigint,url:string,content:bigint>"
    name = F.struct(*order)

    def guests(rs: Iterator, bucket: int) -> Iterator[tuple]:
        """The first page of each of the NEAR + 1 runs that come first in rs, for the bucket."""
        for _, run in islice(groupby(rs, key=lambda r: (r["host"], r["content"])), NEAR + 1):
            first = next(run)
            yield bucket, tuple(first[c] for c in order)

    ghosts = []
    for i in range(len(buckets)):
        ghosts += guests((r for j in range(i - 1, -1, -1) for r in reversed(buckets[j])), i)
        ghosts += guests((r for j in range(i + 1, len(buckets)) for r in buckets[j]), i)
    starts = spark.createDataFrame([([tuple(rs[0][c] for c in order) for rs in buckets[1:]],)], f"starts array<{kind}>")
    cut = rows.crossJoin(F.broadcast(starts)).withColumn("bucket", F.size(F.filter("starts", lambda x: x <= name))).drop("starts")
    visits = spark.createDataFrame(ghosts, f"bucket int, page {kind}").groupBy("page").agg(F.collect_set("bucket").alias("visits"))
    same = [F.col(c).eqNullSafe(F.col("page")[c]) for c in order]
    placed = cut.join(F.broadcast(visits), same, "left")
    own = F.array(F.struct("bucket", F.lit(False).alias("ghost")))
    visit = F.transform("visits", lambda b: F.struct(b.alias("bucket"), F.lit(True).alias("ghost")))
    dealt = placed.select(*order, "html", F.explode(F.when(F.col("visits").isNull(), own).otherwise(F.concat(own, visit))).alias("to"))
    dealt = dealt.select("to.bucket", *order, "to.ghost", "html")
    sorted_pages = dealt.repartition("bucket").sortWithinPartitions("bucket", *order)

    def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string()))], ["key", "url", "text"])

        def read() -> Iterator[_Page]:
            page = None
            for batch in batches:
                for row in zip(*[c.to_pylist() for c in batch.columns]):
                    page = _Page(row, page)
                    yield page

        done, size = [], 0
        for _, of_bucket in groupby(read(), key=lambda page: page.bucket):
            for page, text in differenced(of_bucket):
                done.append((page.key, page.url, text))
                size += len(text)
                if size > BATCH_BYTES or len(done) == 1000:
                    yield out(done)
                    done, size = [], 0
        if done:
            yield out(done)

    texts = sorted_pages.mapInArrow(difference, "key long, url string, text string")
    return texts.select(F.col("key").alias(key), F.col("url").alias(url), "text", F.char_length("text").cast("long").alias("n_chars"))
