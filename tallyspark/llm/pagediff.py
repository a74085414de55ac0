"""Main text of HTML pages by structure and nearest-URL page differencing.

Pages are laid out in order of host and path, so that a page's nearest relatives stand next to it. Each
page is cut into text blocks; of the pages before and after it on the same host, the one that shares more of its path
is its pair. The block lists of both are aligned by longest common subsequence, and blocks that both have, the
site's furniture, are deleted. Two things are kept from differencing: running text of an ``article`` or
``main`` element, and pages that are copies of each other (COPY of their text shared), which would
otherwise lose everything. What HTML itself marks as not main text goes by its mark, but no mark takes away a ``main``,
nor an ``article`` of a page that has neither outside of marks (comments aside): such a mark is ignored.

Defined results: a null or empty html, or one without main text, gives ""; a null url counts as "";
a host's only page is not differenced; repeated pages are copies; broken markup is read as far as it goes; of two
neighbours that share as much path, the one before is the pair; pages of one URL stand in order of a hash of their content.
A page of any length is read whole, and a task holds three. An empty table gives an empty result; columns of other names
are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import lay_out_in_order

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements that close an open paragraph are all blocks; these keep end tags of what is outside from closing them.
WALLS = frozenset("article main body html".split())
DROPPED = frozenset("head title nav footer aside form script style noscript template iframe object svg math canvas button select textarea dialog menu search".split())
#: What is dropped whatever it holds.
UNSEEN = frozenset("head title script style noscript template iframe object svg math canvas button select textarea".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Class or id names that mark what is not main text: a name is a mark if it has one of these words and else only PLACES.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist comentarios kommentare commentaires respond replies reply disqus "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login menu nav navbar navigation pager pagination promo promotion related recommended "
    "share sharing social sidebar sidebars side sponsor sponsored toolbar widget widgets footer masthead skip".split()
)
PLACES = frozenset("area bar block body bottom box button buttons entry form global icon icons item items left link links list main page panel post primary right secondary section site slot top unit".split())
COMMENTS = frozenset("comment comments reply replies respond".split())
COPY = 0.8
#: Share of a block's text in links from which it counts as a list of links.
LINKS = 0.5

Block = tuple[str, bool, bool]  # text, in the main part, mostly links


def marks_of(attrs: list[tuple[str, str | None]]) -> set[str]:
    found: set[str] = set()
    for name in " ".join(v or "" for k, v in attrs if k in ("class", "id")).split():
        words = set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()))
        if words <= MARKS | PLACES:
            found |= words & MARKS
    return found


class BlockReader(HTMLParser):
    """Text blocks of a page, in order, without what is marked as not main text."""

    def __init__(self, ignored: frozenset[int] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple] = []  # tag, dropped, main, in a header, marked elements around (number, of comments), None if unseen
        self.ignored, self.number = ignored, 0
        self.plain, self.around_main, self.around_article = False, set(), set()
        self.blocks: list[Block] = []
        self.words: list[str] = []
        self.linked = 0
        self.links = 0

    def state(self) -> tuple:
        return self.open[-1][1:] if self.open else (False, False, False, ())

    def wrongly_marked(self) -> frozenset[int]:
        """Numbers of the marked elements that hold the page's main part."""
        return frozenset(self.around_main if self.plain or self.around_main else self.around_article)

    def flush(self) -> None:
        text = "".join(self.words)
        short = " ".join(text.split())
        if short:
            self.blocks.append((short, self.state()[1], self.linked >= LINKS * len(text)))
        self.words, self.linked = [], 0

    def drop_to(self, i: int) -> None:
        self.flush()
        self.links -= sum(x[0] == "a" for x in self.open[i:])
        del self.open[i:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.flush()
            if tag == "body":
                self.open = [x for x in self.open if x[0] == "html"]
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] == "p":
                    self.drop_to(i)
                    break
                if self.open[i][0] in BLOCKS:
                    break
        elif tag == "br":
            self.words.append(" ")
        if tag in VOID:
            return
        self.number += 1
        dropped, main, header, marks = self.state()
        given = dict(attrs)
        names = marks_of(attrs)
        here = tag in ("article", "main") or given.get("role") in ("main", "article")
        if tag in UNSEEN or "hidden" in given or re.search(r"display\s*:\s*none", given.get("style") or "") or (here and names & COMMENTS):
            dropped, marks = True, None
        elif self.number not in self.ignored and (tag in DROPPED or given.get("role") in ROLES or (tag == "header" and not main) or (not here and tag not in ("html", "body") and names & MARKS)):
            dropped, marks = True, None if marks is None else (*marks, (self.number, bool(names & COMMENTS)))
        if here and marks is not None:
            self.plain |= not marks
            if tag == "main" or given.get("role") == "main":
                self.around_main.update(n for n, _ in marks)
            elif not any(of_comments for _, of_comments in marks):
                self.around_article.update(n for n, _ in marks)
        if tag == "header" and main:
            header = True
        self.open.append((tag, dropped, main or here, header and tag not in HEADINGS, marks))
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                if tag in BLOCKS or any(x[0] in BLOCKS for x in self.open[i:]):
                    self.drop_to(i)
                else:
                    self.links -= sum(x[0] == "a" for x in self.open[i:])
                    del self.open[i:]
                return
            if self.open[i][0] in WALLS and tag not in WALLS:
                return

    def handle_data(self, data: str) -> None:
        dropped, _, header, _ = self.state()
        if not dropped and not header:
            self.words.append(data)
            self.linked += len(data) if self.links else 0

    def close(self) -> None:
        super().close()
        self.flush()


def read_blocks(html: str | None) -> list[Block]:
    reader = BlockReader()
    reader.feed(html or "")
    reader.close()
    if wrong := reader.wrongly_marked():
        reader = BlockReader(wrong)
        reader.feed(html or "")
        reader.close()
    return reader.blocks


def common_blocks(a: list[str], b: list[str]) -> set[int]:
    """Places in ``a`` of a longest common subsequence of both, by bit-parallel rows: a row is one integer of len(b) bits."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    found = set(range(start)) | set(range(len(a) - end, len(a)))
    mid_a, mid_b = a[start : len(a) - end], b[start : len(b) - end]
    if not mid_a or not mid_b:
        return found
    places: dict[str, int] = {}
    for j, x in enumerate(mid_b):
        places[x] = places.get(x, 0) | (1 << j)
    full = (1 << len(mid_b)) - 1
    rows, v = [], full
    for x in mid_a:
        u = v & places.get(x, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    # a zero bit at j in row i means that the subsequence grows at j when the first i + 1 blocks of a are used
    i, j = len(mid_a) - 1, len(mid_b) - 1
    while i >= 0 and j >= 0:
        while j >= 0 and rows[i] >> j & 1:
            j -= 1
        if j < 0:
            break
        if i and not rows[i - 1] >> j & 1:
            i -= 1
            continue
        found.add(start + i)
        i -= 1
        j -= 1
    return found


def main_text(blocks: list[Block], pair: list[Block] | None) -> str:
    """Text of a page, given the blocks of its pair."""
    marked = any(main for _, main, _ in blocks)
    shared: set[int] = set()
    if pair:
        shared = common_blocks([t for t, _, _ in blocks], [t for t, _, _ in pair])
        if sum(len(blocks[i][0]) for i in shared) >= COPY * sum(len(t) for t, _, _ in blocks):
            shared = set()
    keep = [t for i, (t, main, links) in enumerate(blocks) if (main or not marked) and not (i in shared and (links or not main))]
    return " ".join(keep)


def address(url: str | None) -> tuple[str, list[str]]:
    """Host and path segments of a URL."""
    try:
        parts = urlsplit(url or "")
    except ValueError:
        return url or "", []
    return parts.netloc.lower(), [x for x in parts.path.split("/") if x]


def shared_segments(a: list[str], b: list[str]) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page. One range shuffle in order of host and of the path's segments, so that pages
    below one segment are neighbours; a task holds three pages."""
    id_type = pages.schema["page_id"].dataType.simpleString()
    url = F.coalesce(F.col("url"), F.lit(""))
    host = F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(url, "^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    rows = pages.select(F.concat_ws("\x01", host, F.translate(path, "/", "\x01")).alias("__key"), F.col("page_id").alias("__page"), F.col("url").alias("__url"), F.col("html").alias("__html"))
    laid = lay_out_in_order(rows, "__key", ["__page", "__url", "__html"], both_sides=True)
    names = ["page_id", "url", "text", "n_chars"]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for part, ghost, _, page, url, html in zip(*(batch.column(i) for i in range(6))):
                yield part.as_py(), ghost.as_py(), page, url.as_py(), html.as_py()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def relation(a, b) -> int:
            if a is None or b is None or a["part"] != b["part"] or a["host"] != b["host"]:
                return -1
            return shared_segments(a["path"], b["path"])

        def flushed(rows: list[tuple]) -> pa.RecordBatch:
            ids, urls, texts = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array([x.as_py() for x in ids], batch_type[0]), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=names)

        def settle(before, now, after) -> None:
            if now is None or now["ghost"]:
                return
            near, far = relation(before, now), relation(now, after)
            pair = before if near >= 0 and near >= far else after if far >= 0 else None
            out.append((now["id"], now["url"], main_text(now["blocks"], pair and pair["blocks"])))

        out: list[tuple] = []
        batch_type: list[pa.DataType] = [pa.int64()]
        before = now = None
        size = 0
        for part, ghost, page, url, html in stream(batches):
            batch_type[0] = page.type
            host, path = address(url)
            after = {"part": part, "ghost": ghost, "id": page, "url": url, "host": host, "path": path, "blocks": read_blocks(html)}
            settle(before, now, after)
            before, now = now, after
            size += len(html or "")
            if out and size > 4_000_000:
                yield flushed(out)
                out, size = [], 0
        settle(before, now, None)
        if out:
            yield flushed(out)

    return laid.mapInArrow(run, f"page_id {id_type}, url string, text string, n_chars bigint")
