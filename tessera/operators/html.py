"""Raw pages to article records and links, with the standard library's parser inside Arrow batches.

A page is parsed in one pass; broken markup never fails a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import ship

SKIPPED = frozenset(("script", "style", "noscript", "template", "nav", "aside", "footer", "form", "iframe", "svg"))
BLOCKS = frozenset(("p", "div", "li", "h1", "h2", "h3", "h4", "td", "th", "tr", "section", "article", "br", "ul", "ol", "blockquote"))
LEAST_CHARS, MOST_WORDS = 40, 2500
EXTERNAL_VIDEO = re.compile(r"(youtube\.com|youtu\.be|vimeo\.com|dailymotion\.com)")


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.meta: dict[str, str] = {}
        self.title, self.h1, self.blocks, self.links, self.images, self.videos = "", "", [""], [], [], []
        self.skip, self.inside, self.lang = 0, "", None

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag in SKIPPED:
            self.skip += 1
        elif tag == "meta":
            name = (a.get("property") or a.get("name") or "").lower()
            if name and a.get("content"):
                self.meta.setdefault(name, a["content"].strip())
        elif tag == "html":
            self.lang = a.get("lang")
        elif tag in ("title", "h1"):
            self.inside = tag
        elif tag == "img" and a.get("src"):
            self.images.append(a["src"])
        elif tag in ("video", "source", "embed") and a.get("src"):
            self.videos.append(a["src"])
        if tag == "a" and a.get("href"):
            self.links.append(a["href"])
        if tag in BLOCKS and self.blocks[-1]:
            self.blocks.append("")

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        if tag == self.inside:
            self.inside = ""
        if tag in BLOCKS and self.blocks[-1]:
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside == "title":
            self.title += data
        elif not self.skip:
            if self.inside == "h1":
                self.h1 += data
            self.blocks[-1] += data


def parse(html: str) -> _Page:
    page = _Page()
    try:
        page.feed(html)
        page.close()
    except (AssertionError, ValueError):  # what was read so far stands
        pass
    return page


def article(html: str | None, url: str | None) -> dict:
    """Title, author, date, language, text and media of a page.

    The text is the paragraphs of ``LEAST_CHARS`` or more characters, or all text if there are fewer than two, cut after ``MOST_WORDS``.
    """
    page = parse(html or "")
    first = lambda *names: next((page.meta[n] for n in names if page.meta.get(n)), None)
    blocks = [re.sub(r"\s+", " ", b).strip() for b in page.blocks]
    long = [b for b in blocks if len(b) >= LEAST_CHARS]
    text = "\n".join(long if len(long) >= 2 else [b for b in blocks if b])
    words = list(re.finditer(r"\S+", text))
    if len(words) > MOST_WORDS:
        text = text[: words[MOST_WORDS - 1].end()]
    full = lambda items: list(dict.fromkeys(x for x in (absolute(url, i) for i in items) if x))
    videos = full(page.videos)
    return {
        "title": first("og:title", "twitter:title") or page.title.strip() or page.h1.strip() or None,
        "author": first("author", "article:author"),
        "published": first("article:published_time", "date", "pubdate"),
        "lang": page.lang,
        "text": text,
        "images": full(page.images),
        "external_videos": [v for v in videos if EXTERNAL_VIDEO.search(v)],
        "self_hosted_videos": [v for v in videos if not EXTERNAL_VIDEO.search(v)],
    }


def absolute(base: str | None, link: str) -> str | None:
    """The link as an absolute http(s) URL without fragment; null for anything else."""
    try:
        out = urljoin(base or "", link.strip()).split("#")[0]
    except ValueError:
        return None
    return out if out.startswith(("http://", "https://")) else None


_ARTICLE = pa.struct([("title", pa.string()), ("author", pa.string()), ("published", pa.string()), ("lang", pa.string()), ("text", pa.string()), *((n, pa.list_(pa.string())) for n in ("images", "external_videos", "self_hosted_videos"))])


def articles(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([article(h, u) for u, h in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)], _ARTICLE)
            yield pa.RecordBatch.from_arrays([b.column(0), *found.flatten()], ["page_id", *(f.name for f in _ARTICLE)])

    ship(pages.sparkSession)
    schema = "page_id long, title string, author string, published string, lang string, text string, images array<string>, external_videos array<string>, self_hosted_videos array<string>"
    return pages.select(F.col(id_col).cast("long"), url_col, html_col).mapInArrow(run, schema)


def links(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """A row per distinct link of a page, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, url, html in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                rows += [(key, i, x) for i, x in enumerate(dict.fromkeys(y for y in (absolute(url, z) for z in parse(html or "").links) if y))]
            cols = [list(c) for c in zip(*rows, strict=True)] if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())], ["page_id", "place", "link"])

    ship(pages.sparkSession)
    return pages.select(F.col(id_col).cast("long"), url_col, html_col).mapInArrow(run, "page_id long, place int, link string")
