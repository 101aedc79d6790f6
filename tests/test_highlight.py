"""Marks against a plain second way: character by character through the standard library's parser."""

import random
import re
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest

from tessera.operators import highlight
from tessera.plans import registry

DIR = "/root/testdata/sf0.001"


class Plain(HTMLParser):
    """Text with a flag a character, tags and comments apart; None stands for a border between texts."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.chars, self.open = [], []

    def border(self, tag):
        if tag not in highlight.INLINE and not {"script", "style"} & set(self.open):
            self.chars.append(("\n", False))

    def handle_starttag(self, tag, attrs):
        self.border(tag)
        if tag in highlight.UNMARKED:
            self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.border(tag)

    def handle_endtag(self, tag):
        if tag in self.open:
            self.open.remove(tag)
        self.border(tag)

    def handle_data(self, data):
        if not {"script", "style"} & set(self.open):
            self.chars += [(c, not self.open) for c in data]


def texts(html):
    """Marked texts in order, of a page with marks."""
    return re.findall(r"<mark class=\"([^\"]*)\">(.*?)</mark><!--m-->", html, re.S)


def brute(html, keywords):
    """Flags of characters in a keyword, by trying every keyword at every place."""
    p = Plain()
    p.feed(html)
    p.close()
    text = "".join(c for c, _ in p.chars)
    low, flags, at = text.lower(), [False] * len(text), 0
    while at < len(text):
        best = 0
        for k in keywords:
            m = re.compile(r"\s+".join(map(re.escape, k.lower().split()))).match(low, at)
            if m and len(k) >= 3 and not (at and (low[at - 1].isalnum() or low[at - 1] == "_")) and not (re.fullmatch("[a-z0-9 -]+", k) and m.end() < len(low) and (low[m.end()].isalnum() or low[m.end()] == "_")):
                best = max(best, m.end() - at)
        if best:
            flags[at : at + best] = [True] * best
        at += best or 1
    return [(c, f and ok) for (c, ok), f in zip(p.chars, flags, strict=True)]


def marks_of(html, keywords, sentences=()):
    out = highlight.marked(html, highlight.marks(html, highlight.automaton(list(keywords)), list(sentences)))
    assert highlight.unmarked(out) == html
    return out


def test_random_pages_by_brute_force():
    rng = random.Random(8)
    keywords = ["abc", "b c", "ab", "cab ca", "a&b", "c"]
    parts = ["a", "b", "c", "ab", " ", "\n ", "abc", "<b>", "</b>", "<p>", "</p>", "&amp;", "<!-- abc -->", '<i title="abc > ab">', "</i>", "<a href='/abc'>", "</a>", "<script>abc<b></script>", "<br/>", "&#97;", "_"]
    for _ in range(1500):
        html = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        out = marks_of(html, keywords)
        want = brute(html, [k for k in keywords if len(k) >= 3])
        seen = Plain()  # characters inside marks, through the same parser
        got, inside = [], [False]

        class Reader(Plain):
            def handle_starttag(self, tag, attrs):
                inside[0] = inside[0] or tag == "mark"
                super().handle_starttag(tag, attrs)

            def handle_endtag(self, tag):
                inside[0] = inside[0] and tag != "mark"
                super().handle_endtag(tag)

            def handle_data(self, data):
                if not {"script", "style"} & set(self.open):
                    got.extend((c, inside[0]) for c in data)

        reader = Reader()
        reader.feed(out)
        reader.close()
        assert not seen.chars
        solid = lambda rows: [(c, f) for c, f in rows if not c.isspace()]  # noqa: E731  blanks alone aren't marked
        assert solid(got) == solid(want), html


def test_rules():
    assert texts(marks_of("<p>The Home <b>Office</b> said</p>", ["home office"])) == [("keyword-highlight", "Home "), ("keyword-highlight", "Office")]
    assert texts(marks_of("<p>homeoffice home\n office.</p>", ["Home Office"])) == [("keyword-highlight", "home\n office")]
    assert texts(marks_of("<p>Café &eacute;tude R&amp;D</p>", ["étude", "r&d"])) == [("keyword-highlight", "&eacute;tude"), ("keyword-highlight", "R&amp;D")]
    assert texts(marks_of("<p>সচিবালয়ের সচিবের অসচিব</p>", ["সচিব"])) == [("keyword-highlight", "সচিবালয়ের"), ("keyword-highlight", "সচিবের")]
    both = texts(marks_of("<p>one important sentence here</p>", ["important"], ["One important sentence", "short"]))
    assert both == [("important-sentence-highlight", "one "), ("important-sentence-highlight keyword-highlight", "important"), ("important-sentence-highlight", " sentence")]
    assert texts(marks_of("<title>alpha</title><a>alpha</a><textarea>alpha</textarea>alpha<p title='alpha'", ["alpha"])) == [("keyword-highlight", "alpha")]
    assert marks_of("", ["abc"]) == "" and marks_of("<p>abc</p>", []) == "<p>abc</p>"


def test_query(spark):
    """Every page comes back; titles and keywords are marked where a plain search finds them between tags."""
    pages = {r["page_id"]: r["html"] for r in pq.read_table(f"{DIR}/pages.parquet").to_pylist()}
    words = {w.lower() for r in pq.read_table(f"{DIR}/benchmark.parquet").to_pylist() for w in re.split(r"[\W\d_]+", r["text"]) if len(w) >= 7}
    rows = registry.queries()["page_highlights"](spark, DIR).collect()
    assert {r["page_id"] for r in rows} == set(pages) and all(r["same"] for r in rows)
    some = 0
    for r in rows:
        html = pages[r["page_id"]]
        got = {(int(a), int(b)) for a, b, k in (x.split(":") for x in r["marks"].split(",") if x) if k == "k"}
        body = html[html.find("<article") :]
        for m in re.finditer(r"(?<![\w&;#])\w{7,}(?![\w;])", body):
            inside = body.rfind("<", 0, m.start()) > body.rfind(">", 0, m.start())
            if m[0].lower() in words and not inside:
                at = m.start() + len(html) - len(body)
                some += 1
                spans = [(int(a), int(b)) for a, b, _ in (x.split(":") for x in r["marks"].split(",") if x)]
                assert any(a <= at and at + len(m[0]) <= b for a, b in spans), (r["page_id"], m[0])
        assert all(html[a:b].strip() for a, b in got)
    assert some > 10


def test_too_many_keywords(spark):
    with pytest.raises(ValueError):
        highlight.highlighted(spark.createDataFrame([(1, "x")], "page_id long, html string"), "page_id", "html", ["k"] * (highlight.MOST + 1))
