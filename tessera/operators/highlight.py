"""Marks in pages: keywords and sentences are found in a page's plain text and marked in its HTML.

A page is read once into its plain text and an offset map: for each character of the text its place in the HTML, which entities make uneven.
Terms are searched in a folded text (lower case, white space as single blanks) by one pass of an automaton, so a line break or a tag inside a
term doesn't matter.  Places go back through two sorted maps by range look-up, folded text to text, text to HTML, and a mark that
crosses tags is cut at them.  Where marks of both kinds meet, each stretch gets one mark with both classes.  Removing the marks gives the page again.

Everything is local to a page, so nothing is shuffled; the keywords are a reference list of bounded size, sent with the tasks.

Defined cases: a null page has no marks and stays null; text in scripts, styles, links, text areas and titles isn't marked, but a sentence may go on behind
it; terms of under three letters and sentences of under ten are left out; of overlapping keywords the one that starts first, then the longest; terms
that occur in tags or comments aren't found; a page that breaks off inside a tag is marked as far as its last text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import ship
from .gazetteer import leftmost_longest

#: Most keywords, and bytes of all of them.
MOST, MOST_BYTES = 100_000, 16 << 20
LEAST_KEYWORD, LEAST_SENTENCE = 3, 10
UNMARKED = frozenset(("script", "style", "a", "textarea", "title"))
KEYWORD, SENTENCE = "keyword-highlight", "important-sentence-highlight"
#: Tags that don't end a word.
INLINE = frozenset("a abbr b bdi bdo cite code em font i ins kbd mark q s small span strong sub sup u var wbr".split())
#: A tag, comment, declaration or character reference; what is left between them is text.
_PARTS = re.compile(r"<!--.*?(?:-->|$)|</?([a-zA-Z][^\s/>]*)(?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*(?:>|$)|<[!?][^>]*(?:>|$)|(&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);?)", re.S)
#: Vowel signs and joiners belong to the letter before them.
_TAIL = re.compile("[়া-্ৗ]*")
_BENGALI = re.compile("[ঀ-৿]")
_ENDING = re.compile("[ঀ-৿]{0,8}")
#: What marking adds.
MARK = re.compile(r'<mark class="(?:important-sentence-highlight|keyword-highlight)[^"]*">|</mark><!--m-->')


def mapped(html: str) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """The plain text, with a line break for each tag that ends a word; for each of its characters where it begins and ends in the HTML, and
    whether it may be marked."""
    text, begins, ends, free = [], [], [], []
    inside: str | None = None
    linked = 0

    def add(piece: str, at: int, size: int | None) -> None:
        text.append(piece)
        n = len(piece)
        begins.append(np.arange(at, at + n) if size is None else np.full(n, at))
        ends.append(np.arange(at + 1, at + n + 1) if size is None else np.full(n, at + size))
        free.append(np.full(n, not linked and inside is None))

    at = 0
    for m in _PARTS.finditer(html):
        if m.start() < at:
            continue
        if inside in ("script", "style"):  # until their own end tag
            if not (m[1] and m[0].startswith("</") and m[1].lower() == inside):
                continue
            inside, at = None, m.end()
            continue
        if m.start() > at:
            add(html[at : m.start()], at, None)
        at = m.end()
        if m[2]:
            plain = unescape(m[2])
            add(plain, m.start(), None if plain == m[2] else len(m[2]))
        elif m[1] and m[1].lower() not in INLINE:
            text.append("\n"), begins.append([m.start()]), ends.append([m.start()]), free.append([False])
        if m[1] and m[1].lower() in UNMARKED:
            tag, end = m[1].lower(), m[0].startswith("</")
            if tag == "a":
                linked = max(0, linked - 1) if end else linked + 1
            else:
                inside = None if end and inside == tag else inside if end else inside or tag
    if at < len(html) and inside not in ("script", "style"):
        add(html[at:], at, None)
    join = lambda x, kind: np.concatenate([np.zeros(0, kind), *x]).astype(kind)
    return "".join(text), join(begins, np.int64), join(ends, np.int64), join(free, bool)


def folded(text: str) -> tuple[str, np.ndarray]:
    """Lower case with white space as single blanks, and where each character begins in the text."""
    out, at = [], []
    gap = False
    for i, c in enumerate(text):
        if c.isspace():
            if not gap:
                out.append(" "), at.append(i)
            gap = True
        else:
            low = c.lower()
            out.append(low if len(low) == 1 else c)
            at.append(i)
            gap = False
    return "".join(out), np.array(at, np.int64)


def _term(s: str) -> str:
    return " ".join("".join(c.lower() if len(c.lower()) == 1 else c for c in s).split())


def _whole(text: str, begin: int, end: int) -> int | None:
    """Where a keyword ends that may be a word here; a Bengali one may have an ending of up to eight letters."""
    word = lambda c: c.isalnum() or c == "_"
    plain = all(c.isascii() and (c.isalnum() or c in " -") for c in text[begin:end])
    if begin and (word(text[begin - 1]) or _BENGALI.match(text[begin - 1])):
        return None
    if plain:
        return None if end < len(text) and word(text[end]) else end
    return _ENDING.match(text, end).end()


def automaton(keywords: list[str]):
    """One automaton for the keywords that are long enough."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for t in {_term(k) for k in keywords}:
        if len(t) >= LEAST_KEYWORD:
            machine.add_word(t, len(t))
    machine.make_automaton()
    return machine


def found(text: str, machine, sentences: list[str]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Keywords and sentences in a folded text, each as leftmost-longest spans."""
    words = []
    if len(machine):
        for last, n in machine.iter(text):
            if (end := _whole(text, last - n + 1, last + 1)) is not None:
                words.append((last - n + 1, end, 0))
    whole = []
    for s in {_term(s) for s in sentences if s}:
        at = text.find(s) if len(s) >= LEAST_SENTENCE else -1
        while at >= 0:
            whole.append((at, _TAIL.match(text, at + len(s)).end(), 0))
            at = text.find(s, at + 1)
    return [x[:2] for x in leftmost_longest(words)], [x[:2] for x in leftmost_longest(whole)]


def marks(html: str, machine, sentences: list[str]) -> list[tuple[int, int, str]]:
    """(start, end, classes) of the stretches of the HTML that are marked, in order; none holds a tag."""
    text, begins, ends, free = mapped(html)
    low, at = folded(text)
    words, whole = found(low, machine, sentences)
    kinds = np.zeros(len(text), np.int8)
    for spans, bit in ((whole, 1), (words, 2)):
        for a, b in spans:
            kinds[at[a] : at[b - 1] + 1] |= bit
    kinds[~free] = 0
    # A stretch ends where the kind changes or the HTML has something between two characters.
    if not len(kinds):
        return []
    cut = np.flatnonzero((kinds[1:] != kinds[:-1]) | (begins[1:] != ends[:-1]) & (begins[1:] != begins[:-1])) + 1
    edges = [0, *cut.tolist(), len(kinds)]
    names = {1: SENTENCE, 2: KEYWORD, 3: f"{SENTENCE} {KEYWORD}"}
    return [(int(begins[a]), int(ends[b - 1]), names[int(kinds[a])]) for a, b in zip(edges, edges[1:]) if kinds[a] and text[a:b].strip()]


def marked(html: str, stretches: list[tuple[int, int, str]]) -> str:
    out, last = [], 0
    for a, b, names in stretches:
        out += [html[last:a], f'<mark class="{names}">', html[a:b], "</mark><!--m-->"]
        last = b
    return "".join([*out, html[last:]])


def unmarked(html: str) -> str:
    """The page without the marks that ``marked`` made."""
    return MARK.sub("", html)


def highlighted(pages: DataFrame, id_col: str, html_col: str, keywords: list[str], sentences_col: str | None = None) -> DataFrame:
    """page_id, html with marks, and ``marks``: start, end, classes and text of each in the page's own HTML.  ``sentences_col``: each page's sentences."""
    if len(keywords) > MOST or sum(len(k.encode()) for k in keywords) > MOST_BYTES:
        raise ValueError(f"there may be {MOST} keywords of {MOST_BYTES} bytes in all")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(keywords)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("classes", pa.string()), ("text", pa.string())]))
        for batch in batches:
            htmls, rows = [], []
            for html, sentences in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                stretches = marks(html or "", machine, sentences or [])
                htmls.append(None if html is None else marked(html, stretches))
                rows.append([{"start": a, "end": b, "classes": c, "text": html[a:b]} for a, b, c in stretches])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(htmls, pa.string()), pa.array(rows, kind)], ["page_id", "html", "marks"])

    ship(pages.sparkSession)
    sentences = F.array().cast("array<string>") if sentences_col is None else F.col(sentences_col)
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html"), sentences.alias("sentences")).mapInArrow(run, "page_id long, html string, marks array<struct<start:int,end:int,classes:string,text:string>>")


def without_marks(html):
    """The column without marks."""
    return F.regexp_replace(html, r'<mark class="(?:important-sentence-highlight|keyword-highlight)[^"]*">|</mark><!--m-->', "")
