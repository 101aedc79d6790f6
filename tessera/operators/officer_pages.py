"""Officer pages: a page's lines in document order, role headings among them, labelled fields of each role, and its photo.

A page is read once, in Arrow batches, into lines and images with their places; that step knows tags only.  All else is DataFrame
operations: headings and labels are told by column rules, a heading's reach comes from running sums and look-ups of the lines that begin and
end its container, and every line goes to the headings that reach it.  Nothing is inferred from a place outside a heading's reach.

A heading opens a block.  Its container is the innermost element that holds more than the heading.  If the container has no other role
heading, hardly a text and no heading tag before this one, it is a card and the block is all of it; else the block begins after the heading.
It ends with the container or before the next heading.  Pages without role headings are read as plain text: a line that begins with a
role's name and a colon carries its role to the lines that follow.

Defined cases: a page without text, or null, has no lines and gives no rows; broken markup never fails a task; of several blocks of a role that
with a name wins, then a card, then the first; of several values of a field the first wins; fields of a found role that the page doesn't
have are returned too, by their state.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import held, ship
from ..functions import integrity, legacy
from ..functions import text as T

# Tags, labels, roles and placeholders.
BLOCKS = frozenset("p div tr li table dt dd dl section article ul ol h1 h2 h3 h4 h5 h6 form tbody thead blockquote fieldset legend figure figcaption caption center main aside pre address".split())
CELLS, HEADINGS = frozenset(("td", "th")), frozenset(f"h{i}" for i in range(1, 7))
DROPPED = frozenset("script style noscript template svg nav header footer select option title head iframe button input textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that an opening tag ends where their own end tag is missing, and where the search for them stops.
ENDED = {"li": ({"li"}, {"ul", "ol"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": (CELLS, {"tr", "table"}), "th": (CELLS, {"tr", "table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"})}
ROLES = ("primary", "alternate", "appellate")
FIELDS = ("Officer_Name", "Designation", "Phone", "Mobile", "Email", "Address")
MOST_HEADING, MOST_LABEL = 70, 25
CONTAINERS = ("কর্মকর্তাগণ", "কর্মকর্তাবৃন্দ", "officers", "informationofficers")
PRIMARY = ("দায়িত্বপ্রাপ্তকর্মকর্তা", "তথ্যপ্রদানকারীকর্মকর্তা", "তথ্যকর্মকর্তা", "designatedofficer", "responsibleofficer")
ALTERNATE, ALTERNATE_OF = ("বিকল্প", "alternat"), ("দায়িত্বপ্রাপ্ত", "তথ্যপ্রদানকারী", "designated", "responsible", "তথ্যকর্মকর্তা", "কর্মকর্তা", "officer")
APPELLATE, APPELLATE_OF = ("আপীল", "appellate"), ("কর্তৃপক্ষ", "authority", "কর্মকর্তা", "officer")
SEPARATORS = ",| ও | and |/"
FOLDED = (("আপিল", "আপীল"), ("দ্বায়িত্ব", "দায়িত্ব"), ("পদবী", "পদবি"))
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
PHONE = r"(?:\+|০|0|৮|8)[০-৯0-9][০-৯0-9\s\-()./]{5,}[০-৯0-9]"
CLOAKED = "protected from spam|email address is being protected|javascript to view"
COLON = "[:ঃ：]"
BARE_LABEL = r"^(কর্মকর্তার নাম|পদবি|পদবী|টেলিফোন|ফোন|মোবাইল|ই-মেইল|ইমেইল|ঠিকানা)\s+(\S.*)$"
INLINE_LABEL = rf"(?i)(?:(?<=\s)|^)(কর্মকর্তার নাম|নাম|পদবি|পদবী|টেলিফোন|ফোন|মোবাইল|ই-মেইল|ইমেইল|ইমেল|ঠিকানা|Name|Designation|Phone|Mobile|E-?mail|Address)\s*(?:\([^)]{{1,12}}\))?\s*{COLON}"
BLANK_VALUES = ("নাম", "n/a", "na", "-", "--", "—", "০০০", "000", "null", "none", "nil", "প্রযোজ্য নয়", "নেই", ".", "...", "test", "testing", "demo", "sample", "xxx", "abc", "asdf", "ttt", "পরীক্ষা")
REJECTED_PATHS = "/assets/|/theme/|/images/logo"
REJECTED_WORDS = "logo|banner|placeholder|default|avatar|no[-_]?image|noimage|blank|spinner|icon|favicon|site-assets|technical-support|carousel|slider|flag|emblem|coat[-_]?of[-_]?arms"
IMAGE_FILE = re.compile(r"\.(?:jpe?g|png|webp|bmp|gif|svg)(?:\?|$)", re.I)
BACKGROUND = re.compile(r"background(?:-image)?\s*:[^;]*url\(\s*['\"]?([^'\")]+)", re.I)
ROLE_WORDS = {"primary": ("primary", "designated", "দায়িত্বপ্রাপ্ত"), "alternate": ("alternate", "alternative", "বিকল্প"), "appellate": ("appellate", "আপীল", "আপিল")}
FONT = re.compile(r"font-family\s*:\s*([^;]+)", re.I)
LEAST_SIDE = 80
#: Pages whose lines a task in Python holds at once.
AT_ONCE = 16
#: Text before a card's heading is shorter than this.
MOST_BEFORE = 200


#: A text without any of these, squashed, is no heading.
_SIGNS = ("কর্মকর্তা", "কর্তৃপক্ষ", "officer", "authority", "দায়িত্বপ্রাপ্ত", "তথ্যপ্রদানকারী", "designated", "responsible")


def _may_head(text: str) -> bool:
    """Whether ``heading`` has to look at the text."""
    if not 0 < len(text) <= MOST_HEADING:
        return False
    squashed = re.sub("[\\s:：\\-–—\u200c\u200d]+", "", text.lower())
    for a, b in FOLDED:
        squashed = squashed.replace(a, b)
    return any(s in squashed for s in _SIGNS)


def _clean(s: str) -> str:
    return " ".join(re.sub("[​⁠﻿­‎‏‪-‮⁦-⁩]", "", unescape(s)).replace(" ", " ").split())


class _Stream(HTMLParser):
    """Lines and images of a page.  Places count opening tags, texts and end tags, so distances between them mean something."""

    def __init__(self, url: str, words: tuple[dict, dict] | None = None):
        super().__init__(convert_charrefs=True)
        self.url, self.pos, self.skipped, self.words = url, 0, 0, words
        #: Open elements: tag, place, number of its first line, whether an image is inside, length of the line's pieces at its start, in a link.
        self.open: list[dict] = [dict(tag="", at=0, line=0, image=False, piece=0, linked=False, font=None)]
        self.lines: list[dict] = []
        self.images: list[dict] = []
        self.pieces: list[str] = []
        self.plain = ""
        self.units: list[str] = []
        self.begun: int | None = None
        self.rows: list[list[list[list[str]]]] = []  # of each open table its rows, each a list of cells, each a list of lines

    def flush(self) -> None:
        cells = [_clean(c) for c in "".join(self.pieces).split("\t")]
        cells = [c for c in cells if c or len(cells) > 1]
        if any(cells):
            text = " ".join(c for c in cells if c)
            linked = not self.plain.strip()
            units = list(dict.fromkeys([*self.units, *([] if linked or len(cells) > 1 else [text])]))  # inner elements first; a row isn't a heading
            begin = _clean(re.match("[^:ঃ]{0,70}", text)[0])
            self.lines.append(dict(pos=self.begun, cells=cells, units=[u for u in units if _may_head(u)], begin=begin if _may_head(begin) else None, path=[e for e in self.open if e["at"] < self.begun], htag=any(e["tag"] in HEADINGS for e in self.open), row=None, header=None))
        if self.rows and self.rows[-1] and self.rows[-1][-1] and self.rows[-1][-1][-1][-1:] != [""]:
            self.rows[-1][-1][-1].append("")
        self.pieces, self.plain, self.units, self.begun = [], "", [], None
        for e in self.open:
            e["piece"] = 0

    def handle_starttag(self, tag, attrs):
        if self.skipped or tag in DROPPED:
            self.skipped += tag not in VOID
            return
        a = {k: v or "" for k, v in attrs}
        if tag == "base" and a.get("href"):
            self.url = urljoin(self.url, a["href"])
        if tag in ENDED or tag in BLOCKS:
            ended, stop = ENDED.get(tag, ({"p"}, {"table", "td", "th", "li", "div"}))
            for e in reversed(self.open[1:]):
                if e["tag"] in stop:
                    break
                if e["tag"] in ended:
                    self.end(e["tag"])
        self.pos += 1
        if tag in BLOCKS or tag == "br":
            self.flush()
        self.picture(tag, a)
        if tag in VOID:
            self.pos += 1
            return
        if tag == "table":
            self.rows.append([])
        elif tag == "tr" and self.rows:
            self.rows[-1].append([])
        elif tag in CELLS and self.rows and self.rows[-1]:
            self.rows[-1][-1].append([""])
        linked = self.open[-1]["linked"] or (tag == "a" and a.get("href", "").strip() not in ("", "#"))
        family = FONT.search(a.get("style", ""))
        font = a.get("face") if tag == "font" and a.get("face") else family[1] if family else self.open[-1]["font"]
        self.open.append(dict(tag=tag, at=self.pos, line=len(self.lines), image=False, piece=len(self.pieces), linked=linked, font=font))

    def handle_endtag(self, tag):
        if self.skipped:
            self.skipped -= tag not in VOID
        elif any(e["tag"] == tag for e in self.open[1:]):
            while True:
                last = self.open[-1]["tag"]
                self.end(last)
                if last == tag:
                    break

    def end(self, tag):
        """Ends the innermost element with the tag."""
        k = max(i for i, e in enumerate(self.open) if e["tag"] == tag)
        e = self.open[k]
        if tag not in BLOCKS and not e["linked"] and e["line"] == len(self.lines) and (text := _clean("".join(self.pieces[e["piece"] :]))):
            self.units.append(text)
        if tag in BLOCKS:
            self.flush()
        elif tag in CELLS:
            self.pieces.append("\t")
        self.pos += 1
        e |= dict(end=self.pos, last=len(self.lines) - 1 + (self.begun is not None and self.begun > e["at"]))
        if tag == "tr" and self.rows and self.rows[-1]:
            self.rowed(e)
        elif tag == "table" and self.rows:
            self.rows.pop()
        del self.open[k]

    def rowed(self, e: dict) -> None:
        """Gives the row's first line the cells of the row, and of the table's first row."""
        rows = self.rows[-1]
        if e["line"] < len(self.lines) and len(rows) > 1 and self.lines[e["line"]]["row"] is None:
            lines = lambda cell: [x for x in map(_clean, cell) if x]
            self.lines[e["line"]] |= dict(row=[lines(c) for c in rows[-1]], header=[" ".join(lines(c)) for c in rows[0]])

    def handle_data(self, data):
        if self.skipped:
            return
        self.pos += 1
        if self.begun is None and data.strip():
            self.begun = self.pos
        data = self.recovered(data).replace("\t", " ")
        self.pieces.append(data)
        if not self.open[-1]["linked"]:
            self.plain += data
        if self.rows and self.rows[-1] and self.rows[-1][-1]:
            self.rows[-1][-1][-1][-1] += data

    def recovered(self, text: str) -> str:
        """The text of a run in a legacy font in Unicode, if that makes it sound; else as it is."""
        if self.words is None or not text.strip():
            return text
        judge, read = self.words
        if integrity.judged(text, self.open[-1]["font"], judge)[0] != integrity.LEGACY:
            return text
        out = legacy.read(unescape(text), read)
        return out if integrity.judged(out, None, judge)[0] in integrity.STORABLE else text

    def picture(self, tag: str, a: dict) -> None:
        found = []
        if tag in ("img", "source"):
            found = [v for n in ("data-src", "data-lazy-src", "data-original", "src") if (v := a.get(n, "").strip()) and not v.startswith("data:")][:1]
            sizes = [p.split() for p in (a.get("srcset") or a.get("data-srcset") or "").split(",") if p.strip()]
            if sizes and not found:
                found = [max(sizes, key=lambda p: float(re.sub("[^0-9.]", "", p[1]) or 1) if len(p) > 1 else 1.0)[0]]
        if m := BACKGROUND.search(a.get("style", "")):
            found.append(m[1])
        if tag == "a" and IMAGE_FILE.search(a.get("href", "")):
            found.append(a["href"])
        if found:
            for e in self.open:
                e["image"] = True
        number = lambda s: int(s) if s.isdigit() else 0
        for x in found:
            self.images.append(dict(pos=self.pos, url=urljoin(self.url, x.strip()), alt=_clean(a.get("alt", "")), title=_clean(a.get("title", "")), width=number(a.get("width", "")), height=number(a.get("height", ""))))

    def result(self) -> tuple[list[dict], list[dict]]:
        self.flush()
        for e in self.open:
            e |= dict(end=self.pos + 1, last=len(self.lines) - 1)
        for i, line in enumerate(self.lines):
            path = line.pop("path")
            c = next((e for e in reversed(path) if e["tag"] not in ("", "html", "body") and (e["last"] > e["line"] or e["image"])), path[0])
            line |= dict(i=i, c_at=c["at"], c_end=c["end"], c_first=c["line"], c_last=c["last"])
        return self.lines, self.images


def parsed(html: str | None, url: str | None, words: tuple[dict, dict] | None = None) -> tuple[list[dict], list[dict]]:
    """Lines and images of a page; with ``words`` (what is known of words), texts in legacy fonts are read."""
    stream = _Stream(url or "", words)
    try:
        stream.feed(html or "")
        stream.close()
    except (AssertionError, ValueError):  # what was read so far stands
        pass
    return stream.result()


_LINE = pa.struct([("i", pa.int32()), ("pos", pa.int32()), ("cells", pa.list_(pa.string())), ("units", pa.list_(pa.string())), ("begin", pa.string()), ("htag", pa.bool_()), *((n, pa.int32()) for n in ("c_at", "c_end", "c_first", "c_last")), ("row", pa.list_(pa.list_(pa.string()))), ("header", pa.list_(pa.string()))])
_IMAGE = pa.struct([("pos", pa.int32()), *((n, pa.string()) for n in ("url", "alt", "title")), ("width", pa.int32()), ("height", pa.int32())])
_SCHEMA = (
    "page_id long, lines array<struct<i:int,pos:int,cells:array<string>,units:array<string>,begin:string,htag:boolean,c_at:int,c_end:int,c_first:int,c_last:int,row:array<array<string>>,header:array<string>>>, "
    "images array<struct<pos:int,url:string,alt:string,title:string,width:int,height:int>>"
)


def streams(pages: DataFrame, id_col: str, url_col: str, html_col: str, recover: bool = True) -> DataFrame:
    """page_id, lines and images of every page; with ``recover``, texts in legacy fonts are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = (integrity.known, legacy.known("read")) if recover else None
        for b in (whole.slice(at, AT_ONCE) for whole in batches for at in range(0, whole.num_rows, AT_ONCE)):
            found = [parsed(h, u, words) for u, h in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in found], pa.list_(_LINE)), pa.array([x for _, x in found], pa.list_(_IMAGE))], ["page_id", "lines", "images"])

    ship(pages.sparkSession)
    return pages.select(F.col(id_col).cast("long"), url_col, html_col).mapInArrow(run, _SCHEMA)


# Rules on columns


def _holds(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def squashed(c: Column) -> Column:
    """Lower case without white space, colons and dashes, spellings folded."""
    out = F.regexp_replace(F.lower(c), "[\\s:：\\-–—‌‍]+", "")
    for a, b in FOLDED:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def label_of(c: Column) -> Column:
    """The field that a label names, or null.  The order matters: an office's phone is a phone."""
    sq = F.regexp_replace(squashed(c), "[ঃ:]+$", "")
    rules = [
        ("Mobile", _holds(sq, ("মোবাইল", "mobile")) | sq.startswith("cell")),
        ("Phone", _holds(sq, ("ফোন", "phone")) | sq.isin("tel", "tel.")),
        ("Email", _holds(sq, ("ইমেইল", "ইমেল", "mail"))),
        ("Designation", sq.startswith("পদবি") | sq.startswith("designation")),
        ("Officer_Name", sq.startswith("নাম") | sq.startswith("কর্মকর্তারনাম") | sq.startswith("name")),
        ("Address", reduce(lambda a, b: a | b, [sq.startswith(x) for x in ("ঠিকানা", "অফিস", "কার্যালয়", "address", "office")])),
    ]
    out = reduce(lambda w, r: w.when(r[1], r[0]), rules, F.when((sq == "") | (F.length(sq) > MOST_LABEL), F.lit(None)))
    return out


def _role(c: Column) -> Column:
    """The role that a heading names, ``container`` for several officers, or null."""
    sq = F.regexp_replace(squashed(c), "[ঃ:]+$", "")
    out = F.when(_holds(sq, CONTAINERS), "container").when(label_of(c).isNotNull() | c.rlike(BARE_LABEL), F.lit(None))
    out = out.when(_holds(sq, APPELLATE) & _holds(sq, APPELLATE_OF), "appellate").when(_holds(sq, ALTERNATE) & _holds(sq, ALTERNATE_OF), "alternate")
    return out.when(_holds(sq, PRIMARY) & ~_holds(sq, (*ALTERNATE, *APPELLATE)), "primary")


def heading(c: Column) -> Column:
    """``_role``, but a container for a title that names two roles or more."""
    parts = F.array_distinct(F.filter(F.transform(F.split(c, SEPARATORS), _role), lambda x: x.isin(*ROLES)))
    return F.when((F.length(c) > 0) & (F.length(c) <= MOST_HEADING), F.when(c.rlike(SEPARATORS) & (F.size(parts) >= 2), "container").otherwise(_role(c)))


def reject_reason(url: Column, alt: Column, title: Column, width: Column, height: Column) -> Column:
    """Why an image can't be an officer's photo, or empty."""
    path = F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1))
    small = (width > 0) & (height > 0) & ((width < LEAST_SIDE) | (height < LEAST_SIDE))
    return (
        F.when(path.rlike(REJECTED_PATHS), "rejected_path").when(F.lower(F.concat_ws(" ", url, alt, title)).rlike(REJECTED_WORDS), "rejected_type")
        .when(path.rlike(r"\.(svg|gif)$"), "rejected_format").when(small, "rejected_small").when(~url.startswith("http"), "not_absolute").otherwise("")
    )


def named(c: Column, blanks: tuple[str, ...] = BLANK_VALUES) -> Column:
    """Whether a value can be an officer's name: not blank or a placeholder, letters in it, no address, no digits only."""
    v = F.trim(F.coalesce(c, F.lit("")))
    return (F.length(v) >= 2) & ~F.lower(v).isin(*blanks) & ~F.contains(v, F.lit("@")) & v.rlike(r"\p{L}")


# Pages


def _first_kind(units: Column) -> Column:
    return F.get(F.filter(F.transform(units, heading), lambda k: k.isNotNull()), F.lit(0))


def _lines(stream: DataFrame) -> DataFrame:
    """A row a line, with the kind of its heading, the role that it names before a colon, and, on a page's first line, the page's images."""
    lines = stream.select("page_id", F.explode("lines").alias("x"), "images").select("page_id", "x.*", "images")
    kind = F.when(F.size("units") > 0, _first_kind(F.col("units")))
    return lines.select("page_id", "i", "pos", "cells", "htag", "c_at", "c_end", "c_first", "c_last", "row", "header", kind.alias("kind"), F.when(F.col("begin").isNotNull(), heading(F.col("begin"))).alias("named"), F.when(F.col("i") == 0, F.col("images")).alias("images"))


def _text(cells: str = "cells") -> Column:
    return F.array_join(F.filter(cells, lambda c: c != ""), " ")


def _blocks(lines: DataFrame) -> DataFrame:
    """page_id, block (the line of its heading), role, card, lines first to last, and places from to."""
    order = Window.partitionBy("page_id").orderBy("i")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    is_role = F.col("kind").isin(*ROLES)
    zero = lambda c: F.coalesce(c, F.lit(0))
    lines = lines.select("page_id", "i", "pos", "kind", "htag", "c_at", "c_end", "c_first", "c_last", F.length(_text()).alias("n"))  # texts needn't move
    sums = lines.select(
        "page_id", "i", "pos", "kind", "c_at", "c_end", "c_first", "c_last", zero(F.sum(F.col("n") + 1).over(before)).alias("chars"), zero(F.sum(F.col("htag").cast("int")).over(before)).alias("tags"),
        zero(F.sum(F.when(is_role, 1)).over(before)).alias("heads"), F.when(is_role, 1).otherwise(0).alias("is_head"),
    )
    heads = sums.where("kind IS NOT NULL")
    after = Window.partitionBy("page_id").orderBy("i")
    heads = heads.withColumns({"next_i": F.lead("i").over(after), "next_pos": F.lead("pos").over(after)}).where("is_head = 1")
    at = lambda name, **cols: sums.select(F.col("page_id"), F.col("i").alias(name), *[F.col(c).alias(n) for n, c in cols.items()])
    heads = heads.join(at("c_first", first_chars="chars", first_tags="tags", first_heads="heads"), ["page_id", "c_first"])
    heads = heads.join(at("c_last", last_heads="heads", last_is="is_head"), ["page_id", "c_last"])
    alone = F.col("last_heads") + F.col("last_is") - F.col("first_heads") == 1
    card = alone & (F.col("chars") - F.col("first_chars") < MOST_BEFORE) & (F.col("tags") == F.col("first_tags"))
    inside = F.col("next_i") <= F.col("c_last")
    return heads.select(
        "page_id", F.col("i").alias("block"), F.col("kind").alias("role"), card.alias("card"), F.when(card, F.col("c_first")).otherwise(F.col("i") + 1).alias("first"),
        F.when(inside, F.col("next_i") - 1).otherwise(F.col("c_last")).alias("last"), F.when(card, F.col("c_at")).otherwise(F.col("pos")).alias("from"), F.when(inside, F.col("next_pos")).otherwise(F.col("c_end")).alias("to"),
    )


_PARTS = "page_id, block, role, card, i, pos, k, cells"


def _cut(rows: DataFrame) -> DataFrame:
    """Lines with several labels as several lines (k)."""
    text = F.get("cells", F.lit(0))
    several = (F.size("cells") == 1) & (F.size(F.regexp_extract_all(text, F.lit(INLINE_LABEL), F.lit(0))) >= 2)
    cut = F.split(text, r"(?=" + INLINE_LABEL + ")")
    parts = F.when(several, F.transform(F.filter(cut, lambda x: F.trim(x) != ""), lambda x: F.array(F.trim(x)))).otherwise(F.array("cells"))
    return rows.select("page_id", "block", "role", "card", "i", "pos", F.posexplode(parts).alias("k", "cells"))


def _block_lines(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """Lines of each block."""
    reach = blocks.where("first <= last").select("page_id", "block", "role", "card", F.explode(F.sequence("first", "last")).alias("i"))
    return _cut(reach.join(lines.select("page_id", "i", "pos", "cells"), ["page_id", "i"]).where("i <> block"))


def _row_lines(lines: DataFrame) -> DataFrame:
    """Table rows with a role in one cell and the officer in the cells after it, which stand under the last header cells: as label and value."""
    rows = lines.where(F.col("row").isNotNull() & F.col("kind").isin(*ROLES))
    full = F.transform("row", lambda c: F.array_join(c, " "))
    rows = rows.withColumn("at", F.array_position(F.transform(full, heading), F.col("kind"))).where((F.col("at") > 0) & (F.col("at") < F.size("row")))
    n = F.size("row") - F.col("at")
    rows = rows.where(n <= F.size("header")).withColumns({"values": F.slice("row", (F.col("at") + 1).cast("int"), n.cast("int")), "heads": F.slice("header", (F.size("header") - n + 1).cast("int"), n.cast("int"))})
    both = lambda h: h.rlike("নাম|(?i)name") & h.rlike("(?i)পদব[িী]|designation")
    contacts = lambda h: sum(F.when(h.rlike(p), 1).otherwise(0) for p in ("(?i)ফোন|phone", "(?i)মোবাইল|mobile", r"(?i)ই-?\s?মেইল|e-?mail", "(?i)ফ্যাক্স|fax")) >= 2
    kinds = F.transform("heads", lambda h: F.when(both(h), "both").when(contacts(h), "contacts").otherwise(label_of(h)))
    rows = rows.withColumn("kinds", kinds).where(F.exists("kinds", lambda k: k.isin("both", "Officer_Name")))
    cells = rows.select("page_id", F.col("i").alias("block"), F.col("kind").alias("role"), "i", "pos", F.posexplode(F.arrays_zip("kinds", "values")).alias("n", "x")).select("*", "x.*").where(F.size("values") > 0)
    pair = lambda name, value: F.struct(F.lit(name).alias("label"), value.alias("value"))
    one = lambda x: (
        F.when(x.rlike(f"^[^:ঃ：]{{1,30}}?\\s*{COLON}"), F.struct(F.regexp_extract(x, f"^([^:ঃ：]{{1,30}}?)\\s*{COLON}", 1).alias("label"), F.regexp_extract(x, f"^[^:ঃ：]{{1,30}}?\\s*{COLON}\\s*(.*)$", 1).alias("value")))
        .when(F.contains(x, F.lit("@")), pair("Email", x)).when(T.digits_only(x).rlike("^(88)?01[3-9][0-9]{8}$"), pair("Mobile", x)).when(F.length(T.digits_only(x)) >= 6, pair("Phone", x))
    )
    first = F.get("values", F.lit(0))
    found = (
        F.when(F.col("kinds") == "both", F.array(pair("Name", first), F.when(F.size("values") > 1, pair("Designation", F.get("values", F.lit(1))))))
        .when(F.col("kinds").isin("contacts", "Phone", "Mobile", "Email"), F.transform("values", one))
        .when(F.col("kinds") == "Address", F.array(pair("Address", F.array_join("values", ", "))))
        .otherwise(F.array(F.struct(F.replace("kinds", F.lit("Officer_Name"), F.lit("Name")).alias("label"), F.array_join("values", " ").alias("value"))))
    )
    pairs = cells.where("kinds IS NOT NULL").select("page_id", "block", "role", "i", "pos", "n", F.posexplode(F.array_compact(found)).alias("m", "p"))
    return pairs.select("page_id", "block", "role", F.lit(True).alias("card"), "i", "pos", (1000 * F.col("n") + F.col("m")).alias("k"), F.array("p.label", "p.value").alias("cells"))


def _labelled(parts: DataFrame) -> DataFrame:
    """page_id, block, role, card, i, k, pos, field, value: labels with their values, which may stand on the next line."""
    order = Window.partitionBy("page_id", "block").orderBy("i", "k")
    colon = f"^([^:ঃ：]{{1,30}}?)\\s*{COLON}\\s*(.*)$"
    rows = parts.withColumn("text", F.trim(F.array_join(F.filter("cells", lambda c: c != ""), " ")))
    rows = rows.withColumns({"head": F.regexp_extract("text", colon, 1), "tail": F.regexp_extract("text", colon, 2), "own": label_of(F.col("text")), "many": F.size("cells") >= 2, "cell": label_of(F.get("cells", F.lit(0)))})
    rows = rows.withColumns({"of_head": F.when(F.col("head") != "", label_of(F.col("head"))), "role_of": heading(F.col("text"))})
    up = {c: F.lead(c).over(order) for c in ("text", "head", "own", "of_head", "role_of", "many", "cell")}
    rows = rows.withColumns({f"next_{c}": e for c, e in up.items()})
    next_free = F.col("next_own").isNull() & F.col("next_role_of").isNull() & F.col("next_text").isNotNull() & ~(F.col("next_many") & F.col("next_cell").isNotNull())
    plain_next = F.when(next_free & (F.col("next_head") == ""), F.col("next_text"))
    bare = ~F.col("many") & F.col("text").rlike(BARE_LABEL) & (F.col("head") == "")
    of_bare = label_of(F.regexp_extract("text", BARE_LABEL, 1))
    rest = F.array_join(F.filter(F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0))), lambda c: c != ""), " ")
    by_cells, by_colon = F.col("many") & F.col("cell").isNotNull(), F.col("of_head").isNotNull()
    field = F.when(by_cells, F.col("cell")).when(bare, of_bare).when(by_colon, F.col("of_head")).otherwise(F.col("own"))
    empty = lambda x, y: F.when(x != "", x).otherwise(F.coalesce(y, F.lit("")))
    value = (
        F.when(by_cells, empty(rest, plain_next)).when(bare, F.regexp_extract("text", BARE_LABEL, 2))
        .when(by_colon, empty(F.col("tail"), F.when(next_free & F.col("next_of_head").isNull(), F.col("next_text")))).otherwise(F.coalesce(plain_next, F.lit("")))
    )
    return rows.select("page_id", "block", "role", "card", "i", "k", "pos", field.alias("field"), F.trim(F.regexp_replace(value, f"^[\\s:ঃ：]+", "")).alias("value")).where("field IS NOT NULL")


def _states(blocks: DataFrame, parts: DataFrame, labelled: DataFrame, blanks: tuple[str, ...], plain: bool = False) -> DataFrame:
    """A row for each block and field: value, state, pos, and how many names the block has.  In ``plain`` text an address that is the only one
    needs no label."""
    key = ["page_id", "block"]
    first = Window.partitionBy(*key, "field").orderBy("i", "k")
    one = labelled.withColumns({"r": F.row_number().over(first), "n": F.count("*").over(Window.partitionBy(*key, "field"))}).where("r = 1")
    mail = F.regexp_replace(F.regexp_replace("value", r"(?i)\s*[\[(]\s*(?:at|@)\s*[\])]\s*", "@"), r"(?i)\s*[\[(]\s*dot\s*[\])]\s*", ".")
    found = F.regexp_extract(mail, EMAIL, 0)
    is_mail, blank = F.col("field") == "Email", (F.col("value") == "") | F.lower("value").isin(*blanks)
    cloaked = is_mail & F.col("value").rlike(f"(?i){CLOAKED}")
    state = F.when(blank | cloaked, "PAGE_EMPTY").when(is_mail & (found == ""), "PARSE_MISS").otherwise("FILLED")
    one = one.select(*key, "field", "pos", "n", state.alias("state"), F.when(state == "FILLED", F.when(is_mail, found).otherwise(F.col("value"))).otherwise("").alias("value"))
    text = parts.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "k", "cells"))), lambda x: F.array_join(x["cells"], " ")), "\n").alias("text"))
    mails = F.array_distinct(F.regexp_extract_all("text", F.lit(f"({EMAIL})"), F.lit(1)))
    signs = text.select(*key, (F.size(mails) > 0).alias("has_mail"), F.when(F.size(mails) == 1, mails[0]).alias("only_mail"), F.exists(F.regexp_extract_all("text", F.lit(PHONE), F.lit(0)), lambda x: F.length(T.digits_only(x)) >= 7).alias("has_phone"))
    grid = blocks.select(*key, "role", "card", F.explode(F.array(*map(F.lit, FIELDS))).alias("field"))
    rows = grid.join(one, [*key, "field"], "left").join(signs, key, "left")
    if plain:
        alone = is_mail & (F.coalesce("value", F.lit("")) == "") & F.col("only_mail").isNotNull()
        rows = rows.withColumns({"value": F.when(alone, F.col("only_mail")).otherwise(F.col("value")), "state": F.when(alone, "FILLED").otherwise(F.col("state"))})
    reached = Window.partitionBy(*key)
    has = lambda *names: F.max(F.col("field").isin(*names) & (F.coalesce("value", F.lit("")) != "")).over(reached)
    miss = (is_mail & F.col("has_mail") & ~has("Email")) | (F.col("field").isin("Phone", "Mobile") & F.col("has_phone") & ~has("Phone", "Mobile"))
    state = F.coalesce("state", F.when(F.coalesce(miss, F.lit(False)), "PARSE_MISS").otherwise("NOT_ON_PAGE"))
    names = F.max(F.when(F.col("field") == "Officer_Name", F.col("n"))).over(reached)
    name = F.max(F.when(F.col("field") == "Officer_Name", F.col("value"))).over(reached)
    return rows.select(*key, "role", "card", "field", F.coalesce("value", F.lit("")).alias("value"), state.alias("state"), "pos", F.coalesce(names, F.lit(0)).alias("names"), F.coalesce(name, F.lit("")).alias("name"))


def _plain_blocks(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks and lines of pages without role headings: a role's name before a colon carries its role to the lines that follow."""
    kinds = lines.where(F.col("kind").isin(*ROLES) | F.col("named").isin(*ROLES)).groupBy("page_id").agg(F.max(F.coalesce(F.col("kind").isin(*ROLES), F.lit(False))).alias("some"))
    rows = lines.join(kinds.where("NOT some").select("page_id"), "page_id", "left_semi").select("page_id", "i", "pos", "cells", "named").withColumn("text", _text())
    order = Window.partitionBy("page_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("named").isNotNull(), F.struct("named", "i")), ignorenulls=True).over(order)
    rows = rows.withColumn("last", last).where(F.col("last.named").isin(*ROLES))
    rows = rows.select("page_id", F.col("last.i").alias("block"), F.col("last.named").alias("role"), F.lit(False).alias("card"), "i", "pos", "cells", "text")
    is_head = F.col("i") == F.col("block")
    rest = F.trim(F.regexp_replace("text", "^[^:ঃ]{0,70}[:ঃ ]*", ""))
    parts = rows.withColumn("cells", F.when(is_head, F.when(rest != "", F.array(rest))).otherwise(F.col("cells"))).where("cells IS NOT NULL").drop("text")
    return rows.select("page_id", "block", "role", "card").distinct(), _cut(parts)


class Pages:
    """Officer pages: ``pages`` has an id, the page's address and its HTML.  Lines are read and told once, for fields and photos.

    ``blanks``: values that stand for none, in lower case; empty where any word may be a value.
    """

    def __init__(self, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", recover: bool = True, blanks: tuple[str, ...] = BLANK_VALUES):
        self.blanks = blanks
        self.lines = held(_lines(streams(pages, id_col, url_col, html_col, recover)), "lines")
        self.blocks = held(_blocks(self.lines), "blocks")

    def fields(self) -> DataFrame:
        """page_id, role, block, card, field, value, state, pos, names, name: the six fields of each role that a page has."""
        rowed = _row_lines(self.lines)
        by_row = rowed.select("page_id", "block").distinct()
        names = _PARTS.split(", ")
        parts = held(_block_lines(self.lines, self.blocks.join(by_row, ["page_id", "block"], "left_anti")).select(*names).unionByName(rowed.select(*names)), "parts")
        plain_blocks, plain_parts = _plain_blocks(self.lines)
        plain_parts = held(plain_parts.select(*names), "parts")
        found = _states(self.blocks, parts, _labelled(parts), self.blanks)
        plain = _states(plain_blocks, plain_parts, _labelled(plain_parts), self.blanks, plain=True).where("name <> ''")
        best = Window.partitionBy("page_id", "role").orderBy(named(F.col("name"), self.blanks).desc(), (F.col("name") != "").desc(), F.col("card").desc(), "block")
        return found.unionByName(plain).withColumn("r", F.dense_rank().over(best)).where("r = 1").drop("r")

    def photos(self) -> DataFrame:
        return _photos(self.lines, self.blocks, self.fields(), self.blanks)


def _photos(lines: DataFrame, blocks: DataFrame, found: DataFrame, blanks: tuple[str, ...] = BLANK_VALUES) -> DataFrame:
    """page_id, role, url, flag: the photo of each role with a name, of those inside its block the nearest to its first field; if no block of the
    page has one, that one image outside whose name, title or file names the officer or the role.  An image that two names claim is nobody's.
    """
    images = lines.select("page_id", F.explode("images").alias("x")).select("page_id", "x.*")
    images = images.withColumn("reject", reject_reason(*(F.col(c) for c in ("url", "alt", "title", "width", "height"))))
    roles = found.groupBy("page_id", "role", "block", "card", "name").agg(F.min("pos").alias("anchor"))
    reach = roles.join(blocks.select("page_id", "block", "from", "to"), ["page_id", "block"])
    at = reach.join(images.withColumnRenamed("page_id", "p"), (F.col("page_id") == F.col("p")) & (F.col("pos") > F.col("from")) & (F.col("pos") < F.col("to")))
    taken = at.select("page_id", "pos", "url").distinct()
    good = at.where((F.col("reject") == "") & named(F.col("name"), blanks))
    nearest = Window.partitionBy("page_id", "role").orderBy(F.abs(F.col("pos") - F.coalesce("anchor", "from")), "pos", "url")
    inside = good.withColumns({"r": F.row_number().over(nearest), "n": F.count("*").over(Window.partitionBy("page_id", "role"))}).where("r = 1")
    inside = inside.select("page_id", "role", "name", "url", F.when(F.col("n") > 1, "photo_multiple_in_block").otherwise("").alias("flag"))

    some = inside.select("page_id").distinct()
    pages = reach.groupBy("page_id").agg(F.min("card").alias("cards")).where("NOT cards").join(some, "page_id", "left_anti")
    outside = images.where("reject = ''").join(taken, ["page_id", "pos", "url"], "left_anti").select("page_id", "url", "alt", "title")
    asked = reach.join(pages, "page_id", "left_semi").where(named(F.col("name"), blanks)).join(outside, "page_id")
    hay = F.lower(F.concat_ws(" ", F.regexp_extract("url", r"([^/?#]*)(?:[?#].*)?$", 1), "alt", "title"))
    own = squashed(F.regexp_replace("name", r"\([^)]*\)", ""))
    number = T.digits_only(F.regexp_extract("name", r"\(([০-৯0-9]{3,})\)", 1))
    words = reduce(lambda w, r: w.when(F.col("role") == r, _holds(hay, ROLE_WORDS[r])), ROLES[1:], F.when(F.col("role") == ROLES[0], _holds(hay, ROLE_WORDS[ROLES[0]])))
    hit = ((F.length(own) >= 4) & F.contains(squashed(hay), own)) | ((number != "") & F.contains(T.digits_only(hay), number)) | words
    hits = asked.where(hit).groupBy("page_id", "role", "name").agg(F.count("*").alias("n"), F.min("url").alias("url"))
    gallery = hits.where("n = 1").select("page_id", "role", "name", "url", F.lit("photo_from_gallery_by_label").alias("flag"))

    chosen = inside.unionByName(gallery)
    claims = chosen.groupBy("page_id", "url").agg(F.count_distinct(squashed(F.col("name"))).alias("names"))
    chosen = chosen.join(claims, ["page_id", "url"])
    return chosen.select("page_id", "role", F.when(F.col("names") == 1, F.col("url")).alias("url"), F.when(F.col("names") > 1, "photo_duplicate").otherwise(F.col("flag")).alias("flag"))
