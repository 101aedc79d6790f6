"""Text functions as Column expressions; those that Spark lacks are Arrow UDFs.

Blank counts as missing: ``blank_to_null`` is applied at the edges and nulls are kept after that.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

BENGALI_DIGITS, ASCII_DIGITS = "০১২৩৪৫৬৭৮৯", "0123456789"
#: Zero-width characters and the byte order mark.
INVISIBLE = "[​‌‍﻿]"
#: Placeholder names that count as blank.
PLACEHOLDERS = ("test", "n/a", "na", "-")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once.  An expression that stands several times in another may be computed as often, and one inside a
    lambda is computed for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def without_repeats(found: Column, most: int) -> Column:
    """The first ``most`` of the strings, without repeats by case."""
    first = lambda f: let(F.transform(f, F.lower), lambda low: F.slice(F.filter(f, lambda x, i: F.array_position(low, F.lower(x)) == i + 1), 1, most))
    return let(found, first)


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def first_filled(*cols: Column) -> Column:
    """The first value of an alias list that isn't blank."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def normalized(c: Column, form: str | None = None) -> Column:
    """For comparison: invisible characters dropped, white space as single spaces, trimmed, lower case; with ``form`` in that Unicode
    normal form, at the price of a Python step."""
    c = c if form is None else unicode_form(c, form)
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(c, INVISIBLE, ""), r"\s+", " ")))


def squashed(c: Column) -> Column:
    """Normalized, without spaces, colons and dashes."""
    return F.regexp_replace(normalized(c), r"[ :\-]+", "")


def header_name(c: Column) -> Column:
    """A header in canonical form: lower case, anything but letters and digits as one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9ঀ-৿]+", "_"), "^_+|_+$", "")


def ascii_digits(c: Column) -> Column:
    return F.translate(c, BENGALI_DIGITS, ASCII_DIGITS)


def bengali_digits(c: Column) -> Column:
    return F.translate(c, ASCII_DIGITS, BENGALI_DIGITS)


def digits_only(c: Column) -> Column:
    return F.regexp_replace(ascii_digits(c), "[^0-9]", "")


def phone_key(c: Column) -> Column:
    """Digits without the country code 88 and then without the leading zero."""
    return F.regexp_replace(F.regexp_replace(digits_only(c), "^88", ""), "^0", "")


def email_key(c: Column) -> Column:
    """Lower case; ``[at]`` and ``[dot]`` undone, spaces dropped."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(c), r"\s*[\[(]\s*at\s*[\])]\s*", "@"), r"\s*[\[(]\s*dot\s*[\])]\s*", ".")
    return F.regexp_replace(plain, r"\s+", "")


def has_name(c: Column) -> Column:
    """Neither blank nor a placeholder."""
    key = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return (key != "") & ~key.isin(*PLACEHOLDERS)


def tokens(c: Column, least: int = 3) -> Column:
    """Distinct lower-case words of ``least`` or more characters."""
    words = F.split(F.regexp_replace(F.lower(c), "[^a-z0-9À-ɏঀ-৿]+", " "), " ")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= least))


def word_set(c: Column, least: int = 2) -> Column:
    """Distinct lower-case words of letters and digits of any script, of ``least`` or more characters; other signs part words."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s]", " "), r"\s+"), lambda w: F.length(w) >= least))


def numbers_in(c: Column) -> Column:
    """Distinct numbers of two or more characters, in digits of either script, without a sign at the end."""
    found = F.regexp_extract_all(ascii_digits(c), F.lit("([0-9][0-9,.]*)"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda n: F.regexp_replace(n, "[,.]$", "")), lambda n: F.length(n) >= 2))


#: Endings that an index term loses, and words that are no terms.
ENDINGS = ("দের", "গুলো", "গুলি", "টির", "টা", "টি", "এর", "ের", "কে", "তে", "রা", "র", "য়", "ে")
STOPWORDS = (
    "এবং", "ও", "এ", "এই", "সে", "যে", "না", "করে", "হয়", "হয়েছে", "থেকে", "জন্য", "সঙ্গে", "বলে", "দাবি", "দাবিতে", "ভিডিও", "ছবি", "করা", "নিয়ে", "একটি", "তার", "তিনি", "এক", "কি", "কী", "নয়", "ভুয়া", "গুজব", "প্রচার",
    "হচ্ছে", "হলো", "হল", "আর", "বা", "কোনো", "সব", "এর", "তা", "যা", "the", "a", "an", "of", "in", "on", "to", "and", "is", "was", "for", "with", "false", "claim", "video", "photo", "fake", "news",
)
#: Letters that the normal form takes apart.
COMPOSED = ("\u09dc", "\u09dd", "\u09df")
ENDING = f"^(.{{2,}}?)(?:{'|'.join(unicodedata.normalize('NFC', w) for w in ENDINGS)})$"
NO_TERMS = tuple(unicodedata.normalize("NFC", w) for w in STOPWORDS)


def index_terms(c: Column) -> Column:
    """Terms of a text for an index, repeats included: words of letters, marks and digits, in lower case, of four or more characters without the longest
    ending that leaves two; no numbers, stop words or single characters."""
    low = F.lower(c)
    for x in COMPOSED:
        low = F.replace(low, F.lit(x), F.lit(unicodedata.normalize("NFC", x)))
    words = F.split(low, r"[^\p{L}\p{M}\p{N}]+")
    stems = F.transform(words, lambda w: F.when(F.length(w) > 3, F.regexp_replace(w, ENDING, "$1")).otherwise(w))
    stems = F.when(low.rlike("[\u0980-\u09ff]"), stems).otherwise(words)  # endings are Bengali
    number = lambda w: (w >= "0") & (w < ":") & w.rlike("^[0-9]+$")
    return F.filter(stems, lambda w: (F.length(w) > 1) & ~w.isin(*NO_TERMS) & ~number(w))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets' union; 0 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """Shared share of the smaller set."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def place_similarity(a: Column, b: Column) -> Column:
    """Per cent of places with equal characters, of the longer string's length; 0 for two empty strings."""
    x, y = F.split(a, ""), F.split(b, "")
    same = F.aggregate(F.zip_with(x, y, lambda p, q: F.when(p == q, 1).otherwise(0)), F.lit(0), lambda s, v: s + F.coalesce(v, F.lit(0)))
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most > 0, F.floor(100.0 * same / most + 0.5)).otherwise(F.lit(0)).cast("int")


def host(url: Column) -> Column:
    """The host in lower case without ``www.``; null for what is no URL."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def edit_limit(c: Column, share: float) -> Column:
    """Most edits that a fuzzy match of a name of this length may have."""
    return F.greatest(F.lit(1), F.floor(F.length(c) * share)).cast("int")


def collapsed_lines(c: Column) -> Column:
    """No-break spaces and CRs normalised, spaces collapsed, blank lines dropped."""
    text = F.regexp_replace(F.regexp_replace(c, " ", " "), r"\r\n?", "\n")
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def first_words(c: Column, n: int) -> Column:
    return F.array_join(F.slice(F.filter(F.split(c, r"\s+"), lambda x: x != ""), 1, n), " ")


def grapheme_count(c: Column) -> Column:
    """Letters as readers count them."""

    @F.arrow_udf("int")
    def count(values: pa.Array) -> pa.Array:
        import regex

        return pa.array([None if v is None else len(regex.findall(r"\X", v)) for v in values.to_pylist()], pa.int32())

    return count(c)


#: Texts that are in a normal form whatever stands next to what: of characters below the first one that can change.
AS_THEY_ARE = {"NFC": "\\A[\\x{0}-\\x{2FF}]*+\\z", "NFD": "\\A[\\x{0}-\\x{BF}]*+\\z", "NFKC": "\\A[\\x{0}-\\x{9F}]*+\\z", "NFKD": "\\A[\\x{0}-\\x{9F}]*+\\z"}


def unicode_form(c: Column, form: str = "NFC") -> Column:
    """A Unicode normal form, which Spark has no function for.  Texts in ``AS_THEY_ARE`` are in it and don't go to Python."""

    @F.arrow_udf("string")
    def put(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else unicodedata.normalize(form, v) for v in values.to_pylist()], pa.string())

    if form not in AS_THEY_ARE:
        return put(c)
    return F.coalesce(put(F.when(~c.rlike(AS_THEY_ARE[form]), c)), c)


def sentences(c: Column, least: int = 20) -> Column:
    """Sentences of ``least`` or more characters: cut after ``।``, ``!``, ``?`` and quotes, and after a full stop before a space
    unless an abbreviation or an initial stands before it."""
    parts = F.split(c, r"(?<=[।!?][\"'”’]?)\s+|(?<=[^\s.]{3}\.)\s+|\n+")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: F.length(x) >= least)


def tolerant_json(c: Column) -> Column:
    """The JSON in a model's answer, or null: the first fenced block, else from the first to the last bracket; typographic quotes and
    trailing commas mended, byte order marks and zero-width characters dropped."""
    text = F.trim(F.regexp_replace(c, INVISIBLE, ""))
    fenced = F.regexp_extract(text, r"(?is)```+(?:json|javascript|js)?\s*(.*?)```+", 1)
    text = F.when(F.trim(fenced) != "", F.trim(fenced)).otherwise(text)
    text = F.regexp_extract(text, r"(?s)(\{.*\}|\[.*\])", 1)
    text = F.regexp_replace(F.translate(text, "“”", '""'), r",\s*([}\]])", "$1")
    return F.when(F.try_parse_json(text).isNotNull() & (text != ""), text)
