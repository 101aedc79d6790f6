"""Projections of records: names and ranks, roles, sentences, devices, notices and certificates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

#: Roles of a directory row, fields of a role, and words by which a rank is told from a name.
ROLES, FIELDS = ("Primary", "Alternate", "Appellate"), ("Name", "Designation", "Phone", "Mobile", "Email")
RANKS = "secretary|director|officer|minister|commissioner|chairman|engineer|manager|সচিব|পরিচালক|কর্মকর্তা|মন্ত্রী|কমিশনার|চেয়ারম্যান|প্রকৌশলী"
#: Browsers and systems by their mark in a user agent, in the order they are looked for.
BROWSERS = (("Edg/", "Edge"), ("OPR/", "Opera"), ("Chrome/", "Chrome"), ("Firefox/", "Firefox"), ("Safari/", "Safari"))
SYSTEMS = (("Android", "Android"), ("iPhone", "iOS"), ("iPad", "iOS"), ("Windows", "Windows"), ("Mac OS X", "macOS"), ("Linux", "Linux"))


def name_and_rank(c: Column) -> tuple[Column, Column]:
    """Both parts around the first dash, comma, bar or bracket; the one with a rank's word is the rank, else the second."""
    parts = F.split(F.regexp_replace(c, r"[)\]]\s*$", ""), r"\s+[-–—]\s+|\s*[,|(\[]\s*", 2)
    a, b = T.blank_to_null(F.get(parts, F.lit(0))), T.blank_to_null(F.get(parts, F.lit(1)))
    swapped = F.coalesce(F.lower(a).rlike(RANKS) & ~F.lower(b).rlike(RANKS), F.lit(False))
    return F.when(swapped, b).otherwise(a), F.when(swapped, a).otherwise(b)


def roles_filled(role_cols: dict[str, tuple[Column, Column]]) -> Column:
    """Names of the roles that have both a name and an e-mail, comma-joined."""
    return F.array_join(F.array_compact(F.array(*[F.when(T.has_name(n) & F.coalesce(e, F.lit("")).contains("@"), F.lit(r)) for r, (n, e) in role_cols.items()])), ",")


def gated(name: Column, **fields: Column) -> Column:
    """A role's fields, which count only where the role has a name."""
    return F.struct(F.when(T.has_name(name), T.blank_to_null(name)).alias("name"), *[F.when(T.has_name(name), T.blank_to_null(c)).alias(k) for k, c in fields.items()])


def where_given(rows: DataFrame, **wanted: str | None) -> DataFrame:
    """Rows that equal every given value, exactly or normalized; values that aren't given don't matter."""
    given = [(F.col(c) == v) | (T.normalized(F.col(c)) == T.normalized(F.lit(v))) for c, v in wanted.items() if v]
    return rows.where(reduce(lambda a, b: a & b, given)) if given else rows


def sentence(kind: Column, details: Column, most: int = 180) -> Column:
    """What an activity was, with its details cut to ``most`` characters."""
    said = {"view": "Viewed a page", "click": "Clicked an element", "signup": "Signed up", "purchase": "Made a purchase"}
    verb = reduce(lambda acc, x: F.when(kind == x[0], x[1]).otherwise(acc), said.items(), F.concat(F.lit("Did "), kind))
    short = F.when(F.length(details) > most, F.concat(F.substring(details, 1, most), F.lit("…"))).otherwise(details)
    return F.concat_ws(": ", verb, F.nullif(short, F.lit("{}")))


def device(agent: Column) -> Column:
    """browser, system and kind of device of a user agent."""
    first = lambda marks: reduce(lambda acc, x: F.when(F.contains(agent, F.lit(x[0])), x[1]).otherwise(acc), reversed(marks), F.lit("Unknown"))
    kind = F.when(F.contains(agent, F.lit("iPad")) | F.contains(agent, F.lit("Tablet")), "tablet").when(F.contains(agent, F.lit("Mobile")), "mobile").otherwise("desktop")
    return F.struct(first(BROWSERS).alias("browser"), first(SYSTEMS).alias("system"), kind.alias("kind"))


def notice(rung: Column, asked: Column, resolved: Column) -> Column:
    """What a reader is told about the rung at which officers were found."""
    at = F.when(rung == "office", F.concat(F.lit("Officers of "), asked)).when(rung == "division", F.concat(asked, F.lit(" has no officers; those of its division, "), resolved))
    return at.when(rung == "ministry", F.concat(asked, F.lit(" has no officers; those of its ministry, "), resolved)).otherwise(F.concat(F.lit("No officers are known for "), asked))


def bengali_date(day: Column, months: tuple[str, ...]) -> Column:
    """Day, month's name and year in Bengali."""
    name = F.get(F.array(*map(F.lit, months)), F.month(day) - 1)
    return T.bengali_digits(F.concat_ws(" ", F.day(day).cast("string"), name, F.year(day).cast("string")))


def cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Price of a call; prices are for a million tokens."""
    return F.round((tokens_in * price_in + tokens_out * price_out) / 1e6, 6)


def summaries(text: Column) -> Column:
    """Short, middle and long: the first one, three and five sentences, and the language by its script."""
    parts = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"[^.!?।]+[.!?।]*"), F.lit(0)), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: F.length(x) > 1)
    cut = lambda n: F.array_join(F.slice(parts, 1, n), " ")
    return F.struct(cut(1).alias("short"), cut(3).alias("middle"), cut(5).alias("long"), F.when(text.rlike("[ঀ-৿]"), "bn").otherwise("en").alias("language"))


def gazetteer_key(c: Column) -> Column:
    """For dictionaries: NFC, the joined khanda ta as one letter, invisible characters and hyphens dropped, ASCII digits, other punctuation
    as blanks, lower case."""
    text = F.replace(T.unicode_form(c), F.lit("ত্‍"), F.lit("ৎ"))
    text = F.regexp_replace(T.ascii_digits(F.regexp_replace(text, T.INVISIBLE, "")), "[-‐‑–—]", "")
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, r"[\p{P}\p{S}]", " ")), r"\s+", " "))


def clean_entity(c: Column) -> Column:
    """Without invisible characters, and without punctuation, quotes and brackets at both ends."""
    return F.regexp_replace(F.trim(F.regexp_replace(c, T.INVISIBLE, "")), r"^[\s\p{P}\p{S}]+|[\s\p{P}\p{S}]+$", "")
