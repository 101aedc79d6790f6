"""Gates on directory rows, entities, feed items and extractions: tiers, exemptions, retry times, grounding and completeness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .quality import looks_blocked

#: Marks in the names of field offices, ministries and agencies.
FIELD_OFFICES = ("জেলা প্রশাসক", "বিভাগীয় কমিশনার")
MINISTRY, DIVISION = "মন্ত্রণালয়", "বিভাগ"
AGENCY = "অধিদপ্তর|অধিদফতর|পরিদপ্তর|দপ্তর|ব্যুরো|পুলিশ|কার্যালয়|সদর দপ্তর|হেডকোয়ার্টার্স|ইনস্টিটিউট"
#: States after which a row isn't due again, and those of them that a forced retry takes.
DONE, THIN = ("complete", "partial", "sparse", "page_blank", "exempt"), ("sparse", "page_blank")
#: Words that stand for no entity.
GENERIC = r"^(person|org|organization|loc|location|entity|keyword|stakeholder|name|ministry|office)\s*[0-9]*$"
NOTHING = r"^(n/?a|none|null|unknown|not found|unspecified)$"
KINDS = "^(news|article|report|summary)$"
BODIES = "^(সরকার|মন্ত্রণালয়|মন্ত্রণালয়|বিভাগ|দপ্তর)$"
#: Fact checkers, their domains, and titles of corrections.
CHECKERS = ("rumor scanner", "রিউমর স্ক্যানার", "factwatch", "fact-watch", "ফ্যাক্টওয়াচ", "dismislab", "ডিসমিসল্যাব", "afp fact check", "এএফপি ফ্যাক্টচেক", "boom bangladesh", "boom bd", "বুম বাংলাদেশ")
CHECKER_DOMAINS = ("rumorscanner.com", "fact-watch.org", "dismislab.com", "factcheck.afp.com", "boombd.com")
CORRECTION = "কোনো মন্তব্য করেননি|দাবিটি সত্য নয়|ভুয়া|গুজব|মিথ্যা দাবি|বিভ্রান্তিকর|ফ্যাক্টচেক|ফ্যাক্ট চেক|fact[- ]?check|false claim|misleading"


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def tier(ministry: Column, division: Column, office: Column) -> Column:
    """4: field offices; 1: ministries and divisions; 2: agencies; 3: others."""
    level = (office == ministry) | (office == division) | office.endswith(MINISTRY)
    return F.when(_any([F.contains(office, F.lit(x)) for x in FIELD_OFFICES]), 4).when(level, 1).when(office.rlike(AGENCY), 2).otherwise(3)


def exemption(office: Column, division: Column, deny: tuple[str, ...], manual: tuple[str, ...]) -> Column:
    """exempt, manual_review or blank, by names that the squashed office and division hold."""
    hay = T.squashed(F.concat_ws(" ", office, division))
    holds = lambda names: _any([F.contains(hay, T.squashed(F.lit(n))) for n in names]) if names else F.lit(False)
    return F.when(holds(deny), "exempt").when(holds(manual), "manual_review").otherwise("")


def due(status: Column, next_retry: Column, now: Column, retry_failed: bool = False) -> Column:
    """Whether a row is to be fetched: never seen, or not waiting for its retry time and not done; a forced retry takes thin pages too."""
    waiting = F.lit(False) if retry_failed else F.coalesce(next_retry > now, F.lit(False))
    done = F.coalesce(status.isin(*[s for s in DONE if not (retry_failed and s in THIN)]), F.lit(False))
    return status.isNull() | (~waiting & ~done)


def invalid_entity(text: Column, most: int = 96) -> Column:
    """Too short or long, a URL, digits and signs alone, or a word that stands for no entity."""
    t = F.trim(F.coalesce(text, F.lit("")))
    low = F.lower(t)
    return (F.length(t) < 2) | (F.length(t) > most) | low.rlike("^https?://") | ~t.rlike(r"[^0-9\s!-/:-@\[-`{-~]") | _any([low.rlike(p) for p in (GENERIC, NOTHING, KINDS, BODIES)])


def is_fact_check(source: Column, url: Column, title: Column) -> Column:
    src, at = F.lower(F.coalesce(source, F.lit(""))), F.lower(F.coalesce(url, F.lit("")))
    return _any([F.contains(src, F.lit(n)) for n in CHECKERS] + [F.contains(at, F.lit(d)) for d in CHECKER_DOMAINS] + [F.lower(F.coalesce(title, F.lit(""))).rlike(CORRECTION)])


def grounded(field: Column, value: Column, text: Column) -> Column:
    """Whether the value stands in the text: phones by five digits or more, within a line or across, e-mails in any case, others as they are."""
    v, t = F.trim(F.regexp_replace(value, r"\s+", " ")), F.regexp_replace(text, r"[^\S\n]+", " ")
    digits = T.digits_only(v)
    phone = (F.length(digits) >= 5) & F.contains(T.digits_only(t), digits)
    found = F.when(field.isin("Phone", "Mobile"), phone).when(field == "Email", F.contains(F.lower(t), F.lower(v))).otherwise(F.contains(F.regexp_replace(t, r"\s+", " "), v))
    return F.coalesce((v != "") & found, F.lit(False))


def low_quality(title: Column, text: Column, boilerplate: Column, least: int = 50) -> Column:
    """Whether an extraction should be tried another way: blocked, boilerplate or hardly any text."""
    return F.coalesce(looks_blocked(title, text) | boilerplate | (F.length(text) < least), F.lit(True))


def relevance(civic: Column, n_orgs: Column, n_money: Column, n_legal: Column, n_persons: Column) -> Column:
    """A bounded sum: 30 for civic relevance (0 to 1), 15 for an organisation, 5 for each amount up to 25, 20 for a legal point, 10 for a person."""
    points = civic * 30 + F.when(n_orgs > 0, 15).otherwise(0) + F.least(n_money * 5, F.lit(25)) + F.when(n_legal > 0, 20).otherwise(0) + F.when(n_persons > 0, 10).otherwise(0)
    return F.least(F.floor(points + 0.5), F.lit(100)).cast("int")


def compared(a: Column, b: Column) -> Column:
    """Two texts, normalised to NFC and single blanks: whether they match, both digests, and the shared part of the smaller word set; null
    where one is blank."""
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(T.unicode_form(F.coalesce(c, F.lit(""))), T.INVISIBLE, ""), r"\s+", " "))
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), " "), lambda w: F.length(w) > 1))

    def share(x: Column, y: Column) -> Column:
        part = F.size(F.array_intersect(x, y)) / F.greatest(F.lit(1), F.least(F.size(x), F.size(y)))
        return F.round(part, 2)

    def row(x: Column, y: Column) -> Column:
        # Equal texts have the same digest and words.
        of_x, same = F.sha2(x, 256), x == y
        alike = T.let(words(x), lambda v: F.when(same, F.when(F.size(v) > 0, 1.0).otherwise(0.0)).otherwise(T.let(words(y), lambda w: share(v, w))))
        out = T.let(of_x, lambda d: F.struct(same.alias("match"), d.alias("a_sha256"), F.when(same, d).otherwise(F.sha2(y, 256)).alias("b_sha256"), alike.alias("overlap")))
        return F.when((x != "") & (y != ""), out)

    return T.let(F.struct(clean(a).alias("x"), clean(b).alias("y")), lambda z: row(z["x"], z["y"]))


def path_counts(events: DataFrame, path: str, part: str = "/api/", top: int = 15) -> DataFrame:
    """The ``top`` lower-case paths that hold ``part``, by count; ties by path."""
    low = F.lower(F.col(path))
    return events.where(F.contains(low, F.lit(part))).groupBy(low.alias("path")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "path").limit(top)


def similar(items: DataFrame, reference: DataFrame, words: Column, least: float, top: int, group: str) -> DataFrame:
    """items (group, link, host, text) scored against each group's reference (group, host, ref words): Jaccard to two places, above
    ``least``, the first of links equal by case, the ``top`` best, and whether they are of the reference's host.

    Every item meets its own group's reference alone.
    """
    scored = items.join(reference, group).withColumn("similarity", F.round(T.jaccard(words, F.col("ref")), 2)).where(F.col("similarity") > least)
    once = scored.groupBy(group, F.lower("link").alias("link")).agg(F.max(F.struct("similarity", (F.col("host") == F.col("ref_host")).alias("same_host"))).alias("x")).select(group, "link", "x.*")
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.col("similarity").desc(), "link"))
    return once.withColumn("rank", rank).where(F.col("rank") <= top)
