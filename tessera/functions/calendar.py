"""Working days (Friday and Saturday are free), deadlines, dates in text and date scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T


def add_working_days(day: Column, n: int) -> Column:
    """The ``n``-th working day after ``day``.

    Five of seven days are working days, so whole weeks are added at once and at most nine days are looked at for the rest.
    """
    weeks, rest = divmod(n, 5)
    if rest == 0:
        weeks, rest = weeks - 1, 5
    start = F.date_add(day, 7 * weeks)
    days = F.filter(F.sequence(F.date_add(start, 1), F.date_add(start, 9)), lambda d: ~F.dayofweek(d).isin(6, 7))
    return F.get(days, rest - 1)


def dhaka_date(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, "Asia/Dhaka"))


def date_score(age_days: Column) -> Column:
    """1 within a day and a half, falling to 0 over six days more; 0.5 without a date."""
    score = F.when(age_days <= 1.5, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1.0 - (age_days - 1.5) / 6.0))
    return F.when(age_days.isNotNull(), score).otherwise(F.lit(0.5))


def relationship(days: Column, similarity: Column) -> Column:
    """How two reports relate by days between them and similarity."""
    return (
        F.when(days.isNull(), "unknown")
        .when((days < -14) & (similarity >= 0.35), "background")
        .when((days > 3) & (similarity >= 0.35), "follow_up")
        .when(similarity >= 0.6, "same_event")
        .when(similarity >= 0.35, "related")
        .otherwise("context")
    )


def iso_dates(text: Column) -> Column:
    """Distinct dates written as YYYY-MM-DD that exist."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\b([0-9]{4}-[0-9]{2}-[0-9]{2})\b"), F.lit(1)), lambda d: F.try_to_date(d, "yyyy-MM-dd"))
    return F.array_distinct(F.filter(found, lambda d: d.isNotNull()))


#: Months in two languages, in order, with their other spellings.
BENGALI_MONTHS = ("জানুয়ারি", "ফেব্রুয়ারি", "মার্চ", "এপ্রিল", "মে", "জুন", "জুলাই", "আগস্ট", "সেপ্টেম্বর", "অক্টোবর", "নভেম্বর", "ডিসেম্বর")
ENGLISH_MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
OTHER_MONTHS = {"জানুয়ারী": 1, "ফেব্রুয়ারী": 2, "অগাস্ট": 8}
#: The ways a date is written, in the order they are looked for.
_BN, _EN = "|".join(BENGALI_MONTHS), "|".join(ENGLISH_MONTHS)
DATE_PATTERNS = (
    rf"[১-৩]?[০-৯]\s*(?:{_BN})[,\s]*[১-২][০-৯]{{3}}",
    rf"(?i)[0-9]{{1,2}}\s*(?:{_EN})[,\s]*[0-9]{{4}}",
    rf"(?i)(?:{_EN})\s+[0-9]{{1,2}},?\s+[0-9]{{4}}",
    r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b",
    r"গতকাল|আজ|আগামীকাল|গত\s+(?:সোম|মঙ্গল|বুধ|বৃহস্পতি|শুক্র|শনি|রবি)বার|গত\s+সপ্তাহ|গত\s+মাস",
)


def written_dates(text: Column, most: int = 10) -> Column:
    """The first ``most`` dates as they are written, by pattern and place, without repeats by case."""
    found = T.let(text, lambda t: F.concat(*[F.regexp_extract_all(t, F.lit(p), F.lit(0)) for p in DATE_PATTERNS]))
    return T.without_repeats(found, most)


def events_of(text: Column, dates: Column) -> Column:
    """Each written date with its surroundings: ten characters before it and a hundred after, 160 at most."""
    def near(t: Column, d: Column, at: Column) -> Column:
        start = F.greatest(F.lit(1), at - 10)
        return F.substring(t, start, at - start + F.length(d) + 100)

    def one(t: Column, d: Column) -> Column:
        around = T.let(F.instr(t, d), lambda at: near(t, d, at))
        return F.struct(d.alias("date"), F.substring(F.trim(F.regexp_replace(around, r"\s+", " ")), 1, 160).alias("event"))

    return T.let(text, lambda t: F.transform(dates, lambda d: one(t, d)))


def updated_on(text: Column) -> Column:
    """The date after a label such as "last updated": digits as D-M-Y or Y-M-D (years of two digits are of this century), or with a month's name."""
    label = r"(?is)(?:শেষ\s*হাল[-\s]?নাগাদ|সর্বশেষ\s*হাল[-\s]?নাগাদ|last\s*updated)[^:ঃ]{0,20}[:ঃ]?\s*([^\n]{0,60})"
    raw = F.translate(F.trim(F.regexp_replace(F.regexp_extract(text, label, 1), r"\s+", " ")), "০১২৩৪৫৬৭৮৯", "0123456789")
    digits = F.regexp_extract(raw, r"[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}", 0)
    parts = F.split(digits, "[-/.]")
    first = F.length(F.get(parts, F.lit(0))) == 4
    year = F.when(first, F.get(parts, F.lit(0))).otherwise(F.get(parts, F.lit(2)))
    year = F.when(F.length(year) <= 2, F.concat(F.lit("20"), F.lpad(year, 2, "0"))).otherwise(year)
    day = F.when(first, F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(0)))
    numeric = F.try_to_date(F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(F.get(parts, F.lit(1)), 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")
    months = {**{m.lower(): i for i, m in enumerate(ENGLISH_MONTHS, 1)}, **{m: i for i, m in enumerate(BENGALI_MONTHS, 1)}, **OTHER_MONTHS}
    named = rf"(?i)([0-9]{{1,2}})\s*({'|'.join(sorted(months, key=len, reverse=True))}),?\s*([0-9]{{4}})"
    number = F.element_at(F.create_map(*[F.lit(x) for pair in months.items() for x in pair]), F.lower(F.regexp_extract(raw, named, 2)))
    by_name = F.try_to_date(F.concat_ws("-", F.regexp_extract(raw, named, 3), F.lpad(number.cast("string"), 2, "0"), F.lpad(F.regexp_extract(raw, named, 1), 2, "0")), "yyyy-MM-dd")
    return F.when(digits != "", numeric).when(F.regexp_extract(raw, named, 0) != "", by_name)


def is_stale(day: Column, today: Column, most: int = 365) -> Column:
    return F.coalesce(F.datediff(today, day) > most, F.lit(False))
