"""Amounts of money in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

#: Units and what they multiply by.
UNITS = {"thousand": 1e3, "lakh": 1e5, "million": 1e6, "crore": 1e7, "billion": 1e9}
PATTERN = r"([0-9][0-9,]*(?:\.[0-9]+)?) (thousand|lakh|million|crore|billion)"


def amounts(text: Column, most: int = 20) -> Column:
    """The first ``most`` amounts with a unit, as numbers."""
    numbers = F.regexp_extract_all(F.lower(text), F.lit(PATTERN), F.lit(1))
    units = F.regexp_extract_all(F.lower(text), F.lit(PATTERN), F.lit(2))
    scale = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    value = F.zip_with(numbers, units, lambda n, u: F.regexp_replace(n, ",", "").cast("double") * F.element_at(scale, u))
    return F.slice(value, 1, most)


#: Units, currencies and the ways an amount is written, in the order they are looked for.
BENGALI_UNITS = {"কোটি": 1e7, "লাখ": 1e5, "লক্ষ": 1e5, "হাজার": 1e3, "মিলিয়ন": 1e6, "বিলিয়ন": 1e9}
_BN, _EN = "|".join(BENGALI_UNITS), "crore|lakh|million|billion|thousand"
WAYS = (
    rf"(?i)৳?\s*[0-9,৳০-৯]+(?:[.,][0-9]+)?\s*(?:{_BN})\s*(?:টাকা|ডলার|ইউরো|পাউন্ড|রুপি)?",
    rf"(?i)[0-9,]+(?:\.[0-9]+)?\s*(?:{_EN})\s*(?:taka|BDT|dollar|USD|EUR|GBP)?",
    r"(?i)(?:৳|BDT|Tk\.?)\s*[0-9,]+(?:\.[0-9]+)?",
)
CURRENCY = r"(?i)টাকা|৳|ডলার|ইউরো|পাউন্ড|রুপি|\btk\b|taka|usd|\$|€|£"
AFTER = r"(?i)^[\s০-৯0-9,.]*(?:(?:হাজার|লাখ|লক্ষ|কোটি|million|billion|crore|lakh)[\s০-৯0-9,.]*)*(?:টাকা|৳|ডলার|ইউরো|পাউন্ড|রুপি|tk|taka|usd)"


def mentions(text: Column, most: int = 20) -> Column:
    """The first ``most`` amounts (amount, value, currency), by way of writing and place, without repeats by case."""
    found = T.let(text, lambda t: F.transform(F.concat(*[F.regexp_extract_all(t, F.lit(p), F.lit(0)) for p in WAYS]), lambda x: F.trim(x)))
    scale = F.create_map(*[F.lit(x) for pair in {**UNITS, **BENGALI_UNITS}.items() for x in pair])

    def one(x: Column) -> Column:
        number = F.regexp_extract(F.regexp_replace(F.translate(x, "০১২৩৪৫৬৭৮৯", "0123456789"), "[,৳]", ""), r"[0-9]+(?:\.[0-9]+)?", 0)
        unit = F.lower(F.regexp_extract(x, rf"(?i){_BN}|{_EN}", 0))
        value = F.floor(F.coalesce(F.nullif(number, F.lit("")).cast("double"), F.lit(0.0)) * F.coalesce(F.try_element_at(scale, unit), F.lit(1.0)) + 0.5)
        currency = F.when(x.rlike("(?i)ডলার|dollar|USD"), "USD").when(x.rlike("(?i)ইউরো|EUR"), "EUR").when(x.rlike("(?i)পাউন্ড|GBP"), "GBP").otherwise("BDT")
        return F.struct(x.alias("amount"), value.alias("value"), currency.alias("currency"))

    return F.transform(T.without_repeats(found, most), one)


def with_currency(text: Column, found: Column, most: int = 6) -> Column:
    """The amounts of ``mentions`` that carry a currency or have one after them, which is then part of the phrase; of amounts within one
    another the longest."""
    def whole(t: Column, x: Column) -> Column:
        tail = F.regexp_extract(F.substring(t, F.instr(t, x["amount"]) + F.length(x["amount"]), F.lit(45)), AFTER, 0)
        phrase = T.let(tail, lambda r: F.when(r != "", F.trim(F.regexp_replace(F.concat(x["amount"], r), r"\s+", " "))))
        return F.when(x["amount"].rlike(CURRENCY), x["amount"]).otherwise(phrase)

    named = T.let(text, lambda t: F.array_compact(F.transform(found, lambda x: whole(t, x))))
    return T.let(named, lambda n: F.slice(F.filter(n, lambda a: ~F.exists(n, lambda b: (b != a) & F.contains(b, a))), 1, most))
