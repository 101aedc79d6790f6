"""Whether text is sound: Unicode, in legacy font codes, or broken; and checks of recovered values.

Words are judged in Arrow batches, each distinct word of a task once, as a word takes a dozen patterns."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import held, ship
from . import text as T

EMPTY, ENGLISH, UNICODE, LEGACY, BROKEN, MIXED, UNKNOWN = "EMPTY", "ENGLISH_OK", "UNICODE_OK", "BIJOY_ANSI", "VISUAL_ORDER_BROKEN", "MIXED", "UNKNOWN"
STORABLE = (ENGLISH, UNICODE)

# Fixed values.
LETTER, BLOCK = "[অ-হৎড়-ৡৰৱ]", "[ঀ-৿]"
#: Dependent vowel signs, the joiner, and other signs.
VOWELS, JOINER, SIGNS = "া-ৌৗৢৣ", "্", "ঁংঃ়"
#: Characters of legacy codes that aren't ordinary typography.
SIGNATURE = "[¡-ÿ†‡ˆ‰ŠšŒœŸƒ„…‹›˜™¯]"
EMAIL, URL, PHONE = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$", r"^(https?://|www\.)\S+$", r"^[+()\d\s./-]{5,}$"
#: Surnames with a capital inside.
CAPITAL_INSIDE, SURNAMES = "[a-z][A-Z]", "^(Mc|Mac|De|Di|La|Le|O')[A-Z][a-z]+$"
#: Abbreviations without a vowel that English text has.
VOWELLESS = (
    "mr mrs ms dr st md mst ltd phd bcs ndc psc hq dc pwd bd rd nd th sq jr sr engr cc bcc pbx tnt fax tel cell mob by my dy secy gm dgm agm dg ddg addl jt pps ps "
    "apps aps spl vc pvc rtd mph mbbs llb llm bsc msc mss mba nbr nsi dmp cmp rmp rab bgb bpdb lgd lged dncc dscc ctg jpg png pdf xls xlsx doc docx ppt pptx txt csv svg gif bmp "
    "html php www http https kb mb gb km mm cm kg no nos"
).split()
#: Families of legacy fonts, by the start of their names.
FONTS = ("sutonny", "bijoy", "adarsha", "sulekha", "sunetra", "shree", "nikoshban", "chandrabati", "kongsho")
#: Zero-width and direction marks that go; joiners and non-joiners stay, as they mean something in Bengali.
MARKS = "[\u200b\u2060\ufeff\u00ad\u200e\u200f\u202a-\u202e\u2066-\u2069]"


#: Faults inside a Bengali word without joiners and non-joiners, by name.
FAULTS = {
    "double_matra": f"[{VOWELS}][{VOWELS}]",
    "hasanta_before_mark": f"{JOINER}[{VOWELS}{JOINER}{SIGNS}]",
    "leading_mark": f"(^|[^ঀ-৿])[{VOWELS}{JOINER}ঁং়]",
    "matra_before_hasanta": f"[{VOWELS}]{JOINER}",
}
#: An r with a joiner that nothing follows: text in the order of sight.
DETACHED = f"র{JOINER}([^ঀ-৿\u200c\u200d]|$)"
#: Words that a task remembers, and the most characters of one.
KNOWN, MOST_KNOWN = 1 << 18, 64
_SIGNATURE, _LETTER, _BLOCK, _MARKS = (re.compile(x) for x in (SIGNATURE, LETTER, BLOCK, MARKS))
_FAULTS = {name: re.compile(p) for name, p in FAULTS.items()}
_DETACHED = re.compile(DETACHED)
_ENGLISH = re.compile(f"{EMAIL}|(?i:{URL})|{PHONE}")


def plain(text: str | None) -> str:
    """NFC, white space as single blanks, marks dropped; null as empty."""
    return " ".join(_MARKS.sub("", unicodedata.normalize("NFC", text or "")).split())


def evidence(token: str) -> str:
    """strong, weak or empty: how much a token without Bengali letters looks like legacy codes.

    Strong: a signature character, a capital after a small letter, a backtick, a bar after a letter.  Weak: letters without a vowel that are
    neither capitals only nor a known abbreviation.
    """
    if _SIGNATURE.search(token):
        return "strong"
    inner = re.sub(r"^\W+|\W+$", "", token)
    if not inner or inner.isdigit() or _ENGLISH.match(token):
        return ""
    core = re.sub(r"""^[(\["']+|[)\]"'.,;:!?]+$""", "", token)
    letters = re.sub("[^A-Za-z]", "", core)
    if not letters:
        return "strong" if "`" in core or core.endswith("|") else ""
    if (re.search(CAPITAL_INSIDE, core) and not re.match(SURNAMES, core)) or "`" in core or re.search(r"\w\|", core):
        return "strong"
    if letters.isupper() or len(letters) < 2 or re.search("[aeiouyAEIOUY]", letters) or letters.lower() in VOWELLESS:
        return ""
    return "weak"


def word_faults(word: str) -> tuple[str, ...]:
    """Names of the faults of a word that has Bengali signs."""
    bare = re.sub("[\u200c\u200d]", "", word)
    found = [name for name, p in _FAULTS.items() if p.search(bare)]
    return (*found, *(["detached_reph"] if _DETACHED.search(word) else []), *(["replacement_char"] if "\ufffd" in word else []))


def legacy_font(font: str | None) -> bool:
    """Whether a list of font families, or an embedded font's name with its prefix, names a legacy one."""
    names = (re.sub("^[a-z]{6}\\+", "", x.strip().strip("'\"")) for x in (font or "").lower().split(","))
    return any(x.replace(" ", "").startswith(FONTS) for x in names)


class _Words(dict):
    """What is known of words, as far as it is remembered: faults of words with Bengali signs, evidence of others."""

    def __missing__(self, word: str):
        out = word_faults(word) if _BLOCK.search(word) else evidence(word)
        if len(word) <= MOST_KNOWN:
            if len(self) >= KNOWN:
                self.clear()
            self[word] = out
        return out


#: The words that a worker has met.
known = _Words()


def judged(text: str | None, font: str | None, words: _Words) -> tuple[str, list[str]]:
    """The class of a text and the faults of its Bengali words."""
    text = plain(text)
    if not text:
        return EMPTY, []
    tokens = text.split(" ")
    if not _BLOCK.search(text):
        faults = ["replacement_char"] if "\ufffd" in text else []
        if legacy_font(font):
            return LEGACY, faults
        marks = list(map(words.__getitem__, tokens))
        strong, weak, signs = marks.count("strong"), marks.count("weak"), len(_SIGNATURE.findall(text))
        if faults:
            return UNKNOWN, faults
        if signs >= 2 or (strong and 2 * strong + weak >= len(tokens)):
            return (UNKNOWN if len(tokens) == 1 and not signs else LEGACY), []
        return (UNKNOWN if strong or weak else ENGLISH), []
    broken = {"replacement_char"} if "\ufffd" in text else set()
    for found in set(map(words.__getitem__, tokens)):
        if type(found) is tuple:  # a word with Bengali signs
            broken.update(found)
    faults = sorted(broken)
    if legacy_font(font):
        return (MIXED if _LETTER.search(text) else LEGACY), faults
    if "\ufffd" in text:
        return BROKEN, faults
    return (MIXED if _SIGNATURE.search(text) else BROKEN if faults else UNICODE), faults


def classify(c: Column, font: Column | None = None) -> Column:
    """A struct of ``kind``, one of seven classes, and ``faults``, the names of what is wrong with the Bengali words, sorted.

    ``font``: the font that the text is set in, if known.  Every distinct word of a task is judged once.
    """
    ship(SparkSession.active())

    @F.arrow_udf("struct<kind string, faults array<string>>")
    def run(texts: pa.Array, fonts: pa.Array) -> pa.Array:
        out = [judged(t, f, known) for t, f in zip(texts.to_pylist(), fonts.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array([k for k, _ in out], pa.string()), pa.array([f for _, f in out], pa.list_(pa.string()))], ["kind", "faults"])

    return run(c, F.lit(None).cast("string") if font is None else font)


#: Most words of a lexicon that are sent with the tasks; beyond it they are shuffled.
MOST_WORDS = 1_000_000


def lexicon_ratio(rows: DataFrame, key: str, text: str, lexicon: DataFrame, word: str) -> DataFrame:
    """``key`` and ``ratio``, the share of a text's words that the lexicon has, repeats counted; 1 for texts without words.

    The lexicon's words are counted; while they are few they go to the texts' tasks, so that two numbers a text are shuffled.  Else words are
    counted a text before they are joined, so a text sends each of its words once.
    """
    known = lexicon.select(F.col(word).alias("_w")).where(F.col("_w").rlike(LETTER)).distinct().withColumn("_known", F.lit(1))
    known = held(known, "lexicon")
    few = known.limit(MOST_WORDS + 1).count() <= MOST_WORDS
    each = rows.select(key, F.explode_outer(F.split(F.col(text), "[^\\p{IsBengali}\u200c\u200d]+")).alias("_w"))
    each = each.withColumn("_n", F.lit(1)) if few else each.groupBy(key, "_w").agg(F.count("*").alias("_n"))
    found = each.join(F.broadcast(known) if few else known, "_w", "left")
    sums = [F.sum(F.when(c, F.col("_n")).otherwise(0)) for c in (F.col("_known") == 1, F.col("_w").rlike(LETTER))]
    return found.groupBy(key).agg(*(c.alias(k) for c, k in zip(sums, ("_hit", "_all"), strict=True))).select(key, F.when(F.col("_all") > 0, F.col("_hit") / F.col("_all")).otherwise(F.lit(1.0)).alias("ratio"))


def _common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], left + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def _folded(c: Column) -> Column:
    return F.trim(F.regexp_replace(T.unicode_form(F.coalesce(c, F.lit(""))), r"\s+", " "))


def likeness(a: Column, b: Column) -> Column:
    """Twice the letters that two readings have in common, in order, over all their letters as readers count them; 1 for two empty ones."""
    ship(SparkSession.active())

    @F.arrow_udf("double")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        import regex

        out = []
        for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True):
            p, q = regex.findall(r"\X", p), regex.findall(r"\X", q)
            out.append(2 * _common(p, q) / (len(p) + len(q)) if p or q else 1.0)
        return pa.array(out, pa.float64())

    return run(_folded(a), _folded(b))


#: Fields that need a second reading, and those whose words must be known.
HIGH_RISK, KNOWN_WORDS = ("Officer_Name", "Phone", "Mobile", "Email"), ("Designation", "Address")
LEAST_KNOWN, LEAST_ALIKE = 0.70, 0.92


def recovered_faults(field: Column, value: Column, second: Column, ratio: Column) -> Column:
    """Why a value that wasn't read as clean Unicode can't be stored, as a list; empty if it can.  ``second``: what another reader read,
    ``ratio``: the share of its words that the lexicon has.  A field at high risk without a second reading fails."""
    value = _folded(value)
    base = F.regexp_replace(field, "^(Primary|Alternate|Appellate)_", "")
    kind, risky = classify(value), base.isin(*HIGH_RISK)
    alike = likeness(value, second)
    asked = (risky | (base == "Designation")) & second.isNotNull()
    phone, mail = base.isin("Phone", "Mobile"), base == "Email"
    rules = [
        F.when(~kind["kind"].isin(*STORABLE), F.concat(F.lit("class_"), kind["kind"])),
        F.when(F.size(kind["faults"]) > 0, F.lit("invalid_words")),
        F.when(base.isin(*KNOWN_WORDS) & (ratio < LEAST_KNOWN), F.lit("lexicon_ratio")),
        F.when(risky & second.isNull(), F.lit("no_second_reading")),
        F.when(asked & phone & (T.digits_only(value) != T.digits_only(second)), F.lit("digits_disagree")),
        F.when(asked & mail & (F.lower(value) != F.lower(_folded(second))), F.lit("email_disagree")),
        F.when(asked & ~phone & ~mail & (alike < LEAST_ALIKE), F.lit("second_reading_similarity")),
    ]
    return F.when(value == "", F.array(F.lit("empty"))).otherwise(F.array_compact(F.array(*rules)))
