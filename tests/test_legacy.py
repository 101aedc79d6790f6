"""Legacy font codes and text integrity, by known words and by syllables put together at random."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tessera.functions import integrity, legacy
from tessera.plans import registry

DIR = "/root/testdata/sf0.001"


def nfc(s):
    return unicodedata.normalize("NFC", s)


def read(s, digits=True):
    return legacy.read(s, legacy._Words(lambda w: legacy._read_word(w, digits)))


def write(s):
    return legacy.write(s, legacy._Words(legacy._written))


#: Codes and what they say.
WORDS = {
    "I": "ও", "†gvt": "মোঃ", "C`": "ঈদ", "mnKvix": "সহকারী", "Dò": "উষ্ণ", "cÎ": "পত্র", "gš¿Yvjq": "মন্ত্রণালয়", "†KŠkj": "কৌশল", "†jvK": "লোক", "Kg©KZ©v": "কর্মকর্তা",
    "Kvh©vjq": "কার্যালয়", "c~e©eZx©": "পূর্ববর্তী", "G-1": "এ-১", "g~j¨ t UvKv": "মূল্য ঃ টাকা", "KZ…©c¶": "কর্তৃপক্ষ", "Møvm": "গ্লাস", "Avwg": "আমি", "ivóª": "রাষ্ট্র",
    "¯’vb": "স্থান", "mnKvix cwiPvjK": "সহকারী পরিচালক", "h©¨": "র্য্য", "Puv`": "চাঁদ", "P‡u`": "চঁদে",
}


@pytest.mark.parametrize("codes", WORDS)
def test_known_words(codes):
    assert read(codes) == nfc(WORDS[codes])


def test_digits_follow_the_font():
    assert read("G-1", digits=False) == "এ-1"
    assert read("1997 mvj") == "১৯৯৭ সাল"


def syllable(rng):
    """Codes of a syllable as a typist would set them, and the syllable."""
    letters = dict(zip(legacy.LETTERS[legacy.LETTERS.index("ক") : legacy.LETTERS.index("ৎ")], legacy.LETTER_CODES[legacy.LETTERS.index("ক") :], strict=False))
    whole = {c: s for c, s in legacy.GLYPHS.items() if s[0] not in "্-\"'" and s[-1] not in "্ুৃ"}
    halves = {c: s for c, s in legacy.GLYPHS.items() if s[-1] == "্" and s[0] != "্"}
    under = {c: s for c, s in legacy.GLYPHS.items() if s[0] == "্" and s[-1] not in "্ু"}
    s, c = rng.choice(list(letters.items()))
    kind = rng.random()
    if kind < 0.25:
        c, s = rng.choice(list(whole.items()))
    elif kind < 0.4:
        a, b = rng.choice(list(halves.items()))
        c, s = a + c, b + s
    if rng.random() < 0.3:
        a, b = rng.choice(list(under.items()))
        if not (c[-1] in "Mcek¤" and a == "ø"):
            c, s = c + a, s + b
    above = rng.random() < 0.15
    vowel = rng.choice([None, "া", "ি", "ী", "ু", "ূ", "ৃ", "ে", "ৈ", "ো", "ৌ"])
    sign = rng.choice(["", "", "ঁ", "ং", "ঃ"])
    left, right = {"ো": ("†", "v"), "ৌ": ("†", "Š"), "ি": ("w", ""), "ে": ("‡", ""), "ৈ": ("ˆ", "")}.get(vowel, ("", {"া": "v", "ী": "x", "ু": "y", "ূ": "~", "ৃ": "„", None: ""}.get(vowel, "")))
    codes = left + c + ("©" if above else "") + right + {"": "", "ঁ": "u", "ং": "s", "ঃ": "t"}[sign]
    return codes, ("র্" if above else "") + s + (vowel or "") + sign


def test_syllables_put_together_at_random():
    rng = random.Random(4)
    for _ in range(4000):
        parts = [syllable(rng) for _ in range(rng.randint(1, 4))]
        codes = "".join(c for c, _ in parts)
        if any(x in codes for x in ("yy", "vv", "y&", "wu", "‡u", "„„", *(b + c for c, before, _ in legacy.AFTER for b in before))):  # slips and codes with another meaning
            continue
        assert read(codes) == nfc("".join(s for _, s in parts)), codes


def test_round_trip_of_syllables():
    rng = random.Random(5)
    for _ in range(3000):
        text = nfc(" ".join("".join(syllable(rng)[1] for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 3))))
        if "yy" in (codes := write(text)) or "vv" in codes:
            continue
        assert read(codes) == text, (codes, text)


def test_columns(spark):
    rows = spark.createDataFrame([("কর্মকর্তা ১২",), ("has Latin",), ("ক্ঘ",), ("",), (None,)], "t string")
    codes = rows.select(legacy.to_legacy(F.col("t")).alias("c")).collect()
    assert [r["c"] for r in codes] == ["Kg©KZ©v 12", None, "K্N", "", None]
    back = rows.select(legacy.from_legacy(legacy.to_legacy(F.col("t"))).alias("b")).collect()
    assert [r["b"] for r in back] == ["কর্মকর্তা ১২", None, "ক্ঘ", "", None]


CLASSES = [
    ("", None, "EMPTY"), (" ​\n", None, "EMPTY"), (None, None, "EMPTY"), ("মো: তোফায়েল হোসেন", None, "UNICODE_OK"), ("মূল্য ঃ টাকা", None, "UNICODE_OK"), ("শাহ্ জালাল", None, "UNICODE_OK"),
    ("১২৩", None, "UNICODE_OK"), ("দোভিত্বপ্রোপ্ত কর্ মকিমো", None, "VISUAL_ORDER_BROKEN"), ("কািে", None, "VISUAL_ORDER_BROKEN"), ("ক�খ", None, "VISUAL_ORDER_BROKEN"), ("a�", None, "UNKNOWN"),
    ("Kg©KZ©v mnKvix", None, "BIJOY_ANSI"), ("gš¿Yvjq", None, "BIJOY_ANSI"), ("কর্মকর্তা Kg©", None, "MIXED"), ("myGov", None, "UNKNOWN"), ("The officer wW is here today", None, "UNKNOWN"),
    ("Deputy Secretary, Ministry of Home Affairs", None, "ENGLISH_OK"), ("Mr. McDonald, Phd, HQ", None, "ENGLISH_OK"), ("info@moha.gov.bd +88-02-223354521 https://a.b/X", None, "ENGLISH_OK"),
    ("Kg KZ", "HKMNBG+SutonnyMJ", "BIJOY_ANSI"), ("ক", "Bijoy Bayanno", "MIXED"), ("Kz", "Kalpurush, serif", "UNKNOWN"),
]


def test_classes(spark):
    rows = spark.createDataFrame([(i, t, f) for i, (t, f, _) in enumerate(CLASSES)], "i int, t string, f string")
    got = {r["i"]: r["kind"] for r in rows.select("i", integrity.classify(F.col("t"), F.col("f"))["kind"].alias("kind")).collect()}
    assert [(t, f, got[i]) for i, (t, f, _) in enumerate(CLASSES)] == CLASSES


@pytest.mark.parametrize(("font", "legacy_one"), [("HKMNBG+SutonnyMJ", True), ("SutonnyOMJ", True), ('"SutonnyMJ", serif', True), ("AdarshaLipi-ANSI", True), ("Kalpurush", False), ("Nikosh", False), ("Noto Sans Bengali", False), (None, False)])
def test_fonts(font, legacy_one):
    assert integrity.legacy_font(font) is legacy_one


def test_recovered_values(spark):
    cases = [
        ("Primary_Officer_Name", "মোঃ আনোয়ার হোসেন", None, 1.0, ["no_second_reading"]),
        ("Primary_Officer_Name", "মোঃ আনোয়ার হোসেন", "মোঃ আনোয়ার হোসেন", 1.0, []),
        ("Primary_Officer_Name", "মোঃ আনোয়ার হোসেন", "মোঃ আনিসুর রহমান", 1.0, ["second_reading_similarity"]),
        ("Primary_Phone", "০২-২২৩৩৫", "02 22335", 1.0, []),
        ("Primary_Mobile", "০১৭১২", "01713", 1.0, ["digits_disagree"]),
        ("Alternate_Email", "A@b.org", "a@B.org", 1.0, []),
        ("Alternate_Email", "a@b.org", "a@b.com", 1.0, ["email_disagree"]),
        ("Appellate_Designation", "উপসচিব", None, 0.5, ["lexicon_ratio"]),
        ("Appellate_Address", "কর্ মকিমো", None, 0.9, ["class_VISUAL_ORDER_BROKEN", "invalid_words"]),
        ("Primary_Phone", "  ", "1", 1.0, ["empty"]),
    ]
    rows = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "i int, field string, value string, second string, ratio double")
    out = rows.select("i", integrity.recovered_faults(*(F.col(c) for c in ("field", "value", "second", "ratio"))).alias("x"))
    assert {r["i"]: r["x"] for r in out.collect()} == {i: c[4] for i, c in enumerate(cases)}


def test_recovered_values_query(spark):
    """Phones differ where a 7 was taken for a 1; names by the share of letters that were taken for others."""
    import regex

    for r in registry.queries()["recovered_values"](spark, DIR).collect():
        if r["field"] == "Primary_Phone":
            want = "empty" if not r["value"] else "digits_disagree" if "7" in r["value"] else ""
        else:
            a, b = (regex.findall(r"\X", x) for x in (r["value"], r["value"].translate(str.maketrans("বনস", "রলম"))))
            want = "empty" if not a else "second_reading_similarity" if 2 * integrity._common(a, b) / (len(a) + len(b)) < 0.92 else ""
        assert r["faults"] == want


def test_lexicon_ratio(spark):
    rows = spark.createDataFrame([(1, "কখ গঘ কখ abc"), (2, ""), (3, None), (4, "১২")], "k int, t string")
    words = spark.createDataFrame([("কখ",), (None,)], "w string")
    assert {r["k"]: round(r["ratio"], 6) for r in integrity.lexicon_ratio(rows, "k", "t", words, "w").collect()} == {1: 0.666667, 2: 1.0, 3: 1.0, 4: 1.0}


def test_a_small_lexicon_goes_to_the_texts(spark, monkeypatch):
    """No word of a text is shuffled while the lexicon is counted as small; beyond that the ratios are the same."""
    rows = spark.createDataFrame([(1, "কখ গঘ কখ abc ১২"), (2, ""), (3, None), (4, "১২ গঘ"), (5, "কখ"), (5, "খ"), (None, "কখ")], "k int, t string")
    words = spark.createDataFrame([("কখ",), ("কখ",), ("১২",), ("",), (None,)], "w string")
    monkeypatch.setattr(F, "broadcast", lambda df, f=F.broadcast: sent.append(1) or f(df))
    for most, sends in ((1_000_000, [1]), (0, [])):
        sent = []
        monkeypatch.setattr(integrity, "MOST_WORDS", most)
        out = integrity.lexicon_ratio(rows, "k", "t", words, "w")
        assert sent == sends and bool(re.search(r"hashpartitioning\([^)]*_w", out._jdf.queryExecution().toString())) == (not sends)
        assert {r["k"]: round(r["ratio"], 6) for r in out.collect()} == {1: 0.666667, 2: 1.0, 3: 1.0, 4: 0.0, 5: 0.5, None: 1.0}


def test_workers_remember_a_bounded_part(spark, monkeypatch):
    """Neither many words nor long ones fill a worker, and batches stay small."""
    monkeypatch.setattr(legacy, "KNOWN", 8)
    words = legacy._Words(str.upper)
    assert [words[x] for x in ("a" * 1000, *map(str, range(100)))] == ["A" * 1000, *map(str, range(100))]
    assert len(words) <= 8 and "a" * 1000 not in words
    legacy.to_legacy(F.lit(""))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 512


def test_a_word_is_judged_by_one_look_up(monkeypatch):
    """Words that are remembered take no pattern again, and long ones aren't remembered."""
    words = integrity._Words()
    text = " ".join(["কিি", "কা"] * 50 + ["ক" * 200])
    first = integrity.judged(text, None, words)
    assert first == (integrity.BROKEN, ["double_matra"]) and len(words) == 2

    class Once:
        def __init__(self, p):
            self.p, self.n = p, 0

        def search(self, x):
            self.n += 1
            return self.p.search(x)

    block = Once(integrity._BLOCK)
    monkeypatch.setattr(integrity, "_BLOCK", block)
    assert integrity.judged(text, None, words) == first and block.n <= 2
