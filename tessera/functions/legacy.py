"""Bengali text in the codes of pre-Unicode fonts: put into Unicode and back, in Arrow batches.

The codes stand for glyphs in the order of sight: a vowel sign that is drawn left of its consonants comes before them, and the r that
is drawn above them after them.  Reading takes three steps: codes become characters, longest code first (an r above becomes a mark of its
own); marks that stand inside a cluster of consonants move behind it; then each syllable, a regular expression, is written in the order
of speech.  Writing is the inverse: a cluster is cut into as few glyphs as it takes.

Both work word by word and remember the words they have met (``KNOWN`` at most), so a text costs a look-up a word.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..cluster import ship

# The font's code table.
#: Letters in the order of the alphabet, and the codes that stand for them in turn.
LETTER_CODES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ_`abcdefghijklmnopqrstu"
LETTERS = "অইঈউঊঋএঐওঔকখগঘঙচছজঝঞটঠডঢণতথদধনপফবভমযরলশষসহড়ঢ়য়ৎংঃঁ"
#: Vowel signs and stops: characters, each with its codes.
SIGN_CODES = {"া": "v", "ি": "w", "ী": "x", "ু": "yz“–æ", "ূ": "~ƒ‚", "ৃ": "„…", "ে": "†‡", "ৈ": "ˆ‰", "ৗ": "Š", "।": "|", "॥": "\\", "্\u200c": "&"}
#: Glyphs of clusters and of parts of clusters; a part that begins or ends with the joiner joins its neighbour.
GLYPHS = {
    "^": "্ব", "•": "ঙ্", "‘": "্তু", "’": "্থ", "‹": "্ক", "Œ": "্ক্র", "”": "চ্", "—": "্ত", "˜": "দ্", "™": "দ্", "š": "ন্", "›": "ন্", "œ": "্ন", "Ÿ": "্ব", "¡": "্ব",
    "¢": "্ভ", "£": "্ভ্র", "¤": "ম্", "¥": "্ম", "¦": "্ব", "§": "্ম", "¨": "্য", "ª": "্র", "«": "্র", "¬": "্ল", "\u00ad": "্ল", "®": "ষ্", "¯": "স্", "°": "ক্ক", "±": "ক্ট", "²": "ক্ষ্ণ",
    "³": "ক্ত", "´": "ক্ম", "µ": "ক্র", "¶": "ক্ষ", "·": "ক্স", "¸": "গু", "¹": "জ্ঞ", "º": "গ্দ", "»": "গ্ধ", "¼": "ঙ্ক", "½": "ঙ্গ", "¾": "জ্জ", "¿": "্ত্র", "À": "জ্ঝ", "Á": "জ্ঞ",
    "Â": "ঞ্চ", "Ã": "ঞ্ছ", "Ä": "ঞ্জ", "Å": "ঞ্ঝ", "Æ": "ট্ট", "Ç": "ড্ড", "È": "ণ্ট", "É": "ণ্ঠ", "Ê": "ণ্ড", "Ë": "ত্ত", "Ì": "ত্থ", "Í": "ত্ম", "Î": "ত্র", "Ï": "দ্দ", "Ð": "-", "Ñ": "-",
    "Ò": '"', "Ó": '"', "Ô": "'", "Õ": "'", "Ö": "্র", "×": "দ্ধ", "Ø": "দ্ব", "Ù": "দ্ম", "Ú": "ন্ঠ", "Û": "ন্ড", "Ü": "ন্ধ", "Ý": "ন্স", "Þ": "প্ট", "ß": "প্ত", "à": "প্প", "á": "প্স",
    "â": "ব্জ", "ã": "ব্দ", "ä": "ব্ধ", "å": "ভ্র", "ç": "ম্ফ", "è": "্ন", "é": "ল্ক", "ê": "ল্গ", "ë": "ল্ট", "ì": "ল্ড", "í": "ল্প", "î": "ল্ফ", "ï": "শু", "ð": "শ্চ", "ñ": "শ্ছ", "ò": "ষ্ণ",
    "ó": "ষ্ট", "ô": "ষ্ঠ", "õ": "ষ্ফ", "ö": "স্খ", "÷": "স্ট", "ø": "স্ন", "ù": "স্ফ", "ú": "্প", "û": "হু", "ü": "হৃ", "ý": "হ্ন", "þ": "হ্ম", "ÿ": "ক্ষ",
}
#: Codes with another meaning after certain codes: (code, those before it, characters).
AFTER = (("ø", "Mcek¤", "্ল"), ("Í", "¯š", "ত"))
ABOVE = "©"
#: Slips of typists, mended in this order before reading.
SLIPS = (
    ("  ", " "), ("yy", "y"), ("vv", "v"), ("\u00ad\u00ad", "\u00ad"), ("y&", "y"), ("„&", "„"), ("‡u", "u‡"), ("wu", "uw"), (" ,", ","), (" |", "|"), ("\\ ", ""), (" \\", ""), ("\\", ""),
    ("\n ", "\n"), (" \n", "\n"), ("\n\n\n\n\n", "\n\n"), ("\n\n\n\n", "\n\n"), ("\n\n\n", "\n\n"),
)

JOINER = "্"
CONSONANT = "[ক-হৎড়ঢ়য়]"
BEFORE, BEHIND, SIGNS = "িেৈ", "াীুূৃৗ", "ঁংঃ"
#: Two-part vowel signs: what is drawn left, what is drawn right, the sign.
TWO_PART = (("ে", "া", "ো"), ("ে", "ৗ", "ৌ"))
#: Stands for the r above until the order of speech is restored.
_R = "\ue000"
#: Words that a worker remembers for each step, and the most characters of one.
KNOWN, MOST_KNOWN = 1 << 18, 64

_READ = {**dict(zip(LETTER_CODES, LETTERS, strict=True)), **{c: s for s, codes in SIGN_CODES.items() for c in codes}, **GLYPHS, ABOVE: _R, "„„": "ৃ"}
_READ |= {b + c: _READ[b] + s for c, before, s in AFTER for b in before}
_DIGITS = dict(zip("0123456789", "০১২৩৪৫৬৭৮৯", strict=True))
_CODES = re.compile("|".join(map(re.escape, sorted(_READ, key=len, reverse=True))))
_SYLLABLE = re.compile(rf"([{BEFORE}]?)({CONSONANT}(?:{JOINER}{CONSONANT})*)([{BEHIND}{SIGNS}{_R}]*)")
_INSIDE = re.compile(rf"([{BEFORE}{BEHIND}ঁ{_R}]+)({JOINER}{CONSONANT})")


def _spoken(m: re.Match) -> str:
    left, cluster, rest = m.groups()
    above = "র" + JOINER if _R in rest else ""
    right = "".join(c for c in rest if c in BEHIND)
    signs = "".join(c for c in rest if c in SIGNS)
    for a, b, both in TWO_PART:
        if left == a and right.startswith(b):
            left, right = both, right[1:]
    return above + cluster + left + right + signs


def _read_word(word: str, digits: bool) -> str:
    out = _CODES.sub(lambda m: _READ[m[0]], word)
    if digits:
        out = "".join(_DIGITS.get(c, c) for c in out)
    out, before = out.replace(JOINER * 2, JOINER), None
    while out != before:  # a sign may pass several joined consonants
        out, before = _INSIDE.sub(r"\2\1", out), out
    out = _SYLLABLE.sub(_spoken, out).replace(_R, "র" + JOINER).replace("অা", "আ").replace(f"{JOINER}\u200c" * 2, f"{JOINER}\u200c")
    return unicodedata.normalize("NFC", out)


def _cluster_codes() -> dict[str, str]:
    """Codes by characters: a sequence of consonants, with a joiner at its end or its start where it is part of a cluster."""
    out = {s: c for c, s in reversed(_READ.items()) if s and re.fullmatch(rf"{JOINER}?{CONSONANT}(?:{JOINER}{CONSONANT})*{JOINER}?", s)}
    return out | {_READ[k]: k for k in _READ if len(k) == 2 and k != "„„"}


_WRITE = _cluster_codes()
_LONGEST = max(map(len, _WRITE))
_SIGN = {s: codes[0] for s, codes in SIGN_CODES.items()} | dict(zip(LETTERS, LETTER_CODES, strict=True))
_SIGN |= {d: a for a, d in _DIGITS.items()}
#: A word that holds any of these can't be told from codes.
_TAKEN = re.compile("[" + re.escape("".join(sorted({c for k in _READ for c in k} | set(_DIGITS)))) + "]")
_SPOKEN = re.compile(rf"(র{JOINER}(?={CONSONANT}))?({CONSONANT}(?:{JOINER}{CONSONANT})*)([{BEFORE}{BEHIND}োৌ]?)([{SIGNS}]*)")
_LEFT = {"ো": ("ে", "া"), "ৌ": ("ে", "ৗ"), **{c: (c, "") for c in BEFORE}}


@lru_cache(maxsize=1 << 14)
def _glyphs(cluster: str) -> str | None:
    """The fewest codes whose characters are the cluster; null if there are none."""
    best: list[tuple[int, str] | None] = [(0, "")] + [None] * len(cluster)
    for end in range(1, len(cluster) + 1):
        for begin in range(max(0, end - _LONGEST), end):
            if (c := _WRITE.get(cluster[begin:end])) is None:
                continue
            # A part that begins with the joiner may share it with a part that ends with it.
            for at in (begin, begin + 1) if cluster[begin] == JOINER else (begin,):
                if (x := best[at]) and (at == begin or x[1]) and (best[end] is None or x[0] + 1 < best[end][0]):
                    best[end] = (x[0] + 1, x[1] + c)
    return best[-1][1] if best[-1] else None


def _seen(m: re.Match) -> str:
    above, cluster, vowel, signs = m.groups()
    left, right = _LEFT.get(vowel, ("", vowel))
    codes = _glyphs(cluster)
    return "".join((_SIGN[left] if left else "", cluster if codes is None else codes, ABOVE if above else "", _SIGN[right] if right else "", signs))


def _written(word: str) -> str | None:
    if _TAKEN.search(word):
        return None
    word = unicodedata.normalize("NFC", word).replace("ড়", "ড়").replace("ঢ়", "ঢ়").replace("য়", "য়").replace("আ", "অা")
    return "".join(_SIGN.get(c, c) for c in _SPOKEN.sub(_seen, word))


class _Words(dict):
    """What words become, as far as they are remembered."""

    def __init__(self, step):
        self.step = step

    def __missing__(self, word: str):
        out = self.step(word)
        if len(word) <= MOST_KNOWN:
            if len(self) >= KNOWN:
                self.clear()
            self[word] = out
        return out


def read(text: str | None, words: _Words) -> str | None:
    if not text:
        return text
    for slip, mended in SLIPS:
        text = text.replace(slip, mended)
    return re.sub("  ", " ", "".join(map(words.__getitem__, re.split(r"(\s+)", text))))


def write(text: str | None, words: _Words) -> str | None:
    parts = list(map(words.__getitem__, re.split(r"(\s+)", text))) if text else [text]
    return None if None in parts else "".join(parts)


#: What a worker remembers, by the step.
_known: dict[str, _Words] = {}


def known(step: str) -> _Words:
    """The words that this worker has met: ``read``, ``read_latin`` (digits stay) or ``write``."""
    steps = {"read": lambda w: _read_word(w, True), "read_latin": lambda w: _read_word(w, False), "write": _written}
    return _known.setdefault(step, _Words(steps[step]))


def _mapped(c: Column, run_one, step: str) -> Column:
    ship(SparkSession.active())

    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        words = known(step)
        return pa.array([run_one(v, words) for v in values.to_pylist()], pa.string())

    return run(c)


def from_legacy(c: Column, digits: bool = True) -> Column:
    """Unicode text (NFC) of a run in a legacy font; ``digits``: whether its digits are Bengali, as in the font, or stay as they are."""
    return _mapped(c, read, "read" if digits else "read_latin")


def to_legacy(c: Column) -> Column:
    """The codes of Bengali text; null for text with characters that are codes themselves (Latin letters, digits and signs).  A cluster
    without glyphs keeps its joiners in Unicode, which reading leaves alone."""
    return _mapped(c, write, "write")
