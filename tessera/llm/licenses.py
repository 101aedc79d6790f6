"""License scans by conditional compression.

Candidates are the neighbourhoods of cues: ``REACH`` words on both sides, across lines, so that line breaks and comment signs count as
blanks.  Cues are license words and, by rule, so many long words of every template that no confirmed wording can be without one.  Such a window (a few KB) is compressed alone and with each template as zstandard raw dictionary, and templates are
tried in the order of the bytes they save.  All are tried; savings rank guesses and don't rule any out.  A guess is confirmed by its
exact wording: the words of the template that the text lacks, or has in another order, may be ``MISSING`` of the template at most,
within at most twice as many words as the template has.

The scan is a pure function of one row and needs no shuffle.

Defined cases: a null or empty text has no blocks; of overlapping confirmed templates the one with the most words found stays, then
the one that lacks fewer, then the shorter span; only templates with equal figures on the same words are reported together; templates
that don't overlap are all reported; equal texts have equal results; texts and lines of any length are scanned whole; repeated rows and
ids are each scanned; an empty table gives an empty result; other columns, of any name, don't take part.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, python_tasks

#: Short public notices by SPDX name.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "All-rights-reserved": "All rights reserved.",
}
#: Usual longer notices, license texts in full where they are short, and the titles of long ones.
_NO_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_ENDORSE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_GNU = "is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("BSD-2-Clause", f"{_BSD} {_NO_WARRANTY}"),
    ("BSD-3-Clause", f"{_BSD} {_ENDORSE} {_NO_WARRANTY}"),
    ("BSD-3-Clause", f"{_BSD} {_ENDORSE}"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC0-1.0", "CC0 1.0 Universal: Creative Commons Legal Code"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", _MIT),
    ("MIT", f"{_MIT} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions"),
    *((f"{name}-{version}.0", _GNU.format(kind, version)) for name, kind, version in (("AGPL", "Affero ", 3), ("GPL", "", 2), ("GPL", "", 3), ("LGPL", "Lesser ", 3))),
    *((f"{name}-{version}.0", f"GNU {kind}GENERAL PUBLIC LICENSE Version {version}, {when}") for name, kind, version, when in (("AGPL", "AFFERO ", 3, "19 November 2007"), ("GPL", "", 2, "June 1991"), ("GPL", "", 3, "29 June 2007"), ("LGPL", "LESSER ", 3, "29 June 2007"))),
)
CUE = re.compile(r"licen[sc]e|copyright|rights reserved|permission|redistribution|public domain|creative commons|\bCC[ -]BY\b|waived", re.I)
#: Share of a template's words that a text may lack.
MISSING = 0.1
_WORD = re.compile(r"\w(?:[\w.+-]*\w)?")
_CLOSING = re.compile(r"[.:]*")
#: Line breaks with the blanks and comment signs around them.
_BREAK = re.compile(r"[ \t]*(?:\r\n?|\n)[ \t]*(?:(?:/?\*+/?|#+|/{2,}|--+|;+|%+|>+|dnl\b|REM\b)[ \t]*)?")
_ALL = [*TEMPLATES.items(), *NOTICES]


def _words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


#: Words on both sides of a license word that are looked at: no confirmed span is longer.
REACH = 2 * max(len(_words(t)) for _, t in _ALL)


def _more_cues() -> list[str]:
    """Words by which every wording that lacks ``MISSING`` of a template at most is found: of the template's words, more than it may lack
    are cues, the longest ones after the license words."""
    out: set[str] = set()
    for _, template in _ALL:
        words = _words(template)
        cues = sum(bool(CUE.search(w)) or w in out for w in words)
        for w in sorted(set(words), key=lambda w: (-len(w), w)):
            if cues <= int(MISSING * len(words)) and not CUE.search(w) and w not in out:
                out.add(w)
                cues += words.count(w)
    return sorted(out)


#: One of these is in every text that has a cue, in lower case.
_STEMS = ("licens", "licenc", "copyright", "rights reserved", "permission", "redistribution", "public domain", "creative commons", "cc by", "cc-by", "waived", *_more_cues())
_CUES = re.compile("|".join([CUE.pattern, *map(re.escape, _more_cues())]), re.I)


@lru_cache(1)
def _compressors():
    import zstandard

    make = lambda d=None: zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
    raw = lambda t: zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return make(), [make(raw(t)) for _, t in _ALL]


@lru_cache(1)
def _prepared() -> list[tuple[list[str], Counter, dict[str, int]]]:
    """Words, their counts and their places as bits, of each template."""
    out = []
    for _, template in _ALL:
        words, bits = _words(template), {}
        for i, w in enumerate(words):
            bits[w] = bits.get(w, 0) | 1 << i
        out.append((words, Counter(words), bits))
    return out


def _ranked(block: str) -> list[tuple[int, int]]:
    """Bytes saved by each template and its place in ``_ALL``, the most first; ties to the shorter template, then the first name."""
    alone, given = _compressors()
    data = block.encode("utf-8", "replace")
    size = len(alone.compress(data))
    return sorted(((size - len(c.compress(data)), k) for k, c in enumerate(given)), key=lambda x: (-x[0], len(_ALL[x[1]][1]), _ALL[x[1]][0]))


def savings(block: str) -> list[tuple[int, str]]:
    """Bytes saved by each template, the most first."""
    return [(saved, _ALL[k][0]) for saved, k in _ranked(block)]


def aligned(words: list[str], k: int) -> list[tuple[int, int, int]]:
    """Words of template ``k`` found in order, first and last of ``words``, for every place where the wording is confirmed."""
    template, counts, bits = _prepared()[k]
    n = len(template)
    may = int(MISSING * n)
    first, full, out = set(template[: may + 1]), (1 << n) - 1, []  # the first word found is one of these
    for at, word in enumerate(words):
        if word in first:
            v, best, last = full, 0, at
            for j in range(at, min(len(words), at + 2 * n)):  # longest common subsequence, a bit for each word of the template
                m = bits.get(words[j])
                if m:
                    u = v & m
                    v = ((v + u) | (v - u)) & full
                    kept = n - v.bit_count()
                    if kept > best:
                        best, last = kept, j
                        if kept == n:
                            break
            if best >= n - may:
                out.append((best, at, last))
    return out


def judge(block: str, words: list[str]) -> list[tuple[int, int, int, int, int]]:
    """Confirmed templates of a window: words found, first and last word, place of the template in ``_ALL``, bytes saved."""
    have, found = Counter(words), []
    possible = {k for k, (t, counts, _) in enumerate(_prepared()) if sum(min(c, have[w]) for w, c in counts.items()) >= len(t) - int(MISSING * len(t))}
    for saved, k in _ranked(block) if possible else ():
        if k in possible:  # others lack too many words in any order
            found += [(kept, a, b, k, saved) for kept, a, b in aligned(words, k)]
    return found


def blocks(text: str) -> list[tuple[int, int]]:
    """Lines (start, end in code points) with a license word."""
    out: list[tuple[int, int]] = []
    for m in CUE.finditer(text):
        if not out or m.start() >= out[-1][1]:
            end = text.find("\n", m.end())
            out.append((text.rfind("\n", 0, m.start()) + 1, end if end >= 0 else len(text)))
    return out


def _placed(text: str) -> list[tuple[str, int, int]]:
    """Words with their start and end; a word that is broken after a hyphen is one."""
    out: list[tuple[str, int, int]] = []
    for m in _WORD.finditer(text):
        a, b = m.span()
        if out and text[out[-1][2]] == "-" and _BREAK.fullmatch(text, out[-1][2] + 1, a):
            word, start, _ = out.pop()
            out.append((f"{word}-{m.group().lower()}", start, b))
        else:
            out.append((m.group().lower(), a, b))
    return out


def licenses(text: str) -> list[tuple[int, int, str, int, int]]:
    """Confirmed licenses in order: start, end, name, bytes saved, words lacking."""
    low = text.lower()
    cues = [m.start() for m in _CUES.finditer(text)] if any(x in low for x in _STEMS) else []
    if not cues:
        return []
    placed = _placed(text)
    words, places, starts = [w for w, _, _ in placed], [(a, b) for _, a, b in placed], [a for _, a, _ in placed]
    at = sorted({max(bisect_right(starts, c) - 1, 0) for c in cues})
    found: dict[tuple[int, int, int], tuple[int, int]] = {}
    i = 0
    while i < len(at):
        first = max(at[i] - REACH, 0)
        while i + 1 < len(at) and at[i + 1] <= first + 2 * REACH:  # a window has the whole reach of each of its license words
            i += 1
        high = min(at[i] + REACH + 1, len(words))
        i += 1
        for kept, a, b, k, saved in judge(_BREAK.sub(" ", text[places[first][0] : places[high - 1][1]]), words[first:high]):
            found.setdefault((a + first, b + first, k), (kept, saved))
    return _chosen(text, places, found)


def _chosen(text: str, places: list[tuple[int, int]], found: dict[tuple[int, int, int], tuple[int, int]]) -> list[tuple[int, int, str, int, int]]:
    """Of confirmed templates (first and last word, place in ``_ALL``: words found, bytes saved), those that overlap no better one."""
    order = sorted((-kept, len(_prepared()[k][0]) - kept, b - a, a, _ALL[k][0], k, saved) for (a, b, k), (kept, saved) in found.items())
    taken, held, out = bytearray(len(places)), {}, {}
    for kept, lacking, more, a, name, _, saved in order:
        if taken.find(1, a, a + more + 1) < 0:
            taken[a : a + more + 1] = b"\1" * (more + 1)
            held[a, more] = (kept, lacking)
        elif held.get((a, more)) != (kept, lacking):
            continue
        end = places[a + more][1]
        out.setdefault((places[a][0], _CLOSING.match(text, end).end(), name), (saved, lacking))
    return sorted((*k, *v) for k, v in out.items())


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, names, spans, saved = [], [], [], []
        for text in batch.column(1).to_pylist():
            found = licenses(text or "")
            counts.append(len(blocks(text or "")))
            names.append(",".join(sorted({x[2] for x in found})))
            spans.append(",".join(f"{n}:{a}:{b}:{lacking}" for a, b, n, _, lacking in found))
            saved.append(sum(x[3] for x in found))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(names, pa.string()), pa.array(spans, pa.string()), pa.array(saved, pa.int64())], ["doc_id", "n_blocks", "licenses", "spans", "saved"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of ``docs``: lines with a license word, confirmed licenses, their spans (name:start:end:words lacking) and bytes saved."""
    python_tasks(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(_scan, "doc_id long, n_blocks long, licenses string, spans string, saved long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: the licenses of every document."""
    return scan(documents(spark, sf_dir))
