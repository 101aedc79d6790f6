"""Secret scans: three patterns, and random strings found by token efficiency.

Base patterns are matched leftmost and non-overlapping, one kind at a time, and matches that are too short are dropped afterwards.
The method then takes every run of credential characters with a letter and measures characters per token under a byte-level
vocabulary: words and identifiers compress to three or more characters a token, random strings to about two or less, and are reported
as kind ``random``.  Left out are known digests (hex of a digest's length), UUIDs, and identifiers, paths and hyphenated words whose
parts are words of the vocabulary; letters in the shape of words are not enough.

Spans are in code points, end exclusive.  The scan is a pure function of one row and needs no shuffle.

Defined cases: a null or empty text has no spans (the digest is that of the empty list); equal texts have equal spans; texts of any
length are scanned whole; repeated rows and ids are each scanned; an empty table gives an empty result; other columns, of any name, pass
through ``masked`` and don't take part in ``scan``.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TMP, documents, python_tasks

VOCABULARY = "byte_bpe_50k.tiktoken"
#: The patterns of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")
#: Runs that may be a credential; those with a letter are measured.
RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
#: Hex lengths of common digests (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512).
DIGESTS = frozenset((32, 40, 56, 64, 96, 128))
#: Characters per token below which a run counts as random.
RATIO = 2.2
#: Characters per token from which a part of an identifier is a word.
WORD_RATIO = 2.5
MASK = "[SECRET]"

_HEX_ONLY = re.compile(r"[0-9a-fA-F]+")
_PIECE = re.compile(r"[A-Za-z0-9]+")
_PART = re.compile(r"[A-Z]?[a-z]{3,}|[A-Z]{3,}(?![a-z])")
_encoders: dict[str, object] = {}


def encoder(path: str | None = None):
    """The vocabulary's encoder; loaded once in each worker."""
    path = path or public_tokenizers.path(VOCABULARY)
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def _is_word(part: str, ratio: float = WORD_RATIO) -> bool:
    """Whether a part is few tokens of the vocabulary, as it stands or in lower case."""
    return any(len(part) >= ratio * len(encoder().encode_ordinary(p)) for p in {part, part.lower()})


def is_identifier(run: str) -> bool:
    """Whether words of the vocabulary make up three quarters of a run's letters and digits: camelCase, snake_case, paths."""
    pieces = _PIECE.findall(run)
    size = 0
    for piece in pieces:
        if len(pieces) > 1 and piece.isalpha() and len(encoder().encode_ordinary(piece)) == 1:  # short words count between signs only
            size += len(piece)
        else:
            size += sum(len(p) for p in _PART.findall(piece) if _is_word(p))
    return 4 * size >= 3 * sum(map(len, pieces))


def is_random(run: str, ratio: float = RATIO) -> bool:
    """Whether a run is a random string and no known digest, UUID or identifier."""
    if not any(c.isalpha() for c in run) or len(run) >= ratio * len(encoder().encode_ordinary(run)):
        return False
    if UUID.fullmatch(run) or (_HEX_ONLY.fullmatch(run) and len(run) in DIGESTS):
        return False
    return not is_identifier(run)


def spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end), in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    found += [(m.start(), 3, m.end()) for m in RUN.finditer(text) if is_random(m.group())]
    return sorted(found)


def _said(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def redact(text: str, mask: str = MASK) -> str:
    """The text with every span, or run of overlapping spans, replaced by ``mask``."""
    out, at = [], 0
    for start, _, end in spans(text):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1).to_pylist():
            found = spans(text or "")
            base = [x for x in found if x[1] < 3]
            rows.append((sum(x[1] == 0 for x in base), sum(x[1] == 1 for x in base), sum(x[1] == 2 for x in base), hashlib.sha256(_said(base).encode()).hexdigest(), _said(found)))
        cols = [list(c) for c in zip(*rows, strict=True)] or [[]] * 5
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of ``docs``: counts of the base kinds, digest of the base spans, and all spans."""
    python_tasks(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def masked(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with secrets masked in the text; texts without any, null ones too, stay as they are."""
    python_tasks(docs.sparkSession)

    @F.arrow_udf("string")
    def mask_all(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else redact(t) for t in texts.to_pylist()], pa.string())

    own = docs.columns
    out = docs.withColumn(f"{TMP}new", mask_all(F.col(text_col)))
    if chars_col in own:
        out = out.withColumn(chars_col, F.when(F.col(f"{TMP}new") == F.col(text_col), F.col(chars_col)).otherwise(F.length(f"{TMP}new").cast(docs.schema[chars_col].dataType)))
    return out.withColumn(text_col, F.col(f"{TMP}new")).select(*[F.col(f"`{c}`") for c in own])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: the secrets of every document."""
    return scan(documents(spark, sf_dir))
