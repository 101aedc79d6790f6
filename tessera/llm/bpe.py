"""Byte-level BPE encoding and decoding with DuckDB inside Spark tasks.

Spark splits the texts by the vocabulary's pattern and deals the rows to tasks.  A task takes words in blocks of bounded size and
encodes each distinct word of a block once: words that are tokens themselves are looked up, the others become rows (word, position,
token and the token after it), one per byte, of a recursive query.  A step joins these pairs to the merge table, finds each word's
leftmost pair of least rank, and contracts it; a word without such a pair is done and leaves the recursion.  The merge table has every
way to cut a token into two tokens, so its size is the vocabulary's.  No step relies on the order of rows.

The steps of a word, and the rows of each, grow with its length.  So a word of over ``LONG`` bytes is cut into overlapping windows of
``LONG``, which are encoded as words, by the same steps, and put together where two windows have a token in common.  That is exact: a
sequence of tokens is the encoding of its bytes if and only if every two neighbours are that of theirs, as a contraction across a border
would come first at two neighbours, and neighbours in a window's encoding are encoded so.  Where windows have no token in common, as in
long runs, a window from a token before the gap to beyond it is tried, of twice the reach each time.  Such gaps are followed side by side,
from a few windows before each until two windows of the grid join again, and the windows that all of them lack are encoded by one recursion a turn; the words are then put together
from windows that are known by their bytes.  A gap that isn't bridged after ``AHEAD`` turns, as in a run without an end, is followed in
its word alone, where windows repeat.

Decoding joins the ids of a block to the vocabulary and puts the bytes of each document together by ordered aggregation.

Ids are held as little-endian unsigned 32-bit integers in one binary value per document.

Defined cases: a null or empty text has no tokens and decodes to nothing; null ids decode to null; repeated rows are each encoded;
texts and words of any length are encoded whole; other columns pass through, but for one of the result's name, which is replaced.
"""

from __future__ import annotations

import base64
import bisect
from collections.abc import Generator, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, python_tasks, text_of

VOCABULARY = "byte_bpe_50k.tiktoken"
#: public_tokenizers.PATTERN in Java's dialect, where \s would only be ASCII.
PATTERN = public_tokenizers.PATTERN.replace(r"[^\s\p{L}\p{N}]", r"[^\p{IsWhite_Space}\p{L}\p{N}]").replace(r"\s", r"\p{IsWhite_Space}").replace(r"\S", r"\P{IsWhite_Space}")
LONG, HALF = 64, 32
#: Turns in which the windows between those of the grid are encoded ahead, those of all gaps at once.
AHEAD = 24
#: Bytes of words (with their offsets) that are encoded at once, tokens that are decoded at once, and bytes of distinct words in one recursion.
BLOCK, TOKENS, WORDS = 12 << 20, 1 << 19, 1 << 17
#: Most words whose tokens a worker remembers.
KNOWN = 400_000

#: A word's tokens as rows: start p, end e, token and next token (-1 after the last).  The leftmost pair of least rank becomes one token;
#: the row of its second token goes, and the row before it gets a new next token.
_RECURSION = """
WITH RECURSIVE step(w, p, e, tok, nt, done) AS (
  SELECT w, p, e, tok, nt, false FROM bytes
  UNION ALL
  (WITH ranked AS MATERIALIZED (
    SELECT s.w, s.p, s.e, s.tok, s.nt, (m.c::BIGINT << 44) + (s.p::BIGINT << 22) + s.e AS k
    FROM step s LEFT JOIN merges m ON m.ab = (s.tok::BIGINT << 32) | s.nt WHERE NOT s.done),
  best AS (
    SELECT w, (min(k) >> 44)::INTEGER AS c, ((min(k) >> 22) & 4194303)::INTEGER AS p, (min(k) & 4194303)::INTEGER AS gone FROM ranked GROUP BY w),
  pair AS MATERIALIZED (
    SELECT b.w, b.c, b.p, b.gone, g.e, g.nt FROM best b LEFT JOIN ranked g ON g.w = b.w AND g.p = b.gone)
  SELECT r.w, r.p, CASE WHEN r.p = x.p THEN x.e ELSE r.e END, CASE WHEN r.p = x.p THEN x.c ELSE r.tok END,
    CASE WHEN r.p = x.p THEN x.nt WHEN r.e = x.p THEN x.c ELSE r.nt END, x.c IS NULL
  FROM ranked r JOIN pair x ON x.w = r.w WHERE x.c IS NULL OR r.p <> x.gone)
)
SELECT w, tok FROM step WHERE done ORDER BY w, p
"""


def load(path: str | None = None) -> dict[bytes, int]:
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _common(here: list[tuple[int, int]], after: list[tuple[int, int]]) -> tuple[int, int] | None:
    """Places of the first token, with its start, that both windows have."""
    at = {x: i for i, x in enumerate(here)}
    return next(((at[x], j) for j, x in enumerate(after) if x in at), None)


class _Windows:
    """Tokens of windows, by their bytes."""

    def __init__(self, encoder: Codec):
        self.encoder = encoder
        self.tokens: dict[bytes, list[int]] = {}

    def look_up(self, windows: set[bytes]) -> None:
        """Encodes all windows, together."""
        if windows:
            tokens, counts = self.encoder._contracted(pa.array(sorted(windows), pa.binary()))
            ends = np.cumsum(counts).tolist()
            self.tokens.update((w, tokens[b - n : b].tolist()) for w, b, n in zip(sorted(windows), ends, counts.tolist(), strict=True))

    def placed(self, window: bytes, start: int) -> list[tuple[int, int]]:
        """(start, token) of a window that is known."""
        out = []
        for t in self.tokens[window]:
            out.append((start, t))
            start += len(self.encoder.bytes_of[t])
        return out

    def follow(self, walks: list[Generator[bytes, None, list[int]]], turns: int | None = None) -> list[list[int]]:
        """Results of walks that yield the windows they lack; a turn encodes those of all walks at once."""
        results: list[list[int]] = [[] for _ in walks]
        waiting = list(enumerate(walks))
        turn = 0
        while waiting and (turns is None or turn < turns):
            lacking, still = set(), []
            for i, walk in waiting:
                try:
                    lacking.add(next(walk))
                    still.append((i, walk))
                except StopIteration as end:
                    results[i] = end.value
            self.look_up(lacking)
            waiting, turn = still, turn + 1
        return results


def _joined(word: bytes, first: int, found: _Windows, until: int | None = None) -> Generator[bytes, None, list[int]]:
    """The tokens of a word, from ``first`` on, from those of windows of it; or until two windows of the grid join after ``until``."""

    def window(start: int, size: int):
        piece = word[start : start + size]
        if piece not in found.tokens:
            yield piece
        return found.placed(piece, start)

    def place(most: int) -> int:
        """Place of the last token that starts at ``most`` or before, or of the first one."""
        return max(bisect.bisect_right(out, most, key=lambda x: x[0]) - 1, 0)

    out, end = (yield from window(first, LONG)), first + LONG
    while end < len(word):
        start, size, reach = (end - HALF) // HALF * HALF, LONG, HALF
        after, at = (yield from window(start, size)), place(start)
        common = _common(out[at:], after)
        if common is not None and until is not None and start > until:
            break
        while common is None:  # start at a token instead, and look further to both sides each time
            reach *= 2
            at = place(end - reach)
            start, size = out[at][0], end + reach - out[at][0]
            after = yield from window(start, size)
            common = _common(out[at:], after) or ((0, 0) if at == 0 else None)  # from the first byte on, a window's tokens take the place of all
        i, j = common
        out[at + i :] = after[j:]
        end = start + size
    return [t for _, t in out]


def _gaps(words: list[bytes], found: _Windows) -> list[tuple[bytes, int]]:
    """Windows of the grid, of known tokens, that have none in common with the next one; once for those that read alike for a while."""
    out: dict[bytes, tuple[bytes, int]] = {}
    for word in words:
        here = found.placed(word[:LONG], 0)
        for start in range(HALF, len(word) - HALF, HALF):
            after = found.placed(word[start : start + LONG], start)
            if _common(here, after) is None:
                out.setdefault(word[max(start - 3 * LONG, 0) : start + 3 * LONG], (word, start))
            here = after
    return list(out.values())


def _picked(flat: np.ndarray, counts: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The items of lists that lie one after another in ``flat``, for the lists at ``index``, and how many each has."""
    n = counts[index]
    at = np.repeat(((np.cumsum(counts) - counts)[index] - (np.cumsum(n) - n)).astype(np.int32), n)
    at += np.arange(len(at), dtype=np.int32)
    return flat[at], n


class Codec:
    """A DuckDB database with the vocabulary and its merge table; one in each worker."""

    def __init__(self, path: str | None = None):
        import duckdb

        self.ranks = load(path)
        self.bytes_of = dict(sorted((r, b) for b, r in self.ranks.items()))
        rules = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        a, b, c = (np.array(x, np.int32) for x in zip(*rules, strict=True))
        pair = (a.astype(np.int64) << 32) | b
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "300MB", "temp_directory": "", "preserve_insertion_order": True})
        self._table("merges", ab=pair, c=c)
        tokens = pa.table({"id": pa.array(list(self.bytes_of), pa.int32()), "bytes": [x.decode("latin-1") for x in self.bytes_of.values()]})
        self.db.register("t", tokens)
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM t")
        self.db.unregister("t")
        self.byte_id = np.array([self.ranks[bytes([x])] for x in range(256)], np.int32)
        #: Words whose tokens are known: those that are tokens themselves, and words met lately (KNOWN at most).
        self.base = (pa.array(list(self.ranks), pa.binary()), np.array(list(self.ranks.values()), np.int32), np.ones(len(self.ranks), np.int64))
        self.known = self.base

    def _table(self, name: str, **columns: np.ndarray) -> None:
        self.db.register("t", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM t")
        self.db.unregister("t")

    def _contract(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the words (binary), one after another, and how many each word has."""
        ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
        lengths = np.diff(ends)
        raw = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        w = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        p = (np.arange(len(raw)) - np.repeat(ends[:-1] - ends[0], lengths)).astype(np.int32)
        tok = self.byte_id[raw]
        after = np.append(tok[1:], np.int32(-1))
        after[ends[1:] - ends[0] - 1] = -1
        self._table("bytes", w=w, p=p, e=p + np.int32(1), tok=tok, nt=after)
        out = self.db.sql(_RECURSION).to_arrow_table()
        return out["tok"].to_numpy().astype(np.int32), np.bincount(out["w"].to_numpy(), minlength=len(words))

    def _contracted(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``_contract``, in recursions of ``WORDS`` bytes or a word more."""
        import pyarrow.compute as pc

        block = np.cumsum(pc.binary_length(words).to_numpy()) // WORDS
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(words)]
        parts = [self._contract(words.slice(a, b - a)) for a, b in zip(cuts, cuts[1:]) if a < b]
        return np.concatenate([np.zeros(0, np.int32), *(t for t, _ in parts)]), np.concatenate([np.zeros(0, np.int64), *(n for _, n in parts)])

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of distinct words (strings), one after another, and how many each has."""
        import pyarrow.compute as pc

        words = words.cast(pa.binary())
        index = pc.index_in(words, self.known[0])
        is_new = index.is_null().to_numpy(zero_copy_only=False)
        old, new = np.flatnonzero(~is_new), np.flatnonzero(is_new)
        counts = np.ones(len(words), np.int64)
        parts = [(old, *_picked(self.known[1], self.known[2], index.drop_null().to_numpy()))]
        sizes = pc.binary_length(words).to_numpy()
        short, long = new[sizes[new] <= LONG], new[sizes[new] > LONG]
        parts.append((short, *self._contracted(pc.take(words, pa.array(short)))))
        tokens = self._encode_long(pc.take(words, pa.array(long)).to_pylist())
        parts.append((long, np.array([x for t in tokens for x in t], np.int32), np.array([len(t) for t in tokens], np.int64)))
        for rows, _, n in parts:
            counts[rows] = n
        starts = np.cumsum(counts) - counts
        flat = np.empty(int(counts.sum()), np.int32)
        for rows, tokens, n in parts:
            flat[np.repeat(starts[rows] - (np.cumsum(n) - n), n) + np.arange(len(tokens))] = tokens
        fresh = (pc.take(words, pa.array(short)), *_picked(flat, counts, short))
        held = self.known if len(self.known[0]) + len(short) <= KNOWN else self.base
        if len(short) <= KNOWN:
            self.known = (pa.concat_arrays([held[0], fresh[0]]), np.concatenate([held[1], fresh[1]]), np.concatenate([held[2], fresh[2]]))
        return flat, counts

    def _encode_long(self, words: list[bytes]) -> list[list[int]]:
        """Tokens of words of over ``LONG`` bytes."""
        found = _Windows(self)
        found.look_up({w[s : s + LONG] for w in words for s in range(0, len(w) - HALF, HALF)})
        found.follow([_joined(w, max(s - 2 * LONG, 0), found, s) for w, s in _gaps(words, found)], AHEAD)
        return found.follow([_joined(w, 0, found) for w in words])

    def encode(self, words: pa.ListArray) -> pa.Array:
        """Ids of each row's words as binary values."""
        offsets = words.offsets.to_numpy()
        inner = words.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        flat, counts = self.encode_words(inner.dictionary)
        index = inner.indices.to_numpy()
        ids, n = _picked(flat, counts, index)
        ends = np.concatenate([[0], np.cumsum(n)])[offsets - offsets[0]] * 4
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids.astype("<u4").tobytes())]).cast(pa.binary())

    def decode(self, ids: pa.Array) -> pa.Array:
        """The bytes of each row's ids; null for null.  Rows are decoded in groups of ``TOKENS`` tokens or a row more."""
        rows, out, at, size = ids.to_pylist(), [], 0, 0
        for end, row in enumerate(rows, 1):
            size += len(row or b"")
            if size >= 4 * TOKENS or end == len(rows):
                out += self._decode(rows[at:end])
                at, size = end, 0
        return pa.array(out, pa.binary())

    def _decode(self, rows: list[bytes | None]) -> list[bytes | None]:
        lengths = np.array([len(x) // 4 if x else 0 for x in rows], np.int64)
        flat = np.frombuffer(b"".join(x for x in rows if x), "<u4").astype(np.int32)
        doc = np.repeat(np.arange(len(rows), dtype=np.int32), lengths)
        self._table("ids", doc=doc, p=np.arange(len(flat), dtype=np.int32), id=flat)
        found = self.db.execute("SELECT doc, array_to_string(list(bytes ORDER BY p), '') FROM ids JOIN vocabulary USING (id) GROUP BY doc").fetchall()
        out: list[bytes | None] = [None if x is None else b"" for x in rows]
        for d, text in found:
            out[d] = text.encode("latin-1")  # a character for each byte
        return out


_codecs: dict[str | None, Codec] = {}


def codec(path: str | None = None) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Batches put together until they hold ``most`` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _run(rows: DataFrame, columns: list[Column], names: list[str], steps: list[tuple[str, int]], path: str | None) -> DataFrame:
    """Runs the codec's ``steps`` (method, place of its input) over blocks of ``columns``, in one Python worker a task.

    The output has ``names``: the columns but the last, which is the first step's input, and a binary one for each step.
    """
    python_tasks(rows.sparkSession)
    source = rows.select(*columns)
    rest = source.schema.fields[:-1]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), *(f"`{n}` binary" for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, BLOCK):
            arrays = [_one(block.column(i)) for i in range(len(rest) + 1)]
            for method, at in steps:
                arrays.append(getattr(codec(path), method)(arrays[at]))
            del arrays[len(rest)], block
            yield from pa.table(arrays, [*(f.name for f in rest), *names]).to_batches(max_chunksize=512)
            del arrays
            pa.default_memory_pool().release_unused()

    return source.mapInArrow(run, schema)


def _one(column: pa.ChunkedArray) -> pa.Array:
    column = column.combine_chunks()
    return column if isinstance(column, pa.Array) else column.chunk(0)


def _split(text_col: str) -> Column:
    return F.regexp_extract_all(text_of(text_col), F.lit(PATTERN), F.lit(0)).alias("__t_words")


def encode(rows: DataFrame, text_col: str = "text", name: str = "ids", path: str | None = None) -> DataFrame:
    """``rows`` without ``text_col`` and with the ids of its tokens, a binary value."""
    rest = [F.col(f"`{c}`") for c in rows.columns if c not in (text_col, name)]
    return _run(rows, [*rest, _split(text_col)], [name], [("encode", len(rest))], path)


def decode(rows: DataFrame, ids_col: str = "ids", name: str = "decoded", path: str | None = None) -> DataFrame:
    """``rows`` with the bytes that the ids stand for."""
    columns = [F.col(f"`{c}`") for c in rows.columns if c != name]
    return _run(rows, [*columns, F.col(f"`{ids_col}`").alias("__t_ids")], [name], [("decode", len(columns))], path)


def round_trip(rows: DataFrame, text_col: str = "text", names: tuple[str, str] = ("ids", "decoded"), path: str | None = None) -> DataFrame:
    """``encode`` and then ``decode`` of the ids, by one worker, so that the ids needn't travel in between."""
    rest = [F.col(f"`{c}`") for c in rows.columns if c not in (text_col, *names)]
    return _run(rows, [*rest, _split(text_col)], list(names), [("encode", len(rest)), ("decode", len(rest) + 1)], path)


def n_tokens(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: ids of every document and the text they decode to, as digests."""
    out = round_trip(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", n_tokens(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
