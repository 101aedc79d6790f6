"""Every query with SQL gives DuckDB's rows on the smallest tables; the others give rows of a stable schema."""

import collections
import datetime
import decimal
import glob
import hashlib
import itertools
import math
import os
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.plans import registry

DIR = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, list | tuple):
        return str([plain(x) for x in v])
    return str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    out = duck.execute(SQL[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in out.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


def table(name):
    import pyarrow.parquet as pq

    return pq.read_table(f"{DIR}/{name}.parquet").to_pylist()


def test_text_fingerprints_long_by_hand(spark):
    got = {r["doc_id"]: (r["sha512"], r["crc32"]) for r in QUERIES["text_fingerprints_long"](spark, DIR).collect()}
    assert got == {r["doc_id"]: (hashlib.sha512(r["text"].encode()).hexdigest(), f"{zlib.crc32(r['text'].encode()):08x}") for r in table("documents")}


def spans_by_hand(text, terms):
    low, out, at = text.lower(), [], 0
    while at < len(low):
        fits = [t for t in terms if low.startswith(t, at) and not (at and low[at - 1].isalnum()) and not low[at + len(t) : at + len(t) + 1].isalnum()]
        if fits:
            best = max(fits, key=len)
            out.append((at, at + len(best), best))
        at += len(max(fits, key=len)) if fits else 1
    return out


def test_dictionary_spans_by_hand(spark):
    from tessera.plans import texts

    terms = {*texts.TERMS, *(r["text"].lower() for r in table("benchmark") if r["text"])}
    want = sorted((r["doc_id"], *x) for r in table("documents") for x in spans_by_hand(r["text"], terms))
    assert sorted(map(tuple, QUERIES["dictionary_spans"](spark, DIR).collect())) == want
    counts = collections.Counter((i, t) for i, _, _, t in ((r["doc_id"], *x) for r in table("documents") for x in spans_by_hand(r["text"], texts.TERMS)))
    got = QUERIES["location_mentions"](spark, DIR).collect()
    assert {(r["id"], r["term"]): r["mentions"] for r in got} == counts
    assert all(a["mentions"] > b["mentions"] or (a["mentions"] == b["mentions"] and a["first_at"] < b["first_at"]) for a in got for b in got if a["id"] == b["id"] and a["rank"] + 1 == b["rank"])


def test_greedy_budget_by_hand(spark):
    from tessera.functions import text as T

    sentences = {r[0]: r[1] for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", T.sentences(F.col("text"))).collect()}
    length = {r["doc_id"]: len(r["text"]) for r in table("documents")}
    for r in QUERIES["greedy_budget_selection"](spark, DIR).collect():
        budget, used, ids = math.floor(length[r["doc_id"]] * 0.3), 0, []
        for size, i in sorted(((len(s), i) for i, s in enumerate(sentences[r["doc_id"]])), reverse=True):
            if used + size <= budget:
                used, ids = used + size, [*ids, i]
        assert (r["ids"], r["used"], r["budget"]) == (sorted(ids), used, budget)


def test_page_links_by_hand(spark):
    """Every link that a plain search for anchors finds outside skipped parts is among those of the page, and no other."""
    from urllib.parse import urljoin

    got = collections.defaultdict(set)
    rows = QUERIES["page_links"](spark, DIR)
    for r in rows.collect():
        got[r["id" if "id" in rows.columns else "page_id"]].add(r["link" if "link" in rows.columns else "url"])
    for p in table("pages"):
        found = {urljoin(p["url"], h) for h in re.findall(r"""<a\b[^>]*?href=["']([^"']+)["']""", p["html"] or "")}
        assert {x.split("#")[0] for x in got[p["page_id"]]} <= {x.split("#")[0] for x in found}


def test_fuzzy_scan_by_hand(spark):
    from tessera.operators import gazetteer
    from tessera.plans import texts

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [*itertools.accumulate(range(len(b)), lambda left, j, up=row, x=x: min(left + 1, up[j + 1] + 1, up[j] + (x != b[j])), initial=i)]
        return row[-1]

    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(9))) for _ in "ab")
        d = edits(a, b)
        assert gazetteer._edits(a, b, 3) == min(d, 4)
    got = {tuple(r) for r in QUERIES["fuzzy_scan"](spark, DIR).collect()}
    assert got
    for i, start, end, name, d in got:
        text = next(r["text"].lower() for r in table("documents") if r["doc_id"] == i)
        assert edits(text[start:end], name) == d and 0 < d <= max(1, int(len(name) * 0.15)) and text[start:end].endswith("license")
    whole = [r for r in table("documents") if "released under the mit license" in r["text"].lower()]
    assert {r["doc_id"] for r in whole} <= {i for i, *_ in got} and texts.NAMES


def test_entry(spark):
    assert entry.entry(spark).count() > 0
