"""Fixity audits and license scans."""

import hashlib

import pytest

from tessera.llm import licenses, warc

SCHEMA = "page_id long, url string, html string"


def pages_of(spark, n, change=()):
    rows = [(i, f"http://x/{i}", ("changed" if i in change else "page") + " é" * (i % 7)) for i in range(n)]
    return spark.createDataFrame([*rows, (None, "u", "no id"), (n, None, None), (3 * n, "", "")], SCHEMA)


def test_records_by_hand(spark):
    rows = warc.archive(pages_of(spark, 40)).orderBy("page_id").collect()
    at, file = 0, 0
    for r in rows:
        if r["file"] != file:
            at, file = 0, r["file"]
        i = r["page_id"]
        url, html = (f"http://x/{i}", "page" + " é" * (i % 7)) if i < 40 else ("", "")
        body = html.encode()
        want = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Target-URI: {url}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
        assert (r["offset"], r["length"], r["digest"]) == (at, len(want), hashlib.sha256(want).hexdigest())
        at += len(want)
    assert len(rows) == 42


@pytest.mark.parametrize("change", [(), (0,), (299, 300), (700,)])
def test_audit_finds_what_changed(spark, change):
    a, b = warc.archive(pages_of(spark, 700)), warc.archive(pages_of(spark, 700, change))
    found, counts = warc.audit(a, b)
    x = a.select("file", "rank", a.digest.alias("x")).join(b.select("file", "rank", b.digest.alias("y")), ["file", "rank"])
    moved = {(r["file"], r["rank"]) for r in a.join(b.select("file", "rank", b["offset"].alias("o"), b["length"].alias("l")), ["file", "rank"]).where("`offset` <> o OR `length` <> l").collect()}
    want = {(r["file"], r["rank"]) for r in x.where("x <> y").collect()} | moved
    assert {(r["file"], r["rank"]) for r in found.collect()} == want
    assert counts[0] == (1 if change and change != (700,) else 0)


def test_audit_of_same_sizes_is_narrow(spark):
    a = warc.archive(pages_of(spark, 1200))
    b = warc.archive(warc.damaged(pages_of(spark, 1200)))
    found, counts = warc.audit(a, b)
    assert {r["file"] * 0 + r["page_id"] for r in a.join(found, ["file", "rank"]).collect()} == {i for i in [*range(1200)] if i % 97 == 13}
    assert max(counts) <= 2 * len(range(13, 1200, 97))


def test_audit_descends_trees_of_unequal_height(spark):
    """A replica that lost its last files, and the end of one, is compared branch by branch, not record by record."""
    a = warc.archive(spark.createDataFrame([(i, f"http://x/{i}", "page") for i in range(256 * 40)], SCHEMA))
    b = warc.archive(spark.createDataFrame([(i, f"http://x/{i}", "page") for i in range(256 * 12 + 5)], SCHEMA))
    assert warc.heights(warc.leaves(a)) == (2, 2) and warc.heights(warc.leaves(b)) == (2, 1)
    short = warc.archive(spark.createDataFrame([(256 * i, f"http://x/{256 * i}", "page") for i in range(9)], SCHEMA))
    assert warc.heights(warc.leaves(short)) == (0, 1)
    found, counts = warc.audit(a, b)
    assert {(r["file"], r["rank"]) for r in found.collect()} == {(f, k) for f in range(12, 40) for k in range(256) if f > 12 or k >= 5}
    assert counts[0] == 1 and counts[3] < 40
    found, _ = warc.audit(short, b)
    assert found.count() == 256 * 12 + 5 - 9


def test_audit_query(spark, tmp_path):
    rows = [(i, f"http://x/{i}", "page", 7) for i in range(300)] + [(13, "again", None, 8), (None, "u", "h", 9)]
    spark.createDataFrame(rows, "page_id long, url string, html string, file int").write.parquet(f"{tmp_path}/pages.parquet")
    out = warc.query(spark, str(tmp_path))
    assert out.dtypes == [("page_id", "bigint"), ("file", "bigint"), ("offset", "bigint"), ("length", "bigint"), ("record_sha256", "string"), ("located", "boolean")]
    got = out.collect()
    assert len(got) == 301 and {r["page_id"] for r in got if r["located"] and r["page_id"] % 97 == 13} == {13, 110, 207}


def test_empty_archives(spark):
    a = warc.archive(spark.createDataFrame([], SCHEMA))
    found, counts = warc.audit(a, a)
    assert found.count() == 0 and counts == [0]


def test_licenses(spark):
    texts = ["x\n" + t + "\ny" for t in licenses.TEMPLATES.values()] + ["licensed under the apache license , version 2.0 and more", "the license was revoked", "", None, "a" * 50000 + " license", "Copyright\nCopyright"]
    rows = [(i, t, "s") for i, t in enumerate([*texts, texts[0]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert len(got) == len(rows)
    for i, name in enumerate(licenses.TEMPLATES):
        assert got[i]["licenses"] == name
        _, a, b, lacking = got[i]["spans"].rsplit(":", 3)
        assert texts[i][int(a) : int(b)] == licenses.TEMPLATES[name] and lacking == "0"
    n = len(licenses.TEMPLATES)
    assert [got[n + k]["licenses"] for k in range(6)] == ["Apache-2.0", "", "", "", "", ""]
    assert [got[n + k]["n_blocks"] for k in range(6)] == [1, 1, 0, 0, 1, 2]
    assert licenses.scan(docs.limit(0)).count() == 0


def test_savings_rank_the_right_template():
    for name, template in licenses.TEMPLATES.items():
        assert licenses.savings(template)[0][1] == name


def test_licenses_in_long_lines():
    import random

    rng = random.Random(5)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))
    for name, template in licenses.TEMPLATES.items():
        text = prose(8000) + " " + template + " " + prose(8000)
        assert len(text) > 80_000 and "\n" not in text
        (found,) = licenses.licenses(text)
        assert found[2] == name and text[found[0] : found[1]] == template and found[4] == 0


def names(text):
    return [x[2] for x in licenses.licenses(text)]


def test_wrapped_licenses():
    import textwrap

    for name, notice in [*licenses.TEMPLATES.items(), *licenses.NOTICES]:
        for prefix in ("", "# ", " * ", "// ", "    "):
            text = "first line\n\n" + textwrap.fill(notice, 40, initial_indent=prefix, subsequent_indent=prefix) + "\n\nlast line"
            assert names(text) == [name], (name, prefix, text)


def test_every_license_of_a_line():
    assert names("Licensed under the Apache License, Version 2.0. Released under the MIT License.") == ["Apache-2.0", "MIT"]
    assert names("Licensed under CC BY 4.0. All rights reserved.") == ["CC-BY-4.0", "All-rights-reserved"]
    every = [*licenses.TEMPLATES.items(), *licenses.NOTICES]
    assert sorted(names(" and then again ".join(t for _, t in every))) == sorted(n for n, _ in every)
    mit = dict(licenses.NOTICES)["MIT"]
    assert names("MIT License\n\nCopyright (c) 2020 Someone\n\n" + mit) == ["MIT"]
    assert names("the software was released early under pressure of the market, and the MIT people took no license") == []


def test_licenses_by_brute_force():
    """Damaged wordings in prose: windows, cues, counts and compression lose nothing that comparing every template with the whole text finds."""
    import random

    rng = random.Random(8)
    every = [t for _, t in [*licenses.TEMPLATES.items(), *licenses.NOTICES]]
    found = 0
    for turn in range(120):
        parts = []
        for _ in range(3):
            words = rng.choice(every).split()
            for _ in range(rng.randrange(len(words) // 6 + 1)):
                at = rng.randrange(len(words))
                words[at : at + 1] = rng.choice(([], ["damaged"], [words[at], "and"]))
            parts += [" ".join(words), " ".join(rng.choice(("some", "prose", "the", "work", "of", "to")) for _ in range(rng.randrange(200)))]
        text = rng.choice((" ", "\n", "\n# ")).join(parts)
        placed = licenses._placed(text)
        words = [w for w, _, _ in placed]
        want = {(a, b, k): (kept, 0) for k in range(len(every)) for kept, a, b in licenses.aligned(words, k)}
        want = licenses._chosen(text, [(a, b) for _, a, b in placed], want)
        assert [(a, b, n, lack) for a, b, n, _, lack in licenses.licenses(text)] == [(a, b, n, lack) for a, b, n, _, lack in want], text
        found += len(want)
    assert found > 100


def test_license_query(spark, tmp_path):
    texts = ["Released under the MIT License.", None, "", "x", "Released under the MIT License."]
    spark.createDataFrame([(i % 4, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, spans string").write.parquet(f"{tmp_path}/documents.parquet")
    out = licenses.query(spark, str(tmp_path))
    assert out.dtypes == [("doc_id", "bigint"), ("n_blocks", "bigint"), ("licenses", "string"), ("spans", "string"), ("saved", "bigint")]
    assert sorted((r["doc_id"], r["licenses"]) for r in out.collect()) == [(0, "MIT"), (0, "MIT"), (1, ""), (2, ""), (3, "")]
