import corpus_pipeline
from tessera.llm import secrets
from tessera.llm.bpe import codec

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, DIR).cache()
        if name != "bpe_encode":
            assert docs.columns == columns, name
        if name in ("quality_rules", "near_dedup"):
            assert 0 < docs.count() < before.count()
        if name == "secret_scan":
            assert docs.count() == before.count() and not any(secrets.spans(r["text"]) for r in docs.collect())
        seen.append((name, docs))
    mixed, encoded = seen[-2][1], seen[-1][1]
    want = sorted((r["doc_id"], r["text"]) for r in mixed.collect())
    import pyarrow as pa

    rows = encoded.collect()
    texts = codec().decode(pa.array([bytes(r["ids"]) for r in rows], pa.binary())).to_pylist()
    assert sorted((r["doc_id"], t.decode()) for r, t in zip(rows, texts, strict=True)) == want


def test_near_dedup_takes_similarity_of_80(spark):
    words = lambda k: [f"w{k}x{i}" for i in range(104)]
    rows = []
    for k in range(10):
        for copy, changed in ((0, 0), (1, 10), (2, 13)):  # of 100 sets of five words each: similarity 90 / 110 = 0.82 and 87 / 113 = 0.77
            w = words(3 * k + (copy == 2))
            rows.append((100 * k + 10 * copy, " ".join(w[: 104 - changed] + [f"new{k}x{copy}x{i}" for i in range(changed)])))
        rows.append((100 * k + 90, " ".join(words(3 * k + 1))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, DIR).collect()}
    assert kept == {100 * k + i for k in range(10) for i in (0, 20, 90)}


ODD = "doc_id long, text string, lang string, source string, n_chars long, size int, `a.b` string, component map<string, int>"


def test_stages_with_odd_rows(spark):
    """Every stage on nulls in each column, empty and very long texts, repeated rows and extra columns with clashing names."""
    import random

    rng = random.Random(6)
    prose = lambda n: " ".join(rng.choice("abcdefgh") + rng.choice("ijklmnop") + rng.choice("qrstuvwx") for _ in range(n))
    good = [prose(80) for _ in range(12)]
    long = prose(60_000)
    rows = [(i, t, "en", f"s{i % 3}", len(t), 1, "x", {"k": 1}) for i, t in enumerate(good)]
    rows += [(20, None, None, None, None, None, None, None), (21, "", "en", "s1", 0, 1, "x", {}), (None, good[0], "en", None, 320, 1, "x", None), (22, long, None, "s0", len(long), 2, None, {"k": None})]
    rows += [(30, good[1], "fr", "s1", 320, 1, "y", {"k": 1}), (3, good[3], "en", "s0", len(good[3]), 1, "x", {"k": 1}), (31, "api_key = abcdefgh12345678 " + good[4], None, "s2", None, 1, "x", None)]
    docs = spark.createDataFrame(rows, ODD)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DIR)
        empty = stage(spark, docs.limit(0), DIR)
        assert empty.count() == 0 and empty.columns == out.columns, name
        if name != "bpe_encode":
            assert out.columns == docs.columns, name
        got = out.collect()
        ids = [r["doc_id"] for r in got]
        if name == "quality_rules":
            assert not {20, 21} & set(ids) and {*range(12), 22, None} <= set(ids) and ids.count(3) == 2
        if name == "near_dedup":
            assert sorted(ids, key=str) == sorted([*range(12), 3, 20, 21, 22, None], key=str)  # 30 and 31 are near copies
        if name == "secret_scan":
            assert len(got) == len(rows) and next(r["text"] for r in got if r["doc_id"] == 31).startswith(secrets.MASK)
        if name == "mix_sources":
            assert {20, 21}.isdisjoint(ids) and 22 in ids
        if name == "bpe_encode":
            assert len(got) == len(rows) and all(r["n_tokens"] * 4 == len(r["ids"]) for r in got)


def test_run(spark, tmp_path):
    """The whole pipeline: clean documents come through it, rejected ones and copies don't."""
    import shutil

    import pyarrow.parquet as pq

    shutil.copytree(DIR, tmp_path / "sf")
    out = corpus_pipeline.run(spark, str(tmp_path / "sf"))
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids"]
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{DIR}/documents.parquet").to_pylist()}
    kept = {r["doc_id"] for r in out.collect()}
    assert kept <= set(texts) and all(len((texts[i] or "").split()) >= 50 for i in kept)
    from test_operators import brute_components

    _, component = brute_components([(i, t) for i, t in texts.items() if len((t or "").split()) >= 50])
    assert len({component[i] for i in kept}) == len(kept)
