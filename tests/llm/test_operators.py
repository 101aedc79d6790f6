"""Each operator against brute force on a small table that has every odd case, and on an empty one."""

import collections
import hashlib
import re

import numpy as np
import pytest

from tessera.llm import bpe, fingerprints, mixing, near_duplicates, quality_classifier, quality_rules, secrets, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_id(df, rows):
    """Rows of ``df`` by id; every row of the table gives one."""
    found = df.collect()
    assert len(found) == len(rows)
    return collections.defaultdict(list, {k: [r for r in found if r["doc_id"] == k] for k in {r["doc_id"] for r in found}})


def test_bpe(spark, docs, rows, empty):
    enc = secrets.encoder()
    slim = docs.select("doc_id", "text", "id")
    got = by_id(bpe.round_trip(slim), rows)
    for r in rows:
        want = np.array(enc.encode_ordinary(r[1] or ""), "<u4").tobytes()
        for x in got[r[0]]:
            assert bytes(x["ids"]) == want
            assert bytes(x["decoded"]) == (r[1] or "").encode()
            assert x["id"] == "y"
    apart = by_id(bpe.decode(bpe.encode(slim)), rows)
    assert all(apart[k][0]["decoded"] == got[k][0]["decoded"] for k in got)
    assert bpe.round_trip(empty.select("doc_id", "text")).count() == 0


def test_bpe_long_words():
    """Words of windows against tiktoken: runs, periods, random letters, characters cut by a border, and every length around a window's."""
    import random
    import time

    import pyarrow as pa

    enc, codec = secrets.encoder(), bpe.codec()
    rng = random.Random(1)
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    texts = ["=" * 5000, "ab" * 2000 + "xyz" * 700, "thequickbrown" * 200, some("etaoin", 2500), "Āb" * 500, some("abcdefghijklmnopqrstuvwxyz", 20_000), some("日本語é", 1500), "".join(rng.choice(("=", "-", "_")) * rng.randint(1, 150) for _ in range(30))]
    texts += ["a" * n for n in range(60, 132)] + [some("ehtr", n) for n in range(60, 132)]
    got = codec.encode(pa.array([[t] for t in texts], pa.list_(pa.string()))).to_pylist()
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == enc._encode_single_piece(text)
    began = time.time()
    ids = codec.encode(pa.array([["=" * 2_000_000], [some("abcdefgh", 300_000)]], pa.list_(pa.string())))
    assert [len(x) for x in codec.decode(ids).to_pylist()] == [2_000_000, 300_000] and time.time() - began < 60


def test_bpe_long_rules():
    """Words of punctuation in mixed runs, of which windows of the grid rarely join, against tiktoken and the clock."""
    import random
    import time

    import pyarrow as pa

    enc, codec, rng = secrets.encoder(), bpe.codec(), random.Random(2)

    def runs(n, most):
        out = ""
        while len(out) < n:
            out += rng.choice("=-_") * rng.randint(1, most)
        return out[:n]

    rule = "=" * 72 + "-" * 72
    for text, most in [(rule * 70, 5), (rule * 7000, 60), (runs(8000, 80), 20), (runs(20_000, 2000), 20), ("-" + "=-" * 4000 + "_", 20)]:
        start = time.time()
        (ids,) = codec.encode(pa.array([[text]], pa.list_(pa.string()))).to_pylist()
        assert time.time() - start < most
        assert ids == np.array(enc.encode_ordinary(text), "<u4").tobytes()


def test_bpe_query(spark, tmp_path):
    """The digests of op1, from tiktoken, on a table with odd cases and a clashing column."""
    enc = secrets.encoder()
    texts = ["Some words, 123 and\n more\u3000ones", "", None, "x" * 200, " \n\t ", "émoji 🙂🙂 naïve", "Some words, 123 and\n more\u3000ones"]
    spark.createDataFrame([(i % 6, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, ids string").write.parquet(f"{tmp_path}/documents.parquet")
    out = bpe.query(spark, str(tmp_path))
    assert out.dtypes[:4] == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    got = collections.Counter(tuple(r)[:4] for r in out.collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    ids = [enc.encode_ordinary(t or "") for t in texts]
    assert got == collections.Counter((i % 6, len(x), sha(np.array(x, "<u4").tobytes()), sha((t or "").encode())) for i, (t, x) in enumerate(zip(texts, ids, strict=True)))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert bpe.encode(docs).columns == ["doc_id", "ids"] and bpe.decode(bpe.encode(docs).withColumnRenamed("doc_id", "decoded")).columns == ["ids", "decoded"]
    assert sorted(bpe.round_trip(docs).columns) == ["decoded", "doc_id", "ids"]


def test_secrets(docs, rows, empty):
    got = by_id(secrets.scan(docs), rows)
    kinds = ("assign", "access", "hex")
    for r in rows:
        t = r[1] or ""
        want = [(m.start(), 0, m.end()) for m in secrets.ASSIGN.finditer(t) if len(m[2]) >= 8]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        said = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(want))
        for x in got[r[0]]:
            assert x["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
            assert (x["n_assign"], x["n_access"], x["n_hex"]) == tuple(sum(k == i for _, k, _ in want) for i in range(3))
            assert set(said.split(",")) <= set(x["spans"].split(","))
    assert secrets.scan(empty).count() == 0
    kept = secrets.masked(docs)
    assert kept.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert texts[rows[8][0]] == rows[8][1] and "deadbeef" not in str([t for t in texts.values() if t and "é" in t and secrets.MASK in t])


@pytest.mark.parametrize(("run", "random"), [("kX9vQ2mLpR7tZw4B", True), ("camelCaseNameNumber2", False), ("d41d8cd98f00b204e9800998ecf8427e", False), ("123e4567-e89b-12d3-a456-426614174000", False), ("onlylettersinthisone", False)])
def test_random_strings(run, random):
    assert secrets.is_random(run) is random


@pytest.mark.parametrize("run", ["to_be_or_not_to_be_it_is", "get_user_by_id_or_name", "src/main/java/org/foo/Bar", "state-of-the-art-thing", "1234567890123456", "-" * 20])
def test_words_are_not_random(run):
    assert not secrets.is_random(run)


def test_random_strings_of_any_letters():
    import random
    import string

    rng = random.Random(11)
    for letters in (string.ascii_lowercase, string.ascii_uppercase, string.ascii_letters, string.ascii_lowercase + string.digits, string.ascii_letters + string.digits):
        for n in (16, 20, 32, 40):
            runs = ["".join(rng.choice(letters) for _ in range(n)) for _ in range(300)]
            assert sum(map(secrets.is_random, runs)) >= 290, (letters, n)
            assert sum(secrets.redact(f"a {r} b") == f"a {secrets.MASK} b" for r in runs) >= 290


def test_quality_rules(spark, docs, rows, empty):
    trusted = spark.createDataFrame([(r[0],) for r in rows[:30]], "doc_id long")
    out = quality_rules.judge(docs, trusted)
    got = by_id(out, rows)
    for r in rows:
        t = r[1] or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        windows = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        inside = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
        failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
        for x in got[r[0]]:
            assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"], x["base_failed"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside), failed)
            assert not (failed and x["kept"])
    kept = quality_rules.keep(docs, trusted)
    assert kept.columns == docs.columns
    assert kept.count() == out.where("kept").count()
    clash = quality_rules.base(docs.withColumnsRenamed({"taken": "n_words", "id": "score"}))  # results replace columns of their names
    assert sorted(clash.columns) == sorted({*docs.columns, *quality_rules.COUNTS, "base_failed", "score"} - {"taken", "id"})
    assert quality_rules.keep(docs.withColumnRenamed("id", "a.b"), trusted).columns[-1] == "a.b"
    none = quality_rules.judge(docs, trusted.limit(0))  # without trusted texts the base rules decide
    assert none.where("kept = base_failed").count() == 0
    assert quality_rules.judge(empty, trusted).count() == 0


def grams_of(text):
    """Buckets of words and pairs of adjacent words, from the definition of Spark's hash: one value seeds the next."""
    import xxhash

    words = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORD.findall(text or "")]
    one = lambda x, seed: xxhash.xxh64_intdigest(x.to_bytes(8, "little"), seed)
    return [x >> 48 for x in [*words, *(one(y, one(x, 42)) for x, y in zip(words, words[1:]))]]


def test_log_ratio_by_hand(spark, docs, rows):
    """The model and the scores, from their definition; trusted ids broadcast or joined."""
    ids = {r[0] for r in rows[:10]}
    trusted = spark.createDataFrame([(i,) for i in [*ids, None]], "doc_id long")
    raw, good = np.zeros(quality_rules.BUCKETS), np.zeros(quality_rules.BUCKETS)
    for r in rows:
        for b in grams_of(r[1]):
            raw[b] += 1
            good[b] += r[0] in ids
    want = np.log((good + quality_rules.PRIOR) / (raw * good.sum() / raw.sum() + quality_rules.PRIOR))
    assert np.allclose(quality_rules.fit(docs, trusted), want)
    assert np.allclose(quality_rules.fit(docs, trusted, most=3), want)
    found = quality_rules.judge(docs, trusted).select("doc_id", "score").collect()
    scores = {r["doc_id"]: r["score"] for r in found}
    for r in rows:
        g = grams_of(r[1])
        assert abs(scores[r[0]] - (np.mean(want[g]) if g else 0)) < 1e-6
    alone = {r["doc_id"]: r["score"] for r in quality_rules.score(docs, want.tolist()).select("doc_id", "score").collect()}
    assert all(abs(alone[i] - x) < 1e-6 for i, x in scores.items())


def test_vocabulary_decides(spark):
    """Words that the trusted texts use are kept; a text of other lower-case words that the corpus repeats is not."""
    import random

    rng = random.Random(3)
    use = [f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(60)]
    spam = [f"spam{'abcdefghij'[i]}" for i in range(10)]
    texts = [" ".join(rng.choice(use) for _ in range(200)) for _ in range(60)] + [" ".join(rng.choice(spam) + rng.choice("uvwxyz") for _ in range(200)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in quality_rules.keep(docs, spark.createDataFrame([(i,) for i in range(30)], "doc_id long")).collect()}
    assert kept == set(range(60))


def test_filtered_quality_rules_compute_once(spark):
    """A filter on a result must not be computed below the array steps; it took minutes for one long text."""
    import random
    import time

    rng = random.Random(4)
    text = " ".join(rng.choice("abcdefghij") + rng.choice("klmnopqrst") for _ in range(40_000))
    docs = spark.createDataFrame([(i, text) for i in range(4)], "doc_id long, text string")
    out, began = quality_rules.judge(docs, docs.select("doc_id")), time.time()
    for condition in ("kept", "base_failed", "n_repeat_words > 0", "n_dup_lines = 0", "score > 0"):
        out.where(condition).count()
        out.where(condition).select("doc_id").count()
    assert time.time() - began < 60


def test_mixing(docs, rows, empty):
    got = mixing.placed(docs).collect()
    assert len(got) == len(rows)
    size, source = collections.Counter(), {r[0]: r[3] for r in rows}
    for r in rows:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    order = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, active, target = 1.5 * sum(size.values()), set(order), {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in active) for s in active}
        over = {s for s in active if share[s] > 2 * size[s]}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * size[s] for s in over}
        left -= sum(target[s] for s in over)
        active -= over
    taken = collections.Counter()
    for x in got:
        s = source[x["doc_id"]]
        taken[s] += x["taken"]
        assert abs(x["target"] - target[s]) < 1e-6 and x["source_size"] == size[s] and 0 <= x["taken"] <= 2 * x["size"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    again = {(x["doc_id"], x["taken"], x["position_1"]) for x in mixing.placed(docs.repartition(5)).collect()}
    assert again == {(x["doc_id"], x["taken"], x["position_1"]) for x in got}
    assert mixing.placed(empty).count() == 0
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    words = sum(len(WORD.findall(r["text"])) for r in mixed.collect())
    assert words == sum(x["taken"] for x in got)


def test_rows_that_differ_in_one_column_are_apart(spark):
    """Equal ids and texts of other languages and sources, a column with a map and one with a dot: each row is taken as often as planned."""
    rows = [(1, "one two three four", lang, source, {"k": 1}, "z") for lang, source in (("en", "a"), ("fr", "a"), ("en", "b"), (None, "en"), ("en", None), ("en", "a"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, extra map<string, int>, `size.x` string")
    want = collections.Counter()
    for r in docs.select("lang", "source", "*").collect():
        want[r["lang"], r["source"]] += 4
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    got = collections.Counter()
    for r in mixed.collect():
        got[r["lang"], r["source"]] += len(r["text"].split())
    assert set(got) <= set(want) and all(got[k] <= 2 * want[k] for k in got) and sum(got.values()) == sum(r["taken"] for r in mixing.placed(docs).collect())


def test_mixing_query(spark, tmp_path):
    texts = ["a b c", "", None, "d e", "a b c d e f g h", "i j"]
    spark.createDataFrame([(i, t, (None, "s", "t")[i % 3], 5) for i, t in enumerate(texts)], "doc_id long, text string, source string, taken int").write.parquet(f"{tmp_path}/documents.parquet")
    out = mixing.query(spark, str(tmp_path))
    assert out.dtypes[:5] == [("doc_id", "bigint"), ("size", "bigint"), ("source_size", "bigint"), ("target", "double"), ("taken", "bigint")]
    assert {r["doc_id"]: r["size"] for r in out.collect()} == {i: len((t or "").split()) for i, t in enumerate(texts)}


def test_demand_is_inverted(spark):
    from pyspark.sql import functions as F

    for place, (a, b) in enumerate(mixing.SCHEDULES):
        for share in (0.0, 0.2, 0.5, 0.9, 1.0):
            t = spark.range(1).select(mixing._time(F.lit(share), F.lit(place))).first()[0]
            assert abs((a * t + (b - a) * t * t / 2) / ((a + b) / 2) - share) < 1e-9


def test_sharding(spark, docs, rows, empty):
    out = sharding.shard(docs, shards=4)
    assert out.columns == [*[c for c in docs.columns if c != "shard"], "shard", "slot"]
    got = out.collect()
    assert len(got) == len(rows)
    slots, sizes = collections.defaultdict(list), collections.Counter()
    for x in got:
        slots[x["shard"]].append(x["slot"])
        sizes[x["shard"]] += len((x["text"] or "").encode()) + 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(len((r[1] or "").encode()) + 8 for r in rows)
    assert all(abs(sizes[k] - sum(sizes.values()) / 4) <= largest for k in range(4))
    assert sharding.shard(empty.drop("shard")).count() == 0


@pytest.mark.parametrize("cell", [sharding.CELL, 200])
def test_sharding_query(spark, tmp_path, cell, monkeypatch):
    """op7's contract, with one cell a shard and with many."""
    import zlib

    monkeypatch.setattr(sharding, "CELL", cell)
    rng = np.random.default_rng(5)
    texts = [None, "", *("é" * int(n) for n in rng.integers(0, 60, 900)), *["copy of this text"] * 500]
    spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, slot int").write.parquet(f"{tmp_path}/documents.parquet")
    out = sharding.query(spark, str(tmp_path))
    assert out.dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")]
    got = out.collect()
    slots, sizes = collections.defaultdict(list), collections.Counter()
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert len(got) == len(texts) and set(slots) == set(range(24)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= 2 * 130


def test_splitters_split_a_hot_key(spark):
    from pyspark.sql import functions as F

    keys = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.lit(12345)).otherwise(F.xxhash64("id")).alias("k1"), F.col("id").alias("k2"), F.lit(10).cast("long").alias("size"))
    bounds, counts, rounds = sharding.splitters(keys, 12)
    assert sum(counts) == 9000 and max(counts) - min(counts) <= 0.03 * 9000 / 12 + 2 and rounds < 12


def test_fingerprints(spark, docs, rows, empty):
    got = fingerprints.fingerprint(docs, "text", ["doc_id"], "fp")
    got = {r["doc_id"]: r["fp"] for r in got.collect()}
    by_text = collections.defaultdict(set)
    for r in rows:
        by_text[r[1] or ""].add(got[r[0]])
    assert all(len(v) == 1 for v in by_text.values()) and all(len(v) == 32 for v in got.values()) and by_text[""] == {"0" * 32}
    texts = {}
    for r in rows:
        if r[0] is not None:
            texts[r[0]] = r[1] or ""
    ids = sorted(texts, reverse=True)
    after = {i: ids[(k + 1) % len(ids)] for k, i in enumerate(ids)}
    assert {r["doc_id"]: r["next_id"] for r in fingerprints.next_ids(docs.select("doc_id")).collect()} == after
    for r in fingerprints.edited(docs.select("doc_id", "text")).collect():
        if r["doc_id"] is not None:
            t, n = texts[r["doc_id"]], texts[after[r["doc_id"]]]
            assert r["edited"] == t[: len(t) - len(t) // 2] + n[: len(t) // 2]
    assert fingerprints.edited(empty.select("doc_id", "text")).count() == 0


def simhash(text):
    """Fingerprint by definition: a bit is set where more than half of the word pairs' hashes have it."""
    import xxhash

    word = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORD.findall(text or "")]
    one = lambda seed, *xs: one(xxhash.xxh64_intdigest(xs[0].to_bytes(8, "little"), seed), *xs[1:]) if xs else seed
    four = lambda seed, x: xxhash.xxh64_intdigest(x.to_bytes(4, "little"), seed)
    pairs = list(zip(word, word[1:], strict=False)) or [(w, None) for w in word]
    hashes = []
    for a, b in pairs:
        known = [x for x in (b,) if x is not None]
        hashes.append((one(42, a, *known) << 64) | one(four(one(42, *known), 7), a))
    return f"{sum(1 << i for i in range(128) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes)):032x}"


@pytest.mark.parametrize("repeated", [True, False])
def test_fingerprint_query(spark, tmp_path, repeated):
    """op2 by brute force, with and without repeated ids."""
    texts = ["one", "", None, "two words", "a b c d e f g h i j k l m n", "a b c d e f g h i j k l m o", "a b c d e f g h i j k l m n", "日本 🙂🙂 naïve é", "x " * 300] + [f"w{i} " * 9 + "common tail of words" for i in range(40)]
    rows = [(3 * i, t, "clash") for i, t in enumerate(texts)] + ([(6, "again", "c"), (6, "zagain", "c"), (9, texts[3], "c"), (None, "no id here", "c"), (None, "no id here", "c")] if repeated else [])
    spark.createDataFrame(rows, "doc_id long, text string, next_id string").write.parquet(f"{tmp_path}/documents.parquet")
    got = fingerprints.query(spark, str(tmp_path))
    assert [t for _, t in got.dtypes] == ["bigint", "bigint", "string", "string", "string", "double", "double", "bigint"]
    by = collections.defaultdict(list)
    for i, t, _ in rows:
        by[i].append(t or "")
    ids = sorted((i for i in by if i is not None), reverse=True)
    marks = {simhash(t) for _, t, _ in rows}
    apart = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    want = []
    for i, t, _ in rows:
        t, nxt = t or "", None if i is None else max(by[ids[(ids.index(i) + 1) % len(ids)]])
        half = len(t) // 2
        e = t[: len(t) - half] + (nxt or "")[:half]
        mine = simhash(t)
        after = mine if nxt is None else max(simhash(x) for x in by[ids[(ids.index(i) + 1) % len(ids)]])
        n_near = sum(apart(mine, m) <= fingerprints.RADIUS for m in marks) if i is not None and i % 20 == 0 else None
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), mine, simhash(e), 1 - apart(mine, simhash(e)) / 128, 1 - apart(mine, after) / 128, n_near))
    key = lambda r: str(tuple(r))
    assert sorted(map(key, map(tuple, got.collect()))) == sorted(map(key, want))


def test_next_ids_over_wide_gaps(spark):
    ids = [-(10**12), -5, 0, 1, 4095, 4096, 10**7, 10**7 + 1, 10**13]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    assert {r[0]: r[1] for r in fingerprints.next_ids(df).collect()} == {b: a for a, b in zip(ids, ids[1:])} | {ids[0]: ids[-1]}


def test_block_tables_find_all(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 2**62, 40)]
    marks = {f"{b:032x}" for b in base}
    for b in base:
        for k in range(5):
            flip = 0
            for bit in rng.choice(128, k, replace=False):
                flip |= 1 << int(bit)
            marks.add(f"{b ^ flip:032x}")
    marks = sorted(marks)
    df = spark.createDataFrame([(m,) for m in marks], "fingerprint string")
    got = {(r["query"], r["entry"], r["distance"]) for r in fingerprints.near(df, df).collect()}
    assert got == {(a, b, (int(a, 16) ^ int(b, 16)).bit_count()) for a in marks for b in marks if (int(a, 16) ^ int(b, 16)).bit_count() <= fingerprints.RADIUS}


def shingle_set(t):
    w = (t or "").encode().lower().split()
    return frozenset(zip(w, w[1:], w[2:], w[3:], w[4:], strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = {r[0]: shingle_set(r[1]) for r in rows if r[0] is not None}
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return sets, {i: top(i) for i in ids}


@pytest.mark.parametrize("group", [near_duplicates.GROUP, 1])
def test_near_duplicates(docs, rows, group):
    """Against all pairs; with ``group`` 1 every open key goes by its rarest shingles."""
    got, found = near_duplicates.classes(docs, group=group)
    out = got.join(found, "digest", "left").collect()
    assert len(out) == len(rows)
    sets, want = brute_components(rows)
    for r in out:
        if r["doc_id"] is not None:
            assert r["n"] == len(sets[r["doc_id"]])
            assert (r["component"] if r["component"] is not None else r["doc_id"]) == want[r["doc_id"]]


def test_near_duplicates_keep(spark, docs, rows, empty):
    """A repeated id on different texts is judged by each of its texts."""
    ids, texts = {r[0] for r in rows}, [r[1] for r in rows if r[1] and len(r[1].split()) > 60 and r[0] is not None]
    low, high = min(i for i in ids if i is not None) - 1, 5000
    more = [(low, texts[0]), (high, texts[0] + " z"), (high, " ".join(f"alone{i}" for i in range(50))), (high, None)]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    kept = near_duplicates.keep(both)
    assert kept.columns == both.columns
    _, want = brute_components([r for r in rows])
    left = collections.Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert (low, texts[0]) in left and not any(i == high and t and t.endswith(" z") for i, t in left)
    assert (high, None) in left and sum(i == high for i, _ in left) == 2
    assert all(i in (low, high, None) or want[i] == i for i, _ in left) and near_duplicates.keep(empty).count() == 0


def test_open_groups_meet_on_rare_shingles(spark):
    """Classes that share most of their shingles and still stay apart, and two of them that don't."""
    sets = {k: [*range(80), *(1000 * k + i for i in range(20))] for k in range(1, 40)}
    sets[50] = [*sets[3][:-3], 99001, 99002, 99003]
    df = spark.createDataFrame(sorted(sets.items()), "node long, items array<bigint>")
    keys = collections.defaultdict(set)
    for r in near_duplicates.rarest(df, 85).collect():
        keys[r["key"]].add(r["node"])
    assert {tuple(sorted(v)) for v in keys.values() if len(v) < 30} == {(3, 50)}


def test_components(spark):
    import random

    rng = random.Random(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(200, 400)] + [(399, 160)] + [(rng.randrange(500, 700), rng.randrange(500, 700)) for _ in range(90)]
    parent = {x: x for e in links for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["comp"] for r in near_duplicates.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: top(x) for a, b in links if a != b for x in (a, b)}


def test_quality_classifier(spark, docs, rows, empty):
    labels = spark.createDataFrame([(r[0], int(not re.search("!!|###", r[1] or "")), 0) for r in rows], "doc_id long, quality int, toxic int")
    trees = quality_classifier.fit(docs, labels)
    out = quality_classifier.score(docs, trees).collect()
    assert len(out) == len(rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out)
    assert {r["held_out"] for r in out} == {True, False}
    assert quality_classifier.score(empty, quality_classifier.fit(docs, labels.limit(0))).count() == 0


def test_statistics_by_definition():
    text = "Two words, HERE.\n\nagain again 12 | é!\nagain again 12 | é!\n averyveryverylongword"
    got = dict(zip(quality_classifier.FEATURES, quality_classifier.statistics(text), strict=True))
    raw, words, lines = text.encode(), text.encode().split(), [x for x in text.encode().split(b"\n") if x.strip()]
    n, k = len(raw), len(words)
    want = {"n_chars": np.log1p(n), "n_words": np.log1p(k), "mean_word": sum(map(len, words)) / k, "long_words": 1 / k, "distinct_words": len(set(words)) / k, "digit": 4 / n, "pipes": 2 / k, "bangs": 2 / k,
            "high_bytes": 4 / n, "n_lines": np.log1p(len(lines)), "repeated_lines": 1 / len(lines), "mean_line": k / len(lines), "capital_words": 1 / len(set(words)), "commas": 1 / k, "space": (k - 1 + 2) / n}
    assert all(abs(got[f] - x) < 1e-9 for f, x in want.items()), {f: (got[f], x) for f, x in want.items() if abs(got[f] - x) > 1e-9}
    assert len(quality_classifier.statistics("")) == len(quality_classifier.FEATURES)


def test_trees_are_walked_as_nested_rules():
    """The flattened arrays against a walk of one row at a time."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, len(quality_classifier.FEATURES))).astype(np.float32)
    x[:20] = x[20:40]  # ties
    trees = quality_classifier.grow(x, (x[:, 2] * x[:, 3] > 0).astype(float))

    def walk(row, feature, threshold, value, node=0):
        inner = len(feature)
        return value[node - inner] if node >= inner else walk(row, feature, threshold, value, 2 * node + 1 + int(row[feature[node]] > threshold[node]))

    want = [1 / (1 + np.exp(-(trees.start + sum(walk(r, *t) for t in zip(trees.feature, trees.threshold, trees.value, strict=True))))) for r in x]
    assert np.allclose(trees.probability(x), want)


def test_repeated_ids_are_learned_from_alike(spark):
    rows = [(i, f"text {i} " * (3 + i % 5) + "!" * (i % 2)) for i in range(60)]
    rows += [(i, "another text of that id") for i in range(0, 60, 3)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (2, None, 1)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = (quality_classifier.fit(d, labels) for d in (docs, docs.orderBy(docs.text.desc()).repartition(7)))
    assert np.array_equal(one.threshold, two.threshold) and np.array_equal(one.value, two.value)


def test_queries_of_contract(spark, tmp_path):
    """Names and types of op3, op5, op9 and op10, and op10's rows by brute force."""
    texts = [None, "", "a b", "a b", *(" ".join(f"w{(i * 7 + j * (1 + i // 9)) % 400}" for j in range(60)) for i in range(30))]
    texts += [texts[9], texts[9].replace("w", "W", 3), " ".join([*texts[9].split()[:-1], "end"])]
    rows = [(2 * i, t, "s", "x") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, kept string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(2 * i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d = str(tmp_path)
    assert secrets.query(spark, d).dtypes == [("doc_id", "bigint"), ("n_assign", "bigint"), ("n_access", "bigint"), ("n_hex", "bigint"), ("base_sha256", "string"), ("spans", "string")]
    assert quality_classifier.query(spark, d).dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    nine = quality_rules.query(spark, d)
    assert nine.dtypes[:8] == [("doc_id", "bigint"), *((c, "bigint") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", "boolean"), ("kept", "boolean")]
    assert nine.where("kept IS NULL OR base_failed IS NULL").count() == 0 and nine.count() == len(rows)
    ten = near_duplicates.query(spark, d)
    assert ten.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    sets, want = brute_components(rows)
    assert sorted(map(tuple, ten.collect())) == sorted((i, len(sets[i]), want[i], want[i] == i) for i in sets)


def test_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, len(quality_classifier.FEATURES))).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 5] > 0)).astype(float)
    trees = quality_classifier.grow(x[:3000], y[:3000])
    assert ((trees.probability(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95


def test_held_out_accuracy(spark):
    """On the given labels, from rows that were never learned from."""
    d = "/root/testdata/sf0.01"
    out = quality_classifier.query(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    assert sum(r["predicted"] == r["quality"] for r in out) >= 0.93 * len(out)
