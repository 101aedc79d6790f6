"""Importance resampling, hard negatives and SimHash near-dedup against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import importance, negatives, simhash_duplicates


def _lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# importance


def _brute_weights(rows, target, runs=1):
    def feats(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(text))
        return [" ".join(w[i : i + k]) for k in range(1, runs + 1) for i in range(len(w) - k + 1)], len(w)

    bucket = lambda x: zlib.crc32(x.encode()) % 10_000
    s, t = (Counter(bucket(f) for text in texts for f in feats(text)[0]) for texts in ([r[1] for r in rows], target))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + 10_000) / ((s[b] + 1) * (n_t + 10_000))))
    out = []
    for r in rows:
        found, n_words = feats(r[1])
        weight = sum(gain(bucket(f)) for f in found)
        h = None if r[0] is None else int(hashlib.sha256(f"2024:{r[0]}".encode()).hexdigest()[:8], 16)
        out.append((r[0], n_words, len(found), weight, None if h is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    return out


def _brute_ranks(scored, share, least):
    able = sorted((x for x in scored if x[1] >= least and x[4] is not None), key=lambda x: (-x[4], x[0], x[2], x[3]))
    drawn = able[: len(able) * share // 100]
    return sorted([(*x, i + 1) for i, x in enumerate(drawn)] + [(*x, None) for x in able[len(drawn) :] + [x for x in scored if x[1] < least or x[4] is None]], key=str)


@pytest.mark.parametrize(("runs", "share", "bins"), [(1, 10, 4096), (1, 60, 3), (3, 100, 4096)])
def test_resampling_by_brute_force(spark, docs, rows, monkeypatch, runs, share, bins):
    """Repeated rows, null ids and texts, ties of score by repeated ids; few ranges, so that a range holds many scores."""
    monkeypatch.setattr(importance, "BINS", bins)
    target = [r[1] for r in rows[:7]] + [None, ""]
    out = importance.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), share=share, runs=runs)
    assert out.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    got = sorted((tuple(r) for r in out.collect()), key=str)
    want = _brute_ranks(_brute_weights(rows, target, runs), share, 20)
    assert got == want
    assert any(r[5] for r in want)


def test_resampling_of_empty_tables(spark, docs, empty):
    target = spark.createDataFrame([("some words",)], "text string")
    assert importance.resample(empty, target).count() == 0
    out = importance.resample(docs, target.limit(0))  # gains from the corpus alone
    assert out.where("rank IS NOT NULL").count() == out.where("n_words >= 20 AND doc_id IS NOT NULL").count() // 10


def test_scores_do_not_depend_on_partitions(spark, docs):
    target = spark.createDataFrame([("an the on",)], "text string")
    one, two = (sorted(map(str, importance.resample(docs.repartition(n), target, share=50).collect())) for n in (1, 5))
    assert one == two


def test_oracle_checksum(spark):
    """The SQL makes CRC-32 from its polynomial."""
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.execute("INSERT INTO documents VALUES (3, 'A b-B é9 a日'), (4, NULL), (5, '')")
    con.execute("INSERT INTO benchmark VALUES (0, 'b c')")
    got = {r[0]: r[1:4] for r in con.execute(importance.ORACLE).fetchall()}
    want = _brute_weights([(3, "A b-B é9 a日"), (4, None), (5, "")], ["b c"])
    assert got == {x[0]: (x[2], x[3], x[4]) for x in want}


# hard negatives


def _brute_mine(rows, anchor, positives=5, negs=5, least=80):
    """rows: (id, label, whole vector), valid ones."""
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a in rows:
        if not anchor(a[0]):
            continue
        scored = sorted(((-dot(a[2], r[2]), r[0], r[1]) for r in rows if r[0] != a[0]))
        pos = [(i, -s) for s, i, label in scored if label == a[1]][:positives]
        for i, p in pos:
            found = [(j, -s) for s, j, label in scored if label != a[1] and least * p <= 100 * -s <= 100 * p][:negs]
            out += [(a[0], i, k, j, p, s) for k, (j, s) in enumerate(found, 1)]
    return sorted(out)


def _vectors(n, seed, dim=6, big=1):
    rng = random.Random(seed)
    out = [(k, rng.choice((0, 0, 0, 1, 2)), [round(rng.gauss(0.2, 1), 1) * float(big) for _ in range(dim)]) for k in range(n)]
    return out + [(7, 1, out[7][2]), out[20], out[20], (21, 0, out[20][2])]  # repeated ids and rows, equal vectors


@pytest.mark.parametrize(("rows", "anchors", "big"), [(1 << 17, 1 << 13, 1), (11, 3, 1), (40, 2, 1 << 18)])
def test_mining_by_brute_force(spark, rows, anchors, big):
    """Ties, repeated rows, a label with half of the rows, many blocks, components whose products exceed doubles."""
    table = _vectors(240, 5, big=big)
    odd = [(300, None, [1.0] * 6), (310, 1, None), (None, 1, [1.0] * 6), (320, 0, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (330, 0, [float("nan")] * 6), (340, 2, [float("inf")] * 6), (350, 2, [0.5, 1.0]), (360, 2, [])]
    df = spark.createDataFrame(table + odd, "vec_id long, label int, embedding array<double>").withColumn("row", F.lit("clash")).withColumn("r", F.lit(1)).repartition(3)
    out = negatives.mine(df.withColumn("vec", negatives.whole(F.col("embedding"))), F.col("vec_id") % 10 == 0, rows=rows, anchors=anchors)
    whole = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in table + odd[6:]]
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got, want = sorted(tuple(r) for r in out.collect()), _brute_mine(whole, lambda i: i % 10 == 0)
    assert got == want
    assert len(want) > 100


def test_mining_of_small_tables(spark):
    df = spark.createDataFrame([], "vec_id long, label int, vec array<bigint>")
    assert negatives.mine(df, F.col("vec_id") % 10 == 0).count() == 0
    alone = spark.createDataFrame([(0, 1, [1, 2]), (1, 2, [1, 2])], df.schema)  # no positive
    assert negatives.mine(alone, F.col("vec_id") == 0).count() == 0


def test_limits_by_definition():
    rng = random.Random(1)
    for _ in range(300):
        s = np.array(sorted((rng.randint(-30, 30) for _ in range(rng.randint(0, 20))), reverse=True), np.int64)
        p = rng.randint(-30, 30)
        begin, end = negatives.limited(s, p, 4)
        assert s[begin:end].tolist() == [x for x in s.tolist() if 80 * p <= 100 * x <= 100 * p][:4]


# SimHash near-dedup


def _brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", _lower(text))
    terms = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(t.encode(), 42) for t in terms]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _brute_components(points, radius=2):
    """Least member of each point's component."""
    points, up = sorted(points), {p: p for p in points}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(points):
        for b in points[i + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= radius:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {p: root(p) for p in points}


def test_simhash_by_brute_force(spark, docs, rows):
    """Every row's fingerprint and component, with repeated ids, null ids and texts without words."""
    marks, found = simhash_duplicates.classes(docs)
    got = Counter((r["doc_id"], r["point"] & (2**64 - 1), r["component"]) for r in marks.join(found, "point", "left").collect())
    fps = [(r[0], _brute_fingerprint(r[1])) for r in rows]
    roots, least = _brute_components({p for _, p in fps}), {}
    for i, p in fps:
        if i is not None:
            least[roots[p]] = min(i, least.get(roots[p], i))
    assert got == Counter((i, p, least.get(roots[p])) for i, p in fps)
    assert simhash_duplicates.fingerprint(None) == simhash_duplicates.fingerprint(" \n") == 0


def test_long_text():
    text = " ".join(random.Random(2).choices(["a", "bb", "ccc", "é"], k=40_000))
    assert simhash_duplicates.fingerprint(text) == _brute_fingerprint(text)


def _points(seed):
    """Random points, pairs at each distance up to 3, chains, and a dense group whose values go together."""
    rng = random.Random(seed)
    flip = lambda p, k: p ^ sum(1 << b for b in rng.sample(range(64), k))
    base = [rng.getrandbits(64) for _ in range(150)]
    out = {*base, 0, 1, 2**63, 2**64 - 1}
    out |= {flip(p, 1 + i % 3) for i, p in enumerate(base)}
    p = base[0]
    for _ in range(30):
        out.add(p := flip(p, 2))
    out |= {base[1] ^ sum(1 << b for b in rng.sample(range(12), rng.randint(1, 6))) for _ in range(150)}
    return sorted(out)


@pytest.mark.parametrize(("choices", "group"), [((2,), 64), ((3,), 64), ((4,), 6), ((2, 3, 4), 20), ((2, 3), 2)])
def test_hamming_join_by_brute_force(spark, choices, group):
    """All partitionings, values of few and of many points; links that aren't in radius would join components."""
    points = _points(3)
    signed = [(p - 2**64 if p >= 2**63 else p, 1) for p in points]
    df = spark.createDataFrame(signed, "point long, id long").repartition(3)
    found = [(r["a"], r["b"]) for r in simhash_duplicates.links(df, len(points), group, choices).collect()]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in found)
    up = {p: p for p, _ in signed}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in found:
        up[root(a)] = root(b)
    got, want = defaultdict(set), defaultdict(set)
    for p, _ in signed:
        got[root(p)].add(p & (2**64 - 1))
    for p, r in _brute_components(points).items():
        want[r].add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_thresholds_follow_the_data():
    """Units add up for every point; where a partition's values are common, a point searches it less."""
    rng = np.random.default_rng(1)
    points = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    points[:3000] = (points[:3000] & ~np.uint64(0x3FFFFF)) | np.uint64(0x155555)  # 22 low bits are equal in most points
    both = simhash_duplicates._together(points).reshape(64, 64)
    plan = simhash_duplicates.Partitioning([list(range(22)), list(range(22, 43)), list(range(43, 64))])
    plan.learn(plan.count(points), len(points))
    units, cost = plan.allocate(points)
    assert (units.sum(axis=1) == simhash_duplicates.RADIUS + 1).all()
    assert (units[:3000, 0] == 0).all() and (units[3000:] == 1).all()
    assert np.isfinite(cost).all()
    assert sorted(b for p in simhash_duplicates.grouped(both, len(points), 3) for b in p) == list(range(64))


def test_correlated_bits_share_a_partition():
    rng = np.random.default_rng(2)
    points = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    for a, b in ((0, 40), (5, 60), (9, 33)):  # bit b copies bit a
        bit = (points >> np.uint64(a)) & np.uint64(1)
        points = (points & ~np.uint64(1 << b)) | (bit << np.uint64(b))
    parts = simhash_duplicates.grouped(simhash_duplicates._together(points).reshape(64, 64), len(points), 3)
    assert sorted(map(len, parts)) == [21, 21, 22]
    assert all(any({a, b} <= {*p} for p in parts) for a, b in ((0, 40), (5, 60), (9, 33)))


def test_empty_and_keep(spark, docs, empty, rows):
    marks, found = simhash_duplicates.classes(empty)
    assert marks.count() == found.count() == 0
    kept = simhash_duplicates.keep(docs)
    assert kept.columns == docs.columns
    got = Counter(r["doc_id"] for r in kept.collect())
    fps = [(r[0], _brute_fingerprint(r[1])) for r in rows]
    roots, least = _brute_components({p for _, p in fps}), {}
    for i, p in fps:
        if i is not None:
            least[roots[p]] = min(i, least.get(roots[p], i))
    assert got == Counter(i for i, p in fps if i is None or least[roots[p]] == i)
