"""Retrieval by terms and related items, compared with plain Python on small tables."""

import collections
import datetime
import math
import random
import re

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import retrieval

DAY = datetime.datetime(2024, 3, 1)


def test_index_terms(spark):
    def terms(text):
        return spark.createDataFrame([(text,)], "t string").select(T.index_terms(F.col("t"))).first()[0]

    assert terms("The Report of 2024, on TEXT-mining a x3") == ["report", "text", "mining", "x3"]
    assert terms("মানুষদের বাড়িতে") == terms("মানুষ বাড়ি")
    apart = "\u09af\u09bc"  # a letter that is one code point or two
    assert terms(f"ভু{apart}া ক{apart}েকটি কথা") == terms("ভু\u09dfা ক\u09dfেকটি কথা") == [f"ক{apart}েক", "কথা"]  # a stop word is one without its ending
    assert terms("") == [] and terms(None) is None


def test_bm25_counts_the_title_twice(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(4))), " ".join(rng.choices(words, k=rng.randrange(30)))) for i in range(40)] + [(40, None, None), (41, "", "")]
    asked = [("p", "alpha"), ("p", "beta"), ("q", "omega"), ("q", "gamma"), ("q", "nowhere"), ("q", "gamma")]
    docs = spark.createDataFrame(rows, "i int, title string, text string")
    full = docs.withColumn("text", F.concat_ws(" ", "title", "text"))
    got = {(r["query"], r["id"]): (r["score"], r["matched"]) for r in retrieval.bm25(full, "i", "text", spark.createDataFrame(asked, "query string, term string"), title=F.col("title")).collect()}
    tf = {i: collections.Counter((title or "").split() * 2 + (text or "").split()) for i, title, text in rows}
    mean = sum(sum(c.values()) for c in tf.values()) / len(tf)
    want = {}
    for q in "pq":
        terms = {t for a, t in asked if a == q}
        for i, c in tf.items():
            hit = [t for t in terms if c[t]]
            n = {t: sum(1 for x in tf.values() if x[t]) for t in hit}
            score = sum(math.log(1 + (len(tf) - n[t] + 0.5) / (n[t] + 0.5)) * c[t] * 2.4 / (c[t] + 1.4 * (0.25 + 0.75 * sum(c.values()) / mean)) for t in hit)
            if len(hit) >= 2:
                want[q, i] = (round(score, 6), len(hit))
    assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and abs(got[k][0] - want[k][0]) < 2e-6 for k in want)


ARTICLES = "article int, title string, summary string, published timestamp, source string"
ITEMS = "item int, title string, snippet string, published timestamp, source string, fact_check boolean"


def words(text):
    return {w for w in re.sub(r"[^\w\s]|_", " ", (text or "").lower()).split() if len(w) > 1}


def numbers(text):
    return {m for x in re.findall(r"[0-9][0-9,.]*", text) if len(m := re.sub("[,.]$", "", x)) >= 2}


def plain(articles, items, most):
    two = lambda x: math.floor(x * 100 + 0.5) / 100
    threes = lambda text: {tuple(w[i : i + 3]) for w in [[x for x in re.split("[ \n]+", text.lower()) if x]] for i in range(len(w) - 2)}
    whole = lambda a, b: " ".join(x for x in (a, b) if x is not None)
    out = []
    for a, title, summary, day, source in articles:
        best = {}
        for i, t, s, d, src, checked in items:
            full = whole(t, s)
            if i is None or not threes(whole(title, summary)) & threes(full) or (src and source and src.lower() == source.lower()):
                continue
            x, y, nums = words(title), words(t), numbers(whole(title, summary))
            part = [two(len(x & y) / max(len(x), len(y)) if x or y else 0)]
            x, y = words(summary), words(full)
            part.append(two(len(x & y) / min(len(x), len(y)) if x and y else 0))
            days = None if d is None or day is None else abs((d - day).total_seconds()) / 86400
            part.append(two(0.5 if days is None else 1.0 if days <= 1.5 else max(0.0, 1 - (days - 1.5) / 6)))
            part.append(two(min(1, len(nums & numbers(full)) / min(len(nums), 3)) if nums else 0))
            score = two(0.4 * part[0] + 0.2 * part[1] + 0.2 * part[2] + 0.2 * part[3])
            name = t.lower() if t is not None else ("none", i)
            best[name] = min(best.get(name, (9,)), (-score, i, part, bool(checked)))
        ranked = sorted(best.values())
        same = [r for r in ranked if not r[3] and -r[0] >= 0.5 and (r[2][0] >= 0.35 or r[2][3] >= 0.6)][:most]
        for kind, rows in (("same_story", same), ("related", [r for r in ranked if r not in same][:most])):
            out += [(a, r[1], kind, n, *r[2], -r[0]) for n, r in enumerate(rows, 1)]
    return sorted(out)


def test_related_news_by_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    stock = "minister opens bridge over river in north after 12 years with 350 crore taka and 2,500 workers, rain or shine".split()
    run = lambda k: " ".join(stock[j : j + k]) if (j := rng.randrange(len(stock))) or k else ""
    when = lambda: rng.choice([None, DAY + datetime.timedelta(hours=rng.randrange(-200, 200))])
    articles = [(a, run(8), run(12), when(), rng.choice(["src1", "src2", None])) for a in range(8)] + [(8, None, None, None, None), (9, "", "", DAY, "")]
    items = [(i, rng.choice([run(8), run(4), None]), run(14), when(), rng.choice(["SRC1", "src3", None]), rng.choice([True, False, None])) for i in range(120)]
    items += [(200, "", "", DAY, "", False), (None, run(8), run(9), DAY, "x", False), *items[:5]]
    a, b = spark.createDataFrame(articles, ARTICLES).withColumn("k", F.lit(1)), spark.createDataFrame(items, ITEMS).withColumn("run", F.lit("clash"))
    want = plain(articles, items, 3)
    assert {r[2] for r in want} == {"same_story", "related"}
    assert sorted(map(tuple, retrieval.related_news(a, b, 3).collect())) == want
    monkeypatch.setattr(retrieval, "MOST_KEYS", 3)  # beyond both bounds the rows are the same
    monkeypatch.setattr(retrieval, "MOST_PAIRS", 3)
    assert sorted(map(tuple, retrieval.related_news(a, b, 3).collect())) == want
    assert retrieval.related_news(a.limit(0), b).count() == 0 and retrieval.related_news(a, b.limit(0)).count() == 0


def test_jaccard_neighbours_equal_brute_force(spark):
    """Copies, near copies, exact halves and sets of very different sizes, against all pairs in Python; nothing is joined word by word."""
    rng = random.Random(11)
    base = [rng.sample(range(400), rng.choice((1, 2, 3, 9, 30, 90, 250))) for _ in range(60)]
    near = [[w for w in rng.choice(base) if rng.random() < 0.8] + rng.sample(range(400, 450), rng.randrange(4)) for _ in range(120)]
    sets = base + near + base[:8] * 5 + [[1, 2, 3, 4], [1, 2, 3, 5, 6, 4, 7, 8], []]
    rows = [(7 * i % 1009, [f"w{w}" for w in s]) for i, s in enumerate(sets)] + [(5000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, words array<string>")
    out = retrieval.jaccard_neighbours(docs, "doc_id", F.col("words"), 3)
    assert not re.search(r"Join Inner, .*\bw#", out._jdf.queryExecution().toString())
    got = {(r["a"], r["rank"]): (r["b"], r["sim"]) for r in out.collect()}
    want = {}
    for a, s in rows:
        found = [(b, len(set(s) & set(t)), len(set(s) | set(t))) for b, t in rows if b != a and s and t]
        found = sorted((-round(i / u, 4), b) for b, i, u in found if 2 * i > u)[:3]
        want |= {(a, k): (b, -sim) for k, (sim, b) in enumerate(found, 1)}
    assert got.keys() == want.keys() and all(got[k][0] == b and abs(got[k][1] - sim) < 1.1e-4 for k, (b, sim) in want.items())
    assert not any(min(got[k][1], 1.0) <= 0.5 for k in got)
