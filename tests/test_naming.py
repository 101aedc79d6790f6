"""Persons, their clusters against going through the links one by one, and collations against ICU."""

import collections
import functools
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import collation, persons


def _one_by_one(nodes, links):
    """Links in order, each taken unless its ends hold two labels."""
    parent, label = {}, dict(nodes)

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        la, lb = label.get(a), label.get(b)
        if a != b and (la is None or lb is None or la == lb):
            parent[b] = a
            label[a] = la if la is not None else lb
    groups = collections.defaultdict(set)
    for x in {*dict(nodes), *(e for link in links for e in link)}:
        groups[find(x)].add(x)
    return {x: min(g) for g in groups.values() for x in g}


def _ordered(links):
    return [(r["a"], r["b"]) for r in links.orderBy(*persons.order()).collect()]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_one_by_one(spark, seed):
    rng = random.Random(seed)
    nodes = [(f"x{i}", rng.choice([None, None, None, "p", "q", "r"])) for i in range(40)]
    pairs = {(f"x{rng.randrange(40)}", f"k{rng.randrange(20)}") for _ in range(75)}
    links = spark.createDataFrame([(a, b, rng.randint(1, 3)) for a, b in sorted(pairs)], "a string, b string, strength int")
    got = dict(tuple(r) for r in persons.constrained_components(spark.createDataFrame(nodes, "node string, label string"), links).select("node", "cluster").collect())
    want = _one_by_one(nodes, _ordered(links))
    assert got == want
    assert len(set(got.values())) > 3


def test_clusters(spark):
    rows = [
        ("Rahim Uddin Khan", "101"), ("R. U. Khan", "101"), ("rahim  uddin khan", None), ("Khan Rahim Uddin", None), ("Uddin Rahim", None),
        ("Salma Akter", "202"), ("Salma Akter", "303"), ("salma akter", None), (None, None), ("  ", None), ("", "404"), ("Salma Akter", "202"), ("Zed", None), ("zed", None),
    ]
    mentions = spark.createDataFrame(rows, "name string, number string").withColumn("cluster", F.lit("clash"))
    got = {(r["name"], r["number"]): r["cluster"] for r in persons.clusters(mentions).collect()}
    assert set(got) == set(rows)
    khan = {got[k] for k in rows[:5]}
    assert len(khan) == 1
    assert len({got[("Salma Akter", "202")], got[("Salma Akter", "303")], got[("salma akter", None)]}) == 3
    assert got[("Zed", None)] == got[("zed", None)] and got[("", "404")] not in khan
    assert got[(None, None)] is None and got[("  ", None)] is None
    assert persons.clusters(mentions.limit(0)).count() == 0


def test_no_cluster_holds_two_numbers(spark):
    rng = random.Random(5)
    names = [" ".join(rng.sample(["ali", "bay", "can", "dag", "efe", "gul", "han", "isa", "kaya", "lale", "mert", "naz"], 3)) for _ in range(300)]
    rows = [(n, str(100 + i) if i % 25 == 0 else None) for i, n in enumerate(names)]
    got = persons.clusters(spark.createDataFrame(rows, "name string, number string")).collect()
    held = collections.defaultdict(set)
    for r in got:
        if r["number"]:
            held[r["cluster"]].add(r["number"])
    assert held and all(len(x) == 1 for x in held.values())


def test_predicates(spark):
    rows = [("মোঃ করিম (১২৩)", "Karim (123)", True, False), ("মোঃ করিম", "মো: করিম", True, True), ("A B", "C D", False, True), ("Anna Maria Lee", "maria lee", False, True), ("Anna Lee", "Lee Majors", False, False), (None, "x", False, True), ("", "", False, True)]
    df = spark.createDataFrame(rows, "a string, b string, same boolean, likely boolean")
    for r in df.select("a", "b", "same", "likely", persons.same_person(F.col("a"), F.col("b")).alias("s"), persons.names_likely_same(F.col("a"), F.col("b")).alias("l")).collect():
        assert (r["s"], r["l"]) == (r["same"], r["likely"]), r


@pytest.mark.parametrize("language", ["bn", "de", "sv"])
def test_order_by_icu(spark, language):
    words = ["ক", "খ", "আম", "অ", "ঢাকা", "চট্টগ্রাম", "খুলনা", "Zebra", "zebra", "äpfel", "Apfel", "apfel", "Öl", "ol", "straße", "strasse", None, "apfel", "á", "a"]
    jvm = spark.sparkContext._jvm
    order = jvm.com.ibm.icu.text.Collator.getInstance(jvm.com.ibm.icu.util.ULocale(language))
    distinct = sorted({w for w in words if w})
    want = sorted(distinct, key=functools.cmp_to_key(lambda a, b: order.compare(a, b) or (a > b) - (a < b)))
    got = collation.first_in_order(spark.createDataFrame([(w,) for w in words], "w string"), "w", language, 100).orderBy("place").collect()
    assert [r["word"] for r in got] == want and [r["place"] for r in got] == list(range(1, len(want) + 1))
    few = collation.first_in_order(spark.createDataFrame([(w,) for w in words], "w string"), "w", language, 3).orderBy("place").collect()
    assert [r["word"] for r in few] == want[:3]


def test_spellings(spark):
    rows = [("Été",), ("ete",), ("ÉTÉ",), ("ete",), ("eta",), (None,)]
    got = collation.spellings(spark.createDataFrame(rows, "w string"), "w", "UNICODE_CI_AI").collect()
    assert sorted(tuple(r) for r in got) == [("eta", 1, 1), ("ete", 3, 4)]
    assert collation.spellings(spark.createDataFrame([], "w string"), "w", "UNICODE_CI_AI").count() == 0
