"""Persons: keys of names, predicates on two names, and clusters of mentions in which two known persons never meet.

A mention is a name and, maybe, a personal number.  Mentions of one number are one person; mentions without one join by the keys of
their names: the whole name first, then pairs of its words.  A key that mentions of two numbers hold tells nothing and is left out.
Chains of keys could still lead from one number to another, so ``clusters`` joins along links in a fixed order, strongest first, and skips
a link whose ends hold two numbers.  Links lie between mentions and keys, never between all mentions of a key, so their number is
linear in the mentions.

The order is kept without going through it one by one: in each turn every cluster names its first open link, and the link is taken if
that cluster has no number, or both ends have the same.  Until the link's turn came, no earlier one would change that cluster, as one that
is shut stays shut; so the link would still be open, and going through the links one by one takes it too.  A turn joins every cluster
without a number that has an open link, so their number is halved at least; chains within a turn are followed by doubling.

Defined cases: a null or blank name without a number is a cluster of its own; a name without a word of two letters has no pairs; a
name of one word has that word for its only key; repeated mentions are one; an empty table has no clusters; columns of any other name aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import held, released
from ..functions import text as T

#: Spellings of one honorific, the longer ones first.
HONORIFICS = ("মোঃ", "মো:")
HONORIFIC = "মো"

#: Most words of a name that make pairs; a longer name is no person's.
WORDS = 8


def bare(name: Column) -> Column:
    """The name without what stands in parentheses."""
    return F.regexp_replace(F.coalesce(name, F.lit("")), r"\([^)]*\)", "")


def person_number(name: Column) -> Column:
    """The digits, three or more and ASCII, of a number in parentheses; null without one."""
    found = F.regexp_extract(F.coalesce(name, F.lit("")), "\\(([\u09e6-\u09ef0-9]{3,})\\)", 1)
    return F.when(found != "", T.ascii_digits(found))


def person_name(name: Column) -> Column:
    """The key of a name: without parentheses and blanks, in lower case, with one spelling of the honorific."""
    key = F.regexp_replace(bare(name), r"[\s\u00a0\u200b-\u200d\ufeff]+", "")
    for spelling in HONORIFICS:
        key = F.replace(key, F.lit(spelling), F.lit(HONORIFIC))
    return F.lower(key)


def same_person(a: Column, b: Column) -> Column:
    """Whether two names have the same number, or the same key."""
    return F.coalesce(person_number(a) == person_number(b), F.lit(False)) | ((person_name(a) != "") & (person_name(a) == person_name(b)))


def name_words(name: Column) -> Column:
    """Distinct words of two letters or more, in lower case and in order."""
    words = F.regexp_extract_all(F.lower(bare(name)), F.lit(r"([\p{L}\p{M}\p{N}]+)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: F.length(w) >= 2)))


def names_likely_same(a: Column, b: Column) -> Column:
    """Whether two names share two words, or all words of the shorter one; a blank name contradicts none."""
    left, right = name_words(a), name_words(b)
    least = F.least(F.lit(2), F.size(left), F.size(right))
    return (person_name(a) == person_name(b)) | (F.size(F.array_intersect(left, right)) >= least)


def _keys(name: Column) -> Column:
    """Keys of a name as structs (strength, key): the whole name, and its words by twos."""
    words = name_words(name)
    few = F.size(words) <= WORDS
    pair = lambda w, i: F.transform(F.slice(words, i + 2, WORDS), lambda v: F.concat_ws(" ", w, v))
    pairs = F.when(F.size(words) == 1, words).when(few, F.flatten(F.transform(words, pair))).otherwise(F.array().cast("array<string>"))
    whole = F.filter(F.array(person_name(name)), lambda k: k != "")
    struct = lambda level: lambda k: F.struct(F.lit(level).alias("strength"), k.alias("key"))
    return F.concat(F.transform(whole, struct(2)), F.transform(pairs, struct(1)))


def links_of(mentions: DataFrame, name: str = "name", number: str = "number") -> tuple[DataFrame, DataFrame]:
    """Nodes (node, label) and links (a, b, strength) of mentions.

    A node is a number (``n:``) or, for mentions without one, a name's key (``m:``); a link goes to a key (``k:``) that no two numbers hold.
    """
    node = F.when(F.col(number).isNotNull(), F.concat(F.lit("n:"), F.col(number))).otherwise(F.concat(F.lit("m:"), person_name(F.col(name))))
    rows = mentions.select(node.alias("a"), F.col(number).alias("label"), F.explode(_keys(F.col(name))).alias("k")).select("a", "label", "k.strength", F.concat(F.lit("k:"), F.col("k.strength"), F.lit(":"), F.col("k.key")).alias("b")).distinct()
    told = rows.groupBy("b").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count_distinct("a").alias("n"))
    told = told.where("n > 1 AND coalesce(least = most, true)").select("b")
    nodes = mentions.select(node.alias("node"), F.col(number).alias("label")).distinct()
    return nodes, rows.join(told, "b", "left_semi").select("a", "b", "strength")


def order(a: str = "a", b: str = "b") -> list[Column]:
    """The order of links: strongest first, then by a hash, then by their ends."""
    return [-F.col("strength"), F.xxhash64(a, b), F.col(a), F.col(b)]


def constrained_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, cluster) of all nodes (node, label) and ends of links (a, b, strength).

    Links are taken in ``order``; one whose ends hold two labels is skipped.  A cluster is called by its smallest node.
    """
    rank = F.struct(*(c.alias(n) for c, n in zip(order(), ("k1", "k2", "k3", "k4"), strict=True)))
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    member = held(nodes.groupBy("node").agg(F.min("label").alias("label")).join(ends, "node", "full").select("node", F.col("node").alias("cluster"), "label"), "persons")
    side = lambda end: member.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}"))
    open_links = held(_open(links.where("a <> b").withColumn("rank", rank).join(side("a"), "a").join(side("b"), "b")), "links")
    while not open_links.isEmpty():
        taken = _taken(open_links)
        new_member = held(_renamed(member, taken, "cluster", "label"), "persons")
        new_links = held(_open(_renamed(_renamed(open_links, taken, "a", "label_a"), taken, "b", "label_b")), "links")
        released(member, open_links, taken)
        member, open_links = new_member, new_links
    smallest = member.groupBy("cluster").agg(F.min("node").alias("name"))
    return member.join(smallest, "cluster").select("node", F.col("name").alias("cluster"))


def _taken(links: DataFrame) -> DataFrame:
    """(cluster, to, label) of the clusters that become part of another one, with that one's label."""
    both = links.select(F.col("a").alias("cluster"), "rank", F.col("b").alias("to"), F.col("label_a").alias("own"), F.col("label_b").alias("label"))
    both = both.union(links.select("b", "rank", "a", "label_b", "label_a"))
    first = both.groupBy("cluster").agg(F.min(F.struct("rank", "to", "own", "label")).alias("x")).where("x.own IS NULL OR x.own = x.label")
    # of two that name the same link, the greater goes to the smaller; else a cluster goes where its link leads
    to = first.groupBy("x.rank").agg(F.max(F.struct("cluster", "x.to", "x.label")).alias("y")).select("y.cluster", "y.to", "y.label")
    to = held(to, "taken")
    while True:  # half of the way to the end of each chain a time
        further = to.select(F.col("cluster").alias("to"), F.col("to").alias("_to"), F.col("label").alias("_label"))
        rows = to.join(further, "to", "left").withColumn("on", F.col("_to").isNotNull())
        new = held(rows.select("cluster", F.coalesce("_to", "to").alias("to"), F.when(F.col("on"), F.col("_label")).otherwise(F.col("label")).alias("label"), "on"), "taken")
        released(to)
        to = new
        if to.where("on").isEmpty():
            return to


def _renamed(rows: DataFrame, taken: DataFrame, column: str, label: str) -> DataFrame:
    """``rows`` with the clusters in ``column``, and their labels, as they are after ``taken``."""
    new = taken.select(F.col("cluster").alias(column), F.col("to").alias("_to"), F.col("label").alias("_label"))
    out = rows.join(new, column, "left").withColumn(label, F.when(F.col("_to").isNull(), F.col(label)).otherwise(F.col("_label")))
    return out.withColumn(column, F.coalesce("_to", column)).select(*rows.columns)


def _open(links: DataFrame) -> DataFrame:
    """The first link of each two clusters that may still become one."""
    swap = F.col("a") > F.col("b")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    shut = F.coalesce(F.col("label_a") != F.col("label_b"), F.lit(False))
    rows = links.where((F.col("a") != F.col("b")) & ~shut).select(pick("a", "b").alias("a"), pick("b", "a").alias("b"), F.struct("rank", pick("label_a", "label_b").alias("label_a"), pick("label_b", "label_a").alias("label_b")).alias("x"))
    return rows.groupBy("a", "b").agg(F.min("x").alias("x")).select("a", "b", "x.rank", "x.label_a", "x.label_b")


def clusters(mentions: DataFrame, name: str = "name", number: str = "number") -> DataFrame:
    """Distinct mentions (name, number) with ``cluster``: the same for mentions of one person, by its number if it has one; blank ones are null."""
    rows = mentions.select(F.col(name).alias("name"), F.col(number).alias("number")).distinct()
    nodes, links = links_of(rows, "name", "number")
    found = constrained_components(nodes, links).where("node NOT LIKE 'k:%'")
    of = found.join(found.groupBy("cluster").agg(F.max("node").alias("person")), "cluster").select("node", F.col("person").alias("cluster"))
    node = F.when(F.col("number").isNotNull(), F.concat(F.lit("n:"), F.col("number"))).when(person_name(F.col("name")) != "", F.concat(F.lit("m:"), person_name(F.col("name"))))
    return rows.withColumn("node", node).join(of, "node", "left").select("name", "number", "cluster")
