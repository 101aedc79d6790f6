"""Link search: from start pages to those a few links away, within a site and its robots rules.

The frontier is a table a level: its links are joined to the pages, what was visited before is left out by an anti-join, and what remains is
the next level.  A level costs a few joins whatever its size; only its number of rows reaches the driver.

Defined cases: null and other than http(s) links lead nowhere; a link's fragment is dropped; a page that several links reach has the least depth and of
equals the smallest referrer; a start page that robots rules exclude isn't visited; a page without a row in ``links`` is visited, but leads nowhere;
cycles end, as a page is visited once; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..cluster import held, released

#: Second-level suffixes under which names are registered.
SUFFIXES = ("gov.bd", "com.bd", "org.bd", "edu.bd", "net.bd", "co.uk", "gov.uk", "org.uk", "ac.uk")
DEPTH = 2


def host_of(url: Column) -> Column:
    """The host in lower case, without user and port; null for what is no http(s) URL."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^(?i:https?)://(?:[^/?#@]*@)?([^/?#:@]+)", 1)), F.lit(""))


def site_of(host: Column) -> Column:
    """The registrable domain: the last two labels, or three under a suffix of two."""
    two, three = F.substring_index(host, ".", -2), F.substring_index(host, ".", -3)
    return F.when(two.isin(*SUFFIXES), three).otherwise(two)


def site_of_url(url: Column) -> Column:
    """As ``site_of`` of the URL's host, by two patterns; empty for what is no http(s) URL."""
    host = F.regexp_extract(url, r"^(?i:https?)://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    suffixes = "|".join(x.replace(".", r"\.") for x in SUFFIXES)
    return F.lower(F.regexp_extract(host, rf"([^.]+\.(?i:{suffixes})|[^.]+\.[^.]+|^[^.]+)$", 1))


def path_of(url: Column) -> Column:
    """Path and query, ``/`` if there is none."""
    path = F.regexp_extract(url, r"^(?i:https?)://[^/?#]*([^#]*)", 1)
    return F.when(path == "", "/").when(path.startswith("?"), F.concat(F.lit("/"), path)).otherwise(path)


def robots_rules(files: DataFrame, agent: str, host: str = "host", text: str = "text") -> DataFrame:
    """host, prefix, allowed: the rules of robots files for ``agent``, or those for ``*`` where none is for it.

    A group's agent lines are followed by its rules; an empty disallow allows all; prefixes are taken as they are.
    """
    lines = files.select(F.lower(host).alias("host"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n")).alias("i", "line"))
    pair = lines.select("host", "i", F.regexp_extract("line", r"^\s*([A-Za-z-]+)\s*:\s*([^#]*)", 1).alias("k"), F.trim(F.regexp_extract("line", r"^\s*([A-Za-z-]+)\s*:\s*([^#]*)", 2)).alias("v"))
    pair = pair.withColumn("k", F.lower("k")).where(F.col("k").isin("user-agent", "allow", "disallow"))
    by_file = pair.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("i", "k", "v"))).alias("x"))  # a file's lines
    # A group's number grows at the first agent line after a rule.
    start = F.struct(F.lit(0).alias("g"), F.lit("").alias("last"), F.array().cast("array<struct<g:int,k:string,v:string>>").alias("out"))
    step = lambda s, x: F.struct(
        F.when((x["k"] == "user-agent") & (s["last"] != "user-agent"), s["g"] + 1).otherwise(s["g"]).alias("g"), x["k"].alias("last"),
        F.concat(s["out"], F.array(F.struct(F.when((x["k"] == "user-agent") & (s["last"] != "user-agent"), s["g"] + 1).otherwise(s["g"]).alias("g"), x["k"].alias("k"), x["v"].alias("v")))).alias("out"),
    )
    rows = by_file.select("host", F.explode(F.aggregate("x", start, step)["out"]).alias("r")).select("host", "r.*")
    mine = rows.where("k = 'user-agent'").withColumn("own", F.lower("v") != "*").where((F.col("v") == "*") | F.contains(F.lit(agent.lower()), F.lower("v")))
    own = mine.groupBy("host").agg(F.max("own").alias("some"))
    groups = mine.join(own, "host").where(F.col("own") == F.col("some")).select("host", "g").distinct()
    rules = rows.where("k <> 'user-agent' AND v <> ''").join(groups, ["host", "g"])
    return rules.select("host", F.col("v").alias("prefix"), (F.col("k") == "allow").alias("allowed")).distinct()


def allowed(urls: DataFrame, rules: DataFrame, url: str = "url", longest: int = 256) -> DataFrame:
    """``urls`` without those that the rules of their host exclude: the longest prefix decides, and of equal ones the allowing.

    The prefixes of a path are looked up among the rules, in lengths that rules have, so no path meets all rules of its host.  Prefixes over
    ``longest`` characters are rare and join by host.
    """
    at = urls.withColumns({"_h": host_of(F.col(url)), "_p": path_of(F.col(url))})
    keys = at.select(url, "_h", "_p").distinct()
    lengths = rules.where(F.length("prefix") <= longest).groupBy("host").agg(F.sort_array(F.collect_set(F.length("prefix"))).alias("lengths"))  # ``longest`` at most
    probes = keys.join(lengths, keys["_h"] == lengths["host"]).select(url, "_h", "_p", F.explode("lengths").alias("n")).where(F.col("n") <= F.length("_p"))
    short = probes.select(url, "_h", F.expr("substring(_p, 1, n)").alias("prefix")).join(rules.withColumnRenamed("host", "_h"), ["_h", "prefix"]).select(url, "prefix", "allowed")
    long = keys.join(rules.where(F.length("prefix") > longest), (F.col("_h") == F.col("host")) & F.col("_p").startswith(F.col("prefix"))).select(url, "prefix", "allowed")
    verdict = short.unionByName(long).groupBy(url).agg(F.max(F.struct(F.length("prefix").alias("n"), "allowed")).alias("x"))
    denied = verdict.where(~F.col("x.allowed")).select(F.col(url).alias("_u"))
    return at.join(denied, at[url] == F.col("_u"), "left_anti").drop("_h", "_p")


def plain(url: Column) -> Column:
    """An http(s) URL without fragment; null for others."""
    return F.when(url.rlike("^(?i:https?)://[^/?#]"), F.regexp_replace(url, "#.*$", ""))


def discover(starts: DataFrame, links: DataFrame, rules: DataFrame | None = None, depth: int = DEPTH, start: str = "url", source: str = "source", target: str = "target") -> DataFrame:
    """url, depth, referrer, start_site: pages up to ``depth`` links away from a start page of the same registrable domain.

    ``links`` has source and target URLs; ``rules`` host, prefix and allowed, from ``robots_rules``.
    """
    permitted = (lambda df: allowed(df, rules)) if rules is not None else (lambda df: df)
    same = site_of_url(F.col(source)) == site_of_url(F.col(target))
    inside = links.where(same).select(plain(F.col(source)).alias("source"), plain(F.col(target)).alias("url"))
    edges = held(inside.where("source <> url").distinct(), "edges")
    first = starts.select(plain(F.col(start)).alias("url")).where("url IS NOT NULL").distinct()
    level, n = _counted(permitted(first).select("url", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("referrer")))
    levels = [level]
    for d in range(1, depth + 1):
        if not n:
            break
        reached = edges.join(level.select(F.col("url").alias("source")), "source").groupBy("url").agg(F.min("source").alias("referrer"))
        for seen in levels:
            reached = reached.join(seen.select("url"), "url", "left_anti")
        level, n = _counted(permitted(reached).select("url", F.lit(d).alias("depth"), "referrer"))
        levels.append(level)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    released(edges)
    return out.withColumn("site", site_of_url(F.col("url")))


def _counted(df: DataFrame) -> tuple[DataFrame, int]:
    seen = Observation()
    out = held(df.observe(seen, F.count(F.lit(1)).alias("n")), "level")
    return out, seen.get["n"]
