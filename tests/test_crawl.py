"""Link search and robots rules against plain searches."""

import random
from collections import deque

from pyspark.sql import functions as F

from tessera.operators import crawl


def site(url):
    host = url.split("/")[2].lower()
    labels = host.split(".")
    return ".".join(labels[-3:] if ".".join(labels[-2:]) in crawl.SUFFIXES else labels[-2:])


def permitted(url, rules):
    host, path = url.split("/")[2].lower(), "/" + url.split("/", 3)[3] if url.count("/") > 2 else "/"
    best = max(((len(p), a) for h, p, a in rules if h == host and path.startswith(p)), default=(0, True))
    return best[1]


def search(starts, edges, rules, depth):
    out, queue = {}, deque((s, 0) for s in sorted(set(starts)) if permitted(s, rules))
    while queue:
        url, d = queue.popleft()
        if url in out:
            continue
        out[url] = d
        if d < depth:
            queue.extend((t, d + 1) for s, t in edges if s == url and site(t) == site(s) and permitted(t, rules))
    return out


def test_search_by_brute_force(spark):
    rng = random.Random(6)
    hosts = ["a.x.gov.bd", "b.x.gov.bd", "y.gov.bd", "www.z.com", "m.z.com"]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice('pqr')}{rng.randrange(12)}" for _ in range(80)]
    edges = [(rng.choice(urls), rng.choice(urls)) for _ in range(220)] + [(urls[0], urls[0])]
    rules = [("a.x.gov.bd", "/p", False), ("a.x.gov.bd", "/p1", True), ("m.z.com", "/", False), ("m.z.com", "/q", True), ("m.z.com", "/q", False), ("y.gov.bd", "/r" + "0" * 300, False), ("y.gov.bd", "/q1", False)]
    links = spark.createDataFrame([*[(s, t + "#part") for s, t in edges], (urls[0], None), (urls[0], "mailto:x"), (None, urls[1])], "source string, target string")
    starts = spark.createDataFrame([(u,) for u in [*urls[:6], None, "ftp://x/"]], "url string")
    table = spark.createDataFrame(rules, "host string, prefix string, allowed boolean")
    for depth in (0, 2, 6):
        rows = crawl.discover(starts, links, table, depth).collect()
        want = search(urls[:6], edges, rules, depth)
        assert {r["url"]: r["depth"] for r in rows} == want and len(rows) == len(want)
        for r in rows:
            sources = [s for s, t in edges if t == r["url"] and s != t and site(s) == site(t) and want.get(s) == r["depth"] - 1]
            assert r["referrer"] == (min(sources) if r["depth"] else None)
    assert crawl.discover(starts.limit(0), links, None).count() == 0
    assert crawl.discover(starts, links.limit(0), None).count() == 6 - (6 - len(set(urls[:6])))


def test_robots_files(spark):
    text = "User-agent: other\nDisallow: /\n\n# all\nUser-Agent: *\nUser-agent: reader\nDisallow: /a # x\nAllow: /a/b\nDisallow:\n\nUser-agent: *\nDisallow: /c\nSitemap: http://h/s.xml"
    files = spark.createDataFrame([("H1", text), ("h2", text.replace("reader", "else")), ("h3", None), ("h4", "Disallow: /x")], "host string, text string")
    got = {(r["host"], r["prefix"], r["allowed"]) for r in crawl.robots_rules(files, "Reader/1.0").collect()}
    assert got == {("h1", "/a", False), ("h1", "/a/b", True), ("h2", "/a", False), ("h2", "/a/b", True), ("h2", "/c", False)}


def test_sites_and_paths(spark):
    cases = {"http://A.b.gov.bd:80/x?q#f": ("a.b.gov.bd", "b.gov.bd", "/x?q"), "https://u@www.z.com": ("www.z.com", "z.com", "/"), "https://z.com?q=1": ("z.com", "z.com", "/?q=1"), "mailto:x": (None, None, "/")}
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    host = crawl.host_of(F.col("u"))
    assert {r["u"]: r["s"] or None for r in df.select("u", crawl.site_of_url(F.col("u")).alias("s")).collect()} == {u: s for u, (_, s, _) in cases.items()}
    assert {r["u"]: (r["h"], r["s"], r["p"]) for r in df.select("u", host.alias("h"), crawl.site_of(host).alias("s"), crawl.path_of(F.col("u")).alias("p")).collect()} == cases
