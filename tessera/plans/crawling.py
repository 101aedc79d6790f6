"""Queries over the links of pages.  A page's links lead to its site's subjects, a subject to the pages that have it in their titles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import crawl, html

DEPTH = 4
#: Robots files: hosts for phones keep some languages to themselves.
_ROBOTS = "User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /de\nAllow: /de/9 # a part\nDisallow: /fr/1\n"


def _graph(spark, sf_dir):
    """Links (source, target) of subjects and pages; start pages; rules."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    found = html.links(pages, "page_id", "url", "html").select("page_id", "link")
    word = F.regexp_replace(F.lower(F.regexp_extract("link", "^https?://[^/]*/([^#]*)", 1)), "[^a-z]+", "")
    base = pages.select("page_id", "url", F.concat(F.lit("https://"), crawl.site_of_url(F.col("url")), F.lit("/")).alias("base"), F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"))
    up = base.select("page_id", "url", "base").join(found, "page_id").select(F.col("url").alias("source"), F.concat("base", word).alias("target"))
    down = base.select("url", "base", F.explode(F.array_distinct(F.split(F.trim(F.regexp_replace(F.lower("title"), "[^a-z]+", " ")), " "))).alias("w")).where("w <> ''")
    down = down.select(F.concat("base", "w").alias("source"), F.col("url").alias("target"))
    hosts = pages.select(crawl.host_of(F.col("url")).alias("host"), crawl.plain(F.col("url")).alias("url"))
    starts = hosts.groupBy("host").agg(F.min("url").alias("url")).select("url")
    files = hosts.where("host LIKE 'm.%'").select("host").distinct().withColumn("text", F.lit(_ROBOTS))
    return starts, up.unionByName(down), crawl.robots_rules(files, "reader/1.0")


def link_search(spark, sf_dir):
    """Depth and referrer of every page and subject within four links of some host's first page."""
    starts, links, rules = _graph(spark, sf_dir)
    return crawl.discover(starts, links, rules, DEPTH).select("url", "depth", "referrer", "site")


LINK_SEARCH = rf"""
WITH RECURSIVE
p AS (SELECT page_id, url AS raw, regexp_replace(url, '#.*$', '') AS url, html, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host FROM pages),
sited AS (SELECT *, regexp_extract(host, '([^.]+\.[^.]+)$', 1) AS site FROM p),
anchors AS (SELECT url, site, unnest(regexp_extract_all(html, '<a href="/([^"]*)"', 1)) AS href FROM sited),
titles AS (SELECT url, site, unnest(list_distinct(string_split(trim(regexp_replace(lower(regexp_extract(html, '<title>(.*?)</title>', 1)), '[^a-z]+', ' ', 'g')), ' '))) AS w FROM sited),
edges AS (
  SELECT DISTINCT source, target FROM (
    SELECT url AS source, 'https://' || site || '/' || regexp_replace(lower(regexp_replace(href, '#.*$', '')), '[^a-z]+', '', 'g') AS target FROM anchors
    UNION ALL SELECT 'https://' || site || '/' || w, url FROM titles WHERE w <> '') WHERE source <> target),
ends AS (SELECT target AS url FROM edges UNION SELECT url FROM p),
parts AS (SELECT url, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]*(.*)$', 1) AS path FROM ends),
open AS (SELECT url FROM parts WHERE NOT (host LIKE 'm.%' AND (starts_with(path, '/de') AND NOT starts_with(path, '/de/9') OR starts_with(path, '/fr/1')))),
starts AS (SELECT min(url) AS url FROM p GROUP BY host),
walk AS (
  SELECT url, 0 AS depth FROM starts JOIN open USING (url)
  UNION
  SELECT e.target, w.depth + 1 FROM walk w JOIN edges e ON e.source = w.url JOIN open o ON o.url = e.target WHERE w.depth < {DEPTH}),
least AS (SELECT url, min(depth)::INTEGER AS depth FROM walk GROUP BY url)
SELECT l.url, l.depth, min(s.url) AS referrer, regexp_extract(regexp_extract(l.url, '^https?://([^/?#:]+)', 1), '([^.]+\.[^.]+)$', 1) AS site
FROM least l LEFT JOIN edges e ON e.target = l.url LEFT JOIN least s ON s.url = e.source AND s.depth = l.depth - 1
GROUP BY l.url, l.depth
"""

QUERIES = {"link_search": (link_search, LINK_SEARCH)}
