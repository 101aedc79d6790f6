"""Queries that project records: names and ranks, roles, sentences, devices, notices, dates, costs and keys."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import calendar
from ..functions import records as R
from ..functions import text as T
from ..operators import resolution
from . import directory


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def name_rank_split(spark, sf_dir):
    """Names written with a rank behind a dash, before a comma, or in brackets."""
    key, name = F.col("s_suppkey"), F.regexp_replace("s_name", "#", " ")
    said = F.when(key % 4 == 0, F.concat(name, F.lit(" - Deputy Secretary"))).when(key % 4 == 1, F.concat(F.lit("Director, "), name)).when(key % 4 == 2, F.concat(name, F.lit(" (Dhaka)"))).otherwise(name)
    a, b = R.name_and_rank(said)
    return _t(spark, sf_dir, "supplier").select("s_suppkey", a.alias("name"), b.alias("rank"))


def _officers(spark, sf_dir):
    key, name = F.col("c_custkey"), F.col("c_name")
    cols = {}
    for i, role in enumerate(R.ROLES, 2):
        cols[f"{role}_name"] = F.when(key % i == 0, F.lit(" n/a ")).otherwise(name)
        cols[f"{role}_email"] = F.when(key % (i + 3) == 0, F.lit("none")).otherwise(F.concat(F.lower(F.lit(role)), F.lit("@x.org")))
    return _t(spark, sf_dir, "customer").select("c_custkey", *[c.alias(n) for n, c in cols.items()])


def role_completeness(spark, sf_dir):
    cols = {r: (F.col(f"{r}_name"), F.col(f"{r}_email")) for r in R.ROLES}
    return _officers(spark, sf_dir).select("c_custkey", R.roles_filled(cols).alias("complete"))


def record_projection(spark, sf_dir):
    """A row for each role that has a name: no name, no other field."""
    slots = F.array(*[F.struct(F.lit(r).alias("role"), R.gated(F.col(f"{r}_name"), email=F.col(f"{r}_email")).alias("x")) for r in R.ROLES])
    return _officers(spark, sf_dir).select("c_custkey", F.explode(slots).alias("s")).select("c_custkey", "s.role", F.col("s.x.name").alias("name"), F.col("s.x.email").alias("email"))


def office_details(spark, sf_dir):
    """Rows of one ministry and division, the office left open."""
    return R.where_given(directory._directory(spark, sf_dir), ministry=" europe ", division=None, office=None).select("ministry", "division", "office", "row")


def activity_sentences(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", R.sentence(F.col("event_type"), F.when(F.col("event_id") % 3 == 0, F.repeat("props", 30)).otherwise(F.col("props"))).alias("said"))


AGENTS = (
    "Mozilla/5.0 (Windows NT 10.0) Chrome/120 Safari/537 Edg/120", "Mozilla/5.0 (Linux; Android 14) Chrome/120 Mobile Safari/537", "Mozilla/5.0 (iPad; CPU OS 17 like Mac OS X) Safari/604", "Mozilla/5.0 (X11; Linux x86_64) Firefox/121", "curl/8"
)


def device_info(spark, sf_dir):
    agent = F.get(F.array(*map(F.lit, AGENTS)), (F.col("user_id") % len(AGENTS)).cast("int"))
    return _t(spark, sf_dir, "events").select(R.device(agent).alias("d")).groupBy("d.browser", "d.system", "d.kind").agg(F.count("*").alias("n"))


def resolution_notice(spark, sf_dir):
    cards = resolution.cards(directory._asked(spark, sf_dir), directory._directory(spark, sf_dir), directory._aliases(spark, sf_dir))
    office = lambda c: F.substring_index(c, "|", -1)
    return cards.select("pos", R.notice(F.col("rung"), office("matched"), office("card")).alias("notice"))


def bengali_dates(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", R.bengali_date(F.col("o_orderdate"), calendar.BENGALI_MONTHS).alias("day"))


def usage_cost(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum("l_partkey").alias("a"), F.sum("l_orderkey").alias("b"))
    return rows.select("l_suppkey", R.cost(F.col("a"), F.col("b"), F.lit(0.15), F.lit(0.6)).alias("usd"))


def fallback_summary(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", R.summaries(F.col("text")).alias("s"))
    return rows.select("doc_id", F.length("s.short").cast("long").alias("short"), F.length("s.middle").cast("long").alias("middle"), F.md5(F.col("s.long").cast("binary")).alias("long"), "s.language")


def certificate_json(spark, sf_dir):
    """A JSON certificate of each document: what it is, its digest and its size."""
    body = F.struct(F.lit("Certificate").alias("@type"), F.col("doc_id").alias("identifier"), F.sha2("text", 256).alias("sha256"), F.col("n_chars").alias("size"))
    return _t(spark, sf_dir, "documents").select("doc_id", F.to_json(body).alias("certificate"))


def gazetteer_keys(spark, sf_dir):
    return _t(spark, sf_dir, "benchmark").select("item_id", R.gazetteer_key(F.concat(F.lit("‌A-b, ১২ "), F.col("text"))).alias("key"), R.clean_entity(F.concat(F.lit(" («“"), F.col("text"), F.lit("”.) "))).alias("clean"))


def domain_meta_first(spark, sf_dir):
    """Pages with what the first page of their host says of it."""
    pages = _t(spark, sf_dir, "pages").withColumn("host", T.host(F.col("url")))
    meta = pages.where("host IS NOT NULL").groupBy("host").agg(F.min_by("url", "page_id").alias("first_url"), F.count("*").alias("n"))
    return pages.join(meta, "host", "left").select("page_id", "first_url", "n")


def newest_files(spark, sf_dir):
    """Of the files of each customer, named by their day, the newest; ties by number."""
    name = F.concat(F.lit("export-"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("-"), F.col("o_orderkey").cast("string"), F.lit(".csv"))
    files = _t(spark, sf_dir, "orders").select("o_custkey", name.alias("file"))
    day = F.try_to_date(F.regexp_extract("file", r"-([0-9]{8})-", 1), "yyyyMMdd")
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(day.desc(), F.lower("file")))
    return files.withColumn("rank", rank).where("rank = 1").select("o_custkey", "file")


_ROLE_SQL = [(r, i, f"CASE WHEN c_custkey % {i} = 0 THEN NULL ELSE c_name END", f"CASE WHEN c_custkey % {i + 3} = 0 THEN 'none' ELSE '{r.lower()}@x.org' END") for i, r in enumerate(R.ROLES, 2)]
_COMPLETE = ", ".join(f"CASE WHEN c_custkey % {i} <> 0 AND c_custkey % {i + 3} <> 0 THEN '{r}' END" for r, i, _, _ in _ROLE_SQL)
_FIRST = lambda marks, col: "CASE " + " ".join(f"WHEN contains({col}, '{m}') THEN '{n}'" for m, n in marks) + " ELSE 'Unknown' END"

QUERIES = {
    "name_rank_split": (
        name_rank_split,
        "SELECT s_suppkey, replace(s_name, '#', ' ') AS name, CASE s_suppkey % 4 WHEN 0 THEN 'Deputy Secretary' WHEN 1 THEN 'Director' WHEN 2 THEN 'Dhaka' END AS rank FROM supplier",
    ),
    "role_completeness": (role_completeness, f"SELECT c_custkey, concat_ws(',', {_COMPLETE}) AS complete FROM customer"),
    "record_projection": (record_projection, " UNION ALL ".join(f"SELECT c_custkey, '{r}' AS role, {n} AS name, CASE WHEN c_custkey % {i} <> 0 THEN {e} END AS email FROM customer" for r, i, n, e in _ROLE_SQL)),
    "office_details": (office_details, f"WITH {directory._DIRECTORY} SELECT m AS ministry, d AS division, o AS office, row FROM dir WHERE lower(m) = 'europe'"),
    "activity_sentences": (
        activity_sentences,
        """
        WITH e AS (SELECT event_id, event_type AS t, CASE WHEN event_id % 3 = 0 THEN repeat(props, 30) ELSE props END AS p FROM events),
        s AS (SELECT *, CASE WHEN length(p) > 180 THEN left(p, 180) || '…' ELSE p END AS d FROM e)
        SELECT event_id, concat_ws(': ', CASE t WHEN 'view' THEN 'Viewed a page' WHEN 'click' THEN 'Clicked an element' WHEN 'signup' THEN 'Signed up' WHEN 'purchase' THEN 'Made a purchase' ELSE 'Did ' || t END, nullif(d, '{}')) AS said FROM s
        """,
    ),
    "device_info": (
        device_info,
        f"""
        WITH a AS (SELECT [{", ".join(f"'{x}'" for x in AGENTS)}][CAST(user_id % {len(AGENTS)} AS INTEGER) + 1] AS a FROM events)
        SELECT {_FIRST(R.BROWSERS, "a")} AS browser, {_FIRST(R.SYSTEMS, "a")} AS system, CASE WHEN contains(a, 'iPad') OR contains(a, 'Tablet') THEN 'tablet' WHEN contains(a, 'Mobile') THEN 'mobile' ELSE 'desktop' END AS kind, count(*) AS n FROM a GROUP BY ALL
        """,
    ),
    "resolution_notice": (
        resolution_notice,
        f"""
        WITH {directory._CARDS}, n AS (SELECT pos, rung, split_part(matched, '|', 3) AS a, split_part(card, '|', 3) AS r FROM cards)
        SELECT pos, CASE rung WHEN 'office' THEN 'Officers of ' || a WHEN 'division' THEN a || ' has no officers; those of its division, ' || r WHEN 'ministry' THEN a || ' has no officers; those of its ministry, ' || r ELSE 'No officers are known for ' || a END AS notice FROM n
        """,
    ),
    "bengali_dates": (
        bengali_dates,
        f"SELECT o_orderkey, translate(day(o_orderdate) || ' ' || [{', '.join(repr(m) for m in calendar.BENGALI_MONTHS)}][month(o_orderdate)] || ' ' || year(o_orderdate), '0123456789', '০১২৩৪৫৬৭৮৯') AS day FROM orders",
    ),
    "usage_cost": (usage_cost, "SELECT l_suppkey, round((CAST(sum(l_partkey) AS DOUBLE) * 0.15::DOUBLE + CAST(sum(l_orderkey) AS DOUBLE) * 0.6::DOUBLE) / 1000000.0::DOUBLE, 6) AS usd FROM lineitem GROUP BY 1"),
    "fallback_summary": (
        fallback_summary,
        r"""
        WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?।]+[.!?।]*'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 1) AS s FROM documents)
        SELECT doc_id, length(array_to_string(s[:1], ' ')) AS short, length(array_to_string(s[:3], ' ')) AS middle, md5(array_to_string(s[:5], ' ')) AS long, 'en' AS language FROM s
        """,
    ),
    "certificate_json": (certificate_json, """SELECT doc_id, '{"@type":"Certificate","identifier":' || doc_id || ',"sha256":"' || sha256(text) || '","size":' || n_chars || '}' AS certificate FROM documents"""),
    "gazetteer_keys": (
        gazetteer_keys,
        r"""
        SELECT item_id, 'ab 12 ' || trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '-', '', 'g'), '[[:punct:]]', ' ', 'g'), '\s+', ' ', 'g')) AS key, regexp_replace(text, '^[\s[:punct:]]+|[\s[:punct:]]+$', '', 'g') AS clean FROM benchmark
        """,
    ),
    "domain_meta_first": (
        domain_meta_first,
        """
        WITH p AS (SELECT page_id, url, nullif(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www[.]', ''), '') AS host FROM pages),
        m AS (SELECT host, arg_min(url, page_id) AS first_url, count(*) AS n FROM p WHERE host IS NOT NULL GROUP BY 1)
        SELECT page_id, first_url, n FROM p LEFT JOIN m USING (host)
        """,
    ),
    "newest_files": (newest_files, "SELECT o_custkey, 'export-' || strftime(o_orderdate, '%Y%m%d') || '-' || o_orderkey || '.csv' AS file FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, lower('export-' || strftime(o_orderdate, '%Y%m%d') || '-' || o_orderkey || '.csv')) = 1"),
}
