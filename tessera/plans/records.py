"""Queries that check records: fixity, two readings, change logs, runs, rankings, field rules, reports and totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, net
from ..functions import text as T
from ..operators import checks


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def evidence_verification(spark, sf_dir):
    """Digests on record against those of a copy with some texts changed and some gone."""
    docs = _t(spark, sf_dir, "documents")
    copy = docs.where("doc_id % 40 <> 7").select("doc_id", F.sha2(F.when(F.col("doc_id") % 50 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("digest"))
    return checks.verified(docs.select("doc_id", F.sha2("text", 256).alias("digest")), copy, "doc_id")


def two_reader_compare(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    a = c.where("c_custkey % 3 <> 0").select("c_custkey", F.col("c_mktsegment").alias("value"))
    b = c.where("c_custkey % 4 <> 0").select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, F.lower("c_mktsegment")).when(F.col("c_custkey") % 11 == 0, F.lit("OTHER")).otherwise(F.col("c_mktsegment")).alias("value"))
    return checks.two_readings(a, b, "c_custkey")


def change_log(spark, sf_dir):
    old = _t(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").cast("string").alias("nation"))
    new = old.where("s_suppkey % 3 = 0").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.upper("s_name")).otherwise(F.lit("  ")).alias("s_name"), F.when(F.col("s_suppkey") % 4 == 0, F.lit("99")).alias("nation"))
    return checks.change_log(old, new, "s_suppkey", ["s_name", "nation"])


def activity_runs(spark, sf_dir):
    return checks.runs(_t(spark, sf_dir, "events"), "user_id", "ts", "event_id", "event_type")


ANSWERS = ('[{"id":1,"score":0.5},{"id":3,"score":1.0}]', '[{"id":2,"score":0.5},{"id":2,"score":0.1}]', '[{"id":1,"score":1.2}]', "[]", '[{"id":9,"score":0.4}]', "no answer")


def ranking_validation(spark, sf_dir):
    """Answers of rankers, taken by order number; the broken kinds are rejected."""
    answer = F.get(F.array(*map(F.lit, ANSWERS)), (F.col("o_orderkey") % len(ANSWERS)).cast("int"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", checks.ranking_is_valid(answer, 5).alias("valid"))


def field_validation(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    email = F.when(F.col("c_custkey") % 7 == 0, F.lit("none")).otherwise(F.concat(T.squashed(F.translate("c_name", "#", ".")), F.lit("@x.org")))
    phone = F.concat(F.lit("0"), F.col("c_custkey").cast("string"), F.repeat(F.lit("1"), (F.col("c_custkey") % 9).cast("int")))
    rules = [("bad_email", ~email.rlike(r"^[a-z0-9.]+@[a-z]+\.org$")), ("short_phone", F.length(phone) < 7), ("overdrawn", F.col("c_acctbal") < 0), ("no_segment", ~T.has_name(F.col("c_mktsegment")))]
    return c.select("c_custkey", checks.field_flags(rules).alias("flags"))


def private_addresses(spark, sf_dir):
    first = F.get(F.array(*[F.lit(x) for x in (10, 127, 172, 192, 169, 8, 230)]), (F.col("c_custkey") % 7).cast("int"))
    ip = F.concat_ws(".", first.cast("string"), (F.col("c_custkey") * 3 % 260).cast("string"), F.col("c_nationkey").cast("string"), F.lit("1"))
    return _t(spark, sf_dir, "customer").select("c_custkey", ip.alias("ip"), net.private_ipv4(ip).alias("private"))


def allowed_pages(spark, sf_dir):
    rows = _t(spark, sf_dir, "pages").select(net.allowed_url(F.col("url"), ("example.org", "example.com")).alias("allowed"), "page_id")
    return rows.groupBy("allowed").agg(F.count("*").alias("n"), F.min("page_id").alias("first_id"))


CHAIN = [("licensed under", "license"), ("mit license", "mit"), ("der ", "german"), ("the ", "english")]


def accountability_first_match(spark, sf_dir):
    return _t(spark, sf_dir, "documents").groupBy(checks.first_rule(F.col("text"), CHAIN).alias("label")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


def urgency_prescreen(spark, sf_dir):
    """Terms that ask for haste and terms that bar an answer, counted; the label follows the counts."""
    low = F.lower("text")
    haste, bar = F.regexp_count(low, F.lit("!|urgent")).cast("long"), F.regexp_count(low, F.lit("secret|password")).cast("long")
    label = F.when(F.col("bar") > 0, "barred").when(F.col("haste") >= 3, "urgent").when(F.col("haste") > 0, "soon").otherwise("normal")
    return _t(spark, sf_dir, "documents").select("doc_id", haste.alias("haste"), bar.alias("bar")).withColumn("label", label)


def coordinate_dms(spark, sf_dir):
    d, m, s = geo.dms_parts((F.col("c_custkey") * 37 % 9000) / F.lit(100.0) + 0.125)
    return _t(spark, sf_dir, "customer").select("c_custkey", d.alias("d"), m.alias("m"), s.alias("s"))


def type_report(spark, sf_dir):
    """A line per user: event types with counts, the most first."""
    counts = _t(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "event_type", "n"))), lambda x: F.concat(x["event_type"], F.lit("="), x["n"].cast("string")))
    return counts.groupBy("user_id").agg(F.sum("n").alias("activities"), F.array_join(parts, ";").alias("report"))


def provider_eval(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").withColumn("tier", F.col("event_id") % 3)
    return rows.groupBy("event_type", "tier").agg(F.count("*").alias("n"), F.round(F.avg("value"), 3).alias("mean_value"), F.round(100.0 * F.count_if(F.col("value") > 10) / F.count("*"), 1).alias("valid_pct"))


def usage_totals(spark, sf_dir):
    return _t(spark, sf_dir, "orders").agg(F.count("*").alias("calls"), F.round(F.sum("o_totalprice"), 1).alias("cost"), F.count_distinct("o_custkey").alias("callers"))


def hierarchy_lists(spark, sf_dir):
    rows = _t(spark, sf_dir, "region").join(_t(spark, sf_dir, "nation"), F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return rows.groupBy("r_name").agg(F.array_join(F.sort_array(F.collect_set("n_name")), "|").alias("nations"), F.count("n_name").alias("n"))


def fill_metrics(spark, sf_dir):
    """How full the rows of a thinned directory are, by segment."""
    c = _t(spark, sf_dir, "customer")
    filled = sum(((F.col("c_custkey") % k != 0).cast("int") for k in (2, 3, 4, 5)), F.lit(0))
    return c.groupBy("c_mktsegment", checks.fill_status(filled, 4).alias("status")).agg(F.count("*").alias("n"))


QUERIES = {
    "evidence_verification": (
        evidence_verification,
        """
        WITH n AS (SELECT doc_id, sha256(CASE WHEN doc_id % 50 = 0 THEN text || '!' ELSE text END) AS d FROM documents WHERE doc_id % 40 <> 7)
        SELECT m.doc_id, CASE WHEN n.d IS NULL THEN 'missing' WHEN n.d = sha256(m.text) THEN 'verified' ELSE 'tampered' END AS status FROM documents m LEFT JOIN n ON n.doc_id = m.doc_id
        """,
    ),
    "two_reader_compare": (
        two_reader_compare,
        """
        WITH a AS (SELECT c_custkey, c_mktsegment AS x FROM customer WHERE c_custkey % 3 <> 0),
        b AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN lower(c_mktsegment) WHEN c_custkey % 11 = 0 THEN 'OTHER' ELSE c_mktsegment END AS y FROM customer WHERE c_custkey % 4 <> 0)
        SELECT c_custkey, x, y, CASE WHEN x IS NULL OR y IS NULL THEN 'single' WHEN lower(x) = lower(y) THEN 'agree' ELSE 'disagree' END AS status FROM a FULL JOIN b USING (c_custkey)
        """,
    ),
    "change_log": (
        change_log,
        """
        WITH o AS (SELECT s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS nation FROM supplier WHERE s_suppkey % 3 = 0),
        c AS (SELECT s_suppkey, 's_name' AS field, s_name AS old_value, CASE WHEN s_suppkey % 2 = 0 THEN upper(s_name) END AS new_value FROM o
              UNION ALL SELECT s_suppkey, 'nation', nation, CASE WHEN s_suppkey % 4 = 0 THEN '99' END FROM o)
        SELECT * FROM c WHERE new_value IS NOT NULL AND new_value IS DISTINCT FROM old_value
        """,
    ),
    "activity_runs": (
        activity_runs,
        """
        WITH m AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS is_new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        r AS (SELECT *, CAST(sum(is_new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM m)
        SELECT user_id, run, event_type, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM r GROUP BY 1, 2, 3
        """,
    ),
    "ranking_validation": (ranking_validation, "SELECT o_orderkey, o_orderkey % 6 = 0 AS valid FROM orders"),
    "field_validation": (
        field_validation,
        """
        SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 7 = 0 THEN 'bad_email' END, CASE WHEN 1 + length(CAST(c_custkey AS VARCHAR)) + c_custkey % 9 < 7 THEN 'short_phone' END, CASE WHEN c_acctbal < 0 THEN 'overdrawn' END) AS flags FROM customer
        """,
    ),
    "private_addresses": (
        private_addresses,
        """
        WITH p AS (SELECT c_custkey, c_nationkey, ([10, 127, 172, 192, 169, 8, 230])[c_custkey % 7 + 1] AS a, c_custkey * 3 % 260 AS b FROM customer)
        SELECT c_custkey, a || '.' || b || '.' || c_nationkey || '.1' AS ip,
               CASE WHEN b <= 255 THEN a IN (0, 10, 127) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254) OR a >= 224 END AS private FROM p
        """,
    ),
    "allowed_pages": (
        allowed_pages,
        r"SELECT coalesce(regexp_matches(lower(url), '^https?://([^/?#]*\.)?example\.(org|com)(:[0-9]+)?([/?#]|$)'), false) AS allowed, count(*) AS n, min(page_id) AS first_id FROM pages GROUP BY 1",
    ),
    "accountability_first_match": (
        accountability_first_match,
        f"""
        WITH l AS (SELECT doc_id, lower(text) AS t FROM documents)
        SELECT CASE {" ".join(f"WHEN contains(t, '{p}') THEN '{n}'" for p, n in CHAIN)} ELSE 'none' END AS label, count(*) AS n, min(doc_id) AS first_id FROM l GROUP BY 1
        """,
    ),
    "urgency_prescreen": (
        urgency_prescreen,
        """
        WITH c AS (SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '!|urgent')) AS BIGINT) AS haste, CAST(len(regexp_extract_all(lower(text), 'secret|password')) AS BIGINT) AS bar FROM documents)
        SELECT *, CASE WHEN bar > 0 THEN 'barred' WHEN haste >= 3 THEN 'urgent' WHEN haste > 0 THEN 'soon' ELSE 'normal' END AS label FROM c
        """,
    ),
    "coordinate_dms": (
        coordinate_dms,
        """
        WITH x AS (SELECT c_custkey, (c_custkey * 37 % 9000) / 100.0::DOUBLE + 0.125::DOUBLE AS x FROM customer), d AS (SELECT *, floor(x) AS d, floor((x - floor(x)) * 60) AS m FROM x)
        SELECT c_custkey, CAST(d AS BIGINT) AS d, CAST(m AS BIGINT) AS m, round(((x - d) * 60 - m) * 60, 2) AS s FROM d
        """,
    ),
    "type_report": (
        type_report,
        """
        WITH k AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
        SELECT user_id, CAST(sum(n) AS BIGINT) AS activities, string_agg(event_type || '=' || n, ';' ORDER BY n DESC, event_type) AS report FROM k GROUP BY 1
        """,
    ),
    "provider_eval": (
        provider_eval,
        "SELECT event_type, event_id % 3 AS tier, count(*) AS n, round(avg(value), 3) AS mean_value, round(100.0::DOUBLE * count(*) FILTER (value > 10) / count(*), 1) AS valid_pct FROM events GROUP BY 1, 2",
    ),
    "usage_totals": (usage_totals, "SELECT count(*) AS calls, round(sum(o_totalprice), 1) AS cost, count(DISTINCT o_custkey) AS callers FROM orders"),
    "hierarchy_lists": (hierarchy_lists, "SELECT r_name, coalesce(string_agg(DISTINCT n_name, '|' ORDER BY n_name), '') AS nations, count(n_name) AS n FROM region LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY 1"),
    "fill_metrics": (
        fill_metrics,
        """
        WITH f AS (SELECT c_mktsegment, CAST(c_custkey % 2 <> 0 AS INT) + CAST(c_custkey % 3 <> 0 AS INT) + CAST(c_custkey % 4 <> 0 AS INT) + CAST(c_custkey % 5 <> 0 AS INT) AS f FROM customer)
        SELECT c_mktsegment, CASE WHEN f >= 4 THEN 'complete' WHEN f * 2 >= 4 THEN 'partial' WHEN f > 0 THEN 'sparse' ELSE 'blank' END AS status, count(*) AS n FROM f GROUP BY 1, 2
        """,
    ),
}
