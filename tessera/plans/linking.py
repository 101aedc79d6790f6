"""Queries that match, merge and reconcile records.  Regions, nations and customers stand in for ministries, divisions and offices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import linkage, reconcile


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _values(spark, names, col="entity"):
    return spark.createDataFrame([(x,) for x in names], f"{col} string")


ENTITIES = ("NATION_3", " nation_7 ", "Customer#000000012", "customer#000000044", "Brand#2", "BUILDING", "Nowhere")


def tiered_entity_match(spark, sf_dir):
    tiers = [(_t(spark, sf_dir, "nation"), "n_name", "nation", 100), (_t(spark, sf_dir, "customer"), "c_name", "customer", 95), (_t(spark, sf_dir, "part"), "p_brand", "brand", 90), (_t(spark, sf_dir, "customer"), "c_mktsegment", "segment", 85)]
    return linkage.tiered(_values(spark, ENTITIES), tiers)


def hierarchy_fallback(spark, sf_dir):
    """A customer without balance falls to its nation's best supplier, then to its region."""
    customer, nation, region, supplier = (_t(spark, sf_dir, x) for x in ("customer", "nation", "region", "supplier"))
    best = supplier.where("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.max_by("s_name", F.struct("s_acctbal", "s_suppkey")).alias("s_name"))
    rows = customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left").join(best, "c_nationkey", "left")
    rungs = [("office", F.col("c_acctbal") > 5000, F.col("c_name")), ("division", F.col("s_name").isNotNull() & (F.col("c_acctbal") > 0), F.col("s_name")), ("ministry", F.col("r_name").isNotNull() & (F.col("c_nationkey") % 5 != 0), F.col("r_name"))]
    safe = [(n, F.coalesce(u, F.lit(False)), v) for n, u, v in rungs]
    return linkage.ladder(rows, safe).select("c_custkey", "rung", "resolved", "skipped")


def scored_best_row(spark, sf_dir):
    """For each customer segment and nation, the supplier of that nation that fits best."""
    supplier = _t(spark, sf_dir, "supplier")
    asked = _t(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("want"), F.min("c_custkey").alias("first_key"))
    pairs = asked.join(supplier, asked.c_nationkey == supplier.s_nationkey)
    rules = [(F.col("s_acctbal") >= F.col("want"), 140), (F.col("s_suppkey") % 10 == F.col("first_key") % 10, 210), (F.col("s_acctbal") > 0, 75), (F.length("s_name") > 10, 5)]
    return linkage.best_scored(pairs, "c_nationkey", "s_suppkey", rules, 80).select("c_nationkey", "s_suppkey", "score")


def upsert_projection(spark, sf_dir):
    supplier = _t(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").cast("string").alias("nation"))
    updates = supplier.where("s_suppkey % 3 = 0").select(
        (F.col("s_suppkey") + F.when(F.col("s_suppkey") % 9 == 0, 1000000).otherwise(0)).alias("s_suppkey"), F.when(F.col("s_suppkey") % 2 == 0, F.upper("s_name")).otherwise(F.lit("  ")).alias("s_name"), F.when(F.col("s_suppkey") % 4 == 0, F.lit("99")).alias("nation")
    )
    return linkage.upsert(supplier, updates, "s_suppkey", ["s_name", "nation"])


def field_discrepancies(spark, sf_dir):
    left = _t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    right = left.select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, F.concat(F.col("c_name"), F.lit(" x"))).otherwise(F.upper("c_name")).alias("c_name"), F.when(F.col("c_custkey") % 7 == 0, F.lit("")).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    return linkage.discrepancies(left, right, "c_custkey", ["c_name", "c_mktsegment"])


def consensus_full_outer(spark, sf_dir):
    labels = _t(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    a = labels.where("doc_id % 3 <> 0").select("doc_id", (0.5 + F.col("quality") * 0.3).alias("confidence"))
    b = labels.where("doc_id % 2 = 0").select("doc_id", (0.6 + (F.col("doc_id") % 10) / 40.0).alias("confidence"))
    return linkage.consensus(a, b, ["doc_id"])


def unmatched_anti(spark, sf_dir):
    return _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id", "left_anti").groupBy("lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


def related_semi(spark, sf_dir):
    return _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels").where("quality = 1"), "doc_id", "left_semi").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def unique_host_match(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages")
    wanted = pages.select(T.host(F.col("url")).alias("k")).where("k IS NOT NULL").distinct()
    return linkage.unique_match(pages.select("page_id", "url"), T.host(F.col("url")), wanted)


def fuzzy_name_match(spark, sf_dir):
    names = _values(spark, ("smal ring", "red widgets", "blue gizmo", "large bolt", "grean widget", "Small Ring"), "name")
    return linkage.closest(names, _t(spark, sf_dir, "part").select(F.col("p_name").alias("choice")), 0.15)


def dedupe_merge_records(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("identity"), F.col("c_custkey").alias("pos"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).alias("name"), F.col("c_mktsegment").alias("tag"))
    s = _t(spark, sf_dir, "supplier").select(F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("identity"), (F.col("s_suppkey") + 100000000).alias("pos"), F.col("s_name").alias("name"), F.lit(None).cast("string").alias("tag"))
    return reconcile.merged(c.unionByName(s), "identity", "pos", ["name", "tag"])


def precedence_merge(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    part = lambda kind, keep, value: c.where(keep).select(F.col("c_custkey").alias("row_key"), F.lit("name").alias("field"), value.alias("value"), F.lit(kind).alias("source_kind"), F.col("c_custkey").alias("seq"))
    rows = part("live", "c_custkey % 2 = 0", F.col("c_name")).unionByName(part("archive", "c_custkey % 3 = 0", F.upper("c_name"))).unionByName(part("human_confirmed", "c_custkey % 5 = 0", F.when(F.col("c_custkey") % 10 == 0, F.lit(" ")).otherwise(F.lit("checked"))))
    return reconcile.by_precedence(rows)


def shared_value_placeholder(spark, sf_dir):
    return reconcile.placeholders(_t(spark, sf_dir, "part"), "p_size", "p_name", 3)


def duplicate_signature_groups(spark, sf_dir):
    return reconcile.same_signature(_t(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_returnflag"], "l_orderkey", 2)


def org_occurrence_unpivot(spark, sf_dir):
    nation, region = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "region")
    rows = _t(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return reconcile.occurrences(rows, {"region": "r_name", "nation": "n_name", "segment": "c_mktsegment"}, "c_nationkey")


def latest_valid_entry(spark, sf_dir):
    """The newest order of each customer that hasn't expired."""
    rows = _t(spark, sf_dir, "orders").where("o_orderdate > TIMESTAMP_NTZ '1997-01-01 00:00:00'")
    return rows.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"), F.max("o_orderdate").alias("o_orderdate"))


def earliest_complete(spark, sf_dir):
    """The first finished order of each customer, else the first."""
    return _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct(F.col("o_orderstatus") != "F", "o_orderdate", "o_orderkey")).alias("first_key"), F.count("*").alias("n"))


def ordered_distinct_union(spark, sf_dir):
    lists = [_t(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("pos")), _t(spark, sf_dir, "customer").select(F.lower("c_mktsegment"), F.col("c_custkey") + 1000), _t(spark, sf_dir, "customer").select("c_mktsegment", F.col("c_custkey") + 2000)]
    return reconcile.distinct_first_seen(lists)


def partition_replace(spark, sf_dir):
    old = _t(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return reconcile.replace_keys(old, old.where("n_nationkey < 5").select("n_nationkey", F.concat(F.col("n_name"), F.lit("*")).alias("n_name")), ["n_nationkey"])


def tier_coverage(spark, sf_dir):
    tier = F.when(F.col("p_size") <= 10, 1).when(F.col("p_brand").rlike("#1"), 2).when(F.col("p_name").startswith("small"), 3).otherwise(4)
    return reconcile.coverage(_t(spark, sf_dir, "part").withColumn("tier", tier), "tier", {"brand": F.col("p_brand").rlike("2"), "type": F.col("p_type") != "ECONOMY"})


_CONS = """
        WITH l AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1),
        a AS (SELECT doc_id, 0.5::DOUBLE + quality * 0.3::DOUBLE AS ca FROM l WHERE doc_id % 3 <> 0), b AS (SELECT doc_id, 0.6::DOUBLE + (doc_id % 10) / 40.0::DOUBLE AS cb FROM l WHERE doc_id % 2 = 0)
        SELECT doc_id, round(CASE WHEN ca IS NULL THEN cb WHEN cb IS NULL THEN ca ELSE greatest(ca, least(0.98::DOUBLE, (ca + cb) / 2 + 0.08::DOUBLE)) END, 4) AS confidence,
               CASE WHEN ca IS NULL THEN 'b' WHEN cb IS NULL THEN 'a' ELSE 'a+b' END AS sources FROM a FULL JOIN b USING (doc_id)
"""
_HOST = r"regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\.', '')"

QUERIES = {
    "tiered_entity_match": (
        tiered_entity_match,
        f"""
        WITH e AS (SELECT unnest({list(ENTITIES)}) AS entity),
        t AS (SELECT DISTINCT n_name AS matched, 'nation' AS kind, 100 AS confidence FROM nation UNION ALL SELECT DISTINCT c_name, 'customer', 95 FROM customer
              UNION ALL SELECT DISTINCT p_brand, 'brand', 90 FROM part UNION ALL SELECT DISTINCT c_mktsegment, 'segment', 85 FROM customer),
        m AS (SELECT entity, kind, matched, confidence, row_number() OVER (PARTITION BY entity ORDER BY confidence DESC, kind, matched) AS rank FROM e JOIN t ON lower(trim(entity)) = lower(trim(matched)))
        SELECT e.entity, kind, matched, coalesce(confidence, 0) AS confidence, CAST(coalesce(rank, 1) AS INTEGER) AS rank FROM e LEFT JOIN m ON e.entity = m.entity AND rank <= 5
        """,
    ),
    "hierarchy_fallback": (
        hierarchy_fallback,
        """
        WITH b AS (SELECT s_nationkey, arg_max(s_name, (s_acctbal, s_suppkey)) AS s_name FROM supplier WHERE s_acctbal > 0 GROUP BY 1),
        r AS (SELECT c.*, s_name, r_name, coalesce(c_acctbal > 5000, false) AS o, coalesce(s_name IS NOT NULL AND c_acctbal > 0, false) AS d, coalesce(r_name IS NOT NULL AND c_nationkey % 5 <> 0, false) AS m
              FROM customer c LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN b ON s_nationkey = c_nationkey)
        SELECT c_custkey, CASE WHEN o THEN 'office' WHEN d THEN 'division' WHEN m THEN 'ministry' ELSE 'none' END AS rung,
               CASE WHEN o THEN c_name WHEN d THEN s_name WHEN m THEN r_name END AS resolved,
               CASE WHEN o THEN '' WHEN d THEN 'office' WHEN m THEN 'office,division' ELSE 'office,division,ministry' END AS skipped FROM r
        """,
    ),
    "scored_best_row": (
        scored_best_row,
        """
        WITH a AS (SELECT c_nationkey, avg(c_acctbal) AS want, min(c_custkey) AS first_key FROM customer GROUP BY 1),
        s AS (SELECT c_nationkey, s_suppkey, CAST((CASE WHEN s_acctbal >= want THEN 140 ELSE 0 END) + (CASE WHEN s_suppkey % 10 = first_key % 10 THEN 210 ELSE 0 END) + (CASE WHEN s_acctbal > 0 THEN 75 ELSE 0 END) + (CASE WHEN length(s_name) > 10 THEN 5 ELSE 0 END) AS DOUBLE) AS score
              FROM a JOIN supplier ON c_nationkey = s_nationkey)
        SELECT c_nationkey, s_suppkey, score FROM s WHERE score >= 80 QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY score DESC, s_suppkey) = 1
        """,
    ),
    "upsert_projection": (
        upsert_projection,
        """
        WITH a AS (SELECT s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS nation FROM supplier),
        b AS (SELECT s_suppkey + CASE WHEN s_suppkey % 9 = 0 THEN 1000000 ELSE 0 END AS s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN upper(s_name) ELSE '  ' END AS s_name, CASE WHEN s_suppkey % 4 = 0 THEN '99' END AS nation FROM a WHERE s_suppkey % 3 = 0)
        SELECT coalesce(a.s_suppkey, b.s_suppkey) AS s_suppkey, coalesce(nullif(trim(b.s_name), ''), a.s_name) AS s_name, coalesce(nullif(trim(b.nation), ''), a.nation) AS nation,
               CASE WHEN a.s_suppkey IS NULL THEN 'inserted' WHEN coalesce(nullif(trim(b.s_name), '') <> a.s_name, false) OR coalesce(nullif(trim(b.nation), '') <> a.nation, false) THEN 'updated' ELSE 'kept' END AS action
        FROM a FULL JOIN b ON a.s_suppkey = b.s_suppkey
        """,
    ),
    "field_discrepancies": (
        field_discrepancies,
        """
        WITH r AS (SELECT c_custkey, c_name, c_mktsegment, CASE WHEN c_custkey % 5 = 0 THEN c_name || ' x' ELSE upper(c_name) END AS n2, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_mktsegment END AS m2 FROM customer),
        l AS (SELECT c_custkey, 'c_name' AS field, c_name AS db_value, n2 AS live_value FROM r UNION ALL SELECT c_custkey, 'c_mktsegment', c_mktsegment, m2 FROM r)
        SELECT *, CASE WHEN nullif(trim(db_value), '') IS NOT NULL AND nullif(trim(live_value), '') IS NOT NULL THEN lower(db_value) <> lower(live_value) END AS differs FROM l
        """,
    ),
    "consensus_full_outer": (consensus_full_outer, _CONS),
    "unmatched_anti": (unmatched_anti, "SELECT lang, count(*) AS n, min(doc_id) AS first_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY 1"),
    "related_semi": (related_semi, "SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1) GROUP BY 1"),
    "unique_host_match": (unique_host_match, f"SELECT {_HOST} AS k, CASE WHEN count(*) = 1 THEN min(page_id) END AS \"row\", count(*) AS n FROM pages WHERE {_HOST} <> '' GROUP BY 1"),
    "fuzzy_name_match": (
        fuzzy_name_match,
        """
        WITH n AS (SELECT unnest(['smal ring', 'red widgets', 'blue gizmo', 'large bolt', 'grean widget', 'Small Ring']) AS name), c AS (SELECT DISTINCT p_name AS choice FROM part),
        p AS (SELECT name, choice, levenshtein(lower(name), lower(choice)) AS distance FROM n, c)
        SELECT name, choice, CAST(distance AS INTEGER) AS distance FROM p WHERE distance <= greatest(1, floor(length(name) * 0.15)) QUALIFY row_number() OVER (PARTITION BY name ORDER BY distance, choice) = 1
        """,
    ),
    "dedupe_merge_records": (
        dedupe_merge_records,
        """
        WITH u AS (SELECT 'N' || c_nationkey AS identity, c_custkey AS pos, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS name, c_mktsegment AS tag FROM customer
                   UNION ALL SELECT 'N' || s_nationkey, s_suppkey + 100000000, s_name, NULL FROM supplier)
        SELECT identity, arg_min(name, pos) FILTER (nullif(trim(name), '') IS NOT NULL) AS name, arg_min(tag, pos) FILTER (nullif(trim(tag), '') IS NOT NULL) AS tag, count(*) AS merged FROM u GROUP BY 1
        """,
    ),
    "precedence_merge": (
        precedence_merge,
        """
        WITH r AS (SELECT c_custkey AS row_key, c_name AS value, 'live' AS source_kind, 1 AS rank FROM customer WHERE c_custkey % 2 = 0
                   UNION ALL SELECT c_custkey, upper(c_name), 'archive', 6 FROM customer WHERE c_custkey % 3 = 0
                   UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN ' ' ELSE 'checked' END, 'human_confirmed', 0 FROM customer WHERE c_custkey % 5 = 0),
        f AS (SELECT * FROM r WHERE trim(value) <> '')
        SELECT row_key, 'name' AS field, arg_min(value, rank) AS value, arg_min(source_kind, rank) AS source_kind, count(DISTINCT lower(trim(value))) > 1 AS conflict FROM f GROUP BY 1
        """,
    ),
    "shared_value_placeholder": (shared_value_placeholder, "SELECT p_size AS value, count(*) AS uses, count(DISTINCT p_name) AS names FROM part GROUP BY 1 HAVING count(*) >= 3 AND count(DISTINCT p_name) > 1"),
    "duplicate_signature_groups": (duplicate_signature_groups, "SELECT l_quantity, l_discount, l_tax, l_returnflag, count(*) AS rows, min(l_orderkey) AS first_row FROM lineitem GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2"),
    "org_occurrence_unpivot": (
        org_occurrence_unpivot,
        """
        WITH r AS (SELECT r_name, n_name, c_mktsegment, c_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
        l AS (SELECT 'region' AS kind, r_name AS name, c_nationkey AS s FROM r UNION ALL SELECT 'nation', n_name, c_nationkey FROM r UNION ALL SELECT 'segment', c_mktsegment, c_nationkey FROM r)
        SELECT kind, name, count(*) AS n, count(DISTINCT s) AS sources FROM l GROUP BY 1, 2
        """,
    ),
    "latest_valid_entry": (latest_valid_entry, "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, max(o_orderdate) AS o_orderdate FROM orders WHERE o_orderdate > TIMESTAMP '1997-01-01' GROUP BY 1"),
    "earliest_complete": (earliest_complete, "SELECT o_custkey, arg_min(o_orderkey, (o_orderstatus <> 'F', o_orderdate, o_orderkey)) AS first_key, count(*) AS n FROM orders GROUP BY 1"),
    "ordered_distinct_union": (
        ordered_distinct_union,
        """
        WITH u AS (SELECT n_name AS name, n_nationkey AS pos, 0 AS list FROM nation UNION ALL SELECT lower(c_mktsegment), c_custkey + 1000, 1 FROM customer UNION ALL SELECT c_mktsegment, c_custkey + 2000, 2 FROM customer),
        d AS (SELECT arg_min(name, (list, pos)) AS name, min((list, pos)) AS first_at FROM u GROUP BY lower(name))
        SELECT name, CAST(row_number() OVER (ORDER BY first_at) AS INTEGER) AS place FROM d
        """,
    ),
    "partition_replace": (partition_replace, "SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN n_name || '*' ELSE n_name END AS n_name FROM nation"),
    "tier_coverage": (
        tier_coverage,
        """
        WITH t AS (SELECT CASE WHEN p_size <= 10 THEN 1 WHEN p_brand LIKE '%#1%' THEN 2 WHEN p_name LIKE 'small%' THEN 3 ELSE 4 END AS tier, p_brand LIKE '%2%' AS b, p_type <> 'ECONOMY' AS y FROM part)
        SELECT CAST(tier AS INTEGER) AS tier, count(*) AS n, round(100.0 * count(*) FILTER (b) / count(*), 1) AS brand_pct, round(100.0 * count(*) FILTER (y) / count(*), 1) AS type_pct FROM t GROUP BY 1
        """,
    ),
}
