"""Queries that resolve names against a directory.  Regions, nations and customers stand in for ministries, divisions and offices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import linkage, resolution


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _directory(spark, sf_dir):
    """Level rows of regions and nations, and an office for each customer; some have no officers."""
    region, nation, customer = (_t(spark, sf_dir, x) for x in ("region", "nation", "customer"))
    nations = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    offices = customer.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    row = lambda df, *cols: df.select(*[c.alias(n) for n, c in zip(("ministry", "division", "office", "has_officers", "row"), cols, strict=True)])
    top = row(region, F.col("r_name"), F.col("r_name"), F.col("r_name"), F.col("r_regionkey") != 2, F.col("r_regionkey").cast("long"))
    middle = row(nations, F.col("r_name"), F.col("n_name"), F.col("n_name"), F.col("n_nationkey") % 3 != 0, 100 + F.col("n_nationkey").cast("long"))
    low = row(offices, F.col("r_name"), F.when(F.col("c_custkey") % 9 == 0, F.lit("No such division")).otherwise(F.col("n_name")), F.col("c_name"), F.col("c_acctbal") > 0, 1000 + F.col("c_custkey"))
    return top.unionByName(middle).unionByName(low)


def _asked(spark, sf_dir):
    """Every customer, by a name in capitals with blanks, by an alias, or misspelt; and the nations."""
    key = F.col("c_custkey")
    name = F.when(key % 50 == 0, F.concat(F.lit("alias "), key.cast("string"))).when(key % 11 == 0, F.concat(F.col("c_name"), F.lit(" branch"))).otherwise(F.concat(F.lit("  "), F.upper("c_name"), F.lit(" ")))
    customers = _t(spark, sf_dir, "customer").select(name.alias("entity"), key.alias("pos"))
    return customers.unionByName(_t(spark, sf_dir, "nation").select(F.col("n_name").alias("entity"), (10_000_000 + F.col("n_nationkey").cast("long")).alias("pos")))


def _aliases(spark, sf_dir):
    key = F.col("c_custkey")
    rows = _t(spark, sf_dir, "customer").where(key % 50 == 0).join(_directory(spark, sf_dir), F.col("c_name") == F.col("office"))
    return rows.select(F.concat(F.lit("alias "), key.cast("string")).alias("alias"), "ministry", "division", "office")


def office_resolution(spark, sf_dir):
    return resolution.cards(_asked(spark, sf_dir), _directory(spark, sf_dir), _aliases(spark, sf_dir))


def unmatched_resolution(spark, sf_dir):
    """Names that no row has, classified by their customer's region and, for even keys, its nation."""
    rows = _t(spark, sf_dir, "customer").where("c_custkey % 11 = 0").join(_t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    classes = rows.select(F.concat(F.col("c_name"), F.lit(" branch")).alias("entity"), F.col("r_name").alias("ministry"), F.when(F.col("c_custkey") % 2 == 0, F.col("n_name")).alias("office"), (F.col("c_custkey") % 100 / 100).alias("confidence"))
    return resolution.classified(_asked(spark, sf_dir), classes, _directory(spark, sf_dir))


def related_ministries(spark, sf_dir):
    names = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.explode(F.array(F.lower("r_name"), F.col("n_name"))).alias("name"), F.col("n_nationkey").alias("pos"))
    return resolution.verified_names(names, _directory(spark, sf_dir), _t(spark, sf_dir, "region").where("r_regionkey = 1").select(F.col("r_name").alias("name")))


def verify_contact(spark, sf_dir):
    """The whole check of a contact: names to cards, each card's row compared with what a live page says, and what an upsert would do."""
    cards = resolution.cards(_asked(spark, sf_dir), _directory(spark, sf_dir), _aliases(spark, sf_dir)).where("rung = 'office'")
    rows = cards.join(_t(spark, sf_dir, "customer"), F.substring_index("card", "|", -1) == F.col("c_name")).select("card", "c_custkey", F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string").alias("nation"))
    live = rows.where("c_custkey % 4 <> 0").select("card", F.when(F.col("c_custkey") % 5 == 0, F.lit("CHANGED")).otherwise(F.lower("segment")).alias("segment"), F.when(F.col("c_custkey") % 7 == 0, F.lit(" ")).otherwise(F.col("nation")).alias("nation"))
    differing = linkage.discrepancies(rows, live, "card", ["segment", "nation"]).groupBy("card").agg(F.count_if("differs").alias("n_differ"), F.count("differs").alias("n_compared"))
    return rows.select("card").join(differing, "card", "left").select("card", F.when(F.col("n_compared").isNull(), "no_live_row").when(F.col("n_differ") > 0, "update").otherwise("verified").alias("verdict"), F.coalesce("n_differ", F.lit(0)).alias("n_differ"))


_DIRECTORY = """
dir AS (
  SELECT r_name AS m, r_name AS d, r_name AS o, r_regionkey <> 2 AS has, CAST(r_regionkey AS BIGINT) AS row FROM region
  UNION ALL SELECT r_name, n_name, n_name, n_nationkey % 3 <> 0, 100 + n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT r_name, CASE WHEN c_custkey % 9 = 0 THEN 'No such division' ELSE n_name END, c_name, c_acctbal > 0, 1000 + c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
asked AS (
  SELECT CASE WHEN c_custkey % 50 = 0 THEN 'alias ' || c_custkey WHEN c_custkey % 11 = 0 THEN c_name || ' branch' ELSE '  ' || upper(c_name) || ' ' END AS entity, c_custkey AS pos,
         CASE WHEN c_custkey % 50 = 0 OR c_custkey % 11 <> 0 THEN c_name ELSE c_name || ' branch' END AS means FROM customer
  UNION ALL SELECT n_name, 10000000 + n_nationkey, n_name FROM nation)"""
_CARDS = f"""{_DIRECTORY},
hit AS (SELECT entity, pos, dir.* FROM asked JOIN dir ON lower(trim(means)) = lower(o)),
up AS (SELECT h.*, v.m AS vm, v.d AS vd, v.o AS vo, v.has AS vhas, t.has AS thas, v.row IS NOT NULL AND v.row <> h.row AS up, t.row <> h.row AS top
  FROM hit h LEFT JOIN dir v ON v.m = h.m AND v.o = h.d AND h.d <> h.m JOIN dir t ON t.m = h.m AND t.d = h.m AND t.o = h.m),
rung AS (SELECT *, CASE WHEN has THEN 'office' WHEN up AND vhas THEN 'division' WHEN top AND thas THEN 'ministry' ELSE 'none' END AS rung,
  concat_ws(',', CASE WHEN NOT has THEN 'office:no_officers' END,
    CASE WHEN NOT has AND up AND NOT vhas THEN 'division:no_officers' WHEN NOT has AND NOT up AND d <> m AND d <> o THEN 'division:no_row' END,
    CASE WHEN NOT has AND NOT (up AND coalesce(vhas, false)) AND top AND NOT thas THEN 'ministry:no_officers' END) AS skipped FROM up),
keyed AS (SELECT *, m || '|' || d || '|' || o AS own, CASE rung WHEN 'office' THEN m || '|' || d || '|' || o WHEN 'division' THEN vm || '|' || vd || '|' || vo WHEN 'ministry' THEN m || '|' || m || '|' || m ELSE 'none:' || m || '|' || d || '|' || o END AS card FROM rung),
cards AS (SELECT card, min(pos) AS pos, arg_min(rung, pos) AS rung, count(DISTINCT trim(entity)) AS n_entities, arg_min(entity, pos) AS first_entity, arg_min(own, pos) AS matched, arg_min(skipped, pos) AS skipped FROM keyed GROUP BY card)"""

QUERIES = {
    "office_resolution": (office_resolution, f"WITH {_CARDS} SELECT * FROM cards"),
    "unmatched_resolution": (
        unmatched_resolution,
        f"""
        WITH {_DIRECTORY},
        c AS (SELECT c_name || ' branch' AS entity, c_custkey AS pos, r_name AS m, n_name AS n, c_custkey % 2 = 0 AS named, (c_custkey % 100) / 100.0::DOUBLE AS confidence FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey % 11 = 0 AND c_custkey % 50 <> 0)
        SELECT entity, pos, c.m || '|' || CASE WHEN named AND v.has THEN n || '|' || n ELSE c.m || '|' || c.m END AS card, 'classified' AS rung, confidence
        FROM c JOIN dir v ON v.o = n JOIN dir t ON t.o = c.m WHERE (named AND v.has) OR t.has
        """,
    ),
    "related_ministries": (related_ministries, "SELECT lower(r_name) AS name, min(n_nationkey) AS pos FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey <> 1 GROUP BY 1 ORDER BY 2 LIMIT 5"),
    "verify_contact": (
        verify_contact,
        f"""
        WITH {_CARDS},
        r AS (SELECT card, c_custkey AS k, c_mktsegment AS segment FROM cards JOIN customer ON c_name = split_part(card, '|', 3) WHERE rung = 'office')
        SELECT card, CASE WHEN k % 4 = 0 THEN 'no_live_row' WHEN k % 5 = 0 THEN 'update' ELSE 'verified' END AS verdict, CAST(CASE WHEN k % 4 <> 0 AND k % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_differ FROM r
        """,
    ),
}
