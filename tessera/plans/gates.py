"""Queries on gates, metrics of requests, tolerant JSON, fact checks and similar articles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import gates, quality, retrieval


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Names of offices by kind, which the customers bear in turn.
OFFICES = ("জেলা প্রশাসক, ", "মন্ত্রণালয় ", "পরিবেশ অধিদপ্তর ", "কার্যালয় ", "Section ")
DENY, MANUAL = ("Section 1", "দপ্তর 7"), ("কার্যালয় 1",)


def row_selection(spark, sf_dir):
    """Tier, exemption and whether a directory row is due, by a state that some rows have."""
    key = F.col("c_custkey")
    office = F.when(key % 6 == 5, F.concat(key.cast("string"), F.lit(" মন্ত্রণালয়"))).otherwise(F.concat(F.get(F.array(*map(F.lit, OFFICES)), (key % 6).cast("int")), key.cast("string")))
    division = F.when(key % 12 == 3, office).otherwise(F.lit("X"))
    status = F.get(F.array(*map(F.lit, ("complete", "sparse", "failed", "page_blank"))), (key % 5).cast("int"))
    retry, now = F.when(key % 7 == 0, key * 10), F.lit(5000)
    rows = _t(spark, sf_dir, "customer").select("c_custkey", gates.tier(F.lit("M"), division, office).alias("tier"), gates.exemption(office, division, DENY, MANUAL).alias("exemption"), gates.due(status, retry, now).alias("due"), gates.due(status, retry, now, True).alias("due_again"))
    return rows


ENTITIES = ("Ministry 12", "  A ", "https://x.org/a", "12-34 / 5", "n/a", "Not Found", "article", "সরকার", "Dhaka South", "Office of Audit", "", "x" * 97)
SOURCES = (("Rumor Scanner BD", "https://a.org", "Title"), ("Daily", "https://www.boombd.com/x", "Title"), ("Daily", "https://a.org", "FACT-CHECK: no"), ("Daily", "https://a.org", "ভুয়া খবর"), ("Daily", "https://a.org", "Rain today"))


def entity_gates(spark, sf_dir):
    """Entities that are none, and feed items that are fact checks; values taken by part number."""
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (F.col("p_partkey") % len(values)).cast("int"))
    source, url, title = (pick([x[i] for x in SOURCES]) for i in range(3))
    return _t(spark, sf_dir, "part").select("p_partkey", gates.invalid_entity(pick(ENTITIES)).alias("invalid"), gates.is_fact_check(source, url, title).alias("fact_check"))


def grounded_values(spark, sf_dir):
    """Whether what was extracted for a customer stands in its page: a phone in other digits, an e-mail in capitals, a name, or something else."""
    key = F.col("c_custkey")
    page = F.concat(F.lit("Contact  "), F.col("c_name"), F.lit("\nPhone: 017-"), F.lpad(key.cast("string"), 6, "0"), F.lit("\nMail: "), F.lower(F.regexp_replace("c_name", "#", ".")), F.lit("@x.org"))
    field = F.get(F.array(*map(F.lit, ("Phone", "Email", "Name", "Name"))), (key % 4).cast("int"))
    value = F.when(key % 4 == 0, F.concat(F.lit("+017 "), T.bengali_digits(F.lpad((key + F.when(key % 3 == 0, 1).otherwise(0)).cast("string"), 6, "0")))).when(key % 4 == 1, F.concat(F.upper(F.regexp_replace("c_name", "#", ".")), F.lit("@X.ORG")))
    value = F.coalesce(value, F.when(key % 4 == 2, F.concat(F.lit(" Contact "), F.col("c_name"))).otherwise(F.upper("c_name")))
    return _t(spark, sf_dir, "customer").select("c_custkey", gates.grounded(field, value, page).alias("grounded"))


def extraction_quality(spark, sf_dir):
    """Documents whose text should be extracted another way."""
    rows = quality.boilerplate_features(_t(spark, sf_dir, "documents").select("doc_id", "source", "text"), "text", r"\|")
    flag = quality.looks_boilerplate(F.col("n_tokens"), F.col("distinct_ratio"), F.col("n_sentences"), F.col("nav_hits"))
    return rows.select("doc_id", gates.low_quality(F.col("source"), F.col("text"), flag, 200).alias("low_quality"))


def request_paths(spark, sf_dir):
    path = F.when(F.col("event_id") % 4 == 0, F.lit("/Page")).otherwise(F.concat(F.lit("/API/"), F.col("event_type"), F.lit("/"), (F.col("user_id") % 7).cast("string")))
    return gates.path_counts(_t(spark, sf_dir, "events").select(path.alias("path")), "path")


def cache_metrics(spark, sf_dir):
    """Entries of each cache, and its oldest and newest."""
    return _t(spark, sf_dir, "events").groupBy(F.col("event_type").alias("cache")).agg(F.count("*").alias("entries"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"))


def relevance_score(spark, sf_dir):
    """Relevance of each order, its lines standing for what was found in an article."""
    found = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.expr("l_returnflag = 'R'")).alias("orgs"), F.count_if(F.expr("l_quantity > 25")).alias("money"), F.count_if(F.expr("l_linestatus = 'F'")).alias("legal"), F.count_if(F.expr("l_returnflag = 'A'")).alias("persons"), F.avg("l_discount").alias("civic"))
    return found.select("l_orderkey", gates.relevance(F.round(F.col("civic") * 10, 2), *map(F.col, ("orgs", "money", "legal", "persons"))).alias("score"))


def evidence_compare(spark, sf_dir):
    """Each document against a capture of it: the same with other blanks, with a word more, or empty."""
    capture = F.when(F.col("doc_id") % 4 == 0, F.lit(" ")).when(F.col("doc_id") % 4 == 1, F.concat(F.col("text"), F.lit("  captured"))).otherwise(F.concat(F.lit(" "), F.regexp_replace("text", " ", "  ")))
    rows = _t(spark, sf_dir, "documents").select("doc_id", gates.compared(F.col("text"), capture).alias("x"))
    return rows.select("doc_id", "x.match", "x.a_sha256", (F.col("x.a_sha256") == F.col("x.b_sha256")).alias("same_digest"), "x.overlap")


def tolerant_json(spark, sf_dir):
    """Model answers around the events' JSON: fenced, after a preamble, with typographic quotes or trailing commas, or broken."""
    way, props = F.col("event_id") % 6, F.col("props")
    text = F.when(way == 0, F.concat(F.lit("Here it is:\n```json\n"), props, F.lit("\n```\nThanks"))).when(way == 1, F.concat(F.lit("\ufeffSure! "), props, F.lit(" Done.")))
    text = text.when(way == 2, F.regexp_replace(props, r"\}$", " , }")).when(way == 3, F.translate(props, '"', "”")).when(way == 4, F.regexp_replace(props, r"\}$", "")).otherwise(props)
    return _t(spark, sf_dir, "events").select("event_id", F.get_json_object(T.tolerant_json(text), "$.k").cast("long").alias("k"))


ASKED = (("q1", "license"), ("q1", "released"), ("q1", "mit"), ("q2", "the"), ("q2", "and"), ("q2", "license"))
ANSWERS = (("q1", 1, "same_claim"), ("q1", 3, "related"), ("q1", 3, "same_claim"), ("q1", 99, "related"), ("q1", 2, "unsure"), ("q3", 1, "related"))


def fact_check_lookup(spark, sf_dir):
    """Documents found for a question that the judge's answers keep; what was not retrieved never comes in."""
    scored = retrieval.bm25(_t(spark, sf_dir, "documents"), "doc_id", "text", spark.createDataFrame(list(ASKED), "query string, term string"), least_score=0.1)
    top = retrieval.top_by(scored, ["query"], [F.col("score").desc(), F.col("id")], 6)
    return retrieval.judged(top, spark.createDataFrame(list(ANSWERS), "query string, n int, relation string"), ("same_claim", "related")).select("query", "id", "score", "relation", F.col("rank").cast("long").alias("rank"))


def similar_articles(spark, sf_dir):
    """Turns of each conversation against its first one: the 25 most alike, and whether the same role speaks."""
    turns = _t(spark, sf_dir, "conversations")
    first = turns.groupBy("conv_id").agg(F.min_by(F.struct("role", "text"), "turn").alias("f")).select("conv_id", F.col("f.role").alias("ref_host"), T.tokens(F.col("f.text"), 3).alias("ref"))
    items = turns.where("turn > 0").select("conv_id", F.concat(F.lit("Turn/"), F.col("turn").cast("string")).alias("link"), F.col("role").alias("host"), "text")
    return gates.similar(items, first, T.tokens(F.col("text"), 3), 0.08, 25, "conv_id").select("conv_id", "link", "similarity", "same_host", F.col("rank").cast("long").alias("rank"))


_WORDS = "list_distinct(list_filter(string_split_regex(lower({0}), '[^a-z0-9À-ɏঀ-৿]+'), lambda x: length(x) >= 3))"

QUERIES = {
    "row_selection": (
        row_selection,
        f"""
        WITH o AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 6 = 5 THEN c_custkey || ' মন্ত্রণালয়' ELSE [{", ".join(f"'{x}'" for x in OFFICES)}][CAST(c_custkey % 6 AS INTEGER) + 1] || c_custkey END AS o FROM customer),
        d AS (SELECT *, CASE WHEN k % 12 = 3 THEN o ELSE 'X' END AS d, ['complete', 'sparse', 'failed', 'page_blank', NULL][CAST(k % 5 AS INTEGER) + 1] AS s, CASE WHEN k % 7 = 0 THEN k * 10 END AS r FROM o),
        h AS (SELECT *, regexp_replace(lower(o || ' ' || d), '[ :\\-]+', '', 'g') AS h FROM d)
        SELECT k AS c_custkey, CASE WHEN contains(o, 'জেলা প্রশাসক') THEN 4 WHEN o = d OR ends_with(o, 'মন্ত্রণালয়') THEN 1 WHEN regexp_matches(o, 'অধিদপ্তর|দপ্তর|কার্যালয়') THEN 2 ELSE 3 END AS tier,
               CASE WHEN contains(h, 'section1') OR contains(h, 'দপ্তর7') THEN 'exempt' WHEN contains(h, 'কার্যালয়1') THEN 'manual_review' ELSE '' END AS exemption,
               s IS NULL OR (NOT coalesce(r > 5000, false) AND s = 'failed') AS due, s IS NULL OR s <> 'complete' AS due_again
        FROM h
        """,
    ),
    "entity_gates": (
        entity_gates,
        f"SELECT p_partkey, [{', '.join(str(x).lower() for x in (True, True, True, True, True, True, True, True, False, False, True, True))}][CAST(p_partkey % 12 AS INTEGER) + 1] AS invalid, p_partkey % 5 <> 4 AS fact_check FROM part",
    ),
    "grounded_values": (grounded_values, "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_custkey % 3 <> 0 WHEN 3 THEN false ELSE true END AS grounded FROM customer"),
    "extraction_quality": (
        extraction_quality,
        """
        WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-zà-ÿ]+'), lambda x: x <> '') AS w, text, source FROM documents),
        f AS (SELECT doc_id, text, source, len(w) AS n, CASE WHEN len(w) > 0 THEN round(len(list_distinct(w)) / len(w), 4) ELSE 0.0 END AS r, length(regexp_replace(text, '[^.!?]', '', 'g')) AS s, length(regexp_replace(text, '[^|]', '', 'g')) AS v FROM w)
        SELECT doc_id, (s < 3 AND v >= 5) OR (n >= 30 AND r < 0.35) OR v * 10 > n OR length(text) < 200 OR regexp_matches(lower(source || ' ' || left(text, 2000)), 'access denied|enable javascript|verify you are human|captcha|checking your browser|subscribe to continue|403 forbidden|too many requests') AS low_quality FROM f
        """,
    ),
    "request_paths": (request_paths, "SELECT lower('/api/' || event_type || '/' || user_id % 7) AS path, count(*) AS n FROM events WHERE event_id % 4 <> 0 GROUP BY 1 ORDER BY n DESC, path LIMIT 15"),
    "cache_metrics": (cache_metrics, "SELECT event_type AS cache, count(*) AS entries, min(ts) AS oldest, max(ts) AS newest FROM events GROUP BY 1"),
    "relevance_score": (
        relevance_score,
        """
        WITH f AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS o, count(*) FILTER (l_quantity > 25) AS m, count(*) FILTER (l_linestatus = 'F') AS l, count(*) FILTER (l_returnflag = 'A') AS p, round(avg(l_discount) * 10, 2) AS c FROM lineitem GROUP BY 1)
        SELECT l_orderkey, CAST(least(100, floor(c * 30 + CASE WHEN o > 0 THEN 15 ELSE 0 END + least(25, 5 * m) + CASE WHEN l > 0 THEN 20 ELSE 0 END + CASE WHEN p > 0 THEN 10 ELSE 0 END + 0.5::DOUBLE)) AS INTEGER) AS score FROM f
        """,
    ),
    "evidence_compare": (
        evidence_compare,
        r"""
        WITH c AS (SELECT doc_id, trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g')) AS a FROM documents),
        w AS (SELECT *, list_distinct(list_filter(string_split(lower(a), ' '), lambda x: length(x) > 1)) AS w FROM c)
        SELECT doc_id, CASE WHEN a <> '' AND doc_id % 4 <> 0 THEN doc_id % 4 <> 1 END AS match, CASE WHEN a <> '' AND doc_id % 4 <> 0 THEN sha256(a) END AS a_sha256, CASE WHEN a <> '' AND doc_id % 4 <> 0 THEN doc_id % 4 <> 1 END AS same_digest,
               CASE WHEN a <> '' AND doc_id % 4 <> 0 THEN CASE WHEN len(w) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE END AS overlap FROM w
        """,
    ),
    "tolerant_json": (tolerant_json, "SELECT event_id, CASE WHEN event_id % 6 <> 4 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events"),
    "fact_check_lookup": (
        fact_check_lookup,
        f"""
        WITH q AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in ASKED)}) t(query, term)),
        w AS (SELECT doc_id AS id, list_filter(string_split_regex(lower(text), '[^a-z0-9À-ɏ]+'), lambda x: length(x) > 1) AS w FROM documents),
        st AS (SELECT count(*) AS n, avg(len(w)) AS avg_len FROM w),
        tf AS (SELECT id, len(w) AS l, term, count(*) AS tf FROM (SELECT id, w, unnest(w) AS term FROM w) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
        s AS (SELECT query, id, round(sum(ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * 2.4 / (tf + 1.4 * (0.25 + 0.75 * l / avg_len))), 6) AS score, count(*) AS matched FROM tf JOIN df USING (term) JOIN q USING (term), st GROUP BY 1, 2),
        r AS (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s WHERE matched >= 2 AND score >= 0.1 QUALIFY rank <= 6)
        SELECT query, id, score, CASE rank WHEN 1 THEN 'same_claim' ELSE 'related' END AS relation, rank FROM r WHERE query = 'q1' AND rank IN (1, 3)
        """,
    ),
    "similar_articles": (
        similar_articles,
        f"""
        WITH f AS (SELECT conv_id, arg_min(role, turn) AS role, {_WORDS.format("arg_min(text, turn)")} AS w FROM conversations GROUP BY 1),
        i AS (SELECT c.conv_id, 'turn/' || turn AS link, c.role = f.role AS same_host, {_WORDS.format("c.text")} AS x, f.w FROM conversations c JOIN f USING (conv_id) WHERE turn > 0),
        s AS (SELECT conv_id, link, same_host, round(len(list_intersect(x, w)) / nullif(len(x) + len(w) - len(list_intersect(x, w)), 0), 2) AS similarity FROM i)
        SELECT conv_id, link, similarity, same_host, row_number() OVER (PARTITION BY conv_id ORDER BY similarity DESC, link) AS rank FROM s WHERE similarity > 0.08 QUALIFY rank <= 25
        """,
    ),
}
