"""Queries over texts: normal forms, predicates, scores, retrieval and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar, geo, money
from ..functions import text as T
from ..operators import gates, gazetteer, html, quality, retrieval, windows


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, sf_dir):
    return _t(spark, sf_dir, "documents")


NAV = r"\|"


def text_normalize(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.normalized(F.col("text")).cast("binary")).alias("digest"), F.length(T.normalized(F.col("text"))).cast("long").alias("n"))


def digits_translate(spark, sf_dir):
    text = F.col("text")
    rows = _docs(spark, sf_dir).select("doc_id", F.length(T.digits_only(text)).cast("long").alias("n_digits"), F.md5(T.bengali_digits(text).cast("binary")).alias("bengali_digest"), (T.ascii_digits(T.bengali_digits(text)) == text).alias("round_trip"))
    return rows.where("n_digits > 0")


def phone_normalize(spark, sf_dir):
    raw = F.concat(F.lit("+88 0"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"), F.lit("-"), F.col("c_nationkey").cast("string"))
    return _t(spark, sf_dir, "customer").select("c_custkey", T.phone_key(raw).alias("phone"), T.email_key(F.concat(F.col("c_name"), F.lit(" [at] x [dot] org"))).alias("email"))


def text_fingerprints(spark, sf_dir):
    t = F.col("text").cast("binary")
    return _docs(spark, sf_dir).select("doc_id", F.md5(t).alias("md5"), F.sha2(t, 256).alias("sha256"), F.base64(F.substring(F.col("text"), 1, 12).cast("binary")).alias("token"))


def text_fingerprints_long(spark, sf_dir):
    t = F.col("text").cast("binary")
    return _docs(spark, sf_dir).select("doc_id", F.sha2(t, 512).alias("sha512"), F.lpad(F.lower(F.hex(F.crc32(t))), 8, "0").alias("crc32"))


def boilerplate_filter(spark, sf_dir):
    rows = quality.boilerplate_features(_docs(spark, sf_dir).select("doc_id", "text"), "text", NAV)
    flag = quality.looks_boilerplate(F.col("n_tokens"), F.col("distinct_ratio"), F.col("n_sentences"), F.col("nav_hits"))
    return rows.select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), "distinct_ratio", F.col("n_sentences").cast("long").alias("n_sentences"), F.col("nav_hits").cast("long").alias("nav_hits"), flag.alias("boilerplate"))


def blocked_filter(spark, sf_dir):
    blocked = quality.looks_blocked(F.col("url"), F.col("html"), ("captcha", "track(1", "enable javascript", "/fr/"))
    return _t(spark, sf_dir, "pages").select("page_id", blocked.alias("blocked"))


RULES = (("has_digits", "[0-9]{3}", 30), ("shouting", "[A-Z]{6}", 25), ("symbols", r"[#$%&*]{3}", 20), ("license", "(licensed under|mit license|copyright)", 15), ("contact", "[a-z0-9]@[a-z0-9]", 40))


def rule_risk_score(spark, sf_dir):
    text = F.col("text")
    rules = [(n, (F.lower(text) if n in ("license", "contact") else text).rlike(p), s) for n, p, s in RULES]
    flags, points = quality.rule_score(rules)
    return _docs(spark, sf_dir).select("doc_id", flags.alias("flags"), points.cast("int").alias("score")).withColumn("level", quality.level(F.col("score")))


REGISTRY = [(f"src{i}", 40 + 3 * i) for i in range(0, 12)]


def source_credibility(spark, sf_dir):
    registry = spark.createDataFrame(REGISTRY, "source string, base int")
    text = F.col("text")
    bonus = F.when(text.contains("."), 5).otherwise(0) + F.when(text.rlike("[0-9]"), 5).otherwise(0) + F.least(2 * F.regexp_count(text, F.lit(r"\n")), F.lit(10))
    rows = _docs(spark, sf_dir).join(registry, "source", "left")
    return rows.select("doc_id", F.least(F.lit(100), F.coalesce("base", F.lit(30)) + bonus).cast("int").alias("score"), F.col("base").isNotNull().alias("known"))


def history_stats_keywords(spark, sf_dir):
    words = _docs(spark, sf_dir).select(F.explode_outer(F.split(F.lower("text"), "[^a-z]+")).alias("keyword")).where("length(keyword) >= 4")
    return words.groupBy("keyword").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "keyword").limit(100)


TERMS = ("the", "thation", "mit license", "erinha", "apache license", "le la", "der")


def dictionary_mentions(spark, sf_dir):
    """Word-bounded mentions of each term, counted by regular expression."""
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    return gazetteer.counted(_docs(spark, sf_dir), "doc_id", "text", list(TERMS)).join(terms, "term", "left_semi")


def _dictionary(spark, sf_dir):
    """The terms and the benchmark's passages; the list is bounded, and reading it fails beyond its bound."""
    rows = _t(spark, sf_dir, "benchmark").select(F.lower("text").alias("t")).where("t <> ''").distinct().orderBy("t").limit(gazetteer.MOST + 1).collect()
    return [*TERMS, *(r["t"] for r in rows)]


def dictionary_spans(spark, sf_dir):
    """Leftmost-longest spans of the benchmark's passages and the terms in every document."""
    return gazetteer.spans(_docs(spark, sf_dir), "doc_id", "text", _dictionary(spark, sf_dir))


def location_mentions(spark, sf_dir):
    """Terms of each document by mentions, then by first place."""
    return gazetteer.located(gazetteer.spans(_docs(spark, sf_dir), "doc_id", "text", list(TERMS)))


PHRASES = [("mit license", "licences"), ("la", "romance"), ("der|die", "german"), ("the", "english"), ("copyright", "licences")]


def phrase_priority(spark, sf_dir):
    """Offices whose phrases a document has, and the first rule's."""
    hits, _ = gazetteer.first_phrases(F.col("text"), PHRASES)
    # A filter on the hits would look for them once more; a row comes of each text that has some.
    some = F.explode(T.let(hits, lambda h: F.when(F.size(h) > 0, F.array(h))))
    return _docs(spark, sf_dir).select("doc_id", some.alias("h")).select("doc_id", F.array_join("h", ",").alias("offices"), F.get("h", F.lit(0)).alias("primary"))


NAMES = ("released under a mit license", "licenced under an apache license", "under some license")


def fuzzy_scan(spark, sf_dir):
    """Names a few edits off in the documents, near the word they end with."""
    return gazetteer.fuzzy(_docs(spark, sf_dir), "doc_id", "text", list(NAMES), ("license",))


def keyword_jaccard_top3(spark, sf_dir):
    """The three nearest documents of each, by words of three letters or more, above a similarity of one half."""
    return retrieval.jaccard_neighbours(_docs(spark, sf_dir), "doc_id", T.tokens(F.col("text"), 3), 3).select("a", "b", "sim", F.col("rank").cast("long").alias("rank"))


ASKED = (("q1", "thation"), ("q1", "erinha"), ("q1", "the"), ("q2", "les"), ("q2", "une"), ("q2", "ouai"), ("q3", "license"), ("q3", "released"), ("q3", "mit"))


def bm25_search(spark, sf_dir):
    """The 20 best documents of each question; the first line is a document's title and counts twice."""
    asked = spark.createDataFrame(list(ASKED), "query string, term string")
    scored = retrieval.bm25(_docs(spark, sf_dir), "doc_id", "text", asked, least_score=0.5, title=F.substring_index("text", "\n", 1), terms=T.index_terms)
    return retrieval.top_by(scored, ["query"], [F.col("score").desc(), F.col("id")], 20).select("query", "id", "score", "matched", F.col("rank").cast("long").alias("rank"))


def related_score(spark, sf_dir):
    """Every document and benchmark passage that share three words in a row: title, context, date and number parts of their score.

    They meet on hashes of the three words, so a passage is compared with the documents that quote it only.  Without dates the date part
    is one half.
    """
    d = _docs(spark, sf_dir).select(F.col("doc_id").alias("item"), retrieval.spaced(F.col("text")).alias("words"))
    p = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("article"), retrieval.spaced(F.col("text")).alias("words"))
    meet = retrieval.joined_items(retrieval.meeting(p, d), d)
    rows = meet.select(F.col("item").alias("doc_id"), "article", F.array_distinct("words").alias("a")).join(p.select("article", F.col("article").alias("item_id"), F.array_distinct("words").alias("b")), "article")
    digits = lambda w: F.filter(w, lambda x: x.rlike("[0-9]"))
    rows = rows.select("doc_id", "item_id", F.round(T.jaccard(F.col("a"), F.col("b")), 4).alias("title"), F.round(T.overlap(F.col("a"), F.col("b")), 4).alias("context"), F.round(T.jaccard(digits(F.col("a")), digits(F.col("b"))), 4).alias("numbers"))
    score = F.round(retrieval.related_score(F.col("title"), F.col("context"), calendar.date_score(F.lit(None).cast("double")), F.col("numbers")), 4)
    return rows.withColumn("score", score).withColumn("level", quality.level(F.col("score") * 100, 50, 25))


def related_news(spark, sf_dir):
    """For each benchmark passage the documents that tell its story and those related to it.

    The first line is the title, the rest what follows it; a text is dated by the event of its number, so some have no date.
    """
    dates = _t(spark, sf_dir, "events").groupBy(F.col("event_id").alias("key")).agg(F.min("ts").alias("published"))
    title = F.substring_index("text", "\n", 1)
    rest = F.substring(F.col("text"), F.length(title) + 2, F.length("text"))
    articles = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("article"), title.alias("title"), rest.alias("summary"), F.concat(F.lit("src"), (F.col("item_id") % 12).cast("string")).alias("source"))
    items = _docs(spark, sf_dir).select(F.col("doc_id").alias("item"), title.alias("title"), rest.alias("snippet"), "source", gates.is_fact_check(F.col("source"), F.lit(""), title).alias("fact_check"))
    return retrieval.related_news(_dated_by(articles, "article", dates), _dated_by(items, "item", dates))


def _dated_by(rows, key, dates):
    return rows.join(dates.withColumnRenamed("key", key), key, "left")


def minmax_rank_fusion(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 200).alias("article"), F.col("l_returnflag").alias("provider"), F.col("l_partkey").alias("item"), F.col("l_extendedprice").alias("score"))
    rows = rows.groupBy("article", "provider", "item").agg(F.max("score").alias("score"))
    out = retrieval.fused(rows, "article", "provider", "item", "score")
    return out.where("rank <= 5").select("article", "item", "fused", "providers", F.col("rank").cast("long").alias("rank"))


def greedy_budget_selection(spark, sf_dir):
    """Sentences of each document, longest first, within 30 % of its characters."""
    rows = _docs(spark, sf_dir).select("doc_id", F.sort_array(F.transform(T.sentences(F.col("text")), lambda s, i: F.struct(F.length(s).cast("long").alias("size"), i.alias("id"))), asc=False).alias("items"), F.floor(F.length("text") * 0.3).alias("budget"))
    taken = retrieval.within_budget(F.col("items"), F.col("budget"))
    rows = rows.withColumn("taken", taken)
    return rows.select("doc_id", F.sort_array(F.transform("taken", lambda x: x["id"])).alias("ids"), F.aggregate("taken", F.lit(0).cast("long"), lambda a, x: a + x["size"]).alias("used"), "budget")


def money_mentions(spark, sf_dir):
    text = F.concat(F.lit("paid "), F.col("o_totalprice").cast("decimal(12,2)").cast("string"), F.lit(" lakh and "), (F.col("o_orderkey") % 7).cast("string"), F.lit(" crore"))
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", money.amounts(text).alias("m"))
    return rows.select("o_orderkey", F.size("m").cast("long").alias("n"), F.round(F.array_max("m"), 2).alias("most"))


def _dated(day):
    """A text with a day written in four ways, once in capitals, and words for other days."""
    english = F.date_format(day, "d MMMM yyyy")
    return F.concat(F.lit("Filed on "), english, F.lit(", heard "), F.date_format(day, "yyyy-MM-dd"), F.lit(" and "), F.upper(english), F.lit("; see "), F.date_format(day, "MMMM d, yyyy"), F.lit(", not 12345-01-011. গত সপ্তাহ"))


def timeline_mentions(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", _dated(F.col("o_orderdate")).alias("text")).withColumn("d", calendar.written_dates(F.col("text")))
    rows = rows.select("o_orderkey", "d", calendar.events_of(F.col("text"), F.col("d")).alias("e"))
    return rows.select("o_orderkey", F.array_join("d", "|").alias("dates"), F.get("e", F.lit(1))["event"].alias("second_event"))


def last_updated(spark, sf_dir):
    """The date on a page's label, in four ways of writing, one of them impossible."""
    way, day = F.col("o_orderkey") % 5, F.col("o_orderdate")
    said = F.when(way == 0, F.date_format(day, "d-M-yyyy")).when(way == 1, F.date_format(day, "yyyy/MM/dd")).when(way == 2, F.concat(F.lit("Monday, "), F.date_format(day, "d MMMM, yyyy"))).when(way == 3, F.lit("31.02.2020")).otherwise(F.lit("never"))
    on = calendar.updated_on(F.concat(F.lit("Home\nLast  Updated on: "), said, F.lit(" at 15:39\nmore")))
    return _t(spark, sf_dir, "orders").select("o_orderkey", on.alias("updated"), calendar.is_stale(on, F.lit("1998-06-01").cast("date")).alias("stale"))


def currency_mentions(spark, sf_dir):
    """Amounts that are money: with a currency in or after them, the longest of those within one another."""
    key = F.col("o_orderkey").cast("string")
    text = F.concat(F.lit("They paid "), key, F.lit(" crore taka, then Tk 1,"), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0"), F.lit(" and 7 million people saw 3 lakh 500 taka; 2 billion USD"))
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")).withColumn("m", money.mentions(F.col("text")))
    rows = rows.select("o_orderkey", "m", money.with_currency(F.col("text"), F.col("m")).alias("w"))
    return rows.select("o_orderkey", F.size("m").cast("long").alias("n"), F.array_max(F.transform("m", lambda x: x["value"])).cast("long").alias("most"), F.array_join("w", "|").alias("money"))


def unicode_normalize(spark, sf_dir):
    """Normal form, with letters and accents apart in every third document."""
    text = F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit("é"), F.lit("e\u0301"))).otherwise(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.normalized(text, "NFC").cast("binary")).alias("digest"))


def working_day_deadline(spark, sf_dir):
    day = F.to_date("o_orderdate")
    return _t(spark, sf_dir, "orders").select("o_orderkey", calendar.add_working_days(day, 20).alias("answer_by"), calendar.add_working_days(day, 30).alias("third_party_by"), calendar.add_working_days(day, 3).alias("soon"), F.date_add(day, 30).alias("appeal_by"))


def relationship_label(spark, sf_dir):
    days, sim = F.datediff(F.to_date("o_orderdate"), F.lit("1998-01-01").cast("date")), (F.col("o_orderkey") % 100) / 100.0
    rows = _t(spark, sf_dir, "orders").select(calendar.relationship(days, sim).alias("label"))
    return rows.groupBy("label").agg(F.count("*").alias("n"))


def haversine_jump(spark, sf_dir):
    """Fixes of a user that lie over a kilometre from the one before, within an hour."""
    e = _t(spark, sf_dir, "events").select("user_id", "event_id", "ts", (23.7 + (F.col("event_id") % 50) / 1000.0).alias("lat"), (90.4 + (F.col("event_id") % 70) / 1000.0).alias("lng"))
    return windows.jumps(e, "user_id", "ts", "event_id", 3600, 1000.0)


def geo_readings(spark, sf_dir):
    lat, lng = (F.col("c_custkey") % 120 - 60).cast("double") + 0.25, (F.col("c_custkey") % 300 - 150).cast("double") + 0.5
    brg = geo.bearing(F.lit(23.81), F.lit(90.41), lat, lng)
    return _t(spark, sf_dir, "customer").select("c_custkey", F.round(geo.haversine_m(F.lit(23.81), F.lit(90.41), lat, lng) / 1000, 3).alias("km"), F.round(brg, 4).alias("degrees"), geo.compass(brg).alias("point"), geo.accuracy_class((F.col("c_custkey") % 700).cast("double")).alias("accuracy"), geo.valid_fix(lat, lng, (F.col("c_custkey") % 60).cast("double")).alias("valid"))


def page_extract(spark, sf_dir):
    return html.articles(_t(spark, sf_dir, "pages"), "page_id", "url", "html")


def page_links(spark, sf_dir):
    return html.links(_t(spark, sf_dir, "pages"), "page_id", "url", "html")


def conversation_timeline(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations")
    return rows.groupBy("conv_id").agg(F.count("*").alias("turns"), F.min_by("role", "turn").alias("first_role"), F.max_by("role", "turn").alias("last_role"), F.sum(F.length("text")).cast("long").alias("chars"))


def search_substring(spark, sf_dir):
    hit = F.contains(F.lower(F.concat_ws(" ", F.col("source"), F.col("lang"), F.col("text"))), F.lit("mit license"))
    return _docs(spark, sf_dir).where(hit).select("doc_id", "source").orderBy(F.col("doc_id").desc()).limit(20)


def rollup_cube_coverage(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.grouping_id().cast("long").alias("level"))


def _count(term):
    return f"len(regexp_extract_all(lower(text), '(^|[^a-z0-9à-ÿ])({term})($|[^a-z0-9à-ÿ])'))"


_RISK = " || ".join(f"CASE WHEN regexp_matches({'lower(text)' if n in ('license', 'contact') else 'text'}, '{p}') THEN ',{n}' ELSE '' END" for n, p, _ in RULES)
_POINTS = " + ".join(f"CASE WHEN regexp_matches({'lower(text)' if n in ('license', 'contact') else 'text'}, '{p}') THEN {s} ELSE 0 END" for n, p, s in RULES)
_NORM = r"lower(trim(regexp_replace(text, '\s+', ' ', 'g')))"
_WD = "(SELECT list(x ORDER BY x)[{n}] FROM (SELECT unnest(range(d + INTERVAL 1 DAY, d + INTERVAL 61 DAY, INTERVAL 1 DAY)) AS x) WHERE dayofweek(x) NOT IN (5, 6))"

def _set(text):
    return f"list_distinct(list_filter(string_split_regex(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+'), lambda x: length(x) > 1))"


def _numbers(text):
    found = f"regexp_extract_all(translate({text}, '{T.BENGALI_DIGITS}', '{T.ASCII_DIGITS}'), '[0-9][0-9,.]*')"
    return f"list_distinct(list_filter(list_transform({found}, lambda x: regexp_replace(x, '[,.]$', '')), lambda x: length(x) >= 2))"


def _spaced(text):
    return f"list_filter(string_split_regex(lower({text}), '[ \\n]+'), lambda x: x <> '')"


def _two(x):
    return f"floor(({x}) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE"


_CHECKS = " OR ".join([f"contains(lower(source), '{n}')" for n in gates.CHECKERS] + [f"regexp_matches(lower(title), '{gates.CORRECTION}')"])

QUERIES = {
    "text_normalize": (text_normalize, f"SELECT doc_id, md5({_NORM}) AS digest, length({_NORM}) AS n FROM documents"),
    "digits_translate": (
        digits_translate,
        "SELECT doc_id, length(regexp_replace(text, '[^0-9]', '', 'g')) AS n_digits, md5(translate(text, '0123456789', '০১২৩৪৫৬৭৮৯')) AS bengali_digest, true AS round_trip FROM documents WHERE regexp_matches(text, '[0-9]')",
    ),
    "phone_normalize": (
        phone_normalize,
        "SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 9, '0') || c_nationkey AS phone, lower(c_name) || '@x.org' AS email FROM customer",
    ),
    "text_fingerprints": (text_fingerprints, "SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256, to_base64(encode(left(text, 12))) AS token FROM documents"),
    "text_fingerprints_long": (text_fingerprints_long, None),
    "boilerplate_filter": (
        boilerplate_filter,
        """
        WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-zà-ÿ]+'), lambda x: x <> '') AS w, text FROM documents),
        f AS (SELECT doc_id, len(w) AS n_tokens, CASE WHEN len(w) > 0 THEN round(len(list_distinct(w)) / len(w), 4) ELSE 0.0 END AS distinct_ratio, length(regexp_replace(text, '[^.!?]', '', 'g')) AS n_sentences, length(regexp_replace(text, '[^|]', '', 'g')) AS nav_hits FROM w)
        SELECT *, (n_sentences < 3 AND nav_hits >= 5) OR (n_tokens >= 30 AND distinct_ratio < 0.35) OR nav_hits * 10 > n_tokens AS boilerplate FROM f
        """,
    ),
    "blocked_filter": (
        blocked_filter,
        "WITH h AS (SELECT page_id, lower(url || ' ' || left(html, 2000)) AS h FROM pages) SELECT page_id, contains(h, 'captcha') OR contains(h, 'track(1') OR contains(h, 'enable javascript') OR contains(h, '/fr/') AS blocked FROM h",
    ),
    "rule_risk_score": (
        rule_risk_score,
        f"WITH r AS (SELECT doc_id, ltrim({_RISK}, ',') AS flags, CAST(least(100, {_POINTS}) AS INTEGER) AS score FROM documents) SELECT *, CASE WHEN score >= 60 THEN 'high' WHEN score >= 30 THEN 'medium' ELSE 'low' END AS level FROM r",
    ),
    "source_credibility": (
        source_credibility,
        f"""
        WITH g AS (SELECT * FROM (VALUES {", ".join(f"('{s}', {b})" for s, b in REGISTRY)}) t(source, base))
        SELECT doc_id, CAST(least(100, coalesce(base, 30) + CASE WHEN contains(text, '.') THEN 5 ELSE 0 END + CASE WHEN regexp_matches(text, '[0-9]') THEN 5 ELSE 0 END + least(10, 2 * (length(text) - length(replace(text, chr(10), ''))))) AS INTEGER) AS score, base IS NOT NULL AS known
        FROM documents LEFT JOIN g USING (source)
        """,
    ),
    "history_stats_keywords": (
        history_stats_keywords,
        "SELECT keyword, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS keyword FROM documents) WHERE length(keyword) >= 4 GROUP BY 1 ORDER BY n DESC, keyword LIMIT 100",
    ),
    "dictionary_mentions": (
        dictionary_mentions,
        " UNION ALL ".join(f"SELECT * FROM (SELECT doc_id, '{t}' AS term, CAST(len(regexp_extract_all(regexp_replace(lower(text), '([^a-z0-9à-ÿ])', '\\1\\1', 'g'), '(^|[^a-z0-9à-ÿ]){t.replace(' ', '  ')}($|[^a-z0-9à-ÿ])')) AS BIGINT) AS n FROM documents) WHERE n > 0" for t in TERMS),
    ),
    "location_mentions": (location_mentions, None),
    "fuzzy_scan": (fuzzy_scan, None),
    "phrase_priority": (
        phrase_priority,
        "WITH h AS (SELECT doc_id, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9à-ÿ])({p})([^a-z0-9à-ÿ]|$)') THEN '{o}' END" for p, o in PHRASES) + "], lambda x: x IS NOT NULL) AS h FROM documents) SELECT doc_id, array_to_string(h, ',') AS offices, h[1] AS \"primary\" FROM h WHERE len(h) > 0",
    ),
    "dictionary_spans": (dictionary_spans, None),
    "keyword_jaccard_top3": (
        keyword_jaccard_top3,
        """
        WITH s AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9À-ɏঀ-৿]+'), lambda x: length(x) >= 3)) AS s FROM documents),
        w AS (SELECT doc_id, len(s) AS n, unnest(s) AS w FROM s),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i, any_value(x.n) + any_value(y.n) AS t FROM w x JOIN w y ON x.w = y.w AND x.doc_id <> y.doc_id AND x.n >= 0.5 * y.n AND y.n >= 0.5 * x.n GROUP BY 1, 2),
        j AS (SELECT a, b, i / (t - i) AS sim FROM p WHERE i / (t - i) > 0.5)
        SELECT a, b, round(sim, 4) AS sim, row_number() OVER (PARTITION BY a ORDER BY round(sim, 4) DESC, b) AS rank FROM j QUALIFY rank <= 3
        """,
    ),
    "bm25_search": (
        bm25_search,
        f"""
        WITH q AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in ASKED)}) t(query, term)),
        s AS (SELECT doc_id AS id, string_split_regex(lower(text || chr(10) || string_split(text, chr(10))[1]), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+') AS s FROM documents),
        w AS (SELECT id, list_filter(list_transform(s, lambda x: CASE WHEN length(x) > 3 THEN regexp_replace(x, '{T.ENDING}', '\\1') ELSE x END), lambda x: length(x) > 1 AND x NOT IN {T.NO_TERMS} AND NOT regexp_matches(x, '^[0-9]+$')) AS w FROM s),
        st AS (SELECT count(*) AS n, avg(len(w)) AS avg_len FROM w),
        tf AS (SELECT id, len(w) AS l, term, count(*) AS tf FROM (SELECT id, w, unnest(w) AS term FROM w) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
        f AS (SELECT query, id, round(sum(ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * 2.4 / (tf + 1.4 * (0.25 + 0.75 * l / avg_len))), 6) AS score, count(*) AS matched FROM tf JOIN df USING (term) JOIN q USING (term), st GROUP BY 1, 2)
        SELECT query, id, score, matched, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM f WHERE matched >= 2 AND score >= 0.5 QUALIFY rank <= 20
        """,
    ),
    "related_score": (
        related_score,
        """
        WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \\n]+'), lambda x: x <> '') AS w FROM documents),
        p AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[ \\n]+'), lambda x: x <> '') AS w FROM benchmark),
        dk AS (SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
        pk AS (SELECT DISTINCT item_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT item_id, w, unnest(range(1, len(w) - 1)) AS i FROM p)),
        m AS (SELECT DISTINCT doc_id, item_id FROM dk JOIN pk USING (k)),
        s AS (SELECT doc_id, item_id, list_distinct(d.w) AS a, list_distinct(p.w) AS b FROM m JOIN d USING (doc_id) JOIN p USING (item_id)),
        i AS (SELECT *, len(list_intersect(a, b)) AS i, list_filter(a, lambda x: regexp_matches(x, '[0-9]')) AS x, list_filter(b, lambda x: regexp_matches(x, '[0-9]')) AS y FROM s),
        r AS (SELECT doc_id, item_id, round(i / (len(a) + len(b) - i), 4) AS title, round(i / least(len(a), len(b)), 4) AS context, coalesce(round(len(list_intersect(x, y)) / nullif(len(x) + len(y) - len(list_intersect(x, y)), 0), 4), 0.0)::DOUBLE AS numbers FROM i),
        t AS (SELECT *, round(0.4::DOUBLE * title + 0.2::DOUBLE * context + 0.2::DOUBLE * 0.5 + 0.2::DOUBLE * numbers, 4) AS score FROM r)
        SELECT *, CASE WHEN score * 100 >= 50 THEN 'high' WHEN score * 100 >= 25 THEN 'medium' ELSE 'low' END AS level FROM t
        """,
    ),
    "related_news": (
        related_news,
        f"""
        WITH e AS (SELECT event_id, min(ts) AS ts FROM events GROUP BY 1),
        d AS (SELECT doc_id AS item, string_split(text, chr(10))[1] AS title, substr(text, length(string_split(text, chr(10))[1]) + 2) AS snippet, source, ts FROM documents LEFT JOIN e ON event_id = doc_id),
        p AS (SELECT item_id AS article, string_split(text, chr(10))[1] AS title, substr(text, length(string_split(text, chr(10))[1]) + 2) AS summary, 'src' || item_id % 12 AS source, ts FROM benchmark LEFT JOIN e ON event_id = item_id),
        dw AS (SELECT item, {_spaced("title || ' ' || snippet")} AS w FROM d),
        pw AS (SELECT article, {_spaced("title || ' ' || summary")} AS w FROM p),
        dk AS (SELECT DISTINCT item, (w[i], w[i + 1], w[i + 2]) AS k FROM (SELECT item, w, unnest(range(1, len(w) - 1)) AS i FROM dw)),
        pk AS (SELECT DISTINCT article, (w[i], w[i + 1], w[i + 2]) AS k FROM (SELECT article, w, unnest(range(1, len(w) - 1)) AS i FROM pw)),
        m AS (SELECT DISTINCT article, item FROM dk JOIN pk USING (k)),
        ds AS (SELECT item, source, title, ts, ({_CHECKS}) AS checks, {_set("title")} AS t, {_set("title || ' ' || snippet")} AS c, {_numbers("title || ' ' || snippet")} AS n FROM d WHERE item IN (SELECT item FROM m)),
        ps AS (SELECT article, source AS own, ts AS day, {_set("title")} AS pt, {_set("summary")} AS pc, {_numbers("title || ' ' || summary")} AS pn FROM p),
        x AS (SELECT article, item, title AS name, checks,
                CASE WHEN len(t) > 0 AND len(pt) > 0 THEN len(list_intersect(t, pt))::DOUBLE / greatest(len(t), len(pt)) ELSE 0.0::DOUBLE END AS title,
                CASE WHEN len(c) > 0 AND len(pc) > 0 THEN len(list_intersect(c, pc))::DOUBLE / least(len(c), len(pc)) ELSE 0.0::DOUBLE END AS context,
                abs(epoch_us(ts) - epoch_us(day)) / 86400000000.0::DOUBLE AS days,
                CASE WHEN len(pn) > 0 THEN least(1.0::DOUBLE, len(list_intersect(n, pn))::DOUBLE / least(len(pn), 3)) ELSE 0.0::DOUBLE END AS numbers
              FROM m JOIN ds USING (item) JOIN ps USING (article) WHERE lower(source) <> own),
        y AS (SELECT article, item, lower(name) AS name, checks, {_two("title")} AS title, {_two("context")} AS context, {_two("numbers")} AS numbers,
                {_two("CASE WHEN days IS NULL THEN 0.5::DOUBLE WHEN days <= 1.5::DOUBLE THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - (days - 1.5::DOUBLE) / 6.0::DOUBLE) END")} AS date FROM x),
        z AS (SELECT *, {_two("0.4::DOUBLE * title + 0.2::DOUBLE * context + 0.2::DOUBLE * date + 0.2::DOUBLE * numbers")} AS score FROM y),
        u AS (SELECT *, NOT checks AND score >= 0.5 AND (title >= 0.35 OR numbers >= 0.6) AS same FROM z QUALIFY row_number() OVER (PARTITION BY article, name ORDER BY score DESC, item) = 1),
        r AS (SELECT *, CASE WHEN same AND row_number() OVER (PARTITION BY article, same ORDER BY score DESC, item) <= 8 THEN 'same_story' ELSE 'related' END AS kind FROM u)
        SELECT article, item, kind, row_number() OVER (PARTITION BY article, kind ORDER BY score DESC, item) AS rank, title, context, date, numbers, score FROM r QUALIFY rank <= 8
        """,
    ),
    "minmax_rank_fusion": (
        minmax_rank_fusion,
        """
        WITH r AS (SELECT l_orderkey % 200 AS article, l_returnflag AS provider, l_partkey AS item, max(l_extendedprice) AS score FROM lineitem GROUP BY 1, 2, 3),
        n AS (SELECT article, item, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0.5 END AS norm FROM r WINDOW w AS (PARTITION BY article, provider)),
        f AS (SELECT article, item, round(avg(norm), 6) AS fused, count(*) AS providers FROM n GROUP BY 1, 2)
        SELECT *, row_number() OVER (PARTITION BY article ORDER BY fused DESC, item) AS rank FROM f QUALIFY rank <= 5
        """,
    ),
    "greedy_budget_selection": (greedy_budget_selection, None),
    "money_mentions": (
        money_mentions,
        "SELECT o_orderkey, CAST(2 AS BIGINT) AS n, round(greatest(CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DOUBLE) * 100000.0::DOUBLE, (o_orderkey % 7) * 10000000.0::DOUBLE), 2) AS most FROM orders",
    ),
    "timeline_mentions": (
        timeline_mentions,
        """
        WITH d AS (SELECT o_orderkey, strftime(o_orderdate, '%-d %B %Y') AS e, strftime(o_orderdate, '%Y-%m-%d') AS i, strftime(o_orderdate, '%B %-d, %Y') AS m FROM orders),
        t AS (SELECT *, 'Filed on ' || e || ', heard ' || i || ' and ' || upper(e) || '; see ' || m || ', not 12345-01-011. গত সপ্তাহ' AS t FROM d)
        SELECT o_orderkey, e || '|' || m || '|' || i || '|গত সপ্তাহ' AS dates, trim(substr(t, greatest(1, instr(t, m) - 10), instr(t, m) - greatest(1, instr(t, m) - 10) + length(m) + 100)) AS second_event FROM t
        """,
    ),
    "last_updated": (
        last_updated,
        """
        WITH d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <= 2 THEN CAST(o_orderdate AS DATE) END AS updated FROM orders)
        SELECT o_orderkey, updated, coalesce(datediff('day', updated, DATE '1998-06-01') > 365, false) AS stale FROM d
        """,
    ),
    "currency_mentions": (
        currency_mentions,
        """
        SELECT o_orderkey, CAST(5 AS BIGINT) AS n, greatest(o_orderkey * 10000000, 2000000000) AS most,
               o_orderkey || ' crore taka|3 lakh 500 taka|2 billion USD|Tk 1,' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') AS money FROM orders
        """,
    ),
    "unicode_normalize": (unicode_normalize, r"SELECT doc_id, md5(lower(trim(regexp_replace(regexp_replace(nfc_normalize(text), '[\x{200B}\x{200C}\x{200D}\x{FEFF}]', '', 'g'), '\s+', ' ', 'g')))) AS digest FROM documents"),
    "working_day_deadline": (
        working_day_deadline,
        f"""
        WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders),
        w AS (SELECT d, CAST({_WD.format(n=20)} AS DATE) AS a, CAST({_WD.format(n=30)} AS DATE) AS t, CAST({_WD.format(n=3)} AS DATE) AS s FROM d)
        SELECT o_orderkey, a AS answer_by, t AS third_party_by, s AS soon, CAST(d + INTERVAL 30 DAY AS DATE) AS appeal_by FROM orders JOIN w ON d = CAST(o_orderdate AS DATE)
        """,
    ),
    "relationship_label": (
        relationship_label,
        """
        WITH r AS (SELECT datediff('day', DATE '1998-01-01', CAST(o_orderdate AS DATE)) AS days, (o_orderkey % 100) / 100.0::DOUBLE AS sim FROM orders)
        SELECT CASE WHEN days IS NULL THEN 'unknown' WHEN days < -14 AND sim >= 0.35 THEN 'background' WHEN days > 3 AND sim >= 0.35 THEN 'follow_up' WHEN sim >= 0.6 THEN 'same_event' WHEN sim >= 0.35 THEN 'related' ELSE 'context' END AS label, count(*) AS n
        FROM r GROUP BY 1
        """,
    ),
    "haversine_jump": (
        haversine_jump,
        """
        WITH e AS (SELECT user_id, event_id, ts, 23.7::DOUBLE + (event_id % 50) / 1000.0::DOUBLE AS lat, 90.4::DOUBLE + (event_id % 70) / 1000.0::DOUBLE AS lng FROM events),
        p AS (SELECT *, lag(lat) OVER w AS plat, lag(lng) OVER w AS plng, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS us FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        h AS (SELECT *, pow(sin(radians(lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lng - plng) / 2), 2) AS a FROM p),
        m AS (SELECT user_id AS key, event_id AS id, round(2 * 6371000.0 * atan2(sqrt(a), sqrt(1 - a)), 1) AS metres, us FROM h)
        SELECT key, id, metres, round(us / 1000000.0, 3) AS seconds FROM m WHERE us > 0 AND us < 3600000000 AND metres > 1000
        """,
    ),
    "geo_readings": (
        geo_readings,
        f"""
        WITH c AS (SELECT c_custkey, (c_custkey % 120 - 60) + 0.25::DOUBLE AS lat, (c_custkey % 300 - 150) + 0.5::DOUBLE AS lng FROM customer),
        h AS (SELECT *, pow(sin(radians(lat - 23.81) / 2), 2) + cos(radians(23.81)) * cos(radians(lat)) * pow(sin(radians(lng - 90.41) / 2), 2) AS a,
              fmod(degrees(atan2(sin(radians(lng - 90.41)) * cos(radians(lat)), cos(radians(23.81)) * sin(radians(lat)) - sin(radians(23.81)) * cos(radians(lat)) * cos(radians(lng - 90.41)))) + 360.0, 360.0) AS b FROM c)
        SELECT c_custkey, round(2 * 6371.0 * atan2(sqrt(a), sqrt(1 - a)), 3) AS km, round(b, 4) AS degrees, ({list(geo.COMPASS)})[CAST(floor(b / 22.5 + 0.5) AS INTEGER) % 16 + 1] AS point,
               CASE WHEN c_custkey % 700 <= 0 THEN 'unknown' WHEN c_custkey % 700 <= 20 THEN 'excellent' WHEN c_custkey % 700 <= 50 THEN 'good' WHEN c_custkey % 700 <= 100 THEN 'fair' WHEN c_custkey % 700 <= 500 THEN 'poor' ELSE 'unreliable' END AS accuracy,
               c_custkey % 60 > 0 AND c_custkey % 60 <= 30 AS valid FROM h
        """,
    ),
    "page_extract": (page_extract, None),
    "page_links": (page_links, None),
    "conversation_timeline": (conversation_timeline, "SELECT conv_id, count(*) AS turns, arg_min(role, turn) AS first_role, arg_max(role, turn) AS last_role, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1"),
    "search_substring": (search_substring, "SELECT doc_id, source FROM documents WHERE contains(lower(source || ' ' || lang || ' ' || text), 'mit license') ORDER BY doc_id DESC LIMIT 20"),
    "rollup_cube_coverage": (
        rollup_cube_coverage,
        "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    ),
}
