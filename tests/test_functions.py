import datetime
import math

from pyspark.sql import functions as F

from tessera.functions import calendar, geo, money
from tessera.functions import text as T
from tessera.operators import gazetteer, html, linkage, reconcile, retrieval


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def test_text(spark):
    a = F.col("a")
    assert one(spark, T.normalized(a), a="  Foo​\n BAR ") == "foo bar"
    assert one(spark, T.ascii_digits(a), a="০১২x৯") == "012x9"
    assert one(spark, T.phone_key(a), a="+88 01711-২২") == "171122"
    assert one(spark, T.email_key(a), a="A.b [at] x [dot] org") == "a.b@x.org"
    assert one(spark, T.has_name(a), a=" N/A ") is False
    assert one(spark, T.host(a), a="https://www.X.org:80/a?b") == "x.org"
    assert one(spark, T.unicode_form(a, "NFKC"), a="ﬁ") == "fi"
    assert one(spark, T.grapheme_count(a), a="কি") == 1
    assert one(spark, T.collapsed_lines(a), a=" a  b\r\n\r\n c ") == "a b\nc"
    assert one(spark, T.sentences(a), a="This is a first sentence here. Second one is also long enough! No.") == ["This is a first sentence here.", "Second one is also long enough!"]
    assert one(spark, T.place_similarity(a, F.col("b")), a="abcd", b="abxd") == 75
    assert one(spark, T.header_name(a), a=" Officer  Name (1) ") == "officer_name_1"


def test_calendar(spark):
    day = F.lit(datetime.date(2024, 2, 28))  # a Wednesday
    for n in range(1, 40):
        got, want, left = one(spark, calendar.add_working_days(day, n), a=1), datetime.date(2024, 2, 28), n
        while left:
            want += datetime.timedelta(1)
            left -= want.weekday() not in (4, 5)
        assert got == want, n


def test_geo(spark):
    assert abs(one(spark, geo.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)), a=1) - 6371000 * math.pi / 180) < 1e-3
    assert one(spark, geo.compass(F.lit(359.0)), a=1) == "N"
    assert one(spark, geo.dms(F.lit(-23.5), "N", "S"), a=1) == "23° 30' 0.0\" S"
    assert one(spark, geo.valid_fix(F.lit(0.0), F.lit(0.0), F.lit(5.0)), a=1) is False


def test_money(spark):
    assert one(spark, money.amounts(F.col("a")), a="Tk 1,200.5 lakh and 50 crore") == [120050000.0, 500000000.0]


def test_spans(spark):
    docs = spark.createDataFrame([(1, "Dhaka City Corporation of Dhaka, notdhaka"), (2, None)], "id long, text string")
    got = [tuple(r) for r in gazetteer.spans(docs, "id", "text", ["dhaka", "dhaka city corporation"]).orderBy("start").collect()]
    assert got == [(1, 0, 22, "dhaka city corporation"), (1, 26, 31, "dhaka")]


def test_html():
    page = html.article('<html lang=en><head><title>T</title><meta name="author" content="A"></head><body><nav>no</nav><p>' + "word " * 10 + "</p><p>" + "more " * 10 + '</p><img src="/i.png"><p>x</p></body>', "http://h/a")
    assert (page["title"], page["author"], page["lang"]) == ("T", "A", "en")
    assert page["text"] == ("word " * 10).strip() + "\n" + ("more " * 10).strip()
    assert page["images"] == ["http://h/i.png"]
    assert html.article(None, None)["text"] == ""


def test_closest_is_exact(spark):
    import random

    rng = random.Random(5)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(3, 14))) for _ in range(120)]
    names, choices = words[:60], words[60:]

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
        return row[-1]

    want = set()
    for n in set(names):
        d, c = min((lev(n, c), c) for c in choices)
        if d <= max(1, int(len(n) * 0.3)):
            want.add((n, c, d))
    got = linkage.closest(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(c,) for c in choices], "choice string"), 0.3)
    assert {tuple(r) for r in got.collect()} == want


def test_budget(spark):
    items = F.array(*[F.struct(F.lit(s).cast("long").alias("size"), F.lit(i).alias("id")) for i, s in enumerate((5, 9, 3, 2))])
    got = one(spark, F.transform(retrieval.within_budget(items, F.lit(10)), lambda x: x["id"]), a=1)
    assert got == [0, 2, 3]


def test_precedence(spark):
    rows = spark.createDataFrame([("r", "name", " ", "human_confirmed", 1), ("r", "name", "B", "archive", 2), ("r", "name", "A", "live", 3)], "row_key string, field string, value string, source_kind string, seq int")
    assert tuple(reconcile.by_precedence(rows).first()) == ("r", "name", "A", "live", True)


def test_written_dates(spark):
    text = "২৮ সেপ্টেম্বর, ২০২৬ এবং 3 March 2021, 3 MARCH 2021; May 5, 2020 and 2020-01-31. আজ"
    got = one(spark, calendar.written_dates(F.col("a")), a=text)
    assert got == ["২৮ সেপ্টেম্বর, ২০২৬", "3 March 2021", "May 5, 2020", "2020-01-31", "আজ"]
    assert one(spark, calendar.written_dates(F.col("a")), a=" ".join(f"20{i:02}-01-01" for i in range(30))) == [f"20{i:02}-01-01" for i in range(10)]
    assert one(spark, calendar.date_score(F.nullif(F.col("a"), F.lit(1.0))), a=1.0) == 0.5


def test_updated_on(spark):
    day = datetime.date
    for said, want in (("28-9-2026", day(2026, 9, 28)), ("2026/9/8", day(2026, 9, 8)), ("১.২.২৬", day(2026, 2, 1)), ("সোমবার, ২৮ সেপ্টেম্বর, ২০২৬ এ ১৫:৩৯", day(2026, 9, 28)), ("5 May 2020", day(2020, 5, 5)), ("31-2-2020", None), ("soon", None)):
        assert one(spark, calendar.updated_on(F.col("a")), a=f"x\nLast updated: {said}") == want, said
    assert one(spark, calendar.updated_on(F.col("a")), a="no label 2020-01-01") is None


def test_mentions_of_money(spark):
    text = "৫০ কোটি টাকা, 12 lakh and ৳3,500; 7 হাজার ৭০১টি; 12 lakh taka"
    got = one(spark, money.mentions(F.col("a")), a=text)
    assert [(r["amount"], r["value"], r["currency"]) for r in got] == [("৫০ কোটি টাকা", 500000000, "BDT"), ("7 হাজার", 7000, "BDT"), ("12 lakh", 1200000, "BDT"), ("12 lakh taka", 1200000, "BDT"), ("৳3,500", 3500, "BDT")]
    assert one(spark, money.with_currency(F.col("a"), money.mentions(F.col("a"))), a=text) == ["৫০ কোটি টাকা", "12 lakh taka", "৳3,500"]


def test_tolerant_json(spark):
    for said, want in (('x ```json\n{"a": 1,}\n``` y', '{"a": 1}'), ("\ufeffHere: [1, 2, ] ok", "[1, 2]"), ("{“a”: 2}", '{"a": 2}'), ("none", None), ("{broken", None), ("", None)):
        got = one(spark, T.tolerant_json(F.col("a")), a=said)
        assert got == want or (got or "").replace(" ", "") == (want or "").replace(" ", ""), (said, got)


def test_gates(spark):
    from tessera.operators import gates

    a = F.col("a")
    for text, bad in (("Dhaka", False), ("D", True), ("ORG 12", True), ("...", True), ("সরকার", True), ("সরকার বাড়ি", False), (None, True)):
        df = spark.createDataFrame([(text,)], "a string")
        assert df.select(gates.invalid_entity(a)).first()[0] is bad, text
    assert one(spark, gates.grounded(F.lit("Phone"), F.col("b"), a), a="Tel 017-11 22", b="০১৭১১২২") is True
    assert one(spark, gates.grounded(F.lit("Phone"), F.col("b"), a), a="Tel 017-11 22", b="0171") is False
    assert one(spark, gates.relevance(F.lit(0.5), F.lit(1), F.lit(9), F.lit(1), F.lit(1)), a=1) == 85


def test_near_names():
    from tessera.operators import gazetteer

    names = ["ministry of health office", "office"]
    assert gazetteer.near_names("the ministri of health office", names, ("office",)) == [(6, 29, "ministry of health office", 3), (24, 29, "office", 1)]  # the shortest window that fits
    assert gazetteer.near_names("the ministry of health office", names, ("office",), taken=((4, 29),)) == []
    assert gazetteer.near_names("nothing here", names, ("office",)) == []


def test_near_names_by_brute_force():
    """Pieces lose no name: the same windows as comparing every name at every anchor."""
    import random

    from tessera.operators import gazetteer

    def plain(text, names, anchors, share, taken):
        out = []
        for anchor in anchors:
            for end in (i + len(anchor) for i in range(len(text)) if text.startswith(anchor, i)):
                for name in names:
                    limit = max(1, int(len(name) * share))
                    fits = [n for n in range(len(name) - limit, len(name) + limit + 1) if n <= end and not any(end - n < b and end > a for a, b in taken)]
                    hits = [(n, d) for n in fits if 0 < (d := gazetteer._edits(text[end - n : end], name, limit)) <= limit]
                    if len(name) >= 6 and name.endswith(anchor) and hits:
                        out.append((end - hits[0][0], end, name, hits[0][1]))
        return sorted(out)

    rng, seen = random.Random(11), 0
    word = lambda: "".join(rng.choice("abc ") for _ in range(rng.randrange(22)))
    for _ in range(400):
        anchors = ("ab", "cca")
        names = sorted({word() + rng.choice(anchors) for _ in range(12)})
        text = "".join(rng.choice(["", word(), rng.choice(names)]) + rng.choice(["", "ab", "cca"]) for _ in range(6))
        taken = tuple((a, a + rng.randrange(1, 6)) for a in (rng.randrange(len(text) + 1) for _ in range(rng.randrange(3))))
        share = rng.choice([0.15, 0.3])
        got = gazetteer.near_names(text, names, anchors, share, taken)
        assert got == plain(text, names, anchors, share, taken)
        seen += len(got)
    assert seen > 500


def test_first_phrases_are_whole_words(spark):
    from tessera.operators import gazetteer

    texts = ["derby in town", "xdie x", "Der Hund", "so die, the", "the derby", "", None, "ender"]
    hits, first = gazetteer.first_phrases(F.col("t"), [("der|die", "german"), ("the", "english")])
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", F.array_join(hits, ",").alias("h"), first.alias("f"))
    assert {r["i"]: (r["h"], r["f"]) for r in rows.collect() if r["h"]} == {2: ("german", "german"), 3: ("german,english", "german"), 4: ("english", "english")}


def test_mentions_look_for_each_pattern_once(spark):
    """Patterns are looked for once a text, not once for every mention found."""
    rows = spark.createDataFrame([("7 crore taka",)], "a string")
    looks = lambda c: rows.select(c.alias("x"))._jdf.queryExecution().analyzed().toString().count("regexp_extract_all(")
    assert looks(money.mentions(F.col("a"))) == len(money.WAYS)
    assert looks(money.with_currency(F.col("a"), money.mentions(F.col("a")))) == len(money.WAYS)
    assert looks(calendar.written_dates(F.col("a"))) == len(calendar.DATE_PATTERNS)
    assert looks(calendar.events_of(F.col("a"), calendar.written_dates(F.col("a")))) == len(calendar.DATE_PATTERNS)


def test_milliseconds_and_places_as_in_sql(spark):
    import duckdb

    from tessera.operators import sessions

    con, rows = duckdb.connect(), []
    for ts in ("2024-01-01 00:00:00.001499", "2024-01-01 00:00:00.0015", "2024-01-01 00:00:00.002501", "2024-01-01 00:00:00", "1969-12-31 23:59:59.9985", "1969-12-31 23:59:59.998501", "1969-12-31 23:59:59.998499"):
        rows.append((ts, *con.execute(f"SELECT epoch_ms(TIMESTAMP '{ts}')").fetchall()[0]))
    got = spark.createDataFrame(rows, "t string, want long").select("want", sessions.millis(F.col("t").cast("timestamp")).alias("got")).collect()
    assert all(r["got"] == r["want"] for r in got)
    values = [i / 40 for i in range(1, 400)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", sessions.two_places(F.col("v")).alias("x")).collect()
    assert [r["x"] for r in got] == [con.execute("SELECT round(?::DOUBLE, 2)", [r["v"]]).fetchall()[0][0] for r in got]


def test_phrases_are_looked_for_once(spark):
    from tessera.plans import texts

    plan = texts.phrase_priority(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("mit license") == 1


def test_normal_forms_of_texts_that_have_them(spark):
    import unicodedata

    points = [*range(1, 0x400), 0x1100, 0x1161, 0x9DF, 0x2126, 0xFB01]
    texts = [chr(i) + chr(j) for i in points for j in (0x41, 0x301)] + ["", "a\nb", None]
    rows = spark.createDataFrame([(t,) for t in texts], "a string").select("a", *[T.unicode_form(F.col("a"), f).alias(f) for f in T.AS_THEY_ARE]).collect()
    for r in rows:
        assert all(r[f] == (None if r["a"] is None else unicodedata.normalize(f, r["a"])) for f in T.AS_THEY_ARE)


def test_compared_texts_are_cleaned_once(spark):
    from tessera.operators import gates

    rows = spark.createDataFrame([("a  b", "a b"), ("aa b", "aa cc"), ("x", " "), ("x", "x")], "a string, b string").select("a", gates.compared(F.col("a"), F.col("b")).alias("x"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("sha2(") == 2
    got = [r["x"] for r in rows.collect()]
    assert [(x.match, x.a_sha256 == x.b_sha256, x.overlap) if x else None for x in got] == [(True, True, 0.0), (False, False, 1.0), None, (True, True, 0.0)]
