"""Officer pages of every shape, by hand; photos against a plain second rule."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import officer_pages

HEAD = {"primary": "দায়িত্বপ্রাপ্ত কর্মকর্তা", "alternate": "বিকল্প দায়িত্বপ্রাপ্ত কর্মকর্তা", "appellate": "আপিল কর্তৃপক্ষ"}
LABELS = {"Officer_Name": "নাম:", "Designation": "পদবি:", "Phone": "ফোন:", "Mobile": "মোবাইল:", "Email": "ইমেইল:", "Address": "ঠিকানা :"}
P = {"Officer_Name": "মো: তোফায়েল হোসেন (১৬২৯৪)", "Designation": "উপসচিব ( প্রশাসন-১ শাখা)", "Phone": "+৮৮-০২-২২৩৩৫৪৫২১", "Mobile": "০১৭১২০৬৩০৮৯", "Email": "admin1@a.gov.bd", "Address": "স্বরাষ্ট্র মন্ত্রণালয়"}
A = {"Officer_Name": "নাসরীন সুলতানা", "Designation": "উপসচিব", "Phone": "+৮৮-০২-৪৭১২৪৩৫৭", "Email": "police4@a.gov.bd"}
Z = {"Officer_Name": "মনজুর মোর্শেদ চৌধুরী", "Designation": "সিনিয়র সচিব", "Mobile": "", "Email": "secretary@a.gov.bd"}


def card(role, values, img="", more=""):
    rows = "".join(f"<tr><th>{LABELS[k]}</th><td>{v.replace('@', '<wbr>@')}</td></tr>" for k, v in values.items())
    picture = f'<div><img src="{img}"></div>' if img else ""
    return f"<div class=widget><div><h3>{HEAD[role]}</h3>{picture}{more}<table><tbody>{rows}</tbody></table></div></div>"


def page(body):
    return f'<html><head><title>{HEAD["primary"]}</title></head><body><header><a href="/x">{HEAD["primary"]}</a></header><nav><a href="/x">{HEAD["appellate"]}</a></nav><main><h2>দায়িত্বপ্রাপ্ত কর্মকর্তাগণ</h2>{body}</main><footer>x</footer></body></html>'


PAGES = {
    1: page(card("primary", P, "/p.jpg") + card("alternate", A) + card("appellate", Z, "/z.jpg")),
    2: page(card("appellate", Z, "/z.jpg") + card("primary", P) + card("alternate", A, "/a.jpg")),  # another order
    3: page(card("primary", dict.fromkeys(P, "")) + card("alternate", {"Officer_Name": "test", "Phone": "n/a"}, "/a.jpg")),  # nobody
    4: page(
        "<table><tr><th>দায়িত্ব</th><th>ছবি</th><th>নাম ও পদবি</th><th>মোবাইল</th><th>ইমেইল</th></tr>"
        f"<tr><td>{HEAD['primary']}</td><td><img src='/p.jpg'></td><td>{P['Officer_Name']}<br>{P['Designation']}<td>{P['Mobile']}</td><td>{P['Email']}</td></tr>"
        f"<tr><td>{HEAD['appellate']}</td><td></td><td>{Z['Officer_Name']}</td><td></td><td>{Z['Email']}</td></tr></table>"
    ),
    5: page(
        f"<p><strong>{HEAD['primary']}</strong></p><p>কর্মকর্তার নাম : {P['Officer_Name']}<br>পদবি : সহকারী পরিচালক<br>ফোন : ০২-৯৫৫৪৪৩৩<br>ই-মেইল : <span>This email address is being protected from spambots.</span></p>"
        f"<p><strong>আপীল কর্তৃপক্ষ</strong></p><p>কর্মকর্তার নাম : {Z['Officer_Name']}<br>ই-মেইল : secretary [at] a.gov.bd</p>"
    ),
    6: page(f"<p>{HEAD['primary']}ের তথ্য পেতে নিচের ঠিকানায় যোগাযোগ করুন, যে কোনো কার্যদিবসে সকাল নয়টা থেকে পাঁচটা</p><div>Designated Officer: Name: Rahim Uddin Designation: Deputy Director Phone: 02-9554433, write to rahim@a.gov.bd or come in person</div><p>Address: Dhaka</p>"),
    7: page(f"<h3>{HEAD['primary']}</h3><table><tr><td>নাম</td></tr><tr><td>{A['Officer_Name']}</td></tr><tr><td>ইমেইল</td><td></td></tr><tr><td>see admin1@a.gov.bd</td></tr></table><p>মোবাইল {P['Mobile']}</p>"),
    8: page('<h3><font face="SutonnyMJ">`vwqZ¡cÖvß Kg©KZ©v</font></h3><table><tr><td><font face="SutonnyMJ">bvg:</font></td><td><font face="SutonnyMJ">†gvt Av‡bvqvi †nv‡mb</font></td></tr><tr><td>E-mail:</td><td>anwar@a.gov.bd</td></tr></table>'),
    9: page(f"<div><p>{HEAD['primary']}, {HEAD['alternate']} ও আপিল কর্তৃপক্ষ</p><p>নাম: X Y</p></div>"),  # a title of several roles
    10: None,
    11: "<p>broken <div><b>" + HEAD["primary"] + "</b><table><tr><td>নাম<td>Q R<tr><td>ফোন<td>০২-১২৩৪৫৬৭",
    12: page(card("primary", {"Officer_Name": "Karim Ahmed", "Designation": "Officer one", "Email": "none yet"}, more="<p>or 02-7654321</p>")),
}


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, "http://a.gov.bd/info", h) for i, h in PAGES.items()]
    return officer_pages.Pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))


@pytest.fixture(scope="module")
def found(pages):
    out = {}
    for r in pages.fields().collect():
        assert (r["page_id"], r["role"], r["field"]) not in out
        out[r["page_id"], r["role"], r["field"]] = (r["value"], r["state"])
    return out


def values(found, page_id, role):
    return {f: v for (p, r, f), (v, s) in found.items() if (p, r) == (page_id, role) and s == "FILLED"}


def states(found, page_id, role):
    return {f: s for (p, r, f), (_, s) in found.items() if (p, r) == (page_id, role) and s != "FILLED"}


def test_cards(found):
    for p in (1, 2):
        assert values(found, p, "primary") == P
        assert values(found, p, "alternate") == A
        assert states(found, p, "alternate") == {"Mobile": "NOT_ON_PAGE", "Address": "NOT_ON_PAGE"}
        assert states(found, p, "appellate") == {"Mobile": "PAGE_EMPTY", "Phone": "NOT_ON_PAGE", "Address": "NOT_ON_PAGE"}
    assert states(found, 3, "primary") == dict.fromkeys(P, "PAGE_EMPTY")
    assert states(found, 3, "alternate")["Officer_Name"] == "PAGE_EMPTY"  # a placeholder
    assert {(r) for p, r, _ in found if p == 3} == {"primary", "alternate"}


def test_rows_of_a_table(found):
    assert values(found, 4, "primary") == {k: P[k] for k in ("Officer_Name", "Designation", "Mobile", "Email")}
    assert values(found, 4, "appellate") == {k: Z[k] for k in ("Officer_Name", "Email")}


def test_lines(found):
    assert values(found, 5, "primary") == {"Officer_Name": P["Officer_Name"], "Designation": "সহকারী পরিচালক", "Phone": "০২-৯৫৫৪৪৩৩"}
    assert states(found, 5, "primary")["Email"] == "PAGE_EMPTY"  # cloaked
    assert values(found, 5, "appellate") == {"Officer_Name": Z["Officer_Name"], "Email": "secretary@a.gov.bd"}


def test_plain_text(found):
    assert values(found, 6, "primary") == {"Officer_Name": "Rahim Uddin", "Designation": "Deputy Director", "Phone": "02-9554433, write to rahim@a.gov.bd or come in person", "Email": "rahim@a.gov.bd", "Address": "Dhaka"}


def test_values_on_the_next_line(found):
    assert values(found, 7, "primary") == {"Officer_Name": A["Officer_Name"], "Email": "admin1@a.gov.bd", "Mobile": P["Mobile"]}


def test_legacy_fonts(found):
    assert values(found, 8, "primary") == {"Officer_Name": "মোঃ আনোয়ার হোসেন", "Email": "anwar@a.gov.bd"}


def test_what_is_no_role(found):
    assert not [k for k in found if k[0] in (9, 10)]


def test_broken_markup(found):
    assert values(found, 11, "primary") == {"Officer_Name": "Q R", "Phone": "০২-১২৩৪৫৬৭"}


def test_signs_that_no_label_caught(found):
    assert states(found, 12, "primary") == {"Email": "PARSE_MISS", "Phone": "PARSE_MISS", "Mobile": "PARSE_MISS", "Address": "NOT_ON_PAGE"}


def test_photos_of_cards(pages):
    got = {(r["page_id"], r["role"]): r["url"] for r in pages.photos().collect()}
    host = "http://a.gov.bd"
    assert got == {(1, "primary"): f"{host}/p.jpg", (1, "appellate"): f"{host}/z.jpg", (2, "appellate"): f"{host}/z.jpg", (2, "alternate"): f"{host}/a.jpg", (4, "primary"): f"{host}/p.jpg"}


def test_photo_rules(spark):
    """Rejected images, the nearest of several, one image in two blocks, and a gallery without an order."""
    lines = lambda name, img="": f"<h3>{{}}</h3>{img}<p>নাম: {name}</p>"
    two = lambda a, b, rest="": "<main>" + a.format(HEAD["primary"]) + b.format(HEAD["alternate"]) + rest + "</main>"
    rows = {
        1: page(card("primary", P, "/themes/default-avatar.png") + card("alternate", A, '/far.jpg"><img width="50" height="90" src="/small.jpg"><img src="/near.jpg')),
        2: two(lines("X Y", '<img src="/same.jpg">'), lines("Q R", '<img src="/same.jpg">')),
        3: two(lines("X Y", '<img src="/same.jpg">'), lines("x  y", '<img src="/same.jpg">')),
        4: '<div><img src="/f/karim-ahmed.jpg"><img src="/f/7.jpg" alt="Alternate officer"><img src="/f/8.jpg"></div>' + two(lines("Karim Ahmed"), lines("Q R")),
        5: '<div><img src="/f/1.jpg"><img src="/f/2.jpg"></div>' + two(lines("Karim Ahmed"), lines("Q R")),
    }
    df = spark.createDataFrame([(i, "https://h/p", h) for i, h in rows.items()], "page_id long, url string, html string")
    got = sorted((r["page_id"], r["role"], r["url"], r["flag"]) for r in officer_pages.Pages(df).photos().collect())
    dup = "photo_duplicate"
    assert sorted(got, key=str) == sorted(
        [
            (1, "alternate", "https://h/near.jpg", "photo_multiple_in_block"), (2, "primary", None, dup), (2, "alternate", None, dup), (3, "primary", "https://h/same.jpg", ""), (3, "alternate", "https://h/same.jpg", ""),
            (4, "primary", "https://h/f/karim-ahmed.jpg", "photo_from_gallery_by_label"), (4, "alternate", "https://h/f/7.jpg", "photo_from_gallery_by_label"),
        ],
        key=str,
    )


def test_headings(spark):
    cases = {
        "দায়িত্বপ্রাপ্ত কর্মকর্তাগণ": "container", "কর্মকর্তাবৃন্দ": "container", "Information Officers": "container", "দায়িত্বপ্রাপ্ত কর্মকর্তা": "primary", "তথ্য প্রদানকারী কর্মকর্তা": "primary",
        "বিকল্প দায়িত্বপ্রাপ্ত কর্মকর্তা": "alternate", "আপীল কর্তৃপক্ষ": "appellate", "আপিল কর্তৃপক্ষ": "appellate", "কর্মকর্তার নাম": None, "Alternate Officer:": "alternate", "": None, "x" * 71 + "designated officer": None,
        "Designated Officer / Appellate Authority": "container", "hello": None,
    }
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("i", officer_pages.heading(F.col("t")).alias("k"))
    assert {r["i"]: r["k"] for r in df.collect()} == dict(enumerate(cases.values()))


def test_places_by_brute_force():
    """Every element's line range is what its own lines say, on random markup."""
    rng = random.Random(9)
    for _ in range(200):
        html = "".join(rng.choice(["<div>", "</div>", "<p>", "</p>", "<b>", "</b>", "<table><tr><td>", "</td></tr></table>", "<br>", "w ", "v", '<img src="a.jpg">', "<ul><li>", "</ul>"]) for _ in range(rng.randint(1, 60)))
        lines, images = officer_pages.parsed(html, "http://h/")
        assert [x["i"] for x in lines] == list(range(len(lines)))
        assert all(a["pos"] < b["pos"] for a, b in itertools.pairwise(lines))
        for x in lines:
            assert 0 <= x["c_first"] <= x["i"] <= x["c_last"] < len(lines)
            assert x["c_at"] < x["pos"] < x["c_end"]
            assert {y["i"] for y in lines if x["c_at"] < y["pos"] < x["c_end"]} <= set(range(x["c_first"], x["c_last"] + 1))
            alone = x["c_first"] == x["c_last"]
            assert not alone or x["c_at"] == 0 or any(x["c_at"] < m["pos"] < x["c_end"] for m in images)


def test_words_of_the_page_are_values(spark, tmp_path):
    """Sections say the page's own words, placeholders among them, in each shape; their SQL says the same."""
    import duckdb

    from tessera.plans import officers

    html = "<html><body><h1>{}</h1></body></html>"
    heads = [f"{w}{' ' * k}" for w in ("Ala test Bel na Cor Demo", "none Test", "test") for k in range(4)]
    rows = [(i, f"https://a.example.com/en/{i}", html.format(h)) for i, h in enumerate(heads)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for query, sql in officers.QUERIES.values():
        assert sorted(map(tuple, query(spark, str(tmp_path)).collect())) == sorted(con.execute(sql).fetchall())


def test_pages_are_read_a_few_at_a_time(spark, monkeypatch):
    """However many pages a batch has, the lines of a few are held."""
    import pyarrow as pa

    pages, run = spark.createDataFrame([(0, "", "")], "page_id long, url string, html string"), []
    monkeypatch.setattr(type(pages), "mapInArrow", lambda self, f, schema: run.append(f))
    officer_pages.streams(pages, "page_id", "url", "html", False)
    whole = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array([""] * 100), pa.array(["<p>a</p>"] * 100)], ["page_id", "url", "html"])
    sizes = [b.num_rows for b in run[0](iter([whole]))]
    assert sum(sizes) == 100 and max(sizes) <= officer_pages.AT_ONCE
