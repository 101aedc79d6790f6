"""Queries over texts in legacy font codes.  Documents are put into Bengali letters by rules that Spark and SQL share."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import integrity, legacy

#: Letters of a text in turn: runs of others are blanks, of vowels the first one stays.
_RUNS = (("[^a-z]+", " "), ("([aeiou])[aeiou]+", r"\1"))
#: Vowels that begin a word, then consonants that make one cluster, then single letters; other vowels are signs.
_INITIAL = tuple(zip((" a", " e", " i", " o", " u"), (" আ", " এ", " ই", " ও", " উ"), strict=True))
_CLUSTERS = (
    ("str", "স্ত্র"), ("ndr", "ন্দ্র"), ("nt", "ন্ত"), ("nd", "ন্ড"), ("st", "স্ত"), ("tr", "ত্র"), ("ng", "ঙ্গ"), ("sh", "শ"), ("ch", "ছ"), ("th", "থ"), ("rm", "র্ম"),
    ("rt", "র্ত"), ("ry", "র্য"), ("rd", "র্দ"), ("ly", "ল্য"), ("bl", "ব্ল"),
)
_LATIN, _BENGALI = "abcdefghijklmnopqrstuvwxyz", "াবকদেফগহিজকলমনোপখরসতুভঠঞষজ"


def _bengali(c):
    c = F.concat(F.lit(" "), F.lower(c))
    for pattern, by in _RUNS:
        c = F.regexp_replace(c, pattern, by.replace("\\", "$"))
    for a, b in (*_INITIAL, *_CLUSTERS):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.trim(F.translate(c, _LATIN, _BENGALI))


def _bengali_sql(c: str) -> str:
    c = f"concat(' ', lower({c}))"
    for pattern, by in _RUNS:
        c = f"regexp_replace({c}, '{pattern}', '{by}', 'g')"
    for a, b in (*_INITIAL, *_CLUSTERS):
        c = f"replace({c}, '{a}', '{b}')"
    return f"trim(translate({c}, '{_LATIN}', '{_BENGALI}'))"


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def legacy_text(spark, sf_dir):
    """Every document in Bengali letters, put into legacy codes and read again: the text it comes to, and the class of the codes."""
    rows = _docs(spark, sf_dir).select("doc_id", legacy.to_legacy(_bengali(F.col("text"))).alias("codes"))
    back = legacy.from_legacy(F.col("codes"))
    out = rows.select("doc_id", F.coalesce(F.col("codes").rlike("^[ -ÿ–-™Œ-ƒˆ˜]*$"), F.lit(False)).alias("in_codes"), back.alias("back"))
    return out.select("doc_id", "in_codes", F.length("back").cast("long").alias("n_chars"), F.md5("back").alias("digest"))


LEGACY_TEXT = f"SELECT doc_id, true AS in_codes, length(b)::BIGINT AS n_chars, md5(b) AS digest FROM (SELECT doc_id, {_bengali_sql('text')} AS b FROM documents)"

#: Ways to spoil a text, each by a pattern that both engines know: vowel signs before their consonants, doubled signs, an r cut off.
_SPOILT = (("e", "([কগজতদনপবমরলস])ে", r"ে\1"), ("i", "ি", "িি"), ("r", "র্([মতযদ])", r"র্ \1"))


def text_integrity(spark, sf_dir):
    """The class and the faults of every document as it is, in Bengali letters, and spoilt in three ways."""
    rows = _docs(spark, sf_dir).select("doc_id", F.col("text").alias("plain"), _bengali(F.col("text")).alias("bengali"))
    forms = [("plain", F.col("plain")), ("bengali", F.col("bengali")), ("both", F.concat_ws(" ", "plain", "bengali"))]
    forms += [(name, F.regexp_replace("bengali", p, by.replace("\\", "$"))) for name, p, by in _SPOILT]
    rows = rows.select("doc_id", F.explode(F.array(*[F.struct(F.lit(k).alias("form"), c.alias("text")) for k, c in forms])).alias("x")).select("doc_id", "x.*")
    return rows.select("doc_id", "form", integrity.classify(F.col("text")).alias("x")).select("doc_id", "form", "x.kind", F.array_join("x.faults", ",").alias("faults"))


def _integrity_sql() -> str:
    sign, fault = integrity.SIGNATURE, integrity.FAULTS
    quoted = "('" + "', '".join(integrity.VOWELLESS) + "')"
    strong_forms = f"regexp_matches(t, '{sign}')"
    return rf"""
WITH b AS (SELECT doc_id, text AS plain, {_bengali_sql("text")} AS bengali FROM documents),
forms AS (
  SELECT doc_id, 'plain' AS form, plain AS text FROM b UNION ALL SELECT doc_id, 'bengali', bengali FROM b UNION ALL SELECT doc_id, 'both', concat_ws(' ', plain, bengali) FROM b
  {" ".join(f"UNION ALL SELECT doc_id, '{n}', regexp_replace(bengali, '{p}', '{by}', 'g') FROM b" for n, p, by in _SPOILT)}),
clean AS (SELECT doc_id, form, trim(regexp_replace(regexp_replace(coalesce(text, ''), '{integrity.MARKS}', '', 'g'), '[\s\x0B\x{{a0}}]+', ' ', 'g')) AS text FROM forms),
tokens AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS t FROM clean WHERE NOT regexp_matches(text, '{integrity.BLOCK}')),
cores AS (
  SELECT t, regexp_replace(t, '^[(\["'']+|[)\]"''.,;:!?]+$', '', 'g') AS core, regexp_replace(t, '^[^\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+$', '', 'g') AS inside FROM tokens),
marks AS (
  SELECT t, CASE
    WHEN {strong_forms} THEN 'strong'
    WHEN regexp_matches(t, '{integrity.EMAIL}') OR regexp_matches(t, '(?i){integrity.URL}') OR regexp_matches(t, '{integrity.PHONE}') OR regexp_matches(inside, '^\p{{Nd}}*$') THEN ''
    WHEN NOT regexp_matches(core, '[A-Za-z]') THEN CASE WHEN contains(core, '`') OR ends_with(core, '|') THEN 'strong' ELSE '' END
    WHEN regexp_matches(core, '{integrity.CAPITAL_INSIDE}') AND NOT regexp_matches(core, '{integrity.SURNAMES.replace("'", "''")}') THEN 'strong'
    WHEN contains(core, '`') OR regexp_matches(core, '[\p{{L}}\p{{N}}_]\|') THEN 'strong'
    WHEN NOT regexp_matches(core, '[a-z]') THEN ''
    WHEN length(regexp_replace(core, '[^A-Za-z]', '', 'g')) >= 2 AND NOT regexp_matches(core, '[aeiouyAEIOUY]') AND lower(regexp_replace(core, '[^A-Za-z]', '', 'g')) NOT IN {quoted} THEN 'weak'
    ELSE '' END AS mark FROM cores),
counts AS (
  SELECT doc_id, form, count(*) AS n, count(*) FILTER (mark = 'strong') AS strong, count(*) FILTER (mark = 'weak') AS weak
  FROM (SELECT doc_id, form, unnest(string_split(text, ' ')) AS t FROM clean WHERE NOT regexp_matches(text, '{integrity.BLOCK}')) JOIN marks USING (t) GROUP BY ALL),
seen AS (
  SELECT *, len(regexp_extract_all(text, '{sign}')) AS signs, regexp_matches(text, '{integrity.BLOCK}') AS bn,
    list_sort(list_filter([CASE WHEN regexp_matches(text, '{integrity.DETACHED}') THEN 'detached_reph' END, {", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{k}' END" for k, p in fault.items())}], lambda x: x IS NOT NULL)) AS faults
  FROM clean LEFT JOIN counts USING (doc_id, form))
SELECT doc_id, form, CASE
  WHEN text = '' THEN 'EMPTY'
  WHEN bn THEN CASE WHEN signs > 0 THEN 'MIXED' WHEN len(faults) > 0 THEN 'VISUAL_ORDER_BROKEN' ELSE 'UNICODE_OK' END
  WHEN signs >= 2 OR strong > 0 AND 2 * strong + weak >= n THEN CASE WHEN n = 1 AND signs = 0 THEN 'UNKNOWN' ELSE 'BIJOY_ANSI' END
  WHEN strong = 0 AND weak = 0 THEN 'ENGLISH_OK' ELSE 'UNKNOWN' END AS kind,
  array_to_string(faults, ',') AS faults
FROM seen
"""


def lexicon_share(spark, sf_dir):
    """The share of every document's words, in Bengali letters, that some passage of ``benchmark`` has."""
    docs = _docs(spark, sf_dir).select("doc_id", _bengali(F.col("text")).alias("text"))
    words = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.explode(F.split(_bengali(F.col("text")), " ")).alias("word"))
    return integrity.lexicon_ratio(docs, "doc_id", "text", words, "word").select("doc_id", F.round("ratio", 9).alias("ratio"))


LEXICON_SHARE = f"""
WITH words AS (SELECT DISTINCT unnest(string_split({_bengali_sql("text")}, ' ')) AS w FROM benchmark),
own AS (SELECT doc_id, unnest(string_split({_bengali_sql("text")}, ' ')) AS w FROM documents),
counted AS (SELECT doc_id, count(*) AS n, count(words.w) AS known FROM own LEFT JOIN words USING (w) WHERE regexp_matches(w, '{integrity.LETTER}') GROUP BY doc_id)
SELECT d.doc_id, round(coalesce(known / n, 1.0), 9) AS ratio FROM documents d LEFT JOIN counted USING (doc_id)
"""


def recovered_values(spark, sf_dir):
    """The first words and the first phone number of every document as fields that were put into legacy codes and read again, against the reading
    of an eye that takes some letters and digits for others: why each value can't be stored."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = _docs(spark, sf_dir).select("doc_id", _bengali(F.array_join(F.slice(F.split(F.trim(text), r"\s+"), 1, 3), " ")).alias("name"), F.regexp_extract(text, r"\+?[0-9][0-9 ().-]{6,}[0-9]", 0).alias("phone"))
    rows = rows.withColumn("read", legacy.from_legacy(legacy.to_legacy(F.col("name"))))
    fields = [("Primary_Officer_Name", "read", F.when(F.col("name") != "", F.translate("name", "বনস", "রলম"))), ("Primary_Phone", "phone", F.translate("phone", "7", "1"))]
    rows = rows.select("doc_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(v).alias("value"), s.alias("second")) for f, v, s in fields])).alias("x")).select("doc_id", "x.*")
    return rows.select("doc_id", "field", "value", F.array_join(integrity.recovered_faults(F.col("field"), F.col("value"), F.col("second"), F.lit(1.0)), ",").alias("faults"))


QUERIES = {
    "legacy_text": (legacy_text, LEGACY_TEXT),
    "text_integrity": (text_integrity, _integrity_sql()),
    "lexicon_share": (lexicon_share, LEXICON_SHARE),
    "recovered_values": (recovered_values, None),
}
