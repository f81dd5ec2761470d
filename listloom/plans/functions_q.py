"""Queries over the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from listloom.functions import classify as C
from listloom.functions import dates as D
from listloom.functions import scoring as S
from listloom.functions import text as X
from listloom.functions.patterns import least_pattern
from listloom.functions.showtimes import stamps_to_films, version_label
from listloom.operators.recurring import curated_rows
from listloom.plans import inputs as I
from listloom.plans.registry import query, table
from listloom.sources import html

PHRASES = ("the", "of the", "que", "den", "gear", "ring", "bolt")
ALIASES = {"small ring set": ("hot gear", "red bolt")}


@query("fn1_entities", f"WITH {I.LISTINGS} SELECT id, trim({I.sql_norm('title')} || ' cafe lA 5 fin ij') AS norm FROM listings")
def fn1_entities(spark, d):
    """Titles between an age prefix and references, named, numeric and out of the C1 range, and compatibility forms."""
    dressed = F.concat(F.lit("Int.—12 ans "), "title", F.lit(" caf&eacute; l&#146;&#x00000041; &#150;5 ﬁn&#133; ĳ"))
    return I.listings(spark, d).select("id", X.normalize_title(dressed).alias("norm"))


@query("fn1_normalize_title", f"WITH {I.LISTINGS} SELECT id, {I.sql_norm('title')} AS norm FROM listings")
def fn1(spark, d):
    return I.listings(spark, d).select("id", X.normalize_title(F.col("title")).alias("norm"))


@query("fn2_slugs", rf"""WITH {I.LISTINGS}, a AS (SELECT id, start_date, lower(trim(title)) AS low FROM listings),
b AS (SELECT id, start_date, low,
  regexp_replace(regexp_replace(regexp_replace(low, '[^\p{{L}}\p{{N}}_\s-]', '', 'g'), '[-\s]+', '-', 'g'), '^-+|-+$', '', 'g') AS plain,
  regexp_replace(regexp_replace(regexp_replace(strip_accents(low), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), '-[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$', '') AS page,
  regexp_replace(regexp_replace(regexp_replace(replace(replace(low, '''', '-'), '’', '-'), '[^a-z0-9-]+', '-', 'g'), '^-+|-+$', '', 'g'), '-+', '-', 'g') AS apostrophe,
  regexp_replace(regexp_replace(low, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS ascii FROM a)
SELECT id, plain, CASE WHEN plain = '' THEN 'unnamed' ELSE plain END || '-' || start_date AS dated,
  left(left(page, 60) || '-' || replace(left(start_date, 7), '-', ''), 80) AS page, apostrophe,
  start_date || '-' || left(ascii, 40) AS date_first FROM b""")
def fn2(spark, d):
    t, s = F.col("title"), F.col("start_date")
    return I.listings(spark, d).select("id", X.slug(t).alias("plain"), X.slug(t, "dated", s).alias("dated"),
                                       X.slug(t, "page", s, (60, 80)).alias("page"), X.slug(t, "apostrophe").alias("apostrophe"),
                                       X.slug(t, "date_first", s, (40,)).alias("date_first"))


@query("fn3_short_key", f"""WITH {I.LISTINGS} SELECT id,
  left(regexp_replace(lower(title), '[^a-z0-9]', '', 'g'), 50) || '|' || left(start_date, 10) AS short_key FROM listings""")
def fn3(spark, d):
    return I.listings(spark, d).select("id", X.short_key(F.col("title"), F.col("start_date"), 50).alias("short_key"))


@query("fn4_row_key", f"""WITH {I.SNAPSHOTS} SELECT position, source_id || '|' || {I.sql_norm('title')} || '|' || start_date
  || '|' || {I.sql_norm('venue_name')} AS row_key FROM base""")
def fn4(spark, d):
    old, new = I.snapshots(spark, d)
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("position"), F.col("c_mktsegment").alias("source_id"),
                                           F.col("c_name").alias("title"), (F.col("c_custkey") % 9 + 1).alias("m"), "c_nationkey")
    start = F.concat(F.lit("2024-0"), F.col("m").cast("string"), F.lit("-15"))
    venue = F.concat(F.lit("Salle "), F.col("c_nationkey").cast("string"))
    return c.select("position", X.row_key(F.col("source_id"), F.col("title"), start, venue).alias("row_key"))


# neighbours by document number give a pair for every document
@query("fn5_token_similarity", f"""WITH {I.LISTINGS}, t AS (
  SELECT id, list_filter(string_split({I.sql_norm('title')}, ' '), lambda x: x <> '') AS w FROM listings),
p AS (SELECT a.id, a.w AS a, b.w AS b FROM t a JOIN t b ON b.id = a.id + 1)
SELECT id, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0
  WHEN len(a) >= 2 AND len(b) > len(a) AND b[1:len(a)] = a THEN 1.0
  WHEN len(b) >= 2 AND len(a) > len(b) AND a[1:len(b)] = b THEN 1.0
  ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6)::DOUBLE AS similarity FROM p""")
def fn5(spark, d):
    t = I.listings(spark, d).select("id", X.tokens(X.normalize_title(F.col("title"))).alias("w"))
    p = t.join(t.select((F.col("id") - 1).alias("id"), F.col("w").alias("v")), "id")
    return p.select("id", F.round(X.token_similarity(F.col("w"), F.col("v")), 6).alias("similarity"))


def _alias_sql(norm: str) -> str:
    return f"CASE WHEN {norm} IN ('small ring set', 'hot gear', 'red bolt') THEN 'small ring set' ELSE regexp_replace({norm}, '(?:(?:^| )(?:the|of the|que|den|gear|ring|bolt))+$', '') END"


@query("fn6_event_name", f"""SELECT p_partkey, {_alias_sql(I.sql_norm("p_name || ' of the gear'"))} AS long_name,
  {_alias_sql(I.sql_norm("p_name"))} AS name FROM part""")
def fn6(spark, d):
    name = lambda c: F.array_join(X.event_name(c, PHRASES, ALIASES), " ")
    return table(spark, d, "part").select("p_partkey", name(F.concat("p_name", F.lit(" of the gear"))).alias("long_name"),
                                          name(F.col("p_name")).alias("name"))


@query("fn7_urls", r"""WITH u AS (SELECT page_id, url, 'http://site/event/' || regexp_replace(lower(split_part(split_part(url, '//', 2), '/', 1)), '\.', '-', 'g')
    || '-' || strftime(DATE '2024-01-31' + CAST(page_id % 400 AS INTEGER), '%Y-%m-%d') || '/' AS ev FROM pages)
SELECT page_id, regexp_replace(regexp_replace(lower(replace(trim(url), 'http://', 'https://')), '/+$', ''), '[?#].*$', '') AS norm,
  strftime(DATE '2024-01-31' + CAST(page_id % 400 AS INTEGER), '%Y-%m-%d') AS url_date,
  replace(regexp_replace(lower(split_part(split_part(url, '//', 2), '/', 1)), '\.', '-', 'g'), '-', ' ') AS slug_title,
  regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/agenda' AS absolute FROM u""")
def fn7(spark, d):
    host = F.regexp_replace(F.lower(F.regexp_extract("url", "//([^/?#]*)", 1)), r"\.", "-")
    ev = F.concat(F.lit("http://site/event/"), host, F.lit("-"),
                  I.day(F.date_add(F.lit("2024-01-31").cast("date"), (F.col("page_id") % 400).cast("int"))), F.lit("/"))
    return table(spark, d, "pages").select(
        "page_id", X.norm_url(F.col("url")).alias("norm"), X.url_date(ev).alias("url_date"),
        X.slug_title(ev).alias("slug_title"), X.absolute_url(F.col("url"), F.lit("/agenda")).alias("absolute"))


MONTH_CASE_FR = "['janvier','février','mars','avril','mai','juin','juillet','août','septembre','octobre','novembre','décembre']"


def _fr_months():
    return F.array(*[F.lit(m) for m in D.MONTHS_FR])


@query("fn8_french_dates", f"""WITH e AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 50 AS INTEGER) AS f,
  o_orderkey % 4 AS k FROM orders)
SELECT id, CASE WHEN k = 3 THEN '' ELSE strftime(s, '%Y-%m-%d') END AS start_date,
  CASE WHEN k = 3 THEN '' WHEN k = 0 THEN strftime(s, '%Y-%m-') || '28' WHEN k = 1 THEN strftime(f, '%Y-%m-%d') ELSE strftime(s, '%Y-%m-%d') END AS end_date FROM e""")
def fn8(spark, d):
    s = F.col("o_orderdate").cast("date")
    f = F.date_add(s, (F.col("o_orderkey") % 50).cast("int"))
    mon = lambda x: F.get(_fr_months(), F.month(x) - 1)
    dd = lambda x: F.dayofmonth(x).cast("string")
    k = F.col("o_orderkey") % 4
    text = (F.when(k == 0, F.concat(F.lit("Du lundi "), dd(s), F.lit(" au mardi 28 "), mon(s), F.lit(" "), F.year(s).cast("string")))
            .when(k == 1, F.concat(F.lit("Expo : du lundi "), dd(s), F.lit(" "), mon(s), F.lit(" "), F.year(s).cast("string"),
                                   F.lit(" au jeudi "), dd(f), F.lit(" "), mon(f), F.lit(" "), F.year(f).cast("string"), F.lit(".")))
            .when(k == 2, F.concat(F.lit("Le samedi "), dd(s), F.lit(" "), F.upper(mon(s)), F.lit(" "), F.year(s).cast("string")))
            .otherwise(F.concat(F.lit("Le samedi "), dd(s), F.lit(" brumaire "), F.year(s).cast("string"))))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), D.french_range(text).alias("r")) \
        .select("id", "r.start_date", "r.end_date")


@query("fn9_card_dates", """WITH e AS (SELECT o_orderkey AS id, DATE '1998-06-15' AS t, (o_orderkey % 28 + 1)::INT AS d1, (o_orderkey % 12 + 1)::INT AS m1,
  (o_custkey % 28 + 1)::INT AS d2, (o_custkey % 12 + 1)::INT AS m2, o_orderkey % 3 AS k FROM orders),
y AS (SELECT *, CASE WHEN t - make_date(1998, m1, d1) > 90 THEN make_date(1999, m1, d1) ELSE make_date(1998, m1, d1) END AS s,
  CASE WHEN t - make_date(1998, m2, d2) > 90 THEN make_date(1999, m2, d2) ELSE make_date(1998, m2, d2) END AS f FROM e)
SELECT id, CASE WHEN k = 2 THEN '' ELSE strftime(s, '%Y-%m-%d') END AS start_date,
  CASE WHEN k = 2 THEN NULL WHEN k = 1 THEN strftime(s, '%Y-%m-%d')
    WHEN f < s THEN strftime(make_date((year(s) + 1)::INT, m2, d2), '%Y-%m-%d') ELSE strftime(f, '%Y-%m-%d') END AS end_date FROM y""")
def fn9(spark, d):
    names = F.array(*[F.lit(x) for x in ("jan.", "févr".replace("é", "e"), "Mars", "avr", "mai", "juin", "juil.", "août", "sept", "oct", "nov", "dec")])
    k = F.col("o_orderkey")
    d1, m1 = (k % 28 + 1).cast("string"), F.get(names, (k % 12).cast("int"))
    d2, m2 = (F.col("o_custkey") % 28 + 1).cast("string"), F.get(names, (F.col("o_custkey") % 12).cast("int"))
    text = (F.when(k % 3 == 0, F.concat_ws(" ", F.lit("Du"), d1, m1, d2, m2)).when(k % 3 == 1, F.concat_ws(" ", F.lit("Le"), d1, m1))
            .otherwise(F.concat_ws(" ", F.lit("Le"), d1, F.lit("soir"))))
    return table(spark, d, "orders").select(k.alias("id"), D.card_range(text, F.lit(I.AS_OF).cast("date")).alias("r")) \
        .select("id", "r.start_date", "r.end_date")


@query("fn10_numeric_dates", """WITH e AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS s, o_orderkey % 7 AS k,
  (2000 + year(o_orderdate) % 100)::INT AS y2 FROM orders)
SELECT id, CASE WHEN k IN (0, 1, 4, 5) THEN strftime(s, '%Y-%m-%d')
    WHEN k IN (2, 3) THEN strftime(make_date(y2, month(s)::INT, least(day(s), 28)::INT), '%Y-%m-%d') ELSE 'soon' END AS start_date,
  CASE WHEN k = 2 THEN y2 || '-12-28' WHEN k = 3 THEN strftime(make_date(y2, month(s)::INT, 28), '%Y-%m-%d')
    WHEN k = 5 THEN strftime(s + 3, '%Y-%m-%d') END AS end_date FROM e""")
def fn10(spark, d):
    s = F.col("o_orderdate").cast("date")
    k = F.col("o_orderkey") % 7
    f = lambda x, p: F.date_format(x, p)
    low = F.lpad(F.least(F.dayofmonth(s), F.lit(28)).cast("string"), 2, "0")
    text = (F.when(k == 0, f(s, "dd/MM/yyyy")).when(k == 1, f(s, "dd/MM/yy"))
            .when(k == 2, F.concat(low, f(s, "/MM"), F.lit("-28/12/"), f(s, "yy")))
            .when(k == 3, F.concat(low, F.lit("-28"), f(s, "/MM/yy"))).when(k == 6, "soon"))
    eng = (F.when(k == 4, F.concat(F.lit("on "), f(s, "d-MMM-yyyy"))).when(k == 5, F.concat_ws(" to ", f(s, "d-MMM-yyyy"), f(F.date_add(s, 3), "d-MMM-yyyy"))))
    n, e = D.numeric_range(text), D.english_range(eng)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(k.isin(4, 5), e).otherwise(n).alias("r")) \
        .select("id", "r.start_date", "r.end_date")


@query("fn11_dates_in_text", """SELECT doc_id AS id, array_to_string(list_filter([
  strftime(DATE '2024-01-01' + CAST(doc_id % 300 AS INTEGER), '%Y-%m-%d'), strftime(DATE '2024-05-01' + CAST(doc_id % 300 AS INTEGER), '%Y-%m-%d'),
  strftime(DATE '2024-03-01' + CAST(doc_id % 300 AS INTEGER), '%Y-%m-%d'), strftime(DATE '2024-02-01' + CAST(doc_id % 300 AS INTEGER), '%Y-%m-%d')],
  lambda x: x BETWEEN '2024-06-08' AND '2025-12-07'), ',') AS dates FROM documents""")
def fn11(spark, d):
    i = (F.col("doc_id") % 300).cast("int")
    at = lambda x: F.date_add(F.lit(x).cast("date"), i)
    fr = at("2024-05-01")
    extra = F.concat(F.lit(" "), F.date_format(at("2024-01-01"), "d MMMM yyyy"), F.lit(" puis "), F.dayofmonth(fr).cast("string"), F.lit(" "),
                     F.get(_fr_months(), F.month(fr) - 1), F.lit(" "), F.year(fr).cast("string"), F.lit(", 31/13/2024, "),
                     F.date_format(at("2024-03-01"), "d/M/yyyy"), F.lit(" 2024-02-31 "), I.day(at("2024-02-01")), F.lit("."))
    text = F.concat(F.col("text"), extra)
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("id"),
        F.array_join(D.dates_in_text(text, F.lit("2024-06-15").cast("date"), years=(2024, 2030)), ",").alias("dates"))


@query("fn11_titled_dates", """SELECT page_id, date, title FROM (SELECT page_id, '2099-05-' || lpad((page_id % 28 + 1)::VARCHAR, 2, '0') AS a, '2099-06-' || lpad((page_id % 28 + 1)::VARCHAR, 2, '0') AS b, '2099-07-01' AS c FROM pages),
  LATERAL (SELECT * FROM (VALUES (a, 'Night & day ' || page_id), (b, 'Open stage ' || page_id || ' ' || b), (c, 'Late show'), ('2099-08-01', 'From 2099-08-01 on, ' || repeat('long ', 400) || 'talk')) v(date, title))""")
def fn11_titled(spark, d):
    """A programme in front of each page's own markup: a heading inside the entry, none, entries in entries, a long text."""
    k, day = F.col("page_id").cast("string"), F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0")
    programme = F.concat(
        F.lit("<section><h2>Programme</h2><ul><li><strong>Night &amp; day "), k, F.lit("</strong><br> le "), (F.col("page_id") % 28 + 1).cast("string"), F.lit(" May 2099</li><li>Open\n stage "), k,
        F.lit(" <i>2099-06-"), day, F.lit("</i></li></ul><div class='x event-item'><script>1/1/2099</script><p>no date</p><h3>Late show</h3><span>1/7/2099</span></div><p>From 2099-08-01 on, "),
        F.lit("long " * 400), F.lit("talk</p><li>1/9/2099<h4>abc</h4></li><p>31/2/2099</p></section>"), F.coalesce("html", F.lit("")))
    pages = table(spark, d, "pages").select("page_id", programme.alias("html"))
    return html.titled_dates(pages, as_of=F.lit("2099-05-01").cast("date"), years=(2099, 2099)).select("page_id", "date", "title")


@query("fn12_start_time", """SELECT event_id, CASE event_id % 4 WHEN 3 THEN '' WHEN 1 THEN strftime(ts, '%H') || ':00' ELSE strftime(ts, '%H:%M') END AS time FROM events""")
def fn12(spark, d):
    k, h, m = F.col("event_id") % 4, F.hour("ts").cast("string"), F.date_format("ts", "mm")
    text = (F.when(k == 0, F.concat(F.lit("Concert à "), h, F.lit("h"), m, F.lit(", entrée libre"))).when(k == 1, F.concat(F.lit("dès "), h, F.lit("h")))
            .when(k == 2, F.concat(F.lit("("), h, F.lit(":"), m, F.lit(")"))).otherwise("toute la journée 123h5"))
    return table(spark, d, "events").select("event_id", D.start_time(text).alias("time"))


PART_RULES = [(["ring", "gear"], "market"), (["hot", "cold"], "sport"), (["plate"], "family")]
DOC_RULES = [(["the", "que"], "concert"), (["nicht", "und"], "theatre")]


@query("fn13_classify", """SELECT p_partkey AS id, CASE WHEN contains(p_name, 'ring') OR contains(p_name, 'gear') THEN 'market'
  WHEN contains(p_name, 'hot') OR contains(p_name, 'cold') THEN 'sport' WHEN contains(p_name, 'plate') THEN 'family' ELSE 'other' END AS category,
  CASE WHEN contains(p_name, 'hot') OR contains(p_name, 'old') THEN 'x' ELSE 'other' END AS loose,
  CASE WHEN regexp_matches(p_name, '\\b(hot|old)\\b') THEN 'x' ELSE 'other' END AS strict FROM part""")
def fn13(spark, d):
    n = F.col("p_name")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), C.keyword_category(n, PART_RULES).alias("category"),
                                          C.keyword_category(n, [(["hot", "old"], "x")]).alias("loose"),
                                          C.keyword_category(n, [(["hot", "old"], "x")], whole_words=True).alias("strict"))


def _desc_sql() -> str:
    out = "CASE"
    for words, cat in C.DESCRIPTION_RULES:
        hits = " OR ".join("contains(t, '" + w.replace("'", "''") + "')" for w in words)
        out += f" WHEN {hits} THEN '{cat}'"
    return out + " ELSE 'other' END"


def _title_sql(rules, col: str) -> str:
    out = f"CASE WHEN regexp_matches({col}, '{C.MARKET_FIRST}') THEN 'market'"
    for words, cat in rules:
        out += " WHEN " + " OR ".join(f"contains({col}, '{w}')" for w in words) + f" THEN '{cat}'"
    return out + " END"


SYLLABLES = [c + v for c in "bcdfghjklmnprstvwxyz" for v in "aeiou"]
# 10,000 rules: every pair of syllables, in an order that is not theirs
MANY = [SYLLABLES[k // 100] + SYLLABLES[k % 100] for k in ((n * 7919) % 10000 for n in range(10000))]


@query("fn13_many_patterns", """WITH s AS (SELECT list_transform(range(100), lambda i: substr('bcdfghjklmnprstvwxyz', CAST(i // 5 + 1 AS INT), 1) || substr('aeiou', CAST(i % 5 + 1 AS INT), 1)) AS syl),
p AS (SELECT n, syl[((n * 7919) % 10000) // 100 + 1] || syl[(n * 7919) % 100 + 1] AS pattern FROM range(10000) r(n), s)
SELECT doc_id, CAST(min(n) AS INT) AS rule FROM (SELECT doc_id, lower(text) AS t FROM documents) d LEFT JOIN p ON contains(t, pattern) GROUP BY doc_id""")
def fn13_many(spark, d):
    """The first of ten thousand ordered patterns inside every whole text."""
    return table(spark, d, "documents").select("doc_id", least_pattern([F.lower("text")], MANY).alias("rule"))


@query("fn13_tiered_category", f"""WITH {I.LISTINGS}, x AS (SELECT id, lower(title) AS n, regexp_replace(lower(description), '\\s+', ' ', 'g') AS t FROM listings)
SELECT id, coalesce({_title_sql(C.LISTING_RULES, 'n')}, {_desc_sql()}) AS category FROM x""")
def fn13_tiered(spark, d):
    return I.listings(spark, d).select("id", C.tiered_category(F.col("title"), F.col("description")).alias("category"))


PLACES = ("Rivertown-le-Haut", "Rivertown", "Les Bois", "Valmont")
CODES = {"74001": "Rivertown", "74002": "Les Bois"}


@query("fn14_commune", """SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'Les Bois' WHEN 1 THEN 'Rivertown' WHEN 2 THEN 'Valmont'
  WHEN 3 THEN NULL ELSE 'Les Bois' END AS commune FROM customer""")
def fn14(spark, d):
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    addr = (F.when(k % 5 == 0, F.concat(n, F.lit(" rue A, 74009 Les Bois"))).when(k % 5 == 1, F.concat(n, F.lit(" rue B  74001 Somewhere")))
            .when(k % 5 == 2, F.concat(F.lit("Place de Valmont, "), n)).when(k % 5 == 3, F.concat(n, F.lit(" rue C, 74099 Nowhere")))
            .otherwise(F.concat(F.lit("74001 Rivertown puis "), n, F.lit(" av. D 74002"))))
    return table(spark, d, "customer").select(k.alias("id"), C.commune(addr, PLACES, CODES).alias("commune"))


@query("fn15_venue_line", """SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'Salle ' || c_nationkey WHEN 1 THEN 'Grand Vox' ELSE '' END AS venue,
  CASE c_custkey % 3 WHEN 0 THEN '74001 Rivertown' WHEN 1 THEN '74002 Les Bois' ELSE 'none' END AS postal,
  CASE c_custkey % 3 WHEN 0 THEN 'Salle ' || c_nationkey || ', ' || (c_nationkey + 1) || ' rue des Arts,' WHEN 1 THEN '22, Cours Bar' ELSE '' END AS before FROM customer""")
def fn15(spark, d):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    addr = (F.when(k % 3 == 0, F.concat(F.lit("Salle "), n.cast("string"), F.lit(", "), (n + 1).cast("string"), F.lit(" rue des Arts, 74001 Rivertown")))
            .when(k % 3 == 1, "22, Cours Bar 74002 Les Bois").otherwise("12 rue Seule"))
    return table(spark, d, "customer").select(
        k.alias("id"), C.venue_from_address(addr, {"22, cours bar": "Grand Vox"}, 60).alias("venue"),
        C.postal_line(addr, "none").alias("postal"), C.before_postcode(addr).alias("before"))


EXPECTED = {"src1": ("title", "start_date", "image_url"), "src2": ("title", "venue_name"), "src3": ("title", "start_date", "description", "price")}
_v = "(coalesce(trim({0}), '') <> '')::INT"
FILL7 = " + ".join(_v.format(c) for c in S.DISPLAY_FIELDS)


@query("fn16_confidence", f"""WITH {I.LISTINGS}, f AS (SELECT id, CASE source_id WHEN 'src1' THEN 1.0 WHEN 'src2' THEN 0.8 WHEN 'src3' THEN 0.55 ELSE 0.5 END::DOUBLE AS trust,
  (CASE source_id WHEN 'src1' THEN ({_v.format('title')} + {_v.format('start_date')} + {_v.format('image_url')}) / 3.0::DOUBLE
    WHEN 'src2' THEN ({_v.format('title')} + {_v.format('venue_name')}) / 2.0::DOUBLE
    WHEN 'src3' THEN ({_v.format('title')} + {_v.format('start_date')} + {_v.format('description')} + {_v.format('price')}) / 4.0::DOUBLE
    ELSE ({_v.format('title')} + {_v.format('start_date')}) / 2.0::DOUBLE END)::DOUBLE AS pq,
  (({FILL7}) / 7.0::DOUBLE)::DOUBLE AS c FROM listings)
SELECT id, trust, round(pq, 3) AS parse_quality, round(c, 3) AS completeness, round(trust * pq * c, 3) AS confidence FROM f""")
def fn16(spark, d):
    trust = F.when(F.col("source_id") == "src1", 1.0).when(F.col("source_id") == "src2", 0.8).when(F.col("source_id") == "src3", 0.55).otherwise(0.5)
    return S.with_confidence(I.listings(spark, d).drop("confidence"), trust, EXPECTED, components=True) \
        .select("id", "trust", "parse_quality", "completeness", "confidence")


def _esc(x: str) -> str:
    return f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query("fn17_summary", f"""WITH t AS (SELECT doc_id AS id, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS x FROM documents),
s AS (SELECT id, x, list_filter(list_transform(regexp_split_to_array(x, '[.!?\\n]+'), lambda p: trim(p)), lambda p: length(p) > 20)[1] AS f FROM t)
SELECT id, CASE WHEN x = '' THEN 'Event' WHEN f IS NULL THEN {_esc('left(x, 200)')} WHEN length(f) <= 200 THEN {_esc('f')}
  ELSE {_esc("CASE WHEN contains(left(f, 200), ' ') THEN regexp_replace(left(f, 200), ' [^ ]*$', '') ELSE left(f, 200) END || '…'")} END AS summary FROM s""")
def fn17(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), X.summary(F.col("text")).alias("summary"))


@query("fn18_range_label", f"""WITH {I.ORDERS} SELECT id, CASE WHEN start_date = end_date THEN strftime(start_date::DATE, '%b %d, %Y')
  ELSE strftime(start_date::DATE, '%b %d, %Y') || ' → ' || strftime(end_date::DATE, '%b %d, %Y') END AS label FROM ev""")
def fn18(spark, d):
    return I.dated_orders(spark, d).select("id", D.range_label(F.col("start_date"), F.col("end_date")).alias("label"))


@query("fn19_clean_text", r"""SELECT page_id AS id, regexp_replace(html, '<[^>]*>', '', 'g') AS stripped FROM pages""")
def fn19(spark, d):
    return table(spark, d, "pages").select(F.col("page_id").alias("id"), X.strip_tags(F.col("html")).alias("stripped"))


@query("fn19_clean_description", r"""WITH t AS (SELECT doc_id AS id, list_filter(list_transform(string_split(text, chr(10)),
    lambda s: trim(regexp_replace(s, '[ \t]+', ' ', 'g'))), lambda s: s <> '') AS l FROM documents)
SELECT id, array_to_string(list_concat(['# Heading'], l), chr(10) || chr(10)) AS body, 'Heading' AS heading,
  CASE WHEN length(array_to_string(l, ' ')) <= 600 THEN array_to_string(l, ' ')
    WHEN contains(left(array_to_string(l, ' '), 600), '.') THEN regexp_replace(left(array_to_string(l, ' '), 600), '\.[^.]*$', '.')
    ELSE left(array_to_string(l, ' '), 600) END AS capped FROM t""")
def fn19_description(spark, d):
    page = F.concat(F.lit("---\ntitle: x\n---\n# Heading \n"), F.col("text"), F.lit("\n74001 Les Bois"))
    body = X.clean_description(page)
    flat = F.array_join(F.slice(F.split(body, "\n\n"), 2, F.size(F.split(body, "\n\n"))), " ")
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), body.alias("body"), X.first_heading(page).alias("heading"),
                                               X.cap_at_sentence(flat, 600).alias("capped"))


@query("fn20_showtimes", f"""WITH {I.SHOWINGS}, dd AS (SELECT title, day, array_to_string(list(DISTINCT time ORDER BY time), ',') AS times FROM sh GROUP BY ALL),
m AS (SELECT title, string_agg(day || '=' || times, ';' ORDER BY day) AS showtimes, min(day) AS start_date, max(day) AS end_date FROM dd GROUP BY title),
l AS (SELECT title, string_agg(DISTINCT CASE language WHEN 'A' THEN 'VO' WHEN 'N' THEN 'Francais' ELSE 'VFST' END, '|'
  ORDER BY CASE language WHEN 'A' THEN 'VO' WHEN 'N' THEN 'Francais' ELSE 'VFST' END) AS language FROM sh GROUP BY title)
SELECT m.title, showtimes, start_date, end_date, language FROM m JOIN l ON m.title = l.title""")
def fn20(spark, d):
    s = I.showings(spark, d)
    stamp = F.concat("day", F.lit("T"), F.lpad("time", 5, "0"), F.lit(":00"))
    version = version_label(F.when(F.col("language") == "A", "En VO").when(F.col("language") == "N", "En VF").otherwise("En VFST"))
    films = stamps_to_films(s.select("title", F.col("time").alias("shown"), stamp.alias("stamp"), version.alias("version")))
    flat = F.array_join(F.transform(F.array_sort(F.map_entries("showtimes")), lambda e: F.concat(
        e["key"], F.lit("="), F.array_join(F.array_sort(F.transform(e["value"], lambda t: F.regexp_replace(t, "^0", ""))), ","))), ";")
    return films.select("title", flat.alias("showtimes"), "start_date", "end_date", "language")


@query("fn21_json_columns", """SELECT event_id AS id, CASE WHEN event_id % 6 = 0 THEN 0 ELSE 2 END AS n_days,
  CASE WHEN event_id % 6 = 0 THEN '' ELSE (props->>'$.k') || ':00' END AS first_time,
  CASE WHEN event_id % 6 = 0 THEN '{}' ELSE '{"d1":["' || (props->>'$.k') || ':00"],"d2":[]}' END AS back FROM events""")
def fn21(spark, d):
    k = F.get_json_object("props", "$.k")
    raw = F.when(F.col("event_id") % 6 == 0, "{broken").otherwise(F.concat(F.lit('{"d1":["'), k, F.lit(':00"],"d2":[]}')))
    m = X.json_map(raw)
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.size(m).cast("long").alias("n_days"),
        F.coalesce(F.get(F.try_element_at(m, F.lit("d1")), F.lit(0)), F.lit("")).alias("first_time"), F.to_json(m).alias("back"))


@query("fn22_schedules", """WITH s AS (SELECT o_orderkey AS id, ['annual','seasonal','daily','weekly','weekend','monthly','once'][(o_orderkey % 7 + 1)::INT] AS kind,
  DATE '1998-06-01' + CAST(o_orderkey % 60 AS INTEGER) AS a, DATE '1998-06-01' + CAST(o_orderkey % 60 + o_orderkey % 9 + 1 AS INTEGER) AS b FROM orders),
g AS (SELECT unnest(generate_series(0, 14))::INT AS i)
SELECT id, kind, strftime(DATE '1998-06-15' + i, '%Y-%m-%d') AS day FROM s, g WHERE
  (kind = 'annual' AND DATE '1998-06-15' + i = a) OR (kind = 'seasonal' AND DATE '1998-06-15' + i BETWEEN a AND b)
  OR (kind = 'daily' AND i IN (0, 3, 6, 9, 12)) OR (kind = 'weekly' AND i IN (0, 7)) OR (kind = 'weekend' AND i > 0 AND dayofweek(DATE '1998-06-15' + i) = 6)
  OR (kind = 'monthly' AND i = 7) OR (kind = 'once' AND i = 0)""")
def fn22(spark, d):
    k = F.col("o_orderkey")
    kind = F.get(F.array(*[F.lit(x) for x in ("annual", "seasonal", "daily", "weekly", "weekend", "monthly", "once")]), (k % 7).cast("int"))
    a = F.date_add(F.lit("1998-06-01").cast("date"), (k % 60).cast("int"))
    b = F.date_add(a, (k % 9 + 1).cast("int"))
    s = table(spark, d, "orders").select(k.alias("id"), kind.alias("kind"), a.alias("a"), b.alias("b"))
    days = D.schedule_dates(F.col("kind"), F.col("a"), F.col("b"), F.lit(I.AS_OF).cast("date"))
    return s.select("id", "kind", F.explode(days).alias("day")).withColumn("day", I.day("day"))


@query("fn22_curated_rows", """WITH e AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE 'Hall ' || (o_custkey % 20) END AS venue, CASE o_orderkey % 3 WHEN 0 THEN 'daily' END AS kind FROM orders),
g AS (SELECT unnest([0, 3, 6, 7, 9, 12]) AS i)
SELECT id, strftime(DATE '1998-06-15' + i::INT, '%Y-%m-%d') AS start_date, 'curated' AS source_id, 'Town' AS commune, round(0.8 * 1.0 * 4 / 7, 3) AS confidence FROM e, g
WHERE id % 5 > 1 AND ((kind = 'daily' AND i <> 7) OR (kind IS NULL AND i IN (0, 7)))""")
def fn22_curated(spark, d):
    """Recurring entries: no rows without a venue, weekly without a schedule, scored."""
    k, none = F.col("o_orderkey"), F.lit(None).cast("string")
    entries = table(spark, d, "orders").select(
        k.alias("id"), F.concat(F.lit("Night "), k).alias("title"), F.when(k % 5 == 1, " ").when(k % 5 > 1, F.concat(F.lit("Hall "), F.col("o_custkey") % 20)).alias("venue_name"),
        F.when(k % 3 == 0, "daily").alias("schedule"), none.alias("start_date"), none.alias("end_date"), none.alias("time"), none.alias("commune"), F.lit("text").alias("description"), F.lit("http://x").alias("source_url"))
    return curated_rows(entries, F.lit("1998-06-15").cast("date"), F.lit(0.8), commune="Town").select("id", "start_date", "source_id", "commune", "confidence")


@query("fn23_tags", """SELECT event_id AS id, CASE WHEN strftime(ts, '%Y-%m-%d') <> '2024-01-10' THEN 'later'
    WHEN hour(ts) * 60 + minute(ts) < 720 THEN 'past' WHEN abs(hour(ts) * 60 + minute(ts) - 720) <= 60 THEN 'now' ELSE 'later' END AS state,
  (1950 + event_id % 70)::INT AS year, CASE WHEN event_id % 2 = 0 THEN '+33 4 50 ' || (10 + event_id % 90) END AS phone,
  CASE WHEN event_type = 'view' THEN 'bar,events,venue' WHEN event_type = 'click' THEN 'live_music,venue' ELSE 'venue' END AS tags, event_type = 'view' AS vo FROM events""")
def fn23(spark, d):
    i = F.col("event_id")
    now = F.lit("2024-01-10 12:00:00").cast("timestamp_ntz")
    t = F.col("event_type")
    return table(spark, d, "events").select(
        i.alias("id"), C.showing_state(I.day("ts"), F.date_format("ts", "HH:mm"), now).alias("state"),
        C.title_year(F.concat(F.lit("Film ("), (1950 + i % 70).cast("string"), F.lit(")"))).alias("year"),
        C.phone_in_text(F.when(i % 2 == 0, F.concat(F.lit("Tél. +33 4 50 "), (10 + i % 90).cast("string"))).otherwise("no phone")).alias("phone"),
        F.array_join(C.venue_tags(F.when(t == "view", "The Pub").otherwise("x"), t == "click", t == "view"), ",").alias("tags"),
        C.original_version(F.when(t == "view", "VOST").otherwise("VF")).alias("vo"))
