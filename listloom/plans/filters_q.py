"""Queries over projections, filters and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from listloom.functions import classify as C
from listloom.functions import text as X
from listloom.operators import gate as G
from listloom.operators import project as P
from listloom.plans import inputs as I
from listloom.plans.registry import query, table
from listloom.plans.sinks_q import EXCLUDE


@query("flt1_canonical_rows", f"""WITH {I.LISTINGS} SELECT CASE WHEN id % 3 = 0 THEN id::VARCHAR ELSE CASE WHEN regexp_replace(lower(trim(title)), '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g') = '' THEN 'unnamed'
    ELSE regexp_replace(regexp_replace(regexp_replace(lower(trim(title)), '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g'), '[-\\s]+', '-', 'g'), '^-+|-+$', '', 'g') END || '-' || start_date END AS id,
  CASE WHEN id % 5 = 0 THEN 'default' ELSE source_id END AS source_id, title, start_date, 'other' AS category, 'Town' AS commune, 'published' AS status, 1.0::DOUBLE AS confidence,
  image_url, venue_name, '2024-06-15' AS created_at FROM listings""")
def flt1(spark, d):
    e = I.listings(spark, d)
    raw = e.select(F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).alias("id"), F.when(F.col("id") % 5 == 0, "").otherwise(F.col("source_id")).alias("source_id"),
                   "title", "start_date", "image_url", "venue_name")
    return P.canonical(raw, "2024-06-15", "default", "Town").select(
        "id", "source_id", "title", "start_date", "category", "commune", "status", "confidence", "image_url", "venue_name", "created_at")


@query("flt2_has_value", f"""WITH {I.LISTINGS} SELECT id, coalesce(trim(image_url), '') <> '' AS image, coalesce(trim(venue_name), '') <> '' AS venue,
  id % 3 <> 0 AS list_filled FROM listings""")
def flt2(spark, d):
    e = I.listings(spark, d).withColumn("l", F.when(F.col("id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("title")))
    return e.select("id", X.has_value("image_url").alias("image"), X.has_value("venue_name").alias("venue"), X.has_value("l", X.kind_of(e, "l")).alias("list_filled"))


@query("flt3_locale_fallback", f"""WITH {I.LISTINGS} SELECT id, coalesce(title, '') AS title, CASE WHEN id % 4 = 0 THEN 'FR ' || id ELSE title END AS title_fr,
  CASE WHEN id % 3 = 0 THEN 'EN ' || id ELSE title END AS title_en, CASE WHEN id % 5 = 0 THEN 'DE ' || id WHEN id % 4 = 0 THEN 'FR ' || id ELSE title END AS title_de,
  coalesce(venue_name, '') AS venue_name_de FROM listings""")
def flt3(spark, d):
    i = F.col("id")
    alt = lambda n, p: F.when(i % n == 0, F.concat(F.lit(p), i)).otherwise("")
    e = I.listings(spark, d).select("id", "title", "venue_name", alt(4, "FR ").alias("title_fr"), alt(3, "EN ").alias("title_en"), alt(5, "DE ").alias("title_de"))
    return P.localized(e, "de").select("id", "title", "title_fr", "title_en", "title_de", "venue_name_de")


@query("flt4_overlap_search", f"""WITH {I.ORDERS} SELECT id, start_date, end_date FROM ev WHERE NOT (end_date < '1998-06-15' AND start_date < '1998-06-15')
  AND end_date >= '1998-07-01' AND start_date <= '1999-03-31' AND category = '2-HIGH' AND contains(lower(venue_name), 'venue 1') AND (contains(lower(title), 'customer; 1') OR contains(lower(description), 'customer; 1'))""")
def flt4(spark, d):
    return P.overlapping(I.dated_orders(spark, d), I.AS_OF, "1998-07-01", "1999-03-31", "2-HIGH", "Venue 1", "customer; 1").select("id", "start_date", "end_date")


@query("flt5_expiry", """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE CASE WHEN l_linenumber % 3 = 0 THEN strftime(l_shipdate, '%Y-%m-%d')
  WHEN l_linenumber % 3 = 1 THEN strftime(l_shipdate + INTERVAL 20 DAY, '%Y-%m-%d') ELSE '' END >= '1998-06-15'""")
def flt5(spark, d):
    k = F.col("l_linenumber") % 3
    li = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.when(k != 2, I.day("l_shipdate")).alias("start_date"),
        F.when(k == 1, I.day(F.date_add(F.col("l_shipdate").cast("date"), 20))).otherwise("").alias("end_date"))
    return P.unexpired(li, I.AS_OF).select("l_orderkey", "l_linenumber", "l_partkey")


@query("flt6_horizon", f"""WITH {I.ORDERS} SELECT id, start_date FROM ev WHERE id % 9 <> 0 AND start_date BETWEEN '1998-06-08' AND '1999-12-07' AND start_date[1:4] IN ('1998', '1999')""")
def flt6(spark, d):
    e = I.dated_orders(spark, d).withColumn("start_date", F.when(F.col("id") % 9 == 0, "1998-13-45").otherwise(F.col("start_date")))
    return P.in_horizon(e, I.AS_OF, 7, 540, (1998, 1999)).select("id", "start_date")


@query("flt7_undated", f"""WITH {I.LISTINGS} SELECT id, CASE WHEN id % 4 = 0 THEN 'pending' ELSE 'published' END AS status,
  CASE WHEN id % 4 = 0 THEN least(confidence, 0.5) ELSE confidence END AS confidence FROM listings""")
def flt7(spark, d):
    e = I.listings(spark, d).withColumn("start_date", F.when(F.col("id") % 4 == 0, " ").otherwise(F.col("start_date")))
    return P.demote_undated(e).select("id", "status", "confidence")


@query("flt8_url_rules", r"""SELECT page_id, url FROM pages WHERE regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) NOT LIKE 'spam%' AND (contains(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/en/')
  OR contains(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/fr/')) AND regexp_extract(rtrim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), '([^/]*)$', 1) NOT IN ('25', '676', '414')
  AND regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) IN (SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) FROM pages WHERE NOT contains(url, 'spam'))""")
def flt8(spark, d):
    p = table(spark, d, "pages").withColumn("host", F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1)).where(~F.col("host").startswith("spam"))
    allowed = p.where(~F.contains("url", F.lit("spam"))).select("host").distinct()
    return P.url_filter(p, fragments=("/en/", "/fr/"), deny_last=("25", "676", "414")).join(allowed, "host", "left_semi").select("page_id", "url")


@query("flt9_generic_image", """WITH e AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'data:image/png;base64,xx' WHEN 2 THEN 'http://x/img/Fallback-Logo_2.PNG?v=1'
  WHEN 3 THEN 'http://x/placeholder.svg' ELSE 'http://x/' || page_id || '.jpg' END AS u, CASE WHEN page_id % 2 = 0 THEN 'sport' ELSE 'none' END AS c FROM pages)
SELECT page_id, CASE WHEN page_id % 5 IN (3, 4) THEN u WHEN c = 'sport' THEN 'ph/sport.jpg' END AS image FROM e""")
def flt9(spark, d):
    k = F.col("page_id")
    u = (F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, "data:image/png;base64,xx").when(k % 5 == 2, "http://x/img/Fallback-Logo_2.PNG?v=1")
         .when(k % 5 == 3, "http://x/placeholder.svg").otherwise(F.concat(F.lit("http://x/"), k, F.lit(".jpg"))))
    c = F.when(k % 2 == 0, "sport").otherwise("none")
    return table(spark, d, "pages").select("page_id", C.event_image(u, c, {"sport": "ph/sport.jpg"}).alias("image"))


@query("flt10_predicate_delete", f"WITH {I.ORDERS} SELECT id, source_id, category FROM ev WHERE NOT (source_id = 'src3' AND category = '5-LOW')")
def flt10(spark, d):
    return P.delete_where(I.dated_orders(spark, d), {"source_id": "src3", "category": "5-LOW"})[0].select("id", "source_id", "category")


GATE = f"""{I.LISTINGS}, r AS (SELECT *, CASE WHEN coalesce(confidence, 0) < 0.4 THEN 'low_confidence'
    WHEN regexp_matches(title, '(?i)^the ') THEN 'excluded_pattern:^the ' WHEN regexp_matches(title, '(?i)que$') THEN 'excluded_pattern:que$'
    WHEN regexp_matches(title, '(?i)[|]') THEN 'excluded_pattern:[|]' END AS reason0 FROM listings),
g AS (SELECT *, CASE WHEN reason0 IS NOT NULL THEN reason0 WHEN row_number() OVER (PARTITION BY reason0, lower(trim(title)), start_date, lower(coalesce(venue_name, '')) ORDER BY id) > 1 THEN 'duplicate' END AS reason FROM r)"""


@query("gate1_publish_gate", f"WITH {GATE} SELECT id, source_id, reason FROM g")
def gate1(spark, d):
    return G.publish_gate(I.listings(spark, d), "id", 0.4, EXCLUDE).select("id", "source_id", "reason")


SUBMIT = """sub AS (SELECT conv_id * 1000 + turn AS id, CASE WHEN turn = 5 THEN '   ' ELSE text END AS title,
  CASE WHEN conv_id % 6 = 0 THEN '' WHEN conv_id % 6 = 1 THEN '12/07/2024' ELSE '2024-07-' || lpad((conv_id % 5 + 10)::VARCHAR, 2, '0') END AS start_date,
  CASE role WHEN 'user' THEN ' Concert' WHEN 'system' THEN NULL ELSE 'party' END AS category, text AS description,
  CASE WHEN conv_id % 7 = 0 THEN 'nobody' WHEN conv_id % 7 = 1 THEN 'a@b' END AS contact_email FROM conversations),
val AS (SELECT id, trim(title) AS title, start_date, CASE WHEN category = ' Concert' THEN 'concert' ELSE 'other' END AS category, left(trim(description), 2000) AS description, contact_email,
  CASE WHEN trim(title) = '' THEN 'title is required' WHEN length(trim(title)) > 500 THEN 'title too long' WHEN start_date = '' THEN 'start_date is required'
    WHEN NOT regexp_matches(start_date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN 'start_date must be YYYY-MM-DD' WHEN contact_email = 'nobody' THEN 'invalid contact_email' END AS error FROM sub)"""


def submissions(spark, d):
    c = F.col("conv_id")
    none = F.lit(None).cast("string")
    return table(spark, d, "conversations").select(
        (c * 1000 + F.col("turn")).alias("id"), F.when(F.col("turn") == 5, "   ").otherwise(F.col("text")).alias("title"),
        F.when(c % 6 == 0, "").when(c % 6 == 1, "12/07/2024").otherwise(F.concat(F.lit("2024-07-"), F.lpad((c % 5 + 10).cast("string"), 2, "0"))).alias("start_date"),
        F.when(F.col("role") == "user", " Concert").when(F.col("role") != "system", "party").alias("category"), F.col("text").alias("description"),
        none.alias("time"), none.alias("venue_name"), none.alias("commune"), none.alias("contact_name"),
        F.when(c % 7 == 0, "nobody").when(c % 7 == 1, "a@b").alias("contact_email"))


@query("gate2_intake_validation", f"WITH {SUBMIT} SELECT id, title, start_date, category, description, (SELECT length(trim(s.description)) FROM sub s WHERE s.id = val.id) > 2000 AS description_cut, contact_email, error FROM val")
def gate2(spark, d):
    return G.validate_submission(submissions(spark, d), description_max=2000).select("id", "title", "start_date", "category", "description", "description_cut", "contact_email", "error")
