"""Queries over lookup, enrichment and difference joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from listloom.functions import classify as C
from listloom.functions import text as X
from listloom.operators import joins as J
from listloom.plans import inputs as I
from listloom.plans.registry import query, table
from listloom.session import fresh_path


@query("jn1_registry_lookup", """WITH r AS (SELECT 'src' || (s_suppkey % 15) AS id, min(s_suppkey) AS k FROM supplier GROUP BY 1)
SELECT doc_id AS id, CASE WHEN k IS NULL THEN 0.5 WHEN k % 4 = 0 THEN 1.0 WHEN k % 4 = 1 THEN 0.8 WHEN k % 4 = 2 THEN 0.55 ELSE 0.5 END::DOUBLE AS baseline,
  CASE WHEN k % 3 = 0 THEN 0.7 ELSE 0.6 END::DOUBLE AS threshold, coalesce(k % 2 = 0, false) AS active FROM documents d LEFT JOIN r ON d.source = r.id""")
def jn1(spark, d):
    k = F.col("k")
    r = table(spark, d, "supplier").groupBy(F.concat(F.lit("src"), (F.col("s_suppkey") % 15).cast("string")).alias("id")).agg(F.min("s_suppkey").alias("k"))
    reg = r.select("id", F.when(k % 4 == 0, "high").when(k % 4 == 1, "medium").when(k % 4 == 2, "low").otherwise("odd").alias("trust_level"),
                   F.when(k % 3 == 0, 0.7).alias("min_publish_confidence"), (k % 2 == 0).alias("active"))
    looked = J.registry_lookup(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("source_id")), reg)
    on = reg.where("active").select(F.col("id").alias("source_id"), F.lit(True).alias("active"))
    return looked.join(on, "source_id", "left").select("id", "baseline", "threshold", F.coalesce("active", F.lit(False)).alias("active"))


@query("jn2_name_join", f"""WITH {I.ORDERS}, v AS (SELECT 'Venue ' || (s_suppkey % 50) AS name, CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal END AS lat FROM supplier)
SELECT category, count(*) AS n FROM ev WHERE venue_name IN (SELECT name FROM v WHERE lat IS NOT NULL) GROUP BY category""")
def jn2(spark, d):
    k = F.col("s_suppkey")
    v = table(spark, d, "supplier").select(F.concat(F.lit("Venue "), (k % 50).cast("string")).alias("name"),
                                           F.when(k % 3 != 0, F.col("s_acctbal")).alias("latitude"), F.lit(1.0).alias("longitude"))
    return J.resolved_by_name(I.dated_orders(spark, d), v).groupBy("category").agg(F.count("*").alias("n"))


def _details(spark, d):
    """Every third document as a detail page under a reshaped title."""
    i = F.col("doc_id")
    return table(spark, d, "documents").where(i % 3 != 1).select(
        i.alias("pos"), F.concat(F.lower(F.split("text", "\n")[0]), F.lit(" !")).alias("title"), F.concat(F.lit("addr "), i).alias("address"),
        F.when(i % 2 == 0, F.concat(F.lit("http://d/"), i, F.lit(".jpg"))).alias("image_url"))


@query("jn3_fill_by_title", f"""WITH {I.LISTINGS}, dt AS (SELECT doc_id AS pos, lower(trim(regexp_replace(strip_accents(lower(split_part(text, chr(10), 1)) || ' !'), '[^a-zA-Z0-9\\s]', '', 'g'))) AS k,
  'addr ' || doc_id AS address, CASE WHEN doc_id % 2 = 0 THEN 'http://d/' || doc_id || '.jpg' END AS image_url FROM documents WHERE doc_id % 3 <> 1),
dd AS (SELECT * FROM dt WHERE k <> '' QUALIFY row_number() OVER (PARTITION BY k ORDER BY pos DESC) = 1)
SELECT l.id, coalesce(nullif(trim(l.address), ''), dd.address) AS address, CASE WHEN coalesce(trim(l.image_url), '') = '' AND dd.image_url IS NOT NULL THEN dd.image_url ELSE l.image_url END AS image_url,
  (l.address IS NULL AND dd.address IS NOT NULL) OR (coalesce(l.image_url, '') = '' AND dd.image_url IS NOT NULL) AS changed
FROM listings l LEFT JOIN dd ON lower(trim(regexp_replace(strip_accents(title), '[^a-zA-Z0-9\\s]', '', 'g'))) = dd.k""")
def jn3(spark, d):
    return J.enrich_by_title(I.listings(spark, d), _details(spark, d), ["address", "image_url"], "pos").select("id", "address", "image_url", "changed")


_url = "regexp_replace(regexp_replace(lower(replace(trim({0}), 'http://', 'https://')), '/+$', ''), '[?#].*$', '')"


@query("jn4_fill_by_url", f"""WITH l AS (SELECT page_id AS id, {_url.format('url')} AS k, CASE WHEN page_id % 2 = 0 THEN 'own' END AS description FROM pages),
dt AS (SELECT page_id AS pos, {_url.format("upper(url) || '?x=1'")} AS k, CASE WHEN page_id % 3 = 0 THEN '' ELSE 'detail ' || page_id END AS description FROM pages),
dd AS (SELECT * FROM dt QUALIFY row_number() OVER (PARTITION BY k ORDER BY pos) = 1)
SELECT id, CASE WHEN l.description IS NULL AND dd.description <> '' THEN dd.description ELSE l.description END AS description,
  l.description IS NULL AND coalesce(dd.description, '') <> '' AS changed FROM l LEFT JOIN dd ON l.k = dd.k""")
def jn4(spark, d):
    p, k = table(spark, d, "pages"), F.col("page_id")
    left = p.select(k.alias("id"), F.col("url").alias("source_url"), F.when(k % 2 == 0, "own").alias("description"))
    right = p.select(k.alias("pos"), F.concat(F.upper("url"), F.lit("?x=1")).alias("source_url"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("detail "), k)).alias("description"))
    return J.enrich_by_url(left, right, ["description"], "pos").select("id", "description", "changed")


# films: parts named after themselves; incoming: the same names, some written differently
@query("jn5_two_tier", """WITH s AS (SELECT p_partkey AS id, p_name || ' ' || (p_partkey % 300) AS title, CASE WHEN p_partkey % 2 = 0 THEN 'img' END AS image_url FROM part),
f AS (SELECT title, min(id) AS target FROM s GROUP BY title),
i AS (SELECT p_partkey AS ip, p_name || ' ' || (p_partkey % 300) AS title, CASE WHEN p_partkey % 3 <> 0 THEN 'new ' || p_partkey END AS image_url FROM part WHERE p_partkey % 5 <> 0),
g AS (SELECT target, arg_min(image_url, ip) FILTER (image_url IS NOT NULL) AS image_url FROM i JOIN f USING (title) GROUP BY target)
SELECT s.id, CASE WHEN s.image_url IS NULL AND g.image_url IS NOT NULL THEN g.image_url ELSE s.image_url END AS image_url, s.image_url IS NULL AND g.image_url IS NOT NULL AS changed
FROM s LEFT JOIN g ON s.id = g.target""")
def jn5(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey")
    title = F.concat("p_name", F.lit(" "), (k % 300).cast("string"))
    store = p.select(k.alias("id"), title.alias("title"), F.when(k % 2 == 0, "img").alias("image_url"))
    spelled = F.when(k % 2 == 1, F.concat(F.upper(title), F.lit(" (!)"))).otherwise(title)
    inc = p.where(k % 5 != 0).select(k.alias("ip"), spelled.alias("title"), F.when(k % 3 != 0, F.concat(F.lit("new "), k)).alias("image_url"))
    return J.enrich_two_tier(store, inc, ["image_url"], "id", "ip").select("id", "image_url", "changed")


@query("jn6_carry_forward", f"""WITH {I.SNAPSHOTS} SELECT n.id, coalesce(nullif(n.title_en, ''), nullif(o.title_en, ''), n.title_en) AS title_en FROM new n LEFT JOIN old o ON n.id = o.id""")
def jn6(spark, d):
    old, new = I.snapshots(spark, d)
    return J.carry_forward(new, old, "id", ["title_en"]).select("id", "title_en")


@query("jn7_gap_fill", f"""WITH {I.ORDERS}, p AS (SELECT id, venue_name, start_date FROM ev WHERE id % 2 = 0), s AS (SELECT id, venue_name, start_date FROM ev WHERE id % 2 = 1)
SELECT * FROM p UNION ALL SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.venue_name = s.venue_name AND p.start_date = s.start_date)""")
def jn7(spark, d):
    e = I.dated_orders(spark, d).select("id", "venue_name", "start_date")
    return J.gap_fill(e.where("id % 2 = 0"), e.where("id % 2 = 1"), ["venue_name", "start_date"])


@query("jn8_detail_over_listing", """SELECT page_id AS id, CASE WHEN page_id % 3 = 0 AND page_id % 2 = 0 THEN regexp_extract(html, '<html lang="([a-z]+)"', 1) ELSE 'listing' END AS title,
  CASE WHEN page_id % 2 = 0 AND page_id % 5 <> 0 THEN 'sport' ELSE 'market' END AS category FROM pages""")
def jn8(spark, d):
    p, k = table(spark, d, "pages"), F.col("page_id")
    listing = p.select(k.alias("id"), F.lit("listing").alias("title"), F.lit("market").alias("category"))
    detail = p.where(k % 2 == 0).select(k.alias("id"), F.when(k % 3 == 0, F.regexp_extract("html", '<html lang="([a-z]+)"', 1)).otherwise("").alias("title"),
                                        F.when(k % 5 == 0, "other").otherwise("sport").alias("category"))
    return J.detail_over_listing(listing, detail, "id", ["title"]).select("id", "title", "category")


@query("jn9_curation_overlay", """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 2 = 0 AND s_suppkey % 8 <> 0 THEN 45.0 + s_nationkey WHEN s_suppkey % 3 <> 0 THEN s_acctbal END::DOUBLE AS latitude,
  CASE WHEN s_suppkey % 7 = 0 THEN 'manual' WHEN s_suppkey % 2 = 0 AND s_suppkey % 8 <> 0 THEN 'refined' WHEN s_suppkey % 3 <> 0 THEN 'stored' END AS coordinate_source,
  CASE WHEN s_suppkey % 5 = 0 THEN '74' || s_suppkey ELSE 'old' END AS postal_code FROM supplier""")
def jn9(spark, d):
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    venues = s.select(k.alias("id"), F.when(k % 3 != 0, F.col("s_acctbal")).alias("latitude"), F.when(k % 3 != 0, F.lit(6.5)).alias("longitude"),
                      F.lit("old").alias("postal_code"))
    zero = k % 8 == 0
    refined = s.where(k % 2 == 0).select(k.alias("id"), F.when(zero, 0.0).otherwise(45.0 + F.col("s_nationkey")).alias("latitude"), F.when(zero, 0.0).otherwise(6.0).alias("longitude"))
    curated = s.where(k % 5 < 2).select(k.alias("id"), F.when(k % 5 == 0, F.concat(F.lit("74"), k)).otherwise(" ").alias("postal_code"))
    return J.curation_overlay(venues, refined, s.where(k % 7 == 0).select(k.alias("id")), curated, ["postal_code"]).select("id", "latitude", "coordinate_source", "postal_code")


PATTERNS = (("hot r", "Boiler House"), ("ring", "Ring Hall"), ("gear", "Gear Works"), ("old", "Museum"), ("bol", "Bolt Barn"))


@query("jn10_ordered_patterns", """SELECT p_partkey AS id, CASE WHEN contains(p_name, 'hot r') THEN 'Boiler House' WHEN contains(p_name, 'ring') THEN 'Ring Hall' WHEN contains(p_name, 'gear') THEN 'Gear Works'
  WHEN contains(p_name, 'old') THEN 'Museum' WHEN contains(p_name, 'bol') THEN 'Bolt Barn' WHEN p_size > 40 THEN 'Big Tent' WHEN p_partkey % 4 = 0 THEN p_brand ELSE 'Town' END AS venue FROM part""")
def jn10(spark, d):
    k = F.col("p_partkey")
    own = F.when(k % 4 == 0, F.col("p_brand")).when(k % 4 == 1, "http://x").otherwise("")
    return table(spark, d, "part").select(k.alias("id"), C.resolve_venue(own, F.upper("p_name"), F.lit(None).cast("string"), PATTERNS,
                                                                         rules=[(F.col("p_size") > 40, "Big Tent")], default="Town").alias("venue"))


@query("jn12_unseen", """WITH k AS (SELECT event_id, event_type || '|case ' || (event_id % 4000) AS key FROM events), seen AS (SELECT DISTINCT event_type || '|case ' || (event_id % 4000) AS key FROM events WHERE user_id % 3 = 0)
SELECT event_id, (SELECT count(DISTINCT key) FROM k) AS n_seen_after FROM k WHERE key NOT IN (SELECT key FROM seen)""")
def jn12(spark, d):
    i = F.col("event_id")
    e = table(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("source_id"), F.concat(F.lit(" Case "), (i % 4000).cast("string")).alias("title"))
    key = F.concat_ws("|", "source_id", F.lower(F.trim("title")))
    fresh, grown = J.unseen(e, e.where("user_id % 3 = 0").select(key.alias("key")).distinct(), key)
    path = fresh_path(spark, "seen")
    grown.write.parquet(path)
    return fresh.select("event_id", F.lit(spark.read.parquet(path).count()).alias("n_seen_after"))


@query("jn13_orphans", "SELECT DISTINCT l_orderkey AS slug FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def jn13(spark, d):
    published = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("slug"))
    return J.orphans(published, table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("slug")), "slug")


EXTRACT = """x AS (SELECT page_id, length(regexp_replace(regexp_extract(html, '<body>(.*)</body>', 1, 's'), '<[^>]*>', '', 'g')) AS len_old,
  length(array_to_string(regexp_extract_all(html, '<p>([^<]*)</p>', 1), '')) AS len_new FROM pages)"""


def _compared(spark, d):
    p = table(spark, d, "pages")
    old = p.select("page_id", X.strip_tags(F.regexp_extract("html", "(?s)<body>(.*)</body>", 1)).alias("text"))
    new = p.select("page_id", F.array_join(F.regexp_extract_all("html", F.lit("<p>([^<]*)</p>"), 1), "").alias("text"))
    return J.compare_extractions(old, new, "page_id", "text")


@query("jn14_extraction_parity", f"WITH {EXTRACT} SELECT page_id, len_old, len_new, len_old > 0 AND len_new < len_old * 0.5 AS regression, len_new >= 120 AS long_enough FROM x")
def jn14(spark, d):
    return _compared(spark, d)


@query("jn14_parity_verdict", f"""WITH {EXTRACT} SELECT count(*) AS n, count(*) FILTER (len_old > 0 AND len_new < len_old * 0.5) AS regressions, NOT bool_or(len_old > 0 AND len_new < len_old * 0.5) AS passed,
  round(avg((len_new >= 120)::INT), 4) AS long_share, round(avg(len_old), 4) AS mean_old, round(avg(len_new), 4) AS mean_new FROM x""")
def jn14_verdict(spark, d):
    return J.comparison_verdict(_compared(spark, d))


@query("jn15_work_queue", f"""WITH {I.LISTINGS} SELECT id FROM listings WHERE coalesce(image_url, '') = '' AND id NOT IN (SELECT doc_id FROM labels)""")
def jn15(spark, d):
    cache = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("image_url"))
    return J.pending_work(I.listings(spark, d), cache, "id", ~X.has_value("image_url")).select("id")


@query("jn15_merge_results", f"""WITH {I.LISTINGS}, r AS (SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'http://r/' || doc_id ELSE ' ' END AS v FROM labels)
SELECT l.id, CASE WHEN coalesce(image_url, '') = '' AND trim(v) <> '' THEN v ELSE image_url END AS image_url, coalesce(coalesce(image_url, '') = '' AND trim(v) <> '', false) AS changed FROM listings l LEFT JOIN r ON l.id = r.id""")
def jn15_merge(spark, d):
    k = F.col("doc_id")
    r = table(spark, d, "labels").select(k.alias("id"), F.when(F.col("quality") == 1, F.concat(F.lit("http://r/"), k)).otherwise(" ").alias("image_url"))
    return J.merge_results(I.listings(spark, d), r, "id", ["image_url"]).select("id", "image_url", "changed")


@query("set1_union", """SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier""")
def set1(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return c.unionByName(table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")), allowMissingColumns=True)


@query("set2_difference", """SELECT o_orderkey AS key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def set2(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("key")).exceptAll(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key")).distinct())


