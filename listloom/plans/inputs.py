"""Listings, events and showings derived from the given tables, each with the same thing in SQL.

The given tables hold no event listings, so their columns are renamed and combined by fixed rules.
Every rule is applied to whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listloom.plans.registry import table

AS_OF = "1998-06-15"


def day(c) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd")


def listings(spark: SparkSession, d: str) -> DataFrame:
    """Documents as listings of their sources: the first line is the title, the language gives the date."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    i = F.col("doc_id")
    start = (F.when(F.col("lang") == "de", "2024-07-01").when(F.col("lang") == "en", "2024-07-02")
             .when(F.col("lang") == "es", "2024-07-03").otherwise("2024-07-04"))
    return docs.select(
        i.alias("id"), F.col("source").alias("source_id"), F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("description"), start.alias("start_date"),
        F.when(i % 5 == 0, day(F.date_add(start.cast("date"), (i % 9).cast("int")))).alias("end_date"),
        F.when(i % 3 == 0, "20:00").alias("time"),
        F.when(F.col("quality").isNotNull(), F.concat(F.lit("Hall "), (i % 7).cast("string"))).alias("venue_name"),
        F.when(i % 2 == 0, F.concat((i % 90 + 1).cast("string"), F.lit(" rue Haute"))).alias("address"),
        F.when(i % 4 == 0, "").when(i % 4 == 1, F.lit(None)).otherwise(F.concat(F.lit("http://img/"), i, F.lit(".jpg"))).alias("image_url"),
        F.when(i % 6 == 0, "12 EUR").alias("price"), F.lit("other").alias("category"), F.col("lang").alias("commune"),
        F.concat(F.lit("http://"), F.col("source"), F.lit("/"), i).alias("source_url"), F.lit("published").alias("status"),
        F.round(F.lit(0.4) + F.col("quality") * 0.5 - F.col("toxic") * 0.2, 2).alias("confidence"),
        F.col("n_chars"), F.col("lang"))


LISTINGS = """listings AS (
  SELECT d.doc_id AS id, source AS source_id, split_part(text, chr(10), 1) AS title, text AS description,
    CASE lang WHEN 'de' THEN '2024-07-01' WHEN 'en' THEN '2024-07-02' WHEN 'es' THEN '2024-07-03' ELSE '2024-07-04' END AS start_date,
    CASE WHEN d.doc_id % 5 = 0 THEN strftime(CAST(CASE lang WHEN 'de' THEN '2024-07-01' WHEN 'en' THEN '2024-07-02'
      WHEN 'es' THEN '2024-07-03' ELSE '2024-07-04' END AS DATE) + CAST(d.doc_id % 9 AS INTEGER), '%Y-%m-%d') END AS end_date,
    CASE WHEN d.doc_id % 3 = 0 THEN '20:00' END AS time,
    CASE WHEN quality IS NOT NULL THEN 'Hall ' || (d.doc_id % 7) END AS venue_name,
    CASE WHEN d.doc_id % 2 = 0 THEN (d.doc_id % 90 + 1) || ' rue Haute' END AS address,
    CASE WHEN d.doc_id % 4 = 0 THEN '' WHEN d.doc_id % 4 = 1 THEN NULL ELSE 'http://img/' || d.doc_id || '.jpg' END AS image_url,
    CASE WHEN d.doc_id % 6 = 0 THEN '12 EUR' END AS price, 'other' AS category, lang AS commune,
    'http://' || source || '/' || d.doc_id AS source_url, 'published' AS status,
    round(0.4 + quality * 0.5 - toxic * 0.2, 2)::DOUBLE AS confidence, n_chars, lang
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

# SQL of the normalised title over a text expression; the test titles hold Latin letters only.
def sql_norm(x: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(regexp_replace(strip_accents(lower(trim(coalesce({x}, '')))), "
            f"'[—–’‘\"'':\\\\/]+', '', 'g'), '[^\\p{{L}}\\p{{N}}_\\s|-]', '', 'g'), '\\s+', ' ', 'g'))")


def dated_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders as events with a start, an end up to nine days later, a venue, a place and a score."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, d, "orders").select(
        k.alias("id"), F.concat(F.lit("Event "), (c % 97).cast("string")).alias("title"),
        day("o_orderdate").alias("start_date"), day(F.date_add(F.col("o_orderdate").cast("date"), (k % 10).cast("int"))).alias("end_date"),
        F.concat(F.lit("src"), (k % 12).cast("string")).alias("source_id"),
        F.when(k % 8 == 0, F.lit(None)).otherwise(F.concat(F.lit("Venue "), (c % 40).cast("string"))).alias("venue_name"),
        F.col("o_orderpriority").alias("category"), F.concat(F.lit("Place "), (c % 5).cast("string")).alias("commune"),
        F.when(F.col("o_orderstatus") == "F", "published").when(F.col("o_orderstatus") == "O", "open").otherwise("pending").alias("status"),
        F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("http://img/"), k, F.lit(".png"))).alias("image_url"),
        F.concat(F.lit("Order, of customer; "), c, F.lit("\nsecond line")).alias("description"),
        F.concat(F.lit("http://site/"), k).alias("source_url"),
        ((k % 101) / 100.0).cast("double").alias("confidence"), "o_totalprice", "o_custkey")


ORDERS = """ev AS (
  SELECT o_orderkey AS id, 'Event ' || (o_custkey % 97) AS title, strftime(o_orderdate, '%Y-%m-%d') AS start_date,
    strftime(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 10 AS INTEGER), '%Y-%m-%d') AS end_date,
    'src' || (o_orderkey % 12) AS source_id,
    CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE 'Venue ' || (o_custkey % 40) END AS venue_name,
    o_orderpriority AS category, 'Place ' || (o_custkey % 5) AS commune,
    CASE o_orderstatus WHEN 'F' THEN 'published' WHEN 'O' THEN 'open' ELSE 'pending' END AS status,
    CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'http://img/' || o_orderkey || '.png' END AS image_url,
    'Order, of customer; ' || o_custkey || chr(10) || 'second line' AS description,
    'http://site/' || o_orderkey AS source_url,
    ((o_orderkey % 101) / 100.0)::DOUBLE AS confidence, o_totalprice, o_custkey
  FROM orders)"""


def showings(spark: SparkSession, d: str) -> DataFrame:
    """Line items as film showings: the part's film, the ship day, a time from the line."""
    key, line, part = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")
    hour, minute = (9 + (key + line * 3) % 14), (F.col("l_suppkey") % 4) * 15
    return table(spark, d, "lineitem").select(
        F.concat(F.lit("Film "), (part % 50).cast("string")).alias("title"), day("l_shipdate").alias("day"),
        F.concat(hour.cast("string"), F.lit(":"), F.lpad(minute.cast("string"), 2, "0")).alias("time"),
        (key * 1000000 + part * 10 + line).alias("position"), F.col("l_returnflag").alias("language"),
        F.col("l_linestatus").alias("version"), part.alias("part"))


SHOWINGS = """sh AS (
  SELECT 'Film ' || (l_partkey % 50) AS title, strftime(l_shipdate, '%Y-%m-%d') AS day,
    (9 + (l_orderkey + l_linenumber * 3) % 14) || ':' || lpad(((l_suppkey % 4) * 15)::VARCHAR, 2, '0') AS time,
    l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS position, l_returnflag AS language,
    l_linestatus AS version, l_partkey AS part
  FROM lineitem)"""


def snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Customers as two successive snapshots of listings; some vanish, some appear, some change."""
    k = F.col("c_custkey")
    base = table(spark, d, "customer").select(
        k.alias("position"), k.cast("string").alias("id"), F.col("c_mktsegment").alias("source_id"), F.col("c_name").alias("title"),
        F.concat(F.lit("2024-0"), (k % 9 + 1).cast("string"), F.lit("-15")).alias("start_date"),
        F.concat(F.lit("Salle "), F.col("c_nationkey").cast("string")).alias("venue_name"),
        F.concat(F.lit("text "), k).alias("description"), F.when(k % 3 == 0, F.concat(F.lit("EN "), k)).alias("title_en"),
        F.lit("published").alias("status"), F.round(F.col("c_acctbal"), 2).alias("confidence"),
        F.lit("2024-01-01").alias("created_at"), F.lit("2024-01-01").alias("updated_at"))
    old = base.where(k % 4 != 0)
    new = base.where(k % 4 != 1).withColumns({
        "description": F.concat("description", F.lit(" v2")), "title_en": F.when(F.col("position") % 7 == 0, F.lit("")),
        "created_at": F.lit("2024-02-01"), "confidence": F.round(F.col("confidence") + 1, 2)})
    return old, new


SNAPSHOTS = """base AS (
  SELECT c_custkey AS position, c_custkey::VARCHAR AS id, c_mktsegment AS source_id, c_name AS title,
    '2024-0' || (c_custkey % 9 + 1) || '-15' AS start_date, 'Salle ' || c_nationkey AS venue_name,
    'text ' || c_custkey AS description, CASE WHEN c_custkey % 3 = 0 THEN 'EN ' || c_custkey END AS title_en,
    'published' AS status, round(c_acctbal, 2) AS confidence, '2024-01-01' AS created_at, '2024-01-01' AS updated_at
  FROM customer),
old AS (SELECT * FROM base WHERE position % 4 <> 0),
new AS (SELECT position, id, source_id, title, start_date, venue_name, description || ' v2' AS description,
    CASE WHEN position % 7 = 0 THEN '' END AS title_en, status, round(confidence + 1, 2) AS confidence,
    '2024-02-01' AS created_at, updated_at FROM base WHERE position % 4 <> 1)"""


def queue(spark: SparkSession, d: str) -> DataFrame:
    """Events as a review queue with a score from the value and a small snapshot."""
    i = F.col("event_id")
    score = F.least(F.round(F.col("value") / 100, 2), F.lit(1.0))
    snap = F.to_json(F.struct(F.concat(F.lit("Case "), i % 300).alias("title"), day(F.date_add(F.col("ts").cast("date"), (i % 40).cast("int"))).alias("start_date"),
                              F.col("event_type").alias("source_id"), score.alias("confidence"), F.concat(F.lit("e"), i % 700).alias("id")))
    return table(spark, d, "events").select(
        i.cast("string").alias("id"), F.concat(F.lit("e"), (i % 700).cast("string")).alias("event_id"), F.col("event_type").alias("source_id"),
        F.lit("low_confidence").alias("reason"), snap.alias("event_snapshot"), score.alias("confidence"),
        F.when(i % 10 == 3, "approved").when(i % 10 == 4, "rejected").otherwise("open").alias("status"),
        F.lit(None).cast("string").alias("notes"), F.lit(None).cast("string").alias("reviewed_by"),
        F.lit(None).cast("string").alias("reviewed_at"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


QUEUE = """q AS (
  SELECT event_id::VARCHAR AS id, 'e' || (event_id % 700) AS event_id, event_type AS source_id, 'low_confidence' AS reason,
    'Case ' || (event_id % 300) AS s_title, strftime(CAST(ts AS DATE) + CAST(event_id % 40 AS INTEGER), '%Y-%m-%d') AS s_date,
    least(round(value / 100, 2), 1.0)::DOUBLE AS confidence,
    CASE event_id % 10 WHEN 3 THEN 'approved' WHEN 4 THEN 'rejected' ELSE 'open' END AS status,
    NULL::VARCHAR AS notes, NULL::VARCHAR AS reviewed_by, NULL::VARCHAR AS reviewed_at,
    strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at
  FROM events)"""
