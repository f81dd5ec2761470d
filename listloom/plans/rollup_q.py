"""Queries over counts, rollups, calendars and quality gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from listloom.operators import coverage as V
from listloom.operators import rollup as R
from listloom.plans import inputs as I
from listloom.plans.registry import query, table


@query("agg1_table_counts", "SELECT 'orders' AS table_name, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'events', count(*) FROM events")
def agg1(spark, d):
    return R.table_counts(**{t: table(spark, d, t) for t in ("orders", "lineitem", "supplier", "events")})


@query("agg1_status_counts", f"WITH {I.QUEUE}, w AS (SELECT unnest(['open', 'approved', 'rejected', 'parked']) AS status) SELECT w.status, count(q.id) AS n FROM w LEFT JOIN q ON w.status = q.status GROUP BY w.status")
def agg1_status(spark, d):
    return R.status_counts(I.queue(spark, d), ("open", "approved", "rejected", "parked"))


@query("agg1_group_counts", f"WITH {I.QUEUE} SELECT source_id, count(*) AS n FROM q GROUP BY source_id")
def agg1_groups(spark, d):
    return R.group_counts(I.queue(spark, d), "source_id")


@query("agg1_trust_summary", """WITH w AS (SELECT unnest(['high', 'medium', 'low']) AS t), r AS (SELECT CASE s_suppkey % 2 WHEN 0 THEN 'high' ELSE 'low' END AS t FROM supplier WHERE s_suppkey % 3 = 0)
SELECT w.t AS trust_level, count(r.t) AS n FROM w LEFT JOIN r ON w.t = r.t GROUP BY w.t""")
def agg1_trust(spark, d):
    k = F.col("s_suppkey")
    return R.trust_summary(table(spark, d, "supplier").select(F.when(k % 2 == 0, "high").otherwise("low").alias("trust_level"), (k % 3 == 0).alias("active")))


@query("agg2_score_histogram", """WITH s AS (SELECT coalesce(CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount * 10 END, 0) AS s FROM lineitem)
SELECT count(*) FILTER (s < 0.2) AS bin_00_02, count(*) FILTER (s >= 0.2 AND s < 0.4) AS bin_02_04, count(*) FILTER (s >= 0.4 AND s < 0.6) AS bin_04_06, count(*) FILTER (s >= 0.6 AND s < 0.8) AS bin_06_08,
  count(*) FILTER (s >= 0.8) AS bin_08_10, count(*) AS total, round(sum(s) / count(*), 3) AS mean, round(least(min(s), 1.0), 3)::DOUBLE AS least, round(greatest(max(s), 0.0), 3)::DOUBLE AS greatest FROM s""")
def agg2(spark, d):
    return R.score_histogram(table(spark, d, "lineitem").select(F.when(F.col("l_linenumber") != 3, F.col("l_discount") * 10).alias("confidence")))


@query("agg3_length_coverage", "SELECT count(*) FILTER (length(trim(text)) >= 120) AS with_text, count(*) AS total FROM documents")
def agg3(spark, d):
    return R.length_coverage(table(spark, d, "documents"), "text")


_v = "(coalesce(trim({0}), '') <> '')"


@query("agg4_coverage_gate", f"""WITH {I.LISTINGS}, b AS (SELECT source_id AS scope, * FROM listings WHERE id % 11 <> 0 UNION ALL SELECT '*' AS scope, * FROM listings WHERE id % 11 <> 0),
a AS (SELECT scope, count(*) AS n, 100.0 * count(*) FILTER ({_v.format('title')} AND {_v.format('start_date')}) / count(*) AS p1, 100.0 * count(*) FILTER ({_v.format('source_url')}) / count(*) AS p2,
  100.0 * count(*) FILTER ({_v.format('venue_name')} AND {_v.format('description')}) / count(*) AS p3, 100.0 * count(*) FILTER ({_v.format('image_url')}) / count(*) AS p4 FROM b GROUP BY scope)
SELECT scope, n, round(p1, 2)::DOUBLE AS title_date_pct, round(p2, 2)::DOUBLE AS url_pct, round(p3, 2)::DOUBLE AS venue_text_pct, round(p4, 2)::DOUBLE AS image_pct, p1 >= 100 AND p2 >= 100 AND p3 >= 95 AND p4 >= 95 AS passed FROM a""")
def agg4(spark, d):
    return V.content_coverage(I.listings(spark, d).withColumn("absent_since", F.when(F.col("id") % 11 == 0, "2024-01-01")))


@query("agg5_film_gate", """WITH f AS (SELECT CASE WHEN l_linenumber = 5 THEN '' ELSE 'i' END AS i, CASE WHEN l_quantity < 3 THEN NULL ELSE 'd' END AS t, strftime(l_shipdate, '%Y-%m-%d') AS e FROM lineitem)
SELECT count(*) AS n, round(100.0 * count(*) FILTER (i <> '') / count(*), 2)::DOUBLE AS image_pct, round(100.0 * count(*) FILTER (t IS NOT NULL) / count(*), 2)::DOUBLE AS text_pct,
  count(*) FILTER (e < '1998-06-15') AS stale, false AS passed, false AS empty FROM f""")
def agg5(spark, d):
    f = table(spark, d, "lineitem").select(F.when(F.col("l_linenumber") == 5, "").otherwise("i").alias("image_url"), F.when(F.col("l_quantity") >= 3, "d").alias("description"), I.day("l_shipdate").alias("end_date"))
    return V.film_completeness(f, I.AS_OF)


VENUES = """v AS (SELECT 'Venue ' || (c_custkey % 60) AS name, CASE WHEN c_custkey % 60 % 5 = 0 THEN NULL WHEN c_custkey % 60 % 7 = 0 THEN 0.0 ELSE 45.0 + (c_custkey % 60) / 10.0 END::DOUBLE AS latitude,
  CASE WHEN c_custkey % 60 % 7 = 0 THEN 0.0 ELSE 6.0 + (c_custkey % 60) / 20.0 END::DOUBLE AS longitude FROM customer)"""


def _venues(spark, d):
    k = F.col("c_custkey") % 60
    return table(spark, d, "customer").select(
        F.concat(F.lit("Venue "), k.cast("string")).alias("name"), F.when(k % 5 == 0, F.lit(None)).when(k % 7 == 0, 0.0).otherwise(45.0 + k / 10.0).cast("double").alias("latitude"),
        F.when(k % 7 == 0, 0.0).otherwise(6.0 + k / 20.0).cast("double").alias("longitude"))


@query("agg6_mappability", f"""WITH {I.ORDERS}, {VENUES}, a AS (SELECT count(*) AS active, count(venue_name) AS with_venue, count(*) FILTER (venue_name IN (SELECT name FROM v WHERE latitude IS NOT NULL AND longitude IS NOT NULL)) AS resolved FROM ev)
SELECT active, with_venue, resolved, (SELECT count(*) FROM v WHERE latitude <> 0 AND longitude <> 0) AS venues_located, round(100.0 * resolved / active, 2)::DOUBLE AS mappable_pct, 100.0 * resolved / active >= 70 AS passed FROM a""")
def agg6(spark, d):
    return V.mappability(I.dated_orders(spark, d), _venues(spark, d))


@query("agg7_venue_rollup", f"""WITH {I.ORDERS}, r AS (SELECT venue_name AS venue, count(*) AS n, array_to_string(list_sort(list_distinct(list(category))), ',') AS categories, arg_min(image_url, id) FILTER (image_url <> '') AS image, min(id) AS first_position FROM ev WHERE venue_name IS NOT NULL GROUP BY 1),
ref AS (SELECT DISTINCT 'Venue ' || (s_suppkey % 60) AS name FROM supplier)
SELECT coalesce(name, venue) AS venue, coalesce(n, 0) AS n, coalesce(categories, 'curated') AS categories, coalesce(image, '') AS image, first_position, name IS NOT NULL AS curated FROM r FULL JOIN ref ON venue = name""")
def agg7(spark, d):
    ref = table(spark, d, "supplier").select(F.concat(F.lit("Venue "), (F.col("s_suppkey") % 60).cast("string")).alias("name"), F.array(F.lit("curated")).alias("categories"),
                                             F.lit("Hall").alias("type"), F.lit("Centre").alias("location")).distinct()
    e = I.dated_orders(spark, d).withColumn("venue", F.col("venue_name"))
    return R.venue_rollup(e, ref, "id").select("venue", "n", F.array_join("categories", ",").alias("categories"), "image", "first_position", "curated")


@query("agg7_venue_positions", f"WITH {I.ORDERS} SELECT venue_name AS venue, id AS position FROM ev WHERE venue_name IS NOT NULL")
def agg7_positions(spark, d):
    return R.venue_positions(I.dated_orders(spark, d).withColumn("venue", F.col("venue_name")), "id")


@query("agg8_active_venues", f"WITH {I.ORDERS} SELECT venue_name, count(*) AS n FROM ev WHERE end_date >= '{I.AS_OF}' AND venue_name IS NOT NULL GROUP BY venue_name")
def agg8(spark, d):
    return R.active_venues(I.dated_orders(spark, d), I.AS_OF)


# 1998-06-15 is a Monday, 1998-06-21 a Sunday
@query("agg9_calendar_counters", f"""WITH {I.ORDERS} SELECT '1998-06-15' AS as_of, false AS overlap, count(*) FILTER (start_date BETWEEN '1998-06-15' AND '1998-06-21') AS week, count(*) FILTER (start_date = '1998-06-15') AS today, count(*) FILTER (start_date IN ('1998-06-20', '1998-06-21')) AS weekend FROM ev
UNION ALL SELECT '1998-06-21', false, count(*) FILTER (start_date BETWEEN '1998-06-21' AND '1998-06-27'), count(*) FILTER (start_date = '1998-06-21'), count(*) FILTER (start_date IN ('1998-06-21', '1998-06-22')) FROM ev
UNION ALL SELECT '1998-06-15', true, count(*) FILTER (start_date <= '1998-06-21' AND end_date >= '1998-06-15'), count(*) FILTER (start_date <= '1998-06-15' AND end_date >= '1998-06-15'), count(*) FILTER (start_date <= '1998-06-21' AND end_date >= '1998-06-20') FROM ev""")
def agg9(spark, d):
    e = I.dated_orders(spark, d)
    parts = [R.calendar_counters(e, day, o).select(F.lit(day).alias("as_of"), F.lit(o).alias("overlap"), "week", "today", "weekend")
             for day, o in (("1998-06-15", False), ("1998-06-21", False), ("1998-06-15", True))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


FILMS = f"""{I.SHOWINGS}, tt AS (SELECT title, day, time, min(position) AS p FROM sh GROUP BY ALL), dd AS (SELECT title, day, list(time ORDER BY p, time) AS times FROM tt GROUP BY ALL)"""


def _films(spark, d):
    s = I.showings(spark, d)
    return R.film_rollup(s.withColumn("title", F.concat(F.lit(" "), "title")), ["language"])


@query("agg10_film_rollup", f"""WITH {FILMS} SELECT a.title, language, showtimes, first_position FROM (SELECT title, string_agg(day || '=' || array_to_string(times, ','), ';' ORDER BY day) AS showtimes FROM dd GROUP BY title) a
JOIN (SELECT title, arg_min(language, position) AS language, min(position) AS first_position FROM sh GROUP BY title) b ON a.title = b.title""")
def agg10(spark, d):
    flat = F.array_join(F.transform(F.array_sort(F.map_entries("showtimes")), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))), ";")
    return _films(spark, d).select("title", "language", flat.alias("showtimes"), "first_position")


@query("agg11_showings_per_day", f"WITH {FILMS} SELECT day, sum(len(times))::BIGINT AS showings FROM dd WHERE day >= '{I.AS_OF}' GROUP BY day")
def agg11(spark, d):
    return R.showings_per_day(_films(spark, d), I.AS_OF)


@query("agg12_markers", f"""WITH {I.ORDERS}, {VENUES} SELECT id, venue_name, latitude, longitude FROM (SELECT * FROM ev WHERE venue_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY venue_name ORDER BY start_date, id) = 1) e
JOIN (SELECT DISTINCT * FROM v WHERE latitude <> 0 AND longitude <> 0) w ON e.venue_name = w.name""")
def agg12(spark, d):
    return R.markers(I.dated_orders(spark, d), _venues(spark, d), [F.col("start_date"), F.col("id")])[0].select("id", "venue_name", "latitude", "longitude")


@query("agg12_bounds", """WITH b AS (SELECT min(embedding[1]::DOUBLE) AS a, max(embedding[1]::DOUBLE) AS b, min(embedding[2]::DOUBLE) AS c, max(embedding[2]::DOUBLE) AS d FROM embeddings)
SELECT round(a - (b - a) * 0.15, 6) AS south, round(b + (b - a) * 0.15, 6) AS north, round(c - (d - c) * 0.15, 6) AS west, round(d + (d - c) * 0.15, 6) AS east FROM b""")
def agg12_bounds(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("name"), F.get("embedding", F.lit(0)).cast("double").alias("latitude"), F.get("embedding", F.lit(1)).cast("double").alias("longitude"))
    _, box = R.markers(e.select(F.col("name").alias("venue_name"), F.col("name").alias("id")), e, [F.col("id")])
    return box.select(*[F.round(c, 6).alias(c) for c in ("south", "north", "west", "east")])


@query("agg13_drop_report", """WITH x AS (SELECT event_id, event_type || ' ' || event_id AS title, CASE WHEN event_id % 7 < 3 THEN 'duplicate' WHEN event_id % 7 < 5 THEN 'low confidence' WHEN event_id % 7 = 5 THEN 'excluded pattern' ELSE 'other' END AS class FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY event_id) AS rn FROM x)
SELECT CASE class WHEN 'excluded pattern' THEN 1 WHEN 'low confidence' THEN 2 WHEN 'duplicate' THEN 3 ELSE 4 END::INT AS place, class, count(*) AS total, string_agg(title, '|' ORDER BY rn) FILTER (rn <= 12) AS titles, greatest(count(*) - 12, 0) AS more FROM r GROUP BY class""")
def agg13(spark, d):
    k = F.col("event_id") % 7
    reason = F.when(k < 3, "duplicate").when(k < 5, "low_confidence").when(k == 5, "excluded_pattern:^x").otherwise("odd")
    drops = table(spark, d, "events").select("event_id", F.concat_ws(" ", "event_type", "event_id").alias("title"), reason.alias("reason"))
    return R.drop_report(drops, "event_id").withColumn("titles", F.array_join("titles", "|"))


@query("agg14_build_check", """SELECT round(date_diff('second', date_trunc('second', max(ts)), TIMESTAMP '2024-02-02') / 3600.0, 2)::DOUBLE AS age_hours, CASE WHEN date_diff('second', date_trunc('second', max(ts)), TIMESTAMP '2024-02-02') / 3600.0 < 12 THEN 'ok' WHEN date_diff('second', date_trunc('second', max(ts)), TIMESTAMP '2024-02-02') / 3600.0 < 48 THEN 'warn' ELSE 'stale' END AS band,
  (SELECT count(*) FROM orders) AS n_stored, count(*) AS n_build, (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')) AS orphans, (SELECT count(*) FROM part) AS films,
  (CASE WHEN date_diff('second', date_trunc('second', max(ts)), TIMESTAMP '2024-02-02') / 3600.0 > 30 THEN 1 ELSE 0 END + 2 + CASE WHEN count(*) <> (SELECT count(*) FROM orders) THEN 4 ELSE 0 END)::INT AS failure_bits, false AS passed FROM events""")
def agg14(spark, d):
    build = table(spark, d, "events").agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("built_at"), F.count("*").alias("n_events"))
    slug = lambda t, c: t.select(F.col(c).alias("slug"))
    orders = table(spark, d, "orders")
    return V.build_check(build, orders, slug(table(spark, d, "lineitem"), "l_orderkey"), slug(orders.where("o_orderstatus <> 'P'"), "o_orderkey"), table(spark, d, "part"), "2024-02-02")


@query("ord2_capped_list", """WITH r AS (SELECT p_brand, p_name || ' ' || p_partkey AS item, row_number() OVER (PARTITION BY p_brand ORDER BY p_name || ' ' || p_partkey) AS rn, count(*) OVER (PARTITION BY p_brand) AS total FROM part)
SELECT p_brand, max(total) AS total, string_agg(item, '; ' ORDER BY rn) FILTER (rn <= 15) || CASE WHEN max(total) > 15 THEN '  …and ' || (max(total) - 15) || ' more' ELSE '' END AS shown FROM r GROUP BY p_brand""")
def ord2(spark, d):
    return R.capped_list(table(spark, d, "part").select("p_brand", F.concat_ws(" ", "p_name", "p_partkey").alias("item")), ["p_brand"], "item")


@query("ord3_today_top", f"WITH {I.ORDERS} SELECT id, title FROM ev WHERE start_date = '{I.AS_OF}' ORDER BY id LIMIT 6")
def ord3(spark, d):
    return R.today_top(I.dated_orders(spark, d), I.AS_OF, "id").select("id", "title")


@query("ord4_sorted_showtimes", f"""WITH {FILMS} SELECT title, day, array_to_string(list_sort(times), ',') AS by_text, array_to_string(list_transform(list_sort(list_transform(times, lambda t: lpad(t, 5, '0'))), lambda t: ltrim(t, '0')), ',') AS by_minute FROM dd""")
def ord4(spark, d):
    f = _films(spark, d)
    both = f.select("title", F.explode(R.sort_showtimes(F.col("showtimes"))).alias("day", "a"), F.col("showtimes"))
    return both.select("title", "day", F.array_join("a", ",").alias("by_text"), F.array_join(R.sort_times(F.try_element_at("showtimes", F.col("day")), True), ",").alias("by_minute"))


@query("ord5_day_programme", f"""WITH {FILMS} SELECT title, array_to_string(times, ',') AS times, split_part(times[1], ':', 1)::INT AS hour FROM dd WHERE day = '{I.AS_OF}'""")
def ord5(spark, d):
    return R.day_programme(_films(spark, d), I.AS_OF).withColumn("times", F.array_join("times", ","))


@query("agg1_distinct_sources", "SELECT DISTINCT source AS source_id FROM documents WHERE source IS NOT NULL")
def agg1_sources(spark, d):
    return R.distinct_sources(table(spark, d, "documents").withColumnRenamed("source", "source_id"))
