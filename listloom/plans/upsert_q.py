"""Queries over upserts, tombstones and the review queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from listloom.functions.text import slug
from listloom.operators import review as R
from listloom.operators import upsert as U
from listloom.plans import inputs as I
from listloom.plans.registry import query, table

NOW = "2024-02-10"
OUT = ["id", "source_id", "title", "description", "title_en", "confidence", "created_at", "updated_at", "absent_since"]
SOURCES = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
# the stored rows: some tombstoned already; the batch leaves out one source entirely
STORED = f"""{I.SNAPSHOTS}, st AS (SELECT *, CASE WHEN position % 6 = 1 THEN '2024-01-20' END AS absent_since FROM old),
bt AS (SELECT * FROM new WHERE source_id <> 'BUILDING')"""


def _stored(spark, d):
    old, new = I.snapshots(spark, d)
    st = old.withColumns({"absent_since": F.when(F.col("position") % 6 == 1, "2024-01-20"), "row_key": F.lit(None).cast("string")}).drop("position")
    return st, new.where("source_id <> 'BUILDING'")


@query("ups1_replace_source", f"""WITH {I.SNAPSHOTS} SELECT id, description FROM old WHERE source_id <> 'HOUSEHOLD' UNION ALL SELECT id, description FROM new n WHERE source_id = 'HOUSEHOLD'""")
def ups1(spark, d):
    old, new = I.snapshots(spark, d)
    twice = new.unionByName(new.withColumns({"position": F.col("position") + 10000000, "description": F.lit("later duplicate")}))
    return U.replace_source(old, twice, "HOUSEHOLD").select("id", "description")


@query("ups1_replace_table", f"""WITH {I.SHOWINGS}, f AS (SELECT lower(replace(title, ' ', '-')) AS id, title, day, position FROM sh)
SELECT id, title, day, CASE WHEN position % 2 = 0 THEN 'c' ELSE '{NOW}' END AS created_at FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY position) = 1""")
def ups1_table(spark, d):
    films = I.showings(spark, d).select(slug(F.col("title")).alias("id"), "title", "day", "position", F.when(F.col("position") % 2 == 0, "c").otherwise("").alias("created_at"))
    return U.replace_table(films, NOW).select("id", "title", "day", "created_at")


@query("ups2_durable_upsert", f"""WITH {STORED} SELECT coalesce(o.id, n.id) AS id, coalesce(o.source_id, n.source_id) AS source_id, coalesce(n.title, o.title) AS title,
  CASE WHEN n.id IS NOT NULL THEN n.description ELSE o.description END AS description,
  CASE WHEN n.id IS NOT NULL THEN coalesce(nullif(n.title_en, ''), nullif(o.title_en, ''), n.title_en) ELSE o.title_en END AS title_en,
  CASE WHEN n.id IS NOT NULL THEN n.confidence ELSE o.confidence END AS confidence, coalesce(o.created_at, n.created_at) AS created_at,
  CASE WHEN n.id IS NOT NULL THEN '{NOW}' ELSE o.updated_at END AS updated_at,
  CASE WHEN n.id IS NOT NULL THEN NULL WHEN o.source_id = 'BUILDING' THEN o.absent_since ELSE coalesce(o.absent_since, '{NOW}') END AS absent_since
FROM st o FULL JOIN bt n ON o.id = n.id""")
def ups2(spark, d):
    st, bt = _stored(spark, d)
    # a batch repeats every row once with an earlier position: the later one counts
    twice = bt.unionByName(bt.withColumns({"position": F.col("position") - 10000000, "description": F.lit("earlier")}))
    return U.durable_upsert(st, twice, SOURCES, NOW).select(*OUT)


@query("ups3_tombstones", f"""WITH {STORED} SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NOT NULL THEN NULL ELSE coalesce(o.absent_since, '{NOW}') END AS absent_since FROM st o FULL JOIN bt n ON o.id = n.id""")
def ups3(spark, d):
    st, bt = _stored(spark, d)
    return U.durable_upsert(st, bt, SOURCES, NOW, guard_empty=False).select("id", "absent_since")


@query("ups4_purge", """SELECT event_id FROM events WHERE event_id % 2 = 0 OR ts >= TIMESTAMP '2024-02-10' - INTERVAL 30 DAY""")
def ups4(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("absent_since"))
    return U.purge_tombstones(e, NOW).select("event_id")


@query("ups5_key_backfill", f"""WITH {I.SNAPSHOTS} SELECT id, CASE WHEN position % 2 = 0 THEN 'kept' ELSE source_id || '|' || lower(regexp_replace(title, '#', '')) || '|' || start_date || '|' || lower(venue_name) END AS row_key FROM base""")
def ups5(spark, d):
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(
        k.cast("string").alias("id"), F.col("c_mktsegment").alias("source_id"), F.col("c_name").alias("title"), F.concat(F.lit("2024-0"), (k % 9 + 1).cast("string"), F.lit("-15")).alias("start_date"),
        F.concat(F.lit("Salle "), F.col("c_nationkey").cast("string")).alias("venue_name"), F.when(k % 2 == 0, "kept").alias("row_key"))
    return U.with_row_key(rows).select("id", "row_key")


def _merge(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    # the base holds one row per key; the batch holds many per key, also keys the base lacks
    base = table(spark, d, "customer").where("c_custkey % 3 <> 0").select(
        F.col("c_custkey").alias("position"), F.concat(F.lit("b"), F.col("c_custkey")).alias("id"), F.when(F.col("c_custkey") % 2 == 0, "post_1").otherwise("odd").alias("source_id"),
        F.concat(F.lit("Show "), F.col("c_custkey")).alias("title"), F.lit("2024-01-05").alias("start_date"), F.lit(0.3).alias("confidence"), F.lit("base").alias("created_at"))
    batch = table(spark, d, "orders").select(
        k.alias("position"), F.concat(F.lit("n"), k).alias("id"), F.when(k % 5 == 0, "official").when(k % 5 == 1, "event_9").when(k % 5 == 2, "odd").otherwise("post_2").alias("source_id"),
        F.concat(F.lit("SHOW-"), c).alias("title"), F.lit("2024-01-05T20:00").alias("start_date"), ((k % 97) / 100.0).cast("double").alias("confidence"), F.concat(F.lit("c"), k).alias("created_at"))
    return U.priority_merge(base, batch, {"official": 10, "event": 30, "post": 50})


# the same in SQL: a row replaces the base when its (priority, confidence) exceeds everything before it
PRIORITY = """b AS (SELECT c_custkey AS key, -50 AS p, 0.3::DOUBLE AS c FROM customer WHERE c_custkey % 3 <> 0),
n AS (SELECT o_orderkey AS pos, o_custkey AS key, CASE o_orderkey % 5 WHEN 0 THEN -10 WHEN 1 THEN -30 ELSE -50 END AS p, ((o_orderkey % 97) / 100.0)::DOUBLE AS c FROM orders),
m AS (SELECT n.*, b.key IS NOT NULL AS hit, max({'p': n.p, 'c': n.c}) OVER (PARTITION BY n.key ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev, {'p': b.p, 'c': b.c} AS held FROM n LEFT JOIN b ON n.key = b.key),
h AS (SELECT *, CASE WHEN prev IS NULL OR prev < held THEN held ELSE prev END AS before FROM m WHERE hit),
r AS (SELECT *, before.p = p AS own FROM h WHERE {'p': p, 'c': c} > before)"""


@query("ups6_priority_merge", f"""WITH {PRIORITY}, w AS (SELECT key, max(pos) AS pos FROM r GROUP BY key), o AS (SELECT key, max(pos) AS pos FROM r WHERE own GROUP BY key)
SELECT 'n' || pos AS id, 'c' || pos AS created_at FROM m WHERE NOT hit
UNION ALL SELECT 'n' || w.pos, CASE WHEN o.pos IS NULL THEN 'base' ELSE 'c' || o.pos END FROM w LEFT JOIN o ON w.key = o.key
UNION ALL SELECT 'b' || key, 'base' FROM b WHERE key NOT IN (SELECT key FROM w)""")
def ups6(spark, d):
    return _merge(spark, d)[0].select("id", "created_at")


@query("ups6_merge_counts", f"""WITH {PRIORITY} SELECT (SELECT count(*) FROM m WHERE NOT hit) AS n_new, (SELECT count(*) FROM r) AS n_updated, (SELECT count(*) FROM m WHERE hit) - (SELECT count(*) FROM r) AS n_duplicate""")
def ups6_counts(spark, d):
    return _merge(spark, d)[1]


@query("rev1_review_insert", f"""WITH {I.LISTINGS}, c AS (SELECT *, left(sha1(source_id || '|e' || (id % 40) || '|' || title || '|' || start_date || '|low'), 16) AS rid FROM listings),
q AS (SELECT rid, min(id) AS k FROM c WHERE id % 3 <> 1 GROUP BY rid), n AS (SELECT rid, arg_max(coalesce(confidence, 0), id) AS conf FROM c WHERE id % 3 <> 0 GROUP BY rid)
SELECT coalesce(q.rid, n.rid) AS id, CASE WHEN q.rid IS NULL OR k % 2 = 0 THEN 'open' ELSE 'approved' END AS status,
  CASE WHEN n.rid IS NOT NULL AND (q.rid IS NULL OR k % 2 = 0) THEN n.conf ELSE 0.1 END::DOUBLE AS confidence, CASE WHEN q.rid IS NULL THEN '{NOW}' ELSE 'before' END AS created_at
FROM q FULL JOIN n ON q.rid = n.rid""")
def rev1(spark, d):
    e = I.listings(spark, d).withColumns({"event_id": F.concat(F.lit("e"), (F.col("id") % 40).cast("string")), "reason": F.lit("low"), "position": F.col("id")})
    rows = R.queue_rows(e.where("id % 3 <> 0"), NOW)
    rid = R.review_id(F.col("source_id"), F.col("event_id"), F.col("title"), F.col("start_date"), F.col("reason"))
    old = e.where("id % 3 <> 1").groupBy(rid.alias("id")).agg(F.min("position").alias("k"))
    none = F.lit(None).cast("string")
    queue = old.select("id", F.lit("e").alias("event_id"), F.lit("s").alias("source_id"), F.lit("low").alias("reason"), F.lit("{}").alias("event_snapshot"), F.lit(0.1).alias("confidence"),
                       F.when(F.col("k") % 2 == 0, "open").otherwise("approved").alias("status"), none.alias("notes"), none.alias("reviewed_by"), none.alias("reviewed_at"), F.lit("before").alias("created_at"))
    return R.insert_review(queue, rows).select("id", "status", "confidence", "created_at")


def _decide(spark, d):
    q = I.queue(spark, d)
    i = F.col("id").cast("long")
    decisions = q.where(i % 4 != 3).select("id", F.when(i % 4 == 0, "approve").otherwise("reject").alias("decision"), F.lit("ann").alias("reviewer"),
                                           F.when(i % 4 == 1, "no").otherwise(" ").alias("note"))
    from listloom.operators.project import canonical
    existing = canonical(q.where("event_id like 'e1%'").select(F.col("event_id").alias("id"), F.lit("stored").alias("title")).distinct(), NOW)
    limits = spark.createDataFrame([("view", 0.8), ("click", None)], "id string, min_publish_confidence double")
    return R.apply_decisions(q, decisions, existing, limits, NOW)


DECIDED = f"""{I.QUEUE}, dec AS (SELECT *, id::BIGINT AS i, CASE WHEN status = 'open' AND id::BIGINT % 4 = 0 THEN 'approved' WHEN status = 'open' AND id::BIGINT % 4 = 1 THEN 'rejected' END AS done FROM q)"""


@query("rev2_decisions_queue", f"""WITH {DECIDED} SELECT id, coalesce(done, status) AS status, CASE WHEN done IS NOT NULL THEN 'ann' END AS reviewed_by, CASE WHEN done = 'rejected' THEN 'no' END AS notes FROM dec""")
def rev2_queue(spark, d):
    return _decide(spark, d)[0].select("id", "status", "reviewed_by", "notes")


@query("rev2_decisions_publish", f"""WITH {DECIDED}, t AS (SELECT event_id AS id, CASE WHEN confidence < CASE source_id WHEN 'view' THEN 0.8 ELSE 0.6 END THEN round(CASE source_id WHEN 'view' THEN 0.8 ELSE 0.6 END + 0.01, 3) ELSE confidence END AS c FROM dec WHERE done = 'approved')
SELECT id, max(c)::DOUBLE AS confidence FROM t WHERE id NOT IN (SELECT event_id FROM q WHERE event_id LIKE 'e1%') GROUP BY id UNION ALL SELECT DISTINCT event_id, 1.0 FROM q WHERE event_id LIKE 'e1%'""")
def rev2_publish(spark, d):
    return _decide(spark, d)[1].select("id", "confidence")


@query("rev3_triage", f"""WITH {I.QUEUE}, t AS (SELECT *, CASE WHEN status = 'open' AND confidence >= 0.7 THEN 'approved' WHEN status = 'open' AND confidence < 0.4 AND created_at::TIMESTAMP < TIMESTAMP '2024-03-15' - INTERVAL 60 DAY THEN 'rejected' END AS done FROM q)
SELECT id, coalesce(done, status) AS status, CASE done WHEN 'approved' THEN 'auto-approved: confidence >= 0.7' WHEN 'rejected' THEN 'auto-rejected: stale (>60d) + low confidence (<0.4)' END AS notes FROM t""")
def rev3(spark, d):
    return R.triage(I.queue(spark, d), "2024-03-15").select("id", "status", "notes")


@query("rev4_queue_aging", f"""WITH {I.QUEUE} SELECT id FROM q WHERE NOT (status = 'open' AND s_date < '2024-02-05' AND created_at::TIMESTAMP < TIMESTAMP '2024-02-05' - INTERVAL 21 DAY)""")
def rev4(spark, d):
    return R.age_out(I.queue(spark, d), "2024-02-05", "2024-02-05").select("id")


@query("ord1_queue_listing", f"""WITH {I.QUEUE} SELECT id, status, confidence, s_title AS title FROM q WHERE confidence BETWEEN 0.1 AND 0.6 AND source_id = 'view'
  QUALIFY row_number() OVER (PARTITION BY status ORDER BY confidence, created_at DESC, id) <= 50""")
def ord1(spark, d):
    return R.with_snapshot(R.list_queue(I.queue(spark, d), "all", "view", 0.1, 0.6, 50)).select("id", "status", "confidence", "event.title")


@query("ups5_duplicate_ids", "SELECT 'c' || (c_custkey % 100) AS id, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1")
def ups5_duplicates(spark, d):
    """Ids that more than one row key carries."""
    return U.duplicate_ids(table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey") % 100).alias("id")))
