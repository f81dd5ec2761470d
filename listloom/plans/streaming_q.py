"""Queries that run the two streams to their end and read what they left behind."""

from __future__ import annotations

from pyspark.sql import functions as F

from listloom.operators.review import with_snapshot
from listloom.operators.store import read_current
from listloom.plans import inputs as I
from listloom.plans.filters_q import SUBMIT, submissions
from listloom.plans.registry import query
from listloom.session import fresh_path
from listloom.streaming import intake

ALL_FILES = 100000


# arrivals: turn 0, turn 1, the later turns; before the third, what was accepted of even conversations is decided
JUDGED = f"""{SUBMIT}, early AS (SELECT id, start_date, row_number() OVER (PARTITION BY start_date ORDER BY id % 1000, id) AS rn FROM val WHERE error IS NULL AND id % 1000 < 2),
held AS (SELECT start_date, count(*) AS n FROM early WHERE rn <= 3 AND (id // 1000) % 2 <> 0 GROUP BY start_date),
late AS (SELECT v.id, row_number() OVER (PARTITION BY v.start_date ORDER BY v.id) + coalesce(h.n, 0) AS rn FROM val v LEFT JOIN held h USING (start_date) WHERE error IS NULL AND v.id % 1000 >= 2),
won AS (SELECT id FROM early WHERE rn <= 3 UNION ALL SELECT id FROM late WHERE rn <= 3)"""


def _judged(spark, d):
    """Three arrivals of files, one micro-batch each, with decisions between the second and the third."""
    rows = submissions(spark, d)
    landing, root = fresh_path(spark, "landing"), fresh_path(spark, "intake")
    turn, conversation = F.col("id") % 1000, F.floor(F.col("id") / 1000)
    for k, arrival in enumerate((rows.where(turn == 0), rows.where(turn == 1), rows.where(turn >= 2))):
        if k == 2:
            for _ in range(2):  # deciding twice frees a place once
                intake.decide(spark, root, rows.where((turn < 2) & (conversation % 2 == 0)).select("id"))
        arrival.write.mode("append").json(landing)
        intake.start_intake(spark, landing, root, files_per_batch=ALL_FILES).awaitTermination()
    return root


@query("str1_intake_stream", f"""WITH {JUDGED} SELECT val.id, start_date, CASE WHEN error IS NOT NULL THEN error WHEN won.id IS NULL THEN 'too many submissions for this date' END AS error,
  won.id IS NOT NULL AS accepted, CASE WHEN won.id IS NOT NULL THEN 0.55 END::DOUBLE AS confidence FROM val LEFT JOIN won ON val.id = won.id""")
def str1(spark, d):
    return intake.outcomes(spark, _judged(spark, d)).select("id", "start_date", "error", "accepted", "confidence")


@query("str1_review_cases", f"""WITH {JUDGED} SELECT 'submission-' || id AS event_id, 'manual_submission' AS source_id, 'open' AS status, 0.55::DOUBLE AS confidence, title, start_date FROM val JOIN won USING (id)""")
def str1_cases(spark, d):
    """Accepted submissions in the review queue."""
    cases = with_snapshot(intake.review_cases(spark, _judged(spark, d), "2024-07-01"))
    return cases.select("event_id", "source_id", "status", "confidence", "event.title", "event.start_date")


@query("str2_upsert_stream", f"""WITH {I.SNAPSHOTS}, bt AS (SELECT * FROM new WHERE source_id <> 'BUILDING')
SELECT coalesce(o.id, n.id) AS id, coalesce(o.source_id, n.source_id) AS source_id, CASE WHEN n.id IS NOT NULL THEN n.description ELSE o.description END AS description,
  CASE WHEN n.id IS NOT NULL THEN coalesce(nullif(n.title_en, ''), nullif(o.title_en, ''), n.title_en) ELSE o.title_en END AS title_en, coalesce(o.created_at, n.created_at) AS created_at,
  CASE WHEN n.id IS NOT NULL THEN '2024-02-10' ELSE '2024-01-10' END AS updated_at, CASE WHEN n.id IS NULL AND o.source_id <> 'BUILDING' THEN '2024-02-10' END AS absent_since
FROM old o FULL JOIN bt n ON o.id = n.id""")
def str2(spark, d):
    """Two snapshots as two micro-batches; the second lacks one source, which stays as it was."""
    old, new = I.snapshots(spark, d)
    landing, root = fresh_path(spark, "landing"), fresh_path(spark, "upserts")
    schema = old.schema.simpleString()[len("struct<"):-1].replace(":", " ")
    for batch, now in ((old, "2024-01-10"), (new.where("source_id <> 'BUILDING'"), "2024-02-10")):
        batch.select(*old.columns).write.mode("append").parquet(landing)
        intake.start_upserts(spark, landing, schema, root, "listings", now, files_per_batch=ALL_FILES).awaitTermination()
    return read_current(spark, root, "listings").select("id", "source_id", "description", "title_en", "created_at", "updated_at", "absent_since")
