"""Review queue: deterministic ids, decisions, automatic triage, ageing and listing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listloom.functions.text import date10
from listloom.operators.project import LISTING_COLUMNS, LISTING_SCHEMA, canonical
from listloom.windows import first_per_key, top_per_key

STATUSES = ("open", "approved", "rejected")
QUEUE = ("id", "event_id", "source_id", "reason", "event_snapshot", "confidence", "status", "notes",
         "reviewed_by", "reviewed_at", "created_at")


def review_id(source: Column, event_id: Column, title: Column, date: Column, reason: Column, title_length: int | None = None) -> Column:
    """First 16 hex digits of a SHA-1 over the parts that identify a case; the whole title counts unless a length is given."""
    e = lambda c: F.coalesce(c, F.lit(""))
    named = e(title) if title_length is None else F.substring(e(title), 1, title_length)
    key = F.concat_ws("|", e(source), e(event_id), named, date10(date), e(reason))
    return F.substring(F.sha1(key.cast("binary")), 1, 16)


def queue_rows(events: DataFrame, now: str, position: str = "position") -> DataFrame:
    """Queue rows for events that carry a ``reason`` and an ``event_id``; the last of equal ids counts."""
    snap = F.to_json(F.struct(*[F.col(c) for c in LISTING_COLUMNS if c in events.columns]))
    rows = events.select(
        review_id(F.col("source_id"), F.col("event_id"), F.col("title"), F.col("start_date"), F.col("reason")).alias("id"),
        "event_id", "source_id", "reason", snap.alias("event_snapshot"),
        F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0)).alias("confidence"),
        F.lit("open").alias("status"), F.lit(None).cast("string").alias("notes"),
        F.lit(None).cast("string").alias("reviewed_by"), F.lit(None).cast("string").alias("reviewed_at"),
        F.lit(now).alias("created_at"), F.col(position).alias("_pos"))
    return first_per_key(rows, ["id"], [F.col("_pos").desc()]).drop("_pos")


def insert_review(queue: DataFrame, incoming: DataFrame) -> DataFrame:
    """Add new cases; refresh the content of open ones; decided ones stay as they are."""
    o = queue.select(*[F.col(c).alias(f"o_{c}") for c in QUEUE])
    n = incoming.select(*[F.col(c).alias(f"n_{c}") for c in QUEUE])
    j = o.join(n, F.col("o_id") == F.col("n_id"), "full_outer")
    refresh = F.col("n_id").isNotNull() & (F.col("o_id").isNull() | (F.col("o_status") == "open"))
    out = []
    for c in QUEUE:
        if c in ("event_snapshot", "reason", "source_id", "confidence"):
            v = F.when(refresh, F.col(f"n_{c}")).otherwise(F.col(f"o_{c}"))
        else:
            v = F.when(F.col("o_id").isNotNull(), F.col(f"o_{c}")).otherwise(F.col(f"n_{c}"))
        out.append(v.alias(c))
    return j.select(*out)


def publishable(approved: DataFrame, thresholds: DataFrame, now: str, default_threshold: float = 0.6) -> DataFrame:
    """Listing rows from approved snapshots: published, confidence raised just over the threshold."""
    snap = approved.withColumn("_s", F.from_json("event_snapshot", LISTING_SCHEMA)).where("_s is not null") \
        .select("_s.*", F.col("id").alias("_case"))
    t = thresholds.select(F.col("id").alias("_tid"), F.col("min_publish_confidence").alias("_t"))
    j = snap.join(t, F.coalesce("source_id", F.lit("")) == F.col("_tid"), "left")
    limit = F.coalesce("_t", F.lit(default_threshold))
    conf = F.coalesce("confidence", F.lit(0.0))
    raised = F.when(conf < limit, F.round(limit + 0.01, 3)).otherwise(F.col("confidence"))
    rows = canonical(j.withColumns({"confidence": raised, "status": F.lit("published")}), now)
    # a case has one snapshot; equal ids of different cases: the case with the least id counts
    with_case = rows.withColumn("_order", F.xxhash64("id", "title", "source_id", "start_date"))
    return first_per_key(with_case, ["id"], [F.col("confidence").desc(), F.col("_order").asc()]).drop("_order")


def apply_decisions(queue: DataFrame, decisions: DataFrame, events: DataFrame, thresholds: DataFrame,
                    now: str) -> tuple[DataFrame, DataFrame]:
    """Apply (id, decision, reviewer, note) to open cases: (queue, events).

    Approving publishes the snapshot unless its id exists already. Rejecting needs a note; without
    one, and for decided or unknown cases, nothing happens. One decision per id is expected.
    """
    d = decisions.select(F.col("id").alias("_did"), F.lower("decision").alias("_dec"), F.col("reviewer").alias("_by"),
                         F.nullif(F.trim("note"), F.lit("")).alias("_note"))
    j = queue.join(d, F.col("id") == F.col("_did"), "left")
    approve = (F.col("status") == "open") & (F.col("_dec") == "approve")
    reject = (F.col("status") == "open") & (F.col("_dec") == "reject") & F.col("_note").isNotNull()
    hit = F.coalesce(approve | reject, F.lit(False))
    after = j.withColumn("_ok", F.coalesce(approve, F.lit(False))).withColumns({
        "status": F.when(approve, "approved").when(reject, "rejected").otherwise(F.col("status")),
        "reviewed_by": F.when(hit, F.col("_by")).otherwise(F.col("reviewed_by")),
        "reviewed_at": F.when(hit, F.lit(now)).otherwise(F.col("reviewed_at")),
        "notes": F.when(hit, F.coalesce("_note", "notes")).otherwise(F.col("notes")),
    })
    new = publishable(after.where("_ok"), thresholds, now).select(*events.columns).join(events.select("id"), "id", "left_anti")
    return after.select(*queue.columns), events.unionByName(new)


def triage(queue: DataFrame, now: str, approve_at: float = 0.7, reject_below: float = 0.4,
           stale_days: int = 60) -> DataFrame:
    """Open cases of high confidence are approved, stale ones of low confidence rejected."""
    cutoff = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(stale_days))
    is_open = F.col("status") == "open"
    approve = is_open & (F.col("confidence") >= approve_at)
    reject = is_open & (F.col("confidence") < reject_below) & (F.col("created_at").cast("timestamp_ntz") < cutoff)
    hit = approve | reject
    return queue.withColumns({
        "status": F.when(approve, "approved").when(reject, "rejected").otherwise(F.col("status")),
        "reviewed_by": F.when(hit, "auto-triage").otherwise(F.col("reviewed_by")),
        "reviewed_at": F.when(hit, F.lit(now)).otherwise(F.col("reviewed_at")),
        "notes": F.coalesce("notes", F.when(approve, F.lit(f"auto-approved: confidence >= {approve_at}"))
                            .when(reject, F.lit(f"auto-rejected: stale (>{stale_days}d) + low confidence (<{reject_below})"))),
    })


def age_out(queue: DataFrame, as_of: str, now: str, max_age_days: int = 21) -> DataFrame:
    """Drop open cases whose event has passed and that have waited longer than ``max_age_days``."""
    cutoff = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(max_age_days))
    json = lambda p: F.nullif(F.get_json_object("event_snapshot", p), F.lit(""))
    day = F.substring(F.coalesce(json("$.start_date"), json("$.startDate")), 1, 10)
    stale = ((F.col("status") == "open") & (day < as_of)
             & (F.col("created_at").cast("timestamp_ntz") < cutoff))
    return queue.where(~F.coalesce(stale, F.lit(False)))


def list_queue(queue: DataFrame, status: str = "open", source: str | None = None, low: float | None = None,
               high: float | None = None, limit: int | None = None) -> DataFrame:
    """Cases by rising confidence, newest first among equals; ``all`` joins three limited lists."""
    q = queue
    if source:
        q = q.where(F.col("source_id") == source)
    if low is not None:
        q = q.where(F.col("confidence") >= low)
    if high is not None:
        q = q.where(F.col("confidence") <= high)
    order = [F.col("confidence").asc(), F.col("created_at").desc(), F.col("id").asc()]
    limit = None if limit is None else max(0, limit)
    if status != "all":
        q = q.where(F.col("status") == status).orderBy(*order)
        return q if limit is None else q.limit(limit)
    q = q.where(F.col("status").isin(*STATUSES))
    place = F.array_position(F.array(*[F.lit(s) for s in STATUSES]), F.col("status"))
    if limit is not None:
        q = top_per_key(q, ["status"], order, limit, "_r").drop("_r")
    return q.orderBy(place, *order)


def with_snapshot(queue: DataFrame, fields: Sequence[str] = ("title", "start_date", "category")) -> DataFrame:
    """Read fields of the stored snapshot; bad JSON gives nulls."""
    return queue.withColumn("event", F.from_json("event_snapshot", ", ".join(f"{f} string" for f in fields)))
