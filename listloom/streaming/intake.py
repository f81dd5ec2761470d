"""Continuous intake of submissions, and micro-batches of scraped listings."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from listloom.operators.gate import validate_submission
from listloom.operators.review import queue_rows
from listloom.operators.store import last_commit, make_folder, publish_parts, read_current
from listloom.operators.upsert import durable_upsert

OPEN_CONFIDENCE = 0.55
SUBMISSION = ("id long, title string, start_date string, category string, description string, time string, "
              "venue_name string, commune string, contact_name string, contact_email string")
OUTCOME = SUBMISSION + ", error string, accepted boolean, confidence double, status string"


def _kinds(rows: DataFrame, kind: str) -> DataFrame:
    """Validated submissions, or decisions, with the key that their state is kept under."""
    if kind == "decision":
        blank = [F.lit(None).cast(t).alias(c) for c, t in (f.split(" ") for f in (SUBMISSION + ", error string").split(", ")) if c not in ("id", "start_date")]
        return rows.select("id", "start_date", *blank, F.lit(kind).alias("kind"), F.col("start_date").alias("key"))
    # what is refused as it stands needs no state, so it is spread
    return validate_submission(rows).withColumns({
        "kind": F.lit(kind), "key": F.when(F.col("error").isNull(), F.col("start_date")).otherwise(F.concat(F.lit("!"), F.pmod("id", F.lit(64))))})


class Stand:
    """The submissions of one date that are accepted and not decided: at most ``limit``, by which their places are counted.

    Takes the rows of a micro-batch as they come, and holds no more of them than there can be places: decisions
    free the places of ids that stand, then the least ids that arrived take what is free, and at the end
    decisions on these free them again. An id that does not stand changes nothing, so a decision counts once.
    """

    def __init__(self, standing: Sequence[int], limit: int):
        self.standing, self.limit = set(standing), limit
        self.decided: set[int] = set()
        self.waiting: list[tuple[int, int, dict]] = []  # a heap of (-id, order, row)
        self.order = 0

    def decide(self, ids: Iterable[int]) -> None:
        for i in ids:
            if i in self.standing:
                self.standing.remove(i)
            else:
                self.decided.add(i)

    def arrive(self, row: dict) -> dict | None:
        """Hold a valid submission; returns one that can no longer get a place."""
        self.order += 1
        heapq.heappush(self.waiting, (-row["id"], -self.order, row))
        return heapq.heappop(self.waiting)[2] if len(self.waiting) > self.limit else None

    def settle(self) -> list[tuple[dict, bool]]:
        """(submission, accepted) for those still held."""
        held = sorted(self.waiting, key=lambda w: (-w[0], -w[1]))
        free = max(0, self.limit - len(self.standing))
        taken = [row for _, _, row in held[:free]]
        self.standing = (self.standing | {row["id"] for row in taken}) - self.decided
        return [(row, n < free) for n, (_, _, row) in enumerate(held)]


def _judged(limit: int):
    columns = [f.split(" ")[0] for f in OUTCOME.split(", ")]

    def outcome(row: dict, accepted: bool) -> dict:
        refused = row["error"] is None and not accepted
        return row | {"error": "too many submissions for this date" if refused else row["error"], "accepted": accepted,
                      "confidence": OPEN_CONFIDENCE if accepted else None, "status": "open" if accepted else None}

    def judged(key, frames, state) -> Iterator[pd.DataFrame]:
        stand = Stand(state.get[0] if state.exists else (), limit)
        for frame in frames:
            rows = frame.astype(object).where(frame.notna(), None).to_dict("records")
            stand.decide(r["id"] for r in rows if r["kind"] == "decision")
            done = [outcome(r, False) for r in rows if r["kind"] != "decision" and r["error"] is not None]
            late = [stand.arrive(r) for r in rows if r["kind"] != "decision" and r["error"] is None]
            done += [outcome(r, False) for r in late if r]
            if done:
                yield pd.DataFrame(done, columns=columns)
        if held := [outcome(r, accepted) for r, accepted in stand.settle()]:
            yield pd.DataFrame(held, columns=columns)
        if stand.standing:
            state.update((sorted(stand.standing),))
        elif state.exists:
            state.remove()

    return judged


def decide(spark: SparkSession, root: str, decided: DataFrame) -> None:
    """Free the quota of decided submissions (``id``, and ``start_date`` where the caller has it).

    Decisions are one append to a folder that the intake reads as its second stream; whatever part of it a broken
    write left is completed by repeating it, since a decided id has no place any more and a repeat frees none. They
    count from the next batch on.
    """
    if "start_date" not in decided.columns:
        decided = decided.select(F.col("id").cast("long").alias("id")).join(outcomes(spark, root).where("accepted").select("id", "start_date"), "id")
    decided.select(F.col("id").cast("long").alias("id"), "start_date").distinct().write.mode("append").json(f"{root}/decisions")


def review_cases(spark: SparkSession, root: str, now: str) -> DataFrame:
    """Accepted submissions as open rows of the review queue, for ``review.insert_review``."""
    rows = outcomes(spark, root).where("accepted").withColumns({
        "event_id": F.concat(F.lit("submission-"), "id"), "source_id": F.lit("manual_submission"), "reason": F.lit("submission")})
    return queue_rows(rows, now, "id")


def start_intake(spark: SparkSession, source: str, root: str, limit: int = 3, files_per_batch: int = 1,
                 continuous: bool = False) -> StreamingQuery:
    """Judge JSON submissions as they land in ``source``; outcomes go to ``root/outcomes``.

    Submissions and decisions are one stream, keyed by date; the state of a date is the ids that stand there, so a
    batch costs what it holds, however many came before. Outcomes are written under the batch's own number with
    overwrite and the state goes with the progress of the stream, so a replayed batch gives the same files.
    """

    def handle(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/outcomes/batch={number}")

    make_folder(spark, f"{root}/decisions")

    def read(schema: str, path: str) -> DataFrame:
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)

    rows = _kinds(read(SUBMISSION, source), "submission").unionByName(_kinds(read("id long, start_date string", f"{root}/decisions"), "decision"))
    judged = rows.groupBy("key").applyInPandasWithState(_judged(limit), OUTCOME, "standing array<long>", "append", "NoTimeout")
    writer = judged.writeStream.foreachBatch(handle).option("checkpointLocation", f"{root}/progress")
    if not continuous:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def outcomes(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(OUTCOME + ", batch long").parquet(f"{root}/outcomes")


def start_upserts(spark: SparkSession, source: str, schema: str, root: str, table: str, now: str,
                  position: str = "position", files_per_batch: int = 1, guard_empty: bool = True,
                  continuous: bool = False) -> StreamingQuery:
    """Every micro-batch is folded into the stored table of its sources, one version per source.

    A batch's number is its version, and publishing a version that is already current does nothing:
    replays change nothing. Only the parts of the sources in the batch are read and rewritten. If another writer has
    committed one of these parts meanwhile, the batch fails with ``Conflict`` and is taken up again by a restart.
    """

    def handle(batch: DataFrame, number: int) -> None:
        s, base = batch.sparkSession, last_commit(batch.sparkSession, root)
        batch = batch.persist()  # planned and read once
        try:
            # the number of distinct sources is bounded by the source registry
            names = [r[0] for r in batch.select("source_id").distinct().orderBy("source_id").collect()]
            if not names:
                return
            stored = read_current(s, root, table, names)
            if stored is None:
                stored = batch.limit(0).drop(position).withColumns({
                    "row_key": F.lit(None).cast("string"), "absent_since": F.lit(None).cast("string")})
            merged = durable_upsert(stored, batch, names, now, position, guard_empty=guard_empty)
            publish_parts(merged, root, table, "source_id", now, version=number, base=base)
        finally:
            batch.unpersist()

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{root}/progress-{table}")
    if not continuous:
        writer = writer.trigger(availableNow=True)
    return writer.start()
