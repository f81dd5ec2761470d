"""Keyed upserts over plain tables, with tombstones. Pure functions from tables to tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from listloom.functions.text import row_key, short_key
from listloom.operators.project import LISTING_COLUMNS
from listloom.session import stored
from listloom.windows import first_per_key, range_bucket, side_by_side

TRANSLATIONS = ("title_en", "title_fr", "description_en", "description_fr", "venue_name_en", "venue_name_fr")
# Sources no scrape may touch.
PROTECTED = ("curated", "manual_submission")
KEPT_ON_UPDATE = ("id", "source_id", "created_at")


def with_row_key(df: DataFrame) -> DataFrame:
    """Fill a missing row key from the row's own content; keys that are set stay."""
    made = row_key(F.col("source_id"), F.col("title"), F.col("start_date"), F.col("venue_name"))
    return df.withColumn("row_key", F.coalesce("row_key", made) if "row_key" in df.columns else made)


def replace_source(stored: DataFrame, batch: DataFrame, source: str, position: str = "position",
                   key: str = "id") -> DataFrame:
    """The source's rows are replaced by the batch; of equal ids the first counts.

    An id another source already holds is not inserted again.
    """
    others = stored.where(~F.col("source_id").eqNullSafe(F.lit(source)))
    mine = first_per_key(batch.where(F.col("source_id") == source), [key], [F.col(position).asc()])
    mine = mine.join(others.select(key), key, "left_anti").select(*stored.columns)
    return others.unionByName(mine)


def replace_table(batch: DataFrame, now: str, position: str = "position", key: str = "id") -> DataFrame:
    """The batch as the whole new table: of equal ids the first counts, missing times are filled in."""
    rows = first_per_key(batch, [key], [F.col(position).asc()])
    filled = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(now))
    return rows.withColumns({"created_at": filled("created_at"), "updated_at": F.lit(now)})


def durable_upsert(stored: DataFrame, batch: DataFrame, sources: Sequence[str], now: str,
                   position: str = "position", carry: Sequence[str] = TRANSLATIONS,
                   protected: Sequence[str] = PROTECTED, guard_empty: bool = True) -> DataFrame:
    """One scrape of ``sources`` folded into the stored rows.

    Present keys are updated (id, source and creation time stay), new keys inserted, and stored rows
    of the scraped sources that the batch lacks get ``absent_since`` unless they have it already;
    rows that come back lose it. Of equal keys in the batch the last row counts. Empty translation
    fields keep the stored text. Protected sources never change. ``guard_empty`` leaves a source alone
    when the batch has no row of it at all.

    One full outer join on the unique row key does all of it, with one shuffle of either side; stored rows of other sources bypass it.
    """
    live = [s for s in sources if s not in protected]
    touched = F.coalesce(F.col("source_id").isin(live), F.lit(False))
    stored = with_row_key(stored)
    columns = stored.columns
    b = with_row_key(batch.where(touched).withColumn("row_key", F.lit(None).cast("string")))
    b = first_per_key(b, ["row_key"], [F.col(position).desc()])
    for c in columns:
        if c not in b.columns:
            b = b.withColumn(c, F.lit(None).cast(stored.schema[c].dataType))
    # names out of ``sources`` only, so at most as many as the caller has listed
    seen = [r[0] for r in batch.where(touched).select("source_id").distinct().collect()] if guard_empty else live
    bypass = stored.where(~touched)
    s = stored.where(touched).select(*[F.col(c).alias(f"s_{c}") for c in columns])
    n = b.select(*[F.col(c).alias(f"n_{c}") for c in columns])
    j = s.join(n, F.col("s_row_key") == F.col("n_row_key"), "full_outer")
    scraped = F.coalesce(F.coalesce("s_source_id", "n_source_id").isin(seen), F.lit(False))
    present, known = F.col("n_row_key").isNotNull(), F.col("s_row_key").isNotNull()
    out = []
    for c in columns:
        old, new = F.col(f"s_{c}"), F.col(f"n_{c}")
        if c == "row_key":
            v = F.coalesce(old, new)
        elif c in KEPT_ON_UPDATE:
            v = F.when(known, old).otherwise(new if c != "created_at" else F.coalesce(new, F.lit(now)))
        elif c == "absent_since":
            stamp = F.lit(now).cast(stored.schema[c].dataType)
            v = F.when(present, F.lit(None)).when(scraped, F.coalesce(old, stamp)).otherwise(old)
        elif c == "updated_at":
            v = F.when(present, F.lit(now)).otherwise(old)
        elif c == "status":
            v = F.when(present, F.lit("published")).otherwise(old)
        elif c in carry:
            keep = F.coalesce(F.nullif(new, F.lit("")), F.nullif(old, F.lit("")), new)
            v = F.when(present, keep).otherwise(old)
        else:
            v = F.when(present, new).otherwise(old)
        out.append(v.cast(stored.schema[c].dataType).alias(c))
    return bypass.unionByName(j.select(*out))


def purge_tombstones(df: DataFrame, now: str, max_age_days: int = 30) -> DataFrame:
    """Drop rows that have been absent for more than ``max_age_days``."""
    cutoff = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(max_age_days))
    absent = F.col("absent_since").cast("timestamp_ntz")
    return df.where(absent.isNull() | (absent >= cutoff))


def duplicate_ids(df: DataFrame) -> DataFrame:
    """Ids carried by more than one row key: reported, never dropped."""
    return df.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def source_priority(priorities: Mapping[str, int], default: int = 50):
    """Priority of a source name by its longest listed prefix; a lower number wins."""
    out = F.lit(default)
    for prefix, value in sorted(priorities.items(), key=lambda kv: len(kv[0])):
        out = F.when(F.col("source_id").startswith(prefix), value).otherwise(out)
    return out


def priority_merge(base: DataFrame, batch: DataFrame, priorities: Mapping[str, int], position: str = "position",
                   default: int = 50) -> tuple[DataFrame, DataFrame]:
    """Merge a batch into a base on the short title-and-date key: (merged rows, counts).

    In batch order, a row replaces the base row of its key when its source has the better (lower)
    priority number, or the same number and a higher confidence than the row now held; otherwise it
    is a duplicate. Rows with new keys are all appended, even when they repeat each other. A base row
    replaced by a better source hands down its creation time.

    Rather than walking a key row by row, the chain of replacements is read off as record highs of
    (priority, confidence): the winner is the earliest row holding the best pair, and it replaces the
    base only if that pair beats the base's.
    """
    pri = source_priority(priorities, default)
    conf = F.coalesce(F.col("confidence"), F.lit(0.0))
    key = short_key(F.col("title"), F.col("start_date"))
    # where base rows share a key the last one answers for it
    b = base.withColumn("_key", key).withColumn("_p", -pri).withColumn("_c", conf)
    owner = first_per_key(b, ["_key"], [F.col(position).desc()]).select(
        F.col("_key").alias("_ok"), F.col(position).alias("_opos"), F.struct(F.col("_p"), F.col("_c")).alias("_held"),
        F.col("created_at").alias("_created"))
    n = batch.withColumn("_key", key).withColumn("_rank", F.struct((-pri).alias("_p"), conf.alias("_c")))
    n = n.join(owner, F.col("_key") == F.col("_ok"), "left")
    # what decides, without the rows themselves: base and batch are read for it once
    hits = stored(n.select(position, "_key", "_rank", "_held", "_opos", "_created", "created_at", F.col("_ok").isNull().alias("_fresh")), "merge-hits")
    # record highs: rows above everything earlier under the same key; the last of them is the winner
    highs = _record_highs(hits.where(~F.col("_fresh") & (F.col("_rank") > F.col("_held"))), position)
    last = highs.groupBy("_key").agg(
        F.max(position).alias(position), F.first("_opos").alias("_opos"), F.first("_created").alias("_created"), F.max_by("created_at", position).alias("_mine"),
        # a step up in priority inherits the creation time, a step up in confidence alone brings its own
        F.max_by(F.struct(F.col("created_at").alias("at")), F.when(F.col("_own"), F.col(position))).alias("_h"), F.count("*").alias("_n"))
    winners = last.select(position, "_opos", F.when(F.col("_h").isNotNull(), F.col("_h.at")).otherwise(F.coalesce("_created", "_mine")).alias("_at"), "_n")
    fresh = hits.where("_fresh").select(position, F.lit(None).cast(hits.schema["_opos"].dataType).alias("_opos"), F.col("created_at").alias("_at"), F.lit(None).cast("long").alias("_n"))
    taken = stored(winners.unionByName(fresh), "merge-taken")
    kept = base.join(taken.where("_opos is not null").select(F.col("_opos").alias(position)), position, "left_anti")
    added = batch.join(taken.select(position, "_at"), position).withColumn("created_at", F.col("_at"))
    merged = kept.select(*base.columns).unionByName(added.select(*base.columns))
    counts = (side_by_side(taken.agg(F.count_if(F.col("_opos").isNull()).alias("n_new"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_updated")),
                           hits.agg(F.count_if(~F.col("_fresh")).alias("_hits")))
              .select("n_new", "n_updated", (F.col("_hits") - F.col("n_updated")).alias("n_duplicate")))
    return merged, counts


def _record_highs(rows: DataFrame, position: str) -> DataFrame:
    """Rows whose rank exceeds that of every earlier row of their key.

    ``_own`` marks those that beat the row held until then on confidence alone. A running maximum in two levels: inside position ranges of a key, then over the ranges' maxima,
    so a key with a large share of the batch is spread over many tasks.
    """
    t = rows.withColumn("_rb", range_bucket(position))
    inside = Window.partitionBy("_key", "_rb").orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("_pk").orderBy("_prb").rowsBetween(Window.unboundedPreceding, -1)
    tops = (t.groupBy(F.col("_key").alias("_pk"), F.col("_rb").alias("_prb")).agg(F.max("_rank").alias("_top"))
            .withColumn("_above", F.max("_top").over(before)).drop("_top"))
    j = t.withColumn("_inner", F.max("_rank").over(inside)).join(
        tops, (F.col("_key") == F.col("_pk")) & (F.col("_rb") == F.col("_prb")))
    beats = lambda c: F.col(c).isNull() | (F.col("_rank") > F.col(c))
    until_then = F.greatest("_held", "_inner", "_above")
    return j.where(beats("_inner") & beats("_above")).withColumn("_own", until_then["_p"] == F.col("_rank._p"))


assert set(TRANSLATIONS) <= set(LISTING_COLUMNS)
