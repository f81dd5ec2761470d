"""Lookup, enrichment, overlay and difference joins.

No join here forces a broadcast: Spark broadcasts a side when its measured size is below the session
threshold and otherwise sorts and merges, with adaptive execution splitting skewed partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listloom.functions.scoring import trust_of
from listloom.functions.text import ascii_title, filled, has_value, norm_url, normalize_title
from listloom.windows import first_per_key

REGISTRY_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), False), T.StructField("name", T.StringType()),
    T.StructField("type", T.StringType()), T.StructField("base_url", T.StringType()),
    T.StructField("trust_level", T.StringType()), T.StructField("cadence_hours", T.IntegerType()),
    T.StructField("active", T.BooleanType()), T.StructField("notes", T.StringType()),
    T.StructField("min_publish_confidence", T.DoubleType()),
])


def registry_lookup(df: DataFrame, registry: DataFrame, global_threshold: float = 0.6) -> DataFrame:
    """Add ``baseline`` (0.5 for unknown sources) and ``threshold`` (own, else global)."""
    r = registry.select(F.col("id").alias("_rid"), trust_of(F.col("trust_level")).alias("_b"),
                        F.col("min_publish_confidence").alias("_t"))
    return (df.join(r, F.col("source_id") == F.col("_rid"), "left")
            .withColumns({"baseline": F.coalesce("_b", F.lit(0.5)),
                          "threshold": F.coalesce("_t", F.lit(global_threshold))})
            .drop("_rid", "_b", "_t"))


def resolved_by_name(events: DataFrame, venues: DataFrame) -> DataFrame:
    """Events whose venue name is that of a venue with both coordinates. Names repeat safely."""
    located = venues.where("latitude is not null and longitude is not null").select(F.col("name").alias("_n"))
    return events.where(has_value("venue_name")).join(located, F.col("venue_name") == F.col("_n"), "left_semi")


def fill_missing(df: DataFrame, details: DataFrame, key: Column, detail_key: Column, fields: Sequence[str],
                 position: str, last_wins: bool = False, flag: str = "changed") -> DataFrame:
    """Fill empty fields from the detail row with the same key; ``flag`` tells whether any was filled.

    Of several details with one key the first by ``position`` is used, or the last.
    """
    order = F.col(position).desc() if last_wins else F.col(position).asc()
    d = details.withColumn("_dk", detail_key).where("_dk <> ''")
    d = first_per_key(d, ["_dk"], [order]).select("_dk", *[F.col(f).alias(f"_d_{f}") for f in fields])
    joined = df.withColumn("_k", key).join(d, F.col("_k") == F.col("_dk"), "left")
    own = {f: filled(f) if f in df.columns else F.lit(None) for f in fields}
    changed = F.lit(False)
    for f in fields:
        changed = changed | (own[f].isNull() & filled(f"_d_{f}").isNotNull())
    out = joined.withColumn(flag, changed)
    values = {f: F.when(own[f].isNull() & filled(f"_d_{f}").isNotNull(), F.col(f"_d_{f}"))
              .otherwise(F.col(f) if f in df.columns else F.lit(None)) for f in fields}
    return out.withColumns(values).drop("_k", "_dk", *[f"_d_{f}" for f in fields])


def enrich_by_title(df: DataFrame, details: DataFrame, fields: Sequence[str], position: str) -> DataFrame:
    return fill_missing(df, details, ascii_title(F.col("title")), ascii_title(F.col("title")), fields, position, True)


def enrich_by_url(df: DataFrame, details: DataFrame, fields: Sequence[str], position: str) -> DataFrame:
    return fill_missing(df, details, norm_url(F.col("source_url")), norm_url(F.col("source_url")), fields, position)


def enrich_two_tier(store: DataFrame, incoming: DataFrame, fields: Sequence[str], position: str,
                    incoming_position: str) -> DataFrame:
    """Fill empty fields of stored rows from incoming rows with the same title.

    An incoming row looks for its normalised title among the stored ones and, only when that finds
    nothing, for its lower-cased title. Just the first stored row of a bucket is ever changed, and
    the earliest incoming row with a value supplies it. Adds ``changed``.
    """
    lower = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    s = store.select(F.col(position).alias("_pos"), normalize_title(F.col("title")).alias("_n"), lower("title").alias("_l"))
    by_norm = s.groupBy("_n").agg(F.min("_pos").alias("_t1"))
    by_low = s.groupBy("_l").agg(F.min("_pos").alias("_t2"))
    inc = incoming.where(has_value("title")).select(
        normalize_title(F.col("title")).alias("_in"), lower("title").alias("_il"),
        F.col(incoming_position).alias("_ip"), *[filled(f).alias(f"_d_{f}") for f in fields])
    target = (inc.join(by_norm, F.col("_in") == F.col("_n"), "left").join(by_low, F.col("_il") == F.col("_l"), "left")
              .withColumn("_target", F.coalesce("_t1", "_t2")).where("_target is not null"))
    supply = target.groupBy("_target").agg(*[
        F.min_by(f"_d_{f}", F.when(F.col(f"_d_{f}").isNotNull(), F.col("_ip"))).alias(f"_d_{f}") for f in fields])
    joined = store.join(supply, F.col(position) == F.col("_target"), "left")
    empty = {f: F.coalesce(F.col(f), F.lit("")) == "" for f in fields}
    changed = F.lit(False)
    for f in fields:
        changed = changed | (empty[f] & F.col(f"_d_{f}").isNotNull())
    out = joined.withColumn("changed", changed)
    return out.withColumns({f: F.when(empty[f] & F.col(f"_d_{f}").isNotNull(), F.col(f"_d_{f}")).otherwise(F.col(f))
                            for f in fields}).drop("_target", *[f"_d_{f}" for f in fields])


def carry_forward(incoming: DataFrame, stored: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Incoming rows keep the stored value of a field they leave empty. Keys are unique in ``stored``."""
    old = stored.select(F.col(key).alias("_ck"), *[F.col(f).alias(f"_s_{f}") for f in fields])
    joined = incoming.join(old, F.col(key) == F.col("_ck"), "left")
    nonempty = lambda c: F.nullif(F.col(c), F.lit(""))
    return joined.withColumns({f: F.coalesce(nonempty(f), nonempty(f"_s_{f}"), F.col(f)) for f in fields}) \
        .drop("_ck", *[f"_s_{f}" for f in fields])


def gap_fill(primary: DataFrame, secondary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All primary rows, and the secondary rows whose key the primary ones lack."""
    have = primary.select(*[F.col(k).alias(f"_p_{k}") for k in keys]).distinct()
    cond = F.lit(True)
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_p_{k}"))
    return primary.unionByName(secondary.join(have, cond, "left_anti"), allowMissingColumns=True)


def detail_over_listing(listing: DataFrame, detail: DataFrame, key: str, fields: Sequence[str],
                        category: str | None = "category") -> DataFrame:
    """A filled detail value replaces the listing's; a category only when it says more than ``other``."""
    names = [*fields, category] if category else list(fields)
    d = detail.select(F.col(key).alias("_dk"), *[F.col(f).alias(f"_d_{f}") for f in names])
    out = listing.join(d, F.col(key) == F.col("_dk"), "left")
    values = {f: F.coalesce(F.nullif(F.col(f"_d_{f}"), F.lit("")), F.col(f)) for f in fields}
    if category:
        better = F.coalesce(F.col(f"_d_{category}"), F.lit("other")) != "other"
        values[category] = F.when(better, F.col(f"_d_{category}")).otherwise(F.col(category))
    return out.withColumns(values).drop("_dk", *[f"_d_{f}" for f in names])


def coordinate_pair(lat: Column, lng: Column) -> Column:
    """The pair as a struct when both are present and not both zero."""
    return F.when(lat.isNotNull() & lng.isNotNull() & ((lat != 0) | (lng != 0)),
                  F.struct(lat.alias("latitude"), lng.alias("longitude")))


def curation_overlay(venues: DataFrame, refined: DataFrame, manual: DataFrame, curated: DataFrame,
                     fields: Sequence[str] = ("postal_code", "address")) -> DataFrame:
    """Coordinates: none for venues under manual review, else refined, else stored; plus their origin.

    Curated text fields overwrite only where they have a value. All sides are unique by ``id``.
    """
    r = refined.select(F.col("id").alias("_r"), coordinate_pair(F.col("latitude"), F.col("longitude")).alias("_rp"))
    m = manual.select(F.col("id").alias("_m"))
    c = curated.select(F.col("id").alias("_c"), *[filled(f).alias(f"_c_{f}") for f in fields])
    j = (venues.join(r, F.col("id") == F.col("_r"), "left").join(m, F.col("id") == F.col("_m"), "left")
         .join(c, F.col("id") == F.col("_c"), "left"))
    stored = coordinate_pair(F.col("latitude"), F.col("longitude"))
    pair = F.when(F.col("_m").isNull(), F.coalesce("_rp", stored))
    origin = (F.when(F.col("_m").isNotNull(), "manual").when(F.col("_rp").isNotNull(), "refined")
              .when(stored.isNotNull(), "stored"))
    out = j.withColumns({"_pair": pair, "coordinate_source": origin})
    values = {"latitude": F.col("_pair.latitude"), "longitude": F.col("_pair.longitude")}
    values |= {f: F.coalesce(F.col(f"_c_{f}"), F.col(f)) for f in fields}
    return out.withColumns(values).drop("_pair", "_r", "_rp", "_m", "_c", *[f"_c_{f}" for f in fields])


def unseen(rows: DataFrame, seen: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
    """(rows whose key was never seen, the seen keys plus theirs). ``seen`` has one column, ``key``."""
    keyed = rows.withColumn("_key", key)
    fresh = keyed.join(seen, F.col("_key") == F.col("key"), "left_anti")
    grown = seen.select("key").union(fresh.select(F.col("_key").alias("key"))).distinct()
    return fresh.drop("_key"), grown


def orphans(published: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Published keys that are no longer expected."""
    return published.select(key).distinct().join(expected.select(key), key, "left_anti")


def compare_extractions(old: DataFrame, new: DataFrame, key: str, text: str, ratio: float = 0.5,
                        min_length: int = 120) -> DataFrame:
    """Per key both text lengths, whether the new one lost too much, and whether it is long enough."""
    o = old.select(F.col(key), F.length(F.coalesce(text, F.lit(""))).alias("len_old"))
    n = new.select(F.col(key), F.length(F.coalesce(text, F.lit(""))).alias("len_new"))
    return o.join(n, key).withColumns({
        "regression": (F.col("len_old") > 0) & (F.col("len_new") < F.col("len_old") * ratio),
        "long_enough": F.col("len_new") >= min_length,
    })


def comparison_verdict(compared: DataFrame) -> DataFrame:
    return compared.agg(
        F.count("*").alias("n"), F.count_if("regression").alias("regressions"),
        F.coalesce(~F.bool_or("regression"), F.lit(True)).alias("passed"),
        F.round(F.avg(F.col("long_enough").cast("double")), 4).alias("long_share"),
        F.round(F.avg("len_old"), 4).alias("mean_old"), F.round(F.avg("len_new"), 4).alias("mean_new"))


def pending_work(rows: DataFrame, cache: DataFrame, key: str, need: Column) -> DataFrame:
    """Rows that still need a value and were never looked up; cached misses count as looked up."""
    return rows.where(need).join(cache.select(key), key, "left_anti")


def merge_results(rows: DataFrame, results: DataFrame, key: str, fields: Sequence[str],
                  overwrite: bool = False) -> DataFrame:
    """Fold delivered values into the rows by key; empty and unchanged values are skipped.

    Adds ``changed``. ``results`` is unique by key.
    """
    r = results.select(F.col(key).alias("_rk"), *[filled(f).alias(f"_r_{f}") for f in fields])
    j = rows.join(r, F.col(key) == F.col("_rk"), "left")
    take = {f: F.col(f"_r_{f}").isNotNull() & ~F.col(f"_r_{f}").eqNullSafe(F.col(f))
            & (F.lit(overwrite) | filled(f).isNull()) for f in fields}
    changed = F.lit(False)
    for f in fields:
        changed = changed | take[f]
    out = j.withColumn("changed", changed)
    return out.withColumns({f: F.when(take[f], F.col(f"_r_{f}")).otherwise(F.col(f)) for f in fields}) \
        .drop("_rk", *[f"_r_{f}" for f in fields])
