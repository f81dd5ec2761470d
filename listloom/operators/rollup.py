"""Counts, histograms, venue and film rollups, calendar counters and capped lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listloom.functions.text import date10, filled, has_value
from listloom.operators.review import STATUSES
from listloom.windows import first_per_key, top_per_key

# The five score bins, the last one open at the top.
BINS = ("0.0-0.2", "0.2-0.4", "0.4-0.6", "0.6-0.8", "0.8-1.0")


def table_counts(**tables: DataFrame) -> DataFrame:
    parts = [df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n")) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def status_counts(df: DataFrame, statuses: Sequence[str] = STATUSES) -> DataFrame:
    """Rows per status; expected statuses that do not occur count zero."""
    wanted = df.sparkSession.createDataFrame([(s,) for s in statuses], "status string")
    have = df.where("status is not null").groupBy("status").agg(F.count("*").alias("n"))
    return wanted.join(have, "status", "full_outer").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def group_counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), key)


def distinct_sources(df: DataFrame) -> DataFrame:
    return df.where("source_id is not null").select("source_id").distinct().orderBy("source_id")


def trust_summary(registry: DataFrame) -> DataFrame:
    """Active sources per trust level, the three known levels always listed."""
    return status_counts(registry.where("active").select(F.col("trust_level").alias("status")),
                         ("high", "medium", "low")).withColumnRenamed("status", "trust_level")


def score_bin(score: Column) -> Column:
    s = F.coalesce(score, F.lit(0.0))
    return (F.when(s < 0.2, BINS[0]).when(s < 0.4, BINS[1]).when(s < 0.6, BINS[2]).when(s < 0.8, BINS[3])
            .otherwise(BINS[4]))


def score_histogram(df: DataFrame, score: str = "confidence") -> DataFrame:
    """One row: rows per bin, total, mean, least and greatest score; zeros for an empty table."""
    s = F.coalesce(F.col(score), F.lit(0.0))
    b = score_bin(F.col(score))
    counts = [F.count_if(b == name).alias("bin_" + name.replace(".", "").replace("-", "_")) for name in BINS]
    # the reported least starts at 1 and the greatest at 0, whatever the scores
    some = lambda c: F.when(F.count("*") > 0, F.round(c, 3)).otherwise(F.lit(0.0))
    return df.agg(*counts, F.count("*").alias("total"),
                  F.coalesce(F.round(F.sum(s) / F.nullif(F.count("*"), F.lit(0)), 3), F.lit(0.0)).alias("mean"),
                  some(F.least(F.min(s), F.lit(1.0))).alias("least"), some(F.greatest(F.max(s), F.lit(0.0))).alias("greatest"))


def length_coverage(df: DataFrame, text: str = "description", min_length: int = 120) -> DataFrame:
    long = F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) >= min_length
    return df.agg(F.count_if(long).alias("with_text"), F.count("*").alias("total"))


def venue_rollup(events: DataFrame, reference: DataFrame, position: str, default_commune: str = "") -> DataFrame:
    """Per resolved venue: number of events, sorted categories, first image, first position.

    Reference venues without events keep their curated categories and count zero; venues the
    reference lacks get a row made from their first event. Positions are given as rows by
    ``venue_positions``: a popular venue would not fit into one array.
    """
    e = events.where("venue is not null")
    # categories by way of distinct (venue, category) rows, so no set grows inside one buffer
    cats = (e.select("venue", "category").distinct().groupBy("venue")
            .agg(F.sort_array(F.collect_list(F.coalesce("category", F.lit("other")))).alias("_cats")))
    image = F.col("image_url")
    rows = e.groupBy("venue").agg(
        F.count("*").alias("_n"), F.min(position).alias("_first"),
        F.min_by(image, F.when(filled("image_url").isNotNull(), F.col(position))).alias("_image"),
        F.min_by(F.initcap("category"), position).alias("_type"), F.min_by("commune", position).alias("_commune"))
    r = reference.select(F.col("name").alias("_name"), F.col("categories").alias("_curated"),
                         F.col("type").alias("_rtype"), F.col("location").alias("_loc"))
    j = rows.join(cats, "venue").join(r, F.col("venue") == F.col("_name"), "full_outer")
    return j.select(
        F.coalesce("_name", "venue").alias("venue"), F.coalesce("_n", F.lit(0)).alias("n"),
        F.coalesce("_cats", "_curated", F.array().cast("array<string>")).alias("categories"),
        F.coalesce("_image", F.lit("")).alias("image"), F.col("_first").alias("first_position"),
        F.coalesce("_rtype", "_type").alias("type"),
        F.coalesce("_loc", "_commune", F.lit(default_commune)).alias("location"),
        F.col("_name").isNotNull().alias("curated"))


def venue_positions(events: DataFrame, position: str) -> DataFrame:
    """(venue, position) rows: which events belong to a venue."""
    return events.where("venue is not null").select("venue", F.col(position).alias("position"))


def active_venues(events: DataFrame, as_of: str) -> DataFrame:
    """Venues with current or coming events, by name."""
    start = F.substring(F.coalesce("start_date", F.lit("")), 1, 10)
    end = F.coalesce(F.nullif(F.substring("end_date", 1, 10), F.lit("")), start)
    return (events.where((end >= as_of) & has_value("venue_name")).groupBy("venue_name")
            .agg(F.count("*").alias("n")).orderBy("venue_name"))


def calendar_counters(events: DataFrame, as_of: str, overlap: bool = False) -> DataFrame:
    """Starts in the next seven days, today, and on the coming weekend.

    On a Sunday the weekend counted is that Sunday and the Monday after it. With ``overlap`` an event
    counts on every day it runs, not only on its first.
    """
    today = F.lit(as_of).cast("date")
    dow = F.dayofweek(today)  # 1 is Sunday
    sat = F.date_add(today, F.when(dow == 1, 0).otherwise(7 - dow).cast("int"))
    fmt = lambda d: F.date_format(d, "yyyy-MM-dd")
    day = F.nullif(F.substring("start_date", 1, 10), F.lit(""))
    last = F.coalesce(F.nullif(F.substring("end_date", 1, 10), F.lit("")), day) if overlap else day
    within = lambda lo, hi: (day <= fmt(hi)) & (last >= fmt(lo))
    return events.agg(F.count_if(within(today, F.date_add(today, 6))).alias("week"),
                      F.count_if(within(today, today)).alias("today"),
                      F.count_if(within(sat, F.date_add(sat, 1))).alias("weekend"))


def film_rollup(showings: DataFrame, meta: Sequence[str] = (), title: str = "title", position: str = "position") -> DataFrame:
    """One row per trimmed title: first metadata wins, days mapped to times in first-seen order.

    ``showings`` has title, day, time and position rows. Times of a day are at most the minutes of
    a day, days at most the calendar, so the two collected levels are bounded.
    """
    s = showings.withColumn("_t", F.trim(title)).where("_t <> '' and day is not null and time is not null")
    times = s.groupBy("_t", "day", "time").agg(F.min(position).alias("_p"))
    days = times.groupBy("_t", "day").agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "time"))),
                                                      lambda x: x["time"]).alias("times"))
    films = days.groupBy("_t").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("day", "times")))).alias("showtimes"))
    first = s.groupBy("_t").agg(F.min(position).alias("first_position"), *[F.min_by(m, position).alias(m) for m in meta])
    return films.join(first, "_t").withColumnRenamed("_t", title)


def showings_per_day(films: DataFrame, as_of: str) -> DataFrame:
    """Today and later: number of showings per day."""
    return (films.select(F.explode("showtimes").alias("day", "times")).where(F.col("day") >= as_of)
            .groupBy("day").agg(F.sum(F.size("times")).alias("showings")).orderBy("day"))


def day_programme(films: DataFrame, day: str) -> DataFrame:
    """Films of a day by the hour of their first showing."""
    t = F.try_element_at("showtimes", F.lit(day))
    hour = F.split(F.get(t, F.lit(0)), ":")[0].try_cast("int")
    return films.where(F.size(t) > 0).select("title", t.alias("times"), hour.alias("hour")).orderBy("hour", "title")


def sort_times(times: Column, numeric: bool = False) -> Column:
    """Distinct times of a day in text order of their parts, or by the minute with ``numeric``."""
    distinct = F.array_distinct(times)
    if numeric:
        key = lambda t: F.split(t, ":")[0].try_cast("int") * 60 + F.split(t, ":")[1].try_cast("int")
        return F.transform(F.array_sort(F.transform(distinct, lambda t: F.struct(key(t).alias("k"), t.alias("t")))),
                           lambda x: x["t"])
    return F.transform(F.array_sort(F.transform(distinct, lambda t: F.split(t, ":"))), lambda p: F.array_join(p, ":"))


def sort_showtimes(m: Column, numeric: bool = False) -> Column:
    return F.transform_values(m, lambda _k, v: sort_times(v, numeric))


def markers(events: DataFrame, venues: DataFrame, order: Sequence[Column], pad: float = 0.15) -> tuple[DataFrame, DataFrame]:
    """(first event of every venue with coordinates, bounding box padded by a share of its sides)."""
    v = venues.where("latitude <> 0 and longitude <> 0").select(
        F.col("name").alias("_v"), "latitude", "longitude")
    v = first_per_key(v, ["_v"], [F.col("latitude").asc(), F.col("longitude").asc()])
    first = first_per_key(events.where(has_value("venue_name")), ["venue_name"], list(order))
    m = first.join(v, F.col("venue_name") == F.col("_v")).drop("_v")
    dlat = (F.max("latitude") - F.min("latitude")) * pad
    dlng = (F.max("longitude") - F.min("longitude")) * pad
    box = m.agg((F.min("latitude") - dlat).alias("south"), (F.max("latitude") + dlat).alias("north"),
                (F.min("longitude") - dlng).alias("west"), (F.max("longitude") + dlng).alias("east"))
    return m, box


def reason_class(reason: Column) -> Column:
    r = F.coalesce(reason, F.lit(""))
    return (F.when(r == "duplicate", "duplicate").when(r == "low_confidence", "low confidence")
            .when(r.startswith("excluded_pattern:"), "excluded pattern").otherwise("other"))


# Order of the classes in the report.
REPORT_ORDER = ("excluded pattern", "low confidence", "duplicate", "other")


def drop_report(drops: DataFrame, position: str, shown: int = 12) -> DataFrame:
    """Held-back rows per class: place in the report, total, first titles, how many more."""
    d = drops.withColumn("class", reason_class(F.col("reason")))
    total = d.groupBy("class").agg(F.count("*").alias("total"))
    head = top_per_key(d.select("class", position, F.coalesce("title", F.lit("?")).alias("title")), ["class"],
                       [F.col(position).asc()], shown, "_r")
    titles = head.groupBy("class").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "title"))),
                                                   lambda x: x["title"]).alias("titles"))
    place = F.array_position(F.array(*[F.lit(c) for c in REPORT_ORDER]), F.col("class"))
    return total.join(titles, "class").select(
        place.cast("int").alias("place"), "class", "total", "titles",
        F.greatest(F.col("total") - shown, F.lit(0)).alias("more")).orderBy("place")


def capped_list(rows: DataFrame, keys: Sequence[str], item: str, cap: int = 15) -> DataFrame:
    """Per key the first items in order as one text, ``…and N more`` behind, and the total."""
    head = top_per_key(rows.select(*keys, item), keys, [F.col(item).asc()], cap, "_r")
    shown = head.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    total = rows.groupBy(*keys).agg(F.count(item).alias("total"))
    text = F.array_join("_items", "; ")
    more = F.concat(text, F.lit("  …and "), (F.col("total") - cap).cast("string"), F.lit(" more"))
    return total.join(shown, list(keys)).select(*keys, "total", F.when(F.col("total") > cap, more).otherwise(text).alias("shown"))


def today_top(events: DataFrame, as_of: str, position: str, n: int = 6) -> DataFrame:
    """The first rows that start today, in feed order."""
    return events.where(date10(F.col("start_date")) == as_of).orderBy(position).limit(n)
