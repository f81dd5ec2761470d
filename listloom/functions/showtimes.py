"""Showtimes read from time stamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def version_label(text: Column) -> Column:
    """Language label of a version heading."""
    t = F.lower(F.coalesce(text, F.lit("")))
    has = lambda x: F.contains(t, F.lit(x))
    return (F.when(has("vo") & ~has("vf"), "VO").when(has("vost"), "VOST").when(has("vfst"), "VFST").otherwise("Francais"))


def stamps_to_films(showings: DataFrame) -> DataFrame:
    """(title, stamp, version) rows to one row per film: day to times, first and last day, languages.

    Repeated stamps of a day count once; the times of a day and the days of a film are bounded by
    the clock and the calendar.
    """
    s = showings.select("title", F.substring("stamp", 1, 10).alias("day"), F.substring("stamp", 12, 5).alias("time"), "version")
    once = s.select("title", "day", "time").distinct()
    days = once.groupBy("title", "day").agg(F.array_sort(F.collect_list("time")).alias("times"))
    films = days.groupBy("title").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("day", "times")))).alias("showtimes"),
        F.min("day").alias("start_date"), F.max("day").alias("end_date"))
    langs = (s.select("title", "version").distinct().groupBy("title")
             .agg(F.array_join(F.array_sort(F.collect_list("version")), "|").alias("language")))
    return films.join(langs, "title")
