"""Published outputs: calendar feed, site map rows, structured data, JSON artefacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listloom.functions.text import date10, escape_html, summary


def ics_escape(c: Column, newlines: bool = False) -> Column:
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for mark in (";", ","):
        out = F.replace(out, F.lit(mark), F.lit("\\" + mark))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if newlines else out


def calendar_blocks(events: DataFrame, as_of: str, place: str = "", exclusive_end: bool = True,
                    start: str | None = None, end: str | None = None, slug: str | None = None) -> DataFrame:
    """One calendar entry per row as text (column ``block``), filtered by slug or by start date.

    All-day entries end on the day after the last, as the calendar standard has it; with
    ``exclusive_end`` off the last day itself is written.
    """
    e = events
    if slug:
        e = e.where(F.col("slug") == slug)
    else:
        if start:
            e = e.where(F.coalesce("start_date", F.lit("")) >= start)
        if end:
            e = e.where(F.coalesce("start_date", F.lit("")) <= end)
    nonempty = lambda c: F.nullif(F.col(c), F.lit(""))
    first = F.substring(F.coalesce(nonempty("start_date"), F.lit(as_of)), 1, 10)
    last = F.substring(F.coalesce(nonempty("end_date"), first), 1, 10)
    if exclusive_end:
        last = F.coalesce(F.date_format(F.date_add(F.try_to_date(last, "yyyy-MM-dd"), 1), "yyyy-MM-dd"), last)
    compact = lambda c: F.replace(c, F.lit("-"), F.lit(""))
    text = F.coalesce("description", F.lit(""))
    url = F.coalesce("source_url", F.lit(""))
    lines = F.array_compact(F.array(
        F.lit("BEGIN:VEVENT"),
        F.concat(F.lit("UID:"), F.coalesce(F.col("id").cast("string"), F.concat(F.lit("event-"), compact(first)))),
        F.concat(F.lit("DTSTART;VALUE=DATE:"), compact(first)),
        F.concat(F.lit("DTEND;VALUE=DATE:"), compact(last)),
        F.concat(F.lit("SUMMARY:"), ics_escape(F.coalesce(nonempty("title"), F.lit("Event")))),
        F.when(text != "", F.concat(F.lit("DESCRIPTION:"), ics_escape(text, True))),
        F.concat(F.lit("LOCATION:"), ics_escape(F.coalesce(nonempty("venue_name"), F.lit(place)))),
        F.when(url != "", F.concat(F.lit("URL:"), url)),
        F.lit("STATUS:CONFIRMED"), F.lit("END:VEVENT")))
    return e.withColumn("block", F.array_join(lines, "\r\n"))


def write_calendar(blocks: DataFrame, path: str, name: str, timezone: str = "UTC") -> None:
    """Write the feed as text parts that read in order: header, entries by start, footer."""
    head = ["BEGIN:VCALENDAR", "VERSION:2.0", f"PRODID:-//{name}//EN", "CALSCALE:GREGORIAN", "METHOD:PUBLISH",
            f"X-WR-CALNAME:{name}", f"X-WR-TIMEZONE:{timezone}"]
    spark = blocks.sparkSession
    ends = spark.createDataFrame([(0, "\r\n".join(head)), (2, "END:VCALENDAR")], "part int, value string") \
        .select("part", F.lit("").alias("s"), F.lit("").alias("i"), "value")
    body = blocks.select(F.lit(1).alias("part"), F.coalesce("start_date", F.lit("")).alias("s"),
                         F.col("id").cast("string").alias("i"), F.col("block").alias("value"))
    (ends.unionByName(body).orderBy("part", "s", "i").select("value")
     .write.mode("errorifexists").option("lineSep", "\r\n").text(path))


# The static pages of a published site with their priorities.
STATIC_PAGES = (("", "1.0"), ("/about.html", "0.7"), ("/submit.html", "0.5"), ("/review.html", "0.3"), ("/privacy.html", "0.3"))


def sitemap_rows(slugs: DataFrame, site: str, as_of: str) -> DataFrame:
    """(loc, lastmod, changefreq, priority): static pages weekly, one monthly row per unique slug."""
    fixed = slugs.sparkSession.createDataFrame(
        [(site + p, as_of, "weekly", prio) for p, prio in STATIC_PAGES],
        "loc string, lastmod string, changefreq string, priority string")
    nonempty = lambda c: F.nullif(F.col(c), F.lit(""))
    rows = slugs.select(
        F.concat(F.lit(f"{site}/events/"), "slug", F.lit(".html")).alias("loc"),
        date10(F.coalesce(nonempty("updated_at"), nonempty("created_at"), F.lit(as_of))).alias("lastmod"),
        F.lit("monthly").alias("changefreq"), F.lit("0.8").alias("priority"))
    return fixed.unionByName(rows)


def write_sitemap(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").format("xml").option("rootTag", "urlset").option("rowTag", "url").save(path)


def structured_data(events: DataFrame, site: str) -> DataFrame:
    """Add ``json_ld`` (nested event document) and social-card columns for each row with a ``slug``."""
    url = F.concat(F.lit(f"{site}/events/"), "slug", F.lit(".html"))
    e = lambda c: F.coalesce(F.col(c), F.lit(""))
    image = F.when((e("image_url") != "") & ~F.col("image_url").startswith("data:"), F.col("image_url"))
    end = F.when((e("end_date") != "") & (F.col("end_date") != e("start_date")), F.col("end_date"))
    doc = F.struct(
        F.lit("https://schema.org").alias("@context"), F.lit("Event").alias("@type"), F.col("title").alias("name"),
        e("description").alias("description"), e("start_date").alias("startDate"), url.alias("url"),
        F.lit("https://schema.org/OfflineEventAttendanceMode").alias("eventAttendanceMode"),
        F.lit("https://schema.org/EventScheduled").alias("eventStatus"),
        F.struct(F.lit("Place").alias("@type"), e("venue_name").alias("name"),
                 F.struct(F.lit("PostalAddress").alias("@type"), e("commune").alias("addressLocality")).alias("address")
                 ).alias("location"),
        end.alias("endDate"), image.alias("image"))
    text = F.replace(F.to_json(doc, {"ignoreNullFields": "true"}), F.lit("</script>"), F.lit("<\\/script>"))
    return events.withColumns({"json_ld": text, "og_url": url, "og_title": escape_html(F.col("title")),
                               "og_description": summary(F.col("description")), "og_image": image})
