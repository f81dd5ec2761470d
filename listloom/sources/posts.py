"""Listings out of free text: sectioned pages, posts, and text laid out on a grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from listloom.functions.dates import MONTHS_SHORT, month_number
from listloom.functions.text import strip

# How a dated line of a section looks.
DATED_LINE = r"^[\p{L}\p{N}_]{3},\s*(\d{1,2})\s*([\p{L}\p{N}_]{3})\s*at\s*(\d{2}:\d{2})\s*(UTC|UTC[+-]\d+)"
POST_DATES = (
    r"(?iu)(?<!\d)\d{1,2}\s*(?:juin|juillet|ao[uû]t|septembre|octobre|novembre|d[eé]cembre|janvier|f[eé]vrier|mars|avril|mai)(?!\p{L})\s*(?:\d{4})?",
    r"(?<!\d)\d{1,2}/\d{1,2}/\d{4}(?!\d)",
)


def lines_of(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda s: s != "")


def _places(lines: Column, test) -> Column:
    """Zero-based places of the lines that pass a test."""
    return F.array_compact(F.transform(lines, lambda s, i: F.when(test(s), i)))


def section_records(docs: DataFrame, text: str, year: int, begin: str = "upcoming", finish: str = "past",
                    owner: str = "Event by", dated: str = DATED_LINE, title_cap: int | None = None) -> DataFrame:
    """Records between two marker lines: a dated line opens one, the next longer line is its title.

    A line that names the owner is the description and never a title: without another one there is no record. Works inside the row with array functions: no shuffle, and a long document is one value anyway.
    """
    # a cheap test first: without an opening line there is nothing to take apart
    d = docs.where(F.col(text).rlike(rf"(?imu)^[\s\p{{Z}}]*{begin}[\s\p{{Z}}]*$")).withColumn("_l", lines_of(F.col(text)))
    d = d.withColumns({"_b": _places(F.col("_l"), lambda s: s.rlike(rf"(?iu)^{begin}$")),
                       "_f": _places(F.col("_l"), lambda s: s.rlike(rf"(?iu)^{finish}$"))})
    end = F.coalesce(F.array_min(F.filter("_f", lambda i: i > F.get("_b", F.lit(0)))), F.size("_l"))
    d = d.withColumn("_end", end)
    start = F.array_max(F.filter("_b", lambda i: i < F.col("_end")))
    d = d.withColumn("_s", F.slice("_l", start + 2, F.greatest(F.col("_end") - start - 1, F.lit(0))))
    d = d.withColumn("_d", _places(F.col("_s"), lambda s: s.rlike(dated)))
    parts = F.transform("_d", lambda at, k: F.struct(
        F.get("_s", at).alias("head"),
        F.slice("_s", at + 2, F.coalesce(F.get("_d", k + 1), F.size("_s")) - at - 1).alias("body")))
    r = d.select(*docs.columns, F.posexplode(parts).alias("record", "_r"))
    body, at = F.col("_r.body"), F.col("_at")
    r = r.withColumn("_at", F.array_min(_places(body, lambda s: (F.length(s) > 3) & ~s.startswith(owner))))
    credits = F.filter(body, lambda s, i: (i > at) & s.startswith(owner))
    g = lambda i: F.regexp_extract("_r.head", dated, i)
    month = F.coalesce(month_number(g(2), MONTHS_SHORT), F.lit(1))
    return r.where(at.isNotNull()).select(
        *docs.columns, "record", _capped(F.get(body, at), title_cap).alias("title"),
        F.coalesce(F.get(credits, F.size(credits) - 1), F.lit("")).alias("description"),
        F.format_string("%04d-%02d-%02d", F.lit(year), month, g(1).try_cast("int")).alias("start_date"),
        g(3).alias("time"))


def _capped(text: Column, cap: int | None) -> Column:
    return text if cap is None else F.substring(text, 1, cap)


def post_records(posts: DataFrame, text: str, patterns: Sequence[str] = POST_DATES, title_cap: int | None = None, text_cap: int | None = None) -> DataFrame:
    """One record per post of two lines or more: title, text, first date found, first image and link."""
    p = posts.withColumn("_l", lines_of(F.col(text))).where(F.size("_l") >= 2)
    first = F.get("_l", F.lit(0))
    title = F.when(F.length(first) < 3, F.get("_l", F.lit(1))).otherwise(first)
    hits = [F.nullif(F.regexp_extract(F.col(text), x, 0), F.lit("")) for x in patterns]
    out = {"title": _capped(title, title_cap), "description": _capped(F.col(text), text_cap),
           "event_date": F.coalesce(*hits, F.lit(""))}
    for name, source in (("image_url", "images"), ("source_url", "links")):
        out[name] = F.coalesce(F.get(source, F.lit(0)), F.lit("")) if source in posts.columns else F.lit("")
    return p.withColumns(out).drop("_l")


def number_records(rows: DataFrame, keys: Sequence[str], order: str, starts: Column, out: str = "record") -> DataFrame:
    """Number the records of a line table: a running count of the rows that open one."""
    from listloom.windows import running_sum
    return running_sum(rows, keys, order, F.coalesce(starts.cast("int"), F.lit(0)), out)


# --- timetable grid -------------------------------------------------------------------------------

# Column edges of the seven days, the title column, and the lines that are not content.
DAY_COLUMNS = ((0, 170, 250), (1, 250, 290), (2, 290, 340), (3, 340, 380), (4, 380, 440), (5, 440, 490), (6, 490, 600))
TITLE_EDGE = 170
GRID_HEADER, GRID_FOOTERS = "FILMS", ("VF :", "TARIF NORMAL", "Version originale")
GRID_SKIP = r"^(Mer|Jeu|Ven|Sam|Dim|Lun|Mar)$|^\d{1,2}$|FERMETURE"
SECTION_MARK = r"(?i)^\s*(?:(?:Summer|Little)?\s*film\s+festival)\s*$"
PREFIX_MARK = r"(?i)^\s*int\.?\s*[—\-]?\s*\d+\s*ans\s*$"
DURATION = r"(\d+)[Hh](\d+)"
#: A film in the kinds of a page's rows (Title, Prefix, Duration, Section mark, x for times): what stands before the first one joins it.
GRID_FILM = r"(?:^[xS]+)?(?:[TP][xTP]*(?:D[xS]*|S[xSP]*)?|D[xS]*)"


def grid_films(rows: DataFrame, page: str = "page", week_start: str = "week_start",
               columns: Sequence[tuple[int, int, int]] = DAY_COLUMNS, title_edge: int = TITLE_EDGE) -> DataFrame:
    """Films of a timetable given as positioned texts: (page, week_start, y, x, text, position).

    Rows between the header and the footer are read from top to bottom. A title row with a duration
    closes a film's title, earlier title rows without one belong to it; a section mark belongs to the
    film before it, and when that film had no duration, the mark ends it. Times right of the title
    edge go to the day of their column. Rows are told apart before they travel; those of a page come together
    once, as a list, in which the letters of their kinds tell the films: they fit a sheet of paper.
    """
    text = F.trim("text")
    footer = F.lit(False)
    for f in GRID_FOOTERS:
        footer = footer | F.contains("text", F.lit(f))
    kind = F.when(text == GRID_HEADER, "H").when(footer, "E").when(text.isNull() | F.col("text").rlike(GRID_SKIP), None) \
        .when(F.col("x") >= title_edge, "x").when(F.col("text").rlike(DURATION), "D") \
        .when(F.col("text").rlike(SECTION_MARK), "S").when(F.col("text").rlike(PREFIX_MARK), "P").otherwise("T")
    r = rows.withColumn("_k", kind)

    own = F.trim(F.regexp_replace("text", r"\s*\d+[Hh]\d+.*$", ""))
    part = F.when(F.col("_k") == "D", own).when(F.col("_k").isin("S", "P", "T"), text)
    dur = F.when(F.col("_k") == "D", F.lower(F.regexp_extract("text", DURATION, 0)))
    day = F.coalesce(*[F.when((F.col("x") >= lo) & (F.col("x") < hi), i) for i, lo, hi in columns])
    tail = F.regexp_replace("text", r"^.*?\d+[Hh]\d+\s*", "")
    src = F.when(F.col("_k") == "x", F.col("text")).when(F.col("_k") == "D", tail)
    col = F.when(F.col("_k") == "x", day).when(F.col("_k") == "D", F.lit(0))
    date = F.date_add(F.to_date(week_start), F.col("_col"))
    found = F.when(F.col("_col").isNotNull(), F.regexp_extract_all("_src", F.lit(r"\d+[Hh]\d+"), 0))
    r = r.withColumns({"_part": F.nullif(part, F.lit("")), "_dur": dur, "_src": src, "_col": col})
    r = r.withColumns({"_times": F.coalesce(F.transform(found, lambda t: F.struct(date.alias("day"), F.regexp_replace(t, "[Hh]", ":").alias("time"))),
                                            F.array().cast("array<struct<day:date,time:string>>"))})

    # rows of no kind become null, which the list leaves out: a filter would find the kinds once more
    row = F.when(F.col("_k").isNotNull(), F.struct("y", "position", "_part", "_k", "_dur", "_times"))
    pages = r.groupBy(page).agg(F.sort_array(F.collect_list(row)).alias("_r"))
    begin = F.array_position(F.col("_r._k"), "H").cast("int")
    pages = pages.where(begin > 0).withColumn("_r", F.slice("_r", begin + 1, F.size("_r")))
    end = F.array_position(F.col("_r._k"), "E").cast("int")
    pages = pages.withColumn("_r", F.filter(F.when(end > 0, F.slice("_r", F.lit(1), end - 1)).otherwise(F.col("_r")), lambda x: x["_k"] != "H"))
    # marks before the first title belong to no film
    pages = pages.withColumn("_s", F.array_join("_r._k", ""))
    pages = pages.withColumns({"_n": F.transform(F.regexp_extract_all("_s", F.lit(GRID_FILM), 0), F.length), "_lead": F.length(F.regexp_extract("_s", "^[xS]*", 0))})
    pages = pages.withColumn("_at", F.aggregate("_n", F.array(F.lit(1)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n))))

    def film(n: Column, i: Column) -> Column:
        lead = F.when(i == 0, F.col("_lead")).otherwise(0)
        return F.get(F.transform(F.array(F.slice("_r", F.get("_at", i), n)), lambda own: F.struct(
            F.array_join(F.slice(own["_part"], lead + 1, n - lead), " ").alias("title"), F.array_max(own["_dur"]).alias("dur"),
            F.flatten(own["_times"]).alias("shows"))), F.lit(0))

    films = pages.select(page, F.posexplode(F.transform("_n", film)).alias("_i", "_f"))
    films = films.where((F.size("_f.shows") > 0) & (F.col("_f.title") != "")).withColumn("_shows", F.sort_array(F.array_distinct("_f.shows")))
    days = F.array_distinct("_shows.day")
    shows = F.map_from_entries(F.transform(days, lambda d: F.struct(
        d.cast("string").alias("day"), F.filter("_shows", lambda t: t["day"] == d)["time"].alias("times"))))
    # inline keeps what a reader asks of the map from being asked by making it again
    return films.select(page, (F.col("_i") + 1).cast("long").alias("film"), F.inline(F.array(F.struct(
        F.regexp_replace("_f.title", r"\s+", " ").alias("title"), F.coalesce("_f.dur", F.lit("")).alias("duration"), shows.alias("showtimes"),
        F.array_min(days).cast("string").alias("start_date"), F.array_max(days).cast("string").alias("end_date")))))


def week_of(text: Column, as_of: Column, months) -> Column:
    """First day of ``Du d au d month``; a start after the end lies in the month before."""
    p = r"(?i)Du\s+(\d+)\s+au\s+(\d+)\s+([a-z]+)"
    g = lambda i: F.regexp_extract(text, p, i)
    d1, d2 = g(1).try_cast("int"), g(2).try_cast("int")
    m = F.coalesce(month_number(g(3), months), F.month(as_of))
    first = F.try_make_timestamp(F.year(as_of), m, F.lit(1), F.lit(0), F.lit(0), F.lit(0)).cast("date")
    return F.when(text.rlike(p), F.date_add(F.when(d1 > d2, F.add_months(first, -1)).otherwise(first), d1 - 1))
