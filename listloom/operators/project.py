"""Canonical rows, locale fields, row filters and predicate builders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listloom.functions.text import filled, last_segment, slug, strip_tags

# The stored columns of a listing, in order.
LISTING_COLUMNS = (
    "id", "source_id", "title", "description", "start_date", "end_date", "time", "venue_id", "category",
    "commune", "source_url", "image_url", "price", "venue_name", "address", "contact_phone", "website",
    "status", "confidence", "created_at", "updated_at", "title_en", "title_fr", "description_en",
    "description_fr", "venue_name_en", "venue_name_fr",
)
LISTING_SCHEMA = T.StructType([
    T.StructField(c, T.DoubleType() if c == "confidence" else T.StringType()) for c in LISTING_COLUMNS
])
LOCALE_FIELDS = ("title", "description", "venue_name", "name")


def _col(df: DataFrame, name: str, dtype: T.DataType) -> Column:
    return F.col(name).cast(dtype) if name in df.columns else F.lit(None).cast(dtype)


def canonical(df: DataFrame, now: str, source: str = "unknown", commune: str | None = None,
              keep: Sequence[str] = ()) -> DataFrame:
    """Any record as the 27 listing columns with defaults; id from title and date when missing.

    Columns named in ``keep`` (a position, say) are carried along unchanged.

    A column the input lacks takes its default; a column it has keeps its own nulls, except those
    that are filled when empty (id, source_id, description, created_at, updated_at).
    """
    c = {f.name: _col(df, f.name, f.dataType) for f in LISTING_SCHEMA}
    when_absent = {"title": F.lit(""), "category": F.lit("other"), "commune": F.lit(commune),
                   "status": F.lit("published"), "confidence": F.lit(1.0)}
    for name, value in when_absent.items():
        if name not in df.columns:
            c[name] = value
    c["title"] = F.coalesce(c["title"], F.lit(""))
    filled_when_empty = {"id": slug(c["title"], "dated", c["start_date"]), "source_id": F.lit(source),
                         "description": F.lit(""), "created_at": F.lit(now), "updated_at": F.lit(now)}
    for name, value in filled_when_empty.items():
        c[name] = F.when(F.coalesce(c[name], F.lit("")) != "", c[name]).otherwise(value)
    return df.select(*[c[f.name].cast(f.dataType).alias(f.name) for f in LISTING_SCHEMA], *keep)


def localized(df: DataFrame, locale: str = "fr", fields: Sequence[str] = LOCALE_FIELDS,
              canonical_locale: str = "fr") -> DataFrame:
    """Fill the language variants of the text fields.

    The canonical language holds the base text; English falls back to the base; the asked locale
    falls back to the canonical language and then to the base.
    """
    out = {}
    for f in [f for f in fields if f in df.columns]:
        text = T.StringType()
        nonempty = lambda c: F.nullif(c, F.lit(""))
        base = F.coalesce(F.col(f), F.lit(""))
        home, en, loc = f"{f}_{canonical_locale}", f"{f}_en", f"{f}_{locale}"
        home_value = base if locale == canonical_locale else F.coalesce(nonempty(_col(df, home, text)), base)
        en_value = F.coalesce(nonempty(_col(df, en, text)), base)
        current = {home: home_value, en: en_value}.get(loc, _col(df, loc, text))
        out |= {f: base, home: home_value, en: en_value,
                loc: F.coalesce(nonempty(current), nonempty(home_value), base)}
    return df.withColumns(out)


def scan(df: DataFrame, source: str | None = None, status: str | None = "published") -> DataFrame:
    """Live catalog rows, optionally of one source and status, by date, title and id.

    The id makes the order total, so rows that share date and title can be split over tasks.
    """
    out = df.where(F.col("absent_since").isNull()) if "absent_since" in df.columns else df
    if source is not None:
        out = out.where(F.col("source_id") == source)
    if status is not None:
        out = out.where(F.col("status") == status)
    return out.orderBy("start_date", "title", "id")


def overlapping(df: DataFrame, as_of: str, start: str | None = None, end: str | None = None,
                category: str | None = None, venue: str | None = None, query: str | None = None) -> DataFrame:
    """Rows whose date range meets [start, end], with optional category, venue and text filters."""
    s = F.substring("start_date", 1, 10)
    e_own = F.substring("end_date", 1, 10)
    e = F.coalesce(e_own, s)
    keep = s.isNotNull() & ~F.coalesce((e_own < as_of) & (s < as_of), F.lit(False))
    if start:
        keep &= e >= start
    if end:
        keep &= s <= end
    if category:
        keep &= F.col("category") == category
    if venue:
        keep &= F.contains(F.lower(F.coalesce("venue_name", F.lit(""))), F.lit(venue.lower()))
    if query:
        q = F.lit(query.lower().strip())
        keep &= (F.contains(F.lower(F.coalesce("title", F.lit(""))), q)
                 | F.contains(F.lower(strip_tags(F.coalesce("description", F.lit("")))), q))
    return df.where(keep).orderBy("start_date", "id")


def unexpired(df: DataFrame, as_of: str, keep_undated: bool = False) -> DataFrame:
    """Drop rows that ended before ``as_of``; rows without any date go too unless asked to stay."""
    nonempty = lambda c: F.nullif(F.col(c), F.lit(""))
    last = F.substring(F.coalesce(nonempty("end_date"), nonempty("start_date"), F.lit("")), 1, 10)
    keep = last >= as_of
    return df.where(keep | (last == "")) if keep_undated else df.where(keep)


def in_horizon(df: DataFrame, as_of: str, back: int = 0, ahead: int = 365,
               years: tuple[int, int] | None = None) -> DataFrame:
    """Rows whose start is a valid date from ``back`` days before to ``ahead`` days after ``as_of``."""
    d = F.try_to_date(F.substring("start_date", 1, 10), "yyyy-MM-dd")
    today = F.lit(as_of).cast("date")
    keep = d.between(F.date_add(today, -back), F.date_add(today, ahead))
    if years:
        keep &= F.year(d).between(*years)
    return df.where(keep)


def demote_undated(df: DataFrame, cap: float = 0.5) -> DataFrame:
    """Rows without a start wait for a date: status pending, confidence capped."""
    missing = filled("start_date").isNull()
    return df.withColumns({
        "status": F.when(missing, "pending").otherwise(F.col("status")),
        "confidence": F.when(missing, F.least("confidence", F.lit(cap))).otherwise(F.col("confidence")),
    })


def url_filter(df: DataFrame, url: str = "url", hosts: Sequence[str] = (), fragments: Sequence[str] = (),
               deny_last: Sequence[str] = ()) -> DataFrame:
    """Keep URLs on allowed hosts whose path holds one of the fragments and whose end is not denied."""
    u = F.col(url)
    host = F.regexp_extract(u, r"^[A-Za-z]+://([^/?#]*)", 1)
    path = F.regexp_extract(u, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    keep = F.lit(True)
    if hosts:
        keep &= host.isin(list(hosts))
    if fragments:
        any_fragment = F.lit(False)
        for f in fragments:
            any_fragment |= F.contains(path, F.lit(f))
        keep &= any_fragment
    if deny_last:
        keep &= ~last_segment(path).isin(list(deny_last))
    return df.where(keep)


def delete_where(df: DataFrame, equal: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """Split off the rows that match every given value: (kept, deleted). Nulls never match."""
    cond = F.lit(True)
    for name, value in equal.items():
        cond &= F.col(name).eqNullSafe(F.lit(value))
    return df.where(~cond), df.where(cond)
