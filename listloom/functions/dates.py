"""Dates, times and schedules read out of text, as column expressions. Never raises on bad input."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from listloom.functions.text import bind

# Month spellings.
MONTHS_FR = {
    "janvier": 1, "février": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6,
    "juillet": 7, "août": 8, "septembre": 9, "octobre": 10, "novembre": 11, "décembre": 12,
}
MONTHS_CARD = {
    "jan": 1, "janv": 1, "janvier": 1, "fev": 2, "fevr": 2, "fevrier": 2, "février": 2,
    "mar": 3, "mars": 3, "avr": 4, "avril": 4, "mai": 5, "juin": 6, "jun": 6,
    "juil": 7, "juillet": 7, "jul": 7, "aout": 8, "août": 8, "ao": 8, "aug": 8,
    "sep": 9, "sept": 9, "septembre": 9, "oct": 10, "octobre": 10, "nov": 11, "novembre": 11,
    "dec": 12, "décembre": 12, "decembre": 12,
}
MONTHS_EN = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6,
    "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
}
MONTHS_SHORT = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8,
    "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
}
MONTHS_FR_LOOSE = {**MONTHS_FR, "fevrier": 2, "aout": 8, "decembre": 12}
W = r"[\p{L}\p{N}_]+"


def month_number(name: Column, months: Mapping[str, int]) -> Column:
    table = F.create_map(*[x for k, v in months.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(table, F.lower(name))


def iso(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM-dd")


def _num(c: Column) -> Column:
    return c.try_cast("int")


def _date(year: Column, month: Column, day: Column) -> Column:
    """A date, or null when the three numbers are not one."""
    def read(p: Column) -> Column:
        ok = p["y"].isNotNull() & p["m"].between(1, 12) & p["d"].between(1, 31)
        return F.try_to_date(F.when(ok, F.format_string("%04d-%02d-%02d", p["y"], p["m"], p["d"])), "yyyy-MM-dd")

    return bind(F.struct(year.alias("y"), month.alias("m"), day.alias("d")), read)


def _pair(start: Column, end: Column) -> Column:
    return F.struct(start.alias("start_date"), end.alias("end_date"))


def french_range(text: Column) -> Column:
    """``Du <day> d au <day> d month yyyy``, the same across months, or ``Le <day> d month yyyy``."""
    t = F.coalesce(text, F.lit(""))
    same = rf"(?i)Du\s+{W}\s+(\d+)\s+au\s+{W}\s+(\d+)\s+({W})\s+(\d{{4}})"
    cross = rf"(?i)Du\s+{W}\s+(\d+)\s+({W})\s+(\d{{4}})\s+au\s+{W}\s+(\d+)\s+({W})\s+(\d{{4}})"
    one = rf"(?i)Le\s+{W}\s+(\d+)\s+({W})\s+(\d{{4}})"
    g = lambda p, i: F.regexp_extract(t, p, i)

    def text_date(y: Column, m: Column, d: Column) -> Column:
        return F.format_string("%s-%02d-%02d", y, month_number(m, MONTHS_FR), _num(d))

    def known(*months: Column) -> Column:
        ok = F.lit(True)
        for m in months:
            ok = ok & month_number(m, MONTHS_FR).isNotNull()
        return ok

    s1, e1 = text_date(g(same, 4), g(same, 3), g(same, 1)), text_date(g(same, 4), g(same, 3), g(same, 2))
    s2, e2 = text_date(g(cross, 3), g(cross, 2), g(cross, 1)), text_date(g(cross, 6), g(cross, 5), g(cross, 4))
    s3 = text_date(g(one, 3), g(one, 2), g(one, 1))
    return (F.when(t.rlike(same) & known(g(same, 3)), _pair(s1, e1))
            .when(t.rlike(cross) & known(g(cross, 2), g(cross, 5)), _pair(s2, e2))
            .when(t.rlike(one) & known(g(one, 2)), _pair(s3, s3))
            .otherwise(_pair(F.lit(""), F.lit(""))))


def card_range(text: Column, as_of: Column) -> Column:
    """Dates without a year: ``Du d mon d mon`` or ``Le d mon``.

    The year is that of ``as_of``, or the next when the date lies more than 90 days back; an end
    before its start moves to the year after the start. Impossible dates give null.
    """
    rng = r"(?i)Du\s+(\d{1,2})\s+(\S+)\s+(\d{1,2})\s+(\S+)"
    one = r"(?i)Le\s+(\d{1,2})\s+(\S+)"
    g = lambda p, i: F.regexp_extract(text, p, i)
    mon = lambda c: month_number(F.regexp_replace(F.trim(c), r"\.+$", ""), MONTHS_CARD)

    def near(day: Column, month: Column) -> Column:
        this = bind(_date(F.year(as_of), month, _num(day)), lambda d: F.when(F.date_diff(as_of, d) <= 90, d))
        return F.coalesce(this, _date(F.year(as_of) + 1, month, _num(day)), _date(F.year(as_of), month, _num(day)))

    none = F.lit(None).cast("string")
    parts = F.struct(mon(g(rng, 2)).alias("m1"), mon(g(rng, 4)).alias("m2"), g(rng, 1).alias("d1"), g(rng, 3).alias("d2"),
                     mon(g(one, 2)).alias("m"), g(one, 1).alias("d"))

    def ranged(p: Column) -> Column:
        both = F.struct(near(p["d1"], p["m1"]).alias("s"), near(p["d2"], p["m2"]).alias("e"))
        return bind(both, lambda x: _pair(iso(x["s"]), iso(
            F.when(x["e"] < x["s"], _date(F.year(x["s"]) + 1, p["m2"], _num(p["d2"]))).otherwise(x["e"]))))

    def read(p: Column) -> Column:
        return (F.when(p["m1"].isNotNull() & p["m2"].isNotNull(), ranged(p))
                .when(p["m"].isNotNull(), bind(iso(near(p["d"], p["m"])), lambda x: _pair(x, x)))
                .otherwise(_pair(F.lit(""), none)))

    return bind(parts, read)


def numeric_range(text: Column, roll_back: bool = False) -> Column:
    """dd/mm/yyyy, dd/mm/yy, dd/mm-dd/mm/yy, dd-dd/mm/yy; any other text passes through as start.

    ``roll_back`` puts the start of a range that would begin after its end into the year before.
    """
    full, short = r"^(\d{2})/(\d{2})/(\d{4})$", r"^(\d{2})/(\d{2})/(\d{2})$"
    months, days = r"^(\d{2})/(\d{2})-(\d{2})/(\d{2})/(\d{2})$", r"^(\d{2})-(\d{2})/(\d{2})/(\d{2})$"
    none = F.lit(None).cast("string")

    def read(t: Column) -> Column:
        g = lambda p, i: _num(F.regexp_extract(t, p, i))
        # two-digit years: 69-99 belong to the last century for single dates, ranges are always 20xx
        yy = g(short, 3)
        s1 = _date(g(full, 3), g(full, 2), g(full, 1))
        s2 = _date(F.when(yy >= 69, yy + 1900).otherwise(yy + 2000), g(short, 2), g(short, 1))
        y3, y4 = g(months, 5) + 2000, g(days, 4) + 2000
        s3, e3 = _date(y3, g(months, 2), g(months, 1)), _date(y3, g(months, 4), g(months, 3))
        s4, e4 = _date(y4, g(days, 3), g(days, 1)), _date(y4, g(days, 3), g(days, 2))
        if roll_back:
            s3 = F.when(s3 > e3, _date(y3 - 1, g(months, 2), g(months, 1))).otherwise(s3)
        return (F.when(t.rlike(full), _pair(iso(s1), none)).when(t.rlike(short), _pair(iso(s2), none))
                .when(t.rlike(months), _pair(iso(s3), iso(e3))).when(t.rlike(days), _pair(iso(s4), iso(e4)))
                .otherwise(_pair(t, none)))

    return bind(F.trim(F.coalesce(text, F.lit(""))), read)


def english_range(text: Column) -> Column:
    """``d-Mon-yyyy`` with an optional ``to d-Mon-yyyy``; empty start when neither is found."""
    d = r"(\d{1,2})-([A-Z][a-z]{2})-(\d{4})"
    both = rf"{d}\s*to\s*{d}"
    none = F.lit(None).cast("string")

    def read(t: Column) -> Column:
        def at(p: str, i: int) -> Column:
            g = lambda k: F.regexp_extract(t, p, k)
            return iso(_date(_num(g(i + 2)), month_number(g(i + 1), MONTHS_SHORT), _num(g(i))))

        return (F.when(t.rlike(both), _pair(at(both, 1), at(both, 4))).when(t.rlike(d), _pair(at(d, 1), none))
                .otherwise(_pair(F.lit(""), none)))

    return bind(F.coalesce(text, F.lit("")), read)


def leading_french_date(text: Column) -> Column:
    """``d month yyyy`` at the start of a text, months without accents."""
    p = rf"^(\d{{1,2}})\s+({W})\s+(\d{{4}})"
    g = lambda i: F.regexp_extract(F.trim(text), p, i)
    months = {k.translate(str.maketrans("éû", "eu")): v for k, v in MONTHS_FR.items()}
    return iso(_date(_num(g(3)), month_number(g(2), months), _num(g(1))))


def dates_in_text(text: Column, as_of: Column | None = None, back: int = 7, ahead: int = 540,
                  years: tuple[int, int] = (2025, 2030)) -> Column:
    """Every valid date in a text as ISO strings, in pattern order, first sight kept.

    With ``as_of`` only dates from ``back`` days before to ``ahead`` days after it remain, and
    only in ``years`` (both ends included).
    """
    t = F.coalesce(text, F.lit(""))
    en, fr, sh = "|".join(MONTHS_EN), "|".join(MONTHS_FR_LOOSE), "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec"
    day_month_year = {
        rf"(?iu)\d{{1,2}}\s+(?:{en})\s+\d{{4}}": MONTHS_EN,
        rf"(?iu)\d{{1,2}}\s+(?:{fr})\s+\d{{4}}": MONTHS_FR_LOOSE,
        rf"(?iu)\d{{1,2}}\s+(?:{sh})[\p{{L}}\p{{N}}_]*\s+\d{{4}}": MONTHS_SHORT,
    }

    def reader(months: Mapping[str, int]):
        name = rf"(?iu)^\d+\s+({'|'.join(sorted(months, key=len, reverse=True))})"
        return lambda m: iso(_date(_num(F.regexp_extract(m, r"(\d{4})$", 1)),
                                   month_number(F.regexp_extract(m, name, 1), months),
                                   _num(F.regexp_extract(m, r"^(\d+)", 1))))

    lists = [F.transform(F.regexp_extract_all(t, F.lit(p), 0), reader(months)) for p, months in day_month_year.items()]
    slash = F.regexp_extract_all(t, F.lit(r"\d{1,2}/\d{1,2}/\d{4}"), 0)
    lists.append(F.transform(slash, lambda m: iso(_date(
        _num(F.substring_index(m, "/", -1)), _num(F.split(m, "/")[1]), _num(F.substring_index(m, "/", 1))))))
    lists.append(F.transform(F.regexp_extract_all(t, F.lit(r"\d{4}-\d{2}-\d{2}"), 0),
                             lambda m: iso(F.try_to_date(m, "yyyy-MM-dd"))))
    found = F.array_distinct(F.array_compact(F.concat(*lists)))
    if as_of is None:
        return found
    lo, hi = iso(F.date_add(as_of, -back)), iso(F.date_add(as_of, ahead))
    return F.filter(found, lambda d: d.between(lo, hi) & F.substring(d, 1, 4).try_cast("int").between(*years))


def start_time(text: Column) -> Column:
    """The first ``HHh[MM]`` or ``HH:MM`` as ``HH:MM``, else empty."""
    p = r"\b(\d{1,2})h(\d{2})?\b|\b(\d{1,2}):(\d{2})\b"
    t = F.coalesce(text, F.lit(""))
    g = lambda i: F.coalesce(F.regexp_extract(t, p, i), F.lit(""))
    hour = F.when(g(1) != "", g(1)).otherwise(g(3))
    minute = F.when(g(1) != "", F.when(g(2) != "", g(2)).otherwise("00")).otherwise(g(4))
    return F.when(t.rlike(p), F.concat(F.lpad(hour, 2, "0"), F.lit(":"), minute)).otherwise("")


def range_label(start: Column, end: Column) -> Column:
    """``Mon dd, yyyy → Mon dd, yyyy``, one date when both are equal or one is missing."""
    fmt = lambda c: F.coalesce(F.date_format(F.try_to_date(c, "yyyy-MM-dd"), "MMM dd, yyyy"), F.lit(""))
    s, e = fmt(F.nullif(F.substring(start, 1, 10), F.lit(""))), fmt(F.nullif(F.substring(end, 1, 10), F.lit("")))
    return F.when((s != "") & (e != "") & (start != end), F.concat_ws(" → ", s, e)).when(s != "", s).otherwise(e)


def schedule_dates(kind: Column, start: Column, end: Column, as_of: Column, horizon: int = 14) -> Column:
    """Concrete dates of a recurring entry from ``as_of`` to ``as_of + horizon`` days.

    annual (or start = end): the start when inside; seasonal: every day of the clamped range;
    daily: every third day up to the twelfth; weekly: today and in a week; weekend: the next two
    Saturdays, never today; monthly: the middle of the horizon; anything else: today.
    """
    last = F.date_add(as_of, horizon)
    none = F.array().cast("array<date>")
    offsets = lambda days: F.filter(F.array(*[F.date_add(as_of, d) for d in days]), lambda d: d <= last)
    saturday = F.next_day(as_of, "Sat")
    weekend = F.filter(F.array(saturday, F.date_add(saturday, 7)), lambda d: d <= last)
    lo, hi = F.greatest(start, as_of), F.least(end, last)
    once = F.when(start.between(as_of, last), F.array(start)).otherwise(none)
    return (F.when((kind == "annual") | F.coalesce(start == end, F.lit(False)), once)
            .when((kind == "seasonal") & start.isNotNull() & end.isNotNull(),
                  F.when(lo <= hi, F.sequence(lo, F.greatest(hi, lo))).otherwise(none))
            .when(kind == "daily", offsets((0, 3, 6, 9, 12)))
            .when(kind == "weekly", offsets((0, 7)))
            .when(kind == "weekend", weekend)
            .when(kind == "monthly", F.array(F.date_add(as_of, horizon // 2)))
            .otherwise(F.array(as_of)))
