"""Fields out of raw HTML pages held in a table."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listloom.functions.dates import dates_in_text
from listloom.functions.text import has_value, squeeze, strip, strip_tags, unescape, url_date

#: Characters of markup that are taken apart before their rows leave a Python task, whatever the session's batches hold.
CHUNK_CHARS = 1 << 20
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


# --- flat tags: built-in expressions --------------------------------------------------------------

def inner_html(html: Column, tag: str) -> Column:
    return F.regexp_extract(html, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)


def tag_text(html: Column, tag: str) -> Column:
    """Text of the first such element, tags removed, entities decoded."""
    return squeeze(unescape(strip_tags(inner_html(html, tag))))


def all_texts(html: Column, tag: str) -> Column:
    found = F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), 1)
    return F.transform(found, lambda h: squeeze(unescape(strip_tags(h))))


def attribute_values(html: Column, tag: str, attribute: str) -> Column:
    found = F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\s[^>]*?\b{attribute}=[\"']([^\"']*)[\"']"), 1)
    return F.transform(found, unescape)


def _bounded_batches(pages: DataFrame) -> None:
    """Bound Arrow batches by bytes, not only by rows; the session's own limit stays where one is set."""
    conf, key = pages.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(conf.get(key, str(2**31 - 1)).rstrip("bB") or 0) >= 2**28:
        conf.set(key, str(8 << 20))


def _in_chunks(batches: Iterator[pd.DataFrame], html: str) -> Iterator[pd.DataFrame]:
    """The same rows in parts of about CHUNK_CHARS characters of markup, one page at least."""
    for batch in batches:
        size = batch[html].str.len().fillna(0).astype("int64").cumsum() // CHUNK_CHARS
        for _, part in batch.groupby(size.to_numpy(), sort=False):
            yield part


# --- nested blocks: one pass of the standard parser per page ---------------------------------------

@dataclass(frozen=True)
class Pick:
    """Which element to read: tag, class and attribute must all match when given."""

    tag: str | None = None
    cls: str | None = None
    attr: tuple[str, str] | None = None
    inside: str | None = None      # class or tag an ancestor must have
    take: str = "text"             # "text" or the name of an attribute

    def matches(self, tag: str, attrs: Mapping[str, str | None], ancestors: Sequence[tuple[str, str]]) -> bool:
        if self.tag and tag != self.tag:
            return False
        if self.cls and self.cls not in (attrs.get("class") or "").split():
            return False
        if self.attr and attrs.get(self.attr[0]) != self.attr[1]:
            return False
        return not self.inside or any(t == self.inside or self.inside in c.split() for t, c in ancestors)


@dataclass(frozen=True)
class Field:
    """A value to extract: ordered fallbacks, and the greatest length when the value is capped."""

    picks: tuple[Pick, ...]
    cap: int | None = None
    separator: str = ""


class _Reader(HTMLParser):
    """Collects the first hit of every pick in one pass."""

    def __init__(self, picks: Sequence[Pick]):
        super().__init__(convert_charrefs=True)
        self.picks, self.stack = picks, []
        self.found: dict[Pick, list[str] | str] = {}
        self.open: list[tuple[int, Pick]] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        for p in self.picks:
            if p not in self.found and p.matches(tag, a, self.stack):
                if p.take != "text":
                    if a.get(p.take):
                        self.found[p] = a[p.take]
                else:
                    self.found[p] = []
                    if tag not in VOID:
                        self.open.append((len(self.stack), p))
        if tag not in VOID:
            self.stack.append((tag, a.get("class") or ""))

    def handle_endtag(self, tag):
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth][0] == tag:
                del self.stack[depth:]
                self.open = [(d, p) for d, p in self.open if d < depth]
                return

    def handle_data(self, data):
        text = data.strip()
        if text and not (self.stack and self.stack[-1][0] in ("script", "style")):
            for _, p in self.open:
                self.found[p].append(text)


def extract_fields(pages: DataFrame, fields: Mapping[str, Field], html: str = "html") -> DataFrame:
    """Add one string column per field, read from each page's markup; null when nothing matched.

    Pages stay in their partitions and go through Python in Arrow batches, without a shuffle.
    """
    keep = [c for c in pages.columns if c != html]
    schema = T.StructType([pages.schema[c] for c in keep] + [T.StructField(f, T.StringType()) for f in fields])
    picks = tuple(dict.fromkeys(p for f in fields.values() for p in f.picks))

    def value(found, field: Field) -> str | None:
        for p in field.picks:
            got = found.get(p)
            text = field.separator.join(got) if isinstance(got, list) else got
            if text:
                return text[:field.cap] if field.cap else text
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _in_chunks(batches, html):
            rows = []
            for markup in batch[html]:
                reader = _Reader(picks)
                reader.feed(markup or "")
                rows.append({name: value(reader.found, f) for name, f in fields.items()})
            out = pd.DataFrame(rows, columns=list(fields), index=batch.index)
            yield pd.concat([batch[keep], out], axis=1)

    _bounded_batches(pages)
    return pages.select(*keep, html).mapInPandas(run, schema)


# Texts are whole; a Field's cap shortens one.
DETAIL_FIELDS: dict[str, Field] = {
    "title": Field((Pick("h1"), Pick("h2"))),
    "description": Field((Pick(cls="description"), Pick(cls="field--name-body"), Pick("article")), None, " "),
    "image_url": Field((Pick("meta", attr=("property", "og:image"), take="content"),
                        Pick("meta", attr=("name", "twitter:image"), take="content"),
                        Pick("img", inside="picture", take="src"))),
    "venue_name": Field((Pick(cls="event-venue"), Pick(cls="lieu"), Pick(cls="location"))),
    "address": Field((Pick(cls="event-address"), Pick(cls="adresse"))),
    "price": Field((Pick(cls="tarifs"), Pick(cls="price"))),
    "date_text": Field((Pick(cls="event-datetimes"), Pick(cls="event-dates"),
                        Pick(attr=("itemprop", "startDate"), take="content"))),
    "website": Field((Pick("a", inside="event-website", take="href"),)),
}


# --- nesting intervals: what stands around a date ---------------------------------------------------

# Elements that may be an entry of a programme, and elements that name one.
ENTRY_TAGS = ("h1", "h2", "h3", "h4", "h5", "p", "li", "article", "section")
ENTRY_CLASSES = ("event", "event-item", "calendar-item", "schedule-item")
HEADING_TAGS = ("h1", "h2", "h3", "h4", "h5", "strong")


class _Intervals(HTMLParser):
    """Texts of a page in order, and for every element from which text to which it reaches."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.elements: list[list] = []
        self.stack: list[int] = []

    def handle_starttag(self, tag, attrs):
        if tag not in VOID:
            self.stack.append(len(self.elements))
            self.elements.append([tag, (dict(attrs).get("class") or "").split(), len(self.pieces), None, None])

    def handle_endtag(self, tag):
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.elements[self.stack[depth]][0] == tag:
                self._close(depth)
                return

    def _close(self, depth: int):
        for number in self.stack[depth:]:
            self.elements[number][3:] = len(self.pieces), len(self.elements)
        del self.stack[depth:]

    def handle_data(self, data):
        text = " ".join(data.split())
        if text and not (self.stack and self.elements[self.stack[-1]][0] in ("script", "style")):
            self.pieces.append(text)

    def close(self):
        super().close()
        self._close(0)


_ELEMENTS = "array<struct<number:int,tag:string,classes:array<string>,first:int,past:int,last:int>>"


def element_intervals(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without the markup, with ``pieces`` (texts in order) and ``elements``.

    Elements are numbered as they open; one that holds the texts from ``first`` to before ``past`` holds the
    elements from its own number to before ``last``, so nesting is a test of intervals. A null page has none.
    """
    keep = [c for c in pages.columns if c not in (html, "pieces", "elements")]
    schema = T.StructType([pages.schema[c] for c in keep]).add("pieces", T.ArrayType(T.StringType())).add("elements", T._parse_datatype_string(_ELEMENTS))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _in_chunks(batches, html):
            pieces, elements = [], []
            for markup in batch[html]:
                reader = _Intervals()
                reader.feed(markup or "")
                reader.close()
                pieces.append(reader.pieces)
                elements.append([{"number": n, "tag": t, "classes": c, "first": a, "past": b, "last": z} for n, (t, c, a, b, z) in enumerate(reader.elements)])
            yield pd.concat([batch[keep], pd.DataFrame({"pieces": pieces, "elements": elements}, index=batch.index)], axis=1)

    _bounded_batches(pages)
    return pages.select(*keep, html).mapInPandas(run, schema)


def titled_dates(pages: DataFrame, html: str = "html", as_of: Column | None = None, back: int = 7, ahead: int = 540, years: tuple[int, int] = (2025, 2030),
                 shortest: int = 4) -> DataFrame:
    """(columns of ``pages`` but the markup, element, date, title): every date of a page with what it is the date of.

    A date belongs to the innermost entry element whose text holds it; the title is the first heading inside that
    element, else the element's own text. Titles under ``shortest`` characters are left out, longer ones are whole.
    """
    keep = [c for c in pages.columns if c not in (html, "pieces", "elements")]
    text = lambda e: F.array_join(F.slice("pieces", e["first"] + 1, e["past"] - e["first"]), " ")
    entry = lambda e: e["tag"].isin(*ENTRY_TAGS) | F.arrays_overlap(e["classes"], F.array(*map(F.lit, ENTRY_CLASSES)))
    read = element_intervals(pages, html).withColumn("_entries", F.transform(F.filter("elements", entry), lambda e: F.struct(
        e["number"].alias("number"), e["last"].alias("last"), text(e).alias("text"), dates_in_text(text(e), as_of, back, ahead, years).alias("dates"))))
    read = read.withColumn("_entries", F.filter("_entries", lambda e: F.size(e["dates"]) > 0))
    rows = read.select("*", F.explode("_entries").alias("_e")).select("*", F.explode("_e.dates").alias("date"))
    within = lambda e: (e["number"] > F.col("_e.number")) & (e["number"] < F.col("_e.last"))
    rows = rows.where(~F.exists("_entries", lambda e: within(e) & F.array_contains(e["dates"], F.col("date"))))
    heading = F.get(F.filter("elements", lambda e: within(e) & e["tag"].isin(*HEADING_TAGS)), F.lit(0))
    title = F.coalesce(text(heading), F.col("_e.text"))
    return rows.select(*keep, F.col("_e.number").alias("element"), "date", title.alias("title")).where(F.char_length("title") >= shortest)


# --- structured data ------------------------------------------------------------------------------

# Where an event's fields stand in its object.
EVENT_PATHS = {
    "name": "$.name", "startDate": "$.startDate", "endDate": "$.endDate", "description": "$.description", "image": "$.image", "imageUrl": "$.image.url",
    "venue": "$.location.name", "street": "$.location.address.streetAddress", "city": "$.location.address.addressLocality",
    "price": "$.offers.price", "currency": "$.offers.priceCurrency",
}


def event_record(html: Column) -> Column:
    """The first schema.org event with a name among a page's ld+json blocks, null when there is none.

    Every block is parsed once, to a variant; a block is an object that either is the event or lists it in its
    graph. Graph items and fields are looked at one by one: an item of another type, or a field of an
    event that is no text where text is due, is null by itself and hides nothing beside it.
    """
    scripts = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>\s*(\{.*?)</script>"), 1)

    def items(block: Column) -> Column:
        return F.coalesce(F.try_variant_get(block, '$["@graph"]', "array<variant>"), F.array(block))

    def text(item: Column, path: str) -> Column:
        nested = F.try_variant_get(item, path, "map<string,variant>").isNotNull() | F.try_variant_get(item, path, "array<variant>").isNotNull()
        return F.when(~nested, F.try_variant_get(item, path, "string"))

    def fields(item: Column) -> Column:
        return F.struct(text(item, '$["@type"]').alias("type"), *(text(item, path).alias(name) for name, path in EVENT_PATHS.items()))

    found = F.transform(F.flatten(F.transform(F.transform(scripts, F.try_parse_json), items)), fields)
    return F.get(F.filter(found, lambda e: (e["type"] == "Event") & has_value(e["name"])), F.lit(0))


def structured_events(pages: DataFrame, html: str = "html", url: str = "url", text_cap: int | None = None,
                      skip_venues: Sequence[str] = ()) -> DataFrame:
    """Title, dates, text, place, image and price of each page's event; heading and URL date otherwise."""
    p = pages.withColumn("_e", event_record(F.col(html)))
    j = lambda path: F.nullif(F.col(f"_e.{path}"), F.lit(""))
    street, city = j("street"), F.coalesce(j("city"), F.lit(""))
    address = F.when(street.isNotNull(), F.regexp_replace(F.concat_ws(", ", street, city), "^[, ]+|[, ]+$", ""))
    image = F.when(j("image").startswith("http"), j("image")).otherwise(j("imageUrl"))
    price, venue = j("price"), j("venue")
    has = F.col("_e").isNotNull()
    bare = F.nullif(strip(strip_tags(F.regexp_extract(F.col(html), r"(?s)<h1[^>]*>(.*?)</h1>", 1))), F.lit(""))
    return p.withColumns({
        "structured": has,
        "title": F.when(has, strip(j("name"))).otherwise(bare),
        "start_date": F.when(has, F.substring(j("startDate"), 1, 10))
        .when(bare.isNotNull(), F.coalesce(url_date(F.col(url)), F.lit(""))),
        "end_date": F.substring(j("endDate"), 1, 10),
        "description": squeeze(j("description")) if text_cap is None else F.substring(squeeze(j("description")), 1, text_cap),
        "venue_name": F.when(~F.lower(venue).isin(list(skip_venues)) if skip_venues else F.lit(True), venue),
        "address": address,
        "image_url": image,
        "price": F.when(price != "0.00", F.concat_ws(" ", price, F.coalesce(j("currency"), F.lit("EUR")))),
    }).drop("_e")
