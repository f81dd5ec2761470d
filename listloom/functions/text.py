"""Text normalisation, slugs, keys and similarity as column expressions."""

from __future__ import annotations

import html.entities
import json
import re
import unicodedata
import zlib
from collections.abc import Callable, Mapping, Sequence
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode spelling of the word and space classes, independent of engine flags.
WORD = r"\p{L}\p{N}_"
SPACE = r"\s\p{Z}\x1c-\x1f\x85"
BLANKS = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def bind(c: Column, use) -> Column:
    """``use(c)`` with ``c`` evaluated once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


# --- presence -----------------------------------------------------------------------------------

def has_value(c: Column | str, kind: str = "string") -> Column:
    """False for null, for blank text and for an empty array or map."""
    c = F.col(c) if isinstance(c, str) else c
    if kind == "string":
        # finds one visible character instead of trimming the whole text
        return F.coalesce(c.rlike(f"[^{SPACE}]"), F.lit(False))
    if kind in ("array", "map"):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    return c.isNotNull()


def kind_of(df, name: str) -> str:
    """The presence rule that fits a column's type."""
    simple = df.schema[name].dataType.typeName()
    return simple if simple in ("string", "array", "map") else "scalar"


def filled(c: Column | str) -> Column:
    """The text itself when it has a value, else null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(has_value(c), c)


def strip(c: Column) -> Column:
    """Trim every kind of Unicode white space; a trim only looks at the two ends of a text."""
    return F.btrim(c, F.lit(BLANKS))


def squeeze(c: Column) -> Column:
    """Every run of white space becomes one blank; ends trimmed."""
    return F.trim(F.regexp_replace(c, f"[{SPACE}]+", " "))


# --- Unicode folding and entities ---------------------------------------------------------------

@lru_cache(maxsize=2)
def _fold_tables(compat: bool) -> tuple[str, str, dict[str, str]]:
    """From the Unicode data: one-to-one replacements, then those that give several characters."""
    form = "NFKD" if compat else "NFD"
    single_from, single_to, gone, several = [], [], [], {}
    for code in range(0x80, 0x110000):
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF:
            continue  # Hangul syllables decompose reversibly, so equality is unchanged
        ch = chr(code)
        out = "".join(x for x in unicodedata.normalize(form, ch) if not "\u0300" <= x <= "\u036f")
        if out == ch:
            continue
        if not out:
            gone.append(ch)
        elif len(out) == 1:
            single_from.append(ch)
            single_to.append(out)
        else:
            several[ch] = out
    return "".join(single_from + gone), "".join(single_to), several


# What HTML takes numeric references to C1 controls for, the characters of Windows-1252.
CONTROL_REFERENCES = {str(b): bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def _lookup(d: Mapping[str, str], shelves: int = 1024) -> Callable[[Column], Column]:
    """``key -> value or null`` over a fixed table; a map is searched from end to end, so keys are dealt to many small ones."""
    dealt: list[dict[str, str]] = [{} for _ in range(shelves)]
    for key, value in d.items():
        dealt[zlib.crc32(key.encode()) % shelves][key] = value
    table = F.from_json(F.lit(json.dumps(dealt)), "array<map<string,string>>")
    return lambda key: F.try_element_at(F.get(table, (F.crc32(key) % shelves).cast("int")), key)


def fold(c: Column, compat: bool = True) -> Column:
    """Decompose and drop the marks U+0300-U+036F (NFKD, or NFD when ``compat`` is off)."""
    src, dst, several = _fold_tables(compat)
    table, marked = _lookup(several), "".join(several)

    def spread(one: Column) -> Column:
        chars = F.transform(F.split(one, ""), lambda ch: F.when(ch > "\x7f", F.coalesce(table(ch), ch)).otherwise(ch))
        # a character class over this many ranges is slow to match; deleting them is a table lookup
        holds = F.length(F.translate(one, marked, "")) < F.length(one)
        return F.when(holds, F.array_join(chars, "")).otherwise(one)

    return bind(c, lambda v: F.when(v.rlike(r"[^\x00-\x7F]"), bind(F.translate(v, src, dst), spread)).otherwise(v))


@lru_cache(maxsize=1)
def _entities() -> tuple[dict[str, str], str]:
    """The standard entity names; those allowed without a semicolon, longest first."""
    names = {k.rstrip(";"): v for k, v in html.entities.html5.items()}
    bare = sorted((k for k in html.entities.html5 if not k.endswith(";")), key=lambda k: (-len(k), k))
    return names, "|".join(bare)


def unescape(c: Column) -> Column:
    """Decode named and numeric HTML entities with built-in expressions."""
    names, bare = _entities()
    # the text in pieces, one after the other: references, what holds no ampersand, ampersands that start none
    pattern = rf"&#[xX][0-9a-fA-F]+;?|&#[0-9]+;?|&[A-Za-z][A-Za-z0-9]{{1,31}};|&(?:{bare})|[^&]+|&"
    table, controls = _lookup(names), _lookup(CONTROL_REFERENCES, 32)
    body = lambda e: F.regexp_replace(e, "^&|;$", "")

    def character(code: Column) -> Column:
        shown = F.decode(F.unhex(F.lpad(F.hex(F.when(code < 0x110000, code)), 8, "0")), "UTF-32")
        unseen = code.between(1, 8) | code.between(14, 31) | (code == 11) | (code == 127) | code.between(0xFDD0, 0xFDEF) | (F.pmod(code, F.lit(65536)) >= 65534)
        return (F.when((code == 0) | (code >= 0x110000) | code.between(0xD800, 0xDFFF), F.lit("\ufffd"))
                .when(code.between(0x80, 0x9F), F.coalesce(controls(code.cast("string")), shown))
                .when(unseen, F.lit("")).when(code.isNotNull(), shown))

    def numbered(e: Column) -> Column:
        # leading zeros say nothing; more digits than any code point has are out of range
        hexed, plain = F.regexp_extract(e, "^&#[xX]0*([0-9a-fA-F]*)", 1), F.regexp_extract(e, "^&#0*([0-9]*)", 1)
        digits = F.when(e.rlike("^&#[xX]"), bind(hexed, lambda h: F.when(F.length(h) > 6, F.lit(str(0x110000))).otherwise(F.conv(F.concat(F.lit("0"), h), 16, 10)))) \
            .otherwise(bind(plain, lambda p: F.when(F.length(p) > 7, F.lit(str(0x110000))).otherwise(F.concat(F.lit("0"), p))))
        return bind(digits.try_cast("bigint"), character)

    def named(e: Column) -> Column:
        # an unknown name may start with one that needs no semicolon; the rest of it stays text
        start = table(F.regexp_extract(e, f"^&({bare})", 1))
        return F.coalesce(table(body(e)), F.concat(start, F.regexp_replace(e, f"^&(?:{bare})", "")), e)

    def decode(e: Column) -> Column:
        return F.when(e.rlike("^&#[0-9xX]"), F.coalesce(numbered(e), e)).when(e.rlike("^&[A-Za-z]"), named(e)).otherwise(e)

    def joined(v: Column) -> Column:
        return F.array_join(F.transform(F.regexp_extract_all(v, F.lit(pattern), 0), decode), "")

    return bind(c, lambda v: F.when(F.contains(v, F.lit("&")), joined(v)).otherwise(v))


def only_closed_references(c: Column) -> Column:
    """Markup whose ``&`` without a semicolon after the name stay as they are when it is decoded.

    HTML also takes some names for references where the semicolon is missing, as in a text cut short; XML does not.
    """
    return F.regexp_replace(c, "&(?!(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);)", "&amp;")


# --- titles -------------------------------------------------------------------------------------

# The age-rating prefix and the punctuation that never separates two titles.
AGE_PREFIX = rf"(?i)^int[.°]?[{SPACE}]*—[{SPACE}]*\d+[{SPACE}]+ans[{SPACE}]+"
TITLE_PUNCT = "[—–’‘\"':\\\\/]+"


def normalize_title(c: Column) -> Column:
    """Case-, accent- and punctuation-free form of a title; missing gives the empty string."""
    t = fold(unescape(F.lower(strip(F.coalesce(c, F.lit(""))))))
    t = F.regexp_replace(t, AGE_PREFIX, "")
    t = F.regexp_replace(t, TITLE_PUNCT, "")
    t = F.regexp_replace(t, f"[^{WORD}{SPACE}|-]", "")
    return squeeze(t)


def ascii_title(c: Column) -> Column:
    """ASCII letters, digits and blanks only, lower case: the key of detail pages."""
    t = fold(F.coalesce(c, F.lit("")))
    return F.lower(F.trim(F.regexp_replace(t, r"[^a-zA-Z0-9\s]", "")))


def date10(c: Column) -> Column:
    return F.substring(F.coalesce(c, F.lit("")), 1, 10)


def slug(c: Column, variant: str = "plain", date: Column | None = None, lengths: Sequence[int] = ()) -> Column:
    """URL-safe name of a text, whole unless ``lengths`` cut it.

    plain: words joined by hyphens; dated: the same, ``unnamed`` when empty, date appended;
    page: ASCII, plus year-month (``lengths``: of the text, and of the whole); apostrophe: apostrophes
    become hyphens; date_first: date, then ASCII (``lengths``: of the text).
    """
    raw = F.coalesce(c, F.lit(""))
    low = strip(F.lower(raw))
    d = date10(date) if date is not None else F.lit("")
    if variant in ("plain", "dated"):
        s = F.regexp_replace(low, f"[^{WORD}{SPACE}-]", "")
        s = F.regexp_replace(F.regexp_replace(s, f"[-{SPACE}]+", "-"), "^-+|-+$", "")
        if variant == "plain":
            return s
        s = F.when(s == "", "unnamed").otherwise(s)
        return F.when(d == "", s).otherwise(F.concat_ws("-", s, d))
    if variant == "page":
        s = F.regexp_replace(fold(low, compat=False), "[^a-z0-9]+", "-")
        s = F.regexp_replace(F.regexp_replace(s, "^-+|-+$", ""), r"-\d{4}-\d{2}-\d{2}$", "")
        month = F.regexp_replace(F.substring(d, 1, 7), "-", "")
        s = F.when(F.length(d) >= 7, F.concat_ws("-", F.substring(s, 1, lengths[0]) if lengths else s, month)).otherwise(s)
        s = F.substring(s, 1, lengths[1]) if len(lengths) > 1 else s
        return F.when(s == "", "event").otherwise(s)
    if variant == "apostrophe":
        s = F.regexp_replace(F.lower(raw), "['’]", "-")
        return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "[^a-z0-9-]+", "-"), "^-+|-+$", ""), "-+", "-")
    if variant == "date_first":
        s = F.regexp_replace(F.regexp_replace(F.lower(raw), "[^a-z0-9]+", "-"), "^-+|-+$", "")
        return F.concat_ws("-", F.when(d == "", "nodate").otherwise(d), F.substring(s, 1, lengths[0]) if lengths else s)
    raise ValueError(f"unknown slug variant {variant!r}")


def short_key(title: Column, date: Column, length: int | None = None) -> Column:
    """ASCII letters and digits of a title, and the date; the whole title unless ``length`` cuts it."""
    t = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]", "")
    return F.concat(t if length is None else F.substring(t, 1, length), F.lit("|"), date10(date))


def row_key(source: Column, title: Column, date: Column, venue: Column) -> Column:
    """Stable identity of a stored row; nulls count as empty so no field shifts."""
    none = F.lit("")
    return F.concat_ws("|", F.coalesce(source, none), normalize_title(title), F.coalesce(date, none),
                       normalize_title(venue))


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda t: t != "")


def strip_suffixes(norm: Column, phrases: Sequence[str]) -> Column:
    """Drop trailing locality phrases again and again; earlier phrases are tried first."""
    if not phrases:
        return norm
    alts = "|".join(re.escape(p) for p in phrases)
    return F.regexp_replace(norm, rf"(?:(?:^| )(?:{alts}))+$", "")


def event_name(title: Column, phrases: Sequence[str] = (),
               aliases: Mapping[str, Sequence[str]] | None = None) -> Column:
    """Token list used for fuzzy matching: suffixes stripped, alias titles made canonical."""
    return name_tokens(normalize_title(title), phrases, aliases)


def name_tokens(norm: Column, phrases: Sequence[str] = (), aliases: Mapping[str, Sequence[str]] | None = None) -> Column:
    """``event_name`` of a title that is normalised already."""
    out = strip_suffixes(norm, phrases)
    for canonical, others in (aliases or {}).items():
        spellings = [normalize_title(F.lit(x)) for x in (canonical, *others)]
        same = F.array_contains(F.array(*spellings), norm)
        out = F.when(same, normalize_title(F.lit(canonical))).otherwise(out)
    return tokens(out)


def token_similarity(a: Column, b: Column) -> Column:
    """1 for a strict prefix of two tokens or more, else the Jaccard share of the token sets."""
    na, nb = F.size(a), F.size(b)
    longer_b = (na >= 2) & (nb > na) & (F.slice(b, 1, na) == a)
    longer_a = (nb >= 2) & (na > nb) & (F.slice(a, 1, nb) == b)
    union = F.size(F.array_union(a, b))
    jac = F.size(F.array_intersect(a, b)) / F.when(union > 0, union)
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).when(longer_a | longer_b, F.lit(1.0)).otherwise(jac)


# --- URLs ---------------------------------------------------------------------------------------

def norm_url(c: Column) -> Column:
    u = F.replace(F.trim(F.coalesce(c, F.lit(""))), F.lit("http://"), F.lit("https://"))
    u = F.regexp_replace(F.lower(u), "/+$", "")
    return F.regexp_replace(u, "[?#].*$", "")


def url_date(c: Column) -> Column:
    """ISO date at the end of a URL, null when absent or not a calendar date."""
    found = F.regexp_extract(F.regexp_replace(c, "/+$", ""), r"-(\d{4}-\d{2}-\d{2})$", 1)
    return F.date_format(F.try_to_date(F.nullif(found, F.lit("")), "yyyy-MM-dd"), "yyyy-MM-dd")


def slug_title(c: Column, marker: str = "/event/") -> Column:
    """Readable title from a URL: the segment after the last marker, date and hyphens removed."""
    s = F.substring_index(F.regexp_replace(c, "/+$", ""), marker, -1)
    s = F.regexp_replace(F.substring_index(s, "/", 1), r"-\d{4}-\d{2}-\d{2}$", "")
    return F.trim(F.replace(s, F.lit("-"), F.lit(" ")))


def last_segment(c: Column) -> Column:
    return F.substring_index(F.regexp_replace(c, "/+$", ""), "/", -1)


def absolute_url(base: Column, href: Column) -> Column:
    """Resolve a link against its page."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)//", 1)
    host = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    page = F.regexp_replace(base, "[?#].*$", "")
    folder = F.when(page == host, F.concat(host, F.lit("/"))).otherwise(F.regexp_replace(page, "[^/]*$", ""))
    return (F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
            .when(href.startswith("//"), F.concat(scheme, href))
            .when(href.startswith("/"), F.concat(host, href))
            .when(href.startswith("#") | href.startswith("?"), F.concat(page, href))
            .otherwise(F.concat(folder, href)))


# --- prose --------------------------------------------------------------------------------------

def escape_html(c: Column) -> Column:
    out = c
    # Fixed values, ampersand first: the five characters that markup needs escaped.
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def cut_at_word(c: Column, n: int) -> Column:
    head = F.substring(c, 1, n)
    return F.when(F.instr(head, " ") > 0, F.regexp_replace(head, r"(?s) [^ ]*$", "")).otherwise(head)


def summary(c: Column, maxlen: int = 200, default: str = "Event") -> Column:
    """First sentence of more than 20 characters, cut at a word, escaped for markup."""
    text = strip(F.coalesce(c, F.lit("")))
    pieces = F.transform(F.split(text, r"[.!?\n]+"), strip)
    first = F.get(F.filter(pieces, lambda s: F.length(s) > 20), F.lit(0))
    long = F.concat(cut_at_word(first, maxlen), F.lit("…"))
    return (F.when(text == "", F.lit(default))
            .when(first.isNull(), escape_html(F.substring(text, 1, maxlen)))
            .when(F.length(first) <= maxlen, escape_html(first))
            .otherwise(escape_html(long)))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]*>", "")


def strip_front_matter(c: Column) -> Column:
    """Drop a leading block between two lines of three hyphens."""
    return F.regexp_replace(c, r"(?s)^---[^\n]*\n(?:.*?\n)??[ \t]*---[ \t]*(?:\n|$)", "")


def first_heading(c: Column) -> Column:
    """Text of the first line that starts with a hash sign."""
    return strip(F.regexp_extract(c, r"(?m)^[^\S\n]*#+([^\n]*)", 1))


def clean_description(c: Column) -> Column:
    """Front matter off, blanks collapsed per line, lines parted by one empty line,
    a closing postal line dropped."""
    body = strip_front_matter(F.coalesce(c, F.lit("")))
    lines = F.transform(F.split(body, "\n"), lambda s: strip(F.regexp_replace(s, "[ \t]+", " ")))
    lines = F.filter(lines, lambda s: s != "")
    postal = r"^\d{5}\s+[A-Za-zÀ-ÿ\-'\s]+$"
    n = F.size(lines)
    last_is_postal = F.coalesce(F.get(lines, n - 1).rlike(postal), F.lit(False))
    kept = F.when(last_is_postal, F.slice(lines, 1, F.greatest(n - 1, F.lit(0)))).otherwise(lines)
    return strip(F.array_join(kept, "\n\n"))


def cut_boilerplate(c: Column, phrases: Sequence[str]) -> Column:
    out = c
    for p in phrases:
        out = F.substring_index(out, p, 1)
    return F.trim(out)


def cap_at_sentence(c: Column, n: int) -> Column:
    """At most ``n`` characters, ending at the last full stop inside when there is one."""
    head = F.substring(c, 1, n)
    cut = F.when(F.instr(head, ".") > 0, F.regexp_replace(head, r"(?s)\.[^.]*$", ".")).otherwise(head)
    return F.when(F.length(c) <= n, c).otherwise(cut)


def json_map(c: Column, schema: str = "map<string,array<string>>") -> Column:
    """Stored JSON as a typed value; bad or missing text gives an empty map or array."""
    empty = F.create_map().cast(schema) if schema.startswith("map") else F.array().cast(schema)
    return F.coalesce(F.from_json(c, schema, {"mode": "PERMISSIVE"}), empty)
