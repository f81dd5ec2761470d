"""Keyword categories, places read from addresses, and derived tags."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from listloom.functions.patterns import least_pattern, value_at
from listloom.functions.text import SPACE, bind, squeeze

Rules = Sequence[tuple[Sequence[str], str]]

# Default keyword rules, first match wins.
LISTING_RULES: Rules = [
    (["concert", "chorale", "choeur", "musique", "orchestre"], "concert"),
    (["theatre", "spectacle", "danse"], "theatre"),
    (["sport", "marathon", "escalade", "ski", "randonnee", "velo", "course", "freeride"], "sport"),
    (["marche", "market"], "market"),
    (["exposition", "photo", "peinture", "musee", "exhibition", "film", "festival"], "exhibition"),
    (["soiree", "bar", "club", "nightlife"], "nightlife"),
    (["enfant", "famille", "jeune public", "jeu", "family"], "family"),
]
# Phrases that are specific enough to be searched in descriptions.
DESCRIPTION_RULES: Rules = [
    (["visite guidée", "visite guidee", "visite commentée", "visite commentee", "exposition",
      "expo temporaire", "musée", "musee", "galerie", "parcours d'art", "parcours d’art"], "exhibition"),
    (["randonnée", "randonnee", "sortie nature", "course à pied", "course a pied", "trail",
      "escalade", "tour de montagne", "trek"], "sport"),
    (["concert de", "live", "scène", "scene", "groupe de musique", "orchestre", "chorale",
      "chœur", "choeur", "concert"], "concert"),
    (["vide-grenier", "vide grenier", "braderie", "foire", "marché aux", "marche aux", "bourse aux"], "market"),
    (["spectacle pour enfants", "atelier enfant", "atelier enfants", "jeu de piste",
      "chasse au trésor", "chasse au tresor", "goûter", "gouter"], "family"),
    (["pièce de théâtre", "piece de theatre", "spectacle de théâtre", "spectacle de theatre",
      "one man show", "danse"], "theatre"),
]
# Fixed value: fairs and markets are recognised before any keyword.
MARKET_FIRST = "march[ée]|foire|brocante|braderie"
# Words that start the street part of an address.
STREET_WORDS = ("allée", "allee", "avenue", "av.", "rue", "route", "rte", "impasse", "chemin", "place",
                "cours", "boulevard", "montée", "montee", "promenade", "quai", "passage", "sentier")
# Fixed value: image names that stand for "no image".
GENERIC_IMAGE = (r"(?i)/(fallback[-_ ]?logo|placeholder|default[-_ ]?image|no[-_ ]?image|not[-_ ]?found|"
                 r"coming[-_ ]?soon|generic|spacer)[^/]*\.(png|jpe?g|webp|gif)\b")


def keyword_category(text: Column, rules: Rules, default: str | None = "other", whole_words: bool = False) -> Column:
    """Category of the first rule with a keyword inside the lower-cased text, found in one pass for any number of rules."""
    pairs = [(word, category) for words, category in rules for word in words]
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(value_at(least_pattern([low], [w for w, _ in pairs], whole_words), [c for _, c in pairs]), F.lit(default))


def tiered_category(title: Column, description: Column, rules: Rules = LISTING_RULES,
                    description_rules: Rules = DESCRIPTION_RULES, market_first: bool = True) -> Column:
    """Title keywords first; the description is read only when the title says nothing."""
    by_title = keyword_category(title, rules, None)
    if market_first:
        by_title = F.when(F.lower(F.coalesce(title, F.lit(""))).rlike(MARKET_FIRST), "market").otherwise(by_title)
    by_text = keyword_category(F.regexp_replace(description, f"[{SPACE}]+", " "), description_rules)
    return F.coalesce(by_title, by_text)


def ordered_pattern(texts: Sequence[Column], patterns: Sequence[tuple[str, str]]) -> Column:
    """Value of the first (pattern, value) whose pattern lies inside any of the texts, else null.

    All patterns are looked for in one pass over each text, whose cost does not grow with their number.
    """
    low = [F.lower(F.coalesce(t, F.lit(""))) for t in texts]
    return value_at(least_pattern(low, [p.lower() for p, _ in patterns]), [v for _, v in patterns])


def resolve_venue(venue: Column, address: Column, title: Column, patterns: Sequence[tuple[str, str]],
                  known: Sequence[str] = (), rules: Sequence[tuple[Column, str]] = (),
                  default: str = "Unknown") -> Column:
    """Known name, else first pattern, else first rule, else the listing's own name, else default."""
    v = F.coalesce(venue, F.lit(""))
    out = F.when(v.isin(list(known)) & (v != ""), v) if known else F.when(F.lit(False), v)
    hit = ordered_pattern([v, address, title], patterns)
    chain = out.when(hit.isNotNull(), hit)
    for condition, name in rules:
        chain = chain.when(F.coalesce(condition, F.lit(False)), name)
    return chain.when((v != "") & ~v.startswith("http"), v).otherwise(default)


def commune(address: Column, tokens: Sequence[str], by_code: Mapping[str, str]) -> Column:
    """Place after the last five-digit code when known, else the code's place; without a code the
    first known place named in the text; null when unsure."""
    a = squeeze(F.coalesce(address, F.lit("")))
    last = r"^.*\b(\d{5})\b(.*)$"
    code = F.regexp_extract(a, last, 1)
    trailing = squeeze(F.regexp_replace(F.regexp_extract(a, last, 2), "^[ ,;-]+|[ ,;-]+$", ""))
    named = F.create_map(*[x for t in tokens for x in (F.lit(t.lower()), F.lit(t))])
    codes = F.create_map(*[x for k, v in by_code.items() for x in (F.lit(k), F.lit(v))])
    loose = None
    for t in tokens:
        hit = a.rlike(rf"(?iu)\b{re.escape(t)}\b")
        loose = F.when(hit, t) if loose is None else loose.when(hit, t)
    exact = F.try_element_at(named, F.lower(trailing))
    return F.when(code == "", loose).otherwise(F.coalesce(exact, F.try_element_at(codes, code)))


def venue_from_address(address: Column, overrides: Mapping[str, str] | None = None, cap: int | None = None) -> Column:
    """Part of an address before its postcode and before "number + street word"."""
    a = squeeze(F.coalesce(address, F.lit("")))
    head = F.trim(F.regexp_replace(a, r"\b\d{5}\b.*$", ""))
    words = "|".join(re.escape(w) for w in STREET_WORDS)
    # the word boundary after the street word is Unicode aware, so "allée" is one word
    street = rf"(?iu)\b\d{{1,4}}\b\s*,?\s*(?:{words})(?![\p{{L}}\p{{N}}_]).*$"
    head = squeeze(F.regexp_replace(head, street, ""))
    head = F.trim(F.regexp_replace(head, r"[\s,;:–—-]+$", ""))
    if cap is not None:
        head = F.when(F.length(head) > cap, F.regexp_replace(F.substring(head, 1, cap), "[ ,-]+$", "")).otherwise(head)
    for part, venue in reversed(list((overrides or {}).items())):
        head = F.when(F.contains(F.lower(F.coalesce(address, F.lit(""))), F.lit(part)), venue).otherwise(head)
    return head


def postal_line(text: Column, default: str = "") -> Column:
    """A five-digit code with the place that follows it."""
    p = r"\b\d{5}\s+[A-Za-zÀ-ÿ\-'\s]+"
    found = F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), p, 0))
    return F.when(found == "", default).otherwise(found)


def before_postcode(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    p = r"(?s)^(.*?)\b\d{5}\b"
    return F.when(t.rlike(p), F.regexp_replace(F.regexp_extract(t, p, 1), "^[ -]+|[ -]+$", "")).otherwise("")


def event_image(image: Column, category: Column, placeholders: Mapping[str, str]) -> Column:
    """The image, or the category's placeholder when it is missing, inline data or a stock name."""
    table = F.create_map(*[x for k, v in placeholders.items() for x in (F.lit(k), F.lit(v))])
    usable = (F.coalesce(image, F.lit("")) != "") & ~image.startswith("data:") & ~image.rlike(GENERIC_IMAGE)
    return F.when(usable, image).otherwise(F.try_element_at(table, category))


def title_year(title: Column) -> Column:
    """A year of the 20th or 21st century named in a title."""
    return F.regexp_extract(F.coalesce(title, F.lit("")), r"\b(?:19|20)\d{2}\b", 0).try_cast("int")


def phone_in_text(text: Column) -> Column:
    found = F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), r"\+[\d\s-]{7,20}", 0))
    return F.nullif(found, F.lit(""))


def original_version(language: Column) -> Column:
    return F.contains(F.lower(F.coalesce(language, F.lit(""))), F.lit("vo"))


def showing_state(day: Column, time: Column, now: Column, near_minutes: int = 60) -> Column:
    """past, now (within the hour) or later, for a showing seen at ``now``."""
    minutes = F.split(time, ":")[0].try_cast("int") * 60 + F.substring(F.split(time, ":")[1], 1, 2).try_cast("int")
    current = F.hour(now) * 60 + F.minute(now)
    today = day == F.date_format(now, "yyyy-MM-dd")
    return (F.when(today & (minutes < current), "past")
            .when(today & (F.abs(minutes - current) <= near_minutes), "now").otherwise("later"))


def venue_tags(name: Column, has_live_music: Column, has_event_page: Column,
               name_tags: Sequence[tuple[Sequence[str], str]] = (
                   (("bar ", "pub", "brew", "club", "garage"), "bar"),
                   (("restaurant", "cafe", "maison"), "restaurant"))) -> Column:
    """Sorted tags of a venue from its flags and its name."""
    n = F.lower(F.coalesce(name, F.lit("")))
    tags = [F.lit("venue"), F.when(F.coalesce(has_live_music, F.lit(False)), "live_music"),
            F.when(F.coalesce(has_event_page, F.lit(False)), "events")]
    for words, tag in name_tags:
        tags.append(F.when(n.rlike("|".join(re.escape(w) for w in words)), tag))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*tags))))
