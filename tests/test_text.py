import html
import random
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from listloom.functions import classify as C
from listloom.functions import dates as D
from listloom.functions import text as X
from listloom.functions.patterns import least_pattern, trie_regex


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


TITLES = [
    ("Organ d&rsquo;Or", "organ dor"), ("Organ d'Or", "organ dor"), ("Café — Crème", "cafe creme"), ("ﬁne ½ ™ Ⅷ", "fine 12 TM viii"), ("Int.—12 ans Le Film", "le film"),
    ("a&amp;b &#233;t&#xE9; &bogus; &lt;x&gt;", "ab ete bogus x"), ("x\\y/z:w", "xyzw"), ("Ångström ª º ² ①", "angstrom a o 2 1"), ("", ""), ("&copy 2024 &eacute;", "2024 e"),
    ("𝔘nicode 𝟛", "Unicode 3"), ("a-b — c|d", "a-b c|d"), ("&amp;amp;", "amp"), ("ĳ", "ij"), ("Fin&#133;suite", "finsuite"), ("l&#146;ete &#150; fin", "lete fin"),
    ("&#x00000041;&#0000066;", "AB"), ("\U0002f800", "\u4e3d"), ("🄐", "A"), ("&#99999999999; &#xD800; &#0;", ""), ("a&#7;b&#127;", "ab"), ("&#128;5", "5"), ("int 6 ans", "int 6 ans"), ("INT° — 16 ans   X", "x"),
]


def test_normalize_title_table(spark):
    got = values(spark, [(i, t) for i, (t, _) in enumerate(TITLES)], "i int, t string", "i", X.normalize_title(F.col("t")))
    wrong = [(TITLES[i], g) for i, g in got if g != TITLES[i][1]]
    assert not wrong, wrong


def test_entities_equal_the_standard_library(spark):
    codes = [*range(0, 260), 0x1F, 0xFFFE, 0xFFFF, 0x10FFFF, 0x110000, 10**12, 0xD800, 0xDFFF, 0xFDD0, 0x1F600, 0x2F800]
    texts = [f"a&#{c};b&#x{c:X};c&#{c:012d} d" for c in codes] + ["&amp", "&notit;", "&NotEqualTilde;", "&;", "&#;", "&#x;", "&lt;&gt&quot;&apos;"]
    got = values(spark, list(enumerate(texts)), "i int, t string", "i", X.unescape(F.col("t")))
    wrong = [(texts[i], g, html.unescape(texts[i])) for i, g in got if g != html.unescape(texts[i])]
    assert not wrong, wrong[:5]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8", exclude_characters="\0"), max_size=20), min_size=200, max_size=300))
def test_normalize_any_text(spark, titles):
    n = X.normalize_title
    rows = values(spark, list(enumerate(titles)), "i int, t string", "t", n(F.col("t")).alias("a"), n(n(F.col("t"))).alias("again"), n(F.concat(F.lit("  "), "t", F.lit(" \t"))).alias("spaced"))
    for t, a, again, spaced in rows:
        assert spaced == a and a == a.strip() and "  " not in a, t
        # a mark that stood for nothing may leave an age prefix or an entity behind: then only the length may shrink
        assert again == a or len(again) < len(a) or "&" in t, t


def test_case_and_accents_do_not_count(spark):
    plain, dressed = "Fete de l'ete au chateau", "FÊTE de l’Été au Château"
    got = values(spark, [(plain,), (dressed,), (unicodedata.normalize("NFD", dressed),)], "t string", X.normalize_title(F.col("t")))
    assert len(set(got)) == 1


def test_suffix_strip_equals_loop(spark):
    phrases = ["rivertown-le-haut", "rivertown", "le-haut", "les bois", "valmont"]
    words = ["fair", "rivertown", "le-haut", "rivertown-le-haut", "les", "bois", "valmont", "night"]
    rng = random.Random(1)
    lists = [[rng.choice(words) for _ in range(rng.randint(0, 7))] for _ in range(3000)]

    def loop(tokens):
        tokens = list(tokens)
        while True:
            for p in (p.split() for p in phrases):
                if len(tokens) >= len(p) and tokens[-len(p):] == p:
                    del tokens[-len(p):]
                    break
            else:
                return " ".join(tokens)

    got = values(spark, [(i, " ".join(x)) for i, x in enumerate(lists)], "i int, t string", "i", X.strip_suffixes(F.col("t"), phrases))
    assert all(g.strip() == loop(lists[i]) for i, g in got)


def test_alias_titles_share_a_name(spark):
    aliases = {"Grand Trail du Lac GTL": ["GTL Lake-Run", "GTL"]}
    got = values(spark, [("GTL ®",), ("gtl lake-run",), ("Grand Trail du Lac GTL",)], "t string", F.array_join(X.event_name(F.col("t"), (), aliases), " "))
    assert {g[0] for g in got} == {"grand trail du lac gtl"}


def test_similarity(spark):
    rows = [(["a"], ["a", "b"], 0.5), (["a", "b"], ["a", "b", "c", "d"], 1.0), ([], ["a"], 0.0), (["a", "b"], ["b", "a"], 1.0),
            (list("abcdefg"), list("abcdefx"), 6 / 8), (list("nwab"), list("nwcd"), 2 / 6)]
    for a, b, want, got in values(spark, rows, "a array<string>, b array<string>, w double", "a", "b", "w", X.token_similarity(F.col("a"), F.col("b"))):
        assert got == pytest.approx(want), (a, b)


def test_page_text_helpers(spark):
    page = "---\nurl: x\n---\n# The Title \n\nSome   prose here.\nMore\n74001 Rivertown-le-Haut"
    assert one(spark, X.clean_description(F.lit(page))) == "# The Title\n\nSome prose here.\n\nMore"
    assert one(spark, X.first_heading(F.lit(page))) == "The Title"
    assert one(spark, X.strip_front_matter(F.lit("--- x\nno end"))) == "--- x\nno end"
    assert one(spark, X.cut_boilerplate(F.lit("Text. Search Menu"), ["Search", "Menu"])) == "Text."


def test_dates(spark):
    cases = [("Du mercredi 12 au dimanche 16 août 2026.", "2026-08-12", "2026-08-16"),
             ("du lundi 30 novembre 2026 au mardi 1 décembre 2026", "2026-11-30", "2026-12-01"),
             ("Le samedi 5 Juillet 2025", "2025-07-05", "2025-07-05"), ("Du lundi 1 au mardi 2 foo 2025", "", ""), (None, "", "")]
    got = values(spark, cases, "t string, s string, e string", "s", "e", D.french_range(F.col("t")))
    assert all((s, e) == tuple(r) for s, e, r in got), got
    as_of = F.lit("2026-01-10").cast("date")
    card = lambda t: tuple(one(spark, D.card_range(F.lit(t), as_of)))
    assert card("Du 20 déc. 5 janv.") == ("", None)  # accented abbreviation is not in the list
    assert card("Du 20 dec. 5 janv.") == ("2026-12-20", "2027-01-05")
    assert card("Le 30 sept") == ("2026-09-30", "2026-09-30")
    assert card("Le 29 fevrier") == (None, None)
    num = lambda t, **k: tuple(one(spark, D.numeric_range(F.lit(t), **k)))
    assert num("27/05/2026") == ("2026-05-27", None) and num("27/05/26") == ("2026-05-27", None)
    assert num("13/05-24/06/26") == ("2026-05-13", "2026-06-24") and num("01-02/11/26") == ("2026-11-01", "2026-11-02")
    assert num("20/12-05/01/26") == ("2026-12-20", "2026-01-05") and num("20/12-05/01/26", roll_back=True) == ("2025-12-20", "2026-01-05")
    assert num("all summer") == ("all summer", None) and num("31/02/2026") == (None, None)
    assert tuple(one(spark, D.english_range(F.lit("3-Jul-2026 to 9-Aug-2026")))) == ("2026-07-03", "2026-08-09")
    assert one(spark, D.leading_french_date(F.lit("3 aout 2026 et plus"))) == "2026-08-03"
    found = one(spark, D.dates_in_text(F.lit("Gig 12 July 2026, 3 août 2026; 5 Sept 2026, 31/12/2026 2026-07-12 2026-13-01 30 February 2026")))
    assert found == ["2026-07-12", "2026-08-03", "2026-09-05", "2026-12-31"]
    times = values(spark, [("à 20h30",), ("9h",), ("doors 07:15 then 8h",), ("123h45",), ("none",)], "t string", D.start_time(F.col("t")))
    assert [t[0] for t in times] == ["20:30", "09:00", "07:15", "", ""]


def test_schedules_around_a_saturday(spark):
    sat = "2026-08-15"  # a Saturday
    rows = [("annual", "2026-08-20", "2026-08-20"), ("annual", "2027-08-20", None), ("seasonal", "2026-08-10", "2026-08-17"), ("daily", None, None), ("weekly", None, None),
            ("weekend", None, None), ("monthly", None, None), ("odd", None, None), ("seasonal", "2026-09-20", "2026-09-22")]
    c = D.schedule_dates(F.col("k"), F.col("s").cast("date"), F.col("e").cast("date"), F.lit(sat).cast("date"))
    got = [[str(x)[5:] for x in r[0]] for r in values(spark, rows, "k string, s string, e string", c)]
    assert got == [["08-20"], [], ["08-15", "08-16", "08-17"], ["08-15", "08-18", "08-21", "08-24", "08-27"], ["08-15", "08-22"], ["08-22", "08-29"], ["08-22"], ["08-15"], []]


def test_addresses(spark):
    tok, codes = ("Rivertown-le-Haut", "Rivertown", "Les Bois"), {"74001": "Rivertown"}
    com = lambda t: one(spark, C.commune(F.lit(t), tok, codes))
    assert com("1 rue X, 74001 LES BOIS") == "Les Bois" and com("74001 Elsewhere") == "Rivertown" and com("99999 Elsewhere") is None
    assert com("near rivertown square") == "Rivertown" and com(None) is None
    ven = lambda t: one(spark, C.venue_from_address(F.lit(t)))
    assert ven("Grande Salle, 12 allée des Pins, 74001 Rivertown") == "Grande Salle" and ven("") == ""
    assert ven("Centre - 3bis") == "Centre - 3bis" and ven("x" * 80) == "x" * 80


def test_classifier_order_and_word_mode(spark):
    rules = [(["jeu"], "family"), (["bar"], "nightlife")]
    assert one(spark, C.keyword_category(F.lit("Jeudi barre"), rules)) == "family"
    assert one(spark, C.keyword_category(F.lit("Jeudi barre"), rules, whole_words=True)) == "other"
    assert one(spark, C.tiered_category(F.lit("Grande Foire"), F.lit(None).cast("string"))) == "market"
    assert one(spark, C.tiered_category(F.lit("Mystère"), F.lit("une visite\n guidée"))) == "exhibition"


def test_many_patterns_equal_the_chain(spark):
    """Against one test after the other: overlapping and nested patterns, marks with a meaning of their own, whole words."""
    rng = random.Random(4)
    letters = "ab é.*(|^$\\[]-x1"
    word = lambda n: "".join(rng.choice(letters) for _ in range(rng.randint(1, n)))
    for size, whole in ((1, False), (3, True), (40, False), (40, True), (400, False), (400, True)):
        patterns = [word(5) for _ in range(size)] + ["ab", "ab é", "a"]
        texts = [(i, word(12), word(20) if i % 3 else None) for i in range(150)]
        edge = r"(?<![^\W_]){}(?![^\W_])"
        inside = lambda p, t: bool(re.search(edge.format(re.escape(p)), t)) if whole else p in t
        want = {i: next((n for n, p in enumerate(patterns) if any(inside(p, t) for t in (a, b or ""))), None) for i, a, b in texts}
        df = spark.createDataFrame(texts, "i int, a string, b string")
        assert {r[0]: r[1] for r in df.select("i", least_pattern([F.col("a"), F.col("b")], patterns, whole)).collect()} == want, (size, whole)
    df = spark.createDataFrame([("xyz",), ("",), (None,)], "a string")
    assert [r[0] for r in df.select(least_pattern([F.col("a")], ["q", "", "x"])).collect()] == [1, 1, 1]
    assert [r[0] for r in df.select(least_pattern([F.col("a")], ["y", ""])).collect()] == [0, 1, 1]
    assert [r[0] for r in df.select(least_pattern([F.col("a")], [])).collect()] == [None] * 3


def test_trie_grows_with_words_not_alternatives():
    words = [a + b for a in "abcdefghij" for b in "klmnopqrst"]
    assert trie_regex(words).count("|") == 99 and trie_regex(["one", "only", "on"]) == "(?:on(?:e|ly)?)"
    assert re.fullmatch(trie_regex(words + ["a"]), "a") and not re.fullmatch(trie_regex(words), "a")


def test_references_cost_the_same_wherever_they_stand_in_the_tables(spark):
    """4000 titles with references and compatibility forms in one task: a search of whole tables took over 10 ms a title."""
    import time

    dressed = F.concat(F.lit("Int.—12 ans "), F.repeat(F.lit("word "), 20), F.col("id").cast("string"), F.lit(" caf&eacute; l&#146;&#x00000041; &#150;5 ﬁn&#133; ĳ"))
    start = time.time()
    got = spark.range(0, 4000, 1, 1).select("id", X.normalize_title(dressed).alias("n")).collect()
    assert time.time() - start < 30
    assert all(r.n == "word " * 20 + f"{r.id} cafe lA 5 fin ij" for r in got)


def test_pages_are_taken_apart_in_small_parts(monkeypatch):
    """Rows leave a task before many pages are held as elements; a null page and one beyond the limit keep their places."""
    import pandas as pd

    from listloom.sources import html as H

    monkeypatch.setattr(H, "CHUNK_CHARS", 100)
    batch = pd.DataFrame({"i": range(40), "html": ["<p>x</p>" * 5, None, "", "y" * 250] * 10}, index=range(7, 47))
    parts = list(H._in_chunks(iter([batch, batch[:0]]), "html"))
    assert len(parts) >= 15 and max(p["html"].str.len().sum() for p in parts) < 350
    assert pd.concat(parts)["i"].tolist() == list(range(40))
