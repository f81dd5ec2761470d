import json
import random

from pyspark.sql import functions as F

from listloom.functions import text as X
from listloom.operators import coverage as V
from listloom.operators import joins as J
from listloom.operators import project as P
from listloom.operators import review as R
from listloom.operators import rollup as A
from listloom.operators import store
from listloom.operators import upsert as U
from listloom.session import fresh_path
from listloom.sources import files, html, posts
from listloom.streaming import intake

STORED = "id string, source_id string, title string, start_date string, venue_name string, description string, title_en string, status string, created_at string, updated_at string, row_key string, absent_since string"
BATCH = "position long, id string, source_id string, title string, start_date string, venue_name string, description string, title_en string"


def empty(spark):
    return spark.createDataFrame([], STORED)


def batch(spark, *titles, source="s", venue="Hall", tr=None):
    return spark.createDataFrame([(i, f"{t}-{i}", source, t, "2026-07-01", venue, f"text {t}", tr) for i, t in enumerate(titles)], BATCH)


def rows(df):
    return {r["title"]: r for r in df.collect()}


def test_upsert_twice_is_stable(spark):
    one = U.durable_upsert(empty(spark), batch(spark, "a", "b"), ["s"], "t1")
    two = U.durable_upsert(one, batch(spark, "a", "b"), ["s"], "t1")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    assert all(r["absent_since"] is None for r in two.collect()) and two.count() == 2


def test_tombstone_keeps_first_time_and_clears(spark):
    s = U.durable_upsert(empty(spark), batch(spark, "a", "b"), ["s"], "t1")
    s = U.durable_upsert(s, batch(spark, "a"), ["s"], "t2")
    s = U.durable_upsert(s, batch(spark, "a"), ["s"], "t3")
    assert rows(s)["b"]["absent_since"] == "t2"
    s = U.durable_upsert(s, batch(spark, "a", "b"), ["s"], "t4")
    assert rows(s)["b"]["absent_since"] is None and rows(s)["b"]["created_at"] == "t1"


def test_protected_and_other_sources_stay(spark):
    s = U.durable_upsert(empty(spark), batch(spark, "a"), ["s"], "t1").withColumn("source_id", F.lit("curated")).withColumn("row_key", F.lit("k"))
    for src in ("other", "curated"):
        t = U.durable_upsert(s, batch(spark, "zzz", source=src), [src], "t2")
        assert rows(t)["a"]["absent_since"] is None and rows(t)["a"]["updated_at"] == "t1"
        assert ("zzz" in rows(t)) == (src == "other")


def test_empty_batch_guard(spark):
    s = U.durable_upsert(empty(spark), batch(spark, "a"), ["s"], "t1")
    none = batch(spark, "a").limit(0)
    assert rows(U.durable_upsert(s, none, ["s"], "t2"))["a"]["absent_since"] is None
    assert rows(U.durable_upsert(s, none, ["s"], "t2", guard_empty=False))["a"]["absent_since"] == "t2"


def test_accented_venue_is_the_same_row_and_translations_stay(spark):
    s = spark.createDataFrame([("old", "s", "Été", "2026-07-01", "Café", "d", "Summer", "published", "t0", "t0", None, None)], STORED)
    t = U.durable_upsert(s, batch(spark, "ete", venue="cafe", tr=""), ["s"], "t1")
    r = t.collect()
    assert len(r) == 1 and r[0]["id"] == "old" and r[0]["title_en"] == "Summer" and r[0]["row_key"]
    again = U.durable_upsert(t, batch(spark, "ete", venue="cafe", tr=""), ["s"], "t1").collect()
    assert [tuple(x) for x in r] == [tuple(x) for x in again]


def test_purge(spark):
    df = spark.createDataFrame([("a", "2026-06-01"), ("b", "2026-07-06"), ("c", None)], "id string, absent_since string")
    assert {r["id"] for r in U.purge_tombstones(df, "2026-07-11").collect()} == {"b", "c"}


def test_priority_merge_equals_sequential_walk(spark):
    rng = random.Random(11)
    pri = {"official": 10, "event": 30}
    prio = lambda s: next((v for k, v in pri.items() if s.startswith(k)), 50)
    src = ["official", "event_x", "odd", "none"]
    base = [(i, f"b{i}", rng.choice(src), f"T{i}", "2026-07-01", rng.choice([0.2, 0.5]), f"cb{i}") for i in range(30)]
    new = [(i, f"n{i}", rng.choice(src), f"t {rng.randrange(45)}", "2026-07-01T9", rng.choice([0.1, 0.2, 0.5, 0.7, 0.9]), f"cn{i}") for i in range(400)]
    held = {f"t{b[0]}": list(b) for b in base}
    fresh, upd, dup = [], 0, 0
    for n in new:
        k = n[3].replace(" ", "")
        if k not in held:
            fresh.append(n)
            continue
        h = held[k]
        if prio(n[2]) < prio(h[2]):
            held[k], upd = [*n[:6], h[6]], upd + 1
        elif prio(n[2]) == prio(h[2]) and n[5] > h[5]:
            held[k], upd = list(n), upd + 1
        else:
            dup += 1
    want = sorted([(h[1], h[6]) for h in held.values()] + [(n[1], n[6]) for n in fresh])
    schema = "position long, id string, source_id string, title string, start_date string, confidence double, created_at string"
    merged, counts = U.priority_merge(spark.createDataFrame(base, schema), spark.createDataFrame(new, schema), pri)
    assert sorted((r["id"], r["created_at"]) for r in merged.collect()) == want
    assert tuple(counts.first()) == (len(fresh), upd, dup)


def test_film_enrichment_fills_only_the_first_empty(spark):
    s = spark.createDataFrame([(1, "Été", None, "has"), (2, "Ete!", None, None), (3, "Full", "img", "text"), (4, "Plain", "", "")],
                              "id long, title string, image_url string, description string")
    inc = spark.createDataFrame([(1, "ETE", "i1", "d1"), (2, "full", "x", "x"), (3, "PLAIN", None, "d3"), (4, "Unknown", "z", "z"), (5, "plain", "i5", "d5")],
                                "ip long, title string, image_url string, description string")
    got = {r["id"]: (r["image_url"], r["description"], r["changed"]) for r in J.enrich_two_tier(s, inc, ["image_url", "description"], "id", "ip").collect()}
    assert got == {1: ("i1", "has", True), 2: (None, None, False), 3: ("img", "text", False), 4: ("i5", "d3", True)}


def test_predicate_delete_only_exact_pair(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("a", None)], "source_id string, category string")
    kept, gone = P.delete_where(df, {"source_id": "a", "category": "x"})
    assert gone.count() == 1 and kept.count() == 3
    assert P.delete_where(kept, {"source_id": "a", "category": "x"})[1].count() == 0


def test_histogram_and_empty_gates(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.19, 0.2, 0.4, 0.6, 0.8, 1.0, None)], "confidence double")
    assert tuple(A.score_histogram(df).first())[:6] == (3, 1, 1, 1, 2, 8)
    assert tuple(A.score_histogram(df.limit(0)).first()) == (0, 0, 0, 0, 0, 0, 0.0, 0.0, 0.0)
    ev = spark.createDataFrame([], "source_id string, title string, start_date string, source_url string, venue_name string, description string, image_url string, status string")
    r = V.content_coverage(ev).collect()
    assert len(r) == 1 and r[0]["n"] == 0 and r[0]["image_pct"] == 100.0 and r[0]["passed"]
    f = V.film_completeness(spark.createDataFrame([], "image_url string, description string, end_date string"), "2026-01-01").first()
    assert f["empty"] and f["image_pct"] == 100.0


def test_triage_and_ageing(spark):
    q = spark.createDataFrame([(i, None, None, None, snap, c, "open", None, None, None, at) for i, c, at, snap in [
        ("hi", 0.7, "2026-03-01 00:00:00", None), ("mid", 0.69, "2025-01-01 00:00:00", None), ("old", 0.39, "2026-01-10 00:00:00", json.dumps({"start_date": "2026-01-01"})),
        ("new", 0.39, "2026-01-12 00:00:00", json.dumps({"start_date": "2026-09-01"}))]],
        "id string, event_id string, source_id string, reason string, event_snapshot string, confidence double, status string, notes string, reviewed_by string, reviewed_at string, created_at string")
    got = {r["id"]: r["status"] for r in R.triage(q, "2026-03-12").collect()}
    assert got == {"hi": "approved", "mid": "open", "old": "rejected", "new": "open"}
    assert {r["id"] for r in R.age_out(q, "2026-03-12", "2026-03-12").collect()} == {"hi", "mid", "new"}


def test_section_text(spark):
    text = "noise\nUpcoming\nFri, 3 Jul at 20:00 UTC+2\nab\nBig Night\nEvent by Us\nSat, 4 Jul at 09:30 UTC\nSmall Day\nPast\nSun, 5 Jul at 10:00 UTC\nGone\n"
    got = posts.section_records(spark.createDataFrame([(1, text), (2, "no markers")], "id int, t string"), "t", 2026).drop("t").collect()
    assert [tuple(r) for r in got] == [(1, 0, "Big Night", "Event by Us", "2026-07-03", "20:00"), (1, 1, "Small Day", "", "2026-07-04", "09:30")]


def test_timetable_page(spark):
    cells = [(1, 10, "99H99 before"), (2, 10, "FILMS"), (3, 260, "Jeu"), (4, 10, "The Long"), (5, 10, "Road 1H50 18H00 VO"), (5, 250, "20H30"), (6, 10, "Summer film festival"),
             (7, 10, "Quiet Film"), (7, 340, "11h00 - 14h15"), (8, 10, "little film festival"), (9, 10, "int.—12 ans"), (10, 10, "Next One 2h05"), (10, 339, "21H00"), (10, 339, "21H00"),
             (11, 10, "No Shows 1H00"), (12, 10, "Tail"), (12, 495, "09H15"), (13, 10, "TARIF NORMAL"), (14, 10, "After 1H00"), (14, 260, "10H00")]
    df = spark.createDataFrame([(1, "2026-07-01", float(y), float(x), t, i) for i, (y, x, t) in enumerate(cells)],
                               "page int, week_start string, y double, x double, text string, position int")
    got = {r["title"]: (r["duration"], dict(r["showtimes"]), r["start_date"], r["end_date"]) for r in posts.grid_films(df).collect()}
    assert got == {
        "The Long Road Summer film festival": ("1h50", {"2026-07-01": ["18:00"], "2026-07-02": ["20:30"]}, "2026-07-01", "2026-07-02"),
        "Quiet Film little film festival int.—12 ans": ("", {"2026-07-04": ["11:00", "14:15"]}, "2026-07-04", "2026-07-04"),
        "Next One": ("2h05", {"2026-07-03": ["21:00"]}, "2026-07-03", "2026-07-03"),
        "Tail": ("", {"2026-07-07": ["09:15"]}, "2026-07-07", "2026-07-07")}


def _films_of(kinds):
    """The rows of each film and of its title, one row after the other."""
    films, titles, last, marked = [[]], [[]], None, False
    for i, k in enumerate(kinds):
        if k in "TPD" and last in (None, "D") or k in "TD" and marked:
            if last is not None:
                films.append([])
                titles.append([])
        films[-1].append(i)
        if k in "TPD" or k == "S" and last is not None:
            titles[-1].append(i)
        marked = marked and k not in "TD" or k == "S" and last in ("T", "P")
        last = k if k in "TPD" else last
    return list(zip(films, titles))


def test_timetable_kinds_in_any_order(spark):
    rng = random.Random(5)
    pages = ["".join(rng.choices("TPDSx", k=rng.randint(0, 14))) for _ in range(300)]
    words = {"T": "Title", "P": "int. 12 ans", "D": "End 1H30 9H00", "S": "little film festival", "x": "10H15"}
    rows, want = [], set()
    for p, kinds in enumerate(pages):
        rows += [(p, -1.0, 0.0, "VF : early", 0), (p, 0.0, 0.0, " FILMS ", 0), (p, 0.5, 0.0, "Mer", 0), (p, 99.0, 0.0, "TARIF NORMAL", 0), (p, 99.5, 0.0, "Late 1H00 2H00", 0), (p, 50.0, 0.0, None, 0)]
        rows += [(p, float(i + 1), 300.0 if k == "x" else 0.0, words[k], i) for i, k in enumerate(kinds)]
        for own, title in _films_of(kinds):
            shows = {"2026-07-03": ["10:15"]} if any(kinds[i] == "x" for i in own) else {}
            shows |= {"2026-07-01": ["9:00"]} if any(kinds[i] == "D" for i in own) else {}
            if shows and title:
                want.add((p, " ".join(words[kinds[i]].replace(" 1H30 9H00", "") for i in title), "1h30" * any(kinds[i] == "D" for i in own), str(sorted(shows.items()))))
    df = spark.createDataFrame(rows, "page int, y double, x double, text string, position int").withColumn("week_start", F.lit("2026-07-01")).repartition(3)
    films = posts.grid_films(df)
    got = [(r["page"], r["title"], r["duration"], str(sorted(r["showtimes"].items()))) for r in films.collect()]
    assert set(got) == want and len({(r["page"], r["film"]) for r in films.collect()}) == len(got)
    # rows are taken apart once, without windows, and showtimes are made once though a reader explodes them
    plan = films.select("page", F.explode("showtimes"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("map_from_entries") == 1 and plan.count("RLIKE") == 4


def test_retention_never_names_a_current_version(spark):
    rows = [("site", f"p{p}", v, f"2024-01-{v:02d}") for p in range(50) for v in range(1, 1 + p % 4 + 1)] + [("other", "p1", 1, "2020-01-01")]
    entries = spark.createDataFrame(rows, "name string, part string, version long, built_at string")
    newest = {}
    for name, part, version, _ in rows:
        newest[name, part] = max(version, newest.get((name, part), 0))
    for keep in (0, 1, 2, 30):
        gone = {(r["name"], r["part"], r["version"]) for r in store.expired_versions(entries, keep).collect()}
        assert gone == {(n, p, v) for n, p, v, _ in rows if v <= newest[n, p] - max(1, keep)}


def test_queue_honours_its_limit(spark):
    queue = spark.range(1500).select(F.col("id").cast("string").alias("id"), F.lit("open").alias("status"), F.lit("s").alias("source_id"), F.lit(0.5).alias("confidence"), F.lit("2024").alias("created_at"))
    assert [R.list_queue(queue, limit=n).count() for n in (0, 1200, None)] == [0, 1200, 1500]


def test_long_titles_stay_apart(spark):
    head = "Festival of the very long name that goes on and on for more than fifty letters"
    key = lambda t: spark.range(1).select(X.short_key(F.lit(t), F.lit("2024-01-01"))).first()[0]
    assert key(head + " first night") != key(head + " second night")


def test_html_fields_and_fallbacks(spark):
    page = ("<html><head><meta property='og:image' content='http://i/1.png'></head><body><h2>Second</h2><div class='x event-venue'><b>Grand</b> <i>Hall</i><script>no</script></div>"
            "<div class='event-website'><p><a href='http://w'>w</a></p></div><div class='price'>" + "9" * 300 + "</div></body></html>")
    df = spark.createDataFrame([(1, page), (2, None)], "id int, html string")
    got = {r["id"]: r for r in html.extract_fields(df, html.DETAIL_FIELDS).collect()}
    r = got[1]
    assert (r["title"], r["image_url"], r["venue_name"], r["website"], len(r["price"])) == ("Second", "http://i/1.png", "GrandHall", "http://w", 300)
    assert got[2]["title"] is None


def test_json_lines_and_links(spark):
    df = spark.createDataFrame([('{"a": 1}',), ("",), ("{bad",), ('[1]',), ('{"a": "x"}',), ('{"b": 2}',)], "l string")
    assert [r["record"]["a"] for r in files.parse_json_lines(df, F.col("l"), "a string").orderBy("l").collect()] == ["x", "1", None]
    feed = spark.createDataFrame([(2, "<rss><link> http://b/event/1 </link><link><![CDATA[http://a/event/2]]></link></rss>"), (1, "<rss><link>http://b/event/1</link></rss>")], "n int, x string")
    got = {(r["link"], r["doc"]) for r in files.xml_links(feed, "x", "n", "link", "/event/").collect()}
    assert got == {("http://b/event/1", 1), ("http://a/event/2", 2)}


def test_fourth_submission_is_refused_across_batches(spark):
    root, landing = fresh_path(spark, "t-intake"), fresh_path(spark, "t-landing")
    sub = lambda ids: spark.createDataFrame([(i, f"T{i}", "2026-07-01", None, "d", None, None, None, None, None) for i in ids], intake.SUBMISSION)
    for ids in ([1, 2], [3, 4]):
        sub(ids).coalesce(1).write.mode("append").json(landing)
        intake.start_intake(spark, landing, root).awaitTermination()
    assert {r["id"]: r["accepted"] for r in intake.outcomes(spark, root).collect()} == {1: True, 2: True, 3: True, 4: False}
    intake.start_intake(spark, landing, root).awaitTermination()  # nothing new: nothing changes
    assert intake.outcomes(spark, root).count() == 4


def test_decisions_free_places_once(spark):
    """Decided twice, for an id that was never accepted, and with the accepted one of the same batch."""
    root, landing = fresh_path(spark, "t-intake"), fresh_path(spark, "t-landing")
    sub = lambda ids, day="2026-07-01": spark.createDataFrame([(i, f"T{i}", day, None, "d", None, None, None, None, None) for i in ids], intake.SUBMISSION)

    def run(ids, day="2026-07-01"):
        sub(ids, day).coalesce(1).write.mode("append").json(landing)
        intake.start_intake(spark, landing, root, files_per_batch=100).awaitTermination()
        return {r["id"]: r["accepted"] for r in intake.outcomes(spark, root).collect()}

    assert run([5, 1, 4, 2, 3]) == {1: True, 2: True, 3: True, 4: False, 5: False}
    ids = spark.createDataFrame([(2,), (4,), (99,)], "id long")
    intake.decide(spark, root, ids)
    intake.decide(spark, root, ids)
    got = run([6, 7])
    assert got[6] and not got[7]
    intake.decide(spark, root, spark.createDataFrame([(8, "2026-07-01"), (1, "2026-07-01"), (3, "2026-07-01")], "id long, start_date string"))
    assert run([8, 9, 10])[8] and run([11, 12, 13]) == got | {8: True, 9: True, 10: False, 11: True, 12: False, 13: False}
    assert run([14], "bad day")[14] is False and run([15], "2026-08-01")[15]


def test_stand_equals_a_plain_walk():
    rng = random.Random(7)
    for _ in range(300):
        limit, stand, standing, unused = rng.randint(0, 4), (), set(), rng.sample(range(40), 40)
        for _ in range(5):
            new, unused = unused[:(n := rng.randint(0, 8))], unused[n:]
            gone = [rng.randrange(40) for _ in range(rng.randint(0, 6))]
            keeper = intake.Stand(stand, limit)
            rows, refused = [("s", i) for i in new] + [("d", i) for i in gone], []
            rng.shuffle(rows)
            for kind, i in rows:
                if kind == "d":
                    keeper.decide([i])
                elif (late := keeper.arrive({"id": i})) is not None:
                    refused.append(late["id"])
                assert len(keeper.waiting) <= limit
            settled = {row["id"]: ok for row, ok in keeper.settle()} | {i: False for i in refused}
            free = max(0, limit - len(standing - set(gone)))
            taken = set(sorted(new)[:free])
            assert settled == {i: i in taken for i in new}
            standing = (standing - set(gone)) | (taken - set(gone))
            stand = sorted(keeper.standing)
            assert set(stand) == standing


def test_json_array_is_read_by_many_tasks(spark):
    root = fresh_path(spark, "t-array")
    rows = [{"k": i, "t": f'quote " back \\ [x], {{y}} {i}', "n": {"a": [i, [i]]}} for i in range(20000)]
    rows[7] = {"k": "text", "t": 3}
    texts = {"big": json.dumps(rows), "spread": json.dumps(rows[:50], indent=1), "odd": ' \n[1, "a,b]", null, [2,3], {"k": 5}, {} ]\n ', "empty": "[]", "blank": " [ ] ", "one": '[{"k": 1}]', "object": '{"k": [1]}', "cut": json.dumps(rows[:9])[:-30],
             "bad": '[{"k": 1}, {"k": oops}]', "twice": "[1][2]", "nothing": ""}
    spark.createDataFrame(list(texts.items()), "name string, value string").repartition(3, "name").write.partitionBy("name").text(root)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        found = files.json_elements(spark, root).withColumn("name", F.regexp_extract("file", "name=([a-z]+)", 1)).select("name", "number", "element").collect()
        assert spark.read.option("lineSep", ",").text(f"{root}/name=big").rdd.getNumPartitions() > 5
        typed = files.read_json_arrays(spark, f"{root}/name=big", "k long, t string", text="element").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    got = {}
    for r in sorted(found, key=lambda r: (r["name"], r["number"])):
        got.setdefault(r["name"], []).append(json.loads(r["element"]))
    assert got == {name: json.loads(texts[name]) for name in ("big", "spread", "odd", "one")}
    assert sorted((r["k"], r["t"]) for r in typed if r["k"] is not None) == [(r["k"], r["t"]) for i, r in enumerate(rows) if i != 7]
    assert [(r["k"], r["t"], json.loads(r["element"])) for r in typed if r["k"] is None] == [(None, "3", rows[7])]


def test_one_odd_graph_item_hides_nothing(spark):
    block = '{"@graph":[1,{"@type":"Event","name":"G2","location":["a"]}]}'
    page = spark.createDataFrame([(f'<script type="application/ld+json">{block}</script><h1>no</h1>', "http://s/")], "html string, url string")
    r = html.structured_events(page).first()
    assert (r["structured"], r["title"], r["venue_name"]) == (True, "G2", None)


def test_versions_replay_and_parts(spark):
    root = fresh_path(spark, "t-store")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "source_id string, v int")
    store.publish_parts(df, root, "t", "source_id", version=0)
    store.publish_parts(df.withColumn("v", F.lit(9)), root, "t", "source_id", version=0)  # replay of a finished batch
    store.publish_parts(df.where("source_id = 'a'").withColumn("v", F.lit(5)), root, "t", "source_id", version=1)
    assert {(r["source_id"], r["v"]) for r in store.read_current(spark, root, "t").collect()} == {("a", 5), ("b", 2)}
    assert {(r["source_id"], r["v"]) for r in store.read_current(spark, root, "t", ["b"]).collect()} == {("b", 2)}
