"""Learned operators: URL reputation, nearest neighbours, toxicity; page text."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from listloom.llm import toxicity as tox
from listloom.llm.ann import Index, balanced_partitions, nearest, neighbours
from listloom.llm.page_diff import blocks, extract, shared
from listloom.llm.url_reputation import host_of, judge_urls, path_of

URLS = [None, "", "no scheme", "http://", "HTTPS://A.Example.ORG/es/x?q=1#f", "x://example.org/en/15", "x://sub.example.org/en/2", "http://notexample.org/es/", "ftp://HOST:80", "a://b://c/d",
        "http://b.com/fr/1", "http://b.com/de/1", "http://b.com/de", "//com/fr/", "http://com/fr/?x", "http://É.org/ü#", "http://x.net/a\nb/c"]


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    end = min([i for i in (tail.find(c) for c in "?#") if i >= 0], default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail[:end]


def test_url_parts_and_rules(spark):
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)] + [(0, None, "x", "y")], "page_id long, url string, rule string, host string")
    got = {r.page_id: r for r in judge_urls(df).collect()}
    assert judge_urls(df).count() == len(URLS) + 1
    for i, u in enumerate(URLS):
        assert (got[i].host, got[i].path) == plain_url(u), u
    assert got[4].rule == "example.org/es/" and got[4].verdict == "block"
    assert got[5].rule == "example.org/en/1" and got[6].rule == "org/"
    assert got[7].rule == "org/" and got[10].rule == "com/fr/" and got[11].rule == "com/de/" and got[12].rule is None
    assert got[0].verdict == "allow"
    assert judge_urls(df.limit(0)).collect() == []


def test_bad_hosts_are_blocked(spark):
    rows = [(i, f"http://bad.com/de/{i}") for i in range(40)] + [(100 + i, f"http://good.com/fr/{i}") for i in range(40)] + [(200, "http://bad.com/x"), (201, "http://good.com/x"), (202, "http://new.com/")]
    got = {r.page_id: r.verdict for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert (got[200], got[201], got[202]) == ("block", "allow", "allow")


def test_partitions_are_balanced_and_cut_little():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=8) * 3 + rng.normal(size=(100, 8)) for _ in range(8)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = neighbours(x, 10)
    part = balanced_partitions(near, 8)
    assert np.bincount(part).tolist() == [100] * 8
    assert (part[near] == part[:, None]).mean() > 0.6


def plain_nearest(rows, every, k):
    out = []
    for q, v in {i: min(w for j, w in rows if j == i) for i, _ in rows if i % every == 0}.items():
        scored = []
        for i, w in rows:
            if i != q:
                s = 0.0
                for a, b in zip(v, w):
                    s += a * b
                scored.append((-s, i))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def test_nearest_is_exact_in_one_partition(spark):
    rng = np.random.default_rng(1)
    good = [(i, rng.normal(size=4).round(1).tolist()) for i in range(1, 90)] + [(i, [0.5, 0.5, 0.0, 1.0]) for i in range(90, 140)] + [(20, [0.5, 0.5, 0.0, 1.0])]
    good = [(i, v) for i, v in good if any(v)]
    bad = [(200, None), (201, []), (202, [0.0] * 4), (203, [1.0, None, 0.0, 0.0]), (204, [float("nan"), 1.0, 1.0, 1.0]), (220, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0] * 4), (221, [1.0] * 3)]
    df = spark.createDataFrame([(*r, 1) for r in good + bad], "vec_id long, embedding array<double>, part int").repartition(4)
    assert sorted(tuple(r) for r in nearest(df, k=7).collect()) == plain_nearest(good, 20, 7)
    assert nearest(df.limit(0)).collect() == []
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in nearest(few).collect()] == [(0, 1, 1, 3.0)]


def test_recall_of_routed_search():
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(60, 1, 32)) + 0.6 * rng.normal(size=(60, 150, 32))).reshape(-1, 32)
    drawn = np.flatnonzero(rng.random(len(x)) < 0.4)
    index = Index(x[drawn], drawn, 8, 20)
    home = index.home(x)
    sizes = np.bincount(home, minlength=index.parts)
    some = np.arange(0, len(x), 45)
    true = neighbours(x, 20)[some]
    probed = index.probed(x[some], sizes, 21)
    assert index.probes < index.parts
    assert np.mean([np.isin(home[t], p).mean() for t, p in zip(true, probed)]) >= 0.9
    for q, own, p, floor in zip(x[some], some, probed, index.floor(x[some], some, probed)):
        scores = np.sort((x @ q)[np.isin(home, p) & (np.arange(len(x)) != own)])
        assert floor <= scores[-20]


def test_gradients():
    net, words = tox.Network(1), tox.Words([b"vequx the trash of it all", b"short one", b""])
    first, text = words.windows()
    target, weight = np.array([1, 0], np.float32), np.array([1.0, 2.0], np.float32)
    _, g = net.gradients(words, first, text, target, weight)
    for name, p in net.p.items():
        at = np.unravel_index(np.abs(g[name]).argmax(), p.shape)
        old, sides = p[at], []
        for step in (1e-2, -1e-2):
            p[at] = old + step
            sides.append(net.gradients(words, first, text, target, weight)[0])
        p[at] = old
        assert (sides[0] - sides[1]) / 2e-2 == pytest.approx(g[name][at], rel=0.05, abs=1e-4), name


def test_windows_overlap_and_cover():
    words = tox.Words([b"w " * n for n in (0, 1, 32, 33, 100)])
    first, text = words.windows()
    for i, n in enumerate((0, 1, 32, 33, 100)):
        starts = first[text == i] - words.cut[i]
        seen = np.zeros(n, int)
        for s in starts:
            seen[s:s + tox.WINDOW] += 1
        assert (seen > 0).all() and (n < 33 or len(starts) > 1)
        assert not n or starts[-1] + tox.WINDOW >= n


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = tox.toxicity(docs, labels).join(labels, "doc_id").where("held_out").select("toxic", "predicted", "score").collect()
    toxic = [r.predicted for r in got if r.toxic == 1]
    clean = [r.predicted for r in got if r.toxic == 0]
    assert all(0 <= r.score <= 1 for r in got)
    assert np.mean(toxic) > 0.75 and np.mean(clean) < 0.02


def test_toxicity_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(4, 0), (8, 1), (8, None), (99, 1)], "doc_id long, toxic int")
    rows = tox.toxicity(odd, labels).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    empty = [r.score for r in rows if r.doc_id in (1, 2, 3)]
    assert max(empty) == min(r.score for r in rows)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in tox.toxicity(odd, none).collect()} == {0}
    assert tox.toxicity(odd.limit(0), labels).collect() == []
    civil = tox.keep_civil(odd, none)
    assert civil.columns == odd.columns and civil.count() == odd.count()
    assert {r[0] for r in civil.select("score").collect()} == {"x"}  # a column of the table, not the network's


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/a">Menu</a></ul></nav><div class="cookie-notice">We use cookies</div><!-- ad <p>x</p> --><article><header><h1>Head &amp; line</h1></header>
<p><b>One&nbsp;two <i>three</i>four<br>five<p>Next
 line &lt;b&gt; caf&eacute;</p><div class="adBox">Buy</div><aside>Side</aside><form><input value=">"><button>Go</button></form><ul><li>a<li>b</ul>
<section id="comments"><p>nice</p></section><pre>x   y</pre></article><p>loose</p><footer>&copy; foot</footer></body></html>"""


def test_blocks():
    assert blocks(PAGE) == [(True, "Head & line"), (True, "One two threefour five"), (True, "Next line <b> café"), (True, "a"), (True, "b"), (True, "x y"), (False, "loose")]
    assert blocks("") == [] and blocks("<p") == [] and blocks("plain < text") == [(False, "plain < text")]
    assert blocks("<article><p>cut off &am") == [(True, "cut off &am")] and blocks("<script>never ends") == []


def test_longest_common_lines():
    assert shared([1, 2, 3, 4], [2, 9, 4, 1]) == {1, 3}
    assert shared([5] * 100, [5] * 100) == set(range(100)) or len(shared([5] * 100, [5] * 100)) > 60


@pytest.mark.parametrize("bits", [1, 200, 1 << 27])
def test_common_lines_that_repeat_often(monkeypatch, bits):
    monkeypatch.setattr("listloom.llm.page_diff.TRACE_BITS", bits)
    rng = np.random.default_rng(4)
    cases = [([5] * 100, [5] * 100), ([1, 2] * 150 + [5] * 200, [5] * 200 + [2, 1] * 100), ([], [1])]
    cases += [(rng.integers(0, k, rng.integers(0, 40)).tolist(), rng.integers(0, k, rng.integers(0, 40)).tolist()) for k in (2, 3, 9) for _ in range(30)]
    for a, b in cases:
        length = [0] * (len(b) + 1)
        for x in a:
            length = _next_lengths(length, x, b)
        places = sorted(shared(a, b))
        assert len(places) == length[-1]
        rest = iter(b)
        assert all(a[i] in rest for i in places)


def _next_lengths(length, x, b):
    out = [0]
    for j, y in enumerate(b):
        out.append(length[j] + 1 if x == y else max(out[-1], length[j + 1]))
    return out


def test_neighbours_lose_shared_lines(spark, monkeypatch):
    shell = "<body><p>Welcome to the site</p><p>text of {}</p><p>All rights reserved</p></body>"
    rows = [(i, f"http://h.org/a/{i:02d}", shell.format(i)) for i in range(30)] + [(50, "http://alone.org/", shell.format(50)), (51, None, shell.format(51)), (52, "http://h.org/z", None), (3, "http://h.org/a/03", shell.format(3))]
    rows += [(60, "http://c.org/1", "<article><p>same</p></article>"), (61, "http://c.org/2", "<article><p>same</p></article>")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string").repartition(3)
    monkeypatch.setattr("listloom.llm.page_diff._bounds.__defaults__", (4,))
    got = extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == len(rows)
    for r in got.collect():
        if r.page_id < 30:
            assert r.text == f"text of {r.page_id}"
        elif r.page_id in (50, 51):
            assert r.text == f"Welcome to the site\n\ntext of {r.page_id}\n\nAll rights reserved"
        else:
            assert r.text == {52: "", 60: "same", 61: "same"}[r.page_id]
        assert r.n_chars == len(r.text)
    assert extract(df.limit(0)).collect() == []


def test_copies_of_a_page_keep_their_text(spark, monkeypatch):
    shell = "<body><p>Welcome to the site</p><p>text of {}</p></body>"
    rows = [(1, "http://h.org/a", "one"), (2, "http://h.org/a", "one"), (3, "http://h.org/b", "one"), (3, "http://h.org/b", "one"), (3, "http://h.org/b", "one"), (4, "http://h.org/c", "two"),
            (5, "http://h.org/d", "one")]
    df = spark.createDataFrame([(i, u, shell.format(t)) for i, u, t in rows], "page_id long, url string, html string").repartition(3)
    for size in (1, 2000):
        monkeypatch.setattr("listloom.llm.page_diff._bounds.__defaults__", (size,))
        assert sorted((r.page_id, r.url, r.text) for r in extract(df).collect()) == [(i, u, f"text of {t}") for i, u, t in rows]
    twins = spark.createDataFrame([(i, f"http://t.org/{i}", shell.format("x")) for i in range(3)], "page_id long, url string, html string")
    assert {r.text for r in extract(twins).collect()} == {"Welcome to the site\n\ntext of x"}


def test_host_and_path_columns(spark):
    row = spark.range(1).select(host_of(F.lit("a://B.c?x")).alias("h"), path_of(F.lit("a://B.c?x")).alias("p")).first()
    assert (row.h, row.p) == ("b.c", "")
