"""SimHash groups, line spread and benchmark hits against plain versions."""

import random
import re

import numpy as np
import pytest
import xxhash

from listloom.llm import simhash
from listloom.llm.decontaminate import benchmark_hits, keep_clean, remove_spans
from listloom.llm.line_spread import drop_wide_lines


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(prints):
    """Least member of every value's component over pairs within three bits."""
    values = sorted(set(prints))
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1:]:
            if (a ^ b).bit_count() <= 3 and root(a) != root(b):
                parent[root(b)] = root(a)
    return {v: root(v) for v in values}


def test_near_duplicates(odd, documents):
    source = odd.select("doc_id", "text").union(documents.select("doc_id", "text").selectExpr("doc_id + 100", "text"))
    rows = source.collect()
    prints = [plain_fingerprint(t) for _, t in rows]
    roots = plain_components(prints)
    least = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[roots[p]] = min(i, least.get(roots[p], i))
    want = sorted((str(i), f"{p:016x}", least.get(roots[p])) for (i, _), p in zip(rows, prints))
    assert sorted((str(r[0]), r[1], r[2]) for r in simhash.near_duplicates(source).collect()) == want


def test_near_duplicates_of_nothing(odd):
    assert simhash.near_duplicates(odd.limit(0)).collect() == []


@pytest.mark.parametrize("group", [2, 5, 64])
def test_dense_groups(spark, group):
    """Clusters around a few centres, with groups above and below the limit of comparing."""
    rng = random.Random(group)
    values = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            v = centre
            for _ in range(rng.randint(0, 4)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    signed = [int(np.uint64(v).astype(np.int64)) for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), group)
    got = {int(np.int64(r.node).astype(np.uint64)): r.component for r in simhash.connected_components(edges).collect()}
    groups = {}
    for v in values:
        groups.setdefault(got.get(v, ("alone", v)), set()).add(v)
    want = {}
    for v, r in plain_components(values).items():
        want.setdefault(r, set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_keep_one_keeps_columns(odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = sorted((r.doc_id is None, r.doc_id) for r in kept.collect())
    # 1, 2 and 3 have no words; 4 (twice) and 5 are copies
    assert [i for none, i in ids if not none] == [1, 4, 4, 6, 7, 8]


def plain_hits(texts, items):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    windows = {}
    for name, t in items:
        w = words(t)
        if w:
            n = min(13, len(w))
            for k in range(len(w) - n + 1):
                windows.setdefault(tuple(w[k:k + n]), set()).add(name)
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for window, names in windows.items():
            for k in range(len(w) - len(window) + 1):
                if tuple(w[k:k + len(window)]) == window:
                    hit |= set(range(k, k + len(window)))
                    found |= names
        out.append((len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("shard_words", [200_000, 40])
def test_hits(spark, shard_words):
    rng = random.Random(3)
    vocabulary = ["a", "b", "c", "É", "x1"]
    items = [(str(i), " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 13, 14, 30])))) for i in range(12)] + [("none", None), ("blank", " .,"), ("0", "B, c a b")]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts += [f"{'y ' * rng.randint(0, 400)}{items[k][1]}; {'z ' * 30}" for k in range(12)] + [None, "", texts[5]]
    docs = spark.createDataFrame([(i % 70, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, items string")
    tests = spark.createDataFrame(items, "item_id string, text string")
    got = benchmark_hits(docs, tests, shard_words=shard_words)
    want = plain_hits(texts, items)
    assert sorted((r.text or "", r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got.collect()) == sorted((t or "", *w) for t, w in zip(texts, want))
    kept = keep_clean(docs, tests, shard_words=shard_words)
    assert kept.columns == docs.columns
    assert sorted(r.text or "" for r in kept.collect()) == sorted(t or "" for t, w in zip(texts, want) if not w[3])


def test_spans_are_cut(spark):
    docs = spark.createDataFrame([(1, "Before it: one two three, and after."), (2, None)], "doc_id long, text string")
    tests = spark.createDataFrame([(7, "ONE two THREE")], "item_id long, text string")
    assert sorted((r.doc_id, r.text) for r in remove_spans(docs, tests).collect()) == [(1, "Before it: , and after."), (2, None)]


def test_no_tests_and_no_documents(spark, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(not r.contaminated and r.n_hit == 0 for r in benchmark_hits(odd, none).collect())
    assert keep_clean(odd, none).count() == odd.count()
    assert benchmark_hits(odd.limit(0), none).collect() == []


def plain_lines(rows, least):
    sites, first = {}, {}
    for i, t, s in rows:
        for k, line in enumerate((t or "").split("\n")):
            if name := line.strip(" "):
                sites.setdefault(name, set()).add(s or "")
                first[name] = min(first.get(name, (i, k)), (i, k))
    out = []
    for i, t, _ in rows:
        if t is not None:
            keep = [line for k, line in enumerate(t.split("\n")) if not (name := line.strip(" ")) or len(sites[name]) < least or first[name] == (i, k)]
            t = "\n".join(keep)
        out.append((i, t))
    return sorted(out, key=str)


def test_lines(spark):
    rng = random.Random(5)
    rows = [(i, None if i == 7 else "\n".join(rng.choice([f"common {rng.randint(0, 3)}", f" rare {i}", f"some {rng.randint(0, 40)} ", "", "  "]) for _ in range(rng.randint(0, 9))),
             None if i % 11 == 0 else f"s{rng.randint(0, 7)}") for i in range(150)]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, source string, place string")
    for least in (1, 3, 5, 9):
        got = drop_wide_lines(docs, min_sites=least)
        assert got.columns == [*docs.columns, "n_removed"]
        assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == plain_lines(rows, least)


def test_lines_of_odd_rows(odd):
    got = drop_wide_lines(odd, min_sites=2)
    assert got.count() == odd.count()
    texts = [r.text for r in got.where("doc_id in (4, 5)").orderBy("doc_id").collect()]
    # a row listed twice is one place; the copy with the next id loses the line
    assert texts == ["One two three four five six seven."] * 2 + [""]
    assert drop_wide_lines(odd.limit(0)).collect() == []


def plain_alike(texts):
    """Places of all pairs of texts with a five-word Jaccard of 0.8 or more."""
    sets = [{tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if (w := re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))) else set() for t in texts]
    return [(i, j) for j in range(len(sets)) for i in range(j) if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]


def plain_kept(rows):
    """Ids that stay of (id, text): the least of each group over pairs that are alike or within three bits."""
    prints = [plain_fingerprint(t) for _, t in rows]
    pairs = plain_alike([t for _, t in rows]) + [(i, j) for j in range(len(rows)) for i in range(j) if (prints[i] ^ prints[j]).bit_count() <= 3]
    least = [i for i, _ in rows]
    while True:
        before = list(least)
        for i, j in pairs:
            least[i] = least[j] = min(least[i], least[j])
        if least == before:
            return set(least)


def test_stage_finds_five_word_similarity(spark, monkeypatch):
    """One of each group stays by brute-force Jaccard; few of the pairs are within three bits."""
    rng = random.Random(8)
    texts = []
    for _ in range(25):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 400))]
        texts.append(" ".join(words))
        for _ in range(3):
            words = list(words)
            for _ in range(rng.randint(1, max(1, len(words) // 60))):
                words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    texts += [texts[0].upper(), texts[5], "", None, "one two"]
    prints = [plain_fingerprint(t) for t in texts]
    assert sum((prints[i] ^ prints[j]).bit_count() > 3 for i, j in plain_alike(texts)) > 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = simhash.keep_one(docs)
    assert {r.doc_id for r in kept.collect()} == plain_kept(list(enumerate(texts)))


def test_pairs_in_one_template_are_all_found(spark):
    """250 pairs alike by over 0.8 share a template that makes all texts meet, though texts of two pairs are not alike."""
    rng = random.Random(21)
    template = [f"t{rng.randrange(10**6)}" for _ in range(300)]
    texts = []
    for k in range(250):
        pair = template + [f"p{k}x{j}" for j in range(28)]
        for side in "ab":
            texts.append(" ".join(pair + [f"{side}{k}y{j}" for j in range(22)]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert kept == plain_kept(list(enumerate(texts)))


@pytest.mark.parametrize("group", [1, 4])
def test_large_groups_lose_no_pair(spark, group):
    """Chains and templates of few words, with a limit that makes all groups large: components as by brute force."""
    rng = random.Random(group)
    texts = []
    for _ in range(6):
        template = [f"w{rng.randrange(40)}" for _ in range(rng.randint(30, 90))]
        for _ in range(12):
            words = list(template)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = f"n{rng.randrange(8)}"
            texts.append(" ".join(words[rng.randint(0, 6):]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marked = simhash.stored(simhash._marked(docs, "doc_id", "text", 3, 5), "marked")
    near = simhash.links(marked.select("fp").distinct())
    edges = simhash.alike_links(marked, docs, "doc_id", "text", 5, near, group)
    found = simhash._placed(marked.select("doc_id", "fp"), edges).collect()
    assert {r.doc_id for r in found if r.doc_id == r.component_id} == plain_kept(list(enumerate(texts)))


def test_partition_that_ends_with_a_large_group():
    """The last group is above the limit and fills its batch, with or without an empty batch after it."""
    import pyarrow as pa

    def batch(key, prints):
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(prints), np.int8)), pa.array(np.full(len(prints), key, np.int64)), pa.array(np.array(prints, np.int64))], ["view", "key", "fp"])

    large = [1 << b for b in range(21)]  # view 0 leaves these bits out
    want = [b.to_pydict() for b in simhash._resolve(iter([batch(0, large + [0])]), 100)]
    assert sum(len(b["u"]) for b in want) > 0
    for parts in ([batch(0, large)], [batch(0, large), batch(0, [])], [batch(0, large), batch(0, []), batch(0, [0])], [batch(0, [])]):
        got = [b.to_pydict() for b in simhash._resolve(iter(parts), 4)]
        held = {v for b in got for v, near in zip(b["v"], b["near"]) if near is not None}
        assert held == {v for p in parts for v in p.column("fp").to_pylist()}
