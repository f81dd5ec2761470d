"""Hard negatives against a plain search of all rows."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from listloom.llm import hard_negatives as module
from listloom.llm.hard_negatives import CoverTree, hard_negatives

FIELDS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def plain(rows, every=100, positives=5, negatives=5, share=80):
    """Rows (id, label, whole numbers), ids once."""
    out = []
    for own, label, q in rows:
        if own % every:
            continue
        score = {i: int(np.dot(q, v)) for i, _, v in rows}
        ranked = sorted((i for i in score if i != own), key=lambda i: (-score[i], i))
        of = {i: label for i, label, _ in rows}
        for p in [i for i in ranked if of[i] == label][:positives]:
            inside = [i for i in ranked if of[i] != label and share * score[p] <= 100 * score[i] <= 100 * score[p]]
            out += [(own, p, n + 1, i, score[p], score[i]) for n, i in enumerate(inside[:negatives])]
    return sorted(out)


def answer(df, **options):
    return sorted(tuple(r[f] for f in FIELDS) for r in hard_negatives(df, **options).collect())


def test_query_equals_plain_search(spark):
    from listloom.llm.queries import op12_hard_negatives
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, np.floor(256 * np.array(r.embedding, float)).astype(int))
            for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = op12_hard_negatives(spark, folder)
    assert sorted(tuple(r[f] for f in FIELDS) for r in got.collect()) == plain(rows)


@pytest.mark.parametrize("clustered", [True, False])
def test_many_trees(spark, monkeypatch, clustered):
    monkeypatch.setattr(module, "ROWS", 100)
    monkeypatch.setattr(module, "SAMPLE", 300)
    rng = np.random.default_rng(2)
    centre = rng.standard_normal((12, 8)) * 3
    rows = [(i, int(rng.integers(4)), (centre[i % 12] + rng.standard_normal(8) * 0.3) if clustered else rng.standard_normal(8)) for i in range(1500)]
    df = spark.createDataFrame([(i, label, [float(x) for x in v]) for i, label, v in rows], "vec_id long, label int, embedding array<double>")
    want = plain([(i, label, np.floor(256 * v).astype(int)) for i, label, v in rows], every=50, share=95)
    assert want and answer(df, every=50, share=95) == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.0]), (0, 2, [1.0, 0.5]), (1, 1, [1.0, 0.0]), (2, 1, [1.0, 0.0]), (3, 2, [1.0, 0.0]), (3, 2, [1.0, 0.0]), (4, 2, [0.9, 0.0]), (5, 2, [0.0, 0.0]),
            (6, None, [1.0, 0.0]), (7, 2, None), (8, 2, [1.0, None]), (9, 2, [nan, 1.0]), (10, 2, [inf, 1.0]), (None, 2, [1.0, 0.0]), (11, 2, [1.0]), (12, 2, []), (100, 3, [-1.0, 0.0]), (13, 3, [0.5, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").selectExpr("*", "'x' as g", "'x' as v", "'x' as floor", "'x' as windows", "'x' as tree", "'x' as rank")
    one, nine = 256 * 256, 256 * 230
    assert answer(df.repartition(3)) == sorted((0, p, r, n, one, s) for p in (1, 2) for r, n, s in ((1, 3, one), (2, 3, one), (3, 4, nine)))
    assert answer(df.limit(0)) == []


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 400), st.sampled_from([1, 3, 9]))
def test_tree_finds_what_is_there(seed, n, d):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.integers(-50, 50, (n, d)), rng.integers(-2, 2, (n, d)), np.zeros((2, d), np.int64)]).astype(np.int32)
    ids, labels = rng.permutation(len(x)), rng.integers(0, 3, len(x))
    top = float((x.astype(float) ** 2).sum(1).max())
    tree = CoverTree.of_row(CoverTree.build(ids, labels, x, top).row(), top)
    nodes = tree.nodes
    for i in range(len(nodes["start"])):
        inside = slice(nodes["start"][i], nodes["end"][i])
        wide = module.augmented(tree.x, top)
        assert np.sqrt(((wide[inside] - wide[nodes["center"][i]]) ** 2).sum(1)).max() <= nodes["radius"][i] * (1 + 1e-9)
        kids = slice(nodes["first"][i], nodes["first"][i] + nodes["count"][i])
        assert not nodes["count"][i] or (nodes["end"][kids] - nodes["start"][kids]).sum() == nodes["end"][i] - nodes["start"][i]
    q = rng.integers(-50, 50, d)
    low, high = sorted(rng.integers(-2000, 2000, 2).tolist())
    score = dict(zip(ids.tolist(), (x.astype(int) @ q).tolist()))
    want = sorted((i for i, label in zip(ids.tolist(), labels.tolist()) if label != 1 and low <= score[i] <= high), key=lambda i: (-score[i], i))[:4]
    found, scores = tree.best(q, lambda r: tree.labels[r] != 1, 4, low, high, {})
    assert found.tolist() == want and scores.tolist() == [score[i] for i in want]


@pytest.mark.parametrize("scale", [1, 1 << 12, 1 << 24])
def test_many_vectors_find_what_one_finds(monkeypatch, scale):
    """Vectors together, in strips, in all kinds of numbers: as each alone and each window alone."""
    monkeypatch.setattr(module, "STRIP", 7)
    monkeypatch.setattr(module, "ANCHORS", 13)
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.integers(-50, 50, (300, 5)), rng.integers(-2, 2, (200, 5))]).astype(np.int32) * scale
    ids, labels = rng.permutation(len(x)) // 2, rng.integers(0, 3, len(x))
    tree = CoverTree.build(ids, labels, x, float((x.astype(float) ** 2).sum(1).max()))
    q, own, label = x[:40].astype(np.int64), ids[:40], labels[:40]
    first = np.concatenate([[0], np.cumsum(rng.integers(1, 4, 40))])
    low, high = np.sort(rng.integers(-2000, 2000, (2, first[-1])) * scale * scale, axis=0).astype(float)
    low[::5], high[::7] = -np.inf, np.inf
    for same in (True, False):
        want = []
        for i in range(40):
            for w in range(first[i], first[i + 1]):
                found, scores = tree.best(q[i], lambda r: ((tree.labels[r] == label[i]) == same) & (tree.ids[r] != own[i]), 3, low[w], high[w], {})
                want += [(w, a, b) for a, b in zip(found.tolist(), scores.tolist())]
        assert want and list(zip(*(c.tolist() for c in tree.many(q, own, label, first, low, high, 3, same)))) == want


def test_descent_leaves_nodes_out():
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((40, 16)) * 4
    x = np.floor(256 * (centre[np.arange(4000) % 40] + rng.standard_normal((4000, 16)) * 0.1)).astype(np.int32)
    tree = CoverTree.build(np.arange(4000), np.zeros(4000, np.int64), x, float((x.astype(float) ** 2).sum(1).max()))
    seen = {}
    tree.best(x[0].astype(np.int64), lambda r: tree.ids[r] >= 0, 5, -np.inf, np.inf, seen)
    assert sum(map(len, seen.values())) < 1000
