"""Order MinHash against a plain version, and the pairs of the query against a sorted list."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from listloom.llm import order_minhash as module
from listloom.llm.order_minhash import OrderMinHash, edit_likeness, fingerprints, likeness, spliced, written


def plain(text, sketch):
    """Numbered k-mers sorted as a whole for each function."""
    kmers = sketch.kmers(text)
    seen, numbered = {}, []
    for place, kmer in enumerate(kmers.tolist()):
        numbered.append((kmer, place, seen.setdefault(kmer, 0)))
        seen[kmer] += 1
    out = []
    for turn, times in zip(sketch.turn[:, 0].tolist(), sketch.times[:, 0].tolist()):
        base = [int(module._mixed(np.array([(k * int(module._TIMES) + n) % 2**64], np.uint64))[0]) >> 32 for k, _, n in numbered]
        least = sorted(range(len(base)), key=lambda i: ((base[i] ^ turn) * times % 2**32, i))[:sketch.together]
        value = np.full(1, len(least), np.uint64)
        for i in sorted(least, key=lambda i: numbered[i][1]):
            value = module._mixed(value * np.uint64(31) + np.uint64(numbered[i][0]))
        out.append(int(value[0] >> np.uint64(48)))
    return out


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abc é日", max_size=60), st.sampled_from([1, 2, 3, 5, 8]), st.integers(1, 4))
def test_sketch_equals_plain_version(text, k, together):
    sketch = OrderMinHash(k, together, 8)
    assert sketch(text).tolist() == plain(text, sketch)


def test_slices_make_no_difference(monkeypatch):
    text = "the quick brown fox jumps over the lazy dog " * 30
    whole = OrderMinHash()(text)
    monkeypatch.setattr(module, "_SLICE", 7)
    assert (OrderMinHash()(text) == whole).all()
    monkeypatch.setattr(module, "_PLACE", 3)
    assert (OrderMinHash()(text) == whole).all()


@given(st.text(alphabet="ab日", max_size=30), st.integers(1, 9))
def test_kmers_are_equal_where_texts_are(text, k):
    size = min(k, len(text))
    runs = [text[i:i + size] for i in range(len(text) - size + 1)] if text else []
    found = OrderMinHash(k).kmers(text).tolist()
    assert len(found) == len(runs) and len(set(found)) == len(set(runs)) == len(set(zip(found, runs)))


def test_order_and_edits_count():
    rng = np.random.default_rng(1)
    text = " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(600))
    sketch = OrderMinHash(functions=256)

    def near(other):
        return (sketch(text) == sketch(other)).mean()

    half = len(text) // 2
    assert near(text[half:] + text[:half]) < 0.75  # equal k-mers but one in 500, other order
    assert near(text[:-20] + "x" * 20) > 0.9
    assert near(text[:half]) > near(text[:half // 2]) > near(text[::-1])
    assert near(text) == 1.0


def test_fingerprints(spark, odd):
    rows = fingerprints(odd).collect()
    sketch = OrderMinHash()
    assert sorted(((r.doc_id, r.fingerprint) for r in rows), key=str) == sorted(((r.doc_id, written(sketch(r.text or ""))) for r in odd.select("doc_id", "text").collect()), key=str)
    pair = spark.createDataFrame([(written(sketch("one text of some length")), written(sketch("one text of some lengths")))], "a string, b string").select(likeness("a", "b"), likeness("a", "a"))
    assert tuple(pair.first()) == ((sketch("one text of some length") == sketch("one text of some lengths")).mean(), 1.0)
    assert fingerprints(odd.limit(0)).collect() == []


def expected(rows):
    """Rows (id, text) with ids once: what the query returns."""
    sketch, out = OrderMinHash(), []
    rows = sorted(((i, t or "") for i, t in rows), reverse=True)
    for (i, t), (_, following) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        edited = t[:len(t) - half] + following[:half]
        a, b, c = sketch(t), sketch(edited), sketch(following)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), written_le(a), written_le(b), (a == b).mean(), (a == c).mean()))
    return sorted(out)


def written_le(values):
    return values.astype("<u2").tobytes().hex()


def test_query_equals_sorted_list(spark):
    from listloom.llm.queries import op13_order_minhash
    folder = "/root/testdata/sf0.001"
    want = expected([tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()])
    got = op13_order_minhash(spark, folder)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert sorted(tuple(r) for r in got.collect()) == want


@pytest.mark.parametrize("n", [0, 1, 2, 7])
def test_few_rows(spark, n):
    rows = [(5 * i, [None, "", "a", "日本語 text é", "b" * 300, "same", "same"][i]) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as edge", "'x' as shard", "'x' as tie", "'x' as next")
    got = edit_likeness(df.repartition(3)).collect()
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256, bytes(r.fingerprint).hex(), bytes(r.edited_fingerprint).hex(), r.near_edited, r.near_next) for r in got) == expected(rows)


def test_repeated_and_null_ids(odd):
    got = edit_likeness(odd).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in odd.select("doc_id").collect())
    alike = {(r.fingerprint, r.n_chars) for r in got if r.doc_id in (4, 5)}
    assert len(alike) == 1 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_spliced():
    assert spliced("abcde", "XYZ") == "abcXY" and spliced("abcdef", "X") == "abcX" and spliced("a", "X") == "a" and spliced("", "X") == ""
