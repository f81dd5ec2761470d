"""Aligned tokens against the two libraries and a plain alignment by byte offsets."""

import hashlib
from collections import Counter
from functools import reduce

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from listloom.llm.token_align import Fragment, Tokenizers, align, ranges, words_of

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(c): c for c in seen} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in seen)}
    pieces = {i: bytes(back[c] for c in p) for p, i in a.get_vocab().items() if p != "<|endoftext|>"}
    b = sentencepiece.SentencePieceProcessor(model_file=B)

    def tokens(text):
        if not text:
            return [], []
        one = [(i, pieces[i]) for i in a.encode(" " + text, add_special_tokens=False).ids]
        other = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        whole = (" " + text).encode()
        return (one, other) if whole == b"".join(p for _, p in one) == b"".join(p for _, p in other) else ([], [])

    return tokens


def spans(tokens):
    at, out = 0, []
    for i, piece in tokens:
        out.append((at, at + len(piece), i))
        at += len(piece)
    return out


def plain(rows, tokens):
    """Of each (id, text): its sums and groups, by comparing the places of all tokens."""
    every, counts = [], Counter()
    for key, text in rows:
        a, b = map(spans, tokens(text))
        shared = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        groups = [";".join("|".join(",".join(str(i) for s, e, i in side if low < e <= high) for side in (a, b)) for low, high in zip([0, *shared], shared))]
        links = [(i, j) for s, e, i in a for t, f, j in b if s < f and t < e] if len(a) < 300 else _swept(a, b)
        counts.update(links)
        every.append((key, len(a), len(b), len(shared), links, groups[0]))
    best = Counter()
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    return [(key, na, nb, ng, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), text) for key, na, nb, ng, links, text in every]


def _swept(a, b):
    out, j = [], 0
    for s, e, i in a:
        while b[j][1] <= s:
            j += 1
        k = j
        while k < len(b) and b[k][0] < e:
            out.append((i, b[k][2]))
            k += 1
    return out


@pytest.mark.parametrize("size,share", [(1 << 16, 1 << 20), (500, 1), (64, 300)])
def test_alignment(odd, documents, libraries, size, share):
    source = odd.select("doc_id", "text").union(documents.select("doc_id", "text").where("length(text) < 4000 or doc_id < 60"))
    aligned = align(source, A, B, size=size)
    text = {r.row: r.groups for r in aligned.groups().collect()}
    got = [(r.doc_id, *(r[f] for f in FIELDS), text[r.row]) for r in aligned.sums(share).collect()]
    want = plain([(r[0], r[1]) for r in source.collect()], libraries)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(r[1] == 0 and r[0] == 7 for r in got)  # a text that B does not give back


def test_query_digests(spark, libraries):
    from listloom.llm.queries import op11_token_align
    folder = "/root/testdata/sf0.001"
    want = {r[0]: (*r[1:7], hashlib.sha256(r[7].encode()).hexdigest() if r[7] else "") for r in plain([tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()], libraries)}
    assert {r.doc_id: (*(r[f] for f in FIELDS), r.groups_sha256) for r in op11_token_align(spark, folder).collect()} == want


def test_alignment_of_nothing(odd):
    aligned = align(odd.limit(0), A, B)
    assert aligned.sums().collect() == [] and aligned.groups().collect() == []


@pytest.fixture(scope="module")
def tokenizers():
    return Tokenizers(open(A, "rb").read(), open(B, "rb").read())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\tab'sé日.1<\x1c\x85", min_size=1, max_size=60), st.integers(1, 20))
def test_ranges_give_the_whole(tokenizers, libraries, text, size):
    from listloom.llm.token_align import _ANEW, _key
    whole = (" " + text).encode()
    found = []
    for start, end, at, to in ranges(whole, size):
        words = list(map(_key, _ANEW.split(whole[at:to].decode())))
        tokenizers.learn([words])
        found.append(tokenizers.fragment(words, at, start, end))
    words = words_of(text)
    tokenizers.learn([words])
    one = tokenizers.fragment(words)
    a, b = libraries(text)
    if a:
        assert one.a.tolist() == [i for i, _ in a] and one.b.tolist() == [i for i, _ in b]
        assert_same(reduce(Fragment.__add__, found), one)


def assert_same(x, y):
    assert all((getattr(x, f) == getattr(y, f)).all() for f in ("a", "b", "ends_a", "ends_b", "both_a", "both_b"))


@given(st.lists(st.integers(1, 4), max_size=30), st.lists(st.integers(1, 4), max_size=30), st.integers(0, 60), st.integers(0, 60))
def test_monoid(la, lb, p, q):
    """Any two cuts, composed in either order, give the whole."""
    ea, eb = np.cumsum(np.array(la, int)), np.cumsum(np.array(lb, int))

    def piece(low, high):
        a, b = (np.flatnonzero((e - l >= low) & (e - l < high)) for e, l in ((ea, np.array(la, int)), (eb, np.array(lb, int))))
        return Fragment.of(a, b, ea[a], eb[b])

    p, q = sorted((p, q))
    x, y, z, whole = piece(0, p), piece(p, q), piece(q, 1000), piece(0, 1000)
    assert_same((x + y) + z, whole)
    assert_same(x + (y + z), whole)
    assert_same(Fragment.empty() + whole, whole)
    assert_same(whole + Fragment.empty(), whole)
