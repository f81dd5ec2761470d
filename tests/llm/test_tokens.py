"""Token counts, byte-level BPE and token files against the tokenizers' own libraries."""

import base64
import struct
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from listloom.llm.byte_bpe import Ranks, decode, encode
from listloom.llm.common import read_bytes
from listloom.llm.token_count import pre_tokens, token_counts
from listloom.llm.token_file import digests, pack, read_tokens, token_file, unpack, write_tokens

NONE = -10**6


def key(i):
    return NONE if i is None else i


def both(odd, documents):
    return odd.select("doc_id", "text").union(documents.select("doc_id", "text"))


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts(spark, odd, documents):
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    source = both(odd, documents)
    got = sorted((key(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(source, P.path("piece_bpe_32k.model")).collect())
    want = sorted((key(i), len(t.encode()), n := len(model.encode(t)), n > 4096) for i, t in ((r[0], r[1] or "") for r in source.collect()))
    assert got == want
    # the shuffled way alone gives the same
    alone = token_counts(odd, P.path("piece_bpe_32k.model"), share=1)
    assert sorted((key(r[0]), r[2]) for r in alone.collect()) == sorted((key(r[0]), len(model.encode(r[1] or ""))) for r in odd.select("doc_id", "text").collect())


def test_counts_of_nothing(odd):
    assert token_counts(odd.limit(0), P.path("piece_bpe_32k.model")).collect() == []


@given(st.text(alphabet=" \n▁ab\tc,é", max_size=30))
def test_pre_tokens_cover(text):
    assert "".join(pre_tokens(text)) == (" " + text.replace("▁", " ") if text else "")


def test_bpe(spark, odd, documents, tiktoken_encoding):
    source = both(odd, documents)
    rows = encode(source, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    got = sorted((key(r.doc_id), r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in rows.collect())
    want = []
    for i, t in source.collect():
        ids = tiktoken_encoding.encode_ordinary(t or "")
        want.append((key(i), len(ids), struct.pack(f"<{len(ids)}I", *ids), (t or "").encode()))
    assert got == sorted(want)
    few = rows.limit(5)
    assert all(bytes(r.decoded) == bytes(r.again) for r in decode(few, P.path("byte_bpe_multi_50k.tiktoken"), name="again").collect())


def test_bpe_of_nothing(odd):
    assert encode(odd.limit(0), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect() == []


def test_ids_of_a_batch_are_decoded_together():
    from listloom.llm.byte_bpe import _decoded
    pieces = pa.array([b"a", b"", b"bc", b"\xff"], pa.large_binary())
    assert _decoded([struct.pack("<3I", 0, 2, 3), None, b"", struct.pack("<2I", 1, 2)], pieces) == [b"abc\xff", None, b"", b"bc"]
    assert _decoded([], pieces) == [] and _decoded([None, b""], pieces) == [None, b""]


def test_folded_words_reach_the_block_of_their_texts(spark, documents):
    """Words whose number of a block is not that of the texts are folded for nothing, and merged again where they stand."""
    from pyspark.sql import functions as F
    import regex
    from listloom.llm.byte_bpe import _met, _of_block, folded
    from listloom.llm.common import texts
    ranks = Ranks(read_bytes(P.path("byte_bpe_multi_50k.tiktoken")))
    some = texts(documents.limit(200).repartition(3)).withColumn("part", F.spark_partition_id())
    none = spark.sparkContext.broadcast((pa.array([], pa.string()), pa.array([], pa.large_binary())))
    met = _met(some, none, P.PATTERN, folded(F.col("word"), ranks, ranks.pair_maps()), "<i4").collect()
    words = {r.block: set() for r in met if r.n == 0}
    for r in met:
        if r.n:
            found, ids = _of_block(r.n, r.size, bytes(r.data), "<i4", 0)
            words[r.block].update(found.to_pylist())
            assert ids.to_pylist() == [ranks.merged(w.encode()) for w in found.to_pylist()]
    held = {r.block: [] for r in met if r.n == 0}
    for r in met:
        if r.n == 0:
            held[r.block] += pa.ipc.open_stream(bytes(r.data)).read_all().column("text").to_pylist()
    assert len(held) == 3
    for block, found in held.items():
        assert words[block] - set("\n.,;:!?") == {w for t in found for w in regex.findall(P.PATTERN, t) if len(w.encode()) <= 256} - set("\n.,;:!?")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=" ab\n\n.,!1é日\t\r\x1c\x85'sß", max_size=20), min_size=1, max_size=5))
def test_cut_texts_have_the_words_of_whole_ones(tiktoken_encoding, some):
    import regex
    from listloom.llm.byte_bpe import _Cut
    ranks = test_queue_of_long_words.__dict__.setdefault("ranks", Ranks(read_bytes(P.path("byte_bpe_multi_50k.tiktoken"))))
    nothing = pa.array([], pa.string()), pa.array([], pa.large_binary())
    want = [struct.pack(f"<{len(i)}I", *i) for i in map(tiktoken_encoding.encode_ordinary, some)]
    assert _Cut(pa.array(some), regex.compile(P.PATTERN).findall).ids(*nothing, ranks.merged).to_pylist() == want
    # a pattern that takes a line end with the mark before it: texts are not cut there
    other = regex.compile(r" ?\p{L}+| ?[^\s\p{L}]+[\n]*|\s+(?!\S)|\s+").findall
    want = [b"".join(ranks.merged(w.encode()) for w in other(t)) for t in some]
    assert _Cut(pa.array(some), other).ids(*nothing, ranks.merged).to_pylist() == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aenrstzéß日", min_size=1, max_size=40))
def test_queue_of_long_words(tiktoken_encoding, word):
    ranks = test_queue_of_long_words.__dict__.setdefault("ranks", Ranks(read_bytes(P.path("byte_bpe_multi_50k.tiktoken"))))
    assert np.frombuffer(ranks.merged(word.encode()), "<u4").tolist() == tiktoken_encoding.encode_ordinary(word)


@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_pack_round_trip(values):
    control, data = pack(np.array(values, np.uint32))
    assert unpack(control, data, len(values)).tolist() == values and len(control) == -(-len(values) // 4)


def test_token_file(spark, odd, documents, tmp_path):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    source = both(odd.where("doc_id is null or doc_id < 7 or text not like '%1%'"), documents.selectExpr("doc_id + 100 as doc_id", "text"))
    got = [tuple(r) for r in digests(token_file(source, P.path("word_bpe_49k.json"))).orderBy("start").collect()]
    start, want = 0, []
    for i, t in sorted(((key(r[0]), r[1] or "") for r in source.collect())):
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [1]
        want.append((None if i == NONE else i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert got == want
    write_tokens(odd.limit(0), f"file://{tmp_path}/empty", P.path("word_bpe_49k.json"))
    assert read_tokens(spark, f"file://{tmp_path}/empty").collect() == []


def test_chunks_are_met_once_a_batch():
    """Ids of a batch from its distinct chunks, whatever white space parts them, and each learned a single time."""
    from tokenizers import Tokenizer
    from listloom.llm.token_file import _Encoder
    model = read_bytes(P.path("word_bpe_49k.json"))
    tokenizer, encode, learned = Tokenizer.from_str(model.decode()), _Encoder(model), []
    learn = encode._learn
    encode._learn = lambda chunks: (learned.append(chunks), learn(chunks))
    space = "x".join(chr(i) for i in (*range(0x3100), *range(0xFF00, 0x11000)))
    for batch in ([space, "", " ", "ﬁn straße ÉCOLE, µ. ª"], [space.replace("\x1c", "").replace("\x1d", "").replace("\x1e", "").replace("\x1f", ""), " a  b\u0085c\u180ed "], ["", ""], []):
        got = encode(pa.array(batch, pa.string()), b"")
        assert got == [struct.pack(f"<{len(ids)}I", *ids) for ids in (tokenizer.encode(t, add_special_tokens=False).ids for t in batch)]
    assert got == [] and len(set(sum(learned, []))) == len(sum(learned, []))
    assert encode(pa.array(["z", "ones two ones.", "two, Two"])[1:], b"")[0] == struct.pack("<4I", *tokenizer.encode("ones two ones.", add_special_tokens=False).ids)


def test_words_are_learned_once_whatever_case_and_marks():
    """Chunks that differ by case and marks share one word; marks are kept apart, and what composes or folds is left to the tokenizer."""
    from tokenizers import Tokenizer
    from listloom.llm.token_file import _Encoder
    model = read_bytes(P.path("word_bpe_49k.json"))
    tokenizer, encode, learned = Tokenizer.from_str(model.decode()), _Encoder(model), []
    learn = encode._learn
    encode._learn = lambda chunks: (learned.extend(chunks), learn(chunks))
    marks = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    batch = [" ".join(w + m for w in ("ones", "Ones", "ONES", "école", "ÉCOLE") for m in ("", "!!", "...", *marks)), "it's it'll' ones's e\u0301! İx K!! ſ. ª, µº <|endoftext|> ones<|endoftext|>."]
    got = encode(pa.array(batch), b"")
    assert got == [struct.pack(f"<{len(ids)}I", *ids) for ids in (tokenizer.encode(t, add_special_tokens=False).ids for t in batch)]
    assert len(set(learned)) == len(learned)
    assert [c for c in learned if "ones" in c.lower() or "école" in c.lower()] == ["ones", "école", "ones's", "ones<|endoftext|>."]


def test_frequent_ids_take_one_byte(spark, documents):
    from listloom.llm.token_file import frequency_order, token_ids
    coded = token_ids(documents, P.path("word_bpe_49k.json"), 1)
    order = frequency_order(coded)
    counts = np.bincount(np.concatenate([np.frombuffer(r.ids, "<u4") for r in coded.collect()]))
    assert (np.diff(counts[order]) <= 0).all() and len(order) == (counts > 0).sum()
