"""The registered queries and the pipeline, stage by stage, on the smallest tables."""

import base64
import hashlib
import struct

import public_tokenizers as P
import pytest
from oracle import compare, connect
from test_duplicates import plain_hits, plain_kept, plain_lines

import corpus_pipeline
from listloom.llm.line_spread import MIN_SITES
from listloom.llm.queries import QUERIES, SQL
from listloom.llm.toxicity import fitted

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_token_counts": [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")],
    "op2_byte_bpe": [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")],
    "op3_simhash": [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")],
    "op4_url_reputation": [("page_id", "bigint"), ("host", "string"), ("path", "string"), ("rule", "string"), ("verdict", "string")],
    "op5_token_file": [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")],
    "op6_nearest": [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")],
    "op7_toxicity": [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")],
    "op8_decontaminate": [("doc_id", "bigint"), ("n_words", "bigint"), ("n_hit", "bigint"), ("n_items", "bigint"), ("items_sha256", "string"), ("contaminated", "boolean")],
    "op9_page_text": [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")],
    "op10_line_spread": [("doc_id", "bigint"), ("n_lines", "bigint"), ("n_removed", "bigint"), ("text", "string")],
    "op11_token_align": [("doc_id", "bigint"), ("n_a", "bigint"), ("n_b", "bigint"), ("n_groups", "bigint"), ("n_links", "bigint"), ("n_best", "bigint"), ("count_sum", "bigint"), ("groups_sha256", "string")],
    "op12_hard_negatives": [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")],
    "op13_order_minhash": [("doc_id", "bigint"), ("n_chars", "bigint"), ("edited_sha256", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double")],
}


def test_names():
    assert list(QUERIES) == list(COLUMNS)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "byte_bpe"]


@pytest.mark.parametrize("name", list(COLUMNS))
def test_query(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert df.dtypes == COLUMNS[name]
    if name in SQL:
        diff, *_ = compare(spark, connect(FOLDER), name, QUERIES[name], SQL[name], FOLDER)
        assert diff is None, diff
    else:
        assert df.count() > 0


def test_stages(spark, tmp_path):
    import tiktoken

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    inputs, outputs = {}, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        out.write.parquet(f"file://{tmp_path}/{name}")
        inputs[name], outputs[name] = docs, spark.read.parquet(f"file://{tmp_path}/{name}")
        if name != "byte_bpe":
            assert outputs[name].columns == docs.columns
        docs = outputs[name]

    def rows(df):
        return [(r["doc_id"], r["text"], r["source"]) for r in df.orderBy("doc_id").collect()]

    before, kept = rows(inputs["toxicity"]), {r[0] for r in rows(outputs["toxicity"])}
    network = fitted(inputs["toxicity"], spark.read.parquet(f"{FOLDER}/labels.parquet"))
    scores = network.scores([(t or "").encode() for _, t, _ in before])
    assert kept == {i for (i, *_), s in zip(before, scores) if s < 0.7}

    assert sorted(((i, t) for i, t, _ in rows(outputs["line_dedup"])), key=str) == plain_lines(rows(inputs["line_dedup"]), MIN_SITES)
    assert all(r["n_chars"] == len(r["text"]) for r in outputs["line_dedup"].collect())

    assert {r[0] for r in rows(outputs["near_dedup"])} == plain_kept([(i, t) for i, t, _ in rows(inputs["near_dedup"])])

    before = rows(inputs["decontamination"])
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert {r[0] for r in rows(outputs["decontamination"])} == {r[0] for r, w in zip(before, plain_hits([t for _, t, _ in before], items)) if not w[3]}

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t, _ in rows(inputs["byte_bpe"]):
        ids = encoding.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(tuple(r) for r in outputs["byte_bpe"].collect()) == want
    # the run as a whole does the same
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, FOLDER).collect()) == want
