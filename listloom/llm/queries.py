"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listloom.llm.ann import nearest
from listloom.llm.byte_bpe import encode
from listloom.llm.decontaminate import benchmark_hits
from listloom.llm.hard_negatives import hard_negatives
from listloom.llm.line_spread import LINE_SPREAD_SQL, drop_wide_lines
from listloom.llm.order_minhash import edit_likeness
from listloom.llm.page_diff import extract
from listloom.llm.simhash import near_duplicates
from listloom.llm.token_align import align
from listloom.llm.token_file import digests, token_file
from listloom.llm.token_count import token_counts
from listloom.llm.toxicity import toxicity
from listloom.llm.url_reputation import URL_SQL, judge_urls
from listloom.plans.registry import table


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    found = encode(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


def op4_url_reputation(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(table(spark, folder, "pages"))


def op5_token_file(spark: SparkSession, folder: str) -> DataFrame:
    return digests(token_file(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1))


def op6_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings"))


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = benchmark_hits(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op9_page_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract(table(spark, folder, "pages"))


def op10_line_spread(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn("n_lines", F.size(F.split("text", "\n", -1)))
    return drop_wide_lines(docs).select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), "text")


def op11_token_align(spark: SparkSession, folder: str) -> DataFrame:
    aligned = align(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digests = aligned.groups().select("row", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256"))
    return aligned.sums().join(digests, "row").drop("row")


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", shifted))


def op13_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    found = edit_likeness(table(spark, folder, "documents"))
    return found.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_byte_bpe, op3_simhash, op4_url_reputation, op5_token_file, op6_nearest, op7_toxicity, op8_decontaminate, op9_page_text, op10_line_spread,
                                  op11_token_align, op12_hard_negatives, op13_order_minhash)}
SQL: dict[str, str] = {"op4_url_reputation": URL_SQL, "op10_line_spread": LINE_SPREAD_SQL}
