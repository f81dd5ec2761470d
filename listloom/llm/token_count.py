"""Token counts without token ids: count every distinct pre-token once, join, sum."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

from listloom.llm.common import batches, frequent, read_bytes, small_batches, stored, texts

#: A pre-token is a run of spaces with what follows them, or a line break with what follows it. No
#: piece of the model holds a space behind another character, or a line break, so merges never cross.
_PRE_TOKEN = re.compile(r" +[^ \n]*|\n[^ \n]*")
#: Longer pre-tokens are counted where they stand: as join keys they would be bulky, and hardly any repeat.
LONG = 64
#: Distinct pre-tokens that a task holds before it hands their counts on.
HELD = 500_000


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text, with the space that the model puts before it."""
    return _PRE_TOKEN.findall(" " + text.replace("▁", " ")) if text else []


class PieceCounter:
    """Counts the pieces of single pre-tokens as they count inside a text."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        if bad := [p for p in map(self.model.id_to_piece, range(self.model.get_piece_size())) if re.search("[^▁]▁|\n", p)]:
            raise ValueError(f"pieces that cross pre-tokens: {bad[:5]}")

    def __call__(self, words: list[str]) -> list[int]:
        # encode() puts one space before its input; a line break never merges with it
        ids = self.model.encode([w if w[0] == "\n" else w[1:] for w in words], num_threads=1)
        return [1 if w == " " else len(i) - (w[0] == "\n") for w, i in zip(words, ids)]


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, doc_id: str = "doc_id", text: str = "text",
                 share: int = 1 << 20) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``, as the SentencePiece model counts whole texts.

    Every distinct pre-token is counted once. Those that make up at least one in ``share`` of all
    occurrences (at most ``share``, whatever the input) go to every task; the others are joined by a
    shuffle in which none has more rows than that. Only sums of counts travel, never ids.

    Null and empty texts have 0 bytes and 0 tokens. Rows that repeat, in their id or as a whole, give a
    row each; a null id stays null. Other columns are ignored, whatever their names. An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(read_bytes(model_path))
    rows = texts(docs, doc_id, text).withColumn("row", F.monotonically_increasing_id())

    def occurrences(parts):
        def pairs():
            seen: Counter = Counter()
            for part in parts:
                for t in part.column("text").to_pylist():
                    seen.update(pre_tokens(t))
                    if len(seen) > HELD:
                        yield from seen.items()
                        seen.clear()
            yield from seen.items()

        yield from batches(((w, n) for w, n in pairs() if len(w) <= LONG), pa.schema([("word", pa.string()), ("n", pa.int64())]))

    def counted(parts):
        count = PieceCounter(model.value)
        for part in parts:
            words = part.column("word").to_pylist()
            yield pa.RecordBatch.from_arrays([part.column("word"), part.column("n"), pa.array(count(words), pa.int64())], ["word", "n", "pieces"])

    totals = rows.select("text").mapInArrow(occurrences, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    vocabulary = stored(totals.mapInArrow(counted, "word string, n long, pieces long"), "pieces")
    shared = spark.sparkContext.broadcast(dict(frequent(vocabulary, "n", share).select("word", "pieces").collect()))
    key = rows.schema["doc_id"].dataType
    schema = to_arrow_schema(StructType().add("row", "long").add("word", "string").add("n", "long").add("head", StructType().add("doc_id", key).add("n_bytes", "long")))

    def looked_up(parts):
        count, table = PieceCounter(model.value), shared.value

        def found():
            for part in parts:
                for row, key, t in zip(*(part.column(c).to_pylist() for c in ("row", "doc_id", "text"))):
                    total, long = 0, []
                    for w, n in Counter(pre_tokens(t)).items():
                        pieces = table.get(w)
                        if pieces is not None:
                            total += n * pieces
                        elif len(w) > LONG:
                            long.append((w, n))
                        else:
                            yield row, w, n, None
                    if long:
                        total += sum(p * n for p, (_, n) in zip(count([w for w, _ in long]), long))
                    # the sum so far has a word of its own, which no text has and which is no hot key
                    yield row, f"\n\n{row}", total, {"doc_id": key, "n_bytes": len(t.encode())}

        yield from batches(found(), schema)

    parts = rows.mapInArrow(looked_up, from_arrow_schema(schema)).join(vocabulary.select("word", "pieces"), "word", "left")
    return (parts.groupBy("row").agg(
                F.first("head", ignorenulls=True).alias("head"), F.sum(F.col("n") * F.coalesce("pieces", F.lit(1))).alias("n_tokens"))
            .select("head.doc_id", "head.n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
