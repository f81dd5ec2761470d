"""Token files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes."""

from __future__ import annotations

import hashlib
import json
import os
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StructType

from listloom.llm.common import read_bytes, small_batches, stored, texts
from listloom.session import fresh_path

#: Ids of a segment, about: a segment ends with the document that reaches it.
SEGMENT = 1 << 20
#: Words, and other chunks of text, whose ids a worker keeps.
KEPT = 1_000_000
_SPACE = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
#: Letters up to U+00FF, where composing changes nothing and lower case goes letter by letter, and marks, which the pattern parts from them.
_PLAIN = r"^(?P<word>[A-Za-zªµºÀ-ÖØ-öø-ÿ]+)(?P<mark>[!-/:-@\[-`{-~]*)$"
#: White space for Arrow and Python, but not for Unicode's property.
_CONTROL = (b"\x1c", b"\x1d", b"\x1e", b"\x1f")
#: For each control byte, the lengths of the four values it stands for.
_LENGTHS = np.array([[1 + (c >> s & 3) for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)
#: The steps before the merges that make words of letters independent, and the pattern among them.
_WORD_LEVEL = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]})
#: Byte-level vocabularies write bytes as visible characters: those that are visible in Latin-1 as themselves, the others from U+0100 on.
_SEEN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_VISIBLE = {b: b if b in _SEEN else 256 + sum(x not in _SEEN for x in range(b)) for b in range(256)}
_workers: dict[str, _Encoder] = {}


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data): two control bits per value say how many bytes of it are in ``data``, least first."""
    v = np.ascontiguousarray(values, "<u4")
    extra = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    four = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    four[:len(v)] = extra
    four = four.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4)[None, :] <= extra[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values of ``pack``."""
    length = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(length, dtype=np.int64) - length
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[at].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(length > k)
        if not len(more):
            break
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


class _Encoder:
    """Ids of whole texts from ids of the chunks between white space, which the tokenizer never joins.

    Where the tokenizer lower-cases words of letters and parts them from punctuation, chunks of plain
    letters with marks behind them are looked up by their letters: those are far fewer, and the merges alone
    run on them.
    """

    def __init__(self, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.kept = Tokenizer.from_str(model.decode()), {}
        spec = json.loads(model)
        self.bare = Tokenizer(self.tokenizer.model) if (spec["normalizer"], spec["pre_tokenizer"]) == _WORD_LEVEL else None
        if self.bare:
            self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.point = self._ids(self.tokenizer, ["."])[0]

    @staticmethod
    def of(model: bytes) -> _Encoder:
        """One for each worker process and tokenizer."""
        name = hashlib.sha256(model).hexdigest()
        if name not in _workers:
            _workers[name] = _Encoder(model)
        return _workers[name]

    @staticmethod
    def _ids(tokenizer, chunks: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for i in range(0, len(chunks), 50_000) for e in tokenizer.encode_batch_fast(chunks[i:i + 50_000], add_special_tokens=False)]

    def _word_ids(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters, many in one call with a point behind each, which tells them apart again."""
        words, point, found = [w if w.isascii() else w.encode().decode("latin-1").translate(_VISIBLE) for w in words], self.point, []
        if len(point) != 4:
            return self._ids(self.bare, words)
        lines = [" . ".join(words[i:i + 500]) + " ." for i in range(0, len(words), 500)]
        for i in range(0, len(lines), 100):
            for e in self.bare.encode_batch_fast(lines[i:i + 100], add_special_tokens=False):
                ids, at = array("I", e.ids), 0
                data = ids.tobytes()
                for end in (np.flatnonzero(np.frombuffer(ids, "<u4") == int.from_bytes(point, "little")) * 4).tolist():
                    found.append(data[at:end])
                    at = end + 4
        return found

    def _learn(self, chunks: list[str]) -> None:
        """Ids of words in lower case, which the merges alone give, and of other chunks."""
        words, other = [], []
        for c in chunks:
            (words if self.bare and c.isalpha() and (c.isascii() or max(c) < "\u0100") and c.islower() else other).append(c)
        self.kept.update(zip(words, self._word_ids(words)))
        self.kept.update(zip(other, self._ids(self.tokenizer, other)))

    def _chunk_ids(self, chunks: pa.Array) -> pa.Array:
        """Ids (large binary) of distinct chunks. Words of letters, with marks behind them or not, are told apart by Arrow."""
        plain = pc.extract_regex(chunks, _PLAIN) if self.bare else pa.nulls(len(chunks), pa.struct([("word", pa.string()), ("mark", pa.string())]))
        is_plain = plain.is_valid().to_numpy(zero_copy_only=False)
        word, mark = plain.filter(plain.is_valid()).flatten()
        word, mark = pc.utf8_lower(word).dictionary_encode(), mark.dictionary_encode()
        # by NumPy, which makes the strings of a whole array in one go
        found = [c.to_numpy(zero_copy_only=False).tolist() for c in (word.dictionary, mark.dictionary, chunks.filter(plain.is_null()))]
        kept, (words, *others) = self.kept, found
        self._learn([c for c in chain(words, dict.fromkeys(chain(*others))) if c not in kept])
        word_ids, mark_ids, other = (pa.array([kept[c] for c in some], pa.large_binary()) for some in found)
        ids = pa.concat_arrays([pc.binary_join_element_wise(word_ids.take(word.indices), mark_ids.take(mark.indices), pa.scalar(b"", pa.large_binary())), other])
        place = np.empty(len(chunks), np.int64)
        place[is_plain], place[~is_plain] = np.arange(len(word)), np.arange(len(word), len(chunks))
        return ids.take(pa.array(place))

    def __call__(self, texts: pa.Array, end: bytes) -> list[bytes]:
        """Chunks are told apart and numbered by Arrow, so that Python meets each distinct one of a batch once."""
        if len(self.kept) > KEPT:
            self.kept.clear()
        data = texts.buffers()[2]
        raw = data.to_pybytes() if data else b""
        odd = any(c in raw for c in _CONTROL)
        split = pc.split_pattern_regex(texts, _SPACE) if odd else pc.utf8_split_whitespace(texts)
        numbered = split.flatten().dictionary_encode()
        self.kept[""] = b""  # before and after white space at the ends of a text
        ids = self._chunk_ids(numbered.dictionary).take(numbered.indices)
        if not len(ids):
            return [end] * len(texts)
        # one behind the other: a text's ids are those of its chunks
        at = np.frombuffer(ids.buffers()[1], "<i8")[:len(ids) + 1]
        bounds = at[np.concatenate([[0], np.cumsum(split.value_lengths().to_numpy(zero_copy_only=False))])].tolist()
        data = memoryview(ids.buffers()[2]) if ids.buffers()[2] else b""
        return [b"".join((data[a:b], end)) for a, b in zip(bounds, bounds[1:])]


def token_ids(docs: DataFrame, model_path: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids) with ids as little-endian 32-bit integers, ``end_id`` last."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(read_bytes(model_path))
    rows = texts(docs, doc_id, text)
    schema = to_arrow_schema(StructType().add("doc_id", rows.schema["doc_id"].dataType).add("ids", "binary"))

    def encoded(parts):
        encode, end = _Encoder.of(model.value), int(end_id).to_bytes(4, "little")
        for part in parts:
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(encode(part.column("text"), end), pa.binary())], schema=schema)

    return rows.mapInArrow(encoded, from_arrow_schema(schema))


def frequency_order(coded: DataFrame) -> np.ndarray:
    """All ids that occur, the most frequent first, equal ones by id: at most as many as the vocabulary has."""

    def counted(parts):
        total = np.zeros(0, np.int64)
        for part in parts:
            n = np.bincount(np.frombuffer(b"".join(part.column("ids").to_pylist()), "<u4"))
            if len(n) > len(total):
                total = np.concatenate([total, np.zeros(len(n) - len(total), np.int64)])
            total[:len(n)] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])

    counts = coded.select("ids").mapInArrow(counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return np.array([r[0] for r in counts.orderBy(F.desc("n"), "id").collect()], np.uint32)


def write_tokens(docs: DataFrame, path: str, model_path: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the token ids of every row of ``docs``, each text's followed by ``end_id``, in ascending doc_id order.

    ``path`` gets two tables. ``segments``: shard, number (segments in order), first (ids before it in
    its shard), tokens, doc_ids, sizes (ids of each document), control and data (the values of ``pack``);
    the values are places in ``order``, a one-row table of all ids by falling frequency.

    Null and empty texts have the end id alone. Rows that repeat are written as often as they occur,
    equal ids in no defined order; null ids come first. Other columns are ignored. An empty table gives
    files without segments.
    """
    spark = docs.sparkSession
    coded = stored(token_ids(docs, model_path, end_id, doc_id, text), "token-ids")
    order = frequency_order(coded)
    place = np.zeros(int(order.max()) + 1 if len(order) else 0, np.uint32)
    place[order] = np.arange(len(order), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(place)
    key = coded.schema["doc_id"].dataType
    schema = to_arrow_schema(StructType().add("shard", "integer").add("number", "integer").add("first", "long").add("tokens", "long")
                             .add("doc_ids", ArrayType(key)).add("sizes", ArrayType(IntegerType())).add("control", "binary").add("data", "binary"))

    moved = to_arrow_schema(StructType().add("doc_id", key).add("places", "binary"))
    kind = "<u2" if len(order) <= 1 << 16 else "<u4"  # two bytes an id travel where they are enough

    def ranked(parts):
        for part in parts:
            ids = part.column("ids").to_pylist()
            places = shared.value[np.frombuffer(b"".join(ids), "<u4")].astype(kind)
            ends = np.cumsum([len(i) // 4 for i in ids]).tolist()
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([places[a:b].tobytes() for a, b in zip([0, *ends], ends)], pa.binary())], schema=moved)

    def segments(parts):
        shard, number, first, keys, held, size = TaskContext.get().partitionId(), 0, 0, [], [], 0

        def segment():
            control, data = pack(np.concatenate(held))
            row = [[shard], [number], [first], [size], [keys], [[len(h) for h in held]], [control], [data]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, schema)], schema=schema)

        for part in parts:
            for k, places in zip(*(c.to_pylist() for c in part.columns)):
                keys.append(k)
                held.append(np.frombuffer(places, kind))
                size += len(held[-1])
                if size >= SEGMENT:
                    yield segment()
                    number, first, keys, held, size = number + 1, first + size, [], [], 0
        if held:
            yield segment()

    ordered = coded.mapInArrow(ranked, from_arrow_schema(moved)).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(segments, from_arrow_schema(schema)).write.parquet(f"{path}/segments")
    spark.createDataFrame([(order.astype("<u4").tobytes(),)], "ids binary").write.parquet(f"{path}/order")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of every document in a token file; ``start`` counts the ids of all documents before it."""
    segments = spark.read.parquet(f"{path}/segments")
    order = spark.sparkContext.broadcast(np.frombuffer(bytes(spark.read.parquet(f"{path}/order").first()[0]), "<u4"))
    # a row for each shard, of which there are as many as tasks wrote
    sizes = sorted(segments.groupBy("shard").agg(F.sum("tokens")).collect())
    before = dict(zip((s for s, _ in sizes), np.cumsum([0, *(n for _, n in sizes)]).tolist()))
    key = segments.schema["doc_ids"].dataType.elementType
    schema = to_arrow_schema(StructType().add("doc_id", key).add("start", "long").add("ids", "binary"))

    def documents(parts):
        for part in parts:
            for shard, first, tokens, keys, sizes, control, data in zip(*(part.column(c).to_pylist() for c in ("shard", "first", "tokens", "doc_ids", "sizes", "control", "data"))):
                ids = order.value[unpack(control, data, tokens)].astype("<u4")
                ends = np.cumsum(sizes)
                starts = ends - sizes
                yield pa.RecordBatch.from_arrays([pa.array(keys, schema.field("doc_id").type), pa.array(starts + before[shard] + first, pa.int64()),
                                                  pa.array([ids[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())], schema=schema)

    return segments.mapInArrow(documents, from_arrow_schema(schema))


def token_file(docs: DataFrame, model_path: str, end_id: int = 1, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write a token file below the shared folder (or at ``path``) and read it back; rows and edge cases as in ``write_tokens``."""
    path = path or fresh_path(docs.sparkSession, "token-file")
    write_tokens(docs, path, model_path, end_id, doc_id, text)
    return read_tokens(docs.sparkSession, path)


def digests(read: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of documents read from a token file."""
    return read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").cast("long").alias("ids_crc32"))
