"""Order MinHash: fingerprints of texts from minimal k-mers in text order, so that moved passages count as edits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

from listloom.llm.common import small_batches, stored, texts

#: Code points of a k-mer, k-mers of a tuple, tuples of a fingerprint.
K, TOGETHER, FUNCTIONS = 8, 2, 64
#: Bits of a text's place in a sort key; texts of more k-mers are sorted by an index.
_PLACE = 20
#: k-mers whose hashes under all functions are computed together.
_SLICE = 4096
_TIMES = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit values spread over all bits; different ones stay different."""
    for m in _MIX:
        x = (x ^ (x >> np.uint64(33))) * m
    return x ^ (x >> np.uint64(33))


class OrderMinHash:
    """Fingerprints of ``functions`` values of 16 bits.

    Every k-mer of a text is numbered by its occurrence. Each function orders the numbered k-mers by a hash of
    its own and takes the ``together`` least; these, in the order of the text, are hashed to one value. Texts of
    fewer than k code points are one k-mer, texts of fewer k-mers than a tuple asks for give shorter tuples.
    """

    def __init__(self, k: int = K, together: int = TOGETHER, functions: int = FUNCTIONS, seed: int = 13):
        self.k, self.together, self.functions = k, together, functions
        rng = np.random.default_rng(seed)
        self.turn = rng.integers(0, 1 << 32, (functions, 1), np.uint32)
        self.times = rng.integers(0, 1 << 31, (functions, 1), np.uint32) * np.uint32(2) + np.uint32(1)
        self.rows = np.arange(functions)
        self.space = np.empty(functions * _SLICE, np.uint32)

    def kmers(self, text: str) -> np.ndarray:
        """A 44-bit hash of the k-mer at each place."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        if not len(points):
            return points
        k, length, size, h, run, times = min(self.k, len(points)), 0, 1, None, points, _TIMES
        # hashes of runs of one, two, four, ... code points make those of k
        while True:
            if k & size:
                h = run if h is None else h[:len(h) - size] * times + run[length:]
                length += size
            if length == k:
                return _mixed(h) >> np.uint64(20)
            run = run[:-size] * times + run[size:]
            size, times = 2 * size, np.uint64(int(times) ** 2 % 2**64)

    def numbered(self, kmers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(k-mer, place, number of the k-mer's occurrence), in an order of no meaning."""
        n = len(kmers)
        if n <= 1 << _PLACE:
            keys = np.sort(kmers << np.uint64(_PLACE) | np.arange(n, dtype=np.uint64))
            sorted_, place = keys >> np.uint64(_PLACE), (keys & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
        else:
            place = np.argsort(kmers, kind="stable")
            sorted_ = kmers[place]
        first = np.ones(n, bool)
        first[1:] = sorted_[1:] != sorted_[:-1]
        starts = np.flatnonzero(first)
        return sorted_, place, (np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))).astype(np.uint64)

    def __call__(self, text: str) -> np.ndarray:
        kmer, place, number = self.numbered(self.kmers(text))
        base = (_mixed(kmer * _TIMES + number) >> np.uint64(32)).astype(np.uint32)
        least: list[np.ndarray] = []
        which: list[np.ndarray] = []
        for i in range(0, len(base), _SLICE):
            part = base[None, i:i + _SLICE]
            some = self.space[:self.functions * part.shape[1]].reshape(self.functions, -1)
            np.bitwise_xor(part, self.turn, out=some)
            np.multiply(some, self.times, out=some)
            for _ in range(min(self.together, part.shape[1])):
                at = some.argmin(1)
                least.append(some[self.rows, at])
                which.append(at + i)
                some[self.rows, at] = np.uint32(0xFFFFFFFF)
            if len(least) > 100 * self.together:
                least, which = self._best(least, which)
        if len(least) > self.together:
            least, which = self._best(least, which)
        chosen = np.array(which, np.int64).reshape(-1, self.functions)
        chosen = chosen[np.argsort(place[chosen], axis=0), self.rows]
        tuples = np.full(self.functions, len(chosen), np.uint64)
        for one in chosen:
            tuples = _mixed(tuples * np.uint64(31) + kmer[one])
        return (tuples >> np.uint64(48)).astype(np.uint16)

    def _best(self, least: list[np.ndarray], which: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The least values of each function, and whose they are; of equal ones the earlier."""
        values, places = np.array(least), np.array(which)
        order = np.argsort(values, axis=0, kind="stable")[:self.together]
        return list(values[order, self.rows]), list(places[order, self.rows])


def written(values: np.ndarray) -> str:
    """A fingerprint as text: four hexadecimal digits a value."""
    return values.astype(">u2").tobytes().hex()


def likeness(one: Column, other: Column) -> Column:
    """Share of the values in which two written fingerprints of equal length agree."""
    n = F.octet_length(one) / 4
    same = F.filter(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.substring(one, i * 4 + 1, F.lit(4)) == F.substring(other, i * 4 + 1, F.lit(4)))
    return F.size(same) / n


def fingerprints(docs: DataFrame, k: int = K, together: int = TOGETHER, functions: int = FUNCTIONS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fingerprint of every row of ``docs``, from whole texts.

    Null and empty texts have the fingerprint of no k-mers. Equal texts have equal fingerprints. Rows that repeat
    give a row each; a null id stays null. Other columns are ignored, whatever their names. An empty table gives an
    empty result.
    """
    small_batches(docs.sparkSession)
    rows = texts(docs, doc_id, text)
    schema = to_arrow_schema(StructType().add("doc_id", rows.schema["doc_id"].dataType).add("fingerprint", "string"))

    def found(parts):
        sketch = OrderMinHash(k, together, functions)
        for part in parts:
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([written(sketch(t)) for t in part.column("text").to_pylist()], pa.string())], schema=schema)

    return rows.mapInArrow(found, from_arrow_schema(schema))


def spliced(text: str, following: str) -> str:
    """A text whose last half (rounded down) is replaced by as many of the first code points of another, or all it has."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def edit_likeness(docs: DataFrame, k: int = K, together: int = TOGETHER, functions: int = FUNCTIONS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (binaries), near_edited, near_next of every row.

    The edited text is ``spliced`` with the next document's, by descending id; the first follows the last. Texts
    travel once, to ranges of ids; what stands at the ends of ranges meets by a join of two rows a range.

    Null and empty texts have no code points; two of them are alike (1.0). Of rows that share an id, the hash of
    the text decides which comes first, so a hot id may fill many ranges; null ids come last. A single row is its own
    next. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = texts(docs, doc_id, text).withColumn("tie", F.xxhash64("text"))
    order = (F.desc_nulls_last("doc_id"), F.col("tie"))
    key = rows.schema["doc_id"].dataType
    result = (StructType().add("doc_id", key).add("n_chars", "long").add("edited_sha256", "string").add("fingerprint", "binary")
              .add("edited_fingerprint", "binary").add("near_edited", "double").add("near_next", "double"))
    schema = to_arrow_schema(StructType([*result, *StructType().add("shard", "integer").add("edge", "string").add("text", "string")]))

    def pair(sketch: OrderMinHash, doc, t: str, prints: np.ndarray, following: str, next_prints: np.ndarray) -> tuple:
        edited = spliced(t, following)
        edited_prints = prints if edited == t else sketch(edited)
        return (doc, len(t), hashlib.sha256(edited.encode()).hexdigest(), prints.tobytes(), edited_prints.tobytes(),
                float((prints == edited_prints).mean()), float((prints == next_prints).mean()))

    def batch(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, field.type) for c, field in zip(zip(*found), schema)], schema=schema)

    def edge(shard: int, kind: str, doc, t: str, prints: np.ndarray) -> tuple:
        return doc, len(t), None, prints.tobytes(), None, None, None, shard, kind, t

    def paired(parts) -> Iterator[pa.RecordBatch]:
        sketch, shard, held = OrderMinHash(k, together, functions), TaskContext.get().partitionId(), None
        for part in parts:
            found = []
            for doc, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                prints = held[2] if held and t == held[1] else sketch(t)
                found.append((*pair(sketch, *held, t, prints), None, None, None) if held else edge(shard, "first", doc, t, prints))
                held = doc, t, prints
            if found:
                yield batch(found)
        if held:
            yield batch([edge(shard, "last", *held)])

    def joined(parts) -> Iterator[pa.RecordBatch]:
        sketch = OrderMinHash(k, together, functions)
        for part in parts:
            found = [(*pair(sketch, doc, t, np.frombuffer(prints, np.uint16), following, np.frombuffer(next_prints, np.uint16)), None, None, None)
                     for doc, t, prints, following, next_prints in zip(*(c.to_pylist() for c in part.columns))]
            if found:
                yield batch(found)

    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    done = stored(ordered.mapInArrow(paired, from_arrow_schema(schema)), "edit-likeness")
    # a number for each task that had rows
    shards = sorted(r[0] for r in done.where("edge = 'first'").select("shard").collect())
    after = spark.createDataFrame(list(zip(shards, shards[1:] + shards[:1])), "shard int, next int")
    first = done.where("edge = 'first'").select(F.col("shard").alias("next"), F.col("text").alias("following"), F.col("fingerprint").alias("next_prints"))
    last = done.where("edge = 'last'").select("shard", "doc_id", "text", "fingerprint")
    ends = last.join(after, "shard").join(first, "next").select("doc_id", "text", "fingerprint", "following", "next_prints")
    return done.where("edge is null").union(ends.mapInArrow(joined, from_arrow_schema(schema))).select(*result.names)
