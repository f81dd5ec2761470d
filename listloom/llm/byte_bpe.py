"""Byte-level BPE: ranked merges folded over the bytes of distinct words, texts put together from them."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

from listloom.llm.common import read_bytes, short_plan_texts, small_batches, texts

#: Words of more bytes are merged by a queue where they stand: folding arrays takes time with their square.
LONG = 256
#: Bytes of text whose words are looked up together.
BLOCK = 16 << 20
#: Texts, about, in which the words are counted that go to every task; and how many such words at most.
SAMPLE, FREQUENT = 4000, 40_000
_NONE = 2**31 - 1
#: A prime: pairs of ids are spread over this many small maps, as a lookup in a map takes time with its
#: size; more of them would make the plan's text, which the driver keeps, longer than its data.
_MAPS = 16381
#: Bytes of text that travel together, compressed.
_TOGETHER = 2 << 20
#: Bytes of text that are put together at once.
_AT_ONCE = 4 << 20
_KINDS = {"smallint": "<i2", "int": "<i4"}


class Ranks:
    """A rank file: lines of a base64 piece and its rank, which is its id."""

    def __init__(self, data: bytes):
        self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
        self.size = max(self.rank.values()) + 1
        if missing := [b for b in range(256) if bytes([b]) not in self.rank]:
            raise ValueError(f"bytes without a rank: {missing[:5]}")

    def pieces(self) -> list[bytes]:
        out = [b""] * self.size
        for piece, rank in self.rank.items():
            out[rank] = piece
        return out

    def whole(self) -> dict[str, bytes]:
        """Words that are pieces, with their id as little-endian bytes."""
        out = {}
        for piece, rank in self.rank.items():
            try:
                out[piece.decode()] = rank.to_bytes(4, "little")
            except UnicodeDecodeError:
                continue
        return out

    def pair_maps(self) -> str:
        """JSON of _MAPS maps from a pair of ids (left * size + right) to the rank of the two together."""
        maps = [""] * _MAPS
        for piece, rank in self.rank.items():
            for i in range(1, len(piece)):
                a, b = self.rank.get(piece[:i]), self.rank.get(piece[i:])
                if a is not None and b is not None:
                    key = a * self.size + b
                    maps[key % _MAPS] += f'{"," * bool(maps[key % _MAPS])}"{key}":{rank}'
        return f"[{','.join(f'{{{m}}}' for m in maps)}]"

    def merged(self, word: bytes) -> bytes:
        """Ids of one word as little-endian bytes, by a queue of pairs in rank order."""
        if (rank := self.rank.get(word)) is not None:
            return rank.to_bytes(4, "little")
        left, right = list(range(-1, len(word) - 1)), list(range(1, len(word) + 1))
        part: list[bytes | None] = [word[i:i + 1] for i in range(len(word))]
        queue = [(r, i, word[i:i + 2]) for i in range(len(word) - 1) if (r := self.rank.get(word[i:i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, both = heapq.heappop(queue)
            if part[i] is None or (j := right[i]) >= len(word) or part[i] + part[j] != both:
                continue  # one of the two has been merged since
            part[i], part[j] = both, None
            right[i] = right[j]
            if right[j] < len(word):
                left[right[j]] = i
            for a in (left[i], i):
                if a >= 0 and right[a] < len(word) and (r := self.rank.get(pair := part[a] + part[right[a]])) is not None:
                    heapq.heappush(queue, (r, a, pair))
        return np.array([self.rank[p] for p in part if p is not None], "<u4").tobytes()


def folded(word: Column, ranks: Ranks, pair_maps: str) -> Column:
    """Ids of a word (array of int) by higher-order functions: of all neighbours the pair of the least rank,
    the leftmost of several, becomes one piece, until no pair has a rank.
    """
    byte = F.array(*(F.lit(ranks.rank[bytes([b])]) for b in range(256)))
    ids = F.transform(F.split(F.decode(word.cast("binary"), "ISO-8859-1"), ""), lambda c: F.element_at(byte, F.ascii(c) + 1))
    maps = F.from_json(F.lit(pair_maps), "array<map<string,int>>").cast("array<map<bigint,int>>")

    def merge(maps: Column, start: Column) -> Column:
        def rank(a: Column, b: Column) -> Column:
            key = a.cast("long") * ranks.size + b  # null at the last place, which has no right neighbour
            return F.coalesce(F.try_element_at(F.element_at(maps, (key % _MAPS).cast("int") + 1), key), F.lit(_NONE))

        def joined(p: Column, pairs: Column) -> Column:
            least = F.array_min(pairs)
            at = F.array_position(pairs, least).cast("int")
            return F.when(least == _NONE, p).otherwise(F.concat(F.slice(p, 1, at - 1), F.array(least), F.slice(p, at + 2, F.size(p))))

        def step(p: Column, _: Column) -> Column:
            pairs = F.zip_with(p, F.slice(p, 2, F.size(p)), rank)
            return F.element_at(F.transform(F.array(pairs), lambda r: joined(p, r)), 1)

        return F.aggregate(F.sequence(F.lit(2), F.size(start)), start, step)

    # bound once, so that the plan names the literal a single time
    many = F.element_at(F.transform(F.array(maps), lambda m: merge(m, ids)), 1)
    return F.when(F.octet_length(word) < 2, ids).otherwise(many)


def _decoded(ids: list[bytes | None], pieces: pa.Array) -> list[bytes | None]:
    """The bytes of each text's ids, taken from ``pieces`` for all texts at once; null stays null."""
    taken = pieces.take(pa.array(np.frombuffer(b"".join(filter(None, ids)), "<u4")))
    if not len(taken):
        return [None if i is None else b"" for i in ids]
    places = np.cumsum([0, *(len(i or b"") // 4 for i in ids)])
    at, data = np.frombuffer(taken.buffers()[1], "<i8")[places].tolist(), memoryview(taken.buffers()[2])
    return [None if i is None else data[a:b].tobytes() for i, a, b in zip(ids, at, at[1:])]


def _joined(values: pa.Array, bounds: np.ndarray) -> pa.Array:
    """Values (large binary) one behind the other, cut anew: what stands between each bound and the next."""
    if not len(values) or not values.buffers()[2]:
        return pa.array([b""] * (len(bounds) - 1), pa.large_binary())
    at = np.frombuffer(values.buffers()[1], "<i8")[values.offset:values.offset + len(values) + 1][bounds]
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(at.tobytes()), values.buffers()[2]])


class _Cut:
    """Texts as chunks between single spaces and line ends, numbered by Arrow; Python meets each distinct one that is not plain once.

    A space between two characters that are not white space always starts a match of the pattern, so a text
    can be cut there; at a line end too, where the pattern makes it a match of its own. Letters alone are one
    word, with a space before them or not, and a mark of punctuation starts another. Texts with other white
    space are taken apart whole.
    """

    def __init__(self, texts: pa.Array, find: Callable[[str], list[str]]):
        lines = find("a.\nb c\nd") == ["a", ".", "\n", "b", " c", "\n", "d"]
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " \n") if lines else texts, " ")
        coded = cut.flatten().dictionary_encode()
        self.places, lengths = coded.indices.to_numpy(), cut.value_lengths().to_numpy()
        self.bounds = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        chunks, starts = coded.dictionary, self.bounds[:-1]
        self.n_chunks = len(chunks)
        parts = pc.extract_regex(chunks, rf"^(?P<end>{chr(92) + 'n?' if lines else ''})(?P<word>\pL+)(?P<mark>[.,;:!?]?)$")
        met = np.zeros(len(chunks), bool)
        met[np.delete(self.places, starts)] = True  # what only starts texts has no space before it
        plain = parts.is_valid().to_numpy(zero_copy_only=False)
        self.plain, self.other = np.flatnonzero(plain & met), np.flatnonzero(~plain & met)
        self.end, word, self.mark = parts.take(pa.array(self.plain)).flatten()

        def apart(chunk: str) -> list[str] | None:
            """The words of a chunk; None if it cannot stand alone."""
            after = lines and chunk.startswith("\n")
            body = chunk[after:]
            if not body or body[0].isspace() or body[-1].isspace():
                return None
            return ["\n", *find(body)] if after else find(" " + body)

        lists = [apart(c) for c in chunks.take(pa.array(self.other)).to_pylist()]
        alone = np.ones(len(chunks), bool)
        alone[self.other] = [words is not None for words in lists]
        firsts = chunks.take(pa.array(self.places[starts])).to_pylist()
        held = alone[self.places]
        held[starts] = [n == 1 or bool(f) and not f[-1].isspace() for n, f in zip(lengths.tolist(), firsts)]
        self.tidy = np.logical_and.reduceat(held, starts) if len(starts) else held
        heads = [find(f if tidy else texts[i].as_py()) for i, (f, tidy) in enumerate(zip(firsts, self.tidy.tolist()))]
        lists = [words or [] for words in lists] + heads
        self.list_bounds = np.cumsum([0, *map(len, lists)])
        before = pc.if_else(pc.equal(self.end, ""), " ", "")
        #: of plain chunks, of other ones, and of the starts of texts
        self.words = pa.concat_arrays([pc.binary_join_element_wise(before, word, ""), pa.array([w for words in lists for w in words], pa.string())])

    def ids(self, known: pa.Array, values: pa.Array, merged: Callable[[bytes], bytes]) -> pa.Array:
        """Each text's ids (large binary), from ``known`` words with theirs; other words are merged on the spot."""
        at = pc.index_in(self.words, value_set=known)
        if at.null_count:
            absent = self.words.filter(at.is_null()).unique()
            known = pa.concat_arrays([known, absent])
            values = pa.concat_arrays([values, pa.array([merged(w.encode()) for w in absent.to_pylist()], pa.large_binary())])
            at = pc.index_in(self.words, value_set=known)
        ids, n = values.take(at), len(self.plain)
        marks = pa.array(["", "\n", *".,;:!?"])
        mark_ids = pa.array([merged(m.encode()) if m else b"" for m in marks.to_pylist()], pa.large_binary())
        end, mark = (mark_ids.take(pc.index_in(c, value_set=marks)) for c in (self.end, self.mark))
        chunk_ids = pa.concat_arrays([pc.binary_join_element_wise(end, ids[:n], mark, pa.scalar(b"", pa.large_binary())),
                                      _joined(ids[n:], self.list_bounds), pa.array([b""], pa.large_binary())])
        number = np.zeros(self.n_chunks, np.int64)
        number[self.plain], number[self.other] = np.arange(n), n + np.arange(len(self.other))
        places = number[self.places]
        places[~np.repeat(self.tidy, np.diff(self.bounds))] = len(chunk_ids) - 1
        places[self.bounds[:-1]] = n + len(self.other) + np.arange(len(self.tidy))
        return _joined(chunk_ids.take(pa.array(places)), self.bounds)


def _in_blocks(words: pa.Table, kind: str) -> Iterator[tuple[int, int, int, bytes]]:
    """Words (word, blocks, ids) together for each block: its number, how many, bytes, and the compressed
    lengths of words and of their ids, ids, and letters.
    """
    words, codec = words.combine_chunks(), pa.Codec("zstd", 3)
    word, blocks, ids = (words.column(c).chunk(0) for c in ("word", "blocks", "ids"))
    numbers = blocks.flatten().to_numpy()
    order = np.argsort(numbers, kind="stable")
    of = pc.list_parent_indices(blocks).take(pa.array(order))
    word, ids, numbers = word.take(of).cast(pa.large_binary()), ids.take(of), numbers[order]
    lengths, counts = (c.to_numpy().astype("<u2") for c in (pc.binary_length(word), ids.value_lengths()))
    values, letters = ids.flatten().to_numpy().astype(kind), memoryview(word.buffers()[2] or b"")
    word_at, id_at = (np.concatenate([[0], np.cumsum(c, dtype=np.int64)]) for c in (lengths, counts))
    cuts = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)]
    for a, b in zip(cuts, cuts[1:]):
        data = b"".join((lengths[a:b].tobytes(), counts[a:b].tobytes(), values[id_at[a]:id_at[b]].tobytes(), letters[word_at[a]:word_at[b]]))
        yield int(numbers[a]), b - a, len(data), codec.compress(data, asbytes=True)


def _of_block(n: int, size: int, data: bytes, kind: str, shift: int) -> tuple[pa.Array, pa.Array]:
    """The words of ``_in_blocks``, and their ids as little-endian bytes (large binary)."""
    raw = pa.Codec("zstd").decompress(data, size, asbytes=True)
    lengths, counts = np.frombuffer(raw, "<u2", 2 * n).astype(np.int64).reshape(2, n)
    values = np.frombuffer(raw, kind, int(counts.sum()), 4 * n)
    word_at, id_at = (np.concatenate([[0], np.cumsum(c)]) for c in (lengths, counts))
    letters = raw[4 * n + values.nbytes:]
    word = pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(word_at.astype("<i4").tobytes()), pa.py_buffer(letters)])
    data = (values.astype("<i4") + shift).astype("<u4").tobytes()
    return word, pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer((id_at * 4).astype("<i8").tobytes()), pa.py_buffer(data)])


def _blocks(parts) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Batches of a partition in blocks of about BLOCK bytes, each with a number of its own.

    ``part`` is the partition of the input. A task's own number will not do: below a union it counts the other side's tasks too.
    """
    number, held, size = None, [], 0
    for part in parts:
        if not len(part):
            continue
        if number is None:
            number = part.column("part")[0].as_py() << 33
        held.append(part)
        size += part.column("text").nbytes
        if size >= BLOCK:
            yield number, held
            number, held, size = number + 1, [], 0
    if held:
        yield number, held


def encode(docs: DataFrame, rank_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids, decoded for every row of ``docs``: ids as little-endian unsigned 32-bit
    integers in one binary, and the bytes that decoding these ids gives.

    Each match of ``pattern`` is encoded by itself. Words that are pieces, and frequent words, are known to
    every task; the others of each block of texts are shuffled by word, folded once, and shuffled back to
    the block, where texts are put together.

    Null and empty texts have no tokens. Rows that repeat give a row each; a null id stays null. Other
    columns are ignored, whatever their names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    short_plan_texts(spark)
    ranks = Ranks(read_bytes(rank_path))
    rows = texts(docs, doc_id, text).withColumn("part", F.spark_partition_id())
    shared_ranks = spark.sparkContext.broadcast(ranks)
    whole, pair_maps = ranks.whole(), ranks.pair_maps()
    known_ids = whole | _frequent(rows, ranks, pattern, whole, pair_maps)
    frequent = spark.sparkContext.broadcast((pa.array(known_ids.keys(), pa.string()), pa.array(known_ids.values(), pa.large_binary())))

    # two bytes an id where they are enough
    shift, kind = (32768, "smallint") if ranks.size <= 65536 else (0, "int")
    small = F.transform(folded(F.col("word"), ranks, pair_maps), lambda i: (i - shift).cast(kind))
    met = _met(rows, frequent, pattern, small, _KINDS[kind])
    schema = to_arrow_schema(StructType().add("doc_id", rows.schema["doc_id"].dataType).add("n_tokens", "long").add("ids", "binary").add("decoded", "binary"))

    def put_together(parts):
        import regex

        find, ranks, now, given, held = regex.compile(pattern).findall, shared_ranks.value, None, [], []
        pieces = pa.array(ranks.pieces(), pa.large_binary())

        def finished():
            known, values = (pa.concat_arrays(a) for a in zip(frequent.value, *given))
            some, size = [], 0
            for i, batch in enumerate(held):
                some.append(batch)
                size += batch.nbytes
                if size >= _AT_ONCE or i == len(held) - 1:
                    yield from encoded(some, known, values)
                    some, size = [], 0

        def encoded(some, known, values):
            texts = pa.Table.from_batches(some).combine_chunks()
            ids = _Cut(texts.column("text").chunk(0), find).ids(known, values, ranks.merged)
            at = np.frombuffer(ids.buffers()[1], "<i8") // 4
            taken = pieces.take(pa.array(np.frombuffer(ids.buffers()[2] or b"", "<u4")[:at[-1]]))
            whole = [texts.column("doc_id").chunk(0).cast(schema.field("doc_id").type), pa.array(np.diff(at)), ids, _joined(taken, at)]
            start = 0
            for n in map(len, some):
                yield pa.RecordBatch.from_arrays([c.slice(start, n).cast(f.type) for c, f in zip(whole, schema)], schema=schema)
                start += n

        for part in parts:
            for block, n, size, data in zip(*(c.to_pylist() for c in part.columns)):
                if block != now:
                    if held:
                        yield from finished()
                    now, given, held = block, [], []
                if n:
                    given.append(_of_block(n, size, data, _KINDS[kind], shift))
                else:
                    held += [b for b in pa.ipc.open_stream(data) if len(b)]
        if held:
            yield from finished()

    return met.mapInArrow(put_together, from_arrow_schema(schema))


def _met(rows: DataFrame, frequent, pattern: str, ids: Column, kind: str) -> DataFrame:
    """(block, n, size, data), a block's rows together: its ``n`` words with their ids as in ``_in_blocks``, then, where n is 0, its texts."""

    def rare(parts):
        import regex

        find, known = regex.compile(pattern).findall, frequent.value[0]
        for number, held in _blocks(parts):
            words = pa.chunked_array([_Cut(part.column("text"), find).words.unique() for part in held]).unique()
            fresh = words.filter(pc.and_(pc.invert(pc.is_in(words, value_set=known)), pc.less_equal(pc.binary_length(words), LONG)))
            for i in range(0, len(fresh), 50_000):
                some = fresh[i:i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), number)), some], ["block", "word"])

    def packed(parts):
        for number, held in _blocks(parts):
            for part in held:
                rows_each = max(1, int(len(part) * _TOGETHER / max(1, part.nbytes)))
                for i in range(0, len(part), rows_each):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as out:
                        out.write_batch(part.slice(i, rows_each))
                    yield met_rows([(number, 0, 0, sink.getvalue().to_pybytes())])

    def met_rows(some):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["block", "n", "size", "data"])

    def in_blocks(parts):
        held, size = [], 0
        for part in parts:
            held.append(part)
            size += part.nbytes
            if size >= BLOCK:
                yield from gathered(held)
                held, size = [], 0
        yield from gathered(held)

    def gathered(held):
        if any(map(len, held)):
            found = _in_blocks(pa.Table.from_batches(held), kind)
            while some := list(islice(found, 100)):
                yield met_rows(some)

    # blocks of one word in lists of those of 16384 partitions at most, so that no list grows with the input
    words = (rows.mapInArrow(rare, "block long, word string")
             .groupBy("word", F.shiftright("block", 47).alias("range")).agg(F.collect_list("block").alias("blocks")))
    fields = "block long, n int, size int, data binary"
    return (words.select("word", "blocks", ids.alias("ids")).mapInArrow(in_blocks, fields).unionByName(rows.mapInArrow(packed, fields))
            .repartition("block").sortWithinPartitions("block", F.col("n") == 0))


def _frequent(rows: DataFrame, ranks: Ranks, pattern: str, whole: dict[str, bytes], pair_maps: str) -> dict[str, bytes]:
    """Words found more than twice in a sample of about SAMPLE texts, with their ids: at most FREQUENT.

    The sample decides which words travel, not what comes out: any word may be in it or not.
    """
    share = SAMPLE / max(1, rows.count())

    def found(parts):
        import regex

        for part in parts:
            counts = [w for t in part.column("text").to_pylist() for w in regex.findall(pattern, t)]
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array(counts, pa.string())], ["word"])

    sample = rows.select("text") if share >= 1 else rows.select("text").sample(fraction=share, seed=7)
    counts = (sample.mapInArrow(found, "word string").where(F.octet_length("word") <= LONG)
              .groupBy("word").count().where("count > 2").orderBy(F.desc("count"), "word").limit(FREQUENT).select("word"))
    some = counts.withColumn("ids", folded(F.col("word"), ranks, pair_maps)).toArrow()
    return {w: np.array(ids, "<u4").tobytes() for part in some.to_batches(5000) for w, ids in zip(part.column("word").to_pylist(), part.column("ids").to_pylist()) if w not in whole}


def decode(encoded: DataFrame, rank_path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of its ``ids`` (binary of little-endian 32-bit integers) as ``name``; null stays null."""
    pieces = encoded.sparkSession.sparkContext.broadcast(Ranks(read_bytes(rank_path)).pieces())
    base = encoded.drop(name)
    schema = to_arrow_schema(base.withColumn(name, F.lit(None).cast("binary")).schema)

    def back(parts):
        known = pa.array(pieces.value, pa.large_binary())
        for part in parts:
            values = _decoded(part.column(ids).to_pylist(), known)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values, pa.binary())], schema=pa.schema([*part.schema, schema.field(name)]))

    return base.mapInArrow(back, from_arrow_schema(schema))
