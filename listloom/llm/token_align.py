"""Cross-tokenizer alignment: fragments of byte ranges compose to the groups in which two tokenizers agree."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import ArrayType, StructType

from listloom.llm.common import frequent, read_bytes, small_batches, stored, texts
from listloom.llm.token_count import PieceCounter
from listloom.llm.token_file import _VISIBLE

#: Bytes of a range: longer texts are cut into ranges that are aligned in tasks of their own.
RANGE = 1 << 16
#: Fragments that one task composes in a round of the tree.
FAN = 8
#: Words whose tokens a worker keeps, texts it takes apart together, links it holds before it sums them up.
KEPT, SOME, LINKS = 300_000, 200, 2 << 20
#: White space never stands behind another character in a match of A's pattern but at its end, and no
#: piece of B holds a space behind another character, or a line break: both start anew here.
_ANEW = re.compile(r"(?<=\S)(?=[ \n])")
#: Fixed value: the pre-tokenizer that splits words by its own pattern and takes bytes as characters.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


@dataclass
class Fragment:
    """The tokens of A and B that start in one byte range of a text: an element of a monoid.

    ``ends`` are byte offsets in the whole text, ``both`` tells at which of them A and B end together.
    What lies before the first such place is the open prefix, what lies behind the last is the open
    suffix, and the groups between are closed: no neighbour can change them.
    """

    a: np.ndarray
    b: np.ndarray
    ends_a: np.ndarray
    ends_b: np.ndarray
    both_a: np.ndarray
    both_b: np.ndarray
    whole: bool = True  # the bytes of all tokens are those of the text

    @staticmethod
    def of(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, whole: bool = True) -> Fragment:
        return Fragment(a, b, ends_a, ends_b, *_common(ends_a, ends_b), whole)

    @staticmethod
    def empty() -> Fragment:
        none = np.zeros(0, np.int64)
        return Fragment.of(none, none, none, none)

    def suffix(self) -> tuple[int, int]:
        """Where the open suffix starts in A and in B."""
        return _after_last(self.both_a), _after_last(self.both_b)

    def prefix(self) -> tuple[int, int]:
        """Where the open prefix ends in A and in B, its common end included."""
        return _past_first(self.both_a), _past_first(self.both_b)

    def __add__(self, right: Fragment) -> Fragment:
        """This fragment and the one of the range behind it: closed groups stay, its open suffix meets the open prefix."""
        (la, lb), (ra, rb) = self.suffix(), right.prefix()
        open_a, open_b = _common(np.concatenate([self.ends_a[la:], right.ends_a[:ra]]), np.concatenate([self.ends_b[lb:], right.ends_b[:rb]]))
        return Fragment(*(np.concatenate(pair) for pair in ((self.a, right.a), (self.b, right.b), (self.ends_a, right.ends_a), (self.ends_b, right.ends_b))),
                        np.concatenate([self.both_a[:la], open_a, right.both_a[ra:]]), np.concatenate([self.both_b[:lb], open_b, right.both_b[rb:]]),
                        self.whole and right.whole)

    def links(self, ids_b: int) -> np.ndarray:
        """A code (id of A times ``ids_b``, plus id of B) for each pair of tokens whose byte ranges overlap, in text order."""
        last = np.searchsorted(self.ends_b, self.ends_a)
        first = np.concatenate([[0], (last + self.both_a)[:-1]])[:len(last)]
        n = last - first + 1
        places = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first, n)
        return np.repeat(self.a.astype(np.int64), n) * ids_b + self.b[places]


def _common(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of two ascending arrays, which values of either are in the other."""
    in_x, in_y = np.zeros(len(x), bool), np.zeros(len(y), bool)
    if len(x) and len(y):
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        in_x = y[at] == x
        in_y[at[in_x]] = True
    return in_x, in_y


def _after_last(marks: np.ndarray) -> int:
    return len(marks) - int(marks[::-1].argmax()) if marks.any() else 0


def _past_first(marks: np.ndarray) -> int:
    return int(marks.argmax()) + 1 if marks.any() else len(marks)


def _encoder(model: bytes, pieces: dict[bytes, int], merged: list[int]) -> Callable[[str], list[int]]:
    """What encodes a word by A. Where ids follow the order of merges, the least id is the next merge, and no
    offsets are needed, so the words' bytes are merged by rank; else the model's own library does it.
    """
    if merged == sorted(merged) and len(pieces) == len(merged) + 256:
        import public_tokenizers
        import tiktoken

        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pieces, special_tokens={}).encode_ordinary
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_str(model.decode())
    own.encode_special_tokens = True
    return lambda word: own.encode(word, add_special_tokens=False).ids


class Tokenizers:
    """Tokens of A and B word by word, where a word starts wherever both start anew; each distinct word once."""

    def __init__(self, a: bytes, b: bytes):
        spec = json.loads(a)
        if spec["normalizer"] is not None or spec["pre_tokenizer"] != _BYTE_LEVEL or spec["model"]["type"] != "BPE":
            raise ValueError("A must be a byte-level BPE that splits words by its own pattern")
        self.b = PieceCounter(b).model
        vocabulary = spec["model"]["vocab"]
        byte = {chr(v): k for k, v in _VISIBLE.items()}
        pieces = {bytes(byte[c] for c in piece): i for piece, i in vocabulary.items()}
        self.encode_a = _encoder(a, pieces, [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]])
        special = [t["id"] for t in spec.get("added_tokens") or ()]
        self.lengths_a = np.zeros(max([*vocabulary.values(), *special]) + 1, np.int64)
        self.lengths_a[list(pieces.values())] = list(map(len, pieces))
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))]
        self.lengths_b = np.array([len(p) for p in self.bytes_b])
        self.space = self.b.piece_to_id("▁")
        self.known: dict[str | tuple[str], tuple[bytes, bytes]] = {}
        self.broken: set[str | tuple[str]] = set()

    def learn(self, texts: list[list[str | tuple[str]]]) -> None:
        """Take the words of some texts into the table. A gives the bytes of any word back, B need not."""
        if len(self.known) > KEPT:
            self.known.clear(), self.broken.clear()
        new = list({w for words in texts for w in words if w not in self.known})
        for i in range(0, len(new), 10_000):
            some = new[i:i + 10_000]
            full = list(map(_full, some))
            # encode() of B puts a space before its input; a line break never merges with it
            for w, f, ids_b in zip(some, full, self.b.encode([f[f[0] == " ":] for f in full], num_threads=1)):
                ids_b = ids_b[1:] if f[0] == "\n" else ids_b or [self.space]
                self.known[w] = array("I", self.encode_a(f)).tobytes(), array("I", ids_b).tobytes()
                if b"".join(map(self.bytes_b.__getitem__, ids_b)) != f.encode():
                    self.broken.add(w)

    def fragment(self, words: list[str | tuple[str]], at: int = 0, start: int = 0, end: int | None = None) -> Fragment:
        """The tokens of ``words``, which stand at byte ``at``, that start at ``start`` or behind, and before ``end``."""
        ids = [np.frombuffer(b"".join(side), "<u4") for side in (zip(*map(self.known.__getitem__, words)) if words else ((), ()))]
        ends = [at + np.cumsum(lengths[i]) for i, lengths in zip(ids, (self.lengths_a, self.lengths_b))]
        whole = self.broken.isdisjoint(words) if self.broken else True
        if at != start or end is not None:
            for n, (i, e) in enumerate(zip(ids, ends)):
                starts = np.concatenate([[at], e[:-1]])[:len(e)]
                keep = slice(*np.searchsorted(starts, [start, starts[-1] + 1 if end is None else end])) if len(e) else slice(0)
                ids[n], ends[n] = i[keep], e[keep]
        return Fragment.of(*ids, *ends, whole)


def _key(word: str) -> str | tuple[str]:
    """A word without the space it starts with; (word,) where that space stands before a line break."""
    return word if word[0] == "\n" else (word,) if word[1:2] == "\n" else word[1:]


def _full(key: str | tuple[str]) -> str:
    return key[0] if isinstance(key, tuple) else key if key[:1] == "\n" else " " + key


def words_of(text: str) -> list[str | tuple[str]]:
    """The keys (see ``_key``) of the words of a text with a space before it."""
    chunks = text.replace("\n", " \n").split(" ")
    if all(chunks) and not any(c[-1].isspace() or c[0].isspace() and (c[0] != "\n" or c[1].isspace()) for c in chunks) and text[:1] != "\n":
        return chunks
    return list(map(_key, _ANEW.split(" " + text)))


def ranges(text: bytes, size: int) -> list[tuple[int, int, int, int]]:
    """(start, end, from, to): byte ranges that cover ``text``, each with the stretch, from one place where words
    start to another, that its tokens are found in. Ranges last ``size`` bytes, more where no word starts for so long.
    """

    def starts(p: int) -> bool:
        return not text[max(0, p - 4):p].decode(errors="ignore")[-1:].isspace()

    def last(low: int, p: int) -> int | None:
        """The last place behind ``low``, up to ``p``, where a word starts."""
        while (p := max(text.rfind(b" ", low + 1, p + 1), text.rfind(b"\n", low + 1, p + 1))) > low:
            if starts(p):
                return p
            p -= 1
        return None

    def first(p: int) -> int:
        """The first place from ``p`` on where a word starts, or the end."""
        while True:
            found = [q for q in (text.find(b" ", p), text.find(b"\n", p)) if q >= 0]
            if not found:
                return len(text)
            if starts(min(found)):
                return min(found)
            p = min(found) + 1

    cuts = [(0, 0)]
    for p in range(size, len(text), size):
        if (low := last(cuts[-1][0], p)) is not None:
            cuts.append((p, low))
    ends = [p for p, _ in cuts[1:]] + [len(text)]
    return [(p, e, low, first(e)) for (p, low), e in zip(cuts, ends)]


def _kind(n: int) -> str:
    return "<u2" if n <= 1 << 16 else "<u4"


class _Rows:
    """Fragments as rows, with ids as wide as their vocabularies ask for."""

    def __init__(self, key, lengths_a: np.ndarray, lengths_b: np.ndarray):
        self.lengths = lengths_a, lengths_b
        self.kinds = tuple(_kind(len(x)) for x in self.lengths)
        self.schema = to_arrow_schema(StructType().add("row", "long").add("doc_id", key).add("part", "long").add("start_a", "long").add("start_b", "long")
                                      .add("a", "binary").add("b", "binary").add("both_a", "binary").add("both_b", "binary").add("whole", "boolean"))

    def write(self, rows: list, keys: list, parts: list, found: list[Fragment]) -> pa.RecordBatch:
        def start(ids, ends, lengths):
            return int(ends[0] - lengths[ids[0]]) if len(ids) else -1

        columns = [rows, keys, parts, [start(f.a, f.ends_a, self.lengths[0]) for f in found], [start(f.b, f.ends_b, self.lengths[1]) for f in found],
                   [f.a.astype(self.kinds[0]).tobytes() for f in found], [f.b.astype(self.kinds[1]).tobytes() for f in found],
                   [np.packbits(f.both_a).tobytes() for f in found], [np.packbits(f.both_b).tobytes() for f in found], [f.whole for f in found]]
        return pa.RecordBatch.from_arrays([pa.array(c, field.type) for c, field in zip(columns, self.schema)], schema=self.schema)

    def read(self, part: pa.RecordBatch | pa.Table) -> list[Fragment]:
        out = []
        for sa, sb, a, b, both_a, both_b, whole in zip(*(part.column(c).to_pylist() for c in ("start_a", "start_b", "a", "b", "both_a", "both_b", "whole"))):
            ids = [np.frombuffer(x, kind) for x, kind in zip((a, b), self.kinds)]
            ends = [s + np.cumsum(lengths[i]) for s, i, lengths in zip((sa, sb), ids, self.lengths)]
            marks = [np.unpackbits(np.frombuffer(m, np.uint8), count=len(i)).astype(bool) for m, i in zip((both_a, both_b), ids)]
            out.append(Fragment(*ids, *ends, *marks, whole))
        return out


@dataclass
class Aligned:
    """A stored table of aligned documents, and the tokenizers they were aligned by."""

    rows: DataFrame
    a_path: str
    b_path: str
    lengths_a: np.ndarray
    lengths_b: np.ndarray

    def _reader(self) -> _Rows:
        return _Rows(self.rows.schema["doc_id"].dataType, self.lengths_a, self.lengths_b)

    def groups(self) -> DataFrame:
        """row, doc_id, groups: ids of A, a bar, ids of B for each group, as text."""
        reader = self._reader()
        schema = to_arrow_schema(StructType().add("row", "long").add("doc_id", self.rows.schema["doc_id"].dataType).add("groups", "string"))

        def written(parts):
            table = [f"{i}{end}" for size, ends in ((len(reader.lengths[0]), ",|"), (len(reader.lengths[1]), ",;")) for i in range(size) for end in ends]
            for part in parts:
                some = ["".join(map(table.__getitem__, _in_groups(f, len(reader.lengths[0])).tolist()))[:-1] for f in reader.read(part)]
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), pa.array(some, pa.string())], schema=schema)

        return self.rows.mapInArrow(written, from_arrow_schema(schema))

    def pair_counts(self) -> DataFrame:
        """code, n: how many links of the whole table hold each pair of ids; code = id of A * ids of B + id of B."""
        reader = self._reader()

        def counted(parts):
            codes, n, held, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
            for part in parts:
                for f in reader.read(part):
                    held.append(f.links(len(reader.lengths[1])))
                    size += len(held[-1])
                    if size >= LINKS:
                        codes, n = _summed(codes, n, *np.unique(np.concatenate(held), return_counts=True))
                        held, size = [], 0
            if held:
                codes, n = _summed(codes, n, *np.unique(np.concatenate(held), return_counts=True))
            for i in range(0, len(codes), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(codes[i:i + 100_000]), pa.array(n[i:i + 100_000])], ["code", "n"])

        return self.rows.mapInArrow(counted, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))

    def sums(self, share: int = 1 << 20) -> DataFrame:
        """row, doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum of every document.

        Pairs that make up at least one in ``share`` of all links (at most ``share``, whatever the input) and the
        highest count of each id of B go to every task; the counts of other pairs come by a shuffle without hot keys.
        """
        spark, reader, ids_b = self.rows.sparkSession, self._reader(), len(self.lengths_b)
        counts = stored(self.pair_counts(), "pair-counts")
        best = np.zeros(ids_b, np.int64)
        # a row for each id of B
        for b, n in counts.groupBy((F.col("code") % ids_b).alias("b")).agg(F.max("n").alias("n")).collect():
            best[b] = n
        common = frequent(counts, "n", share).orderBy("code").toArrow()
        shared = spark.sparkContext.broadcast((common.column("code").to_numpy(), common.column("n").to_numpy(), best))
        schema = to_arrow_schema(StructType().add("row", "long").add("doc_id", self.rows.schema["doc_id"].dataType).add("n_a", "long").add("n_b", "long")
                                 .add("n_groups", "long").add("n_links", "long").add("n_best", "long").add("count_sum", "long")
                                 .add("rare", ArrayType(StructType().add("code", "long").add("n", "long").add("best", "long"))))

        def summed(parts):
            known, known_n, best = shared.value
            for part in parts:
                rows = []
                for f in reader.read(part):
                    codes = f.links(ids_b)
                    pairs, n = np.unique(codes, return_counts=True)
                    at = np.minimum(np.searchsorted(known, pairs), max(0, len(known) - 1))
                    found = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
                    counts, highest = known_n[at[found]], best[pairs % ids_b]
                    rows.append((len(f.a), len(f.b), int(f.both_a.sum()), len(codes), int(n[found][counts == highest[found]].sum()), int((n[found] * counts).sum()),
                                 [{"code": c, "n": m, "best": h} for c, m, h in zip(pairs[~found].tolist(), n[~found].tolist(), highest[~found].tolist())]))
                columns = zip(*rows) if rows else [[]] * 7
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), *(pa.array(c, field.type) for c, field in zip(columns, list(schema)[2:]))], schema=schema)

        known = stored(self.rows.mapInArrow(summed, from_arrow_schema(schema)), "link-sums")
        rare = known.select("row", F.explode("rare").alias("pair")).select("row", "pair.*").join(counts.withColumnRenamed("n", "count"), "code")
        more = rare.groupBy("row").agg(F.sum(F.when(F.col("count") == F.col("best"), F.col("n")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("count")).alias("more_sum"))
        return known.drop("rare").join(more, "row", "left").select(
            "row", "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
            (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"))


def _in_groups(f: Fragment, ids_a: int) -> np.ndarray:
    """A code for each token, in the order in which groups are written: twice the id, one more at the end of a
    group; those of B follow the codes of all ids of A.
    """
    group_a, group_b = np.cumsum(f.both_a) - f.both_a, np.cumsum(f.both_b) - f.both_b
    last_a, last_b = np.flatnonzero(f.both_a) + 1, np.flatnonzero(f.both_b) + 1
    out = np.empty(len(f.a) + len(f.b), np.int64)
    out[np.arange(len(f.a)) + np.concatenate([[0], last_b])[group_a]] = 2 * f.a.astype(np.int64) + f.both_a
    out[np.arange(len(f.b)) + last_a[group_b]] = 2 * (f.b.astype(np.int64) + ids_a) + f.both_b
    return out


def _summed(codes: np.ndarray, n: np.ndarray, more: np.ndarray, more_n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two ascending lists of codes with their counts as one."""
    at = np.searchsorted(codes, more)
    known = np.zeros(len(more), bool)
    if len(codes):
        known = codes[np.minimum(at, len(codes) - 1)] == more
    n = n.copy()
    n[at[known]] += more_n[known]
    return np.insert(codes, at[~known], more[~known]), np.insert(n, at[~known], more_n[~known])


def align(docs: DataFrame, a_path: str, b_path: str, size: int = RANGE, doc_id: str = "doc_id", text: str = "text") -> Aligned:
    """Align the tokens of a byte-level BPE (A, of a space and the text) with SentencePiece's (B) for every row of ``docs``.

    Texts of up to ``size`` bytes are one fragment. Longer ones are cut into byte ranges, whose fragments are found
    in tasks of their own and composed by a tree of FAN branches; so no task tokenises a whole long text, and the
    rounds grow with the logarithm of the longest.

    Null and empty texts, and those that either tokenizer's bytes do not give back, have no tokens. Rows that
    repeat give a row each (``row`` tells them apart); a null id stays null. Other columns are ignored, whatever
    their names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    models = spark.sparkContext.broadcast((read_bytes(a_path), read_bytes(b_path)))
    tokenizers = Tokenizers(*models.value)
    rows = texts(docs, doc_id, text).withColumn("row", F.monotonically_increasing_id())
    key = rows.schema["doc_id"].dataType
    form = _Rows(key, tokenizers.lengths_a, tokenizers.lengths_b)
    cut = to_arrow_schema(StructType().add("row", "long").add("doc_id", key).add("part", "long").add("start", "long").add("end", "long").add("at", "long").add("text", "string"))

    def short(parts):
        tokenizers = Tokenizers(*models.value)
        for whole in parts:
            for i in range(0, len(whole), SOME):
                part = whole.slice(i, SOME)
                found = [words_of(t) if t else [] for t in part.column("text").to_pylist()]
                tokenizers.learn(found)
                yield form.write(part.column("row"), part.column("doc_id"), [0] * len(part), [finished(tokenizers.fragment(w)) for w in found])

    def pieces(parts):
        for part in parts:
            for row, key, t in zip(*(part.column(c).to_pylist() for c in ("row", "doc_id", "text"))):
                whole = b" " + t.encode()
                for n, (start, end, at, to) in enumerate(ranges(whole, size)):
                    yield pa.RecordBatch.from_arrays([pa.array([v], field.type) for v, field in zip((row, key, n, start, end, at, whole[at:to].decode()), cut)], schema=cut)

    def long(parts):
        tokenizers = Tokenizers(*models.value)
        for part in parts:
            found = [list(map(_key, _ANEW.split(t))) for t in part.column("text").to_pylist()]
            tokenizers.learn(found)
            yield form.write(part.column("row"), part.column("doc_id"), part.column("part"),
                             [tokenizers.fragment(w, at, s, e) for w, s, e, at in zip(found, *(part.column(c).to_pylist() for c in ("start", "end", "at")))])

    def composed(table):
        table = table.sort_by("part")
        one = reduce(Fragment.__add__, form.read(table), Fragment.empty())
        return pa.Table.from_batches([form.write(table.column("row").slice(0, 1).combine_chunks(), table.column("doc_id").slice(0, 1).combine_chunks(), [table.column("part")[0].as_py() // FAN], [one])])

    def finished(f: Fragment) -> Fragment:
        return f if f.whole else Fragment.empty()

    few, many = F.octet_length("text") <= size, F.octet_length("text") > size
    schema = from_arrow_schema(form.schema)
    of_ranges = stored(rows.where(many).withColumn("row", -1 - F.col("row")).mapInArrow(pieces, from_arrow_schema(cut)).repartition("row", "part").mapInArrow(long, schema), "fragments")
    most = of_ranges.agg(F.max("part")).first()[0] or 0
    while most:
        of_ranges = of_ranges.groupBy("row", F.floor(F.col("part") / FAN)).applyInArrow(composed, schema)
        most //= FAN

    def complete(parts):
        for part in parts:
            yield form.write(part.column("row"), part.column("doc_id"), part.column("part"), list(map(finished, form.read(part))))

    every = rows.where(few).mapInArrow(short, schema).union(of_ranges.mapInArrow(complete, schema))
    return Aligned(stored(every, "aligned"), a_path, b_path, tokenizers.lengths_a, tokenizers.lengths_b)
