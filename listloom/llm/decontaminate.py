"""Benchmark decontamination: a suffix automaton of the test items follows the words of every document."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from listloom.llm.common import as_bytes, small_batches

#: Words are runs of digits, letters (A-Z lower-cased) and everything beyond ASCII; the rest parts them.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
WINDOW = 13
#: Test words in one automaton. A larger test set takes several, and a pass over the documents for each.
SHARD_WORDS = 200_000


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class Automaton:
    """Generalised suffix automaton over the words of many items.

    A state stands for word sequences that end at the same places; ``link`` leads to the longest suffix
    that ends at more places. ``items`` names the items in which a state's sequences occur.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window, self.vocabulary = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]) for name, ws in items if ws]
        for _, ids in coded:
            last = 0
            for w in ids:
                last = self._extend(last, w)
        self.items: list[set[str]] = [set() for _ in self.next]
        #: per state: (words, item) of the items shorter than a window that end there in full
        self.whole: list[list[tuple[int, str]]] = [[] for _ in self.next]
        for name, ids in coded:
            state = 0
            for w in ids:
                state = self.next[state][w]
                at = state
                while at > 0 and name not in self.items[at]:
                    self.items[at].add(name)
                    at = self.link[at]
            if len(ids) < window:
                while self.length[self.link[state]] >= len(ids):
                    state = self.link[state]
                self.whole[state].append((len(ids), name))
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            # what ends at a suffix ends here too
            self.whole[state] = self.whole[state] + self.whole[self.link[state]]

    def _new(self, length: int, link: int, nxt: dict[int, int]) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, state: int, w: int, target: int) -> int:
        """A copy of ``target`` for the sequences that are no longer than those through ``state``."""
        copy = self._new(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while state >= 0 and self.next[state].get(w) == target:
            self.next[state][w] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, w: int) -> int:
        target = self.next[last].get(w)
        if target is not None:  # an earlier item has been here
            return target if self.length[target] == self.length[last] + 1 else self._split(last, w, target)
        new, state = self._new(self.length[last] + 1, 0, {}), last
        while state >= 0 and w not in self.next[state]:
            self.next[state][w] = new
            state = self.link[state]
        if state >= 0:
            target = self.next[state][w]
            self.link[new] = target if self.length[target] == self.length[state] + 1 else self._split(state, w, target)
        return new

    def hits(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word spans [from, to) inside any occurrence of a window, and the items they come from."""
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        state = matched = 0
        nxt, link, length, whole, window = self.next, self.link, self.length, self.whole, self.window
        for i, w in enumerate(map(self.vocabulary.get, text)):
            if w is None:
                state = matched = 0
                continue
            to = nxt[state].get(w)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = nxt[state].get(w)
            if to is None:
                continue
            state, matched = to, matched + 1
            reach = 0
            if matched >= window:
                reach, at = window, state
                while length[link[at]] >= window:
                    at = link[at]
                found |= self.items[at]
            if whole[state]:
                for n, name in whole[state]:
                    if n <= matched:
                        reach = max(reach, n)
                        found.add(name)
            if reach:
                a = i + 1 - reach
                while spans and spans[-1][1] >= a:
                    a = min(a, spans.pop()[0])
                spans.append((a, i + 1))
        return spans, found


def _shards(items: DataFrame, item_id: str, text: str, window: int, shard_words: int) -> Iterator[Automaton]:
    """Automata over the test items, each of at most ``shard_words`` words and one item more."""
    held, size = [], 0
    for row in items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")), F.col(text)).toLocalIterator():
        ws = words((row[1] or "").encode())
        held.append((row[0], ws))
        size += len(ws)
        if size >= shard_words:
            yield Automaton(held, window)
            held, size = [], 0
    if held:
        yield Automaton(held, window)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _scan(docs: DataFrame, text: str, shared: Broadcast) -> DataFrame:
    """``docs`` with n_words, spans and items by one automaton."""
    small_batches(docs.sparkSession)
    fields = {n: t for n, t in (("n_words", "long"), ("spans", "array<struct<start:int,end:int>>"), ("items", "array<string>"))}
    out = docs.withColumns({n: F.lit(None).cast(t) for n, t in fields.items()}).schema
    arrow = to_arrow_schema(out)
    types = [arrow.field(n).type for n in fields]

    def scanned(parts):
        automaton = shared.value
        for part in parts:
            rows = []
            for t in as_bytes(part.column(text)):
                ws = words(t)
                spans, items = automaton.hits(ws)
                rows.append((len(ws), [{"start": a, "end": b} for a, b in spans], sorted(items)))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([*part.columns, *columns], schema=pa.schema([*part.schema, *(arrow.field(n) for n in fields)]))

    return docs.mapInArrow(scanned, from_arrow_schema(arrow))


def benchmark_hits(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                   item_text: str = "text", window: int = WINDOW, coverage: int = 20, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, text, n_words, n_hit, spans, items, contaminated for every row of ``docs``.

    A document word is hit inside any occurrence of ``window`` consecutive item words, or of a whole item
    of fewer words. ``spans`` are the hit word ranges [start, end), ``items`` the sorted ids of the items,
    ``contaminated`` says whether words are hit and make up at least one in ``coverage``.

    The test set is read through the driver in automata of at most ``shard_words`` words, each sent to
    every task; documents are mapped, not shuffled, unless the test set needs several automata.

    A null text has no words and is never hit; items without words never hit. Items that share an id count
    as one; a null id counts as the id "". Repeated rows give a row each. Other columns are ignored,
    whatever their names. An empty test set hits nothing; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    shards = [spark.sparkContext.broadcast(a) for a in _shards(items, item_id, item_text, window, shard_words)]
    if len(shards) < 2:
        found = _scan(rows, "text", shards[0] if shards else spark.sparkContext.broadcast(Automaton([], window)))
    else:
        mark = rows.withColumn("mark", F.xxhash64("text"))
        parts = None
        for shard in shards:
            one = _scan(mark, "text", shard).where(F.size("items") > 0).select("doc_id", "mark", "spans", "items")
            parts = one if parts is None else parts.union(one)
        merged = parts.groupBy("doc_id", "mark").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        join_spans = F.udf(lambda spans: _merged([tuple(s) for s in spans]), "array<struct<start:int,end:int>>")
        m = merged.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), join_spans("spans").alias("spans"), "items")
        counted = _scan(mark, "text", spark.sparkContext.broadcast(Automaton([], window))).drop("spans", "items")
        found = (counted.join(m, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("mark").eqNullSafe(F.col("m")), "left")
                 .select("doc_id", "text", "n_words", F.coalesce("spans", F.array()).alias("spans"), F.coalesce("items", F.array()).alias("items")))
    sized = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return (found.withColumn("n_hit", sized)
            .select("doc_id", "text", "n_words", "n_hit", "spans", "items", ((F.col("n_hit") > 0) & (F.col("n_hit") * coverage >= F.col("n_words"))).alias("contaminated")))


def keep_clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", coverage: int = 20, **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not contaminated by the rule of ``benchmark_hits``.

    Rows below the coverage limit stay as they are. Edge cases are those of ``benchmark_hits``; a row
    with a null text stays.
    """
    spark = docs.sparkSession
    shards = [spark.sparkContext.broadcast(a) for a in _shards(items, options.get("item_id", "item_id"), options.get("item_text", "text"), options.get("window", WINDOW), options.get("shard_words", SHARD_WORDS))]
    small_batches(spark)
    if len(shards) > 1:
        own_id, own_mark = (name + "_" * max(map(len, docs.columns)) for name in ("id", "mark"))  # names that no column has
        bad = (benchmark_hits(docs, items, doc_id, text, coverage=coverage, **options).where("contaminated")
               .select(F.col("doc_id").alias(own_id), F.xxhash64("text").alias(own_mark)).distinct())
        return docs.join(bad, F.col(doc_id).eqNullSafe(F.col(own_id)) & (F.xxhash64(text) == F.col(own_mark)), "left_anti")
    if not shards:
        return docs

    def kept(parts):
        automaton = shards[0].value
        for part in parts:
            keep = []
            for t in as_bytes(part.column(text)):
                ws = words(t)
                n = sum(b - a for a, b in automaton.hits(ws)[0])
                keep.append(not n or n * coverage < len(ws))
            yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """A text without the words of ``spans`` and what stands between them."""
    if not spans:
        return text
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, text[at:]])


def remove_spans(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``benchmark_hits`` with the hit passages cut out of ``text``; what lies outside of them stays as it is."""
    found = benchmark_hits(docs, items, **options)

    at = found.columns.index("text")

    def cut(parts):
        for part in parts:
            texts = [None if t is None else without_spans(t.encode(), [(s["start"], s["end"]) for s in spans]).decode()
                     for t, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist())]
            yield part.set_column(at, part.schema.field("text"), pa.array(texts, part.schema.field("text").type))

    return found.mapInArrow(cut, found.schema)
