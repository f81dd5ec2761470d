"""Near duplicates by SimHash: balls of half the radius around every fingerprint meet in the middle."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listloom.llm.common import as_bytes, small_batches, stored, texts
from listloom.operators.components import connected_components

BITS = 64
RADIUS = 3
#: Every view leaves out one of three blocks. Of three differing bits at least one falls into some
#: block, and at most two remain in the view without it: there, balls of radius one meet.
BLOCKS = ((0, 21), (21, 42), (42, 64))
#: A group of fingerprints around one variant is compared pair by pair up to this many; beyond it,
#: its members meet once more in the bits left out, which costs a fixed number of rows for each.
GROUP = 64
#: Alike are texts that share four fifths of their word shingles. They meet where the least values of four
#: permutations agree; of 16 such meetings one at least takes place for 99.98 % of pairs at just that similarity.
ALIKE = (4, 5)
BANDS, ROWS = 16, 4
_DRAWN = np.random.default_rng(11).integers(0, 2**64, (2, BANDS * ROWS), np.uint64)
MULTIPLIERS, OFFSETS = _DRAWN[0] | np.uint64(1), _DRAWN[1]


def _shingles(text: bytes, words: int) -> Iterator[bytes]:
    """Word shingles, from first to last; a text of fewer words is one, a text without words has none."""
    parts = text.lower().split()  # on bytes, both know ASCII only
    if not parts:
        return iter(())
    joined, width = b" ".join(parts), min(words, len(parts))
    starts = [0, *accumulate(len(p) + 1 for p in parts)]
    return (joined[a:b - 1] for a, b in zip(starts, starts[width:]))


def fingerprint(text: bytes, words: int = 3) -> int:
    """SimHash of word shingles: a bit is set where it is set in over half of the shingles' XXH64."""
    from xxhash import xxh64_intdigest

    hashes = np.fromiter((xxh64_intdigest(s, 42) for s in _shingles(text, words)), ">u8")
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp) for every row; ``fp`` holds the 64 bits as a signed long."""
    small_batches(docs.sparkSession)
    key = docs.schema[doc_id].dataType.simpleString()

    def marked(parts):
        for part in parts:
            prints = np.array([fingerprint(t, words) for t in as_bytes(part.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return texts(docs, doc_id, text).mapInArrow(marked, f"doc_id {key}, fp long")


def _mask(view: int) -> int:
    low, high = BLOCKS[view]
    return ((1 << high) - (1 << low))


def _ball(parts):
    """(view, key, fp): every fingerprint at all variants of radius one, in every view."""
    for part in parts:
        prints = part.column("fp").to_numpy().view(np.uint64)
        for view in range(len(BLOCKS)):
            kept = [b for b in range(BITS) if not _mask(view) >> b & 1]
            flips = np.array([0, *(1 << b for b in kept)], np.uint64)
            for i in range(0, len(prints), 1000):
                some = prints[i:i + 1000]
                keys = (some[:, None] & np.uint64((1 << BITS) - 1 - _mask(view))) ^ flips[None, :]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(keys.size, view, np.int8)), pa.array(keys.ravel().view(np.int64)),
                     pa.array(np.repeat(some, len(flips)).view(np.int64))], ["view", "key", "fp"])


def _pairs(view: np.ndarray, key: np.ndarray, prints: np.ndarray, group: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs within groups of at most ``group`` rows, each pair at one of its meeting points only."""
    left, right = [prints[:0]], [prints[:0]]
    at = np.arange(len(prints))
    for k in range(1, group):
        at = at[at + k < len(prints)]
        at = at[(key[at] == key[at + k]) & (view[at] == view[at + k])]
        if not len(at):
            break
        a, b = prints[at], prints[at + k]
        ok = np.bitwise_count(a ^ b) <= RADIUS
        for v in range(len(BLOCKS)):
            mask = np.uint64((1 << BITS) - 1 - _mask(v))
            differing = np.bitwise_count((a ^ b) & mask)
            # not where an earlier view has found it; at the lesser of the two variants between them
            here = view[at] == v
            ok &= ~((view[at] > v) & (differing <= 2))
            ok &= ~here | np.where(differing == 2, key[at] < ((a ^ b) & mask ^ key[at]), key[at] == np.minimum(a & mask, b & mask))
        left.append(a[ok])
        right.append(b[ok])
    return np.concatenate(left), np.concatenate(right)


def _second(view: int, key: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hub, fp, near): members of a large group at variants of the left-out block, as whole 64-bit values.

    A hub is at most two bits away from what it holds. Members within one bit of it (near) are within
    three of every other: where a hub has such a member, all it holds is linked, without comparing.
    """
    low, high = BLOCKS[view]
    out, mask = prints & np.uint64(_mask(view)), np.uint64((1 << BITS) - 1 - _mask(view))
    away = np.bitwise_count((prints & mask) ^ np.uint64(key))
    ones = np.array([0, *(1 << b for b in range(low, high))], np.uint64)
    hubs = ((out | np.uint64(key))[:, None] ^ ones[None, :]).ravel()
    near = (away[:, None] + (ones != 0)[None, :] <= 1).ravel()
    own = prints[away == 0]  # at most one value in this view, so few rows in all
    twos = np.array([1 << a | 1 << b for a, b in combinations(range(low, high), 2)], np.uint64)
    return (np.concatenate([hubs, (own[:, None] ^ twos[None, :]).ravel()]),
            np.concatenate([np.repeat(prints, len(ones)), np.repeat(own, len(twos))]),
            np.concatenate([near, np.zeros(own.size * len(twos), bool)]))


def _resolve(parts, group: int = GROUP):
    """(u, v, near): from sorted (view, key, fp), verified pairs with a null ``near``, and hubs of large groups.

    Holds a batch and at most ``group`` rows of the group that the batch breaks off.
    """
    held, large = None, None

    def out(u, v, near=None):
        flags = pa.array(near) if near is not None else pa.nulls(len(u), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64)), flags], ["u", "v", "near"])

    def resolved(rows, last):
        nonlocal held, large
        view, key, prints = rows
        if not len(key):  # no group ends here: ``large`` stays as it is
            return
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (view[1:] != view[:-1])) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(key)]])
        size = ends - starts
        big = size > group
        if large is not None:
            big[0] |= (view[0], key[0]) == large
        keep_from = len(key)
        if not last:
            large = (view[starts[-1]], key[starts[-1]]) if big[-1] else None
            keep_from = len(key) if big[-1] else starts[-1]
        for a, b in zip(starts[big], ends[big]):
            for i in range(a, b, 2000):
                yield out(*_second(int(view[a]), int(key[a]), prints[i:min(b, i + 2000)]))
        small = np.repeat(~big, size)
        small[keep_from:] = False
        u, v = _pairs(view[small], key[small], prints[small], group)
        if len(u):
            yield out(u, v)
        held = [x[keep_from:] for x in rows]

    for part in parts:
        new = [part.column("view").to_numpy(), part.column("key").to_numpy().view(np.uint64), part.column("fp").to_numpy().view(np.uint64)]
        yield from resolved([np.concatenate(x) for x in zip(held, new)] if held else new, False)
    if held is not None:
        yield from resolved(held, True)


def links(prints: DataFrame, group: int = GROUP) -> DataFrame:
    """(u, v): edges between distinct fingerprints that connect all those within RADIUS of each other.

    ``prints`` holds each fingerprint once, as ``fp``. No group is compared whole unless it is small,
    and a hub of the second meeting has at most 2081 members, the values within two bits of it.
    """
    met = (prints.mapInArrow(_ball, "view byte, key long, fp long").repartition("view", "key")
           .sortWithinPartitions("view", "key").mapInArrow(partial(_resolve, group=group), "u long, v long, near boolean"))
    met = stored(met, "simhash-met")
    hubs = (met.where("near is not null").groupBy("u").agg(F.max("near").alias("near"), F.collect_set("v").alias("held"))
            .where(F.col("near") & (F.size("held") > 1)).select(F.array_min("held").alias("u"), F.explode("held").alias("v")).where("u <> v"))
    return met.where("near is null").select("u", "v").union(hubs)


def meetings(text: bytes, words: int) -> list[int]:
    """One signed long for each band: a hash of its least values over the word shingles; none without words."""
    from xxhash import xxh64_intdigest

    hashes = np.fromiter((xxh64_intdigest(s, 42) for s in _shingles(text, words)), np.uint64)
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[i:i + 1024, None] * MULTIPLIERS + OFFSETS).min(0), out=least)
    key = np.zeros(BANDS, np.uint64)
    for values in least.reshape(BANDS, ROWS).T:
        key = (key ^ key >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) + values
    return key.view(np.int64).tolist()


def alike(a: bytes, b: bytes, words: int) -> bool:
    """Whether two texts share at least ALIKE of the different word shingles of both."""
    one, other = set(_shingles(a, words)), set(_shingles(b, words))
    both = len(one & other)
    return both * ALIKE[1] >= (len(one) + len(other) - both) * ALIKE[0]


def _with_hash(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, a, b, text): texts with a 128-bit hash."""
    return texts(docs, doc_id, text).select("doc_id", F.xxhash64("text").alias("a"), F.xxhash64(F.lit("text"), "text").alias("b"), "text")


def _marked(docs: DataFrame, doc_id: str, text: str, words: int, alike_words: int) -> DataFrame:
    """(doc_id, a, b, fp, keys) for every row: its fingerprint, and where it meets texts that are alike."""
    small_batches(docs.sparkSession)
    key = docs.schema[doc_id].dataType.simpleString()

    def marked(parts):
        for part in parts:
            found = list(as_bytes(part.column("text")))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("doc_id", "a", "b")), pa.array(np.array([fingerprint(t, words) for t in found], np.uint64).view(np.int64)),
                 pa.array([meetings(t, alike_words) for t in found], pa.list_(pa.int64()))], ["doc_id", "a", "b", "fp", "keys"])

    return _with_hash(docs, doc_id, text).mapInArrow(marked, f"doc_id {key}, a long, b long, fp long, keys array<long>")


def _one_each(docs: DataFrame, doc_id: str, text: str, ends: DataFrame) -> DataFrame:
    """(a, b, text) for (a, b, least): of the copies of a text one row is read."""
    found = _with_hash(docs, doc_id, text).alias("d").join(ends.alias("e"), F.expr("d.a = e.a and d.b = e.b and d.doc_id <=> e.least"))
    return stored(found.select("d.a", "d.b", "d.text").dropDuplicates(["a", "b"]), "alike-found")


def _checked(pairs: DataFrame, found: DataFrame, words: int) -> DataFrame:
    """(u, v): the fingerprints of those pairs whose texts are alike by their whole sets of shingles."""
    both = pairs.join(found.toDF("xa", "xb", "x"), ["xa", "xb"]).select("ya", "yb", "xfp", "yfp", "x").join(found.toDF("ya", "yb", "y"), ["ya", "yb"])

    def checked(parts):
        for part in parts:
            ok = pa.array([alike(x, y, words) for x, y in zip(as_bytes(part.column("x")), as_bytes(part.column("y")))], pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column("xfp").filter(ok), part.column("yfp").filter(ok)], ["u", "v"])

    return both.select("xfp", "yfp", "x", "y").mapInArrow(checked, "u long, v long")


def _hashed(found: DataFrame, words: int) -> DataFrame:
    """(a, b, hashes): the different hashes of the word shingles of every text."""
    def hashed(parts):
        from xxhash import xxh64_intdigest

        for part in parts:
            sets = [np.unique(np.fromiter((xxh64_intdigest(s, 42) for s in _shingles(t, words)), np.uint64)).view(np.int64).tolist() for t in as_bytes(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(sets, pa.list_(pa.int64()))], ["a", "b", "hashes"])

    return found.mapInArrow(hashed, "a long, b long, hashes array<long>")


def _across(sets: DataFrame) -> DataFrame:
    """(x, y), structs of (a, b, fp): from (a, b, fp, component, hashes), all pairs of texts of two components that can be alike.

    With all hashes in order of rarity, two sets that are ALIKE first agree where enough of both is left for the
    share they need. Hashes of one component only are in no such pair: they come first, and need no row. So
    what differs within a template, not the template, decides who meets.
    """
    part, whole = ALIKE
    each = sets.select("a", "b", "component", F.explode("hashes").alias("h"))
    spread = each.groupBy("h").agg(F.count("*").alias("df"), F.min("component").alias("c"), F.max("component").alias("d")).where("c <> d").select("h", "df")
    held = each.join(spread, "h").groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("held"))
    own = sets.select("a", "b", F.struct("a", "b", "fp").alias("x"), "component", F.size("hashes").alias("n")).join(held, ["a", "b"])
    rows = own.select("x", "component", "n", F.size("held").alias("m"), F.posexplode("held").alias("at", "one")).select(
        "x", "component", "n", (F.col("m") - F.col("at")).alias("rest"), F.col("one.h").alias("h"))
    # the greater set needs the share of itself, the lesser one twice what both need of their sum
    rows = stored(rows.where(F.col("rest") * whole >= F.col("n") * part), "alike-prefix")
    lesser = rows.where(F.col("rest") * (part + whole) >= F.col("n") * 2 * part).alias("i")
    met = lesser.join(rows.alias("p"), F.expr(
        "i.h = p.h and i.component <> p.component and (i.n < p.n or i.n = p.n and i.x < p.x) "
        f"and least(i.rest, p.rest) * {part + whole} >= (i.n + p.n) * {part}"))
    return met.select(F.col("i.x").alias("x"), F.col("p.x").alias("y"))


def _flat(pairs: DataFrame) -> DataFrame:
    """Each pair (x, y) of structs once, as (xa, xb, xfp, ya, yb, yfp)."""
    return stored(pairs.select(*(F.col(f"{s}.{c}").alias(f"{s}{c}") for s in "xy" for c in ("a", "b", "fp"))).distinct(), "alike-pairs")


def alike_links(marked: DataFrame, docs: DataFrame, doc_id: str, text: str, words: int, near: DataFrame, group: int = GROUP) -> DataFrame:
    """(u, v): edges that connect the fingerprints of all texts that meet and are alike by their whole sets of shingles,
    and whatever ``near`` connects.

    Of up to ``group`` different texts that meet, every pair is checked. Of more, each is first checked with one of
    them, another one in every band; groups that then hold several components are gone through once more, by
    every pair of two components that can be alike. No pair is left out because many texts meet.
    """
    # copies collapse first
    own = stored(marked.groupBy("a", "b").agg(F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.min("doc_id").alias("least")), "alike-texts")
    rows = own.select(F.struct("a", "b", "fp").alias("x"), F.posexplode("keys").alias("band", "key"))
    turn = F.struct(F.xxhash64("band", "x.a", "x.b"), "x")
    sized = rows.groupBy("band", "key").agg(F.count("*").alias("n"), F.min(turn).getField("x").alias("hub")).where("n > 1")
    met = stored(rows.join(sized, ["band", "key"]), "alike-met")
    small = met.where(F.col("n") <= group).groupBy("band", "key").agg(F.collect_list("x").alias("held")).select(F.explode("held").alias("x"), "held")
    small = small.select("x", F.explode("held").alias("y")).where("x < y")
    large = met.where(F.col("n") > group)
    hubs = large.where(F.col("x") != F.col("hub")).select(F.least("x", "hub").alias("x"), F.greatest("x", "hub").alias("y"))
    pairs = _flat(small.union(hubs).where(F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) > RADIUS))
    ends = pairs.select(F.col("xa").alias("a"), F.col("xb").alias("b")).union(pairs.select("ya", "yb")).distinct()
    found = _one_each(docs, doc_id, text, own.select("a", "b", "least").join(ends, ["a", "b"]))
    edges = near.union(_checked(pairs, found, words))
    if large.isEmpty():
        return edges
    parts = connected_components(edges)
    placed = large.select("band", "key", "x", F.col("x.fp").alias("node")).join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = placed.groupBy("band", "key").agg(F.min("component").alias("c"), F.max("component").alias("d")).where("c <> d").select("band", "key")
    left = stored(placed.join(several, ["band", "key"]).select("x.a", "x.b", "x.fp", "component").distinct(), "alike-open")
    edges = parts.select(F.col("node").alias("u"), F.col("component").alias("v"))
    if left.isEmpty():
        return edges
    found = _one_each(docs, doc_id, text, own.select("a", "b", "least").join(left.select("a", "b"), ["a", "b"]))
    sets = stored(left.join(_hashed(found, words), ["a", "b"]), "alike-sets")
    return edges.union(_checked(_flat(_across(sets)), found, words))


def _placed(marked: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, fp, component_id for (doc_id, fp), over edges between fingerprints."""
    # copies collapse into one fingerprint before anything is paired up
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    parts = connected_components(edges).withColumnRenamed("node", "fp")
    placed = distinct.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    roots = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = placed.join(roots, "component").select("fp", "component_id")
    return marked.join(classes, "fp", "left").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of ``docs``.

    ``fingerprint`` is the 64-bit SimHash of the word shingles as 16 hex digits; ``component_id`` is the
    least doc_id reachable over fingerprints that differ in at most three bits, the own one included.

    A null text is an empty one; without words the fingerprint is zero, linked like any other. A text of
    fewer words than a shingle is one shingle. Repeated rows give a row each. A row with a null id takes
    part and keeps its null; a component of such rows only has a null component_id. Other columns are
    ignored, whatever their names. An empty table gives an empty result.
    """
    marked = stored(fingerprints(docs, doc_id, text, words), "simhash-prints")
    return _placed(marked, links(marked.select("fp").distinct())).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, alike_words: int = 5) -> DataFrame:
    """The rows of ``docs``, with all their columns, but of each near-duplicate component only those of its least doc_id.

    Linked are the texts that ``near_duplicates`` links, and those whose shingles of ``alike_words`` words
    have a Jaccard similarity of at least ALIKE: candidates meet by least hashes and are checked exactly.
    Edge cases are those of ``near_duplicates``. An id stays or goes as a whole: rows that repeat the least
    id of a component all stay, and an id with rows in several components goes if it is not the least of
    one of them. A null id goes if its component has an id.
    """
    marked = stored(_marked(docs, doc_id, text, words, alike_words), "simhash-prints")
    near = links(marked.select("fp").distinct())
    found = _placed(marked.select("doc_id", "fp"), alike_links(marked, docs, doc_id, text, alike_words, near))
    own_id = "id" + "_" * max(map(len, docs.columns))  # a name that no column of the table has
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(own_id)).distinct()
    return docs.join(gone, F.col(doc_id).eqNullSafe(F.col(own_id)), "left_anti")
