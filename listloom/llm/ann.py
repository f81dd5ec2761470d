"""Nearest neighbours by learned partitions: a balanced cut of a neighbour graph, and a classifier that routes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from listloom.llm.common import small_batches, stored

#: Rows, about, that the partitions are learned from; everything else is indexed by what was learned.
SAMPLE = 8192
#: Rows that one partition is meant to hold, and how many partitions there may be at most.
ROWS, PARTITIONS = 2048, 256
#: Neighbours of a node in the graph, hidden units of the classifier, rows compared with a query at a time.
DEGREE, HIDDEN, CHUNK = 10, 128, 8192
#: Share of a sample's true neighbours that the probed partitions must hold.
TARGET = 0.93


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """Places of the k rows with the largest inner product, the own row left out."""
    out = np.empty((len(x), k), np.int64)
    for i in range(0, len(x), 512):
        s = x[i:i + 512] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out[i:i + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def _halves(nodes: np.ndarray, source: np.ndarray, target: np.ndarray, first: int, rng: np.random.Generator) -> np.ndarray:
    """Which ``first`` of the nodes form one side: the order of a slow mode of a walk over the graph, then swaps."""
    n = len(nodes)
    degree = np.maximum(1, np.bincount(source, minlength=n)).astype(np.float64)
    v = rng.standard_normal(n)
    for _ in range(50):
        v -= (v * degree).sum() / degree.sum()
        v = 0.5 * v + 0.5 * np.bincount(source, v[target], n) / degree
        v /= np.linalg.norm(v) or 1.0
    side = np.zeros(n, bool)
    side[np.argsort(v, kind="stable")[:first]] = True
    for _ in range(10):
        # how many more neighbours a node has on the other side than on its own
        other = np.bincount(source, (side[source] != side[target]).astype(np.float64), n)
        gain = 2 * other - np.bincount(source, minlength=n)
        a, b = np.flatnonzero(side), np.flatnonzero(~side)
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        m = min(len(a), len(b))
        worth = int(((gain[a[:m]] + gain[b[:m]]) > 0).sum()) // 2
        if not worth:
            break
        side[a[:worth]], side[b[:worth]] = False, True
    return side


def balanced_partitions(near: np.ndarray, parts: int, seed: int = 5) -> np.ndarray:
    """A part for every node of a neighbour graph: parts of equal size, with few edges between them."""
    n, rng, out = len(near), np.random.default_rng(seed), np.zeros(len(near), np.int64)
    a, b = np.repeat(np.arange(n), near.shape[1]), near.ravel()
    source, target = np.concatenate([a, b]), np.concatenate([b, a])
    work = [(np.arange(n), source, target, parts, 0)]
    while work:
        nodes, source, target, k, name = work.pop()
        if k == 1:
            out[nodes] = name
            continue
        side = _halves(nodes, source, target, round(len(nodes) * (k // 2) / k), rng)
        for flag, count, at in ((True, k // 2, name), (False, k - k // 2, name + k // 2)):
            mine = side == flag
            keep = mine[source] & mine[target]
            new = np.cumsum(mine) - 1
            work.append((nodes[mine], new[source[keep]], new[target[keep]], count, at))
    return out


class Router:
    """One hidden layer from a vector to the probabilities of partitions."""

    def __init__(self, x: np.ndarray, near: np.ndarray, part: np.ndarray, parts: int, seed: int = 5, epochs: int = 20):
        rng = np.random.default_rng(seed)
        d = x.shape[1]
        self.scale = float(np.sqrt((x * x).mean()) or 1.0)
        self.p = [rng.standard_normal((d, HIDDEN)) * d ** -0.5, np.zeros(HIDDEN), rng.standard_normal((HIDDEN, parts)) * HIDDEN ** -0.5, np.zeros(parts)]
        # a row belongs to its own partition and to those of its neighbours
        want = np.zeros((len(x), parts))
        np.add.at(want, (np.repeat(np.arange(len(x)), near.shape[1]), part[near.ravel()]), 0.5 / near.shape[1])
        want[np.arange(len(x)), part] += 0.5
        moments, t = [[np.zeros_like(p), np.zeros_like(p)] for p in self.p], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), 256):
                some, t = order[i:i + 256], t + 1
                z = x[some] / self.scale
                h = np.maximum(z @ self.p[0] + self.p[1], 0)
                d_out = (self._soft(h @ self.p[2] + self.p[3]) - want[some]) / len(some)
                d_hidden = (d_out @ self.p[2].T) * (h > 0)
                for p, g, (m, v) in zip(self.p, (z.T @ d_hidden, d_hidden.sum(0), h.T @ d_out, d_out.sum(0)), moments):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= 0.003 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)

    @staticmethod
    def _soft(s: np.ndarray) -> np.ndarray:
        e = np.exp(s - s.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._soft(np.maximum(x / self.scale @ self.p[0] + self.p[1], 0) @ self.p[2] + self.p[3])


class Index:
    """What was learned: the router, and how many partitions a query must probe for TARGET of its neighbours."""

    def __init__(self, sample: np.ndarray, names: np.ndarray, parts: int, k: int):
        self.sample, self.names, self.k = sample, names, k
        self.parts = parts = max(1, min(parts, len(sample) // 32))
        self.router, self.probes = None, 1
        if parts > 1:
            near = neighbours(sample, min(DEGREE, len(sample) - 1))
            self.router = Router(sample, near, balanced_partitions(near, parts), parts)
            belief = self.router(sample)
            home, some = belief.argmax(1), np.arange(0, len(sample), max(1, len(sample) // 500))
            true = neighbours(sample, min(k, len(sample) - 1))[some]
            place = np.empty((len(some), parts), np.int64)
            np.put_along_axis(place, np.argsort(-belief[some], axis=1), np.arange(parts)[None, :].repeat(len(some), 0), axis=1)
            needed = np.take_along_axis(place, home[true], axis=1).ravel()
            self.probes = int(np.searchsorted(np.cumsum(np.bincount(needed, minlength=parts)) / len(needed), TARGET)) + 1

    def floor(self, x: np.ndarray, own: np.ndarray, probed: list[np.ndarray]) -> np.ndarray:
        """A score that a query's k nearest in its partitions cannot fall below: what the sample alone reaches there."""
        out = np.full(len(x), -np.inf)
        if len(self.sample) <= self.k:
            return out
        where = self.home(self.sample)
        for i in range(0, len(x), 256):
            s = x[i:i + 256] @ self.sample.T
            for j, row in enumerate(s):
                seen = np.zeros(self.parts, bool)
                seen[probed[i + j]] = True
                row = row[seen[where] & (self.names != own[i + j])]
                if len(row) >= self.k:
                    best = np.partition(row, -self.k)[-self.k]
                    out[i + j] = best - 1e-9 * max(1.0, abs(best))
        return out

    def home(self, x: np.ndarray) -> np.ndarray:
        return self.router(x).argmax(1) if self.router else np.zeros(len(x), np.int64)

    def probed(self, x: np.ndarray, sizes: np.ndarray, enough: int) -> list[np.ndarray]:
        """Partitions of every query, most probable first: ``probes`` of them, more until they hold ``enough`` rows."""
        if not self.router:
            return [np.zeros(1, np.int64)] * len(x)
        order = np.argsort(-self.router(x), axis=1)
        need = 1 + (np.cumsum(sizes[order], axis=1) < enough).sum(1)
        return [o[:max(self.probes, n)] for o, n in zip(order, need)]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products summed in the order of the dimensions, so that equal vectors score equally wherever they stand."""
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += q[d] * x[:, d]
    return out


def nearest_in(q: np.ndarray, own: int, x: np.ndarray, ids: np.ndarray, rough: np.ndarray, k: int, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k best rows not below ``floor``, equal scores by id; ``rough`` holds scores up to rounding."""
    other = (ids != own) & (rough >= floor)
    if other.sum() > k:
        least = np.partition(rough[other], -k)[-k]
        other &= rough >= least - 1e-9 * max(1.0, abs(least))
    at = np.flatnonzero(other)
    scores = exact_scores(q, x[at])
    best = np.lexsort((ids[at], -scores))[:k]
    return ids[at[best]], scores[best]


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v): rows with an id and a vector of the commonest length without null, non-finite or only zero components."""
    v = F.col("v")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    good = F.forall(v, lambda c: F.coalesce((F.abs(c) < F.lit(float("inf"))) & ~F.isnan(c), F.lit(False))) & F.exists(v, lambda c: c != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.coalesce(good, F.lit(False)))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (size["n"] if size else -1))


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of the largest inner product found for every row whose id is divisible by ``every``.

    Partitions are learned from a sample of about SAMPLE rows; every row is indexed. Up to ROWS rows there
    is one partition and the search is exact. A query's own row is no candidate. Scores are exact inner
    products in double precision of the vectors as given, ties go to the smaller id.

    Rows with a null id take no part, nor do vectors that are null, empty, all zero, not of the commonest
    length, or hold null or non-finite components. An id that repeats is a candidate as often as it
    occurs, but never for itself, and is searched for once, with the least of its vectors. Other columns
    are ignored, whatever their names. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = usable(vectors, vec_id, embedding)
    total = rows.count()
    sample = rows if total <= SAMPLE else rows.sample(fraction=SAMPLE / total, seed=5)
    drawn = sample.orderBy("vec_id").limit(2 * SAMPLE).collect()
    x = np.array([r["v"] for r in drawn]) if drawn else np.zeros((0, 1))
    names = np.array([r["vec_id"] for r in drawn], np.int64)
    index = spark.sparkContext.broadcast(Index(x, names, min(PARTITIONS, -(-total // ROWS)), k))

    def placed(parts):
        for part in parts:
            home = index.value.home(_matrix(part.column("v")))
            yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), part.column("vec_id"), part.column("v")], ["part", "vec_id", "v"])

    homes = stored(rows.mapInArrow(placed, "part int, vec_id long, v array<double>"), "ann-index")
    # one row for each partition, of which there are at most PARTITIONS
    sizes = np.zeros(max(1, index.value.parts), np.int64)
    for part, n in homes.groupBy("part").count().collect():
        sizes[part] = n
    chunks = -(-sizes // CHUNK)

    def routed(parts):
        for part in parts:
            ids, q = part.column("vec_id").to_numpy(), _matrix(part.column("v"))
            probed = index.value.probed(q, sizes, k + 1)
            floor = index.value.floor(q, ids, probed)
            at = [(i, p, c) for i, many in enumerate(probed) for p in many for c in range(chunks[p])]
            for a in range(0, len(at), 10_000):
                i, p, c = (np.array(z) for z in zip(*at[a:a + 10_000]))
                yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(ids[i]), part.column("v").take(pa.array(i)), pa.array(floor[i])], ["part", "chunk", "vec_id", "v", "floor"])

    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")).mapInArrow(routed, "part int, chunk int, vec_id long, v array<double>, floor double")
    parts_of = F.element_at(F.array(*(F.lit(int(max(1, c))) for c in chunks)), F.col("part") + 1)
    stock = homes.select("part", F.pmod(F.xxhash64("vec_id", "v"), parts_of).cast("int").alias("chunk"), "vec_id", "v", F.lit(None).cast("double").alias("floor"), F.lit(False).alias("asks"))
    met = stock.union(queries.withColumn("asks", F.lit(True))).repartition("part", "chunk").sortWithinPartitions("part", "chunk", "asks")

    def answered(parts):
        now, held, ids, x = None, [], None, None
        for batch in parts:
            keys = np.stack([batch.column("part").to_numpy(), batch.column("chunk").to_numpy()], axis=1)
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1) | (asks[1:] != asks[:-1])) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if tuple(keys[a]) != now:
                    now, held, x = tuple(keys[a]), [], None
                some = batch.slice(a, b - a)
                if not asks[a]:
                    held.append((some.column("vec_id").to_numpy(), _matrix(some.column("v"))))
                    continue
                if not held:
                    continue
                if x is None:
                    ids, x = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                own, q, floor = some.column("vec_id").to_numpy(), _matrix(some.column("v")), some.column("floor").to_numpy()
                for i in range(0, len(q), 256):
                    rough = q[i:i + 256] @ x.T
                    found = [nearest_in(q[i + j], own[i + j], x, ids, rough[j], k, floor[i + j]) for j in range(len(rough))]
                    n = [len(f[0]) for f in found]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own[i:i + 256], n)), pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]))], ["query_id", "vec_id", "score"])

    found = met.mapInArrow(answered, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
