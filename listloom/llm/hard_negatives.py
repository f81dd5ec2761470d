"""Hard-negative mining: cover trees over norm-augmented candidates bound inner products, leaves are verified exactly."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from listloom.llm.common import small_batches, stored

#: Rows of one tree, about; cells of the top level at most; rows that the top level is chosen from, about.
ROWS, CELLS, SAMPLE = 4096, 1024, 8192
#: Rows below which a node is not divided, and the ratio of the covering radii of two levels.
LEAF, BASE = 64, 1.5
#: Components beyond this take no part: scores of up to 128 dimensions fit 64 bits with it.
LARGEST = 1 << 28
#: Anchors and rows whose scores are made at once.
ANCHORS, STRIP = 512, 1024
_FIELDS = "g int, vec_id long, label long, v array<int>, floor double, windows array<struct<place:int,positive_id:long,score:long,low:double>>, tree struct<ids:binary,labels:binary,x:binary,center:binary,radius:binary,first:binary,count:binary,start:binary,end:binary>"
_NODE = (("center", np.int64), ("radius", np.float64), ("first", np.int64), ("count", np.int64), ("start", np.int64), ("end", np.int64))


def augmented(x: np.ndarray, top: float) -> np.ndarray:
    """Vectors with one more component that gives all of them the squared norm ``top``: then the largest inner product is the least distance."""
    x = x.astype(np.float64)
    return np.concatenate([x, np.sqrt(np.maximum(top - (x * x).sum(1), 0))[:, None]], axis=1)


def centres(x: np.ndarray, first: int, radius: float, most: int) -> tuple[list[int], np.ndarray]:
    """(centres, nearest of them for each row): the farthest row becomes the next centre until all are within ``radius`` of
    one, or one centre more than ``most`` would be needed.
    """
    chosen, owner, near, square = [], np.zeros(len(x), np.int64), np.full(len(x), np.inf), (x * x).sum(1)
    following = first
    while len(chosen) <= most:
        d = np.maximum(square + square[following] - 2 * (x @ x[following]), 0)
        closer = d < near
        owner[closer], near[closer] = len(chosen), d[closer]
        chosen.append(following)
        following = int(near.argmax())
        if near[following] <= radius * radius:
            break
    return chosen, owner


class CoverTree:
    """Rows in nodes of falling covering radius; the rows of a node stand together, its children are numbered in a row."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, top: float, nodes: dict[str, np.ndarray]):
        self.ids, self.labels, self.top, self.nodes = ids, labels, top, nodes
        largest = float(np.abs(x).max(initial=0))
        self.x = x.astype(np.float64 if largest * largest * x.shape[1] < 2**53 else np.int64)

    @staticmethod
    def build(ids: np.ndarray, labels: np.ndarray, x: np.ndarray, top: float) -> CoverTree:
        wide, order = augmented(x, top), np.arange(len(x))
        nodes: dict[str, list] = {name: [] for name, _ in _NODE}

        def add(start: int, end: int, centre: int) -> None:
            d = wide[order[start:end]] - wide[centre]
            for name, value in zip(nodes, (centre, float(np.sqrt((d * d).sum(1).max())), 0, 0, start, end)):
                nodes[name].append(value)

        add(0, len(x), int(((wide - wide.mean(0)) ** 2).sum(1).argmin()))
        at = 0
        while at < len(nodes["start"]):
            start, end, radius = (nodes[name][at] for name in ("start", "end", "radius"))
            if end - start > LEAF and radius > 0:
                some = order[start:end]
                level = BASE ** (np.ceil(np.log(radius) / np.log(BASE)) - 1)
                most = (end - start) // 8
                # the node's own centre is the first of its children's
                chosen, owner = centres(wide[some], int(np.flatnonzero(some == nodes["center"][at])[0]), level, most)
                if len(chosen) <= most:  # else a level down every row would be a node of its own
                    centre, sizes = some[chosen], np.bincount(owner, minlength=len(chosen))
                    order[start:end] = some[np.argsort(owner, kind="stable")]
                    nodes["first"][at], nodes["count"][at] = len(nodes["start"]), len(chosen)
                    for c, e, n in zip(centre.tolist(), (start + np.cumsum(sizes)).tolist(), sizes.tolist()):
                        add(e - n, e, c)
            at += 1
        place = np.empty(len(x), np.int64)
        place[order] = np.arange(len(x))
        held = {name: np.array(nodes[name], kind) for name, kind in _NODE}
        held["center"] = place[held["center"]]
        return CoverTree(ids[order], labels[order], x[order], top, held)

    def row(self) -> dict[str, bytes]:
        return {"ids": self.ids.tobytes(), "labels": self.labels.tobytes(), "x": self.x.astype(np.int32).tobytes(), **{name: self.nodes[name].tobytes() for name, _ in _NODE}}

    @staticmethod
    def of_row(row: dict[str, bytes], top: float) -> CoverTree:
        ids = np.frombuffer(row["ids"], np.int64)
        return CoverTree(ids, np.frombuffer(row["labels"], np.int64), np.frombuffer(row["x"], np.int32).reshape(len(ids), -1), top,
                         {name: np.frombuffer(row[name], kind) for name, kind in _NODE})

    def bounds(self, nodes: slice, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(highest, lowest) inner product that the rows of some nodes can have with ``q``."""
        return ball_bounds(self.x[self.nodes["center"][nodes]].astype(np.float64), self.nodes["radius"][nodes], q.astype(np.float64), self.top)

    def best(self, q: np.ndarray, wanted: Callable[[slice], np.ndarray], k: int, low: float, high: float, seen: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the ``k`` best of the wanted rows with scores from ``low`` to ``high``, equal scores by id.

        The node of the highest bound is next; nodes wholly outside of low and high are left out, and ``low`` rises
        to the k-th best score. ``seen`` keeps scores of leaves for further searches by the same vector.
        """
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        (upper,), (lower,) = self.bounds(slice(0, 1), q)
        queue = [(-min(upper, high), 0)] if upper >= low and lower <= high else []
        while queue:
            bound, node = heapq.heappop(queue)
            if -bound < low:
                break
            children = slice(first := int(self.nodes["first"][node]), first + int(self.nodes["count"][node]))
            if self.nodes["count"][node]:
                upper, lower = self.bounds(children, q)
                for i in np.flatnonzero((upper >= low) & (lower <= high)).tolist():
                    heapq.heappush(queue, (-min(float(upper[i]), high), first + i))
                continue
            rows = slice(int(self.nodes["start"][node]), int(self.nodes["end"][node]))
            if node not in seen:
                seen[node] = (self.x[rows] @ q.astype(self.x.dtype)).astype(np.int64)
            at = np.flatnonzero(wanted(rows) & (seen[node] >= low) & (seen[node] <= high))
            ids, scores = first_of(np.concatenate([ids, self.ids[rows][at]]), np.concatenate([scores, seen[node][at]]), k)
            if len(ids) == k:
                low = max(low, float(scores[-1]))
        return ids, scores


    def many(self, q: np.ndarray, own: np.ndarray, label: np.ndarray, first: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, id, score), in order, of what ``best`` finds for each window of many vectors: rows of the same label, or of another one, but not of the own id.

        Vector i has the windows first[i] to first[i + 1], one at least. Vectors go down the tree together, and each leaf
        is scored for all of them that its bounds may matter to.
        """
        found = [tuple(np.zeros(0, np.int64) for _ in range(3))]
        for a in range(0, len(q), ANCHORS):
            b = min(a + ANCHORS, len(q))
            of = slice(first[a], first[b])
            w, ids, scores = self._together(q[a:b], own[a:b], label[a:b], first[a:b + 1] - first[a], low[of].astype(np.float64), high[of].astype(np.float64), k, same)
            found.append((w + first[a], ids, scores))
        return tuple(np.concatenate(c) for c in zip(*found))

    def _together(self, q, own, label, first, low, high, k, same):
        # no partial sum of a score exceeds the product of the norms, so that smaller kinds are exact below their limits
        most = np.sqrt(max(self.top, 1.0) * max(1.0, float((q.astype(np.float64) ** 2).sum(1).max())))
        kind = np.float32 if most < 2**24 else np.float64 if most < 2**52 else np.int64
        x, vectors, bound = self.x.astype(kind), q.astype(kind), np.float64 if kind is np.int64 else kind
        lowest, highest = np.minimum.reduceat(low, first[:-1]), np.maximum.reduceat(high, first[:-1])
        upper, lower = self.bounds(slice(None), q)
        alive = (upper >= lowest) & (lower <= highest)
        for node in np.flatnonzero(self.nodes["count"]).tolist():  # children are numbered after their parent
            children = slice(at := int(self.nodes["first"][node]), at + int(self.nodes["count"][node]))
            alive[children] &= alive[node]
        leaves = np.flatnonzero(self.nodes["count"] == 0)
        held, fresh, waiting = tuple(np.zeros(0, np.int64) for _ in range(3)), [], 0

        def settle():
            w, ids, scores = (np.concatenate(c) for c in zip(held, *fresh))
            order = np.lexsort((ids, -scores, w))
            w, ids, scores = w[order], ids[order], scores[order]
            rank = np.arange(len(w)) - np.searchsorted(w, w)
            last = rank == k - 1
            low[w[last]] = np.maximum(low[w[last]], scores[last])
            lowest[:] = np.minimum.reduceat(low, first[:-1])
            return w[rank < k], ids[rank < k], scores[rank < k]

        for leaf in leaves[np.argsort(-upper[leaves].max(1), kind="stable")].tolist():
            for start in range(int(self.nodes["start"][leaf]), int(end := self.nodes["end"][leaf]), STRIP):
                some = np.flatnonzero(alive[leaf] & (upper[leaf] >= lowest))
                if not len(some):
                    break
                scores = vectors[some] @ x[start:min(start + STRIP, end)].T
                i, j = np.nonzero(scores >= lowest[some].astype(bound)[:, None])
                a, row, score = some[i], start + j, scores[i, j].astype(np.int64)
                good = ((self.labels[row] == label[a]) == same) & (self.ids[row] != own[a]) & (score <= highest[a])
                a, row, score = a[good], row[good], score[good]
                for n in range(int(np.diff(first).max())):
                    w = first[a] + n
                    inside = np.flatnonzero(w < first[a + 1])
                    inside = inside[(score[inside] >= low[w[inside]]) & (score[inside] <= high[w[inside]])]
                    fresh.append((w[inside], self.ids[row[inside]], score[inside]))
                    waiting += len(inside)
                if waiting > 4096 + len(low) * k:
                    held, fresh, waiting = settle(), [], 0
        return settle()


def ball_bounds(centre: np.ndarray, radius: np.ndarray, q: np.ndarray, top: float) -> tuple[np.ndarray, np.ndarray]:
    """(highest, lowest) inner product of ``q`` with rows within ``radius`` of ``centre``, all of squared norm ``top`` when augmented.

    For many vectors ``q`` there is a column for each of them.
    """
    both = (q * q).sum(-1) + top
    radius = radius if q.ndim == 1 else radius[:, None]
    d = np.sqrt(np.maximum(both - 2 * (centre @ q.T), 0))
    slack = 1e-9 * both + 1e-6 * radius + 1  # rounding of distances; scores are whole numbers
    return (both - np.maximum(d - radius, 0) ** 2) / 2 + slack, (both - (d + radius) ** 2) / 2 - slack


def first_of(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(ids) > k:
        some = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
        ids, scores = ids[some], scores[some]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def quantised(vectors: DataFrame, scale: float, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(vec_id, label, v): whole numbers floor(scale * x) of the rows that take part (see ``hard_negatives``)."""
    v = F.col("v")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(embedding).cast("array<double>").alias("v"))
    good = F.forall(v, lambda c: F.coalesce((F.abs(c * scale) < LARGEST) & ~F.isnan(c), F.lit(False)))
    rows = rows.where("vec_id is not null and label is not null and v is not null and size(v) > 0").where(F.coalesce(good, F.lit(False)))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (size["n"] if size else -1)).withColumn("v", F.transform("v", lambda c: F.floor(c * scale).cast("int")))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.int32)


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, share: int = 80, scale: float = 256.0,
                   vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x); a score is an inner product of whole numbers. Anchors are rows whose id is
    divisible by ``every``; an anchor's positives are its first ``positives`` other rows of the same label, higher
    scores first, ties by id. For each of them the first ``negatives`` rows of another label follow whose scores
    lie from ``share`` per cent of the positive's to the positive's.

    Up to CELLS centres far from each other, chosen among about SAMPLE rows, are the top level. Every row joins the
    cell of its nearest centre; each cell is split into trees of about ROWS rows. Anchors go to the cells whose bounds can
    matter: for positives, those that reach the scores which the sample alone gives; for negatives, those that meet a
    window. All bounds are exact, so is the result.

    Rows with a null id, a null label, a null or empty vector or one not of the commonest length take no part, nor do
    those with null or non-finite components or any of LARGEST and more after scaling. An id that repeats is a candidate as
    often as it occurs, but never for itself, and is an anchor once, with the least of its vectors and labels. Other
    columns are ignored, whatever their names. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = stored(quantised(vectors, scale, vec_id, embedding, label), "whole-numbers")  # read again and again
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c)
    total, top = rows.agg(F.count("*"), F.max(square)).first()
    sample = rows if total <= SAMPLE else rows.sample(fraction=SAMPLE / total, seed=5)
    drawn = sample.orderBy("vec_id").limit(2 * SAMPLE).collect()
    top = float(top or 0)
    x = np.array([r["v"] for r in drawn], np.int32) if drawn else np.zeros((0, 1), np.int32)
    known = spark.sparkContext.broadcast(CoverTree.build(np.array([r["vec_id"] for r in drawn]), np.array([r["label"] for r in drawn]), x, top)) if drawn else None
    wide = augmented(x, top)
    pivots = wide[centres(wide, 0, 0.0, min(CELLS, max(1, -(-total // ROWS))) - 1)[0]] if drawn else wide
    shared = spark.sparkContext.broadcast(pivots)

    def placed(parts):
        centre = shared.value
        for part in parts:
            own = augmented(_matrix(part.column("v")), top)
            d = np.maximum((own * own).sum(1)[:, None] + (centre * centre).sum(1)[None, :] - 2 * own @ centre.T, 0)
            cell = d.argmin(1)
            far = np.sqrt(((own - centre[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(far), *part.columns], ["cell", "far", "vec_id", "label", "v"])

    cells = stored(rows.mapInArrow(placed, "cell int, far double, vec_id long, label long, v array<int>"), "cells")
    # a row for each cell, of which there are at most CELLS
    sizes, radius = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    for cell, n, far in cells.groupBy("cell").agg(F.count("*"), F.max("far")).collect():
        sizes[cell], radius[cell] = n, far
    trees = -(-sizes // ROWS)
    offset = np.cumsum(trees) - trees
    numbers = [F.element_at(F.array(*(F.lit(int(v)) for v in some)), F.col("cell") + 1) for some in (np.maximum(trees, 1), offset)] if len(pivots) else [F.lit(1), F.lit(0)]
    numbered = cells.select((numbers[1] + F.pmod(F.xxhash64("vec_id", "v"), numbers[0])).cast("int").alias("g"), "vec_id", "label", "v")

    def built(parts):
        now, held = None, []

        def tree():
            ids, labels, x = (np.concatenate(z) for z in zip(*held))
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([CoverTree.build(ids, labels, x, top).row()], _TREE)], ["g", "tree"])

        for part in parts:
            g = part.column("g").to_numpy()
            cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if g[a] != now and held:
                    yield tree()
                    held = []
                now, some = int(g[a]), part.slice(a, b - a)
                held.append((some.column("vec_id").to_numpy(), some.column("label").to_numpy(), _matrix(some.column("v"))))
        if held:
            yield tree()

    fields = dict(f.split(" ", 1) for f in _FIELDS.split(", "))
    index = stored(numbered.repartitionByRange("g").sortWithinPartitions("g").mapInArrow(built, f"g int, tree {fields['tree']}"), "cover-trees")
    stock = index.select("g", *(F.lit(None).cast(fields[c]).alias(c) for c in ("vec_id", "label", "v", "floor", "windows")), "tree")
    anchors = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("v", "label")).alias("least")).select("vec_id", "least.label", "least.v")

    def routed(sought: Callable) -> Callable:
        """Rows of anchors, one for each tree to visit; ``sought`` gives what is sought, and the columns floor and windows."""

        def of(parts):
            for whole in parts:
                for a in range(0, len(whole), ANCHORS):
                    part = whole.slice(a, ANCHORS)
                    q = _matrix(part.column("v")).astype(np.int64)
                    first, low, high, floor, windows = sought(q, part)
                    upper, lower = ball_bounds(shared.value[:, :-1], radius, q.astype(np.float64), top)
                    owner = np.repeat(np.arange(len(q)), np.diff(first))
                    i, c = np.nonzero(np.logical_or.reduceat((upper[:, owner] >= low) & (lower[:, owner] <= high), first[:-1], axis=1).T)
                    # the trees of the cells that any of the windows of scores meets
                    many = trees[c]
                    at, goal = np.repeat(i, many), np.repeat(offset[c] - np.cumsum(many) + many, many) + np.arange(many.sum())
                    for b in range(0, len(at), 5_000):
                        i = pa.array(at[b:b + 5_000], pa.int64())
                        yield pa.RecordBatch.from_arrays([pa.array(goal[b:b + 5_000], pa.int32()), *(part.column(n).take(i) for n in ("vec_id", "label", "v")), floor.take(i), windows.take(i)],
                                                         ["g", "vec_id", "label", "v", "floor", "windows"])

        return of

    def met(asking: DataFrame, answer: Callable, schema: str) -> DataFrame:
        """Anchors and trees of one number side by side, the tree first."""

        def answered(parts):
            now, tree = None, None
            for part in parts:
                g, stands = part.column("g").to_numpy(), part.column("tree").is_valid().to_numpy(zero_copy_only=False)
                cuts = [0, *(np.flatnonzero((g[1:] != g[:-1]) | stands[1:] | stands[:-1]) + 1).tolist(), len(g)]
                for a, b in zip(cuts, cuts[1:]):
                    if a < b and stands[a]:
                        now, tree = g[a], CoverTree.of_row(part.column("tree")[a].as_py(), top)
                    elif a < b and g[a] == now:
                        some = part.slice(a, b - a)
                        columns = answer(tree, _matrix(some.column("v")).astype(np.int64), some)
                        if len(columns[0]):
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema.replace(" long", "").split(", "))

        both = stock.union(asking.withColumn("tree", F.lit(None).cast(fields["tree"])))
        return both.repartitionByRange("g").sortWithinPartitions("g", F.col("tree").isNull()).mapInArrow(answered, schema)

    def searched(tree: CoverTree, q, part, first, low, high, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tree.many(q, part.column("vec_id").to_numpy(), part.column("label").to_numpy(), first, low, high, positives if same else negatives, same)

    def raised(low: np.ndarray, w: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        """The least scores that can still matter: where k are found, the k-th."""
        last = np.arange(len(w)) - np.searchsorted(w, w) == k - 1
        low = low.copy()
        low[w[last]] = np.maximum(low[w[last]], scores[last])
        return low

    def positives_sought(q, part):
        first, low, high = np.arange(len(q) + 1), np.full(len(q), -np.inf), np.full(len(q), np.inf)
        w, _, scores = searched(known.value, q, part, first, low, high, True)
        low = raised(low, w, scores, positives)
        return first, low, high, pa.array(low), pa.nulls(len(q), _WINDOWS)

    def positives_found(tree, q, part):
        w, ids, scores = searched(tree, q, part, np.arange(len(q) + 1), part.column("floor").to_numpy(), np.full(len(q), np.inf), True)
        return part.column("vec_id").to_numpy()[w], ids, scores

    def windows_of(part) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        column = part.column("windows")
        first = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
        flat = column.flatten()
        return first, {f.name: flat.field(n).to_numpy() for n, f in enumerate(flat.type)}

    def negatives_sought(q, part):
        first, w = windows_of(part)
        low, high = (-(-share * w["score"] // 100)).astype(np.float64), w["score"].astype(np.float64)
        low[low > high] = np.inf  # below zero there is no window
        at, _, scores = searched(known.value, q, part, first, low, high, False)
        low = raised(low, at, scores, negatives)
        rows = pa.StructArray.from_arrays([pa.array(w["place"], pa.int32()), pa.array(w["positive_id"]), pa.array(w["score"]), pa.array(low)], fields=list(_WINDOWS.value_type))
        return first, low, high, pa.nulls(len(q), pa.float64()), pa.ListArray.from_arrays(pa.array(first, pa.int32()), rows)

    def negatives_found(tree, q, part):
        first, w = windows_of(part)
        at, ids, scores = searched(tree, q, part, first, w["low"], w["score"].astype(np.float64), False)
        own = np.repeat(part.column("vec_id").to_numpy(), np.diff(first))
        return own[at], w["place"][at], w["positive_id"][at], w["score"][at], ids, scores

    asking = f"g int, vec_id long, label long, v array<int>, floor double, windows {fields['windows']}"
    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id")
    pairs = met(stored(anchors.mapInArrow(routed(positives_sought), asking), "anchors"), positives_found, "anchor_id long, positive_id long, score long")
    pairs = pairs.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives)
    windows = pairs.groupBy("anchor_id").agg(F.collect_list(F.struct("place", "positive_id", "score", F.lit(0.0).alias("low"))).alias("windows"))
    seekers = anchors.join(windows, F.col("vec_id") == F.col("anchor_id")).select("vec_id", "label", "v", "windows")
    found = met(stored(seekers.mapInArrow(routed(negatives_sought), asking), "seekers"), negatives_found,
                "anchor_id long, place long, positive_id long, positive_score long, negative_id long, negative_score long")
    best = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


_TREE = pa.struct([(name, pa.binary()) for name in ("ids", "labels", "x", *(name for name, _ in _NODE))])
_WINDOWS = pa.list_(pa.struct([("place", pa.int32()), ("positive_id", pa.int64()), ("score", pa.int64()), ("low", pa.float64())]))
