"""Toxicity scores: a bidirectional gated recurrent network with attention pooling, trained in numpy."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from listloom.llm.common import as_bytes, small_batches

#: Words in a window, and words from one window's start to the next: every word is in two of them.
WINDOW, STRIDE = 32, 16
EMBED, HIDDEN = 16, 8
WORD_SLOTS, GRAM_SLOTS = 1 << 13, 1 << 14
#: Bounds of the labelled sample that the network is fitted on: texts per class, and bytes of one text.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_BYTES = 1200, 2800, 20_000
#: Bytes of text whose words are named at a time.
SLICE = 1 << 20

_LETTER = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Words:
    """The words of some texts: their distinct forms with features, and each text's sequence of forms.

    Features of a form are a slot for the whole word and slots for its three- and four-byte pieces,
    ends marked.
    """

    def __init__(self, texts: list[bytes]):
        names, starts, ends, low, at = [], [], [], [], 0
        counts, i = [0], 0
        while i < len(texts):
            size, j = 0, i
            while j < len(texts) and (j == i or size < SLICE):
                size, j = size + len(texts[j]), j + 1
            part = self._named(texts[i:j])
            names.append(part[0])
            starts.append(part[1] + at)
            ends.append(part[2] + at)
            low.append(part[3])
            counts.append(part[4] + sum(len(n) for n in names[:-1]))
            at, i = at + len(part[3]), j
        forms, first, self.form = np.unique(np.concatenate([np.zeros(0, np.uint64), *names]), return_index=True, return_inverse=True)
        self.form = self.form.astype(np.int32)
        self.word_slot = ((forms >> np.uint64(7)) % np.uint64(WORD_SLOTS)).astype(np.int32)
        none = np.zeros(0, np.int64)
        self._pieces(np.concatenate([np.zeros(0, np.uint8), *low]), np.concatenate([none, *starts])[first], np.concatenate([none, *ends])[first])
        #: text i holds the words from cut[i] to cut[i + 1]
        self.cut = np.concatenate([np.atleast_1d(c) for c in counts]).astype(np.int64)

    @staticmethod
    def _named(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(name, start, end) of every word of some texts, their lower-cased bytes, and the words up to each text's end."""
        buf = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
        edge = np.diff(_LETTER[buf].view(np.int8))
        starts, ends = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
        low = _LOWER[buf]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((low + np.uint64(1)) * np.cumprod(np.full(len(buf), _BASE)))])
        names = _mixed((sums[ends] - sums[starts]) * np.cumprod(np.full(len(buf), _UNBASE))[starts])
        return names, starts, ends, low.astype(np.uint8), np.searchsorted(starts, np.cumsum([1, *(len(t) + 1 for t in texts)])[1:])

    def _pieces(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        slots, owners = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for i in range(0, len(starts), 20_000):
            slot, owner = self._some_pieces(low, starts[i:i + 20_000], ends[i:i + 20_000])
            slots.append(slot)
            owners.append(owner + np.int32(i))
        self.piece_slot, self.piece_of = np.concatenate(slots), np.concatenate(owners)
        self.piece_start = np.searchsorted(self.piece_of, np.arange(len(starts)))

    @staticmethod
    def _some_pieces(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slot, form) of the pieces of some forms, form by form."""
        size = ends - starts
        offsets = np.concatenate([[0], np.cumsum(size + 2)])
        # "^word$" for every form, one after the other
        padded = np.zeros(offsets[-1] + 2, np.uint64)
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        padded[np.repeat(offsets[:-1] + 1, size) + place] = low[np.repeat(starts, size) + place]
        padded[offsets[:-1]], padded[offsets[1:] - 1] = 1, 2
        m = np.uint64(0x100000001B3)
        three = ((padded[:-2] * m + padded[1:-1]) * m + padded[2:]) * m
        owner = np.repeat(np.arange(len(size), dtype=np.int32), size + 2)
        slots, owners = [], []
        for n, h in ((3, three), (4, (three[:-1] + padded[3:]) * m * m)):
            at = np.arange(min(len(h), offsets[-1]))
            at = at[at + n <= offsets[owner[at] + 1]]
            slots.append(((_mixed(h[at]) >> np.uint64(9)) % np.uint64(GRAM_SLOTS)).astype(np.int32))
            owners.append(owner[at])
        slot, of = np.concatenate(slots), np.concatenate(owners)
        order = np.argsort(of, kind="stable")
        return slot[order], of[order]

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(first word, text) of every window; the last window of a text ends with it."""
        n = np.diff(self.cut)
        count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
        text = np.repeat(np.arange(len(n)), count)
        step = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        return self.cut[text] + np.minimum(step * STRIDE, np.maximum(n[text] - WINDOW, 0)), text

    def gather(self, first: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(forms, present) of windows, time first."""
        at = first[None, :] + np.arange(WINDOW)[:, None]
        present = at < self.cut[text + 1][None, :]
        return self.form[np.where(present, at, first[None, :])], present


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _summed(slot: np.ndarray, rows: np.ndarray, slots: int) -> np.ndarray:
    """Sums of the rows that share a slot."""
    return np.stack([np.bincount(slot, column, slots) for column in rows.T], axis=1).astype(np.float32)


class Network:
    """Word and piece embeddings, two gated recurrent layers in opposite directions, attention, one output."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        e, h = EMBED, HIDDEN
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {"word": draw(WORD_SLOTS, e, scale=0.05), "piece": draw(GRAM_SLOTS, e, scale=0.05), "w": draw(e, 6 * h, scale=e ** -0.5),
                  "b": np.zeros(6 * h, np.float32), "uf": draw(h, 3 * h, scale=h ** -0.5), "ub": draw(h, 3 * h, scale=h ** -0.5),
                  "a": draw(2 * h, scale=0.3), "o": draw(2 * h, scale=0.5), "c": np.zeros(1, np.float32)}
        #: score = sigmoid(slope * logit + shift), set by calibration
        self.slope, self.shift = 1.0, 0.0
        self._m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        self._t = 0

    def frozen(self) -> Network:
        """Without what only training needs."""
        self._m = {}
        return self

    def inputs(self, words: Words) -> np.ndarray:
        """Embedding of every distinct form: its word slot plus the mean of its pieces."""
        out = self.p["word"][words.word_slot].copy()
        n = len(out)
        bounds = np.append(words.piece_start, len(words.piece_slot))
        for i in range(0, n, 20_000):
            j = min(n, i + 20_000)
            some = self.p["piece"][words.piece_slot[bounds[i]:bounds[j]]]
            out[i:j] += np.add.reduceat(some, bounds[i:j] - bounds[i], axis=0) / np.diff(bounds[i:j + 1])[:, None]
        return out

    def _layer(self, x: np.ndarray, u: np.ndarray, present: np.ndarray | None, keep: list | None) -> np.ndarray:
        """Hidden states over time of one direction; ``x`` (time, window, 3 hidden)."""
        n = HIDDEN
        h = np.zeros((x.shape[1], n), np.float32)
        out = np.empty((len(x), *h.shape), np.float32)
        for t in range(len(x)):
            g = h @ u
            gates = _sigmoid(x[t, :, :2 * n] + g[:, :2 * n])
            r, z = gates[:, :n], gates[:, n:]
            c = np.tanh(x[t, :, 2 * n:] + r * g[:, 2 * n:])
            new = c + z * (h - c)
            if present is not None:
                new = np.where(present[t][:, None], new, h)
            if keep is not None:
                keep.append((h, r, z, c, g[:, 2 * n:]))
            out[t] = h = new
        return out

    def logits(self, table: np.ndarray, forms: np.ndarray, present: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """One logit per window; ``table`` holds the projected inputs of the forms."""
        h, some = HIDDEN, None if present.all() else present
        x = table[forms]
        kf, kb = ([], []) if keep is not None else (None, None)
        forward = self._layer(x[:, :, :3 * h], self.p["uf"], some, kf)
        backward = self._layer(x[::-1, :, 3 * h:], self.p["ub"], None if some is None else some[::-1], kb)[::-1]
        both = np.concatenate([forward, backward], axis=2)
        score = both @ self.p["a"]
        score = np.where(present, score, -1e9)
        weight = np.exp(score - score.max(0))
        weight /= weight.sum(0)
        pooled = (weight[:, :, None] * both).sum(0)
        if keep is not None:
            keep.update(kf=kf, kb=kb, both=both, weight=weight, pooled=pooled)
        return pooled @ self.p["o"] + self.p["c"][0]

    def _back_layer(self, d: np.ndarray, u: np.ndarray, present: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
        n, du = HIDDEN, np.zeros_like(u)
        dx, carry = np.zeros((*d.shape[:2], 3 * n), np.float32), np.zeros(d.shape[1:], np.float32)
        for t in reversed(range(len(d))):
            h, r, z, c, gc = kept[t]
            total = carry + d[t]
            here = np.where(present[t][:, None], total, 0)
            dc = here * (1 - z) * (1 - c * c)
            dr = dc * gc * r * (1 - r)
            dz = here * (h - c) * z * (1 - z)
            dx[t] = np.concatenate([dr, dz, dc], axis=1)
            dg = np.concatenate([dr, dz, dc * r], axis=1)
            du += h.T @ dg
            carry = (total - here) + here * z + dg @ u.T
        return dx, du

    def gradients(self, words: Words, first: np.ndarray, text: np.ndarray, target: np.ndarray, weight: np.ndarray, drop: np.ndarray | None = None) -> tuple[float, dict]:
        """Mean logistic loss of windows and its gradients."""
        forms, present = words.gather(first, text)
        used, forms = np.unique(forms, return_inverse=True)
        forms = forms.reshape(present.shape)
        sub = words.subset(used)
        embedded = self.inputs(sub)
        if drop is not None:
            embedded -= self.p["word"][sub.word_slot] * drop[used][:, None]
        table = (embedded @ self.p["w"] + self.p["b"]).astype(np.float32)
        kept: dict = {}
        logit = self.logits(table, forms, present, kept)
        prob = _sigmoid(logit)
        loss = float(np.mean(weight * (np.logaddexp(0, logit) - target * logit)))
        d = ((prob - target) * weight / len(target)).astype(np.float32)
        g = {"c": d.sum(keepdims=True), "o": kept["pooled"].T @ d}
        dpool = d[:, None] * self.p["o"]
        both, att = kept["both"], kept["weight"]
        dweight = (both * dpool).sum(2)
        dscore = att * (dweight - (att * dweight).sum(0))
        dboth = att[:, :, None] * dpool[None] + dscore[:, :, None] * self.p["a"]
        g["a"] = dscore.ravel() @ both.reshape(-1, both.shape[2])
        h = HIDDEN
        dxf, g["uf"] = self._back_layer(dboth[:, :, :h], self.p["uf"], present, kept["kf"])
        dxb, g["ub"] = self._back_layer(dboth[::-1, :, h:], self.p["ub"], present[::-1], kept["kb"])
        dx = np.concatenate([dxf, dxb[::-1]], axis=2).reshape(-1, 6 * h)
        order = np.argsort(forms.ravel(), kind="stable")
        dtable = np.add.reduceat(dx[order], np.searchsorted(forms.ravel()[order], np.arange(len(used))), axis=0)
        g["w"], g["b"] = embedded.T @ dtable, dtable.sum(0)
        dembed = dtable @ self.p["w"].T
        g["word"] = _summed(sub.word_slot, dembed if drop is None else dembed * (1 - drop[used])[:, None], WORD_SLOTS)
        sizes = np.diff(np.append(sub.piece_start, len(sub.piece_slot)))
        g["piece"] = _summed(sub.piece_slot, (dembed / sizes[:, None])[sub.piece_of], GRAM_SLOTS)
        return loss, g

    def step(self, gradients: dict, rate: float) -> None:
        """One step of Adam."""
        self._t += 1
        for k, g in gradients.items():
            m, v = self._m[k]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            self.p[k] -= rate * (m / (1 - 0.9 ** self._t)) / (np.sqrt(v / (1 - 0.999 ** self._t)) + 1e-8)

    def window_logits(self, words: Words, first: np.ndarray, text: np.ndarray) -> np.ndarray:
        table = (self.inputs(words) @ self.p["w"] + self.p["b"]).astype(np.float32) if len(first) else None
        out = np.empty(len(first), np.float32)
        for i in range(0, len(first), 2048):
            out[i:i + 2048] = self.logits(table, *words.gather(first[i:i + 2048], text[i:i + 2048]))
        return out

    def text_logits(self, texts: list[bytes]) -> np.ndarray:
        """The highest window logit of every text; without words, that of the least toxic text there can be."""
        words = Words(texts)
        first, text = words.windows()
        out = np.full(len(texts), -20.0, np.float32)
        np.maximum.at(out, text, self.window_logits(words, first, text))
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return _sigmoid(self.slope * self.text_logits(texts).astype(np.float64) + self.shift)


def _subset(self: Words, used: np.ndarray) -> Words:
    """Only some distinct forms, in the order given."""
    out = object.__new__(Words)
    out.word_slot = self.word_slot[used]
    bounds = np.append(self.piece_start, len(self.piece_slot))
    size = bounds[used + 1] - bounds[used]
    out.piece_start = np.cumsum(size) - size
    at = np.arange(size.sum()) - np.repeat(out.piece_start, size)
    out.piece_slot = self.piece_slot[np.repeat(bounds[used], size) + at]
    out.piece_of = np.repeat(np.arange(len(used)), size)
    return out


Words.subset = _subset


def train(texts: list[bytes], labels: list[int], seed: int = 7, rounds: int = 6, batch: int = 256) -> Network:
    """Fit on labelled texts: first every window carries its text's label, then only the highest window of
    each text does, as a toxic text is one with at least one toxic window. A fifth of the texts, left out
    of the fit, calibrates the scores.
    """
    net, rng = Network(seed), np.random.default_rng(seed)
    y = np.asarray(labels, np.float32)
    if not len(y) or y.min() == y.max():
        # nothing to tell apart: a constant score
        net.slope, net.shift = 0.0, (30.0 if len(y) and y[0] else -30.0)
        return net
    words = Words(texts)
    first, text = words.windows()
    held = rng.random(len(y)) < 0.2
    positive = max(1.0, float(((y == 0) & ~held).sum()) / max(1, int(((y == 1) & ~held).sum())))

    def pass_over(chosen: np.ndarray, weight: np.ndarray, rate: float) -> None:
        for i in range(0, len(chosen), batch):
            some = chosen[i:i + batch]
            drop = (rng.random(len(words.word_slot)) < 0.5).astype(np.float32)
            _, g = net.gradients(words, first[some], text[some], y[text[some]], weight[some], drop)
            net.step(g, rate)

    fit = np.flatnonzero(~held[text])
    share = max(1.0, float((y[text[fit]] == 0).sum()) / max(1, int((y[text[fit]] == 1).sum())))
    pass_over(rng.choice(fit, min(160 * batch, 3 * len(fit))), np.where(y[text] == 1, share, 1).astype(np.float32), 0.01)
    for k in range(rounds):
        scored = net.window_logits(words, first, text)
        order = np.lexsort((-scored, text))
        at = np.unique(text[order], return_index=True)[1]
        top = order[at]
        # of clean texts the second highest too: they must be low everywhere
        second = order[np.minimum(at + 1, len(order) - 1)]
        chosen = np.concatenate([top, second[y[text[second]] == 0]])
        chosen = chosen[~held[text[chosen]]]
        pass_over(rng.choice(chosen, min(40 * batch, 3 * len(chosen))), np.where(y[text] == 1, positive ** 0.5, 1).astype(np.float32), 0.006 / (1 + k / 2))
    logit = np.full(len(y), -20.0)
    np.maximum.at(logit, text, net.window_logits(words, first, text).astype(np.float64))
    on = held if 0 < y[held].sum() < held.sum() else np.ones(len(y), bool)
    net.slope, net.shift = _calibrated(logit[on], y[on])
    return net


def _calibrated(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit with softened targets."""
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([np.clip(logit, -20, 20), np.ones(len(y))], axis=1)
    b = start = np.array([1.0, 0.0])

    def loss(b: np.ndarray) -> float:
        # the pull towards the start keeps the fit finite where the classes part cleanly
        return float((np.logaddexp(0, x @ b) - target * (x @ b)).sum() + ((b - start) ** 2).sum() / 2)

    for _ in range(50):
        p = _sigmoid(x @ b)
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(2), x.T @ (target - p) - (b - start))
        size = 1.0
        while size > 1e-6 and loss(b + size * move) > loss(b):
            size /= 2
        b = b + size * move
    return (float(b[0]), float(b[1])) if b[0] > 0 else (1.0, 0.0)


def held_out(doc_id: str) -> Column:
    """Rows whose labels are not to be learned from: one third, by the checksum of their id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
           toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN, limit: int = SAMPLE_BYTES) -> Network:
    """A network fitted on a bounded sample of labelled rows that are not held out, least hash of the id first."""
    known = (labels.where(F.col(label).isin(0, 1) & ~held_out(doc_id)).groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(label).alias("y"))
             .withColumn("at", F.xxhash64(F.lit("sample"), F.col("doc_id"))))
    texts = docs.where(F.octet_length(text) <= limit).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    ids = None
    for y, most in ((1, toxic), (0, clean)):
        some = known.where(F.col("y") == y).orderBy("at", "doc_id").limit(most).select("doc_id", "y")
        ids = some if ids is None else ids.union(some)
    sample = texts.join(F.broadcast(ids), "doc_id").select("text", "y").repartition(1)

    def fit(parts):
        rows = sorted({(t, y) for part in parts for t, y in zip(as_bytes(part.column("text")), part.column("y").to_pylist())})
        network = train([t for t, _ in rows], [y for _, y in rows])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(network.frozen())], pa.binary())], ["network"])

    # the bounded sample is fitted in one task, so that the driver holds a network only
    found = sample.mapInArrow(fit, "network binary").first()
    return pickle.loads(found[0]) if found else train([], [])


def score(docs: DataFrame, network: Network, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a column ``name`` from 0 to 1: the highest over all overlapping windows of the whole text.

    A null text is an empty one; empty texts get the lowest score. Rows and other columns stay as they
    are, but for an older one of that name.
    """
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(network)
    base = docs.drop(name)
    schema = to_arrow_schema(base.withColumn(name, F.lit(0.0)).schema)

    def scored(parts):
        for part in parts:
            texts, values = list(as_bytes(part.column(text))), []
            held, size = [], 0
            for t in texts:
                held.append(t)
                size += len(t)
                if size > 4 << 20:
                    values.append(model.value.scores(held))
                    held, size = [], 0
            values.append(model.value.scores(held))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.concatenate(values), pa.float64())], schema=pa.schema([*part.schema, schema.field(name)]))

    return base.mapInArrow(scored, from_arrow_schema(schema))


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    The network learns from the labels of rows that are not held out and sees nothing but texts.

    A null text is an empty one; empty texts get the lowest score. Labels other than 0 and 1 do not
    count; of several labels of a row the highest counts. Without labels of both classes all scores are
    alike, near 0 (near 1 if all labels say so). A null id is not held out. Repeated rows give a row
    each. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    network = fitted(docs, labels, doc_id, text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text"))
    return score(rows, network).select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is below ``threshold``; edge cases as in ``toxicity``."""
    own = "score" + "_" * max(map(len, docs.columns))  # a name that no column of the table has
    return score(docs, fitted(docs, labels, doc_id, text), text, own).where(F.col(own) < threshold).drop(own)
