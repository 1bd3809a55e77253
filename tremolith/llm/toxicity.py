"""Toxicity: a convolutional text classifier, trained in NumPy on all labelled documents, shard by shard.

A word is the sum of hashed embeddings of the word itself and of its first four and five bytes, so an inflected stem is
known by its beginning.  Filters one, two and three words wide slide over the whole text; each keeps its maximum, and a
logistic layer turns the maxima into a log-odds.  Training is stochastic (fixed order, Adagrad) with the gradient of the
maximum, from an embedding that starts at the smoothed log-odds of each bucket.  In each epoch every shard of about
``SHARD`` documents goes on from the common model; the shards' changes are averaged by Spark, those of a bucket over the
shards that changed it.  One shard alone is plain stochastic descent.

Language groups come from the text alone: spherical k-means over hashed word frequencies of all labelled documents.  On
a fifth of them, kept out of training by the id's hash, each group with enough of both classes gets the threshold with the
best accuracy at the labels' own class shares; the other groups get the common one.  Thresholds are found on log-odds
counted in steps of 0.001.  A score is moved so that its group's threshold is 0.5.

A document labelled twice is toxic if any label says so.  Null labels, ids and texts aren't learnt from.  Null, empty and
wordless texts get the score of a text whose filters all rest.  With labels of one class only, or none, every score is that
class's share (0.5 without labels), moved below 0.5 unless all labels are toxic.  Repeated rows score alike.  Other columns
are kept; one named as the output is replaced.
"""

from __future__ import annotations

import copy
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, Row, functions as F

from . import text as T

BUCKETS, DIMS, FILTERS, WIDTHS = 1 << 17, 8, 8, (1, 2, 3)
GROUPS, SHAPE = 8, 256
SHARD, BATCH = 1 << 14, 32  # documents of a shard and of a step
_PART = 1 << 13             # buckets summed as one value
_SALT = T.seeds(3, 71)
_COLUMNS = np.repeat(np.arange(len(WIDTHS)), [w * FILTERS for w in WIDTHS])   # width of each projection
_OFFSET = np.concatenate([np.repeat(np.arange(w), FILTERS) for w in WIDTHS])  # its place in the filter
_FILTER = np.concatenate([np.tile(np.arange(FILTERS), w) + FILTERS * j for j, w in enumerate(WIDTHS)])


def buckets(words: T.Words) -> np.ndarray:
    """Three embedding rows of each word."""
    parts = (words.hashes(), words.hashes(4), words.hashes(5))
    return np.stack([(T.mix(h * s) & np.uint64(BUCKETS - 1)).astype(np.int32) for h, s in zip(parts, _SALT)], axis=1) if len(words) else np.empty((0, 3), np.int32)


def shapes(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Unit vectors of square-rooted frequencies of hashed words."""
    n = len(first) - 1
    row = np.repeat(np.arange(n), np.diff(first))
    out = np.sqrt(np.bincount(row * SHAPE + rows[:, 0] % SHAPE, minlength=n * SHAPE).reshape(n, SHAPE))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


@dataclass
class Model:
    embed: np.ndarray    # BUCKETS x DIMS
    filters: np.ndarray  # projections x DIMS
    rest: np.ndarray     # bias of each filter
    out: np.ndarray
    bias: float
    groups: np.ndarray   # unit centres
    shift: np.ndarray    # log-odds threshold of each group

    def convolved(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Filter outputs at each word; words beyond the text's end add nothing."""
        p = words @ self.filters.T
        last = np.repeat(first[1:], np.diff(first)) - np.arange(len(words)) - 1  # words after this one
        out = np.zeros((len(words), FILTERS * len(WIDTHS)), p.dtype)
        for at in range(0, p.shape[1], FILTERS):
            off, to = _OFFSET[at], _FILTER[at]
            part = p[off:, at:at + FILTERS]
            if off:
                part = part * (last[:len(part)] >= off)[:, None]
            out[:len(part), to:to + FILTERS] += part
        return out

    def log_odds(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        e = self.embed[rows[:, 0]] + self.embed[rows[:, 1]] + self.embed[rows[:, 2]]
        top = T.maxima(self.convolved(e, first), first, 0.0)
        return np.maximum(top + self.rest, 0) @ self.out + self.bias

    def moved(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log-odds relative to the threshold of each text's group."""
        return self.log_odds(rows, first) - self.shift[(shapes(rows, first) @ self.groups.T).argmax(axis=1)]


def _step(m: Model, sums: dict, rows: np.ndarray, first: np.ndarray, y: np.ndarray, rate: float) -> None:
    e = m.embed[rows].sum(axis=1)
    conv = m.convolved(e, first)
    n, k = len(y), conv.shape[1]
    top, at = np.zeros((n, k)), np.full((n, k), -1)
    for i in range(n):
        if first[i + 1] > first[i]:
            at[i] = conv[first[i]:first[i + 1]].argmax(axis=0) + first[i]
            top[i] = conv[at[i], np.arange(k)]
    h = np.maximum(top + m.rest, 0)
    z = h @ m.out + m.bias
    d = (1 / (1 + np.exp(-z)) - y) / n
    dh = d[:, None] * m.out * (h > 0)
    where = at[:, _FILTER] + _OFFSET
    valid = (at[:, _FILTER] >= 0) & (where < first[1:, None])
    where = np.where(valid, where, 0)
    coef = np.where(valid, dh[:, _FILTER], 0.0)
    de = (coef[:, :, None] * m.filters).reshape(-1, DIMS)
    # each of the three rows of a word gets the word's gradient
    touched, place = np.unique(rows[where.reshape(-1)].reshape(-1), return_inverse=True)
    grad = np.stack([np.bincount(place, np.repeat(de[:, j], 3), len(touched)) for j in range(DIMS)], axis=1)
    for name, g, pick in (("embed", grad, touched), ("filters", np.einsum("nc,ncd->cd", coef, e[where]), slice(None)), ("rest", dh.sum(axis=0), slice(None)), ("out", h.T @ d, slice(None))):
        sums[name][pick] += g * g
        getattr(m, name)[pick] -= rate * g / np.sqrt(sums[name][pick] + 1e-10)
    sums["bias"] += d.sum() ** 2
    m.bias -= rate * d.sum() / np.sqrt(sums["bias"] + 1e-10)


def _apart(x: np.ndarray) -> np.ndarray:
    """Mutually far rows."""
    chosen = [0]
    for _ in range(min(GROUPS, len(x)) - 1):
        chosen.append(int((x @ x[chosen].T).max(axis=1).argmin()))
    return x[chosen]


def _centres(parts: RDD, turns: int = 15) -> np.ndarray:
    """Spherical k-means over an RDD of blocks of unit vectors, from mutually far rows among those of each block."""
    far = np.concatenate(parts.map(lambda x: _apart(x.astype(np.float32))).collect())
    c = _apart(np.unique(far, axis=0))
    for _ in range(turns):
        def near(blocks: Iterator[np.ndarray], c: np.ndarray = c) -> Iterator[tuple[int, np.ndarray]]:
            for x in blocks:
                of = (x.astype(np.float32) @ c.T).argmax(axis=1)
                yield from ((int(g), x[of == g].sum(axis=0, dtype=np.float64)) for g in np.unique(of))
        found = parts.mapPartitions(near).reduceByKey(np.add, 8).collectAsMap()
        new = np.stack([found.get(g, c[g]) for g in range(len(c))])
        new = (new / np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-9)).astype(np.float32)
        if np.allclose(new, c, atol=1e-6):
            break
        c = new
    return c


def _threshold(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Middle of the log-odds gap that gives the best weighted accuracy."""
    order = np.argsort(z)
    z, gain = z[order], np.where(y[order] > 0, -weight[order], weight[order])
    right = np.concatenate([[0], np.cumsum(gain)])  # the first i are called clean
    right[1:-1][z[1:] == z[:-1]] = -np.inf
    best = np.flatnonzero(right >= right.max() - 1e-9)
    i = int(best[len(best) // 2])
    edge = np.concatenate([[z[0] - 2], z, [z[-1] + 2]])
    return float((edge[i] + edge[i + 1]) / 2)


def _read(rows: Iterator[Row], most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Word buckets, first words and labels of some documents at a time."""
    def cut(held: list[Row]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        y, done = np.array([r.y for r in held]), 0
        for texts in T.slices(pa.array([bytes(r.t) for r in held], pa.large_binary()), most):
            words = T.words(texts, T.NOT_LETTER)
            yield buckets(words), words.first, y[done:done + len(texts)]
            done += len(texts)
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r.t)
        if size >= most:
            yield from cut(held)
            held, size = [], 0
    if held:
        yield from cut(held)


def _prior(rows: Iterator[Row]) -> Iterator[tuple[int, np.ndarray]]:
    """For each class: documents with each bucket, and documents, of one shard."""
    n = np.zeros((2, BUCKETS + 1), np.int64)
    for words, first, y in _read(rows):
        doc = np.repeat(np.arange(len(y)), np.diff(first))
        for j in range(3):
            pairs = np.unique(doc * BUCKETS + words[:, j])
            for c in (0, 1):
                n[c, :-1] += np.bincount(pairs[y[pairs // BUCKETS] == c] % BUCKETS, minlength=BUCKETS)
        n[:, -1] += np.bincount(y, minlength=2)
    yield from enumerate(n)


def _started(n: np.ndarray, own: np.ndarray) -> tuple[Model, dict]:
    """The model before training and its sums of squared gradients; ``n`` documents of each class have a bucket, of ``own``."""
    rng = np.random.default_rng(7)
    k = FILTERS * len(WIDTHS)
    m = Model(rng.normal(0, 0.02, (BUCKETS, DIMS)), rng.normal(0, 0.3, (len(_FILTER), DIMS)), np.zeros(k), rng.normal(0.2, 0.05, k), 0.0, np.zeros((1, SHAPE)), np.zeros(1))
    # smoothed log-odds of each bucket by documents, as the first coordinate
    odds = np.log((n[1] + 1) / (own[1] + 2)) - np.log((n[0] + 1) / (own[0] + 2))
    m.embed[:, 0] = 0.3 * odds * (n.sum(axis=0) / (n.sum(axis=0) + 3))
    m.filters[_OFFSET == 0, 0] = 1.0
    m.rest[:] = -0.5
    m.bias = -1.0
    return m, {"embed": np.full((BUCKETS, DIMS), 1e-3), "filters": np.full(m.filters.shape, 1e-3), "rest": np.full(k, 1e-3), "out": np.full(k, 1e-3), "bias": 1e-3}


def _flat(m: Model, sums: dict) -> np.ndarray:
    """All but the embedding as one vector."""
    return np.concatenate([np.ravel(x) for x in (m.filters, m.rest, m.out, m.bias, sums["filters"], sums["rest"], sums["out"], sums["bias"])])


def _moved(m: Model, sums: dict, by: dict[int, np.ndarray]) -> None:
    """Add the mean change of all shards; key -1 holds the vector of ``_flat`` and the number of shards."""
    for part, x in by.items():
        if part >= 0:
            own, touched = slice(part * _PART, (part + 1) * _PART), np.maximum(x[:, -1:], 1)
            m.embed[own] += x[:, :DIMS] / touched
            sums["embed"][own] += x[:, DIMS:-1] / touched
    flat, at = _flat(m, sums) + by[-1][:-1] / by[-1][-1], 0
    for of in (lambda k: getattr(m, k), sums.get):
        for name in ("filters", "rest", "out"):
            x = of(name)
            x[...] = flat[at:at + x.size].reshape(x.shape)
            at += x.size
        if at < len(flat) - 1:
            m.bias = float(flat[at])
        at += 1
    sums["bias"] = float(flat[-1])


def _epoch(shared, epoch: int):
    """One pass over a shard from the common model: its changes, by parts of the embedding."""
    def body(rows: Iterator[Row]) -> Iterator[tuple[int, np.ndarray]]:
        m, sums = copy.deepcopy(shared.value)
        rng, steps = np.random.default_rng(epoch), 0
        for words, first, y in _read(rows):
            for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // BATCH)):
                counts = np.diff(first)[part]
                pick = np.repeat(first[part] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
                _step(m, sums, words[pick], np.concatenate([[0], np.cumsum(counts)]), y[part], 0.1 / (1 + epoch))
                steps += 1
        if steps:
            old, gone = shared.value
            change = np.concatenate([m.embed - old.embed, sums["embed"] - gone["embed"]], axis=1)
            change = np.concatenate([change, change.any(axis=1, keepdims=True)], axis=1).astype(np.float32)
            yield from ((p, change[p * _PART:(p + 1) * _PART]) for p in range(BUCKETS // _PART))
            yield -1, np.append(_flat(m, sums) - _flat(old, gone), 1.0)
    return body


def _thresholds(model: Model, found: dict[tuple[int, int, int], int], share: float) -> np.ndarray:
    """Threshold of each group from the numbers of documents by (group, thousandths of log-odds, label)."""
    shift = np.zeros(len(model.groups))
    if not found:
        return shift
    (group, z, y), n = np.array(list(found)).T, np.array(list(found.values()), float)
    z, p = z / 1000, n[y > 0].sum() / n.sum()
    if 0 < p < 1:
        weight = n * np.where(y > 0, share / p, (1 - share) / (1 - p))
        shift[:] = _threshold(z, y, weight)
        for g in range(len(shift)):
            mine = group == g
            if min(n[mine & (y == c)].sum() for c in (0, 1)) >= 20:
                shift[g] = _threshold(z[mine], y[mine], weight[mine])
    return shift


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", shard: int = SHARD, epochs: int = 6) -> Model | None:
    """Fit on every labelled document; shards of about ``shard`` of them learn side by side."""
    spark = docs.sparkSession
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("i")).agg(F.max(F.when(F.col(label) > 0, 1).otherwise(0)).alias("y"))
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = counts.get(1, 0) / sum(counts.values())
    turn = F.xxhash64(F.col("i").cast("string"))
    texts = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("i"), F.col(text).cast("binary").alias("t"))
    texts = texts.join(known.hint("shuffle_hash"), "i").repartition(-(-sum(counts.values()) // shard), "i", "t")
    # the shuffle's files serve all passes, as all start from this one RDD
    rows = texts.sortWithinPartitions(turn, "i", "t").select("y", (F.pmod(turn, F.lit(5)) == 4).alias("held"), "t").rdd
    own, held = rows.filter(lambda r: not r.held), rows.filter(lambda r: r.held)
    prior = own.mapPartitions(_prior).reduceByKey(np.add, 2).collectAsMap()
    n = np.stack([prior.get(c, np.zeros(BUCKETS + 1, np.int64)) for c in (0, 1)])
    m, sums = _started(n[:, :-1], n[:, -1])
    if not n[:, -1].all():
        if rows.isEmpty():
            return None
        m.out[:] = 0
        m.bias = 1.0 if n[1, -1] or not n[0, -1] and share == 1 else -1.0
        return m
    for epoch in range(epochs):
        shared = spark.sparkContext.broadcast((m, sums))
        _moved(m, sums, own.mapPartitions(_epoch(shared, epoch)).reduceByKey(np.add, 8).collectAsMap())
        shared.destroy()
    shaped = rows.mapPartitions(lambda part: (shapes(words, first).astype(np.float16) for words, first, _ in _read(part))).persist(StorageLevel.DISK_ONLY)
    m.groups = _centres(shaped)
    shaped.unpersist()
    m.embed, m.filters, m.rest, m.out = (x.astype(np.float32) for x in (m.embed, m.filters, m.rest, m.out))
    shared = spark.sparkContext.broadcast(m)

    def judged(part: Iterator[Row]) -> Iterator[tuple[tuple[int, int, int], int]]:
        found = Counter()
        for words, first, y in _read(part):
            z = np.rint(1000 * np.clip(shared.value.log_odds(words, first), -30, 30)).astype(int)
            group = (shapes(words, first) @ shared.value.groups.T).argmax(axis=1)
            found.update(zip(group.tolist(), z.tolist(), y.tolist()))
        yield from found.items()
    m.shift = _thresholds(m, held.mapPartitions(judged).reduceByKey(lambda a, b: a + b, 8).collectAsMap(), share)
    return m


def classify(docs: DataFrame, model: Model | None, text: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with the score ``out``, 0 to 1, 0.5 at the threshold of the text's language group."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def kernel(texts: T.Texts) -> pa.Array:
            if shared.value is None:
                return pa.array(np.full(len(texts), 0.25))
            words = T.words(texts, T.NOT_LETTER)
            return pa.array(1 / (1 + np.exp(-np.clip(shared.value.moved(buckets(words), words.first), -30, 30))))
        return kernel
    return docs.drop(out).withColumn(out, T.column_udf(make, pa.float64(), "double")(F.col(text)))
