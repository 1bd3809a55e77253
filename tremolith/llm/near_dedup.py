"""MinHash near-duplicates by a multi-index Hamming join that loses no pair under the signature-distance threshold.

A text's set is its distinct ``k``-word shingles.  Its signature has 64 symbols of 16 bits, one per MinHash function; two
sets with Jaccard similarity J differ in about 64 (1 - J) symbols.  The threshold D is the least distance that a pair at
the wanted similarity exceeds with a chance below one in a million.  The symbols are cut into D // 2 + 1 chunks: of D
errors some chunk has one at most, so each chunk is indexed once for each of its symbols left out, and all pairs within D
meet under some key.  Links are confirmed on full sets, recomputed from the texts.

No pair of a bucket is listed as long as a cheaper one may do: equal sets are one class from the start; rounds link the
classes of a bucket with one pivot each and merge components.  What is then still apart is bounded exactly: shingles that
no other candidate has can't be in an intersection, so a class whose shared shingles are too few for any partner in its
bucket leaves it.  Last, the classes that buckets still tie together form clusters, and those outside a cluster's main
component are compared with all of it, block against block, by one matrix product a pair of blocks; links come out, pairs
do not.  Links, components and signatures stay distributed and are written to the shared
folder between rounds.

Defined cases: A text with fewer than ``k`` words has one shingle, all its words; null, empty or blank texts have none and
link with nothing, so they stand alone.  A null id can't be pointed at: such a row gets no component and is kept.  Rows
that repeat an id are one document and should repeat its text; each keeps its own row in the result.  Repeated rows and
exact copies share a component.  Only id and text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import text as T
from .stage import stage

SYMBOLS = 64
_A, _B = T.seeds(SYMBOLS, 21), T.seeds(SYMBOLS, 22)
_PLACE, _TAG = T.seeds(SYMBOLS, 23), T.seeds(SYMBOLS, 24)
_SIGNED = pa.struct([("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("sig", pa.binary())])


def threshold(similarity: float, miss: float = 1e-6) -> int:
    """Least D with P(Binomial(SYMBOLS, 1 - similarity) > D) <= miss."""
    q, over = 1 - similarity, 1.0
    for d in range(SYMBOLS + 1):
        over -= comb(SYMBOLS, d) * q ** d * similarity ** (SYMBOLS - d)
        if over <= miss:
            return d
    return SYMBOLS


def shingles(texts: T.Texts, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    words = T.words(texts)
    hashes, n = words.keys(), len(words)
    weight = T.seeds(k, 31)
    runs = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k):
        runs += hashes[j:n - k + 1 + j] * weight[j] if n >= k else 0
    runs = T.mix(runs)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= k:
            yield np.unique(runs[a:b - k + 1])
        elif b > a:
            yield T.mix((hashes[a:b] * weight[:b - a]).sum(keepdims=True) + np.uint64(b - a))
        else:
            yield np.empty(0, np.uint64)


def signature(own: np.ndarray) -> np.ndarray:
    low = np.full(SYMBOLS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(own), 4096):
        np.minimum(low, (own[at:at + 4096, None] * _A + _B).min(axis=0), out=low)
    return (T.mix(low) >> np.uint64(48)).astype(np.uint16)


def _sign(k: int):
    def kernel(texts: T.Texts) -> pa.Array:
        n, a, b, sig = [], [], [], []
        for own in shingles(texts, k):
            n.append(len(own))
            a.append(own.sum(dtype=np.uint64))
            b.append(T.mix(own).sum(dtype=np.uint64))
            sig.append(signature(own).tobytes() if len(own) else None)
        return T.struct(n=np.array(n, np.int64), a=np.array(a, np.uint64).view(np.int64), b=np.array(b, np.uint64).view(np.int64), sig=pa.array(sig, pa.binary()))
    return kernel


def _symbols(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SYMBOLS)


def keys_of(d: int):
    """Column function: the keys of a signature, one per symbol left out of its chunk."""
    bounds = np.linspace(0, SYMBOLS, d // 2 + 2).astype(int)
    chunk = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))

    def body(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            sym = _symbols(column).astype(np.uint64) * _PLACE
            whole = np.add.reduceat(sym, bounds[:-1], axis=1)
            keys = T.mix(whole[:, chunk] - sym + _TAG).view(np.int64)
            yield T.lists(keys.reshape(-1), np.full(len(column), SYMBOLS)).cast(pa.list_(pa.int64()))
    return F.arrow_udf(body, "array<bigint>")


def _distance(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for a, b in batches:
        yield pa.array((_symbols(a) != _symbols(b)).sum(axis=1).astype(np.int32))


def _alike(k: int, percent: int):
    def body(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        def sets(column):
            return (x for s in T.slices(column) for x in shingles(s, k))
        for a, b in batches:
            out = []
            for x, y in zip(sets(a), sets(b)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append(100 * both >= percent * (len(x) + len(y) - both))
            T.release()
            yield pa.array(out, pa.bool_())
    return F.arrow_udf(body, "boolean")


LOCAL_LINKS = 1 << 16


def _least_reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    links = pa.Table.from_batches(got)
    nodes, at = np.unique(np.concatenate([links["u"].to_numpy(), links["v"].to_numpy()]), return_inverse=True)
    u, v, label = at[:len(links)], at[len(links):], np.arange(len(nodes))
    while True:
        low, closer = np.minimum(label[u], label[v]), label.copy()
        for side in (u, v, label[u], label[v]):
            np.minimum.at(closer, side, low)
        closer = closer[closer]
        if (closer == label).all():
            break
        label = closer
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "label"])


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every linked node: the least node it reaches.  ``links`` has columns u, v.

    Up to ``LOCAL_LINKS`` distinct links are followed in one task and their labels broadcast to joins; more take distributed rounds.
    """
    own = stage(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    if own.count() <= LOCAL_LINKS:
        kind = own.schema["u"].dataType.simpleString()
        return F.broadcast(stage(own.coalesce(1).mapInArrow(_least_reached, f"node {kind}, label {kind}"), "labels"))
    both = own.union(own.select("v", "u"))
    labels = stage(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        closer = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        far = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = stage(closer.join(far, "label").select("node", "old", F.least("label", "further").alias("label")), "labels")
        labels = moved.select("node", "label")
        if moved.where("old <> label").isEmpty():
            return labels


def _shingle_lists(k: int):
    def kernel(texts: T.Texts) -> pa.Array:
        own = list(shingles(texts, k))
        return T.lists(np.concatenate(own).view(np.int64), np.array([len(x) for x in own]))
    return T.column_udf(lambda: kernel, pa.list_(pa.int64()), "array<bigint>")


BLOCK = 1 << 16  # shingles


def _block_links(percent: int):
    """Links between the sets of two blocks whose components differ, one for each set and component of the other side."""
    def counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        both = np.intersect1d(np.concatenate(a), np.concatenate(b))
        out = np.zeros((len(a), len(b)), np.float32)
        place = [[np.searchsorted(both, x[np.isin(x, both, assume_unique=True)]) for x in side] for side in (a, b)]
        for at in range(0, len(both), 2048):
            dense = []
            for side in place:
                m = np.zeros((len(side), min(2048, len(both) - at)), np.float32)
                for i, x in enumerate(side):
                    m[i, x[np.searchsorted(x, at):np.searchsorted(x, at + 2048)] - at] = 1
                dense.append(m)
            out += dense[0] @ dense[1].T
        return out

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                side = []
                for name in ("left", "right"):
                    own = batch.column(name)[row].values
                    lists = own.field("s")
                    ends = lists.offsets.to_numpy()
                    flat = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
                    side.append((own.field("rep").to_numpy(zero_copy_only=False), own.field("comp").to_numpy(zero_copy_only=False), [np.sort(flat[a:b]) for a, b in zip(ends, ends[1:])]))
                (ra, ca, a), (rb, cb, b) = side
                n = counts(a, b)
                union = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b]) - n
                i, j = np.nonzero((100 * n >= percent * union) & (ca[:, None] != cb))
                _, once = np.unique(np.stack([ra[i], cb[j]], axis=1), axis=0, return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(x[once]) for x in (ra[i], rb[j], ca[i], cb[j])], ["u", "v", "cu", "cv"])
    return body


class _Join:
    """The state of one run: texts and signatures of candidates, their components, buckets that are still mixed."""

    def __init__(self, cands: DataFrame, buckets: DataFrame, d: int, k: int, percent: int):
        self.cands, self.buckets, self.d, self.k, self.percent = cands, buckets, d, k, percent
        self.comp = cands.select("rep", F.col("rep").alias("comp"))

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Pairs (u, v) of classes whose sets are alike, with all their columns."""
        light = self.cands.select("rep", "n", "sig")
        side = lambda df, x: df.select([F.col(c).alias(x if c == "rep" else f"{c}_{x}") for c in df.columns])
        near = pairs.join(side(light, "u"), "u").join(side(light, "v"), "v")
        near = near.where(100 * F.least("n_u", "n_v") >= self.percent * F.greatest("n_u", "n_v"))
        near = stage(near.withColumn("d", F.arrow_udf(_distance, "int")("sig_u", "sig_v")).where(F.col("d") <= self.d).select(pairs.columns), "near")
        texts = self.cands.select("rep", "text")
        whole = near.join(side(texts, "u"), "u").join(side(texts, "v"), "v")
        return stage(whole.withColumn("same", _alike(self.k, self.percent)("text_u", "text_v")).where("same").select(pairs.columns), "confirmed")

    def merge(self, links: DataFrame) -> bool:
        """Join the components that ``links`` (of components cu and cv) touch; False if there is none."""
        if links.isEmpty():
            return False
        moved = components(links.select(F.col("cu").alias("u"), F.col("cv").alias("v"))).withColumnRenamed("node", "comp")
        anew = lambda df: df.join(moved, "comp", "left").withColumn("comp", F.coalesce("label", "comp")).select(df.columns)
        self.comp = stage(anew(self.comp), "components")
        # buckets with one component have nothing left to find
        self.buckets = stage(self.mixed(anew(self.buckets)), "buckets")
        return True

    @staticmethod
    def mixed(buckets: DataFrame) -> DataFrame:
        apart = buckets.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
        return buckets.join(apart, "key", "left_semi")

    def fits(self, n: Column, m: Column, n2: Column, m2: Column) -> Column:
        """Whether sets of n and n2 shingles, m and m2 of them shared with anyone, may be alike."""
        most = F.least(m, m2)
        return 100 * most >= self.percent * (n + n2 - most)

    def prune(self) -> None:
        """Adds n and m (shingles that another candidate has) to the buckets; who fits no one in a bucket leaves it."""
        texts = self.cands.join(self.buckets.select("rep").distinct(), "rep", "left_semi")
        each = texts.select("rep", "n", F.explode(_shingle_lists(self.k)("text")).alias("s"))
        shared = each.groupBy("s").agg(F.count("*").alias("c")).where("c > 1").select("s")
        counts = stage(each.join(shared, "s", "left_semi").groupBy("rep", "n").agg(F.count("*").alias("m")), "shared")
        own = self.buckets.join(counts, "rep").where(100 * F.col("m") >= self.percent * F.col("n"))
        small = own.groupBy("key").agg(F.min("n").alias("least"))
        fit = own.join(small, "key").where(self.fits(F.col("n"), F.col("m"), F.col("least"), F.col("m"))).drop("least")
        self.buckets = stage(self.mixed(fit), "buckets")

    def pivot_round(self, nth: int) -> int:
        """Links each class of a bucket with the bucket's pivot; how many links that gave."""
        # the least class first, then another one for each bucket and round
        turn = F.col("rep") if nth == 0 else F.xxhash64("rep", "key", F.lit(nth))
        own = self.buckets
        pivots = own.groupBy("key").agg(F.min_by(F.struct("rep", "comp"), turn).alias("p")).select("key", F.col("p.rep").alias("p"), F.col("p.comp").alias("pc"))
        met = own.join(pivots, "key").where("comp <> pc").select(F.least("rep", "p").alias("u"), F.greatest("rep", "p").alias("v"), F.least("comp", "pc").alias("cu"), F.greatest("comp", "pc").alias("cv"))
        pairs = met.distinct()
        links = self.confirmed(pairs)
        return links.count() if self.merge(links) else 0

    def rest(self) -> None:
        """Whatever shares a bucket and may be alike, across components: clusters of such classes, in blocks."""
        own = self.buckets
        if own.isEmpty():
            return
        ties = own.join(own.groupBy("key").agg(F.min("rep").alias("u")), "key").where("rep <> u").select("u", F.col("rep").alias("v"))
        each = stage(own.select("rep", "comp", "n").distinct().join(components(ties).select(F.col("node").alias("rep"), F.col("label").alias("cluster")), "rep"), "clusters")
        counts = each.groupBy("cluster", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
        size = counts.groupBy("cluster").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
        sets = self.cands.select("rep", _shingle_lists(self.k)("text").alias("s"))
        whole = each.join(size, "cluster").join(sets, "rep").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        whole = stage(whole.select("cluster", "block", "blocks", F.struct("rep", "comp", "s").alias("x"), (F.col("comp") != F.col("main")).alias("out")), "blocks")
        left = whole.where("out").groupBy("cluster", "block", "blocks").agg(F.collect_list("x").alias("left")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        right = whole.groupBy("cluster", F.col("block").alias("other")).agg(F.collect_list("x").alias("right"))
        self.merge(stage(left.join(right, ["cluster", "other"]).select("left", "right").mapInArrow(_block_links(self.percent), "u long, v long, cu long, cv long"), "links"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents with 100 * intersection >= ``percent`` * union of their ``k``-word shingle sets are linked.
    """
    d = threshold(percent / 100)
    base = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    sign = T.column_udf(lambda: _sign(k), _SIGNED, "struct<n:bigint,a:bigint,b:bigint,sig:binary>")
    signed = stage(base.withColumn("s", sign("text")).select("id", "s.*"), "signed")
    classes = stage(signed.where("n > 0 and id is not null").groupBy("n", "a", "b").agg(F.min(F.struct("id", "sig")).alias("m")).select("n", "a", "b", F.col("m.id").alias("rep"), F.col("m.sig").alias("sig")), "classes")
    keyed = classes.select("rep", F.explode(keys_of(d)("sig")).alias("key"))
    shared = keyed.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("key")
    buckets = stage(keyed.join(shared, "key", "left_semi").select("key", "rep", F.col("rep").alias("comp")), "buckets")
    involved = classes.join(buckets.select("rep").distinct(), "rep", "left_semi").select("rep", "n", "sig")
    cands = stage(involved.join(base, involved["rep"] == base["id"]).drop("id").dropDuplicates(["rep"]), "candidates")
    run = _Join(cands, buckets, d, k, percent)
    run.pivot_round(0)
    run.prune()
    nth = 1
    # rounds as long as they merge a good part of what is apart; the rest is compared whatever it is
    while not run.buckets.isEmpty() and 50 * run.pivot_round(nth) > run.buckets.select("rep").distinct().count():
        nth += 1
    run.rest()
    found = signed.join(classes.select("n", "a", "b", "rep"), ["n", "a", "b"], "left").join(run.comp, "rep", "left")
    comp = F.when(F.col("id").isNotNull(), F.coalesce("comp", "rep", "id"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(F.col("id") == comp, F.lit(True)).alias("kept"))
