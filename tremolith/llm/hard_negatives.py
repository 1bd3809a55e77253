"""Hard negatives by spanning trees of anchors, whose edges bound the scores of their children.

Vectors become integers, a score is their inner product.  Anchors are put in blocks of near ones (ordered by the signs of
fixed projections), and each block gets a least spanning tree, in one task.  A scan over all rows takes a bounded round of
trees: the roots are scored with every candidate, and a child's score lies within that of its parent plus or minus edge
length times norm of the candidate (an inexact parent hands on its whole interval).  Only candidates whose interval
overlaps what the child still looks for are scored again, a level of the trees at a time.  The first scan finds the
positives (same label), the second the negatives within each positive's window (other label).  Each task keeps the best
few of each anchor; these meet in a ranked merge.  Rounds go on until every anchor has had its turn, so each anchor meets
all rows, and neither anchors nor candidates are ever gathered whole.

Rows with a null label, a null vector or null or non-finite entries take no part.  A shorter vector counts as filled up
with zeros.  A row with a null id is a candidate, last among equal scores, but no anchor.  Rows that repeat an id count as
rows of their own: each is an anchor, and a positive of the other if labels are equal.  Scores that may pass 2**53 are
computed with whole numbers; a score beyond long fails with an overflow error.  No rows, no anchors, or anchors without
positives or negatives give no result rows.  Only the id, label and vector columns are read.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from .stage import stage
from .text import seeds

#: Anchors of a block and of a round, and entries of a scan's score matrix.
BLOCK, ROUND, CELLS = 1024, 8192, 1 << 21
_LONG = 2 ** 63 - 1
ROWS = "row long, id long, label long, x array<long>"
FOUND = "anchor long, slot int, far boolean, id long, row long, score long"


def integer_rows(table: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256, labels: Column | None = None) -> DataFrame:
    """``row`` (a number of its own), ``id``, ``label`` and integer vector ``x`` of each row that takes part, written once."""
    entry = lambda c: c.cast("double")
    rows = table.select(F.col(key).cast("long").alias("id"), (F.col(label) if labels is None else labels).cast("long").alias("label"), F.col(vector).alias("v"))
    rows = rows.where("label is not null and v is not null").where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(entry(c)) & (F.abs(entry(c)) < float("inf"))))

    def whole(c):
        c = entry(c) * scale
        return F.when(F.abs(c) < 2.0 ** 62, F.floor(c)).otherwise(c.cast("long"))  # the cast fails beyond long

    return stage(rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", F.transform("v", whole).alias("x")), "negatives-rows")


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list column as doubles or whole numbers, shorter ones filled up with zeros, longer ones cut at ``width``."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    longest = int(sizes.max(initial=0))
    if len(flat) == len(sizes) * longest:
        x = flat.reshape(len(sizes), longest)
    else:
        x = np.zeros((len(sizes), longest), np.int64)
        x[np.arange(longest) < sizes[:, None]] = flat
    if width is None or longest == width:
        return x
    return x[:, :width] if longest > width else np.pad(x, ((0, 0), (0, width - longest)))


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parent (itself for the root, row 0) and edge length of each row in a least spanning tree, one row at a time."""
    n = len(x)
    parent, length, open_ = np.zeros(n, np.int64), np.full(n, np.inf), np.ones(n, bool)
    length[0] = 0
    for _ in range(n):
        at = int(np.argmin(np.where(open_, length, np.inf)))
        open_[at] = False
        away = np.sqrt(np.square(x - x[at]).sum(axis=1))
        nearer = open_ & (away < length)
        parent[nearer], length[nearer] = at, away[nearer]
    return parent, length


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the signs of 16 fixed projections: near anchors mostly share the leading ones."""
    for batch in batches:
        x = matrix(batch.column(3)).astype(np.float64)
        signs = np.stack([x @ np.where(seeds(x.shape[1], k) >> np.uint64(40) & np.uint64(1), 1.0, -1.0) >= 0 for k in range(16)], axis=1)
        yield batch.append_column("sketch", pa.array((signs @ (1 << np.arange(15, -1, -1))).astype(np.int32)))


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of at most ``BLOCK`` anchors of a sorted partition, each with its tree: parent's row, edge and depth."""
    made, block = TaskContext.get().partitionId() << 32, []

    def tree(rows: pa.Table) -> pa.RecordBatch:
        x = matrix(rows.column("x").combine_chunks())
        parent, length = spanning_tree(x.astype(np.float64))
        depth = np.zeros(len(x), np.int32)
        for _ in range(len(x)):
            deeper = np.where(parent == np.arange(len(x)), 0, depth[parent] + 1).astype(np.int32)
            if (deeper == depth).all():
                break
            depth = deeper
        row = rows.column("row").to_numpy()
        out = rows.append_column("block", pa.array(np.full(len(x), made, np.int64))).append_column("parent", pa.array(row[parent])).append_column("edge", pa.array(length)).append_column("depth", pa.array(depth))
        return out.combine_chunks().to_batches()[0]

    for batch in batches:
        while len(batch):
            room = BLOCK - sum(map(len, block))
            block.append(batch.slice(0, room))
            batch = batch.slice(room)
            if sum(map(len, block)) == BLOCK:
                yield tree(pa.Table.from_batches(block))
                made, block = made + 1, []
    if block:
        yield tree(pa.Table.from_batches(block))


def plant(rows: DataFrame, every: int = 50) -> DataFrame:
    """The anchors (ids divisible by ``every``) in blocks, each block a spanning tree, written once."""
    anchors = rows.where(F.col("id") % every == 0)
    n = anchors.count()
    ordered = anchors.mapInArrow(_sketches, f"{ROWS}, sketch int").repartitionByRange(max(1, -(-n // BLOCK)), "sketch", "row").sortWithinPartitions("sketch", "row").drop("sketch")
    return stage(ordered.mapInArrow(_trees, f"{ROWS}, block long, parent long, edge double, depth int"), "negatives-trees")


@dataclass
class Round:
    """A bounded number of trees, their anchors by depth; ``low`` and ``high`` are what each slot of an anchor looks for."""
    row: np.ndarray
    label: np.ndarray
    x: np.ndarray
    parent: np.ndarray
    edge: np.ndarray
    levels: list[tuple[int, int]]
    low: np.ndarray = field(default=None)
    high: np.ndarray = field(default=None)
    size: int = 0  # largest absolute entry


def rounds(trees: DataFrame, most: int = ROUND) -> Iterator[Round]:
    """One after another, each of whole trees with at most ``most`` anchors (or one tree)."""
    groups, held = [], 0
    for r in trees.groupBy("block").count().orderBy("block").collect():  # one row for each block of anchors
        if not groups or held + r["count"] > most:
            groups.append([])
            held = 0
        groups[-1].append(r["block"])
        held += r["count"]
    for blocks in groups:
        own = trees.where(F.col("block").between(blocks[0], blocks[-1])).orderBy("depth", "block", "row").toArrow()
        depth = own.column("depth").to_numpy()
        row = own.column("row").to_numpy()
        order = np.argsort(row)
        parent = order[np.searchsorted(row, own.column("parent").to_numpy(), sorter=order)]
        x = matrix(own.column("x").combine_chunks())
        edges = np.flatnonzero(np.diff(depth, prepend=-1, append=-1))
        yield Round(row, own.column("label").to_numpy(), x, parent, own.column("edge").to_numpy(), list(zip(edges[:-1].tolist(), edges[1:].tolist())), size=int(max(-int(x.min(initial=0)), int(x.max(initial=0)))))


def scores(a: np.ndarray, c: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of anchors and candidates as whole numbers."""
    if exact:
        return (a.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    out = a.astype(object) @ c.astype(object).T
    if out.size and max(abs(v) for v in out.ravel()) > _LONG:
        raise OverflowError("a score is beyond long")
    return out.astype(np.int64)


def best(anchor, slot, far, ids, row, score, k: int) -> np.ndarray:
    """Places of the first ``k`` of each (anchor, slot): falling score, known before unknown ids, rising id."""
    order = np.lexsort((row, ids, far, -score, slot, anchor))
    a, s = anchor[order], slot[order]
    starts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (s[1:] != s[:-1])]) if len(order) else np.empty(0, np.int64)
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[place < k]


class Search:
    """The best ``k`` of each anchor's slots among the candidates of one task."""

    def __init__(self, trees: Round, k: int, same: bool):
        self.t, self.k, self.same = trees, k, same
        self.slots = trees.low.shape[1]
        self.need = trees.low.copy()  # what a further candidate must reach
        self.kept = [np.empty(0, t) for t in (np.int64, np.int64, bool, np.int64, np.int64, np.int64)]
        self.scored = self.met = 0

    def __call__(self, row, ids, far, label, x) -> None:
        t = self.t
        for at in range(0, len(row), step := max(64, CELLS // max(1, len(t.row)))):
            self._part(*(v[at:at + step] for v in (row, ids, far, label, x)))

    def _part(self, row, ids, far, label, x) -> None:
        t = self.t
        size = int(max(-int(x.min(initial=0)), int(x.max(initial=0))))
        exact = size * t.size * max(1, x.shape[1]) < 2 ** 53
        norm = np.sqrt(np.square(x.astype(np.float64)).sum(axis=1))
        low = np.empty((len(t.row), len(row)))
        high = np.empty_like(low)
        want_low, want_high = self.need.min(axis=1), t.high.max(axis=1)
        hits = []
        for first, last in t.levels:
            own = slice(first, last)
            up = t.parent[own]
            if first == 0:
                wanted = np.ones((last - first, len(row)), bool)
            else:
                slack = np.multiply.outer(t.edge[own] * (1 + 1e-9), norm) + 1e-9 * (np.abs(low[up]) + np.abs(high[up])) + 1  # rounding outwards
                low[own], high[own] = low[up] - slack, high[up] + slack
                wanted = (high[own] >= want_low[own, None]) & (low[own] <= want_high[own, None])
            asked = (t.label[own, None] == label) == self.same
            looked = wanted & asked
            if first == 0:
                looked[:] = True  # scores of the roots bound all others
            self.met += looked.size
            # one product for the level where most of it is looked for, else one for each anchor
            union = np.flatnonzero(looked.any(axis=0))
            whole = 2 * np.count_nonzero(looked) >= len(union) * (last - first)
            for rows, columns in [(own, union)] if whole else [(slice(k, k + 1), np.flatnonzero(looked[k - first])) for k in range(first, last)]:
                if not len(columns):
                    continue
                s = scores(t.x[rows], x[columns], exact)
                self.scored += s.size
                low[rows, columns] = high[rows, columns] = s
                fits = asked[rows.start - first:rows.stop - first, columns]
                for slot in range(self.slots):
                    a, c = np.nonzero((s >= self.need[rows, slot, None]) & (s <= t.high[rows, slot, None]) & fits)
                    if len(a):
                        hits.append((a + rows.start, np.full(len(a), slot), columns[c], s[a, c]))
        if not hits:
            return
        a, slot, c, s = (np.concatenate(v) for v in zip(*hits))
        other = t.row[a] != row[c]
        a, slot, c, s = a[other], slot[other], c[other], s[other]
        new = [np.concatenate([old, v]) for old, v in zip(self.kept, (a, slot, far[c], ids[c], row[c], s))]
        a, slot, far, ids, row, s = new
        keep = best(a, slot, far, ids, row, s, self.k)
        self.kept = [v[keep] for v in new]
        # a slot that is full needs at least its last score from now on
        a, slot, s = self.kept[0], self.kept[1], self.kept[5]
        cell = a * self.slots + slot
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.empty(0, np.int64)
        full = starts[np.diff(np.r_[starts, len(cell)]) == self.k]
        self.need[a[full], slot[full]] = s[full + self.k - 1]

    def result(self) -> pa.RecordBatch:
        a, slot, far, ids, row, s = self.kept
        return pa.RecordBatch.from_arrays([pa.array(self.t.row[a]), pa.array(slot.astype(np.int32)), pa.array(far), pa.array(ids), pa.array(row), pa.array(s)], ["anchor", "slot", "far", "id", "row", "score"])


def scan(rows: DataFrame, trees: Round, k: int, same: bool) -> DataFrame:
    """The first ``k`` rows of each anchor's slots over all rows, ranked; ``far`` marks a null id."""
    sent = rows.sparkSession.sparkContext.broadcast(trees)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(sent.value, k, same)
        for batch in batches:
            if len(batch):
                ids = batch.column(1)
                search(batch.column(0).to_numpy(), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), batch.column(2).to_numpy(), matrix(batch.column(3), search.t.x.shape[1]))
        yield search.result()

    first = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "far", "id", "row")
    found = rows.mapInArrow(task, FOUND).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    made = stage(found, "negatives-found")
    sent.unpersist()
    return made


def hard_negatives(rows: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of ``integer_rows``.

    An anchor's positives are its first ``positives`` other rows of its label.  Of each, the first ``negatives`` rows of
    another label whose score is between ``least`` and ``most`` per cent of the positive's are returned.
    """
    spark, parts = rows.sparkSession, []
    trees = plant(rows, every)
    for trees_now in rounds(trees):
        n = len(trees_now.row)
        trees_now.low, trees_now.high = np.full((n, 1), -_LONG), np.full((n, 1), _LONG)
        near = scan(rows, trees_now, positives, True)
        # windows: least * p <= 100 * s <= most * p, at most `positives` whole numbers an anchor of the round
        got = near.select("anchor", "rank", "score").toArrow()
        order = np.argsort(trees_now.row)
        at = order[np.searchsorted(trees_now.row, got.column("anchor").to_numpy(), sorter=order)]
        slot = got.column("rank").to_numpy() - 1
        trees_now.low, trees_now.high = np.full((n, positives), _LONG), np.full((n, positives), -_LONG)
        for a, k, p in zip(at.tolist(), slot.tolist(), got.column("score").to_pylist()):
            trees_now.low[a, k], trees_now.high[a, k] = -(-least * p // 100), most * p // 100
        far = scan(rows, trees_now, negatives, False)
        parts.append(near.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("id").alias("p"), F.col("far").alias("p_far"), F.col("score").alias("positive_score"))
                     .join(far.select("anchor", "slot", "rank", F.when(~F.col("far"), F.col("id")).alias("negative_id"), F.col("score").alias("negative_score")), ["anchor", "slot"]))
    if not parts:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    made = functools.reduce(DataFrame.unionByName, parts)
    anchors = trees.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return made.join(anchors, "anchor").select("anchor_id", F.when(~F.col("p_far"), F.col("p")).alias("positive_id"), "rank", "negative_id", "positive_score", "negative_score")


SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda e: floor(256 * e::double)) as x
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda e: e is null or isnan(e) or isinf(e))) = 0
), s as (
  select a.vec_id as anchor_id, c.vec_id as id, c.label = a.label as same, list_dot_product(a.x, c.x)::bigint as score
  from v a, v c where a.vec_id % 50 = 0 and a.vec_id <> c.vec_id
), p as (
  select anchor_id, id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5
)
select p.anchor_id, p.positive_id, row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.id)::int as rank,
       s.id as negative_id, p.positive_score, s.score as negative_score
from p join s on s.anchor_id = p.anchor_id and not s.same and 50 * p.positive_score <= 100 * s.score and 100 * s.score <= 95 * p.positive_score
qualify rank <= 3
"""
