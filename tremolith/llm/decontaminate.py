"""Benchmark decontamination: Wu-Manber multi-pattern search over word hashes.

All windows of ``n`` consecutive benchmark words are searched in each text at once.  A block is two neighbouring words.
The shift table tells, for the block that ends at a position, how far the next possible end of a window lies at least;
a shift of zero leads to the bucket of windows with that last block, and every word of each is compared, as bytes.
A text is cut into lanes of positions that move on together, so one NumPy step serves many positions.

An item with fewer than ``n`` words is one window; one with a null id is named ``None``.  Null or wordless texts and items have no windows and never hit.
Repeated rows are judged alike, each on its own; an empty benchmark or document table gives no hits or no rows.
The benchmark is a stated query set: it is searched in blocks of at most ``block_bytes`` of text, one scan each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import text as T
from .stage import stage

LANE = 256
_TABLE = 1 << 20
_PAIR = T.seeds(2, 5)
SPANS = "struct<n_words:bigint,spans:array<struct<a:bigint,b:bigint>>,items:array<string>>"
_KIND = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), ("items", pa.list_(pa.string()))])


def _blocks(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of the block that ends at each word (of one word where windows have one)."""
    out = hashes * _PAIR[1]
    if width == 2:
        out[1:] += hashes[:-1] * _PAIR[0]
    return T.mix(out)


def _ramp(counts: np.ndarray) -> np.ndarray:
    """0, 1, … for each count, one after another."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _same(a: T.Words, i: np.ndarray, b: T.Words, j: np.ndarray) -> np.ndarray:
    """Whether words ``i`` of ``a`` are words ``j`` of ``b``, byte by byte, about 4 MB at a time."""
    size = a.ends[i] - a.starts[i]
    same = size == b.ends[j] - b.starts[j]
    open_ = np.flatnonzero(same)
    total, at = np.concatenate([[0], np.cumsum(size[open_])]), 0
    while at < len(open_):
        end = max(at + 1, int(np.searchsorted(total, total[at] + (1 << 22), side="right")) - 1)
        own = open_[at:end]
        n = size[own]
        inside = _ramp(n)
        differs = a.data[np.repeat(a.starts[i[own]], n) + inside] != b.data[np.repeat(b.starts[j[own]], n) + inside]
        same[own] = np.add.reduceat(differs, np.cumsum(n) - n, dtype=np.int64) == 0
        at = end
    return same


class Patterns:
    """Tables for windows of one length: shifts by block, distinct windows sorted by last block, their items."""

    def __init__(self, length: int, words: T.Words, hashes: np.ndarray, starts: np.ndarray, item: np.ndarray):
        """``starts`` are the first words of the windows in ``words``, ``item`` the number of the item of each."""
        self.length, self.width, self.words = length, min(2, length), words
        key = np.zeros(len(starts), np.uint64)
        for j, weight in enumerate(T.seeds(length, 6)):
            key += hashes[starts + j] * weight
        order = np.argsort(key, kind="stable")
        key, starts, item = key[order], starts[order], item[order]
        # neighbours of one key are one window if their words agree; a clash of keys only splits a window in two
        twin = np.flatnonzero(key[1:] == key[:-1])
        for j in range(length):
            ok = _same(words, starts[twin] + j, words, starts[twin + 1] + j)
            twin = twin[ok]
        fresh = np.ones(len(starts), bool)
        fresh[twin + 1] = False
        group = np.cumsum(fresh) - 1
        starts = starts[fresh]
        block = self._block(hashes, starts + length - 1)
        order = np.argsort(block, kind="stable")
        self.starts, self.last, self.head = starts[order], block[order], hashes[starts[order]]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        many = int(item.max()) + 1
        owner = np.unique(place[group] * many + item)
        self.item_first, self.item = np.searchsorted(owner, np.arange(len(starts) + 1) * many), owner % many
        self.shift = np.full(_TABLE, length - self.width + 1, np.int16)
        for end in range(self.width - 1, length):
            at = (self._block(hashes, starts + end) & np.uint64(_TABLE - 1)).astype(np.int64)
            self.shift[at] = np.minimum(self.shift[at], length - 1 - end)

    def _block(self, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        return T.mix(hashes[at] * _PAIR[1] + (hashes[at - 1] * _PAIR[0] if self.width == 2 else np.uint64(0)))

    def ends(self, blocks: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Positions whose block ends some window, by shifts."""
        counts = np.maximum(np.diff(first) - self.length + 1, 0)
        lanes = -(-counts // LANE)
        row = np.repeat(np.arange(len(counts)), lanes)
        at = first[row] + self.length - 1 + _ramp(lanes) * LANE
        stop = np.minimum(at + LANE, first[row + 1])
        ends = [np.empty(0, np.int64)]
        while len(at):
            step = self.shift[(blocks[at] & np.uint64(_TABLE - 1)).astype(np.int64)].astype(np.int64)
            ends.append(at[step == 0])
            at = at + np.maximum(step, 1)
            more = at < stop
            at, stop = at[more], stop[more]
        return np.concatenate(ends)

    def found(self, words: T.Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of confirmed occurrences and their window.  Buckets are opened about a million candidates at a time."""
        blocks = _blocks(hashes, self.width)
        ends = self.ends(blocks, words.first)
        low, high = np.searchsorted(self.last, blocks[ends]), np.searchsorted(self.last, blocks[ends], side="right")
        total, at, out = np.concatenate([[0], np.cumsum(high - low)]), 0, [(np.empty(0, np.int64), np.empty(0, np.int64))]
        while at < len(ends):
            stop = max(at + 1, int(np.searchsorted(total, total[at] + (1 << 20), side="right")) - 1)
            n = high[at:stop] - low[at:stop]
            starts, which = np.repeat(ends[at:stop], n) - self.length + 1, np.repeat(low[at:stop], n) + _ramp(n)
            ok = hashes[starts] == self.head[which]
            starts, which = starts[ok], which[ok]
            for j in range(self.length):
                ok = _same(words, starts + j, self.words, self.starts[which] + j)
                starts, which = starts[ok], which[ok]
            out.append((starts, which))
            at = stop
        return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def build(items: list[tuple[object, str | None]], n: int) -> tuple[list[str], list[Patterns]]:
    """Sorted item names, and the pattern tables of benchmark items (id, text), one per window length."""
    names = sorted({str(i) for i, _ in items})
    number = {x: k for k, x in enumerate(names)}
    parts, hashes, read, seen = [], [np.empty(0, np.uint64)], 0, 0
    for s in T.slices(pa.array([body for _, body in items], pa.string())):
        w = T.words(s, T.NOT_ALNUM)
        hashes.append(w.hashes())
        parts.append((w.data, w.starts + read, w.ends + read, w.first[:-1] + seen))
        read, seen = read + len(w.data), seen + len(w)
    if not seen:
        return names, []
    data, starts, ends, first = (np.concatenate(x) for x in zip(*parts))
    words, hashes = T.Words(data, starts, ends, np.append(first, seen)), np.concatenate(hashes)
    del parts
    own, item = words.per_row, np.array([number[str(i)] for i, _ in items])
    size, made = np.minimum(n, own), []
    for k in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == k)
        windows = own[rows] - k + 1
        made.append(Patterns(k, words, hashes, np.repeat(words.first[rows], windows) + _ramp(windows), np.repeat(item[rows], windows)))
    return names, made


def _search(tables: tuple[list[str], list[Patterns]]):
    names, patterns = pa.array(tables[0], pa.string()), tables[1]

    def kernel(texts: T.Texts) -> pa.Array:
        words = T.words(texts, T.NOT_ALNUM)
        hashes, cover, hits = words.hashes(), np.zeros(len(words) + 1, np.int64), [np.empty((0, 2), np.int64)]
        for p in patterns:
            starts, which = p.found(words, hashes)
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + p.length, -1)
            once = np.unique(np.stack([np.searchsorted(words.first, starts, side="right") - 1, which], axis=1), axis=0)
            n = p.item_first[once[:, 1] + 1] - p.item_first[once[:, 1]]
            item = p.item[np.repeat(p.item_first[once[:, 1]], n) + _ramp(n)]
            hits.append(np.unique(np.stack([np.repeat(once[:, 0], n), item], axis=1), axis=0))
        hit = np.concatenate([[False], np.cumsum(cover)[:-1] > 0, [False]])
        a, b = np.flatnonzero(hit[1:] & ~hit[:-1]), np.flatnonzero(hit[:-1] & ~hit[1:])
        # a run never joins the words of two rows: it is cut where a row ends
        inner = words.first[1:-1]
        inner = np.unique(inner[(inner > 0) & (inner < len(words))])
        inner = inner[hit[inner] & hit[inner + 1]]
        a, b = np.sort(np.concatenate([a, inner])), np.sort(np.concatenate([b, inner]))
        row = np.searchsorted(words.first, a, side="right") - 1
        spans = pa.StructArray.from_arrays([pa.array(a - words.first[row]), pa.array(b - words.first[row])], ["a", "b"])
        per = np.bincount(row, minlength=len(texts))
        spans = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)), spans)
        found = np.unique(np.concatenate(hits), axis=0)
        per = np.bincount(found[:, 0], minlength=len(texts))
        found = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)), names.take(pa.array(found[:, 1])))
        return T.struct(n_words=words.per_row.astype(np.int64), spans=spans, items=found)
    return kernel


def _covered(spans: Column) -> Column:
    """Words in the union of sorted spans."""
    step = lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), s["b"] - F.greatest(s["a"], acc["to"]))).alias("n"), F.greatest(acc["to"], s["b"]).alias("to"))
    return F.aggregate(F.array_sort(spans), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")), step)["n"]


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 13,
                  block_bytes: int = 8 << 20, out: str = "contamination") -> DataFrame:
    """``docs`` with a struct ``out``: n_words, hit spans (in words), n_hit, items found (ids as strings), n_items.

    A column of that name in ``docs`` is replaced; other columns stay as they are.
    """
    size = benchmark.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    items = benchmark.select(F.col(item_id).alias("i"), F.col(item_text).alias("t"))
    found = docs.drop(out)
    for k in range(blocks):
        # at most about block_bytes reach the driver at once
        block = items.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == k).collect() if blocks > 1 else items.collect()
        tables = docs.sparkSession.sparkContext.broadcast(build([(r.i, r.t) for r in block], n))
        new = T.column_udf(lambda tables=tables: _search(tables.value), _KIND, SPANS)(F.col(text))
        if k:
            found = stage(found, "decontaminate").withColumn("__new", new)
            old = F.col(out)
            found = found.withColumn(out, F.struct(old["n_words"].alias("n_words"), F.concat(old["spans"], F.col("__new")["spans"]).alias("spans"), F.array_union(old["items"], F.col("__new")["items"]).alias("items"))).drop("__new")
        else:
            found = found.withColumn(out, new)
    found_items = F.array_sort(F.col(out)["items"])
    return found.withColumn(out, F.struct(F.col(out)["n_words"].alias("n_words"), F.col(out)["spans"].alias("spans"), _covered(F.col(out)["spans"]).alias("n_hit"),
                                          found_items.alias("items"), F.size(found_items).cast("long").alias("n_items")))


def contaminated(out: str = "contamination") -> Column:
    """The contract's rule: some word is hit, and the hits are a twentieth of the words at least."""
    c = F.col(out)
    return (c["n_hit"] > 0) & (20 * c["n_hit"] >= c["n_words"])



#: The contract's result as DuckDB SQL over documents and benchmark.
SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
p as (select distinct item_id, k, array_to_string(w[i:i + k - 1], ' ') as s from (select item_id, w, least(13, len(w)) as k, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from b where len(w) > 0)),
n as (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, (select distinct k from p) where len(w) >= k),
o as (select n.doc_id, n.i, n.k, p.item_id from n join p on p.k = n.k and p.s = array_to_string(n.w[n.i:n.i + n.k - 1], ' ')),
h as (select doc_id, count(distinct place) as n_hit from (select doc_id, unnest(range(i, i + k)) as place from o) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(x, ',' order by x) as items from (select distinct doc_id, cast(item_id as varchar) as x from o) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join h using (doc_id) left join t using (doc_id)"""
