"""Language-model scores by prediction by partial matching, pretrained on the corpus itself.

Text is lower-cased (A-Z) and read as words, each closed by a blank, with one more blank as end mark.  Every byte of every
text, of training texts as of others, is predicted by byte contexts that run across word ends: from the longest known context
of up to ``ORDER`` bytes (blanks precede a text) down to none, an unseen byte escapes with T / 2N (N counts, T kinds of bytes
seen in the context) and a seen one has (2c - 1) / 2N, symbols of longer contexts are excluded from shorter ones, and the
last resort is uniform over the bytes left.  The contexts are learnt from all words of all training texts.

Counts cover all training texts and are made by Spark.  What is broadcast is bounded by parameters: ``FREQUENT`` words (for
the base score) and about ``MOST_GRAMS`` entries of the contexts seen most.  Nothing is cut by it: words and contexts
beyond are joined.  A byte whose longest context is broadcast has all shorter ones there too; every other one is looked up,
once for each distinct gram, in the table of all contexts.

``base_score`` is the add-one unigram score of the same tokens.  Null texts count as empty and hold the end mark only.
Without training texts every byte is uniform.  Rows with a null id are scored and not learnt from.  Repeated rows are
scored alike.  Other columns are dropped, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from . import text as T
from .stage import stage

ORDER, FREQUENT, MOST_GRAMS = 5, 1 << 17, 1 << 21
_HELD = 1 << 20  # distinct grams that a counting task holds before it hands them on
_BYTES = [np.uint64((1 << 8 * k) - 1) for k in range(ORDER + 2)]
_ORDERS = [np.uint64(k << 56) for k in range(ORDER + 1)]


def written(words: T.Words) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each row's words, a blank after each word, and the length of each row."""
    n = words.ends - words.starts
    out = np.full(int(n.sum()) + len(n), 0x20, np.uint8)
    inner = np.repeat(words.starts - np.cumsum(n) + n, n) + np.arange(n.sum())
    out[np.arange(n.sum()) + np.repeat(np.arange(len(n)), n)] = words.data[inner]
    return out, T.sums(n + 1, words.first)


def spelled(data: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte and the closing blank of each sequence: it and the ``ORDER`` bytes before as a number; the sequence."""
    which = np.repeat(np.arange(len(n)), n + 1)
    stream = np.full(len(data) + len(n) * (ORDER + 1) + ORDER, 0x20, np.uint64)
    inner = np.arange(len(data)) + np.repeat(np.arange(len(n)), n) * (ORDER + 1) + ORDER
    stream[inner] = data
    at = np.arange(len(which)) + which * ORDER + ORDER
    gram = stream[at]
    for k in range(1, ORDER + 1):
        gram |= stream[at - k] << np.uint64(8 * k)
    return gram, which


@dataclass
class Trie:
    gram: np.ndarray     # sorted hashes of (context, symbol)
    count: np.ndarray
    node: np.ndarray     # sorted hashes of contexts
    total: np.ndarray    # N
    kinds: np.ndarray    # T
    below: np.ndarray    # counts that the symbols of a context have in the next shorter context

    whole: bool          # nothing is left out

    def logs(self, data: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log10 probability of each sequence's bytes and its end, by these contexts alone."""
        gram, which = spelled(data, n)
        return np.bincount(which, self.grams(gram)[0], len(n))

    def grams(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of the last byte of each gram, and whether contexts left out may change it."""
        out = np.zeros(len(gram))
        left, seen_n, seen_t = np.arange(len(gram)), np.zeros(len(gram)), np.zeros(len(gram))
        unsure = np.full(len(gram), not self.whole)
        for k in range(ORDER, -1, -1):
            if not len(self.node):
                break
            c = (gram[left] >> np.uint64(8)) & _BYTES[k] | _ORDERS[k]
            at = np.minimum(np.searchsorted(self.node, c), len(self.node) - 1)
            known = self.node[at] == c
            if k == ORDER:
                unsure &= ~known
            g = gram[left] & _BYTES[k + 1] | _ORDERS[k]
            found = np.minimum(np.searchsorted(self.gram, g), len(self.gram) - 1)
            hit = known & (self.gram[found] == g)
            n_left, t_left = np.where(known, self.total[at], 0) - seen_n, np.where(known, self.kinds[at], 0) - seen_t
            out[left[hit]] += np.log10((2 * self.count[found[hit]] - 1) / (2 * n_left[hit]))
            escape = known & ~hit & (t_left > 0)
            out[left[escape]] += np.log10(t_left[escape] / (2 * n_left[escape]))
            seen_n, seen_t = np.where(known, self.below[at], 0)[~hit], np.where(known, self.kinds[at], 0)[~hit]
            left = left[~hit]
        out[left] -= np.log10(np.maximum(257 - seen_t, 1))
        return out, unsure


@dataclass
class Model:
    tokens: int          # N of the contract, ends included
    kinds: int           # V
    ends: int
    word: np.ndarray     # sorted hashes of frequent words
    count: np.ndarray
    trie: Trie


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [T.words(texts).keys() for texts in T.slices(batch.column(0))]
        if own:
            h, n = np.unique(np.concatenate(own), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])


def corpus_counts(texts: DataFrame) -> DataFrame:
    """(h, c) of every distinct word of a one-column table."""
    return texts.mapInArrow(_count, "h long, n long").groupBy("h").agg(F.sum("n").alias("c"))


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    g, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for batch in batches:
        for texts in T.slices(batch.column(0)):
            own, count = np.unique(spelled(*written(T.words(texts)))[0], return_counts=True)
            both, which = np.unique(np.concatenate([g, own]), return_inverse=True)
            g, n = both, np.bincount(which, np.concatenate([n, count]), len(both)).astype(np.int64)
            if len(g) > _HELD:
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(n)], ["g", "n"])
                g, n = g[:0], n[:0]
        T.release()
    yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(n)], ["g", "n"])


def context_table(texts: DataFrame) -> DataFrame:
    """(k, ctx, total, kinds, next) of every context of k bytes of a one-column table; ``next`` holds count * 256 + byte."""
    grams = stage(texts.mapInArrow(_grams, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")), "grams")
    levels = [grams]
    for k in range(ORDER - 1, -1, -1):
        levels.append(stage(levels[-1].groupBy(F.col("g").bitwiseAND((1 << 8 * (k + 1)) - 1).alias("g")).agg(F.sum("n").alias("n")), "grams"))
    nodes = [level.groupBy(F.shiftright("g", 8).alias("ctx")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.collect_list(F.shiftleft("n", 8).bitwiseOR(F.col("g").bitwiseAND(255))).alias("next"))
             .select(F.lit(ORDER - i).alias("k"), "ctx", "total", "kinds", "next") for i, level in enumerate(levels)]
    return stage(reduce(DataFrame.unionByName, nodes), "contexts")


def build_trie(nodes: DataFrame, most: int) -> Trie:
    """Contexts of ``context_table`` from a power-of-two count on, the least with which they have at most ``most`` entries."""
    by_size = nodes.groupBy(F.floor(F.log2("total")).cast("int").alias("b")).agg(F.sum("kinds").alias("s")).orderBy(F.desc("b")).collect()
    least, held = 0, 0
    for r in by_size:
        held += r.s
        if held > most:
            least = 1 << (r.b + 1)
            break
    # a context that is kept has all its symbols, and every shorter context of it is kept
    table = nodes.where(F.col("total") >= least).select("k", "ctx", "next").toArrow().combine_chunks()
    if not table.num_rows:
        z = np.zeros(0)
        return Trie(z.astype(np.uint64), z, z.astype(np.uint64), z, z, z, not by_size)
    lengths = pc.list_value_length(table["next"]).to_numpy()
    after = pc.list_flatten(table["next"]).to_numpy()
    k = np.repeat(table["k"].to_numpy(), lengths).astype(np.uint64)
    ctx = np.repeat(table["ctx"].to_numpy(), lengths).astype(np.uint64)
    g = (ctx << np.uint64(8)) | (after & 255).astype(np.uint64)
    shorter = np.maximum(k, np.uint64(1)) - np.uint64(1)
    low = g & np.array(_BYTES)[shorter + np.uint64(1)] | shorter << np.uint64(56)
    g, ctx, n = g | k << np.uint64(56), ctx | k << np.uint64(56), after >> 8
    order = np.argsort(g)
    g, ctx, low, n = g[order], ctx[order], low[order], n[order]
    node, which = np.unique(ctx, return_inverse=True)
    return Trie(g, n.astype(float), node, np.bincount(which, n, len(node)), np.bincount(which, minlength=len(node)).astype(float), np.bincount(which, n[np.searchsorted(g, low)], len(node)), not least)


def _frequent(counts: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """Hashes (sorted) and counts of the FREQUENT most frequent rows with ``least`` at least, and the table of all others."""
    top = counts.where(F.col("c") >= least).orderBy(F.desc("c"), "h").limit(FREQUENT).select("h", "c").toArrow()
    h, c = top["h"].to_numpy().view(np.uint64), top["c"].to_numpy()
    order = np.argsort(h)
    if not len(c):
        return h, c, counts
    lowest, last = int(c[-1]), int(h.view(np.int64)[-1])
    return h[order], c[order], counts.where((F.col("c") < lowest) | (F.col("c") == lowest) & (F.col("h") > last))


def train(texts: DataFrame, most: int = MOST_GRAMS) -> tuple[Model, DataFrame, DataFrame]:
    """Model, the table (h, c) of words that are not frequent, and the table of all contexts.  ``texts`` has one column, null for empty."""
    counts = stage(corpus_counts(texts), "words")
    ends = texts.count()
    facts = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    h, c, rare = _frequent(counts, 2)
    nodes = context_table(texts)
    return Model(facts.n + ends, facts.v + (ends > 0), ends, h, c.astype(float), build_trie(nodes, most)), rare, nodes


def _place(table: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, h), max(len(table) - 1, 0))
    return at, table[at] == h if len(table) else np.zeros(len(h), bool)


def _scored(shared):
    """Of (row, doc_id, learnt, text): the words' part of the result, hashes of words that are not frequent, the score as far as the broadcast
    contexts tell, and all other grams with their numbers."""
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        end_base = log10(model.ends + 1)
        for batch in batches:
            done = 0
            for texts in T.slices(batch.column(3)):
                m = len(texts)
                words = T.words(texts)
                own = words.keys()
                at, often = _place(model.word, own)
                base = np.zeros(len(own))
                base[often] = np.log10(model.count[at[often]] + 1)
                total = T.sums(np.stack([base, often.astype(float)], axis=1), words.first)
                gram, which = spelled(*written(words))
                distinct, of = np.unique(gram, return_inverse=True)
                log, unsure = model.trie.grams(distinct)
                spelt = np.bincount(which, np.where(unsure, 0.0, log)[of], m)
                # the numbers of distinct grams are in the order of the grams
                open_, row = of[unsure[of]], which[unsure[of]]
                pairs, times = np.unique(row * len(distinct) + open_, return_counts=True)
                per_row = np.bincount(pairs // len(distinct), minlength=m)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(done, m) for i in range(3)), pa.array(words.per_row + 1), pa.array((total[:, 1] + (model.ends > 0)).astype(np.int64)), pa.array(total[:, 0] + end_base), pa.array(spelt),
                     T.lists(own[~often].view(np.int64), T.sums((~often).astype(np.int64), words.first)), T.lists(distinct[pairs % len(distinct)].view(np.int64), per_row), T.lists(times, per_row)],
                    ["row", "doc_id", "learnt", "n", "known", "base", "spelt", "rare", "g", "m"])
                done += m
            T.release()
    return body


def _resolve(short: np.ndarray):
    """Of (ctx, want, found): log10 probability of each byte of ``want`` after ctx; ``short`` are the counts after no and after each one byte."""
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 1024):
                batch = whole.slice(begin, 1024)
                m, ctx = batch.num_rows, batch.column(0).to_numpy()
                count = np.zeros((ORDER + 1, m, 256))
                count[0], count[1] = short[256], short[ctx & 255]
                found = pc.list_flatten(batch.column(2))
                if len(found):
                    row = np.repeat(np.arange(m), pc.list_value_length(batch.column(2)).to_numpy())
                    after, lengths = pc.struct_field(found, 1), pc.list_value_length(pc.struct_field(found, 1)).to_numpy()
                    n = pc.list_flatten(after).to_numpy()
                    count[np.repeat(pc.struct_field(found, 0).to_numpy(), lengths), np.repeat(row, lengths), n & 255] = n >> 8
                seen = count > 0
                total, kinds = count.sum(axis=2), seen.sum(axis=2)
                row, byte = np.repeat(np.arange(m), pc.list_value_length(batch.column(1)).to_numpy()), pc.list_flatten(batch.column(1)).to_numpy()
                out, left = np.zeros(len(row)), np.arange(len(row))
                for k in range(ORDER, -1, -1):
                    r, b = row[left], byte[left]
                    gone_n = (count[k] * seen[k + 1]).sum(axis=1) if k < ORDER else np.zeros(m)
                    gone_t = kinds[k + 1] if k < ORDER else np.zeros(m)
                    hit = seen[k][r, b]
                    n_left, t_left = (total[k] - gone_n)[r], (kinds[k] - gone_t)[r]
                    out[left[hit]] += np.log10((2 * count[k][r[hit], b[hit]] - 1) / (2 * n_left[hit]))
                    escape = ~hit & (t_left > 0)
                    out[left[escape]] += np.log10(t_left[escape] / (2 * n_left[escape]))
                    left = left[~hit]
                out[left] -= np.log10(np.maximum(257 - kinds[0][row[left]], 1))
                yield pa.RecordBatch.from_arrays([pa.array((ctx[row] << 8) | byte), pa.array(out)], ["g", "p"])
            T.release()
    return body


def looked_up(grams: DataFrame, nodes: DataFrame) -> DataFrame:
    """(g, p) of every distinct gram of a table (g): its last byte's log10 probability by all contexts."""
    short = np.zeros((257, 256))  # at most 257 contexts of no or one byte; the longer ones are joined
    for r in nodes.where("k < 2").collect():
        after = np.array(r.next)
        short[r.ctx if r.k else 256, after & 255] = after >> 8
    asked = stage(grams.distinct().groupBy(F.shiftright("g", 8).alias("c")).agg(F.collect_list(F.col("g").bitwiseAND(255)).alias("want")), "asked")
    each = asked.select("c", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("c").bitwiseAND((1 << 8 * k) - 1).alias("ctx")) for k in range(2, ORDER + 1)])).alias("z")).select("c", "z.k", "z.ctx")
    found = each.join(nodes.where("k >= 2").select("k", "ctx", "next").hint("merge"), ["k", "ctx"]).groupBy("c").agg(F.collect_list(F.struct("k", "next")).alias("found"))
    none = F.array().cast("array<struct<k:int,next:array<bigint>>>")
    return asked.join(found.hint("merge"), "c", "left").select("c", "want", F.coalesce("found", none).alias("found")).mapInArrow(_resolve(short), "g long, p double")


def score(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", most: int = MOST_GRAMS) -> DataFrame:
    """doc_id, learnt, n_tokens, n_known, train_tokens, base_score, score of every row; trained on rows where ``learn``."""
    spark = docs.sparkSession
    learn = F.coalesce(learn, F.lit(False))
    model, rare, nodes = train(docs.where(learn).select(F.coalesce(F.col(text), F.lit("")).alias("t")), most)
    shared = spark.sparkContext.broadcast(model)
    asked = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), learn.alias("learnt"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    kind = asked.schema["doc_id"].dataType.simpleString()
    rows = stage(asked.mapInArrow(_scored(shared), f"row long, doc_id {kind}, learnt boolean, n long, known long, base double, spelt double, rare array<long>, g array<long>, m array<long>"), "scored")
    found = rows.select("row", F.explode("rare").alias("h")).join(rare, "h").groupBy("row").agg(F.sum(F.log10(F.col("c") + 1)).alias("more_base"), F.count("*").alias("more_known"))
    out = rows.drop("rare", "g", "m").join(found, "row", "left")
    score_ = F.col("spelt")
    if not model.trie.whole:
        rest = rows.select("row", F.explode(F.arrays_zip("g", "m")).alias("z")).select("row", "z.g", "z.m")
        more = rest.join(looked_up(rest.select("g"), nodes).hint("merge"), "g").groupBy("row").agg(F.sum(F.col("p") * F.col("m")).alias("more"))
        out, score_ = out.join(more, "row", "left"), score_ + F.coalesce("more", F.lit(0.0))
    whole = log10(model.tokens + model.kinds + 1)
    return out.select("doc_id", "learnt", F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
                      (F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n") * whole).alias("base_score"), score_.alias("score"))
