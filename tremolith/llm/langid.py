"""Language identification with interpolated Kneser-Ney character models, one per language.

Training counts 5-character grams of lower-cased words (four boundary marks before a word, one after) of a bounded,
documented sample of the labelled rows: at most ``per_lang`` documents of each language and about ``most_chars`` characters
of whole texts, those with the least hash of their id.  Lower orders count distinct left extensions.  All languages share sorted arrays of gram hashes per order; each
entry holds the interpolated log probability in every language, each context its back-off weight, so scoring a character
is one binary search where the full gram is known.  A text's cross-entropy is the mean over its characters and word ends;
the least one names the language.  Each fifth document of the sample, by its id, is kept out of the fit and calibrates: the
limit of a language and a length (powers of two) is the median of their cross-entropies plus ``SPREAD`` times the distance
to the upper quartile, which single odd documents under a known label don't move.  Lengths and languages with fewer than
``ENOUGH`` such documents take the limit of the language, then the median of all languages' limits, then one of all
documents kept out.  A text of n characters whose least cross-entropy lies more than ``slack`` + ``NOISE`` / sqrt(n) nats a
character above its limit is rejected.

Defined cases: a null text and a text without a letter are ``und`` with score 0 and are rejected.  Texts with fewer than
``firm`` characters are too short to reject; without any document kept out no text is far.  Equal cross-entropies go to the first language in code point order.
Without any labelled text every text is ``und``.  Rows with null language or id are never learnt from.  Repeated rows are
judged alike; other columns are kept, but one named as the output column is replaced.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import text as T
from .stage import stage

ORDER = 5
PIECE = 1 << 24
SPREAD, ENOUGH, LENGTHS, NOISE = 8.0, 8, 24, 6.0
_SEED = T.seeds(ORDER + 1, 41)
_KIND = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("entropy", pa.float64()), ("n", pa.int64()), ("rejected", pa.bool_())])
RESULT = "struct<lang:string,score:double,entropy:double,n:bigint,rejected:boolean>"


def unique_words(words: T.Words) -> tuple[list[bytes], np.ndarray]:
    """The distinct words of a slice, and for each word which of them it is."""
    _, sample, which = np.unique(words.keys(), return_index=True, return_inverse=True)
    return [words.get(i) for i in sample.tolist()], which


def grams(distinct: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the k-character grams (k = 0..ORDER) that end at each character and word end; the word of each."""
    # a word is its characters and one closing blank; four more blanks part it from the next one
    points = np.frombuffer(("    " + "     ".join(w.decode(errors="replace") for w in distinct) + " ").encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.fromiter((len(w.decode(errors="replace")) + 1 for w in distinct), np.int64, len(distinct))
    word = np.repeat(np.arange(len(distinct)), lengths)
    at = np.arange(lengths.sum()) + 4 * (word + 1)
    out, h = [np.zeros(len(at), np.uint64)], np.zeros(len(at), np.uint64)
    for k in range(1, ORDER + 1):
        h = T.mix(h * _SEED[0] + points[at - k + 1] * _SEED[k] + np.uint64(k))
        out.append(h)
    return out, word


def contexts(distinct: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """``grams`` and the hash of the k - 1 characters before (k = 1..ORDER)."""
    points = np.frombuffer(("    " + "     ".join(w.decode(errors="replace") for w in distinct) + " ").encode("utf-32-le"), np.uint32).astype(np.uint64)
    full, word = grams(distinct)
    lengths = np.bincount(word, minlength=len(distinct))
    at = np.arange(lengths.sum()) + 4 * (word + 1) - 1
    before, h = [np.zeros(len(at), np.uint64)], np.zeros(len(at), np.uint64)
    for k in range(1, ORDER):
        h = T.mix(h * _SEED[0] + points[at - k + 1] * _SEED[k] + np.uint64(k))
        before.append(h)
    return full, before, word


@dataclass
class Model:
    langs: list[str]
    keys: list[np.ndarray]      # per order: sorted gram hashes
    logs: list[np.ndarray]      # per order: log probability by language
    ctx: list[np.ndarray]       # per order: sorted context hashes
    backs: list[np.ndarray]     # per order: log back-off weight by language
    floor: float

    def word_logs(self, distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each word by language, and its number of characters with the end."""
        full, before, word = contexts(distinct)
        total = np.zeros((len(word), len(self.langs)), np.float32)
        left = np.arange(len(word))
        for k in range(ORDER, 0, -1):
            g = full[k][left]
            at = np.minimum(np.searchsorted(self.keys[k], g), len(self.keys[k]) - 1)
            hit = self.keys[k][at] == g
            total[left[hit]] += self.logs[k][at[hit]]
            left = left[~hit]
            c = before[k - 1][left]
            at = np.minimum(np.searchsorted(self.ctx[k], c), len(self.ctx[k]) - 1)
            seen = self.ctx[k][at] == c
            total[left[seen]] += self.backs[k][at[seen]]
        total[left] += self.floor
        starts = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
        return np.add.reduceat(total, starts, axis=0), np.bincount(word, minlength=len(distinct))


@dataclass
class Trained:
    """A model that was broadcast once, for calibration and for all texts, and its limits."""
    langs: list[str]
    shared: Broadcast
    limits: np.ndarray  # by language and length


def fit(counts: dict[str, tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]]) -> Model:
    """From each language's distinct 5-grams: hashes, counts, hashes of their suffix grams and of their contexts."""
    langs = sorted(counts)
    floor = -np.log(65536.0)
    keys, logs, ctx, backs = [np.zeros(1, np.uint64)], [np.full((1, len(langs)), floor)], [None], [None]
    tables = []  # per language and order: grams, counts, contexts, suffixes
    for lang in langs:
        g5, n5, suffix, before = counts[lang]
        own = {ORDER: (g5, n5.astype(float), before[ORDER - 1], suffix[ORDER - 1])}
        for k in range(ORDER - 1, 0, -1):
            above = own[k + 1]
            # distinct grams one longer that end in this one
            g, sample, n = np.unique(above[3], return_index=True, return_counts=True)
            place = {ORDER - 1: np.arange(len(g5))}.get(k, own[k + 1][4] if k < ORDER - 1 else None)[sample]
            own[k] = (g, n.astype(float), before[k - 1][place], suffix[k - 1][place], place)
        tables.append(own)
    for k in range(1, ORDER + 1):
        union = np.unique(np.concatenate([own[k][0] for own in tables]))
        places = np.unique(np.concatenate([own[k][2] for own in tables]))
        context, lower = np.empty(len(union), np.uint64), np.empty(len(union), np.uint64)
        back = np.zeros((len(places), len(langs)))
        first = np.zeros((len(union), len(langs)))
        for j, own in enumerate(tables):
            g, n, c, s = own[k][:4]
            at = np.searchsorted(union, g)
            context[at], lower[at] = c, s
            n1, n2 = (n == 1).sum(), (n == 2).sum()
            d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            where = np.searchsorted(places, c)
            total, kinds = np.bincount(where, n, len(places)), np.bincount(where, minlength=len(places))
            seen = total > 0
            back[seen, j] = np.log(d * kinds[seen] / total[seen])
            first[at, j] = (n - d) / total[where]
        below = np.exp(logs[k - 1][np.searchsorted(keys[k - 1], lower)]) if k > 1 else np.exp(floor)
        keys.append(union)
        logs.append(np.log(first + np.exp(back[np.searchsorted(places, context)]) * below))
        ctx.append(places)
        backs.append(back)
    return Model(langs, keys, [x.astype(np.float32) for x in logs], ctx, [None, *(x.astype(np.float32) for x in backs[1:])], floor)


def _has_letter(texts: T.Texts) -> np.ndarray:
    ascii_letter = ((texts.data | 0x20) >= 0x61) & ((texts.data | 0x20) <= 0x7A)
    found = T.sums(ascii_letter.astype(np.int64), texts.offsets) > 0
    for i in np.flatnonzero(~found & (np.diff(texts.offsets) > 0)).tolist():
        found[i] = any(c.isalpha() for c in texts.bytes_of(i).decode(errors="replace"))
    return found


def entropies(model: Model, texts: T.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy of each text by language in nats a character, and its characters."""
    words = T.words(texts, T.NOT_LETTER)
    if not len(words):
        return np.zeros((len(texts), len(model.langs))), np.zeros(len(texts), np.int64)
    distinct, which = unique_words(words)
    logs, n = model.word_logs(distinct)
    total, chars = T.sums(logs[which].astype(np.float64), words.first), T.sums(n[which], words.first)
    return -total / np.maximum(chars, 1)[:, None], chars


def length_class(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(n, 1)).astype(np.int64), LENGTHS - 1)


def calibrated(langs: list[str], lang: np.ndarray, n: np.ndarray, entropy: np.ndarray) -> np.ndarray:
    """Limits by language and length from documents kept out of the fit."""
    def limit(x: np.ndarray) -> float:
        middle, upper = np.quantile(x, [0.5, 0.75])
        return middle + SPREAD * (upper - middle)

    out = np.full((len(langs), LENGTHS), np.nan)
    for j, name in enumerate(langs):
        own = lang == name
        if own.sum() >= ENOUGH:
            out[j] = limit(entropy[own])
            for c in np.unique(length_class(n[own])):
                x = entropy[own & (length_class(n) == c)]
                if len(x) >= ENOUGH:
                    out[j, c] = limit(x)
    known = ~np.isnan(out)
    out[~known] = np.median(out[known]) if known.any() else limit(entropy) if len(entropy) else np.inf
    return out


def _judge(model: Model | None, limits: np.ndarray | None, slack: float, firm: int):
    def kernel(texts: T.Texts) -> pa.Array:
        if model is None or not model.langs:
            n = len(texts)
            return T.struct(lang=pa.array(["und"] * n), score=np.zeros(n), entropy=pa.nulls(n, pa.float64()), n=np.zeros(n, np.int64), rejected=np.ones(n, bool))
        h, n = entropies(model, texts)
        und = texts.null | ~_has_letter(texts)
        best = h.argmin(axis=1)
        least = h[np.arange(len(h)), best]
        # posterior of the language under equal priors; a long text counts as 200 characters
        score = 1 / np.exp((least[:, None] - h) * np.minimum(n, 200)[:, None]).sum(axis=1)
        rejected = und if limits is None else und | (n >= firm) & (least > limits[best, length_class(n)] + slack + NOISE / np.sqrt(np.maximum(n, 1)))
        names = np.array(model.langs, object)[best]
        names[und] = "und"
        return T.struct(lang=pa.array(names.tolist(), pa.string()), score=np.where(und, 0.0, score), entropy=pa.array(least, mask=und | (n == 0)), n=n, rejected=rejected)
    return kernel


def _sample(docs: DataFrame, learn: Column, doc_id: str, text: str, lang: str, per_lang: int, most_chars: int) -> DataFrame:
    """(l, t, out) of the rows learnt from, written once: per language those with the least hash of their id, until there are
    ``per_lang`` of them or those before hold ``most_chars`` characters.  ``out`` marks those kept out of the fit."""
    h = F.xxhash64(F.col(doc_id).cast("string"))
    rows = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(lang).alias("l"), h.alias("h"), F.col(text).alias("t"))
    # the greatest hash of a language comes from ids alone, first within 64 parts, as one language may hold most rows
    part = rows.select("l", "h").withColumn("r", F.row_number().over(Window.partitionBy("l", F.pmod("h", F.lit(64))).orderBy("h"))).where(F.col("r") <= per_lang)
    tops = part.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("h"))).where(F.col("r") <= per_lang).groupBy(F.col("l").alias("tl")).agg(F.max("h").alias("top"))
    near = Window.partitionBy("l").orderBy("h", F.xxhash64("t"))
    own = rows.join(F.broadcast(tops), (F.col("l") == F.col("tl")) & (F.col("h") <= F.col("top"))).select("l", "h", "t")  # one row a language
    own = own.withColumns({"r": F.row_number().over(near), "ahead": F.sum(F.char_length("t").cast("long")).over(near.rowsBetween(Window.unboundedPreceding, -1))})
    out = F.pmod(F.xxhash64(F.lit("limit"), "h"), F.lit(5)) == 0
    return stage(own.where((F.col("r") <= per_lang) & (F.coalesce("ahead", F.lit(0)) < most_chars)).select("l", "t", out.alias("out")), "language-sample")


def _fitted(names: list[str]):
    """The model of all grams, in pieces: it is fitted in one task, which holds no more than the sample has characters."""
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        del got
        whose = table["l"].combine_chunks().dictionary_encode()
        counts = {}
        for code, name in enumerate(whose.dictionary.to_pylist()):
            own = table.filter(pa.array(whose.indices.to_numpy() == code)).sort_by("g")
            u = lambda c: own[c].to_numpy().view(np.uint64)
            zero = np.zeros(own.num_rows, np.uint64)
            counts[name] = (u("g"), own["n"].to_numpy(), [zero, *(u(f"s{k}") for k in range(1, ORDER))], [zero, *(u(f"c{k}") for k in range(1, ORDER))])
        del table
        data = pickle.dumps(fit(counts), pickle.HIGHEST_PROTOCOL)
        for at in range(0, len(data), PIECE):
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([data[at:at + PIECE]], pa.binary())], ["at", "piece"])
    return body


def train(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = 2000, most_chars: int = 8_000_000, firm: int = 40) -> Trained | None:
    """Fit on at most ``per_lang`` rows and about ``most_chars`` characters per language for which ``learn`` holds.

    All grams of the sample count.  They are counted by Spark and fitted in one task; the driver takes the fitted arrays to
    broadcast them, and the limits.
    """
    sample = _sample(docs, learn, doc_id, text, lang, per_lang, most_chars)
    names = [f"s{k}" for k in range(1, ORDER)] + [f"c{k}" for k in range(1, ORDER)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = batch.column(0).to_pylist()
            at = 0
            for texts in T.slices(batch.column(1)):
                own = np.array(where[at:at + len(texts)], object)
                at += len(texts)
                words = T.words(texts, T.NOT_LETTER)
                if not len(words):
                    continue
                distinct, which = unique_words(words)
                full, before, word = contexts(distinct)
                of_word = own[words.row_of()]
                for name in sorted(set(own)):
                    n = np.bincount(which[of_word == name], minlength=len(distinct))[word]
                    g, sample, inverse = np.unique(full[ORDER], return_index=True, return_inverse=True)
                    total = np.bincount(inverse, n, len(g)).astype(np.int64)
                    keep = total > 0
                    pick = sample[keep]
                    cols = [pa.array([name] * len(pick)), pa.array(g[keep].view(np.int64)), pa.array(total[keep])]
                    cols += [pa.array(full[k][pick].view(np.int64)) for k in range(1, ORDER)] + [pa.array(before[k][pick].view(np.int64)) for k in range(1, ORDER)]
                    yield pa.RecordBatch.from_arrays(cols, ["l", "g", "n", *names])
            T.release()
    parts = sample.where("not out").select("l", "t").mapInArrow(count, "l string, g long, n long, " + ", ".join(f"{x} long" for x in names))
    grams = parts.groupBy("l", "g").agg(F.sum("n").alias("n"), *[F.first(x).alias(x) for x in names])
    pieces = grams.repartition(1).mapInArrow(_fitted(names), "at long, piece binary").collect()
    if not pieces:
        return None
    model = pickle.loads(b"".join(bytes(r.piece) for r in sorted(pieces, key=lambda r: r["at"])))
    del pieces
    shared = docs.sparkSession.sparkContext.broadcast(model)
    langs = model.langs
    del model  # workers hold it from here on
    T.release()
    judged = sample.where("out").withColumn("j", T.column_udf(lambda: _judge(shared.value, None, 0.0, firm), _KIND, RESULT)("t")).where((F.col("j.n") >= firm) & (F.col("j.lang") == F.col("l")))
    held = judged.select("l", "j.n", "j.entropy").toArrow()
    return Trained(langs, shared, calibrated(langs, np.array(held["l"].to_pylist(), object), held["n"].to_numpy(), held["entropy"].to_numpy()))


def identify(docs: DataFrame, model: Trained | None, text: str = "text", out: str = "language", slack: float = 0.75, firm: int = 40) -> DataFrame:
    """``docs`` with a struct ``out``: lang, score (0 to 1), entropy (nats a character), n (characters), rejected."""
    shared, limits = (None, None) if model is None else (model.shared, model.limits)
    judge = T.column_udf(lambda: _judge(None if shared is None else shared.value, limits, slack, firm), _KIND, RESULT)
    return docs.drop(out).withColumn(out, judge(F.col(text)))
