"""Order MinHash document fingerprints, sensitive to edit distance.  DataFrame functions only.

A text is read as tokens without white space, a k-mer is ``k`` tokens in a row (all of them if there are fewer).  A word of
up to ``WORD`` characters is a token, unless it has characters of a script that puts no blanks between words.  Other runs are
cut by their content, behind each character of ``ENDS`` (every character beyond ASCII, and a fixed part of ASCII), so that an
inserted character moves no other cut; stretches of ``RUN`` characters without one are cut there.  The n-th occurrence of a k-mer has a hash of its own, so repeats count.  Hashes fall into
``bins`` ranges; of each the ``l`` least are selected, put back into text order, and hashed as a tuple, so two texts agree
in a bin only where the same k-mers come in the same order.  Everything happens inside the row, on arrays of longs that
carry a 32-bit hash and a position, so that sorting is primitive.

A fingerprint has six hex digits for each bin that is not empty: its number and its hash.  ``likeness`` is the share of
equal bins among those that are not empty in either.

Defined cases: null counts as empty; texts without tokens have an empty fingerprint and are wholly alike.  Texts that
differ in white space only (ASCII) have equal fingerprints where their words stay words.  Equal texts have equal fingerprints.
Repeated rows are judged alike; an empty table gives none; other columns are kept, names that begin with ``__`` and the
output's name are the operator's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

WORD, RUN = 24, 32
# fixed values: Thai and Lao, Burmese, Khmer, East Asian symbols to ideographs, compatibility ideographs, further planes
NO_BLANKS = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u2E80-\uA4CF\uF900-\uFAFF\x{20000}-\x{3FFFF}"
ENDS = r"aeiouAEIOU0-3.,:;/&=_()[^\x00-\x7F]"
TOKENS = rf"(?<!\S)[\S&&[^{NO_BLANKS}]]{{1,{WORD}}}(?!\S)|\S{{0,{RUN - 1}}}?[{ENDS}]|\S{{1,{RUN}}}"
WIDTH = 6  # hex digits of a bin: two for its number, four for its hash
BUCKET = 4096
_LOW = 0x7FFFFFFF


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: the variable of a one-element transform."""
    return F.transform(F.array(value), body)[0]


def _packed(hash_: Column, at: Column) -> Column:
    """Hash in the upper 32 bits (sign included), position in the lower 31."""
    return F.shiftleft(F.shiftright(hash_, 32), 32).bitwiseOR(at.cast("long"))


def _bin(g: Column, bins: int) -> Column:
    return F.shiftright(F.shiftrightunsigned(g, 32) * bins, 32)


def with_fingerprint(df: DataFrame, text: str, out: str, bins: int = 64, k: int = 2, l: int = 2) -> DataFrame:  # noqa: E741
    """``df`` with the fingerprint ``out`` of column ``text``.

    The steps are columns of their own, each used more than once by the next: so each is computed once, and the sorts,
    which stand outside of any lambda, are compiled and primitive.
    """
    h, s, first, again, u = (f"__{out}_{x}" for x in "hsfau")
    top = lambda x: F.shiftright(x, 32)
    low = lambda x: x.bitwiseAND(F.lit(_LOW))
    longs = F.array().cast("array<bigint>")
    col = F.col
    df = df.withColumn(h, F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKENS), F.lit(0)), lambda t: F.xxhash64(t)))
    n = F.greatest(F.size(h) - (k - 1), F.least(F.size(h), F.lit(1)))
    df = df.withColumn(s, F.sort_array(F.transform(F.slice(h, F.lit(1), n), lambda x, i: _packed(F.xxhash64(x, *[F.get(col(h), i + j) for j in range(1, k)]), i))))
    # equal hashes lie together, in text order: the n-th of a run is the n-th occurrence
    df = df.withColumn(first, F.filter(s, lambda x, i: (i == 0) | (top(F.get(col(s), i - 1)) != top(x))))
    repeats = F.filter(F.sequence(F.lit(1), F.greatest(F.size(s) - 1, F.lit(1))), lambda i: top(F.get(col(s), i - 1)) == top(F.get(col(s), i)))
    df = df.withColumn(again, F.when(F.size(first) < F.size(s), repeats).otherwise(F.array().cast("array<int>")))
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(again) - 1, F.lit(0))), lambda j: (j == 0) | (F.get(col(again), j - 1) != F.get(col(again), j) - 1))
    later = lambda j, a: _let(F.get(col(s), F.get(col(again), j)), lambda x: _packed(F.xxhash64(top(x), j - a + 1), low(x)))
    runs = _let(starts, lambda st: F.flatten(F.transform(st, lambda a, r: F.transform(F.sequence(a, F.coalesce(F.get(st, r + 1), F.size(again)) - 1), lambda j: later(j, a)))))
    df = df.withColumn(u, F.sort_array(F.concat(F.transform(first, lambda x: _packed(F.xxhash64(top(x), F.lit(0)), low(x))), F.when(F.size(again) > 0, runs).otherwise(longs))))
    least = F.filter(u, lambda g, i: (i < l) | (_bin(F.get(col(u), i - l), bins) != _bin(g, bins)))

    def code(sel: Column, g: Column, i: Column) -> Column:
        """Of the first of a bin: the bin, and the hash of the selected k-mers of the bin in text order."""
        own = F.filter(F.array(g, *[F.get(sel, i + j) for j in range(1, l)]), lambda x: x.isNotNull() & (_bin(x, bins) == _bin(g, bins)))
        ordered = F.array_sort(F.transform(own, lambda x: F.shiftleft(low(x), 32).bitwiseOR(F.shiftrightunsigned(x, 32))))
        digest = F.xxhash64(F.transform(ordered, lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))))
        fresh = (i == 0) | (_bin(F.get(sel, i - 1), bins) != _bin(g, bins))
        return F.when(fresh, F.lower(F.concat(F.lpad(F.hex(_bin(g, bins)), 2, "0"), F.substring(F.lpad(F.hex(digest), 16, "0"), 1, WIDTH - 2))))
    made = _let(least, lambda sel: F.array_join(F.transform(sel, lambda g, i: code(sel, g, i)), ""))
    return df.withColumn(out, made).drop(h, s, first, again, u)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bins among those that are not empty in either; 1 if all are empty."""
    parts = lambda x: F.regexp_extract_all(x, F.lit(".{%d}" % WIDTH), F.lit(0))
    bins = lambda x: F.transform(x, lambda c: F.substring(c, 1, 2))
    return _let(F.struct(parts(a).alias("a"), parts(b).alias("b")), lambda p: _let(F.size(F.array_union(bins(p["a"]), bins(p["b"]))), lambda n: F.when(n == 0, 1.0).otherwise(F.size(F.array_intersect(p["a"], p["b"])) / n)))


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, next_text and the columns of ``keep``): the text of the next document by ascending id, after the last one the first.

    Ids are cut into ranges of ``BUCKET``; the first document of each range is also sent to the range before it, so that
    one window per range finds every successor and each text moves once.  Rows with a null id come first.  Rows that
    repeat an id follow each other in the order of their texts.
    """
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"), *keep)
    base = base.withColumn("range", F.coalesce(F.floor(F.col("doc_id") / BUCKET), F.lit(-(1 << 62))).cast("long"))
    # the first text of each range by partial aggregation; the order of the ranges is found without their texts
    heads = base.groupBy("range").agg(F.min(F.struct("doc_id", "text")).alias("head"))
    order = Window.orderBy("range")
    places = base.select("range").distinct().select(F.col("range").alias("at"), F.coalesce(F.lag("range").over(order), F.last("range").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("back"))
    firsts = heads.join(places, F.col("range") == F.col("at")).select(F.col("back").alias("range"), F.lit(1).alias("ghost"), "head.doc_id", "head.text")
    both = base.select("range", F.lit(0).alias("ghost"), "doc_id", "text", *keep).unionByName(firsts, allowMissingColumns=True)
    near = Window.partitionBy("range").orderBy("ghost", F.asc_nulls_first("doc_id"), "text")
    return both.withColumn("next_text", F.lead("text").over(near)).where("ghost = 0").select("doc_id", "text", "next_text", *keep)


def edited(text: Column, other: Column) -> Column:
    """``text`` whose last floor(n / 2) code points are replaced by as many (or all) first ones of ``other``."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.left(text, n - half), F.left(other, half))
