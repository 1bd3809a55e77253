"""First come, first served among overlapping spans, without a walk: chains by links, the rest by rounds of local firsts.

A *span* is a row with ``keys``, whole numbers ``start`` <= ``end``, a unique place in the order ``__p`` and a unique ``__i``.
Two spans of a key overlap if each starts before the other ends.  A span is taken unless it overlaps one taken before it.

Each round cuts the spans of a key into clusters that nothing spans:

* a span alone is taken;
* where the order follows time (or runs against it), the one taken next is the first that starts no earlier than the last
  one ended: a link a span, and pointer doubling along the links (:mod:`.reach`), log2(chain) joins;
* elsewhere whoever comes before all that overlap it is taken, and those go with it.  What stays undecided overlaps nothing
  that was taken, so it is the same problem again, in smaller clusters.

"Before all that overlap it" is a minimum over overlaps.  No pair of spans is listed: a span is put down under the fewest
dyadic blocks of time that fill it and under all blocks that its start lies in.  Of two overlapping spans one holds the
start of the other, so they meet under one block, and a partial aggregate leaves one row a block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut
from .reach import reach
from .scan import next_set, prev, running_max, running_sum, scan

# blocks (level, number): those that fill __lo..__hi, and those that __lo lies in
_FILL = """flatten(transform(sequence(0, __bits), k -> filter(array(
    if(shiftright(__lo + shiftleft(1L, k) - 1, k) < shiftright(__hi + 1, k) and shiftright(__lo + shiftleft(1L, k) - 1, k) % 2 <> 0,
       struct(k as k, shiftright(__lo + shiftleft(1L, k) - 1, k) as at), null),
    if(shiftright(__lo + shiftleft(1L, k) - 1, k) < shiftright(__hi + 1, k) and shiftright(__hi + 1, k) % 2 <> 0,
       struct(k as k, shiftright(__hi + 1, k) - 1 as at), null)), x -> x is not null)))"""
_HOLD = "transform(sequence(0, __bits), k -> struct(k as k, shiftright(__lo, k) as at))"


def _first_overlap(asked: DataFrame, among: DataFrame) -> DataFrame:
    """(__i, first): the least place of those of ``among`` that overlap each of ``asked``; none, no row or null.

    Spans without length overlap those around them but not one another, hence two minima a block.
    """
    def under(df: DataFrame, blocks: str) -> DataFrame:
        return df.select("__c", "__i", "__p", "__long", F.explode(F.expr(blocks)).alias("__block"))

    def half(mine: str, theirs: str) -> DataFrame:
        least = under(among, theirs).groupBy("__c", "__block").agg(F.min("__p").alias("__any"), F.min(F.when(F.col("__long"), F.col("__p"))).alias("__of_long"))
        return under(asked, mine).join(least, ["__c", "__block"]).select("__i", F.when(F.col("__long"), F.col("__any")).otherwise(F.col("__of_long")).alias("first"))

    return half(_HOLD, _FILL).unionByName(half(_FILL, _HOLD)).groupBy("__i").agg(F.min("first").alias("first"))


def _round(mixed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The local firsts, and the spans that neither are one nor overlap one."""
    s, e = F.col("__s"), F.col("__e")
    width = mixed.groupBy("__c").agg(F.length(F.bin(F.max(2 * (e - s)) + 1)).alias("__bits"))
    placed = cut(mixed.withColumns({"__long": e > s, "__lo": F.when(e > s, 2 * s + 1).otherwise(2 * s), "__hi": F.when(e > s, 2 * e - 1).otherwise(2 * s)}).join(width, "__c"))
    first = _first_overlap(placed, placed)
    judged = cut(placed.join(first, "__i", "left").withColumn("__taken", F.coalesce(F.col("first") >= F.col("__p"), F.lit(True))).drop("first"))
    taken, open_ = judged.filter("__taken"), judged.filter("not __taken")
    gone = _first_overlap(open_, taken).filter("first is not null").select("__i")
    return taken.select("__i"), open_.join(gone, "__i", "left_anti")


def _chains(spans: DataFrame, split: Column | None) -> DataFrame:
    """Those taken in clusters whose order follows (__s, __p)."""
    at = ["__at", "__kind", "__p"]
    rows = spans.select("__c", F.col("__s").alias("__at"), F.lit(1).alias("__kind"), "__p", "__i").unionByName(
        spans.select("__c", F.col("__e").alias("__at"), F.lit(0).alias("__kind"), "__p", "__i"))
    links = scan(rows, ["__c"], at, split, b=next_set(F.when(F.col("__kind") == 1, F.col("__i")))).filter("__kind = 0 and b is not null")
    heads = spans.groupBy("__c").agg(F.min_by("__i", F.struct("__s", "__p")).alias("a"))
    return reach(heads, links.select(F.col("__i").alias("a"), "b")).select(F.col("a").alias("__i"))


def first_come(spans: DataFrame, keys: list[str], width: int | None) -> DataFrame:
    """``__i`` of the spans (keys, __s, __e, __p, __i) that are taken; scans are split into buckets ``width`` wide."""
    split = lambda c: None if width is None else F.floor(F.col(c) / F.lit(width)).cast("long")
    taken, left, at = [], cut(spans), ["__s", "__p"]
    names = left.columns
    while not left.isEmpty():
        seen = scan(left, keys, at, split("__s"), __top=running_max("__e", inclusive=False), __before=prev(F.struct(F.col("__e").alias("e"), F.col("__p").alias("p"))))
        seen = cut(seen.withColumn("__new", F.col("__top").isNull() | (F.col("__s") >= F.col("__top"))))
        seen = scan(seen, keys, at, split("__s"), __cluster=running_sum(F.col("__new").cast("long")))
        long, new, before = F.col("__e") > F.col("__s"), F.col("__new"), F.col("__before")
        shape = seen.groupBy(*keys, "__cluster").agg(
            F.min("__i").alias("__c"), F.count(F.lit(1)).alias("__n"), F.bool_and(long & (new | (F.col("__p") > before["p"]))).alias("__on"),
            F.bool_and(long & (new | ((F.col("__p") < before["p"]) & (F.col("__e") >= before["e"])))).alias("__back"))
        shape = shape.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate([*keys, "__cluster"])], "__c", "__n", "__on", "__back")
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate([*keys, "__cluster"])])
        seen = cut(seen.join(shape, same).select(*names, "__c", "__n", "__on", "__back"))
        taken.append(seen.filter("__n = 1").select("__i"))
        chained = seen.filter("__n > 1 and (__on or __back)")
        if not chained.isEmpty():
            # against time is along it with the clock turned round
            turned = chained.withColumns({"__s": F.when(F.col("__on"), F.col("__s")).otherwise(-F.col("__e")), "__e": F.when(F.col("__on"), F.col("__e")).otherwise(-F.col("__s"))})
            taken.append(_chains(turned, split("__at")))
        mixed = seen.filter("__n > 1 and not __on and not __back")
        if mixed.isEmpty():
            break
        firsts, rest = _round(mixed)
        taken.append(firsts)
        left = cut(rest.select(*names))
    return reduce(DataFrame.unionByName, taken) if taken else spans.select("__i").limit(0)
