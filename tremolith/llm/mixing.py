"""Mixing sources to target weights: fixed-length blocks, multinomial draws per shard, index permutations, one join.

Each source's documents are laid out in lanes (by hash of the id) and cut into blocks of ``block`` words.  A source's
target, ``share`` of all words by weight but ``most`` times its own size at most, becomes a number of output slots.  All
slots are dealt to output shards by one pseudorandom permutation, so a shard's source counts are a multinomial draw given
the totals.  The k-th slot of a source takes the block that a pseudorandom permutation of the source's block numbers gives
for k, a new permutation each epoch; slots and blocks are joined by that number.  Permutations are swap-or-not shuffles of
hashes; nothing is drawn by a state, so reruns agree.

DataFrame functions only.  The one unpartitioned window runs over one row a source.

Defined cases: null and wordless texts have size 0 and are never taken.  A null source is a source of its own, the last.
A null id is laid out like any other; repeated rows count once each, as rows.  An empty table gives empty results.
Only id, text and source are read, so other columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .stage import stage

LANE_ROWS, ROUNDS = 4096, 20
WORD = r"[^\x20\x09-\x0D]+"


@dataclass
class Mixture:
    sources: DataFrame   # sk, source, source_size, weight, target, blocks, slots
    slots: DataFrame     # sk, k, block, part (share of the block that is taken), shard, place
    pieces: DataFrame    # row, sk, block, at (first word in the block), n: which words of a block are of which row
    rows: DataFrame      # row, doc_id, source, sk, size
    taken: DataFrame     # row, doc_id, size, source_size, target, taken


def permuted(x: Column, n: Column, *seed: Column) -> Column:
    """A pseudorandom permutation of 0..n-1 at ``x``, chosen by ``seed``, by swap-or-not rounds.

    Each round pairs v with (key - v) mod n and takes the partner if a bit of the larger one says so, which both agree on.
    """
    key = F.xxhash64(*seed)

    def swap(v: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, r), n) - v, n)
        return F.when(F.pmod(F.xxhash64(key, r, F.greatest(v, other)), F.lit(2)) == 1, other).otherwise(v)
    return F.coalesce(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, swap), F.lit(0).cast("long"))


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Adds weight and target to (source, source_size): least(most * size, level * weight) with one common level.

    In order of cap / weight the capped sources come first, so running sums tell where the level lies.
    """
    listed = sources.withColumn("nth", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    listed = listed.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("nth", F.lit(len(weights))) + 1).cast("int")))
    whole = Window.partitionBy()
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "nth")
    level = (listed.withColumn("cap", most * F.col("source_size"))
             .withColumn("before", F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
             .withColumn("rest", F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
             .withColumn("total", share * F.sum("source_size").over(whole)))
    here = (F.col("total") - F.col("before")) / F.col("rest")
    # the first source that is not capped has the least such value, which is also the common one
    first = F.min(F.when(F.col("cap") / F.col("weight") > here, F.struct(F.col("cap") / F.col("weight"), F.col("nth"), here.alias("here")))).over(whole)
    return level.withColumn("target", F.least("cap", F.coalesce(first["here"] * F.col("weight"), F.col("cap")))).drop("nth", "cap", "before", "rest", "total")


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
                block: int = 128, shard_slots: int = 4096, row: str | None = None) -> Mixture:
    """``row`` names a column that numbers the rows; without it they are numbered here."""
    key = F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))
    sized = docs.select((F.col(row) if row else F.monotonically_increasing_id()).alias("row"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), key.alias("sk"),
                        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long")).alias("size"))
    rows = stage(sized, "mix-rows")
    lanes = max(1, rows.count() // LANE_ROWS)
    lane = rows.where("size > 0").withColumn("lane", F.pmod(F.xxhash64("doc_id"), F.lit(lanes)))
    per_lane = lane.groupBy("sk", "lane").agg(F.sum("size").alias("words"), F.ceil(F.sum("size") / block).cast("long").alias("n"))
    order = Window.partitionBy("sk").orderBy("lane")
    per_lane = per_lane.withColumn("ahead", F.sum("n").over(order) - F.col("n")).select("sk", "lane", "ahead")
    of_source = rows.groupBy("sk", "source").agg(F.sum("size").alias("source_size"))
    n_blocks = lane.groupBy("sk", "lane").agg(F.ceil(F.sum("size") / block).cast("long").alias("n")).groupBy("sk").agg(F.sum("n").alias("blocks"))
    want = targets(of_source, weights, share, most).join(n_blocks, "sk", "left").withColumn("blocks", F.coalesce("blocks", F.lit(0).cast("long")))
    exact = F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0)
    want = want.withColumn("whole", F.least(F.floor(exact + 1e-9).cast("long"), (most * F.col("blocks")).cast("long"))).withColumn("last", F.greatest(exact - F.col("whole"), F.lit(0.0)))
    want = want.withColumn("slots", F.col("whole") + F.when((F.col("last") > 1e-9) & (F.col("whole") < most * F.col("blocks")), 1).otherwise(0))
    want = stage(want.withColumn("offset", F.coalesce(F.sum("slots").over(Window.orderBy("sk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
                 .withColumn("all_slots", F.sum("slots").over(Window.partitionBy())), "mix-sources")

    # a fixed number of tasks: few rows come in, many go out
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # slots 0..slots-1 of each source, made in runs of 2**14 that are spread before they unfold
    high = want.where("slots > 0").select("sk", "blocks", "slots", "whole", "last", "offset", "all_slots", F.explode(F.expr("sequence(0L, shiftright(slots - 1, 28))")).alias("hi"))
    mid = high.select("*", F.explode(F.expr("sequence(0L, least(16383L, shiftright(slots - 1 - shiftleft(hi, 28), 14)))")).alias("mid")).repartition(tasks, "sk", "hi", "mid")
    low = mid.select("*", F.explode(F.expr("sequence(0L, least(16383L, slots - 1 - shiftleft(hi, 28) - shiftleft(mid, 14)))")).alias("lo"))
    k = F.expr("shiftleft(hi, 28) + shiftleft(mid, 14) + lo")
    slots = low.select("sk", "blocks", "offset", "all_slots", k.alias("k"), F.when(k < F.col("whole"), 1.0).otherwise(F.col("last")).alias("part"))
    deal = permuted(F.col("offset") + F.col("k"), F.col("all_slots"), F.lit("deal"))
    slots = slots.select("sk", "k", permuted(F.pmod("k", "blocks"), F.col("blocks"), F.col("sk"), F.expr("k div blocks")).alias("block"), "part",
                         F.floor(deal / shard_slots).cast("long").alias("shard"), F.pmod(deal, F.lit(shard_slots)).alias("place"))

    laid = lane.withColumn("at", F.sum("size").over(Window.partitionBy("sk", "lane").orderBy("doc_id", "row")) - F.col("size"))
    pieces = (laid.join(per_lane, ["sk", "lane"])
              .select("row", "sk", "size", "at", "ahead", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))).alias("b"))
              .select("row", "sk", (F.col("ahead") + F.col("b")).alias("block"), F.greatest(F.col("at") - F.col("b") * block, F.lit(0).cast("long")).alias("at"),
                      (F.least(F.col("at") + F.col("size"), (F.col("b") + 1) * block) - F.greatest("at", F.col("b") * block)).alias("n")))
    # planned sizes don't see what the slots unfold to: without the hint this side would be broadcast
    # a block is full except the last of its lane, of which a part of a slot takes as much as there is
    drawn = slots.groupBy("sk", "block").agg(F.sum(F.floor("part")).cast("long").alias("times"), F.max(F.when(F.col("part") < 1, F.floor(F.col("part") * block))).cast("long").alias("head"))
    used = F.col("n") * F.col("times") + F.coalesce(F.least("n", F.greatest(F.col("head") - F.col("at"), F.lit(0).cast("long"))), F.lit(0).cast("long"))
    per_row = pieces.join(drawn.hint("merge"), ["sk", "block"]).groupBy("row").agg(F.sum(used).alias("taken"))
    taken = (rows.join(per_row, "row", "left").join(want.select("sk", "source_size", "target"), "sk")
             .select("row", "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken")))
    return Mixture(want, slots, pieces, rows, taken)


def shards(mixture: Mixture) -> DataFrame:
    """The mix itself: which words of which document fill each place of each output shard."""
    return (mixture.slots.join(mixture.pieces.hint("merge"), ["sk", "block"]).join(mixture.rows.select("row", "doc_id"), "row")
            .select("shard", "place", "sk", "block", "at", "n", "part", "doc_id"))
