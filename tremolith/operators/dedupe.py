"""Idempotency: exact copies, conflicts, digests and current-state rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.overlap import first_come
from ..session import cut


def row_digest(cols: list[str]) -> Column:
    """SHA-256 of a canonical text: columns in name order, each as name=value or name=null."""
    parts = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in sorted(cols)]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def set_digest(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """Order-free digest of a row set: count and two modular sums of row-digest words.

    The sums are partial aggregates, so no task ever holds the whole set.
    """
    d = df.withColumn("__d", row_digest(cols))
    word = lambda i: F.conv(F.substring("__d", i, 12), 16, 10).cast("decimal(38,0)")
    total = lambda i: F.pmod(F.sum(word(i)), F.lit(2**61 - 1).cast("decimal(38,0)")).cast("long")
    return d.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("rows"), total(1).alias("digest_a"), total(13).alias("digest_b"))


def first_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first stored row of every key, by partial aggregation (safe for a key with many copies)."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("__r"))
    return picked.select(*keys, "__r.*").select(*df.columns)


def dedupe_with_conflicts(df: DataFrame, keys: list[str], order: str, digest: str) -> DataFrame:
    """Mark every row accepted, duplicate (same content as the first) or conflict (different content).

    Null keys are keys like any other.  Exactly one row of a key is accepted: the least (order, digest), and of
    identical ones any single one.  The first row per key comes from a partial aggregate; the join back is split
    by adaptive skew handling when one key holds many copies.
    """
    own = df.withColumn("__i", F.monotonically_increasing_id())
    place = F.struct(F.col(order).alias("o"), F.col(digest).alias("d"), F.col("__i").alias("i"))
    first = own.groupBy(*keys).agg(F.min(place).alias("__f"))
    first = first.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__f")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    status = (F.when(place.eqNullSafe(F.col("__f")), "accepted").when(F.col(digest).eqNullSafe(F.col("__f.d")), "duplicate")
              .otherwise("conflict"))
    return own.join(first, same).select(*df.columns, status.alias("disposition"))


def dedupe_snapshots(df: DataFrame, order: str, rules: dict[str, list[str]], digest: str) -> DataFrame:
    """Identity first, then every other uniqueness rule among the accepted rows; first failing rule named."""
    identity, *others = rules
    marked = dedupe_with_conflicts(df, rules[identity], order, digest)
    out = marked.withColumn("rule", F.when(F.col("disposition") == "conflict", identity))
    for name in others:
        live = out.filter(F.col("disposition") == "accepted")
        first = live.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in rules[name]])).groupBy(
            *rules[name]).agg(F.min(order).alias("__first"))
        out = out.join(first, rules[name], "left")
        hit = (F.col("disposition") == "accepted") & F.col("__first").isNotNull() & (F.col(order) > F.col("__first"))
        out = out.withColumns({"disposition": F.when(hit, "conflict").otherwise(F.col("disposition")),
                               "rule": F.when(hit, name).otherwise(F.col("rule"))}).drop("__first")
    return out.select(*df.columns, "disposition", "rule")


def disposition(df: DataFrame, end_us: str, now_us: Column, retention_us: int) -> DataFrame:
    """Accepted reports past retention are acknowledged as expired, not stored."""
    return df.withColumn("disposition", F.when((F.col("disposition") == "accepted") & (F.col(end_us) <= now_us - retention_us), "expired")
                         .otherwise(F.col("disposition")))


def reject_overlaps(df: DataFrame, keys: list[str], start: str, end: str, order: str, width: int | None = None) -> DataFrame:
    """Accept in arrival order unless the span overlaps an already accepted one of its key (``start < e and end > s``).

    Spans are whole numbers; ``width`` is the bucket of the ordered scans, None where every key fits a task.  Spans tied in
    ``order`` come by start, then end.  A span without length overlaps those around it only; one that lacks a bound or ends
    before it starts is never accepted and stands in nobody's way.  Null keys are keys like any other.
    """
    own = cut(df.withColumn("__i", F.monotonically_increasing_id()))
    place = F.struct(F.col(order).alias("o"), F.col(start).alias("s"), F.col(end).alias("e"), F.col("__i").alias("i"))
    spans = own.filter(F.col(end) >= F.col(start)).select(*keys, F.col(start).cast("long").alias("__s"), F.col(end).cast("long").alias("__e"), place.alias("__p"), "__i")
    taken = first_come(spans, keys, width).withColumn("accepted", F.lit(True))
    return own.join(taken, "__i", "left").select(*df.columns, F.coalesce("accepted", F.lit(False)).alias("accepted"))


def duplicate_recordings(df: DataFrame, content: str, run: str, label: str) -> DataFrame:
    """Digests seen in more than one run, with a flag for conflicting labels."""
    d = df.groupBy(F.sha2(F.col(content).cast("binary"), 256).alias("digest")).agg(
        F.count_distinct(run).alias("runs"), F.count_distinct(label).alias("labels"), F.min(run).alias("first_run"))
    return d.filter("runs > 1").withColumn("conflicting", F.col("labels") > 1)


def bulk_ingest(df: DataFrame, batch: str, keys: list[str], order: list[str], digest: str, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Replay batches in (device, sequence, index) order: per-item status and per-batch totals."""
    d = df.withColumns({"__ok": F.coalesce(valid, F.lit(False)), "__i": F.monotonically_increasing_id()})
    good = d.filter("__ok")
    # of items tied in order one is accepted: the least digest, and of identical ones any single one
    place = F.struct(F.struct(*order).alias("o"), F.col(digest).alias("d"), F.col("__i").alias("i"))
    first = good.groupBy(*keys).agg(F.min(place).alias("__f"))
    first = first.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__f")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    status = (F.when(place.eqNullSafe(F.col("__f")), "accepted").when(F.col(digest).eqNullSafe(F.col("__f.d")), "duplicate").otherwise("rejected"))
    items = (good.join(first, same).select(*df.columns, status.alias("item_status"))
             .unionByName(d.filter(~F.col("__ok")).select(*df.columns, F.lit("rejected").alias("item_status"))))
    totals = items.groupBy(batch).agg(*[F.count_if(F.col("item_status") == s).alias(n) for s, n in
                                        (("accepted", "accepted"), ("duplicate", "duplicates"), ("rejected", "rejected"))])
    return items, totals


def cap_per_key(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """Newest ``n`` rows per key; Spark limits each map task to ``n`` per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(o).desc() for o in order])
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def upsert_latest(target: DataFrame, updates: DataFrame, keys: list[str], revision: str) -> DataFrame:
    """Highest revision per key over both inputs.

    Of equal revisions an update replaces the target's row; of those of one side the greatest in its other columns counts.
    """
    both = target.withColumn("__update", F.lit(0)).unionByName(updates.withColumn("__update", F.lit(1)))
    rest = [c for c in target.columns if c not in keys]
    place = F.struct(revision, "__update", *[c for c in rest if c != revision])
    return both.groupBy(*keys).agg(F.max(place).alias("r")).select(*keys, *[f"r.{c}" for c in rest])


def unseen(df: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(seen.select(*keys).distinct(), keys, "left_anti")


def known(df: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(seen.select(*keys).distinct(), keys, "left_semi")
