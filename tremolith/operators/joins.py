"""Interval, nearest, as-of, scope and label joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numeric import bucket
from ..plans.scan import last_set, scan, declared_split

HOUR_US = 3_600_000_000
BROADCAST_ROWS = 200_000
TASK_PAIRS, MOST_TASKS = 2_000_000, 50_000
#: Tasks of events in lists before tasks take up to eight times TASK_PAIRS; events that one policy row meets in a run.
LIST_TASKS, LIST_RUN = 200, 256


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast only after a bounded count shows the side is small; otherwise leave the choice to Spark."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def with_registry(df: DataFrame, sites: DataFrame, assets: DataFrame, devices: DataFrame) -> DataFrame:
    """Telemetry with the site, asset and device rows it names (left, flags tell what exists).

    ``sites``: site; ``assets``: asset, site; ``devices``: device, site, asset, mapping, certificate.
    """
    s = small(sites.select(F.col("site").alias("__s")).distinct())
    a = small(assets.select(F.col("asset").alias("__a"), F.col("site").alias("__as")))
    d = small(devices.select(F.col("device").alias("__d"), F.col("site").alias("d_site"), F.col("asset").alias("d_asset"),
                             F.col("mapping").alias("d_mapping"), F.col("certificate").alias("d_certificate")))
    j = (df.join(s, F.col("site") == F.col("__s"), "left")
         .join(a, (F.col("asset") == F.col("__a")) & (F.col("site") == F.col("__as")), "left")
         .join(d, F.col("device") == F.col("__d"), "left"))
    return j.withColumns({"site_known": F.col("__s").isNotNull(), "asset_known": F.col("__a").isNotNull(),
                          "device_known": F.col("__d").isNotNull()}).drop("__s", "__a", "__as", "__d")


def interval_join(points: DataFrame, spans: DataFrame, keys: list[str], t: str, start: str, end: str, width: int = HOUR_US,
                  how: str = "inner") -> DataFrame:
    """Points inside closed spans of the same key; a span without an end is its first instant.

    Spans are copied to every coarse bucket they touch and points carry theirs, so the join is an
    equi-join on (key, bucket) with the exact range as residual: a hot key is spread over its buckets.
    """
    p = points.withColumn("__pb", bucket(t, width))
    until = F.coalesce(F.col(end), F.col(start))
    wide = spans.withColumns({"__until": until, "__sb": F.explode(F.sequence(bucket(start, width), bucket(until, width)))})
    wide = wide.select(*[F.col(k).alias(f"__s_{k}") for k in keys], *[c for c in spans.columns if c not in keys], "__until", "__sb")
    on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"__s_{k}") for k in keys],
                (F.col("__pb") == F.col("__sb")) & F.col(t).between(F.col(start), F.col("__until")))
    return p.join(wide, on, how).drop("__pb", "__sb", "__until", *[f"__s_{k}" for k in keys])


def label_events(points: DataFrame, events: DataFrame, keys: list[str], t: str, point_id: str, width: int = HOUR_US) -> DataFrame:
    """Each point with the best covering event: verified label first, then latest start, then highest id.

    ``events``: keys, start_us, end_us, event_id, verified, label, and optionally device/source scopes
    (null scope matches every point).
    """
    j = interval_join(points, events.withColumnsRenamed({"device": "e_device", "source": "e_source"}), keys, t, "start_us", "end_us", width, "left")
    fits = F.col("event_id").isNotNull()
    for scope in ("device", "source"):
        if scope in events.columns:
            fits = fits & (F.col(f"e_{scope}").isNull() | (F.col(f"e_{scope}") == F.col(scope)))
    event = F.struct("event_id", "label", "verified", F.col("start_us").alias("event_start_us"))
    rank = F.when(fits, F.struct("verified", "start_us", "event_id"))
    rest = [c for c in points.columns if c != point_id]
    g = j.groupBy(point_id).agg(F.any_value(F.struct(*rest)).alias("p"), F.max_by(F.when(fits, event), rank).alias("e"))
    return g.select(point_id, "p.*", "e.*").select(*points.columns, "event_id", "label", "verified", "event_start_us")


def event_context(events: DataFrame, points: DataFrame, keys: list[str], at: str, t: str, radius_us: int = 300_000_000,
                  width: int = HOUR_US) -> DataFrame:
    """All points within the closed radius around each event."""
    spans = events.withColumns({"__from": F.col(at) - radius_us, "__to": F.col(at) + radius_us})
    return interval_join(points, spans, keys, t, "__from", "__to", width).drop("__from", "__to")


def nearest_point(events: DataFrame, points: DataFrame, keys: list[str], event_id: str, at: str, t: str, order: list[str],
                  take: list[str], radius_us: int = 300_000_000, width: int = HOUR_US) -> DataFrame:
    """Per event the nearest point in time inside the radius; ties by canonical point order; null when none."""
    pairs = event_context(events, points, keys, at, t, radius_us, width)
    best = pairs.groupBy(event_id).agg(F.min_by(F.struct(*take), F.struct(F.abs(F.col(t) - F.col(at)), *order)).alias("n"))
    return events.join(best, event_id, "left").select(*events.columns, *[F.col("n")[c].alias(f"near_{c}") for c in take])


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, changed: str, values: list[str], width: int | None = None) -> DataFrame:
    """Latest right state at or before each left row, as one ordered scan instead of a range join."""
    state = F.struct(*[F.col(v) for v in values])
    r = right.select(*keys, F.col(changed).alias("__t"), F.lit(0).alias("__side"), state.alias("__state"))
    l = left.select(*keys, F.col(at).alias("__t"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"))
    both = r.unionByName(l, allowMissingColumns=True)
    s = scan(both, keys, ["__t", "__side"], declared_split("__t", width), seen=last_set(F.col("__state")))
    return s.filter("__side = 1").select("__row.*", *[F.col("seen")[v].alias(v) for v in values])


def applied_rule(events: DataFrame, rules: DataFrame, asset: str, version: str, values: list[str]) -> DataFrame:
    """The rule snapshot recorded by the event; unmatched versions are reported, not guessed."""
    r = rules.select(F.col(asset).alias("__ra"), F.col(version).alias("__rv"), *values, F.lit(True).alias("rule_found"))
    j = events.join(r, (F.col(asset) == F.col("__ra")) & (F.col(version) == F.col("__rv")), "left").drop("__ra", "__rv")
    return j.withColumn("rule_found", F.coalesce("rule_found", F.lit(False)))


def with_jobs(results: DataFrame, jobs: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    return results.join(jobs, keys, how)


def with_previous(df: DataFrame, keys: list[str], idx: str, values: list[str]) -> DataFrame:
    """Self equi-join on index - 1, independent of arrival order."""
    p = df.select(*keys, (F.col(idx) + 1).alias(idx), *[F.col(v).alias(f"prev_{v}") for v in values])
    return df.join(p, [*keys, idx], "left")


def scope_keys(policies: DataFrame) -> DataFrame:
    """One row for each (site, asset) that a policy covers, as ``__site`` and ``__asset``; null stands for any.

    A policy's sites are those of ``site_ids`` that ``scope_site_ids`` holds as well; an empty list covers all.
    """
    sites, scope, assets = F.col("site_ids"), F.col("scope_site_ids"), F.col("asset_ids")
    listed = lambda c: F.array_compact(F.array_distinct(c))
    every = lambda c: F.array(F.lit(None).cast(policies.schema[c].dataType.elementType))
    free = F.size(scope) == 0
    covered = (F.when(F.size(sites) > 0, F.when(free, listed(sites)).otherwise(listed(F.array_intersect(sites, scope))))
               .when(free, every("site_ids")).when(F.size(scope) > 0, listed(scope)))
    p = policies.withColumn("__site", F.explode(covered))
    return p.withColumn("__asset", F.explode(F.when(F.size(assets) > 0, listed(assets)).otherwise(every("asset_ids"))))


def scope_lookups(events: DataFrame) -> DataFrame:
    """Four copies of each event: its own site and asset, and any, as ``__es`` and ``__ea``."""
    own = lambda c: F.explode(F.array_distinct(F.array(F.col(c), F.lit(None).cast(events.schema[c].dataType))))
    return events.withColumn("__es", own("site")).withColumn("__ea", own("asset"))


def same_scope() -> Column:
    return F.col("__es").eqNullSafe(F.col("__site")) & F.col("__ea").eqNullSafe(F.col("__asset")) & (F.col("severity") == F.col("__severity"))


def match_scopes(events: DataFrame, policies: DataFrame, ident: str = "event_id", listed: bool = True) -> DataFrame:
    """Event-policy pairs whose severity, site and asset scopes agree, as an equi-join.

    Every event looks up its own site and asset and any of them, four keys per event.  ``policies``: policy_id, severity,
    site_ids, asset_ids, scope_site_ids, ...  There may be as many pairs as events times policies, so pairs are only made
    where events lie: events are dealt by ``ident`` over tasks of about TASK_PAIRS pairs, and policies are broadcast in
    blocks of BROADCAST_ROWS keys.  No pair is shuffled, and no key is one task.

    ``listed`` gathers the events of a key in each task, and each policy meets them in runs of up to LIST_RUN: a run repeats
    its policy, and the next policy repeats the run, so written pairs take a fraction of a byte.  Otherwise pairs stay
    dealt by ``ident``, where Spark knows it.
    """
    p = scope_keys(policies).withColumnRenamed("severity", "__severity")
    keys = scope_lookups(events.select("site", "asset", "severity")).groupBy("__es", "__ea", "severity").agg(F.count(F.lit(1)).alias("__e"))
    held = p.groupBy("__site", "__asset", "__severity").agg(F.count(F.lit(1)).alias("__p"))
    pairs = keys.join(held, same_scope()).agg(F.sum(F.col("__e") * F.col("__p")).alias("n")).first()["n"] or 0
    tasks = min(max(1, -(-pairs // TASK_PAIRS)), MOST_TASKS)
    if listed:
        # longer lists make longer runs
        tasks = min(tasks, max(LIST_TASKS, -(-pairs // (8 * TASK_PAIRS))))
        dealt = events.withColumn("__task", F.pmod(F.xxhash64(ident), F.lit(tasks)).cast("int")).repartitionById(tasks, "__task")
        e = scope_lookups(dealt).groupBy("__task", "__es", "__ea", "severity").agg(F.collect_list(F.struct(*events.columns)).alias("__all"))
        runs = F.transform(F.sequence(F.lit(1), F.size("__all"), F.lit(LIST_RUN)), lambda i: F.slice("__all", i, LIST_RUN))
        e = e.select("__es", "__ea", "severity", F.explode(runs).alias("__run"))
    else:
        e = scope_lookups(events.repartition(tasks, ident))
    blocks = max(1, -(-p.count() // BROADCAST_ROWS))
    part = F.pmod(F.xxhash64("policy_id", "__site", "__asset"), F.lit(blocks))
    parts = [e.join(F.broadcast(p if blocks == 1 else p.where(part == b)), same_scope()) for b in range(blocks)]
    met = reduce(DataFrame.unionAll, parts)
    if listed:
        own = [c for c in p.columns if c not in ("__site", "__asset", "__severity")]
        return met.select(*own, F.explode("__run").alias("__event")).select("__event.*", *own)
    return met.drop("__site", "__asset", "__severity", "__es", "__ea")


def map_labels(df: DataFrame, label: str, mapping: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Source label to target code: case-folded mapping first, else a direct taxonomy code."""
    m = small(mapping.select(F.lower(F.trim("source_label")).alias("__m"), F.upper(F.trim("target")).alias("__mt")).dropDuplicates(["__m"]))
    t = small(taxonomy.select(F.upper(F.trim("code")).alias("__t")).distinct())
    name = F.trim(F.col(label))
    j = df.join(m, F.lower(name) == F.col("__m"), "left").join(t, F.upper(name) == F.col("__t"), "left")
    return j.withColumn("target_label", F.coalesce("__mt", "__t")).drop("__m", "__mt", "__t")


def pair_cyclic(left: DataFrame, right: DataFrame, by: str, left_id: str, right_id: str, seed: int) -> DataFrame:
    """Seeded order on both sides, then row i of the left takes row i mod n of the right within ``by``."""
    from ..plans.scan import numbered
    mix = lambda c: F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(c).cast("string")), 256)
    part = lambda c: F.conv(F.substring(c, 1, 3), 16, 10).cast("long")
    l = numbered(left.withColumn("__h", mix(left_id)), [by], ["__h"], part("__h"), "__i")
    r = numbered(right.withColumn("__h", mix(right_id)), [by], ["__h"], part("__h"), "__j")
    n = right.groupBy(by).agg(F.count(F.lit(1)).alias("__n"))
    l = l.join(n, by).withColumn("__j", F.pmod(F.col("__i") - 1, F.col("__n")) + 1).drop("__h", "__i", "__n")
    return l.join(r.drop("__h"), [by, "__j"]).drop("__j")


def device_map(df: DataFrame, asset: str, split: Column, prefix: str = "DEV-") -> DataFrame:
    """Assets to generated device ids by sorted rank; only the distinct assets are ranked, bucket by bucket."""
    from ..plans.scan import numbered
    ranked = numbered(df.select(asset).distinct(), [], [asset], split, "__n")
    ranked = ranked.withColumn("device", F.concat(F.lit(prefix), F.lpad(F.col("__n").cast("string"), 3, "0"))).drop("__n")
    return df.join(ranked, asset)


def spine_join(df: DataFrame, keys: list[str], at: str, start: int, end: int, width: int, counts: dict[str, Column]) -> DataFrame:
    """Aggregates on a gap-free bucket spine per key; empty buckets get zero counts."""
    agg = df.groupBy(*keys, (F.floor(F.col(at) / width) * width).alias("bucket")).agg(*[c.alias(n) for n, c in counts.items()])
    spine = df.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(start), F.lit(end - 1), F.lit(width))).alias("bucket"))
    return spine.join(agg, [*keys, "bucket"], "left").fillna(0, list(counts))
