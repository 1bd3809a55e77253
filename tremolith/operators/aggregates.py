"""Aggregations: buckets, dashboards, baselines, metrics, thresholds, weights and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numeric import bucket, col, ratio, reasons
from ..plans.scan import prev, ranged_sum, running_sum, scan
from ..session import cut

# counters of a communication report that add up over windows (fixed values)
ADDITIVE = ["attempts", "retries", "replayAttempts", "acknowledged", "transportFailures", "retryableResponses",
            "configurationFailures", "rejectedPackets", "ackLatencyTotalMs", "bufferSamples", "bufferDepthSum",
            "bufferDropped", "wifiSamples", "offlineSamples"]


def _comm_metrics(at: Column) -> list[Column]:
    return [F.count("end_ms").alias("windows"),
            *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ADDITIVE],
            F.max(F.when(F.col("acknowledged") > 0, F.col("ackLatencyMaxMs"))).alias("ackLatencyMaxMs"),
            F.max("bufferDepthMax").alias("bufferDepthMax"), F.max_by("bufferDepthLast", at).alias("bufferDepthLast"),
            F.max_by("bufferCapacity", at).alias("bufferCapacity"),
            F.coalesce(F.sum(F.col("end_ms") - F.col("start_ms")), F.lit(0)).alias("observedDurationMs"),
            F.min("start_ms").alias("first_start_ms"), F.max("end_ms").alias("last_end_ms")]


def _comm_rates(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "failures": F.col("attempts") - F.col("acknowledged"), "hasData": F.col("windows") > 0,
        "failureRatePct": F.round(100 * ratio(F.col("attempts") - F.col("acknowledged"), "attempts"), 3),
        "retryRatePct": F.round(100 * ratio("retries", "attempts"), 3),
        "ackLatencyMeanMs": F.round(ratio("ackLatencyTotalMs", "acknowledged"), 3),
        "bufferDepthSampleMean": F.round(ratio("bufferDepthSum", "bufferSamples"), 3)})


def comm_quality(df: DataFrame, keys: list[str], t0_ms: int, t1_ms: int, width_sec: int, most_buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Whole windows attributed to the bucket of their end; empty buckets are emitted; plus one summary row per key.

    A window ending exactly on a boundary belongs to the earlier bucket.
    """
    if width_sec not in (60, 300, 3600, 86400):
        raise ValueError("width must be 60, 300, 3600 or 86400 seconds")
    width, first = width_sec * 1000, t0_ms // (width_sec * 1000) * (width_sec * 1000)
    if t1_ms <= t0_ms:
        raise ValueError("need a positive range")
    if most_buckets is not None and (t1_ms - 1 - first) // width + 1 > most_buckets:
        raise ValueError(f"need at most {most_buckets} buckets")
    live = df.filter((F.col("end_ms") > t0_ms) & (F.col("end_ms") <= t1_ms)).withColumn(
        "bucket_ms", F.floor((F.col("end_ms") - 1) / width) * width)
    at = F.struct("end_ms", "boot", "window_id")
    crossing = F.count_if(F.col("start_ms") < F.greatest(F.lit(t0_ms), F.col("bucket_ms"))).alias("crossBoundaryWindows")
    filled = live.groupBy(*keys, "bucket_ms").agg(*_comm_metrics(at), crossing)
    spine = df.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(first), F.lit(t1_ms - 1), F.lit(width))).alias("bucket_ms"))
    zeros = ["windows", *ADDITIVE, "observedDurationMs", "crossBoundaryWindows"]
    buckets = spine.join(filled, [*keys, "bucket_ms"], "left").fillna(0, zeros)
    return _comm_rates(buckets), _comm_rates(live.groupBy(*keys).agg(*_comm_metrics(at)))


SEVERITY = {"normal": 0, "warning": 1, "critical": 2}


def severity_rank(c: Column) -> Column:
    return F.coalesce(*[F.when(c == s, F.lit(r)) for s, r in SEVERITY.items()])


def site_summary(sites: DataFrame, assets: DataFrame, devices: DataFrame, events: DataFrame, live: DataFrame,
                 telemetry: DataFrame, excluded_labels: list[str]) -> DataFrame:
    """Per site: device counts, assets by worst of event and live status, unreviewed events, last reception."""
    worst_event = events.filter(~F.col("label").isin(excluded_labels)).groupBy("asset").agg(F.max(severity_rank(F.col("severity"))).alias("e"))
    worst_live = live.groupBy("asset").agg(F.max(severity_rank(F.col("status"))).alias("l"))
    rank = F.greatest(F.coalesce("e", F.lit(0)), F.coalesce("l", F.lit(0)))
    a = assets.join(worst_event, "asset", "left").join(worst_live, "asset", "left").withColumn("r", rank).groupBy("site").agg(
        *[F.count_if(F.col("r") == v).alias(f"{k}_assets") for k, v in SEVERITY.items()])
    d = devices.groupBy("site").agg(F.count(F.lit(1)).alias("devices"), F.count_if(F.col("health") != "offline").alias("online"),
                                    F.max("last_us").alias("d_last"))
    u = events.groupBy("site").agg(F.count_if(F.col("label") == "needs_review").alias("unreviewed"))
    t = telemetry.groupBy("site").agg(F.max("t_us").alias("t_last"))
    j = sites
    for part in (a, d, u, t):
        j = j.join(part, "site", "left")
    counts = ["normal_assets", "warning_assets", "critical_assets", "devices", "online", "unreviewed"]
    j = j.fillna(0, counts)
    return j.select(*sites.columns, *counts, F.greatest("d_last", "t_last").alias("last_us"),
                    F.when(F.col("critical_assets") > 0, "critical")
                    .when((F.col("warning_assets") > 0) | (F.col("online") < F.col("devices")), "warning").otherwise("normal").alias("status"))


def latest_status(df: DataFrame, key: str, status: str, order: list[str]) -> DataFrame:
    return df.groupBy(key).agg(F.max_by(status, F.struct(*order)).alias("status"))


def feature_baseline(df: DataFrame, values: str, normal: Column, sigma: float = 3.0) -> DataFrame:
    """Mean, population deviation, extremes and mean +/- k sigma per feature position, over NORMAL rows."""
    e = df.filter(normal).select(F.posexplode(values).alias("feature", "v"))
    g = e.groupBy("feature").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"),
                                 F.min("v").alias("min"), F.max("v").alias("max"))
    return g.withColumns({"low": F.col("mean") - sigma * F.col("std"), "high": F.col("mean") + sigma * F.col("std")})


def signal_baseline(df: DataFrame, by: list[str], value: str, ref: str, unit: str, condition: str, eligible: Column,
                    sigma: float = 3.0) -> DataFrame:
    """Baseline per scope from eligible rows, refused when units or conditions mix, refs repeat or rows are too few."""
    ok = df.filter(eligible & F.col(value).isNotNull())
    g = ok.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(ref).alias("refs"), F.count_distinct(unit).alias("units"),
                            F.count_distinct(condition).alias("conditions"), F.count_if(F.isnan(value) | (F.col(value) < 0)).alias("bad"),
                            F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    refuse = (F.when(F.col("n") < 2, "TOO_FEW_SAMPLES").when(F.col("refs") != F.col("n"), "DUPLICATE_REFERENCES")
              .when(F.col("bad") > 0, "INVALID_VALUE").when((F.col("units") > 1) | (F.col("conditions") > 1), "MIXED_UNITS_OR_CONDITIONS"))
    g = g.withColumn("refused", refuse)
    keep = lambda c: F.when(F.col("refused").isNull(), c)
    return g.select(*by, "n", "refused", *[keep(F.col(c)).alias(c) for c in ("mean", "std", "min", "max")],
                    keep(F.col("mean") - sigma * F.col("std")).alias("low"), keep(F.col("mean") + sigma * F.col("std")).alias("high"))


def event_detail(windows: DataFrame, events: DataFrame, key: str, idx: str, values: str, n: int) -> DataFrame:
    """Feature means before and from an event, their change, and whether either side misses windows.

    Each event is expanded to its 2n window positions, so the join is a plain equi-join.
    """
    want = events.select("event", key, F.explode(F.sequence(F.lit(-n), F.lit(n - 1))).alias("o"), F.col("event_idx"))
    want = want.withColumn("__i", F.col("event_idx") + F.col("o"))
    hit = want.join(windows.select(F.col(key).alias("__k"), F.col(idx).alias("__w"), F.col(values).alias("__v")),
                    (F.col(key) == F.col("__k")) & (F.col("__i") == F.col("__w")))
    rows = hit.select("event", (F.col("o") < 0).alias("before"), F.posexplode("__v").alias("feature", "v"))
    good = F.when(~F.isnan("v") & (F.abs("v") != float("inf")), F.col("v"))
    side = lambda b: F.when(F.col("before") == b, good)
    g = rows.groupBy("event", "feature").agg(
        F.avg(side(True)).alias("before_mean"), F.avg(side(False)).alias("after_mean"),
        F.stddev_pop(side(True)).alias("before_std"), F.stddev_pop(side(False)).alias("after_std"),
        F.count_if(F.col("before")).alias("before_n"), F.count_if(~F.col("before")).alias("after_n"))
    delta = F.col("after_mean") - F.col("before_mean")
    return g.withColumns({"delta": delta, "pct_change": F.when(F.abs("before_mean") > 1e-12, delta / F.abs("before_mean") * 100),
                          "before_missing": F.col("before_n") != n, "after_missing": F.col("after_n") != n})


def ingest_metrics(df: DataFrame, by: list[str], status: str) -> DataFrame:
    """Counts by outcome, error rate and health (below ten percent errors)."""
    is_ = lambda s: F.count_if(F.col(status) == s)
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("requests"), is_("accepted").alias("accepted"), is_("duplicate").alias("duplicates"),
                            is_("rejected").alias("rejected"), is_("conflict").alias("conflicts"))
    rate = 100 * ratio(F.col("rejected") + F.col("conflicts"), "requests")
    return g.withColumns({"error_rate_pct": F.round(rate, 2), "healthy": rate < 10})


def dependency_health(df: DataFrame, key: str, order: list[str], t_us: str, status: str, split: Column | None) -> DataFrame:
    """Report counts, failure rate, last failure and the last degraded-to-healthy transition."""
    s = scan(df, [key], order, split, __p=prev(status))
    up = (F.col(status) != "degraded") & (F.col("__p") == "degraded")
    g = s.groupBy(key).agg(
        F.count(F.lit(1)).alias("reports"), F.count_if(F.col(status) == "degraded").alias("failures"),
        F.max(F.when(F.col(status) == "degraded", F.col(t_us))).alias("last_failure_us"), F.max(F.when(up, F.col(t_us))).alias("last_recovery_us"),
        F.count_if(up).alias("recoveries"), F.max_by(status, F.struct(*order)).alias("status"))
    return g.withColumn("failure_rate_pct", F.round(100 * ratio("failures", "reports"), 2))


def inspect_table(df: DataFrame, by: list[str], status: str, captured: str, order: list[str], now_us: Column, row_limit: int,
                  backlog_sec: int, stale_sec: int) -> DataFrame:
    """Store health: rows by status, pending age, newest row and issue codes."""
    g = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col(status) == "queued").alias("pending"),
        F.count_if(F.col(status) == "unavailable").alias("unavailable"),
        F.min(F.when(F.col(status) == "queued", F.col(captured))).alias("oldest"),
        F.max_by(F.struct(F.col(status).alias("s"), F.col(captured).alias("c")), F.struct(*order)).alias("latest"))
    age = lambda c: (now_us - c) / 1e6
    why = reasons((F.col("rows") >= row_limit * 0.9, "ROW_CAPACITY"), (age(F.col("oldest")) > backlog_sec, "PROCESSING_BACKLOG"),
                  (~age(F.col("latest.c")).between(-5, stale_sec), "INPUT_STALE_OR_FUTURE"), (F.col("latest.s") == "unavailable", "INPUT_UNAVAILABLE"))
    return g.select(*by, "rows", "pending", "unavailable", age(F.col("oldest")).alias("oldest_pending_sec"),
                    F.col("latest.s").alias("latest_status"), age(F.col("latest.c")).alias("latest_age_sec"), why.alias("issues"))


def label_counts(df: DataFrame, by: list[str], status: str, eligible: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(eligible)).alias("eligible"),
                               *[F.count_if(F.col(status) == s).alias(s) for s in ("verified", "weak", "unlabeled", "unmapped")])


def distribution(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.groupBy(*cols).count().withColumnRenamed("count", "rows")


# ------------------------------------------------------------------ evaluation

def _confusion(label: Column, hit: Column) -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.count_if(label & hit).alias("tp"), F.count_if(~label & hit).alias("fp"),
            F.count_if(label & ~hit).alias("fn"), F.count_if(~label & ~hit).alias("tn")]


def _rates(df: DataFrame) -> DataFrame:
    or0 = lambda c: F.coalesce(c, F.lit(0.0))
    recall, spec = ratio("tp", F.col("tp") + F.col("fn")), ratio("tn", F.col("tn") + F.col("fp"))
    return df.withColumns({
        "precision": or0(ratio("tp", F.col("tp") + F.col("fp"))), "recall": recall, "fpr": ratio("fp", F.col("tn") + F.col("fp")),
        "f1": or0(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))),
        "accuracy": ratio(F.col("tp") + F.col("tn"), "n"), "balanced_accuracy": (recall + spec) / 2})


def binary_metrics(df: DataFrame, by: list[str], label: Column, hit: Column) -> DataFrame:
    """Confusion counts and rates; recall and FPR are null without positives or negatives."""
    return _rates(df.groupBy(*by).agg(*_confusion(label, hit)))


def roc_auc(df: DataFrame, by: list[str], label: Column, score: str, score_step: float = 1e-3) -> DataFrame:
    """Rank AUC with averaged ties: rows shrink to one per distinct score before any ordering, and without ``by`` the distinct
    scores are summed by ranges."""
    g = df.groupBy(*by, score).agg(F.count_if(label).alias("pos"), F.count(F.lit(1)).alias("n"))
    c = (scan(g, by, [score], F.floor(F.col(score) / score_step).cast("long"), below=running_sum("n", inclusive=False)) if by
         else ranged_sum(g, score, "n", "below", inclusive=False))
    rank = F.col("below") + (F.col("n") + 1) / 2
    t = c.groupBy(*by).agg(F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"), F.sum(F.col("pos") * rank).alias("r"))
    return t.select(*by, F.when((F.col("p") > 0) & (F.col("q") > 0),
                                (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p").cast("double") * F.col("q"))).alias("auc"))


def grouped_metrics(df: DataFrame, run: str, kind: str, label: str, hit: str) -> DataFrame:
    """Overall, per run and per fault label in one pass (grouping sets)."""
    view = df.select(F.col(run).alias("run"), F.col(kind).alias("kind"), F.col(label).alias("__l"), F.col(hit).alias("__h"))
    g = view.groupingSets([[], ["run"], ["kind"]], "run", "kind").agg(
        F.grouping_id().alias("gid"), *_confusion(F.col("__l"), F.col("__h")))
    return _rates(g).withColumn("scope", F.when(F.col("gid") == 3, "overall").when(F.col("gid") == 1, "run").otherwise("kind")).drop("gid")


def macro_fault_recall(grouped: DataFrame, healthy: str) -> DataFrame:
    return grouped.filter((F.col("scope") == "kind") & (F.col("kind") != healthy)).agg(F.avg("recall").alias("macro_fault_recall"))


def tristate_metrics(df: DataFrame, by: list[str], label: Column, decision: str) -> DataFrame:
    """Decisions -1/0/1: coverage, pending counts, recall and FPR over all windows of a class."""
    d = F.col(decision)
    g = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("windows"), F.count_if(d == -1).alias("pending"), F.count_if(label).alias("positive"),
        F.count_if(~label).alias("negative"), F.count_if(label & (d == 1)).alias("tp"), F.count_if(~label & (d == 1)).alias("fp"),
        F.count_if(label & (d == -1)).alias("pending_anomaly"), F.count_if(~label & (d == -1)).alias("pending_normal"))
    return g.withColumns({"coverage": ratio(F.col("windows") - F.col("pending"), "windows"), "detected_recall": ratio("tp", "positive"),
                          "fpr": ratio("fp", "negative")})


def quantile_higher(df: DataFrame, by: list[str], value: str, q: float, step: float) -> DataFrame:
    """The value at index ceil(q * (n - 1)) of the sorted group, from counts per distinct value."""
    g = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    c = scan(g, by, [value], F.floor(F.col(value) / step).cast("long"), upto=running_sum("n")) if by else ranged_sum(g, value, "n", "upto")
    n = g.groupBy(*by).agg(F.sum("n").alias("total"))
    c = c.join(n, by) if by else c.withColumn("__one", F.lit(1)).join(n.withColumn("__one", F.lit(1)), "__one")
    return c.filter(F.col("upto") > F.ceil(q * (F.col("total") - 1))).groupBy(*by).agg(F.min(value).alias("threshold"))


def normal_threshold(df: DataFrame, score: str, condition: str, label: Column, q: float = 0.99, step: float = 1e-3,
                     single: str | int | None = None) -> DataFrame:
    """Thresholds from normal rows only: first condition, pooled, and the maximum over conditions."""
    normal = df.filter(~label)
    each = quantile_higher(normal, [condition], score, q, step)
    pooled = quantile_higher(normal, [], score, q, step)
    one = each.agg(F.min_by("threshold", condition).alias("t")) if single is None else each.filter(F.col(condition) == single).select(F.col("threshold").alias("t"))
    return (one.select(F.lit("single").alias("policy"), F.col("t").alias("threshold"))
            .unionByName(pooled.select(F.lit("pooled").alias("policy"), "threshold"))
            .unionByName(each.agg(F.max("threshold").alias("threshold")).select(F.lit("max_condition").alias("policy"), "threshold")))


def sigma_threshold(df: DataFrame, by: list[str], error: str, k: float = 3.0) -> DataFrame:
    return df.groupBy(*by).agg((F.avg(error) + k * F.stddev_pop(error)).alias("threshold"))


def run_weights(df: DataFrame, label: str, run: str, normal_cost: float = 1.0) -> DataFrame:
    """Equal totals per class and equal runs inside a class; normal rows scaled by a cost."""
    per = df.groupBy(label, run).agg(F.count(F.lit(1)).alias("__n"))
    cls = per.groupBy(label).agg(F.count(F.lit(1)).alias("__runs"))
    total = per.agg(F.sum("__n").alias("__all")).withColumn("__one", F.lit(1))
    w = per.join(cls, label).withColumn("__one", F.lit(1)).join(total, "__one")
    weight = F.col("__all") / (2 * F.col("__runs") * F.col("__n")) * F.when(F.col(label), 1.0).otherwise(normal_cost)
    return df.join(w.select(label, run, weight.alias("weight")), [label, run])


def fold_summary(df: DataFrame, by: list[str]) -> DataFrame:
    """Mean and worst recall, FPR and balanced accuracy over folds."""
    return df.groupBy(*by).agg(F.avg("recall").alias("mean_recall"), F.avg("fpr").alias("mean_fpr"), F.min("recall").alias("worst_recall"),
                               F.max("fpr").alias("worst_fpr"), F.avg("balanced_accuracy").alias("mean_balanced"))


def choose_policy(summary: DataFrame, name: str, baseline: str, mean_fpr: float, worst_fpr: float, recall_loss: float) -> DataFrame:
    """Best eligible policy: inside the gate, at most ``recall_loss`` below the baseline; ties by FPR then name."""
    base = summary.filter(F.col(name) == baseline).agg(F.max("mean_recall").alias("__b")).withColumn("__one", F.lit(1))
    ok = (summary.withColumn("__one", F.lit(1)).join(base, "__one")
          .filter((F.col(name) != baseline) & (F.col("mean_fpr") <= mean_fpr) & (F.col("worst_fpr") <= worst_fpr)
                  & (F.col("mean_recall") >= F.col("__b") - recall_loss)))
    return ok.orderBy(F.col("mean_recall").desc(), "mean_fpr", name).limit(1).drop("__one", "__b")


def common_ready(df: DataFrame, keys: list[str], decision: str) -> DataFrame:
    """Row keys for which every policy has decided (no -1)."""
    ready = df.groupBy(*keys).agg(F.min(decision).alias("__m")).filter("__m >= 0").drop("__m")
    return df.join(ready, keys, "left_semi")


def error_cases(df: DataFrame, model: str, order: list[str], label: Column, hit: Column, n: int) -> DataFrame:
    """The first ``n`` false positives and false negatives per model."""
    wrong = df.filter(label != hit).withColumn("kind", F.when(hit, "false_positive").otherwise("false_negative"))
    w = Window.partitionBy(model, "kind").orderBy(*order)
    return wrong.withColumn("case_no", F.row_number().over(w)).filter(F.col("case_no") <= n)


def independent_holdout(df: DataFrame, specimen: str, split: str) -> DataFrame:
    """Specimens that occur in more than one split."""
    return df.groupBy(specimen).agg(F.count_distinct(split).alias("splits")).filter("splits > 1")


REQUIRED_POINT_FIELDS = ["position", "orientation", "mountingMethod", "photoRefs"]


def installation_status(points: DataFrame, assets: DataFrame, key: str, fields: list[str] = REQUIRED_POINT_FIELDS) -> DataFrame:
    """Ready when one active point is complete; otherwise the fields missing on any active point."""
    blank = lambda f: F.col(f).isNull() | (F.trim(F.col(f)) == "")
    active = points.filter("active").withColumn("__m", reasons(*[(blank(f), f) for f in fields]))
    g = active.groupBy(key).agg(F.count_if(F.size("__m") == 0).alias("complete_points"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("__m")))).alias("__all"))
    j = assets.join(g, key, "left")
    ready = F.coalesce(F.col("complete_points"), F.lit(0)) > 0
    return j.select(*assets.columns, F.coalesce("complete_points", F.lit(0)).alias("complete_points"),
                    F.when(ready, "ready").otherwise("missing").alias("status"),
                    F.when(ready, F.array().cast("array<string>")).when(F.col("__all").isNull(), F.array(F.lit("activeInstallPoint")))
                    .otherwise(F.col("__all")).alias("missing_fields"))


def environment_status(df: DataFrame, key: str, order: list[str], checks: list[str]) -> DataFrame:
    """Worst of the checks per inspection; each device shows its newest inspection."""
    rank = F.greatest(*[F.when(F.col(c) == "critical", 3).when(F.col(c) == "attention", 2).when(F.col(c) == "not_checked", 1).otherwise(0) for c in checks])
    name = F.element_at(F.array(F.lit("ok"), F.lit("not_checked"), F.lit("attention"), F.lit("critical")), rank + 1)
    return df.withColumn("__s", name).groupBy(key).agg(F.max_by("__s", F.struct(*order)).alias("environment_status"),
                                                       F.count(F.lit(1)).alias("inspections"))


def axis_correlation(df: DataFrame, key: str, axes: list[str]) -> DataFrame:
    """Pairwise Pearson correlation of sample arrays, clipped to [-1, 1]."""
    e = df.select(key, F.posexplode(F.arrays_zip(*axes)).alias("i", "s"))
    pairs = [(a, b) for i, a in enumerate(axes) for b in axes[i + 1:]]
    return e.groupBy(key).agg(*[F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.corr(f"s.{a}", f"s.{b}"))).alias(f"corr_{a}{b}") for a, b in pairs])
