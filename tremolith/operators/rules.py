"""Score-to-event lifecycle under rules that differ by asset and change with time.

A rule row holds from when it applies, its version, thresholds, durations and merge window.  Points carry the rule in force
as a column (an as-of join by the ordered scan), and thresholds are compared row by row.  A change of the rule is an edge:
the pending entry and the exit run begin anew, an open event stays open under the new limits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.scan import declared_split, last_set, prev, running_max, running_sum, scan
from ..session import cut

RULE = ["version", "active", "score_enter", "score_exit", "n_enter", "n_exit", "sec_enter", "sec_exit", "merge_gap_sec"]


def rule_rows(rules: DataFrame, keys: list[str]) -> DataFrame:
    """Rules with ``threshold``, ``hysteresis``, ``duration_sec`` and ``merge_gap_sec`` to the limits of the lifecycle.

    The exit limit is the threshold less its hysteresis, never below zero; both durations are the rule's; one point is
    enough where no count is given.  ``from_us`` is when the version starts to apply, ``active`` false stops the analysis.
    """
    number = lambda c: F.col(c) if c in rules.columns else F.lit(1)
    return rules.select(
        *keys, F.col("from_us").cast("long").alias("from_us"), F.col("version").cast("long").alias("version"), F.col("active").cast("boolean").alias("active"),
        F.col("threshold").cast("double").alias("score_enter"), F.greatest(F.lit(0.0), F.col("threshold").cast("double") - F.col("hysteresis")).alias("score_exit"),
        number("n_enter").cast("int").alias("n_enter"), number("n_exit").cast("int").alias("n_exit"), F.col("duration_sec").cast("double").alias("sec_enter"),
        F.col("duration_sec").cast("double").alias("sec_exit"), F.col("merge_gap_sec").cast("long").alias("merge_gap_sec"))


def with_rules(points: DataFrame, rules: DataFrame, keys: list[str], order: list[str], t_us: str, bucket_us: int | None = None) -> DataFrame:
    """Points with ``rule``, the latest one of their stream that applies at their time (the highest version of a tie)."""
    first = [t_us, "__what", "__version", *[o for o in order if o != t_us]]
    p = points.withColumns({"__what": F.lit(1), "__version": F.lit(None).cast("long"), "__set": F.lit(None).cast(_rule_type(rules))})
    r = rules.select(*keys, F.col("from_us").alias(t_us), F.lit(0).alias("__what"), F.col("version").alias("__version"), F.struct(*RULE).alias("__set"))
    both = scan(p.unionByName(r, allowMissingColumns=True), keys, first, declared_split(t_us, bucket_us), rule=last_set("__set"))
    return both.where("__what = 1").drop("__what", "__version", "__set")


def _rule_type(rules: DataFrame) -> str:
    kinds = dict(rules.dtypes)
    return "struct<" + ",".join(f"{c}:{kinds[c]}" for c in RULE) + ">"


def classify(score: Column, fault: Column, rule: Column) -> Column:
    """F fault, N no usable score, O at or above the rule's entry, U below its exit, M between."""
    usable = score.isNotNull() & ~F.isnan(score) & score.between(0, 100)
    return (F.when(fault, "F").when(~F.coalesce(usable, F.lit(False)), "N")
            .when(score >= rule["score_enter"], "O").when(score < rule["score_exit"], "U").otherwise("M"))


def event_lifecycle_rules(points: DataFrame, rules: DataFrame, keys: list[str], order: list[str], t_us: str, model: str = "model",
                          evidence: list[str] | None = None, bucket_us: int | None = None) -> DataFrame:
    """Merged events of ``points`` (score, fault, ``model``) under ``rules`` (see :func:`rule_rows`), one row an event.

    Points without a rule, or under an inactive one unless they are faults, are not analysed and leave the state alone.
    Besides start, end, reason, peak, samples and merges a row names the rule version that opened the event, the model of
    its first point, the model that reached the peak first, the point that triggered it (with the ``evidence`` columns) and
    the last point that touched it with that point's threshold.
    """
    split = declared_split(t_us, bucket_us)
    evidence = evidence or []
    needed = list(dict.fromkeys([*keys, *order, t_us]))
    rest = points.select(*needed, F.when(~F.col("fault"), F.col("score")).alias("score"), "fault", F.coalesce(F.col(model), F.lit("unknown")).alias("model"),
                         F.struct(*([F.col(c) for c in evidence] or [F.lit(None).alias("none")])).alias("evidence"))
    ruled = with_rules(rest, rules, keys, order, t_us, bucket_us).where("rule is not null and (rule.active or fault)")
    typed = ruled.withColumn("cls", classify(F.col("score"), F.col("fault"), F.col("rule")))
    one = scan(typed, keys, order, split, before=prev(F.struct("cls", "rule")), pos=running_sum(F.lit(1).cast("long")),
               faults=running_sum(F.when(F.col("cls") == "F", 1).otherwise(0).cast("long")))
    fresh = F.col("before").isNull() | (F.col("cls") != F.col("before.cls")) | (F.col("rule") != F.col("before.rule"))
    two = scan(one, keys, order, split, run=last_set(F.when(fresh, F.struct(F.col("pos").alias("p"), F.col(t_us).alias("t"), F.col("model").alias("m"))))).drop("before")
    rule, n, lasting = F.col("rule"), F.col("pos") - F.col("run.p") + 1, F.col(t_us) - F.col("run.t")
    opens = (F.col("cls") == "O") & (n >= rule["n_enter"]) & (lasting >= rule["sec_enter"] * 1e6)
    shuts = (F.col("cls") == "U") & (n >= rule["n_exit"]) & (lasting >= rule["sec_exit"] * 1e6)
    two = cut(two.withColumn("trigger", F.when(opens, "open").when(shuts, "recovered").when(F.col("cls") == "F", "sensor_fault")))
    # of equal scores the first counts: a later point takes the peak only by exceeding it
    scored = F.struct(F.col("score").alias("v"), (-F.col("pos")).alias("back"), F.col("model").alias("m"))
    three = scan(two, keys, order, split, held=last_set(F.col("trigger"), inclusive=False), top=running_max(F.struct("run.p", scored.alias("s"))),
                 # the last close or fault before a row is the same for all rows of an open stretch
                 seg=last_set(F.when(F.col("trigger") != "open", F.col("pos")), inclusive=False))
    was_open = F.coalesce(F.col("held") == "open", F.lit(False))
    opened = F.coalesce(F.col("trigger") == "open", F.lit(False)) & ~was_open
    rows = three.withColumns({"opened": opened, "was_open": was_open, "closed": F.coalesce(F.col("trigger") != "open", F.lit(False)) & was_open,
                              "seg": F.coalesce("seg", F.lit(0))}).where("opened or was_open")
    later = ~F.col("opened") & F.col("score").isNotNull() & (F.col("cls") != "N")
    at_open = lambda c: F.max(F.when(F.col("opened"), c))
    at_close = lambda c: F.max(F.when(F.col("closed"), c))
    touched = F.col("opened") | F.col("closed") | later
    order_key = F.struct(*order)
    segs = rows.groupBy(*keys, "seg").agg(
        at_open(F.col("run.t")).alias("start_us"), at_close(F.col(t_us)).alias("end_us"), at_close(F.col("trigger")).alias("end_reason"),
        at_open(F.col("pos") - F.col("run.p") + 1).alias("lead_n"), F.count(F.when(later, 1)).alias("later_n"),
        F.max(F.when(F.col("opened"), F.col("top.s")).when(later, scored)).alias("peak"),
        F.max_by("score", F.when(F.col("opened") | later, order_key)).alias("last_score"),
        at_open(F.col("faults")).alias("faults_open"), at_close(F.col("faults")).alias("faults_end"), at_open(rule["merge_gap_sec"]).alias("gap_sec"),
        at_open(F.struct(rule["version"].alias("version"), F.col("run.m").alias("model"))).alias("first"),
        F.min_by(F.struct(F.col(t_us).alias("at_us"), *[F.col(o) for o in order if o != t_us], "score", "model", "evidence"), F.when(F.col("opened"), order_key)).alias("trigger"),
        F.max_by(F.struct(F.col(t_us).alias("at_us"), rule["score_enter"].alias("threshold")), F.when(touched, order_key)).alias("last"))
    segs = cut(segs.withColumn(t_us, F.col("start_us")).withColumn("__split", split).drop(t_us))
    chained = scan(segs, keys, ["seg"], F.col("__split"), p=prev(F.struct("end_us", "end_reason", "faults_end")))
    gap = F.col("start_us") - F.col("p.end_us")
    merged = ((F.col("p.end_reason") == "recovered") & gap.between(0, F.col("gap_sec") * 1_000_000) & (F.col("faults_open") == F.col("p.faults_end")))
    events = scan(chained, keys, ["seg"], F.col("__split"), event_no=running_sum(F.when(merged, 0).otherwise(1).cast("long")))
    return events.groupBy(*keys, "event_no").agg(
        F.min("start_us").alias("start_us"), F.max_by("end_us", "seg").alias("end_us"), F.max_by("end_reason", "seg").alias("end_reason"),
        F.max("peak")["v"].alias("max_score"), F.max("peak")["m"].alias("max_model"), F.sum(F.col("lead_n") + F.col("later_n")).alias("samples"),
        (F.count(F.lit(1)) - 1).alias("merge_count"), F.max_by("last_score", "seg").alias("last_score"), F.min_by("first", "seg")["version"].alias("rule_version"),
        F.min_by("first", "seg")["model"].alias("model"), F.min_by("trigger", "seg").alias("trigger"), F.max_by("last", "seg").alias("last"))


def rule_event_records(events: DataFrame, keys: list[str]) -> DataFrame:
    """Stored shape of :func:`event_lifecycle_rules`: severity by the last point's threshold, duration up to the end or the last
    point, versions and trigger evidence.  The id is a digest of stream, start and version, so a replay repeats it."""
    peak = F.bround("max_score")
    ident = F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.col("start_us").cast("string"), F.col("rule_version").cast("string")), 256)
    return events.select(
        F.concat(F.lit("EVENT-"), F.substring(ident, 1, 32)).alias("id"), *keys, "start_us", "end_us", F.when(F.col("end_us").isNull(), "open").otherwise("closed").alias("status"),
        "end_reason", F.when(peak >= F.col("last.threshold"), "critical").otherwise("warning").alias("severity"),
        F.floor((F.coalesce("end_us", "last.at_us") - F.col("start_us")) / 1_000_000).alias("duration_sec"), peak.cast("long").alias("max_score"),
        F.bround("last_score").cast("long").alias("score"), "samples", "merge_count", F.col("rule_version").alias("threshold_version"), F.col("model").alias("model_version"),
        F.col("max_model").alias("max_score_model_version"), "trigger")
