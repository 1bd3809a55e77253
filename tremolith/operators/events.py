"""Event, hysteresis and incident operators built on one run-length state core."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numeric import first_failure
from ..plans.reach import reach
from ..plans.scan import following, history, last_set, next_set, prev, running_max, running_sum, runs, scan, declared_split, declared_width
from ..session import cut


@dataclass(frozen=True)
class Lifecycle:
    """Entry, exit and merge controls; exit never above entry, so over and under runs are disjoint."""

    enter: float = 75.0
    exit: float = 50.0
    n_enter: int = 2
    n_exit: int = 2
    sec_enter: float = 0.0
    sec_exit: float = 0.0
    merge_gap_sec: int = 30

    def __post_init__(self):
        if not 0 <= self.exit <= self.enter <= 100:
            raise ValueError("need 0 <= exit <= enter <= 100")
        if min(self.n_enter, self.n_exit) < 1 or min(self.sec_enter, self.sec_exit, self.merge_gap_sec) < 0:
            raise ValueError("counts must be positive and durations non-negative")


def lifecycle_params(rules: DataFrame) -> DataFrame:
    """Rule rows to thresholds: exit is the threshold less its hysteresis, never below zero."""
    return rules.select(
        "*", F.col("threshold").cast("double").alias("score_enter"),
        F.greatest(F.lit(0.0), F.col("threshold") - F.col("hysteresis")).alias("score_exit"),
        F.col("duration_sec").cast("double").alias("sec_enter"),
        F.col("recovery_sec").cast("double").alias("sec_exit"))


def order_points(df: DataFrame, keys: list[str], t_us: str, device: str, seq: str, received: str,
                 arrival: str, split: Column | None) -> tuple[DataFrame, DataFrame]:
    """Split points into accepted (in total order on arrival) and out-of-order ones.

    A point is late when its (time, device, sequence, received) key is not above every key that
    arrived before it; ``arrival`` is the ordinal in which rows were stored.
    """
    key = F.struct(t_us, device, seq, received)
    marked = scan(df, keys, [arrival], split, __seen=running_max(key, inclusive=False))
    late = F.col("__seen").isNotNull() & (key <= F.col("__seen"))
    return marked.filter(~late).drop("__seen"), marked.filter(late).drop("__seen")


def classify(score: Column, fault: Column, cfg: Lifecycle) -> Column:
    """F fault, N no usable score, O at or above entry, U below exit, M between."""
    usable = score.isNotNull() & ~F.isnan(score) & score.between(0, 100)
    return (F.when(fault, "F").when(~F.coalesce(usable, F.lit(False)), "N")
            .when(score >= cfg.enter, "O").when(score < cfg.exit, "U").otherwise("M"))


def state_rows(df: DataFrame, keys: list[str], order: list[str], split: Column | None, cls: Column, t_us: str,
               n_enter: int, n_exit: int, sec_enter: float = 0.0, sec_exit: float = 0.0,
               unbroken: Column | None = None, value: str | None = None) -> DataFrame:
    """Row-level open/close state for an O/U/M/N/F stream.

    ``unbroken`` (an expression over ``before``, the previous row as a struct) additionally ends
    a run where it is false, e.g. at an index gap.  Adds ``opened``, ``closed``, ``active`` (after
    the row), ``trigger``, ``seg`` (one number for the rows of an open stretch), run columns and, with ``value``, ``run_peak``.
    """
    typed = df.withColumn("cls", cls)
    carried = F.struct("cls") if unbroken is None else F.struct(*[F.col(c) for c in typed.columns])
    one = scan(typed, keys, order, split, before=prev(carried), pos=running_sum(F.lit(1).cast("long")),
               faults=running_sum(F.when(F.col("cls") == "F", 1).otherwise(0).cast("long")))
    fresh = F.col("before").isNull() | (F.col("cls") != F.col("before.cls"))
    if unbroken is not None:
        fresh = fresh | ~F.coalesce(unbroken, F.lit(False))
    two = runs(one, keys, order, split, fresh, F.col(t_us)).drop("before")
    lasting = F.col(t_us) - F.col("run_at")
    trigger = (F.when((F.col("cls") == "O") & (F.col("run_n") >= n_enter) & (lasting >= sec_enter * 1e6), "open")
               .when((F.col("cls") == "U") & (F.col("run_n") >= n_exit) & (lasting >= sec_exit * 1e6), "recovered")
               .when(F.col("cls") == "F", "sensor_fault"))
    two = two.withColumn("trigger", trigger)
    if split is not None:
        two = cut(two)
    extra = {"run_peak": running_max(F.struct("run_id", F.col(value).alias("v")))} if value else {}
    # the last close or fault before a row is the same for all rows of one open stretch
    three = scan(two, keys, order, split, held=last_set(F.col("trigger"), inclusive=False),
                 seg=last_set(F.when(F.col("trigger") != "open", F.col("pos")), inclusive=False), **extra)
    was_open = F.coalesce(F.col("held") == "open", F.lit(False))
    out = three.withColumns({
        "opened": F.coalesce((F.col("trigger") == "open"), F.lit(False)) & ~was_open,
        "closed": F.coalesce((F.col("trigger") != "open"), F.lit(False)) & was_open,
        "seg": F.coalesce("seg", F.lit(0)), "was_open": was_open, "active": F.coalesce(F.coalesce("trigger", "held") == "open", F.lit(False))})
    if value:
        out = out.withColumn("run_peak", F.col("run_peak")["v"])
    return out.drop("held")


def segments(rows: DataFrame, keys: list[str], order: list[str], t_us: str, value: str) -> DataFrame:
    """One row per open-to-close stretch; partial aggregation keeps hot streams spread."""
    at = F.struct(*order)
    inside = rows.filter(F.col("opened") | F.col("was_open"))
    later = ~F.col("opened") & F.col(value).isNotNull()
    return inside.groupBy(*keys, "seg").agg(
        F.max(F.when(F.col("opened"), F.col("run_at"))).alias("start_us"),
        F.max(F.when(F.col("opened"), F.col(t_us))).alias("opened_us"),
        F.max(F.when(F.col("closed"), F.col(t_us))).alias("end_us"),
        F.max(F.when(F.col("closed"), F.col("trigger"))).alias("end_reason"),
        F.max(F.when(F.col("opened"), F.col("run_n"))).alias("lead_n"),
        F.max(F.when(F.col("opened"), F.col("run_peak")).otherwise(F.col(value))).alias("peak"),
        F.count(F.when(later, 1)).alias("later_n"),
        F.max_by(F.col(value), F.when(F.col(value).isNotNull(), at)).alias("last_value"),
        F.max(F.when(F.col("opened"), F.col("faults"))).alias("faults_open"),
        F.max(F.when(F.col("closed"), F.col("faults"))).alias("faults_end"),
        F.max(F.when(F.col("closed"), F.col("run_at"))).alias("exit_at"))


def event_lifecycle(df: DataFrame, keys: list[str], order: list[str], t_us: str, cfg: Lifecycle = Lifecycle(),
                    bucket_us: int | None = None) -> DataFrame:
    """Score points to merged events: start, end, reason, peak, samples and merge count."""
    split = declared_split(t_us, bucket_us)
    needed = [c for c in dict.fromkeys([*keys, *order, t_us]) if c not in ("score", "fault")]
    clean = df.select(*needed, F.when(~F.col("fault"), F.col("score")).alias("score"), "fault")
    rows = state_rows(clean, keys, order, split, classify(F.col("score"), F.col("fault"), cfg), t_us,
                      cfg.n_enter, cfg.n_exit, cfg.sec_enter, cfg.sec_exit, value="score")
    segs = segments(rows, keys, order, t_us, "score")
    # segments start in stream order, so the same time buckets split them
    seg_split = None
    if split is not None:
        segs = cut(segs.withColumn(t_us, F.col("start_us")).withColumn("__split", split).drop(t_us))
        seg_split = F.col("__split")
    chained = scan(segs, keys, ["seg"], seg_split, p=prev(F.struct("end_us", "end_reason", "faults_end")))
    gap = F.col("start_us") - F.col("p.end_us")
    merged = ((F.col("p.end_reason") == "recovered") & gap.between(0, cfg.merge_gap_sec * 1_000_000)
              & (F.col("faults_open") == F.col("p.faults_end")))
    numbered_events = scan(chained, keys, ["seg"], seg_split,
                           event_no=running_sum(F.when(merged, 0).otherwise(1).cast("long")))
    return numbered_events.groupBy(*keys, "event_no").agg(
        F.min("start_us").alias("start_us"), F.max_by("end_us", "seg").alias("end_us"),
        F.max_by("end_reason", "seg").alias("end_reason"), F.max("peak").alias("max_score"),
        F.sum(F.col("lead_n") + F.col("later_n")).alias("samples"),
        (F.count(F.lit(1)) - 1).alias("merge_count"), F.max_by("last_value", "seg").alias("last_score"))


def event_records(events: DataFrame, keys: list[str], rule_version: str, model: str) -> DataFrame:
    """Stored event shape: severity, status, duration and versions; the id is a digest, not random."""
    peak = F.bround("max_score")
    ident = F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.col("start_us").cast("string"), F.lit(rule_version)), 256)
    return events.select(
        F.concat(F.lit("EVENT-"), F.substring(ident, 1, 32)).alias("id"), *keys, "start_us", "end_us",
        F.when(F.col("end_us").isNull(), "open").otherwise("closed").alias("status"), "end_reason",
        F.when(peak >= 75, "critical").otherwise("warning").alias("severity"),
        ((F.col("end_us") - F.col("start_us")) / 1_000_000).cast("long").alias("duration_sec"),
        peak.cast("long").alias("max_score"), "samples", "merge_count",
        F.lit(rule_version).alias("threshold_version"), F.lit(model).alias("model_version"))


def apply_fault_boundary(points: DataFrame, faults: DataFrame, keys: list[str], t_us: str, seq: str,
                         bucket_rows: int | None = None) -> DataFrame:
    """Put health boundaries into the ordered stream and drop points at or before a boundary.

    A boundary that was received after later measurements moves up to the newest measurement that
    arrived before it.  ``arrival`` orders both inputs; points carry ``score``/``fault``.
    """
    both = (points.select(*keys, t_us, seq, "score", "fault", "arrival", F.lit(False).alias("boundary"))
            .unionByName(faults.select(*keys, t_us, F.lit(None).cast("long").alias(seq),
                                       F.lit(None).cast("double").alias("score"), F.lit(True).alias("fault"),
                                       "arrival", F.lit(True).alias("boundary"))))
    split = declared_split("arrival", bucket_rows)
    moved = scan(both, keys, ["arrival"], split, __top=running_max(F.col(t_us)))
    moved = moved.withColumn(t_us, F.when(F.col("boundary"), F.col("__top")).otherwise(F.col(t_us)))
    limited = scan(moved, keys, ["arrival"], split,
                   __limit=running_max(F.when(F.col("boundary"), F.col(t_us)), inclusive=False))
    keep = F.col("boundary") | F.col("__limit").isNull() | (F.col(t_us) > F.col("__limit"))
    return limited.filter(keep).drop("__top", "__limit")


def hysteresis(df: DataFrame, keys: list[str], idx: str, sigma: str, valid: Column, enter: float, exit: float,
               n_enter: int, n_exit: int, split: Column | None) -> tuple[DataFrame, DataFrame]:
    """Deviation stream to per-window states and events; an invalid window only breaks runs."""
    cls = (F.when(~F.coalesce(valid, F.lit(False)), "N").when(F.col(sigma) >= enter, "O")
           .when(F.col(sigma) < exit, "U").otherwise("M"))
    rows = state_rows(df.withColumn(sigma, F.when(valid, F.col(sigma))), keys, [idx], split, cls, idx,
                      n_enter, n_exit, value=sigma)
    states = rows.select(*keys, idx, F.when(F.col("cls") == "N", "INVALID").when(F.col("active"), "ANOMALY")
                         .otherwise("NORMAL").alias("state"), sigma)
    events = segments(rows, keys, [idx], idx, sigma).select(
        *keys, F.col("start_us").alias("start_index"), F.col("exit_at").alias("end_index"),
        F.col("peak").alias("max_sigma"))
    return states, events


def resolve_baseline(df: DataFrame, by_asset: DataFrame, by_type: DataFrame, default: DataFrame,
                     asset: str, kind: str, values: list[str]) -> DataFrame:
    """Baseline columns by asset id, else by asset type, else the default row."""
    a = by_asset.select(F.col(asset).alias("__a"), *[F.col(v).alias(f"__a_{v}") for v in values], F.lit(True).alias("__ha"))
    t = by_type.select(F.col(kind).alias("__t"), *[F.col(v).alias(f"__t_{v}") for v in values], F.lit(True).alias("__ht"))
    fallback = default.first()
    joined = df.join(a, F.col(asset) == F.col("__a"), "left").join(t, F.col(kind) == F.col("__t"), "left")
    pick = lambda v: (F.when(F.col("__ha"), F.col(f"__a_{v}")).when(F.col("__ht"), F.col(f"__t_{v}"))
                      .otherwise(F.lit(fallback[v] if fallback else None)))
    return joined.select(*df.columns, *[pick(v).alias(v) for v in values],
                         F.when(F.col("__ha"), "asset").when(F.col("__ht"), "type").otherwise("default").alias("resolved_by"))


# width and required hits of each persistence policy (fixed values)
POLICIES = {"single": (1, 1), "two_of_three": (3, 2), "three_of_five": (5, 3),
            "three_consecutive": (3, 3), "five_consecutive": (5, 5)}


def persistence(df: DataFrame, keys: list[str], idx: str, hit: str, valid: str,
                policies: dict[str, tuple[int, int]] = POLICIES, index_bucket: int | None = None) -> DataFrame:
    """Causal N-of-M decisions: -1 pending or invalid, 0 normal, 1 anomaly, one column per policy.  A null hit is no hit.

    A decision reads rows of unbroken indices only, so each bucket of indices gets copies of the few rows just before it and
    is judged by framed sums: one shuffle, and nothing to join back.
    """
    widest, size = max(w for w, _ in policies.values()), declared_width(idx, index_bucket)
    place = lambda c: F.floor(c / F.lit(size)).cast("long")
    own = place(F.col(idx))
    spread = df.withColumn("__b", F.explode_outer(F.sequence(own, place(F.col(idx) + (widest - 1)))))
    w = Window.partitionBy(*keys, "__b").orderBy(idx)
    ok, hit_ = F.coalesce(F.col(valid), F.lit(False)), F.coalesce(F.col(hit), F.lit(False)).cast("int")
    linked = spread.withColumns({"__own": F.col("__b").eqNullSafe(own), "__link": F.coalesce(
        ok & F.lag(valid).over(w) & (F.lag(idx).over(w) == F.col(idx) - 1), F.lit(False)).cast("int")})

    def decide(width: int, need: int) -> Column:
        complete = F.sum("__link").over(w.rowsBetween(2 - width, 0)) == width - 1 if width > 1 else F.lit(True)
        return F.when(ok & complete, (F.sum(hit_).over(w.rowsBetween(1 - width, 0)) >= need).cast("int")).otherwise(-1)

    return linked.select("*", *[decide(n, need).alias(p) for p, (n, need) in policies.items()]).filter("__own").drop("__b", "__own", "__link")


def confirm3(df: DataFrame, keys: list[str], order: list[str], split: Column | None, idx: str, uptime: str,
             verdict: str, available: Column, stream: list[str], model: list[str]) -> DataFrame:
    """Three consecutive verdicts with the reason why a chain was reset.

    Chains break, in this order of explanation, on a changed stream, changed model, an index gap, a
    start-to-start time outside 630-670 ms, or an unavailable predecessor.
    """
    base = df.withColumn("__ok", F.coalesce(available, F.lit(False)))
    fields = list(dict.fromkeys([*stream, *model, idx, uptime, verdict, "__ok"]))
    one = scan(base, keys, order, split, b=prev(F.struct(*fields)), pos=running_sum(F.lit(1).cast("long")))
    changed = lambda names: ~F.coalesce(F.struct(*names) == F.struct(*[F.col(f"b.{n}") for n in names]), F.lit(False))
    reason = (F.when(F.col("b").isNull(), "STREAM_START").when(changed(stream), "STREAM_CHANGED")
              .when(changed(model), "MODEL_CHANGED").when(F.col(idx) != F.col(f"b.{idx}") + 1, "WINDOW_GAP")
              .when(~(F.col(uptime) - F.col(f"b.{uptime}")).between(630_000, 670_000), "TIME_GAP")
              .when(~F.col("b.__ok"), "PREVIOUS_UNAVAILABLE"))
    one = one.withColumn("reset_reason", F.when(F.col("__ok"), reason).otherwise("UNAVAILABLE")).drop("b")
    linked = runs(one, keys, order, split, F.col("reset_reason").isNotNull(), F.col(uptime))
    back = history(linked, keys, order, split, F.struct("run_id", verdict), 2, "__h")
    mine = F.filter("__h", lambda s: s["run_id"] == F.col("run_id"))
    n = F.least(F.lit(3), F.col("run_n"))
    hits = F.aggregate(mine, F.col(verdict).cast("int"), lambda a, s: a + s[verdict].cast("int"))
    full = back.withColumns({
        "valid_windows": F.when(F.col("__ok"), n).otherwise(0).cast("int"),
        "hits": F.when(F.col("__ok"), hits).otherwise(0)})
    return full.withColumn("decision", F.when(F.col("valid_windows") < 3, -1).when(F.col("hits") == 3, 1).otherwise(0)).drop(
        "__h", "__ok", "run_id", "run_n", "run_at", "pos")


def incidents_3x3(df: DataFrame, keys: list[str], order: list[str], t_us: str, split: Column | None, verdict: str,
                  usable: Column, unbroken: Column) -> DataFrame:
    """Open on three hits, close on three clears, for streams keyed down to one target and model."""
    cls = F.when(~F.coalesce(usable, F.lit(False)), "N").when(F.col(verdict), "O").otherwise("U")
    rows = state_rows(df.withColumn("__v", F.col(verdict).cast("int")), keys, order, split, cls, t_us, 3, 3,
                      unbroken=unbroken, value="__v")
    return segments(rows, keys, order, t_us, "__v").select(
        *keys, "opened_us", "end_us", F.when(F.col("end_us").isNull(), "open").otherwise("closed").alias("status"),
        F.when(F.col("end_us").isNotNull(), "three_normal_windows").alias("end_reason"))


def incidents_exact(df: DataFrame, keys: list[str], order: list[str], t_us: str, idx: str, uptime: str, target: str, ok: Column, hit: Column,
                    bucket_width: int | None = None) -> DataFrame:
    """Incidents of streams whose target may change while one is open, as the log of the keyed stream form.

    Three linked hits of a target open an incident if none is open, three linked clears of the same target close it; other
    targets' hits meanwhile do nothing.  Triggers do not depend on the state, so an open trigger links to the first open
    trigger after the close of its own target, and the incidents are what is reached from the first trigger of a stream.
    Rows between that cannot be judged, or belong to another target, make the observation unknown.
    """
    split = declared_split(order[0], bucket_width)
    cls = F.when(~F.coalesce(ok, F.lit(False)), "N").when(hit, "O").otherwise("U")
    base = df.select(*keys, *dict.fromkeys([*order, t_us, idx, uptime, target]), cls.alias("cls"), F.coalesce(ok, F.lit(False)).alias("ok"))
    one = scan(base, keys, order, split, b=prev(F.struct("cls", target, idx, uptime)), pos=running_sum(F.lit(1).cast("long")))
    linked = ((F.col("b.cls") == F.col("cls")) & F.col(f"b.{target}").eqNullSafe(F.col(target)) & (F.col(f"b.{idx}") == F.col(idx) - 1)
              & (F.col(uptime) - F.col(f"b.{uptime}")).between(630_000, 670_000))
    two = runs(one, keys, order, split, ~F.coalesce(linked, F.lit(False)), F.col(t_us))
    trigger = F.when(F.col("run_n") >= 3, F.when(F.col("cls") == "O", "open").when(F.col("cls") == "U", "clear"))
    rows = cut(two.select(*keys, *dict.fromkeys([*order, t_us, target]), "ok", "pos", trigger.alias("trigger"), F.monotonically_increasing_id().alias("a")))
    by_pos = declared_split("pos", bucket_width)
    cleared = scan(rows.where("trigger is not null"), [*keys, target], ["pos"], by_pos, shut=next_set(F.when(F.col("trigger") == "clear", F.struct("pos", F.col(t_us).alias("t")))))
    opens = cleared.where("trigger = 'open'").drop("trigger", "ok")
    probes = opens.where("shut is not null").select(*keys, F.col("shut.pos").alias("pos"), F.col("a").alias("from"))
    both = opens.select(*keys, "pos", F.col("a").alias("to")).unionByName(probes, allowMissingColumns=True)
    links = scan(both, keys, ["pos"], by_pos, b=next_set("to")).where("from is not null and b is not null").select(F.col("from").alias("a"), "b")
    first = scan(opens.select(*keys, "pos", "a"), keys, ["pos"], by_pos, earlier=prev("a")).where("earlier is null").select("a")
    incidents = cut(opens.join(reach(first, links), "a"))
    opened = incidents.select(*keys, target, F.col(t_us).alias("opened_us"), F.lit("opened").alias("kind"), F.col(t_us).alias("at_us"))
    closed = incidents.where("shut is not null").select(*keys, target, F.col(t_us).alias("opened_us"), F.lit("closed").alias("kind"), F.col("shut.t").alias("at_us"))
    live = F.struct(F.col("pos").alias("pos"), F.col("shut.pos").alias("shut"), F.col(target).alias("target"), F.col(t_us).alias("t"))
    marked = rows.drop("trigger").join(incidents.select("a", live.alias("begins")), "a", "left")
    inside = scan(marked, keys, order, split, live=last_set("begins", inclusive=False)).where("live is not null and (live.shut is null or pos < live.shut)")
    inside = inside.withColumn("seen", F.when(F.col("ok") & F.col(target).eqNullSafe(F.col("live.target")), "observing").otherwise("unknown"))
    told = scan(inside, keys, order, split, before=prev(F.struct("live.pos", "seen")))
    was = F.when(F.col("before.pos") == F.col("live.pos"), F.col("before.seen")).otherwise("observing")
    seen = told.where(was != F.col("seen")).select(*keys, F.col("live.target").alias(target), F.col("live.t").alias("opened_us"), F.col("seen").alias("kind"), F.col(t_us).alias("at_us"))
    return opened.unionByName(closed).unionByName(seen)


def snapshot_reason(now_us: Column, captured: str, late: str, is_latest: str, quality: str, status: str,
                    score: str, threshold: float, verdict: str, mapped: Column, limit_sec: float) -> Column:
    """Why a snapshot result may not move an incident; null means it may (first failing rule wins)."""
    age = (now_us - F.col(captured)) / 1e6
    return first_failure(
        (mapped, "DEVICE_MAPPING_CHANGED"), (~F.col(late) & F.col(is_latest), "SUPERSEDED_OR_LATE_INPUT"),
        (age.between(-5, limit_sec), "INPUT_STALE_OR_FUTURE"), (F.col(quality) == "valid", "INPUT_QUALITY"),
        (F.col(status) == "completed", "MODEL_RESULT_UNAVAILABLE"),
        (F.col(score).isNotNull() & ~F.isnan(score) & (F.col(verdict) == (F.col(score) > threshold)), "MODEL_RESULT_INVALID"))


def snapshot_incidents(df: DataFrame, keys: list[str], order: list[str], t_us: str, split: Column | None,
                       eligible: Column, verdict: str) -> DataFrame:
    """One anomalous eligible observation opens, one normal eligible observation closes."""
    cls = F.when(~F.coalesce(eligible, F.lit(False)), "N").when(F.col(verdict), "O").otherwise("U")
    rows = state_rows(df.withColumn("__v", F.col(verdict).cast("int")), keys, order, split, cls, t_us, 1, 1, value="__v")
    return segments(rows, keys, order, t_us, "__v").select(
        *keys, F.col("opened_us").alias("occurred_us"), "end_us",
        F.when(F.col("end_us").isNull(), "open").otherwise("closed").alias("status"),
        F.when(F.col("end_us").isNotNull(), "single_normal_snapshot").alias("end_reason"))


def age_observations(incidents: DataFrame, latest: DataFrame, keys: list[str], now_us: Column, max_age_sec: float) -> DataFrame:
    """Open incidents whose newest input is absent or too old become unknown; they never recover by silence."""
    seen = latest.select(*keys, F.col("captured_us").alias("__seen"))
    stale = F.col("__seen").isNull() | ((now_us - F.col("__seen")) / 1e6 > max_age_sec)
    j = incidents.join(seen, keys, "left")
    is_open = F.col("status") == "open"
    return j.select(*incidents.columns,
                    F.when(is_open & stale, "unknown").when(is_open, "observing").otherwise("recovered").alias("observation"),
                    F.when(is_open & F.col("__seen").isNull(), "NO_INPUT").when(is_open & stale, "NO_RECENT_INPUT")
                    .alias("observation_reason"))


def offline_intervals(df: DataFrame, keys: list[str], order: list[str], t_us: str, offline_sec: int,
                      now_us: Column, bucket_us: int | None = None) -> DataFrame:
    """Telemetry gaps beyond the limit: offline since last + limit, recovered at the next row or still open."""
    nxt = scan(df.select(*dict.fromkeys([*keys, *order, t_us])), keys, order, declared_split(t_us, bucket_us), nxt=following(t_us))
    until = F.coalesce(F.col("nxt"), now_us)
    return nxt.filter(until - F.col(t_us) > offline_sec * 1_000_000).select(
        *keys, (F.col(t_us) + offline_sec * 1_000_000).alias("offline_us"), F.col("nxt").alias("recovered_us"))


def device_liveness(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Offline intervals as device_offline and device_recovered event rows."""
    both = F.array(F.struct(F.lit("device_offline").alias("event_type"), F.col("offline_us").alias("at_us")),
                   F.struct(F.lit("device_recovered").alias("event_type"), F.col("recovered_us").alias("at_us")))
    return intervals.select(*keys, F.explode(both).alias("e")).select(*keys, "e.event_type", "e.at_us").filter("at_us is not null")


def sensor_faults(devices: DataFrame, telemetry: DataFrame, key: str, order: list[str], now_us: Column,
                  signature: list[str], noise: str, offline_sec: int = 120) -> DataFrame:
    """Derived faults: no signal, reboot loop, power, stuck value, noise floor; one row each."""
    newest = F.row_number().over(Window.partitionBy(key).orderBy(*[F.col(o).desc() for o in order]))
    last5 = telemetry.withColumn("__rn", newest).filter("__rn <= 5").groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.struct(*signature)).alias("kinds"),
        F.avg(noise).alias("level"))
    d = devices.join(last5, key, "left")
    fault = lambda ok, code, sev: F.when(F.coalesce(ok, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity")))
    quiet = (F.col("health") == "offline") | ((now_us - F.col("last_us")) > offline_sec * 1_000_000)
    found = F.array_compact(F.array(
        fault(quiet, "no_signal", "critical"), fault(F.col("reboots") >= 3, "reboot_loop", "warning"),
        fault(F.col("battery_pct") <= 20, "power", "warning"),
        fault((F.col("n") >= 5) & (F.col("kinds") == 1), "stuck_value", "warning"),
        fault((F.col("n") >= 5) & (F.col("level") > 0.05), "noise_floor", "warning")))
    return d.select(key, F.explode(found).alias("f")).select(key, "f.code", "f.severity")


def fault_episodes(reports: DataFrame, keys: list[str], order: list[str], t_us: str, status: str,
                   bucket_us: int | None = None) -> DataFrame:
    """Active/recovered reports per (device, code) to episodes with whole-second duration."""
    split = declared_split(t_us, bucket_us)
    marked = scan(reports.select(*dict.fromkeys([*keys, *order, t_us, status])), keys, order, split, was=prev(status))
    edges = marked.filter(F.col("was").isNull() | (F.col("was") != F.col(status)))
    edges = edges if split is None else cut(edges)
    paired = scan(edges, keys, order, split, ended=following(t_us))
    return paired.filter(F.col(status) == "active").select(
        *keys, F.col(t_us).alias("start_us"), F.col("ended").alias("end_us"),
        F.when(F.col("ended").isNull(), "open").otherwise("closed").alias("status"),
        F.greatest(F.lit(0), F.floor((F.col("ended") - F.col(t_us)) / 1_000_000)).cast("long").alias("duration_sec"))


def edge_trigger(df: DataFrame, keys: list[str], order: list[str], split: Column | None, t_us: str, rms: str, peak: str,
                 usable: Column, linked: Column, cfg: dict) -> DataFrame:
    """Device trigger replay: severe, 2-of-3 low/high votes, quality, and a timed stable recovery.

    ``linked`` is an expression over ``b`` (previous row) telling whether the row continues it.
    """
    names = [c for c in df.columns]
    one = scan(df, keys, order, split, b=prev(F.struct(*names)), pos=running_sum(F.lit(1).cast("long")))
    first = F.col("b").isNull()
    joined = F.coalesce(linked, F.lit(False))
    bad = (~first & ~joined) | ~F.coalesce(usable, F.lit(False))
    one = one.withColumns({"bad": bad, "lo": F.col(rms) < cfg["low"], "hi": F.col(rms) > cfg["high"]}).drop("b")
    voted = history(one, keys, order, split, F.struct("bad", "lo", "hi"), 2, "__h")
    stop = F.aggregate(F.reverse("__h"), F.struct(F.lit(True).alias("go"), F.lit(0).alias("l"), F.lit(0).alias("h")),
                       lambda a, s: F.struct((a["go"] & ~s["bad"]).alias("go"),
                                             (a["l"] + F.when(a["go"] & ~s["bad"] & s["lo"], 1).otherwise(0)).alias("l"),
                                             (a["h"] + F.when(a["go"] & ~s["bad"] & s["hi"], 1).otherwise(0)).alias("h")))
    v = voted.withColumn("__votes", stop).drop("__h")
    severe = (F.col(rms) < cfg["severe_low"]) | (F.col(rms) > cfg["severe_high"]) | (F.col(peak) > cfg["severe_peak"])
    why = (F.when(F.col("bad"), "quality").when(severe, "severe")
           .when(F.col("lo").cast("int") + F.col("__votes.l") >= 2, "rms_low")
           .when(F.col("hi").cast("int") + F.col("__votes.h") >= 2, "rms_high"))
    v = v.withColumn("why", why).drop("__votes", "pos")
    cls = F.when(F.col("why").isNotNull(), "O").when(~F.col("lo") & ~F.col("hi"), "U").otherwise("M")
    rows = state_rows(v, keys, order, split, cls, t_us, 1, 1, 0.0, cfg["recovery_ms"] / 1000.0)
    return rows.select(*names, "active", F.when(F.col("why").isNotNull(), F.col("why"))
                       .when(F.col("active"), "recovery_hold").otherwise("none").alias("reason"))


def project_incidents(incidents: DataFrame, events: DataFrame, key: str, review: list[str]) -> DataFrame:
    """Newer incident revisions replace event fields; review fields of the stored event survive."""
    fields = [c for c in incidents.columns if c not in (key, *review)]
    i = incidents.select(F.col(key).alias("__ik"), *[F.col(c).alias(f"i_{c}") for c in incidents.columns if c != key])
    e = events.select(F.col(key).alias("__ek"), *[F.col(c).alias(f"e_{c}") for c in events.columns if c != key])
    newer = F.col("__ek").isNull() | (F.col("i_revision") > F.col("e_revision"))
    j = i.join(e, F.col("__ik") == F.col("__ek"), "full_outer")
    return j.select(F.coalesce("__ik", "__ek").alias(key),
                    *[F.when(F.col("__ik").isNotNull() & newer, F.col(f"i_{c}")).otherwise(F.col(f"e_{c}")).alias(c) for c in fields],
                    *[F.when(F.col("__ek").isNotNull(), F.col(f"e_{c}")).otherwise(F.col(f"i_{c}")).alias(c) for c in review])


def apply_resolutions(incidents: DataFrame, resolutions: DataFrame, key: str) -> DataFrame:
    """An operator closes only an open incident; the end reason says so."""
    r = resolutions.groupBy(key).agg(F.min("at_us").alias("__at"))
    close = (F.col("status") == "open") & F.col("__at").isNotNull()
    j = incidents.join(r, key, "left")
    keep = [c for c in incidents.columns if c not in ("status", "end_us", "end_reason")]
    return j.select(*keep, F.when(close, "closed").otherwise(F.col("status")).alias("status"),
                    F.when(close, F.col("__at")).otherwise(F.col("end_us")).alias("end_us"),
                    F.when(close, "operator_resolved").otherwise(F.col("end_reason")).alias("end_reason"))
