"""Sequence, gap, clock and history operators over keyed window streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import bucket, reasons
from ..plans.scan import first_of, following, history, last_set, prev, running_max, running_sum, runs, scan
from ..session import cut

WINDOW_US = 640_000


def with_gap(df: DataFrame, keys: list[str], idx: str, split: Column | None) -> DataFrame:
    """Windows missing before each one; the first of a stream misses its own index."""
    s = scan(df, keys, [idx], split, __p=prev(idx))
    return s.withColumn("gap", F.when(F.col("__p").isNull(), F.col(idx)).otherwise(F.col(idx) - F.col("__p") - 1)).drop("__p")


def sequence_conflicts(df: DataFrame, keys: list[str], arrival: str, idx: str, uptime: str, context: list[str], split: Column | None) -> DataFrame:
    """In arrival order: index or uptime not increasing, or site/asset/profile changed."""
    s = scan(df, keys, [arrival], split, __i=running_max(F.col(idx), inclusive=False),
             __u=running_max(F.col(uptime), inclusive=False), __c=first_of(F.struct(*context)))
    why = (F.when(F.col("__i").isNull(), None).when(~F.col("__c").eqNullSafe(F.struct(*context)), "CONTEXT_CHANGED")
           .when((F.col(idx) <= F.col("__i")) | (F.col(uptime) <= F.col("__u")), "OUT_OF_ORDER"))
    return s.withColumn("conflict", why).drop("__i", "__u", "__c")


def accept_backfill(df: DataFrame, keys: list[str], arrival: str, idx: str, uptime: str, captured: str,
                    arrival_split: Column | None, idx_split: Column | None) -> DataFrame:
    """A late window may fill a hole only if uptime and time lie strictly between both index neighbours."""
    seen = scan(df, keys, [arrival], arrival_split, __top=running_max(F.col(idx), inclusive=False))
    seen = seen if arrival_split is None else cut(seen)
    pair = F.struct(F.col(uptime).alias("u"), F.col(captured).alias("c"))
    n = scan(seen, keys, [idx, arrival], idx_split, __b=prev(pair), __a=following(pair))
    late = F.col("__top").isNotNull() & (F.col(idx) <= F.col("__top"))
    fits = ((F.col("__b").isNull() | ((F.col("__b.u") < F.col(uptime)) & (F.col("__b.c") < F.col(captured))))
            & (F.col("__a").isNull() | ((F.col("__a.u") > F.col(uptime)) & (F.col("__a.c") > F.col(captured)))))
    return n.withColumns({"late": late, "accepted": ~late | fits}).drop("__top", "__a", "__b")


def clock_drift(df: DataFrame, keys: list[str], arrival: str, uptime: str, captured: str, split: Column | None,
                limit_us: int = 1_000_000) -> DataFrame:
    """Cumulative disagreement of UTC and uptime against the stream's first window."""
    s = scan(df, keys, [arrival], split, __a=first_of(F.struct(F.col(uptime).alias("u"), F.col(captured).alias("c"))))
    drift = F.abs((F.col(captured) - F.col("__a.c")) - (F.col(uptime) - F.col("__a.u")))
    return s.withColumns({"drift_us": drift, "clock_ok": drift <= limit_us}).drop("__a")


def is_continuous(df: DataFrame, keys: list[str], idx: str, uptime: str, split: Column | None,
                  low_us: int = 630_000, high_us: int = 670_000) -> DataFrame:
    """Start-to-start interval and whether it lies in the inclusive continuity range."""
    s = scan(df, keys, [idx], split, __p=prev(uptime))
    step = F.col(uptime) - F.col("__p")
    return s.withColumns({"interval_us": step, "continuous": F.coalesce(step.between(low_us, high_us), F.lit(False))}).drop("__p")


def flag_late(df: DataFrame, keys: list[str], arrival: str, captured: str, split: Column | None) -> DataFrame:
    """Late when not newer than everything that arrived before."""
    s = scan(df, keys, [arrival], split, __m=running_max(F.col(captured), inclusive=False))
    return s.withColumn("late", F.col("__m").isNotNull() & (F.col(captured) <= F.col("__m"))).drop("__m")


def make_sequences(df: DataFrame, keys: list[str], idx: str, n: int, value: Column, split: Column | None) -> DataFrame:
    """Non-overlapping sequences of ``n`` contiguous windows; a gap starts over, remainders are dropped."""
    one = scan(df.withColumn("__v", value), keys, [idx], split, __p=prev(idx), pos=running_sum(F.lit(1).cast("long")))
    linked = runs(one, keys, [idx], split, F.col("__p").isNull() | (F.col(idx) != F.col("__p") + 1), F.col(idx))
    chunk = F.floor((F.col("run_n") - 1) / n)
    g = linked.groupBy(*keys, "run_id", chunk.alias("chunk")).agg(
        F.min(idx).alias("start_idx"), F.count(F.lit(1)).alias("__n"),
        F.sort_array(F.collect_list(F.struct(F.col(idx).alias("i"), F.col("__v").alias("v")))).alias("__s"))
    return g.filter(F.col("__n") == n).select(*keys, "start_idx", F.transform("__s", lambda s: s["v"]).alias("sequence"))


def sequence_status(df: DataFrame, keys: list[str], idx: str, n: int, start: str, end: str, rate: str, captured: str) -> DataFrame:
    """Aligned model sequences [k*n, (k+1)*n): warming_up, SEQUENCE_GAP, SEQUENCE_DISCONTINUOUS or ready.

    Needs one row per (stream, index); groups are bounded by ``n``.
    """
    row = F.struct(F.col(idx).alias("i"), F.col(start).alias("s"), F.col(end).alias("e"), F.col(rate).alias("r"), F.col(captured).alias("c"))
    g = df.groupBy(*keys, F.floor(F.col(idx) / n).alias("__g")).agg(F.sort_array(F.collect_list(row)).alias("w"))
    first = F.element_at("w", 1)
    period = (first["e"] - first["s"]) / first["r"]
    slack = F.greatest(F.lit(1.0), period * 0.02)
    steady = F.forall("w", lambda x: (x["r"] == first["r"]) & (x["e"] - x["s"] == first["e"] - first["s"])
                      & (x["s"] == first["s"] + (x["i"] - first["i"]) * (first["e"] - first["s"]))
                      & (F.abs((x["c"] - first["c"]) / 1e6 - (x["i"] - first["i"]) * period) <= slack))
    g = g.withColumns({"full": F.size("w") == n, "steady": steady})
    e = g.select(*keys, "full", "steady", F.explode("w").alias("x"))
    last = F.pmod(F.col("x.i"), F.lit(n)) == n - 1
    return e.select(*keys, F.col("x.i").alias(idx),
                    F.when(~last, "warming_up").when(F.col("full") & F.col("steady"), "ready").otherwise("not_evaluated").alias("status"),
                    F.when(~last, "SEQUENCE_INCOMPLETE").when(~F.col("full"), "SEQUENCE_GAP")
                    .when(~F.col("steady"), "SEQUENCE_DISCONTINUOUS").alias("reason"))


def with_history(df: DataFrame, keys: list[str], order: list[str], split: Column | None, scheduled: Column, value: Column, n: int) -> DataFrame:
    """The last ``n`` scheduled values strictly before each row, for scheduled and event rows alike."""
    marked = df.withColumns({"__sched": F.coalesce(scheduled, F.lit(False)), "__val": value})
    sched = history(marked.filter("__sched"), keys, order, split, F.col("__val"), n, "history")
    tail = F.concat("history", F.array("__val"))
    tail = F.when(F.size(tail) <= n, tail).otherwise(F.slice(tail, -n, n))
    sched = sched.withColumn("__tail", tail)
    empty = F.slice(F.array("__val"), 1, 0)
    events = marked.filter(~F.col("__sched")).withColumns({"history": empty, "__tail": F.lit(None).cast(sched.schema["__tail"].dataType)})
    both = scan(sched.unionByName(events), keys, order, split, __prior=last_set(F.col("__tail"), inclusive=False))
    return both.withColumn("history", F.when(F.col("__sched"), F.col("history")).otherwise(F.coalesce("__prior", "history"))).drop(
        "__sched", "__val", "__tail", "__prior")


def _adjacent(a: Column, b: Column) -> Column:
    elapsed = (b["captured_us"] - a["captured_us"]) / 1e6
    uptime = (b["uptime_us"] - a["uptime_us"]) / 1e6
    return ((b["seq"] == a["seq"] + 1) & (b["slot"] == a["slot"] + 25) & (F.abs(elapsed - 25) <= 1.000001)
            & (F.abs(elapsed - uptime) <= 1.000001) & (uptime > 0))


def history_reason(hist: Column, current: Column, n: int) -> Column:
    """Null when the history supports a verdict, else why not.

    Entries and ``current`` are structs (captured_us, uptime_us, seq, slot, valid); an event row has a null slot.
    """
    pairs = F.zip_with(F.slice(hist, 1, n - 1), F.slice(hist, 2, n - 1), lambda a, b: F.coalesce(_adjacent(a, b), F.lit(False)))
    last = F.get(hist, F.lit(n - 1))
    delay = (current["captured_us"] - last["captured_us"]) / 1e6
    up = (current["uptime_us"] - last["uptime_us"]) / 1e6
    fresh = (delay > 0) & (delay <= 50) & (up > 0) & (up <= 50) & (F.abs(delay - up) <= 1)
    return (F.when(F.size(hist) != n, "HISTORY_INSUFFICIENT")
            .when(~F.forall(hist, lambda h: F.coalesce(h["valid"] & h["seq"].isNotNull() & h["slot"].isNotNull(), F.lit(False))), "HISTORY_QUALITY_OR_SCOPE")
            .when(~F.forall(pairs, lambda p: p), "HISTORY_DISCONTINUITY")
            .when(current["slot"].isNotNull() & ~F.coalesce(_adjacent(last, current), F.lit(False)), "HISTORY_DISCONTINUITY")
            .when(current["slot"].isNull() & ~F.coalesce(fresh, F.lit(False)), "EVENT_HISTORY_TOO_OLD"))


def audit_sessions(df: DataFrame, sessions: DataFrame, split: Column | None, tolerance_us: int = 1_000_000,
                   window_us: int = WINDOW_US) -> DataFrame:
    """Collection audit per session: counts, gaps, timing and clock error, coverage, blocking reasons.

    ``df``: session, boot, idx, uptime_us, captured_us, quality; ``sessions``: session, start_us, end_us,
    min_valid_sec, max_invalid, max_missing, max_timing_us (null = not agreed), reviewed (boolean).
    """
    rows = scan(df, ["session", "boot"], ["idx"], split,
                p=prev(F.struct("idx", "uptime_us", "captured_us")), a=first_of(F.struct("uptime_us", "captured_us")))
    step = F.col("idx") - F.col("p.idx")
    rows = rows.withColumns({
        "missing": F.coalesce(step - 1, F.lit(0)),
        "timing": F.coalesce(F.abs(F.col("uptime_us") - F.col("p.uptime_us") - step * window_us), F.lit(0)),
        "drift": F.abs((F.col("captured_us") - F.col("a.captured_us")) - (F.col("uptime_us") - F.col("a.uptime_us"))),
        "disorder": F.col("p").isNotNull() & ((step <= 0) | (F.col("uptime_us") <= F.col("p.uptime_us")) | (F.col("captured_us") < F.col("p.captured_us")))})
    per = rows.groupBy("session", "boot").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == "valid").alias("v"), F.sum("missing").alias("m"),
        F.max("timing").alias("t"), F.max("drift").alias("d"), F.count_if("disorder").alias("bad"),
        F.min("captured_us").alias("c0"), F.max("captured_us").alias("c1"),
        (F.max("uptime_us") - F.min("uptime_us") + window_us).alias("span"))
    g = per.groupBy("session").agg(
        F.sum("n").alias("windows"), F.sum("v").alias("valid"), F.sum("m").alias("missing"), F.max("t").alias("timing_us"),
        F.max("d").alias("drift_us"), F.sum("bad").alias("disordered"), F.count(F.lit(1)).alias("boots"),
        F.min("c0").alias("first_us"), F.max("c1").alias("last_us"), F.max("span").alias("uptime_span_us"))
    j = sessions.join(g, "session", "left").fillna(0, ["windows", "valid", "missing", "timing_us", "drift_us", "disordered", "boots", "uptime_span_us"])
    span = F.col("end_us") - F.col("start_us")
    edge = window_us + tolerance_us
    why = reasons(
        (~F.col("reviewed"), "HUMAN_NORMAL_REVIEW_REQUIRED"), (F.col("boots") != 1, "REQUIRE_ONE_BOOT_PER_SESSION"),
        (F.col("windows") < 2, "INSUFFICIENT_TIMING_PAIRS"), (F.col("drift_us") > tolerance_us, "TIMESTAMP_UPTIME_MISMATCH"),
        (F.col("valid") * (window_us / 1e6) < F.col("min_valid_sec"), "INSUFFICIENT_VALID_DURATION"),
        (F.col("windows") - F.col("valid") > F.col("max_invalid"), "INVALID_WINDOW_LIMIT"),
        (F.col("missing") > F.col("max_missing"), "MISSING_WINDOW_LIMIT"),
        (F.col("max_timing_us").isNull(), "TIMING_TOLERANCE_NOT_AGREED"),
        (F.col("timing_us") > F.col("max_timing_us"), "TIMING_TOLERANCE_EXCEEDED"),
        ((F.col("windows") < F.greatest(F.lit(0), F.floor(span / window_us) - 1)) | F.col("first_us").isNull()
         | (F.col("first_us") - F.col("start_us") > edge) | (F.col("end_us") - (F.col("last_us") + window_us) > edge)
         | (F.col("uptime_span_us") + 2 * window_us < span - 1), "INCOMPLETE_REQUESTED_INTERVAL"))
    return j.select("session", "windows", "valid", "missing", "timing_us", "drift_us", "disordered", "boots",
                    why.alias("blocking_reasons"), (F.size(why) == 0).alias("passes"))


def assign_lane(df: DataFrame, captured: str, mode: str, now_us: Column) -> DataFrame:
    """Priority deliveries aged -5 to 30 s are live; everything else is history.  ``rank`` orders work."""
    age = (now_us - F.col(captured)) / 1e6
    return df.withColumns({
        "lane": F.when((F.col(mode) == "priority") & age.between(-5, 30), "live").otherwise("history"),
        "work_rank": F.when(F.col(mode) == "priority", 0).otherwise(1)})


def select_slot_window(df: DataFrame, keys: list[str], captured: str, valid: Column, slot_sec: int = 25,
                       width_sec: float = 1.640, window_us: int = WINDOW_US) -> DataFrame:
    """Newest valid window that starts and ends inside the stretch before each slot boundary."""
    end = F.col(captured) + window_us
    slot = F.ceil(end / (slot_sec * 1_000_000)).cast("long") * slot_sec
    fit = df.withColumn("slot", slot).filter(valid & (F.col(captured) >= F.col("slot") * 1_000_000 - int(width_sec * 1_000_000)))
    rest = [c for c in df.columns if c not in keys]
    return fit.groupBy(*keys, "slot").agg(F.max_by(F.struct(*rest), captured).alias("r")).select(*keys, "slot", "r.*")
