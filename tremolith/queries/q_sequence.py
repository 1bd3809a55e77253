"""Sequence, gap, clock and de-duplication queries."""

from pyspark.sql import functions as F

from ..functions.numeric import r6
from ..operators import dedupe as dd, sequence as sq
from ..plans.registry import query
from ..plans.scan import declared_split
from ..sources.tables import DAY_US, points, snapshots, table, vectors, windows
from . import sql
from .q_events import _NOW, first_windows

KEYS = ["device", "boot"]


def sized(spark, sf, at="idx"):
    return declared_split(at)


@query("d01_gap", f"""with {sql.FIRST_WINDOWS} select device, boot, idx,
  coalesce(idx - lag(idx) over (partition by device, boot order by idx) - 1, idx) as gap from fw""")
def d01(spark, sf):
    return sq.with_gap(first_windows(spark, sf).select("device", "boot", "idx"), KEYS, "idx", sized(spark, sf))


@query("d02_sequence_conflicts", f"""with {sql.WINDOWS}, r as (select *, max(idx) over w as mi, max(uptime_us) over w as mu,
  first_value(site) over (partition by device, boot order by ordinal) as s0 from windows
  window w as (partition by device, boot order by ordinal rows between unbounded preceding and 1 preceding))
  select ordinal, case when mi is null then null when s0 <> site then 'CONTEXT_CHANGED' when idx <= mi or uptime_us <= mu then 'OUT_OF_ORDER' end as conflict from r""")
def d02(spark, sf):
    return sq.sequence_conflicts(windows(spark, sf), KEYS, "ordinal", "idx", "uptime_us", ["site"], sized(spark, sf, "ordinal")).select("ordinal", "conflict")


_LATE_SQL = f"""{sql.FIRST_WINDOWS}, q as (select *, case when k % 6 = 0 then ordinal + 40 * (k + 1) else ordinal end as arrival, ordinal as o2 from fw), a as (
  select *, max(idx) over (partition by device, boot order by arrival, o2 rows between unbounded preceding and 1 preceding) as top from q)"""


def _late(spark, sf):
    w = first_windows(spark, sf)
    return w.withColumn("arrival", F.when(F.col("k") % 6 == 0, F.col("ordinal") + 40 * (F.col("k") + 1)).otherwise(F.col("ordinal"))).withColumn(
        "arrival", F.col("arrival") * 10_000_000 + F.col("ordinal"))


@query("d03_accept_backfill", f"""with {_LATE_SQL}, n as (select *, lag(uptime_us) over w as bu, lag(captured_us) over w as bc, lead(uptime_us) over w as au, lead(captured_us) over w as ac
  from a window w as (partition by device, boot order by idx))
  select device, boot, idx, top is not null and idx <= top as late, (top is null or idx > top) or
    ((bu is null or (bu < uptime_us and bc < captured_us)) and (au is null or (au > uptime_us and ac > captured_us))) as accepted from n""")
def d03(spark, sf):
    late = _late(spark, sf)
    return sq.accept_backfill(late, KEYS, "arrival", "idx", "uptime_us", "captured_us", declared_split("arrival"), sized(spark, sf)).select("device", "boot", "idx", "late", "accepted")


@query("d04_clock_drift", f"""with {sql.FIRST_WINDOWS}, a as (select *, first_value(uptime_us) over w as u0, first_value(captured_us) over w as c0
  from fw window w as (partition by device, boot order by ordinal))
  select device, boot, idx, abs((captured_us - c0) - (uptime_us - u0)) as drift_us, abs((captured_us - c0) - (uptime_us - u0)) <= 1000000 as clock_ok from a""")
def d04(spark, sf):
    return sq.clock_drift(first_windows(spark, sf), KEYS, "ordinal", "uptime_us", "captured_us", sized(spark, sf, "ordinal")).select(
        "device", "boot", "idx", "drift_us", "clock_ok")


@query("d05_continuity", f"""with {sql.FIRST_WINDOWS}, u as (select device, boot, idx, idx * 650000 + (k % 60) * 1000 - 30000 as up from fw), s as (
  select *, up - lag(up) over (partition by device, boot order by idx) as step from u)
  select device, boot, idx, step as interval_us, coalesce(step between 630000 and 670000, false) as continuous from s""")
def d05(spark, sf):
    w = first_windows(spark, sf).select("device", "boot", "idx", (F.col("idx") * 650_000 + (F.col("k") % 60) * 1000 - 30_000).alias("up"))
    return sq.is_continuous(w, KEYS, "idx", "up", sized(spark, sf)).drop("up")


@query("d06_flag_late", f"""with {_LATE_SQL}, l as (select *, max(captured_us) over (partition by device, boot order by arrival, o2 rows between unbounded preceding and 1 preceding) as m from a)
  select device, boot, idx, m is not null and captured_us <= m as late from l""")
def d06(spark, sf):
    late = _late(spark, sf)
    return sq.flag_late(late, KEYS, "arrival", "captured_us", declared_split("arrival")).select("device", "boot", "idx", "late")


@query("d07_make_sequences", f"""with {sql.FIRST_WINDOWS}, i as (select *, idx - row_number() over (partition by device, boot order by idx) as isl from fw), c as (
  select *, (row_number() over (partition by device, boot, isl order by idx) - 1) // 3 as ch from i)
  select device, boot, min(idx) as start_idx, count(*) as n, round(sum(value), 6) + 0.0 as total, arg_max(k, idx) as last_k
  from c group by device, boot, isl, ch having count(*) = 3""")
def d07(spark, sf):
    s = sq.make_sequences(first_windows(spark, sf), KEYS, "idx", 3, F.struct("value", "k"), sized(spark, sf))
    total = F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x["value"])
    return s.select("device", "boot", "start_idx", F.size("sequence").cast("long").alias("n"), r6(total).alias("total"),
                    F.element_at("sequence", -1)["k"].alias("last_k"))


@query("d08_sequence_status", f"""with {sql.FIRST_WINDOWS}, g as (select *, idx // 3 as grp, idx * 512 + case when k = 77 then 1 else 0 end as s from fw), f as (
  select *, first_value(idx) over w as i0, first_value(s) over w as s0, first_value(captured_us) over w as c0, count(*) over (partition by device, boot, grp) as n
  from g window w as (partition by device, boot, grp order by idx)), v as (
  select *, min(cast(s = s0 + (idx - i0) * 512 and abs((captured_us - c0) / 1e6 - (idx - i0) * 900.0) <= 300.0 as int)) over (partition by device, boot, grp) as steady
  from f)
  select device, boot, idx, case when idx % 3 <> 2 then 'warming_up' when n = 3 and steady = 1 then 'ready' else 'not_evaluated' end as status,
    case when idx % 3 <> 2 then 'SEQUENCE_INCOMPLETE' when n <> 3 then 'SEQUENCE_GAP' when steady = 0 then 'SEQUENCE_DISCONTINUOUS' end as reason from v""")
def d08(spark, sf):
    # 512 samples per 900-second slot; the capture slack becomes a third of a slot through the clock scale
    w = first_windows(spark, sf).select(
        "device", "boot", "idx", (F.col("idx") * 512 + F.when(F.col("k") == 77, 1).otherwise(0)).alias("s"), F.lit(512).alias("n"),
        (F.col("captured_us") / 300).alias("c")).withColumn("e", F.col("s") + F.col("n")).withColumn("rate", F.lit(512.0 / 3.0))
    return sq.sequence_status(w, KEYS, "idx", 3, "s", "e", "rate", "c")


_SNAP_SQL = f"""{sql.SNAPSHOTS}, h as (
  select stream, vec_id, x, row_number() over (partition by stream order by vec_id) - 1 as pos, vec_id % 9 = 4 as event from snapshots), hs as (
  select *, case when not event then sum(cast(not event as bigint)) over (partition by stream order by vec_id) - 1 end as seq from h), cur as (
  select stream, vec_id, x, event, seq, case when event then null else seq * 25 end as slot, vec_id % 41 <> 7 as valid,
    coalesce(seq * 25, last_value(seq ignore nulls) over (partition by stream order by vec_id) * 25 + 10, 0) * 1000000 + case when vec_id % 53 = 5 then 3000000 else 0 end as captured_us,
    coalesce(seq * 25, last_value(seq ignore nulls) over (partition by stream order by vec_id) * 25 + 10, 0) * 1000000 as uptime_us from hs)"""


def snapshot_stream(spark, sf):
    """Snapshots as a 25-second schedule with event rows in between, a few shifted clocks and bad windows."""
    from ..plans.scan import last_set, running_sum, scan
    s = snapshots(spark, sf).withColumn("event", F.col("vec_id") % 9 == 4)
    split = declared_split("vec_id")
    s = scan(s, ["stream"], ["vec_id"], split, n=running_sum(F.when(~F.col("event"), 1).otherwise(0).cast("long")))
    slot = (F.col("n") - 1) * 25
    at = F.when(~F.col("event"), slot).when(F.col("n") > 0, slot + 10).otherwise(0) * 1_000_000
    return s.select("stream", "vec_id", "x", "event", F.when(~F.col("event"), F.col("n") - 1).alias("seq"),
                    F.when(~F.col("event"), slot).alias("slot"), (F.col("vec_id") % 41 != 7).alias("valid"),
                    (at + F.when(F.col("vec_id") % 53 == 5, 3_000_000).otherwise(0)).alias("captured_us"), at.alias("uptime_us"))


ENTRY = ["captured_us", "uptime_us", "seq", "slot", "valid", "x"]


def with_24(spark, sf, n=24):
    s = snapshot_stream(spark, sf)
    return sq.with_history(s, ["stream"], ["vec_id"], declared_split("vec_id"), ~F.col("event"), F.struct(*ENTRY), n)


@query("d09_history_assembly", f"""with {_SNAP_SQL}, s as (select * from cur where not event), j as (
  select c.stream, c.vec_id, s.vec_id as hv, s.x as hx, row_number() over (partition by c.vec_id order by s.vec_id desc) as rn from cur c
  left join s on s.stream = c.stream and s.vec_id < c.vec_id)
  select stream, vec_id, count(hv) as records, min(hv) as oldest, max(hv) as newest, round(coalesce(sum(hx[1]), 0), 6) + 0.0 as sum_x1 from j where rn <= 24 group by stream, vec_id""")
def d09(spark, sf):
    s = snapshot_stream(spark, sf)
    h = sq.with_history(s, ["stream"], ["vec_id"], declared_split("vec_id"), ~F.col("event"), F.struct("vec_id", "x"), 24)
    ids = F.transform("history", lambda e: e["vec_id"])
    return h.select("stream", "vec_id", F.size("history").cast("long").alias("records"), F.array_min(ids).alias("oldest"),
                    F.array_max(ids).alias("newest"), r6(F.aggregate("history", F.lit(0.0), lambda a, e: a + e["x"][0])).alias("sum_x1"))


_REASON_SQL = f"""{_SNAP_SQL}, s as (select *, captured_us - lag(captured_us) over w as dc, uptime_us - lag(uptime_us) over w as du, row_number() over w as sn
  from cur where not event window w as (partition by stream order by vec_id)), j as (
  select c.vec_id, c.stream, c.event, c.captured_us, c.uptime_us, c.slot, c.seq, s.vec_id as hv, s.valid as hvalid, s.captured_us as hc, s.uptime_us as hu, s.dc, s.du,
    row_number() over (partition by c.vec_id order by s.vec_id desc) as rn from cur c left join s on s.stream = c.stream and s.vec_id < c.vec_id), r as (
  select stream, vec_id, count(hv) as n, bool_and(hvalid) as ok, bool_and(rn = 24 or (abs(dc / 1e6 - 25) <= 1.000001 and abs((dc - du) / 1e6) <= 1.000001)) as cont,
    max(case when rn = 1 then (captured_us - hc) / 1e6 end) as delay, max(case when rn = 1 then (uptime_us - hu) / 1e6 end) as up, bool_or(event) as event
  from j where rn <= 24 group by stream, vec_id), reasons as (
  select stream, vec_id, event, case when n <> 24 then 'HISTORY_INSUFFICIENT' when not ok then 'HISTORY_QUALITY_OR_SCOPE' when not cont then 'HISTORY_DISCONTINUITY'
    when not event and not (abs(delay - 25) <= 1.000001 and abs(delay - up) <= 1.000001 and up > 0) then 'HISTORY_DISCONTINUITY'
    when event and not (delay > 0 and delay <= 50 and up > 0 and up <= 50 and abs(delay - up) <= 1) then 'EVENT_HISTORY_TOO_OLD' end as reason from r)"""


@query("d10_history_reason", f"with {_REASON_SQL} select stream, vec_id, reason from reasons")
def d10(spark, sf):
    h = with_24(spark, sf)
    return h.select("stream", "vec_id", sq.history_reason(F.col("history"), F.struct(*ENTRY), 24).alias("reason"))


@query("d11_audit_sessions", f"""with {sql.FIRST_WINDOWS}, d as (select device as session, boot // 2 as boot, idx + 96 * (boot % 2) as idx, uptime_us + 86400000000 * (boot % 2) as uptime_us, captured_us, quality
    from fw), r as (
  select *, idx - lag(idx) over w as step, abs(uptime_us - lag(uptime_us) over w - (idx - lag(idx) over w) * 640000) as terr,
    abs((captured_us - first_value(captured_us) over w) - (uptime_us - first_value(uptime_us) over w)) as drift,
    lag(idx) over w is not null and (uptime_us <= lag(uptime_us) over w or captured_us < lag(captured_us) over w) as dis
  from d window w as (partition by session, boot order by idx)), p as (
  select session, boot, count(*) as n, count(*) filter (quality = 'valid') as v, sum(coalesce(step - 1, 0)) as m, max(coalesce(terr, 0)) as t, max(drift) as dr,
    count(*) filter (dis) as bad, min(captured_us) as c0, max(captured_us) as c1, max(uptime_us) - min(uptime_us) + 640000 as span from r group by session, boot), g as (
  select session, cast(sum(n) as bigint) as windows, cast(sum(v) as bigint) as valid, cast(sum(m) as bigint) as missing, max(t) as timing_us, max(dr) as drift_us,
    cast(sum(bad) as bigint) as disordered, count(*) as boots, min(c0) as f0, max(c1) as l1, max(span) as us from p group by session), s as (
  select n_nationkey as session, 1704067200000000 as s0, 1706659200000000 as e0, n_regionkey % 2 = 0 as reviewed,
    case when n_nationkey % 4 = 0 then null else 5000000 * n_nationkey end as mt from nation), j as (
  select s.session, coalesce(windows, 0) as windows, coalesce(valid, 0) as valid, coalesce(missing, 0) as missing, coalesce(timing_us, 0) as timing_us, coalesce(drift_us, 0) as drift_us,
    coalesce(disordered, 0) as disordered, coalesce(boots, 0) as boots, f0, l1, coalesce(us, 0) as us, s0, e0, reviewed, mt from s left join g using (session)), k as (
  select *, list_filter([case when not reviewed then 'HUMAN_NORMAL_REVIEW_REQUIRED' end, case when boots <> 1 then 'REQUIRE_ONE_BOOT_PER_SESSION' end,
    case when windows < 2 then 'INSUFFICIENT_TIMING_PAIRS' end, case when drift_us > 1000000 then 'TIMESTAMP_UPTIME_MISMATCH' end,
    case when valid * 0.64 < 300 then 'INSUFFICIENT_VALID_DURATION' end, case when windows - valid > 150 then 'INVALID_WINDOW_LIMIT' end,
    case when missing > 2000 then 'MISSING_WINDOW_LIMIT' end, case when mt is null then 'TIMING_TOLERANCE_NOT_AGREED' end,
    case when timing_us > mt then 'TIMING_TOLERANCE_EXCEEDED' end,
    case when windows < greatest(0, floor((e0 - s0) / 640000) - 1) or f0 is null or f0 - s0 > 1640000 or e0 - (l1 + 640000) > 1640000 or us + 1280000 < e0 - s0 - 1 then 'INCOMPLETE_REQUESTED_INTERVAL' end], lambda x: x is not null) as why from j)
  select session, windows, valid, missing, timing_us, drift_us, disordered, boots, array_to_string(why, ',') as blocking_reasons, len(why) = 0 as passes from k""")
def d11(spark, sf):
    w = first_windows(spark, sf)
    half = F.pmod("boot", F.lit(2))
    d = w.select(F.col("device").alias("session"), F.floor(F.col("boot") / 2).alias("boot"), (F.col("idx") + 96 * half).alias("idx"),
                 (F.col("uptime_us") + DAY_US * half).alias("uptime_us"), "captured_us", "quality")
    s = table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("long").alias("session"), F.lit(1704067200000000).alias("start_us"), F.lit(1706659200000000).alias("end_us"),
        F.lit(300.0).alias("min_valid_sec"), F.lit(150).alias("max_invalid"), F.lit(2000).alias("max_missing"),
        F.when(F.col("n_nationkey") % 4 != 0, F.lit(5_000_000) * F.col("n_nationkey")).alias("max_timing_us"),
        (F.col("n_regionkey") % 2 == 0).alias("reviewed"))
    return sq.audit_sessions(d, s, declared_split("idx")).withColumn("blocking_reasons", F.array_join("blocking_reasons", ","))


@query("d13_lanes", f"""with {sql.WINDOWS} select ordinal, case when event_type = 'click' and ({_NOW} - captured_us) / 1e6 / 86400 between -5 and 30 then 'live' else 'history' end as lane,
  case when event_type = 'click' then 0 else 1 end as work_rank from windows""")
def d13(spark, sf):
    w = windows(spark, sf).select("ordinal", F.when(F.col("event_type") == "click", "priority").otherwise("replay").alias("mode"),
                                  (F.col("captured_us") / 86_400).alias("c"))
    return sq.assign_lane(w, "c", "mode", F.lit(_NOW) / 86_400).select("ordinal", "lane", "work_rank")


@query("d14_slot_windows", f"""with {sql.WINDOWS}, s as (select *, cast(ceil((captured_us + 640000) / 3600000000.0) as bigint) * 3600 as slot from windows)
  select device, slot, max(captured_us) as captured_us, arg_max(ordinal, captured_us) as ordinal from s
  where quality = 'valid' and captured_us >= slot * 1000000 - 1800000000 group by device, slot""")
def d14(spark, sf):
    w = windows(spark, sf).select("device", "ordinal", "captured_us", "quality")
    return sq.select_slot_window(w, ["device"], "captured_us", F.col("quality") == "valid", 3600, 1800.0).drop("quality")


# ---------------------------------------------------------------- de-duplication

_COPIES_SQL = f"""{sql.POINTS}, u as (
  select asset, seq, score, event_type, seq * 3 as arrival from points union all
  select asset, seq, case when k % 2 = 0 then score else score + 1 end, event_type, seq * 3 + 1 + k % 2 from points where k % 4 < 3), dg as (
  select *, coalesce(cast(round(score * 1000) as bigint), -1) as d from u)"""


def _copies(spark, sf):
    p = points(spark, sf)
    a = p.select("asset", "seq", "score", "event_type", (F.col("seq") * 3).alias("arrival"))
    b = p.filter("k % 4 < 3").select("asset", "seq", F.when(F.col("k") % 2 == 0, F.col("score")).otherwise(F.col("score") + 1).alias("score"),
                                     "event_type", (F.col("seq") * 3 + 1 + F.col("k") % 2).alias("arrival"))
    return a.unionByName(b).withColumn("d", F.coalesce(F.round(F.col("score") * 1000).cast("long"), F.lit(-1)))


@query("c01_dedupe_conflicts", f"""with {_COPIES_SQL} select arrival, case when arrival = min(arrival) over w then 'accepted'
  when d = first_value(d) over (partition by asset, seq order by arrival) then 'duplicate' else 'conflict' end as disposition from dg window w as (partition by asset, seq)""")
def c01(spark, sf):
    return dd.dedupe_with_conflicts(_copies(spark, sf), ["asset", "seq"], "arrival", "d").select("arrival", "disposition")


@query("c02_snapshot_uniqueness", f"""with {sql.WINDOWS}, i as (select *, ordinal = min(ordinal) over (partition by device, boot, idx) as first,
    k = first_value(k) over (partition by device, boot, idx order by ordinal) as same, device * 1000 + boot % 7 as sensor, idx // 3 as slot from windows), a as (
  select ordinal, sensor, slot, k, boot, case when first then 'accepted' when same then 'duplicate' else 'conflict' end as d1 from i), s as (
  select *, min(case when d1 = 'accepted' then ordinal end) over (partition by sensor, boot, slot) as f1 from a), s2 as (
  select *, case when d1 = 'accepted' and ordinal > f1 then 'slot' when d1 = 'conflict' then 'identity' end as r1, d1 = 'accepted' and ordinal = f1 as live from s), h as (
  select *, min(case when live then ordinal end) over (partition by sensor, k) as f2 from s2)
  select ordinal, case when live and ordinal > f2 then 'conflict' when r1 = 'slot' then 'conflict' else d1 end as disposition,
         case when live and ordinal > f2 then 'history' else r1 end as rule from h""")
def c02(spark, sf):
    w = windows(spark, sf).select("ordinal", "device", "boot", "idx", "k", (F.col("device") * 1000 + F.col("boot") % 7).alias("sensor"),
                                  F.floor(F.col("idx") / 3).alias("slot"))
    rules = {"identity": ["device", "boot", "idx"], "slot": ["sensor", "boot", "slot"], "history": ["sensor", "k"]}
    return dd.dedupe_snapshots(w, "ordinal", rules, "k").select("ordinal", "disposition", "rule")


@query("c03_reject_overlaps", f"""with recursive {sql.POINTS}, s as (select asset, seq, t_us as s, t_us + cast(value * 600000000 as bigint) as e,
    row_number() over (partition by asset order by seq) as n from points), walk as (
  select asset, n, seq, true as accepted, [s] as ss, [e] as es from s where n = 1
  union all select w.asset, s.n, s.seq, x.ok, case when x.ok then list_append(w.ss, s.s) else w.ss end, case when x.ok then list_append(w.es, s.e) else w.es end
  from walk w join s on s.asset = w.asset and s.n = w.n + 1,
  lateral (select not list_bool_or(list_transform(w.ss, lambda v, i: s.s < w.es[i] and s.e > v)) as ok) x)
  select asset, seq, accepted from walk""")
def c03(spark, sf):
    p = points(spark, sf).select("asset", "seq", F.col("t_us").alias("s"), (F.col("t_us") + (F.col("value") * 600_000_000).cast("long")).alias("e"))
    return dd.reject_overlaps(p, ["asset"], "s", "e", "seq", DAY_US).select("asset", "seq", "accepted")


@query("c04_disposition", f"""with {_COPIES_SQL}, x as (select arrival, seq, case when arrival = min(arrival) over (partition by asset, seq) then 'accepted'
  when d = first_value(d) over (partition by asset, seq order by arrival) then 'duplicate' else 'conflict' end as d0 from dg)
  select arrival, case when d0 = 'accepted' and p.t_us <= {_NOW} - 20 * 86400000000 then 'expired' else d0 end as disposition from x join points p using (seq)""")
def c04(spark, sf):
    d = dd.dedupe_with_conflicts(_copies(spark, sf), ["asset", "seq"], "arrival", "d")
    d = d.join(points(spark, sf).select("seq", "t_us"), "seq")
    return dd.disposition(d, "t_us", F.lit(_NOW), 20 * DAY_US).select("arrival", "disposition")


@query("c05_duplicate_recordings", """select sha256(text) as digest, count(distinct doc_id) as runs, count(distinct lang) as labels, min(doc_id) as first_run,
  count(distinct lang) > 1 as conflicting from documents group by text having count(distinct doc_id) > 1""")
def c05(spark, sf):
    return dd.duplicate_recordings(table(spark, sf, "documents"), "text", "doc_id", "lang")


@query("c06_bulk_ingest", f"""with {_COPIES_SQL}, v as (select *, arrival % 50 as batch, score is not null as ok, arrival as i from dg), f as (
  select *, first_value(d) over (partition by asset, seq order by arrival) as d0, min(arrival) over (partition by asset, seq) as a0 from v where ok), st as (
  select batch, case when arrival = a0 then 'a' when d = d0 then 'd' else 'r' end as s from f union all select batch, 'r' from v where not ok)
  select batch, count(*) filter (s = 'a') as accepted, count(*) filter (s = 'd') as duplicates, count(*) filter (s = 'r') as rejected from st group by batch""")
def c06(spark, sf):
    c = _copies(spark, sf).withColumn("batch", F.col("arrival") % 50)
    return dd.bulk_ingest(c, "batch", ["asset", "seq"], ["arrival"], "d", F.col("score").isNotNull())[1]


@query("c07_cap_per_key", f"""with {sql.POINTS} select asset, seq from points qualify row_number() over (partition by asset order by t_us desc, seq desc) <= 20""")
def c07(spark, sf):
    return dd.cap_per_key(points(spark, sf), ["asset"], ["t_us", "seq"], 20).select("asset", "seq")


_ROW_DIGEST = "sha256('c_custkey=' || c_custkey || chr(31) || 'c_mktsegment=' || c_mktsegment || chr(31) || 'c_nationkey=' || c_nationkey)"


@query("c08_row_digest", f"select c_custkey, {_ROW_DIGEST} as digest from customer")
def c08(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", dd.row_digest(["c_nationkey", "c_custkey", "c_mktsegment"]).alias("digest"))


@query("c08_set_digest", f"""with d as (select c_nationkey, {_ROW_DIGEST} as h from customer), w as (
  select c_nationkey, cast('0x' || substr(h, 1, 12) as bigint) as a, cast('0x' || substr(h, 13, 12) as bigint) as b from d)
  select c_nationkey, count(*) as rows, cast(sum(cast(a as hugeint)) % 2305843009213693951 as bigint) as digest_a,
         cast(sum(cast(b as hugeint)) % 2305843009213693951 as bigint) as digest_b from w group by c_nationkey""")
def c08_set(spark, sf):
    return dd.set_digest(table(spark, sf, "customer"), ["c_nationkey", "c_custkey", "c_mktsegment"], ["c_nationkey"])


@query("c10_upsert_latest", f"""with {sql.POINTS}, b as (select asset, seq as revision, score, 0 as from_update from points union all select asset, seq + 500, -1.0, 1 from points where k % 10 = 0)
  select asset, revision, score from b qualify row_number() over (partition by asset order by revision desc nulls last, from_update desc, score desc nulls last) = 1""")
def c10(spark, sf):
    """Of equal revisions the update counts, then the higher score."""
    p = points(spark, sf)
    return dd.upsert_latest(p.select("asset", F.col("seq").alias("revision"), "score"),
                            p.filter("k % 10 = 0").select("asset", (F.col("seq") + 500).alias("revision"), F.lit(-1.0).alias("score")),
                            ["asset"], "revision")


@query("c11_unseen", f"""with {sql.POINTS} select asset, count(*) as rows from points p where not exists (select 1 from supplier s where s.s_suppkey = p.asset) group by asset""")
def c11(spark, sf):
    seen = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("asset"))
    return dd.unseen(points(spark, sf), seen, ["asset"]).groupBy("asset").agg(F.count(F.lit(1)).alias("rows"))


@query("c11_known", f"""with {sql.POINTS} select asset, count(*) as rows from points p where exists (select 1 from supplier s where s.s_suppkey = p.asset) group by asset""")
def c11_known(spark, sf):
    seen = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("asset"))
    return dd.known(points(spark, sf), seen, ["asset"]).groupBy("asset").agg(F.count(F.lit(1)).alias("rows"))
