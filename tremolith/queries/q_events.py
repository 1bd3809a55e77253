"""Event, hysteresis, persistence and incident queries."""

from pyspark.sql import Window, functions as F

from ..functions.numeric import r6
from ..operators import events as ev
from ..operators.dedupe import first_per_key
from ..plans.registry import query
from ..plans.scan import declared_split, numbered
from ..sources.tables import points, table, windows
from . import sql


def first_windows(spark, sf):
    return first_per_key(windows(spark, sf), ["device", "boot", "idx"], "ordinal")


@query("g03_event_lifecycle", f"with {sql.LIFECYCLE} select * from lifecycle")
def g03(spark, sf):
    return ev.event_lifecycle(points(spark, sf), ["asset"], ["t_us", "seq"], "t_us")


@query("g03_event_summary", f"""with {sql.LIFECYCLE}, live as (
  select asset, arg_max(score, seq) filter (score is not null) as live_score, max(t_us) as last_us from points group by asset)
  select l.asset, live_score, last_us, coalesce(n, 0) as events, coalesce(n_open, 0) as open_events,
         coalesce(n_fault, 0) as fault_closed, worst,
         case when coalesce(n_open, 0) > 0 or live_score >= 75 then 'critical' when live_score >= 50 then 'warning'
              when live_score is null then 'unavailable' else 'normal' end as status
  from live l left join (select asset, count(*) as n, count(*) filter (end_us is null) as n_open,
       count(*) filter (end_reason = 'sensor_fault') as n_fault, max(max_score) as worst from lifecycle group by asset) e using (asset)""")
def g03_summary(spark, sf):
    p = points(spark, sf)
    e = ev.event_lifecycle(p, ["asset"], ["t_us", "seq"], "t_us").groupBy("asset").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("end_us").isNull()).alias("n_open"),
        F.count_if(F.col("end_reason") == "sensor_fault").alias("n_fault"), F.max("max_score").alias("worst"))
    live = p.groupBy("asset").agg(
        F.max_by("score", F.when(F.col("score").isNotNull(), F.col("seq"))).alias("live_score"), F.max("t_us").alias("last_us"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return live.join(e, "asset", "left").select(
        "asset", "live_score", "last_us", zero("n").alias("events"), zero("n_open").alias("open_events"),
        zero("n_fault").alias("fault_closed"), "worst",
        F.when((zero("n_open") > 0) | (F.col("live_score") >= 75), "critical").when(F.col("live_score") >= 50, "warning")
        .when(F.col("live_score").isNull(), "unavailable").otherwise("normal").alias("status"))


@query("g07_event_records", f"""with {sql.LIFECYCLE} select
  'EVENT-' || substr(sha256(asset || '|' || start_us || '|' || 'rule-1'), 1, 32) as id, asset, start_us, end_us,
  case when end_us is null then 'open' else 'closed' end as status, end_reason,
  case when round_even(max_score, 0) >= 75 then 'critical' else 'warning' end as severity,
  (end_us - start_us) // 1000000 as duration_sec, cast(round_even(max_score, 0) as bigint) as max_score, samples, merge_count,
  'rule-1' as threshold_version, 'model-1' as model_version from lifecycle""")
def g07(spark, sf):
    e = ev.event_lifecycle(points(spark, sf), ["asset"], ["t_us", "seq"], "t_us")
    return ev.event_records(e, ["asset"], "rule-1", "model-1")


@query("g01_hysteresis_states", f"""with {sql.POINTS}, d as (
  select asset, row_number() over (partition by asset order by seq) as idx, score / 20.0 as sigma,
         score is not null as ok from points), c as (
  select *, case when not ok then 'N' when sigma >= 3 then 'O' when sigma < 2 then 'U' else 'M' end as cls from d), s as (
  select *, case when lag(cls) over w is distinct from cls then idx end as st from c window w as (partition by asset order by idx)),
  r as (select *, max(st) over (partition by asset order by idx) as run from s), n as (
  select *, row_number() over (partition by asset, run order by idx) as rn from r), t as (
  select *, case when cls = 'O' and rn >= 2 then 'open' when cls = 'U' and rn >= 2 then 'shut' end as trig from n), h as (
  select *, last_value(trig ignore nulls) over (partition by asset order by idx) as held from t)
  select asset, idx, case when cls = 'N' then 'INVALID' when held = 'open' then 'ANOMALY' else 'NORMAL' end as state,
         round(sigma, 6) + 0.0 as sigma from h""")
def g01_states(spark, sf):
    return _hysteresis(spark, sf)[0].withColumn("sigma", r6("sigma"))


def _hysteresis(spark, sf):
    p = points(spark, sf)
    p = numbered(p, ["asset"], ["seq"], declared_split("t_us"), "idx")
    d = p.select("asset", "idx", (F.col("score") / 20.0).alias("sigma"), F.col("score").isNotNull().alias("ok"))
    return ev.hysteresis(d, ["asset"], "idx", "sigma", F.col("ok"), 3.0, 2.0, 2, 2, declared_split("idx"))


@query("g01_hysteresis_events", f"""with {sql.POINTS}, d as (
  select asset, row_number() over (partition by asset order by seq) as idx, score / 20.0 as sigma,
         score is not null as ok from points), c as (
  select *, case when not ok then 'N' when sigma >= 3 then 'O' when sigma < 2 then 'U' else 'M' end as cls from d), s as (
  select *, case when lag(cls) over w is distinct from cls then idx end as st from c window w as (partition by asset order by idx)),
  r as (select *, max(st) over (partition by asset order by idx) as run from s), n as (
  select *, row_number() over (partition by asset, run order by idx) as rn, max(sigma) over (partition by asset, run order by idx) as pk from r), t as (
  select *, case when cls = 'O' and rn >= 2 then 'open' when cls = 'U' and rn >= 2 then 'shut' end as trig from n), h as (
  select *, coalesce(last_value(trig ignore nulls) over (partition by asset order by idx rows between unbounded preceding and 1 preceding) = 'open', false) as was from t), o as (
  select *, coalesce(trig = 'open', false) and not was as opened, coalesce(trig <> 'open', false) and was as closed from h), g as (
  select *, max(case when opened then idx end) over (partition by asset order by idx) as seg from o)
  select asset, max(case when opened then run end) as start_index, max(case when closed then run end) as end_index,
         round(max(case when opened then pk else sigma end), 6) + 0.0 as max_sigma
  from g where opened or was group by asset, seg""")
def g01_events(spark, sf):
    return _hysteresis(spark, sf)[1].withColumn("max_sigma", r6("max_sigma"))


@query("g05_order_points", f"""with {sql.POINTS}, a as (
  select asset, seq, case when k % 7 = 0 then t_us - 7200000000 else t_us end as at_us, event_type from points), b as (
  select *, max((at_us, event_type, seq)) over (partition by asset order by seq rows between unbounded preceding and 1 preceding) as top from a)
  select asset, count(*) as stored, count(*) filter (top is not null and (at_us, event_type, seq) <= top) as out_of_order,
         max(at_us) filter (top is null or (at_us, event_type, seq) > top) as newest_used from b group by asset""")
def g05(spark, sf):
    p = points(spark, sf).withColumn("at_us", F.when(F.col("k") % 7 == 0, F.col("t_us") - 7_200_000_000).otherwise(F.col("t_us")))
    good, late = ev.order_points(p.withColumn("received", F.col("seq")), ["asset"], "at_us", "event_type", "seq", "received",
                                 "seq", declared_split("seq"))
    both = good.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True)))
    return both.groupBy("asset").agg(F.count(F.lit(1)).alias("stored"), F.count_if("late").alias("out_of_order"),
                                     F.max(F.when(~F.col("late"), F.col("at_us"))).alias("newest_used"))


@query("g06_lifecycle_params", """select s_suppkey as rule_id, cast(50 + s_suppkey % 45 as double) as score_enter,
  cast(greatest(0.0, 50 + s_suppkey % 45 - s_nationkey) as double) as score_exit, cast(s_suppkey % 60 as double) as sec_enter,
  cast(s_nationkey as double) as sec_exit from supplier""")
def g06(spark, sf):
    s = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("rule_id"), (50 + F.col("s_suppkey") % 45).alias("threshold"),
        F.col("s_nationkey").alias("hysteresis"), (F.col("s_suppkey") % 60).alias("duration_sec"),
        F.col("s_nationkey").alias("recovery_sec"))
    return ev.lifecycle_params(s).select("rule_id", "score_enter", "score_exit", "sec_enter", "sec_exit")


@query("g02_resolve_baseline", """select c.c_custkey as asset,
  case when s.s_suppkey is not null then s.s_acctbal when n.n_nationkey is not null then 100.0 + n.n_regionkey else -1.0 end as level,
  case when s.s_suppkey is not null then 'asset' when n.n_nationkey is not null then 'type' else 'default' end as resolved_by
  from customer c left join supplier s on s.s_suppkey = c.c_custkey and s.s_acctbal > 0
  left join nation n on n.n_nationkey = c.c_nationkey and n.n_regionkey < 3""")
def g02(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("asset"), F.col("c_nationkey").alias("kind"))
    a = table(spark, sf, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("asset"), F.col("s_acctbal").alias("level"))
    t = table(spark, sf, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("kind"), (100.0 + F.col("n_regionkey")).alias("level"))
    default = spark.createDataFrame([(-1.0,)], "level double")
    return ev.resolve_baseline(c, a, t, default, "asset", "kind", ["level"]).drop("kind")


_P_SQL = lambda w, n: f"""case when quality = 'valid' and count(*) over (partition by device, boot, isl order by idx rows between {w - 1} preceding and current row) = {w}
  then cast(sum(hit) over (partition by device, boot, isl order by idx rows between {w - 1} preceding and current row) >= {n} as int) else -1 end"""


@query("g08_persistence", f"""with {sql.FIRST_WINDOWS}, v as (
  select device, boot, idx, quality, cast(value > 60 as int) as hit from fw), ok as (
  select *, idx - row_number() over (partition by device, boot order by idx) as isl from v where quality = 'valid'), p as (
  select device, boot, idx, {', '.join(_P_SQL(w, n) + ' as ' + name for name, (w, n) in ev.POLICIES.items())} from ok)
  select device, boot, idx, {', '.join(f'coalesce(p.{n}, -1) as {n}' for n in ev.POLICIES)} from v left join p using (device, boot, idx)""")
def g08(spark, sf):
    w = first_windows(spark, sf).select("device", "boot", "idx", (F.col("quality") == "valid").alias("ok"), (F.col("value") > 60).alias("hit"))
    return ev.persistence(w, ["device", "boot"], "idx", "hit", "ok").drop("ok", "hit")


_LINKED = f"""{sql.FIRST_WINDOWS}, q as (
  select device, boot, idx, captured_us, quality, value, site, value > 40 as verdict, quality = 'valid' as ok,
         idx * 650000 + (k % 40) * 1000 - 10000 as up, k % 11 as model from fw)"""


def _linked(spark, sf):
    return first_windows(spark, sf).select(
        "device", "boot", "idx", "captured_us", "quality", "value", "site", (F.col("value") > 40).alias("verdict"),
        (F.col("quality") == "valid").alias("ok"), (F.col("idx") * 650_000 + (F.col("k") % 40) * 1000 - 10_000).alias("up"),
        (F.col("k") % 11).alias("model"))


@query("g09_confirm3", f"""with {_LINKED}, b as (
  select *, case when lag(idx) over w is null then 'STREAM_START' when lag(site) over w <> site then 'STREAM_CHANGED'
     when lag(model) over w <> model then 'MODEL_CHANGED' when idx <> lag(idx) over w + 1 then 'WINDOW_GAP'
     when up - lag(up) over w not between 630000 and 670000 then 'TIME_GAP'
     when not lag(ok) over w then 'PREVIOUS_UNAVAILABLE' end as why
  from (select *, 0 as z from q) window w as (partition by device, boot order by idx)), c as (
  select *, case when ok then why else 'UNAVAILABLE' end as reset_reason,
         sum(case when not ok or why is not null then 1 else 0 end) over (partition by device, boot order by idx) as run from b), d as (
  select *, least(3, row_number() over r) as n, sum(cast(verdict as int)) over (partition by device, boot, run order by idx rows 2 preceding) as h
  from c window r as (partition by device, boot, run order by idx))
  select device, boot, idx, reset_reason, cast(case when ok then n else 0 end as int) as valid_windows,
         cast(case when ok then h else 0 end as int) as hits,
         case when not ok or n < 3 then -1 when h = 3 then 1 else 0 end as decision from d""")
def g09(spark, sf):
    return ev.confirm3(_linked(spark, sf), ["device", "boot"], ["idx"], declared_split("idx"), "idx", "up", "verdict",
                       F.col("ok"), ["site"], ["model"]).select(
        "device", "boot", "idx", "reset_reason", "valid_windows", "hits", "decision")


def _incident_sql(source, part, order, t, ok, hit, link, n, peak="hit"):
    return f"""{source}, c as (select *, case when not ({ok}) then 'N' when {hit} then 'O' else 'U' end as cls from q), s as (
  select *, row_number() over w as pos, case when lag(cls) over w is null or lag(cls) over w <> cls or not coalesce({link}, false)
    then row_number() over w end as st from c window w as (partition by {part} order by {order})), r as (
  select *, max(st) over (partition by {part} order by pos) as run from s), n as (
  select *, row_number() over (partition by {part}, run order by pos) as rn from r), t as (
  select *, case when cls = 'O' and rn >= {n} then 'open' when cls = 'U' and rn >= {n} then 'shut' end as trig from n), h as (
  select *, coalesce(last_value(trig ignore nulls) over (partition by {part} order by pos rows between unbounded preceding and 1 preceding) = 'open', false) as was from t), o as (
  select *, coalesce(trig = 'open', false) and not was as opened, coalesce(trig <> 'open', false) and was as closed from h), g as (
  select *, max(case when opened then pos end) over (partition by {part} order by pos) as seg from o), inc as (
  select {part}, max(case when opened then {t} end) as opened_us, max(case when closed then {t} end) as end_us
  from g where opened or was group by {part}, seg)"""


@query("g10_incidents_3x3", f"""with {_incident_sql(_LINKED.replace('value > 40', 'value > 15'), 'device, site', 'captured_us, idx', 'captured_us', 'ok',
       'verdict', 'idx >= lag(idx) over w', 3)}
  select device, site, opened_us, end_us, case when end_us is null then 'open' else 'closed' end as status,
         case when end_us is not null then 'three_normal_windows' end as end_reason from inc""")
def g10(spark, sf):
    q = _linked(spark, sf).withColumn("verdict", F.col("value") > 15)
    return ev.incidents_3x3(q, ["device", "site"], ["captured_us", "idx"], "captured_us", declared_split("captured_us"), "verdict",
                            F.col("ok"), F.col("idx") >= F.col("before.idx"))


@query("g10_incidents_exact", f"with recursive {sql.incidents('(n // 5 % 3)::varchar', 'value > 30', 'n * 650000 + case when k % 29 = 0 then 100000 else 0 end')} select * from incident_log")
def g10_exact(spark, sf):
    """Every device's whole window stream; the target changes every five windows, also while an incident is open."""
    w = numbered(first_windows(spark, sf), ["device"], ["captured_us", "ordinal"], declared_split("captured_us"), "place")
    late = F.when(F.col("k") % 29 == 0, 100_000).otherwise(0)
    w = w.select("device", F.col("captured_us").alias("t_us"), "place", (F.col("place") * 650_000 + late).alias("uptime"), F.floor(F.col("place") / 5 % 3).cast("long").cast("string").alias("target"), "quality", "value")
    return ev.incidents_exact(w, ["device"], ["place"], "t_us", "place", "uptime", "target", F.col("quality") == "valid", F.col("value") > 30)


@query("g11_snapshot_incidents", f"""with {_incident_sql(_LINKED, 'device, model', 'captured_us, idx', 'captured_us', 'ok', 'verdict', 'true', 1)}
  select device, model, opened_us as occurred_us, end_us, case when end_us is null then 'open' else 'closed' end as status,
         case when end_us is not null then 'single_normal_snapshot' end as end_reason from inc""")
def g11(spark, sf):
    q = _linked(spark, sf)
    return ev.snapshot_incidents(q, ["device", "model"], ["captured_us", "idx"], "captured_us", declared_split("captured_us"),
                                 F.col("ok"), "verdict")


_NOW = 1_706_700_000_000_000


@query("g11_snapshot_reasons", f"""with {sql.WINDOWS}, m as (
  select *, ordinal = max(ordinal) over (partition by device, boot) as is_latest, k % 5 = 0 as late,
         case when k % 9 = 0 then 'failed' else 'completed' end as st, value / 100.0 as score, value > 100 as verdict from windows)
  select ordinal, case when site = 2 and k % 2 = 0 then 'DEVICE_MAPPING_CHANGED' when late or not is_latest then 'SUPERSEDED_OR_LATE_INPUT'
    when ({_NOW} - captured_us) / 1e6 not between -5 and 864000 then 'INPUT_STALE_OR_FUTURE' when quality <> 'valid' then 'INPUT_QUALITY'
    when st <> 'completed' then 'MODEL_RESULT_UNAVAILABLE' when verdict <> (score > 1.0) then 'MODEL_RESULT_INVALID' end as reason from m""")
def g11_reasons(spark, sf):
    w = windows(spark, sf)
    newest = w.groupBy("device", "boot").agg(F.max("ordinal").alias("top"))
    m = w.join(newest, ["device", "boot"]).select(
        "ordinal", "captured_us", "quality", (F.col("ordinal") == F.col("top")).alias("is_latest"), (F.col("k") % 5 == 0).alias("late"),
        F.when(F.col("k") % 9 == 0, "failed").otherwise("completed").alias("status"), (F.col("value") / 100.0).alias("score"),
        (F.col("value") > 100).alias("verdict"), (~((F.col("site") == 2) & (F.col("k") % 2 == 0))).alias("mapped"))
    return m.select("ordinal", ev.snapshot_reason(F.lit(_NOW), "captured_us", "late", "is_latest", "quality", "status", "score", 1.0,
                                                  "verdict", F.col("mapped"), 864_000).alias("reason"))


@query("g12_age_observations", f"""with {_incident_sql(_LINKED, 'device, model', 'captured_us, idx', 'captured_us', 'ok', 'verdict', 'true', 1)},
  latest as (select device, model, max(captured_us) as seen from q where ok group by device, model)
  select i.device, i.model, i.opened_us as occurred_us,
    case when end_us is not null then 'recovered' when seen is null or ({_NOW} - seen) / 1e6 > 86400 then 'unknown' else 'observing' end as observation,
    case when end_us is not null then null when seen is null then 'NO_INPUT' when ({_NOW} - seen) / 1e6 > 86400 then 'NO_RECENT_INPUT' end as observation_reason
  from inc i left join latest l using (device, model)""")
def g12(spark, sf):
    q = _linked(spark, sf)
    inc = ev.snapshot_incidents(q, ["device", "model"], ["captured_us", "idx"], "captured_us", declared_split("captured_us"), F.col("ok"), "verdict")
    latest = q.filter("ok").groupBy("device", "model").agg(F.max("captured_us").alias("captured_us"))
    return ev.age_observations(inc, latest, ["device", "model"], F.lit(_NOW), 86_400).select(
        "device", "model", "occurred_us", "observation", "observation_reason")


_OFF = f"""{sql.POINTS}, n as (select asset, t_us, lead(t_us) over (partition by asset order by t_us, seq) as nxt from points), off as (
  select asset, t_us + 36000000000 as offline_us, nxt as recovered_us from n where coalesce(nxt, {_NOW}) - t_us > 36000000000)"""


def _offline(spark, sf):
    return ev.offline_intervals(points(spark, sf), ["asset"], ["t_us", "seq"], "t_us", 36_000, F.lit(_NOW))


@query("d12_offline_intervals", f"with {_OFF} select * from off")
def d12(spark, sf):
    return _offline(spark, sf)


@query("g13_device_liveness", f"""with {_OFF} select asset, 'device_offline' as event_type, offline_us as at_us from off
  union all select asset, 'device_recovered', recovered_us from off where recovered_us is not null""")
def g13(spark, sf):
    return ev.device_liveness(_offline(spark, sf), ["asset"])


@query("g14_sensor_faults", f"""with {sql.POINTS}, l as (select asset, count(*) as n, count(distinct (k // 60, event_type = 'x')) as kinds, avg(score / 1000) as lvl
    from (select * from points qualify row_number() over (partition by asset order by seq desc) <= 5) group by asset),
  d as (select asset, max(t_us) as last_us, count(*) filter (event_type = 'error' and k < 20) as reboots, arg_max(k, seq) as battery, asset % 17 = 0 as off from points group by asset),
  j as (select * from d left join l using (asset))
  select asset, 'no_signal' as code, 'critical' as severity from j where off or {_NOW} - last_us > 120000000 + 6 * 86400000000
  union all select asset, 'reboot_loop', 'warning' from j where reboots >= 3
  union all select asset, 'power', 'warning' from j where battery <= 20
  union all select asset, 'stuck_value', 'warning' from j where n >= 5 and kinds = 1
  union all select asset, 'noise_floor', 'warning' from j where n >= 5 and lvl > 0.05""")
def g14(spark, sf):
    p = points(spark, sf)
    d = p.groupBy("asset").agg(
        F.max("t_us").alias("last_us"), F.count_if((F.col("event_type") == "error") & (F.col("k") < 20)).alias("reboots"),
        F.max_by("k", "seq").alias("battery_pct")).withColumn("health", F.when(F.col("asset") % 17 == 0, "offline").otherwise("online"))
    t = p.select("asset", "seq", F.floor(F.col("k") / 60).alias("band"), (F.col("event_type") == "x").alias("flag"), (F.col("score") / 1000).alias("level"))
    return ev.sensor_faults(d, t, "asset", ["seq"], F.lit(_NOW), ["band", "flag"], "level", offline_sec=120 + 6 * 86_400)


@query("g15_fault_episodes", f"""with {sql.POINTS}, s as (
  select asset, k % 3 as code, seq, t_us, case when event_type = 'error' then 'active' else 'recovered' end as status from points), e as (
  select *, lag(status) over (partition by asset, code order by t_us, seq) as was from s), f as (
  select * from e where was is null or was <> status), g as (
  select *, lead(t_us) over (partition by asset, code order by t_us, seq) as ended from f)
  select asset, code, t_us as start_us, ended as end_us, case when ended is null then 'open' else 'closed' end as status,
         (ended - t_us) // 1000000 as duration_sec_raw, greatest(0, coalesce((ended - t_us) // 1000000, 0)) as duration_sec from g where status = 'active'""")
def g15(spark, sf):
    p = points(spark, sf).select("asset", (F.col("k") % 3).alias("code"), "seq", "t_us",
                                 F.when(F.col("fault"), "active").otherwise("recovered").alias("status"))
    e = ev.fault_episodes(p, ["asset", "code"], ["t_us", "seq"], "t_us", "status")
    return e.withColumn("duration_sec_raw", F.floor((F.col("end_us") - F.col("start_us")) / 1_000_000).cast("long"))


EDGE = {"low": 20.0, "high": 70.0, "severe_low": 0.5, "severe_high": 200.0, "severe_peak": 250.0, "recovery_ms": 1_300}


@query("g16_edge_trigger", f"""with {_LINKED}, l as (
  select *, lag(idx) over w is null as first, coalesce(idx = lag(idx) over w + 1 and up - lag(up) over w between 630000 and 670000, false) as joined
  from q window w as (partition by device, boot order by idx)), b as (
  select *, (not first and not joined) or not ok as bad, cast(value < 20 as int) as lo, cast(value > 70 as int) as hi from l), i as (
  select *, sum(cast(bad as int)) over (partition by device, boot order by idx) as blk, row_number() over (partition by device, boot order by idx) as pos from b), v as (
  select *, sum(case when bad then 0 else lo end) over x as ls, sum(case when bad then 0 else hi end) over x as hs
  from i window x as (partition by device, boot, blk order by idx rows 2 preceding)), y as (
  select *, case when bad then 'quality' when value < 0.5 or value > 200 or value * 1.1 > 250 then 'severe' when ls >= 2 then 'rms_low' when hs >= 2 then 'rms_high' end as why from v), c as (
  select *, case when why is not null then 'O' when lo = 0 and hi = 0 then 'U' else 'M' end as cls from y), s as (
  select *, case when lag(cls) over w is distinct from cls then pos end as st from c window w as (partition by device, boot order by pos)), r as (
  select *, max(st) over (partition by device, boot order by pos) as run from s), n as (
  select *, first_value(up) over (partition by device, boot, run order by pos) as at0 from r), t as (
  select *, case when cls = 'O' then 'open' when cls = 'U' and up - at0 >= 1300000 then 'shut' end as trig from n), h as (
  select *, coalesce(last_value(trig ignore nulls) over (partition by device, boot order by pos), 'shut') = 'open' as active from t)
  select device, boot, idx, active, case when why is not null then why when active then 'recovery_hold' else 'none' end as reason from h""")
def g16(spark, sf):
    q = _linked(spark, sf).withColumn("peak", F.col("value") * 1.1)
    link = (F.col("idx") == F.col("b.idx") + 1) & (F.col("up") - F.col("b.up")).between(630_000, 670_000)
    return ev.edge_trigger(q, ["device", "boot"], ["idx"], declared_split("idx"), "up", "value", "peak", F.col("ok"), link, EDGE).select(
        "device", "boot", "idx", "active", "reason")


@query("g17_project_incidents", f"""with {sql.POINTS}, i as (
  select asset as id, max(seq) % 5 as revision, 'i' || count(*) as title, 'needs_review' as label from points where fault group by asset), e as (
  select asset as id, max(k) % 5 as revision, 'e' || count(*) as title, 'reviewed' as label from points where asset % 3 > 0 group by asset)
  select coalesce(i.id, e.id) as id, case when i.id is not null and (e.id is null or i.revision > e.revision) then i.revision else e.revision end as revision,
         case when i.id is not null and (e.id is null or i.revision > e.revision) then i.title else e.title end as title,
         case when e.id is not null then e.label else i.label end as label from i full join e on i.id = e.id""")
def g17(spark, sf):
    p = points(spark, sf)
    i = p.filter("fault").groupBy(F.col("asset").alias("id")).agg(
        (F.max("seq") % 5).alias("revision"), F.concat(F.lit("i"), F.count(F.lit(1))).alias("title"), F.lit("needs_review").alias("label"))
    e = p.filter("asset % 3 > 0").groupBy(F.col("asset").alias("id")).agg(
        (F.max("k") % 5).alias("revision"), F.concat(F.lit("e"), F.count(F.lit(1))).alias("title"), F.lit("reviewed").alias("label"))
    return ev.project_incidents(i, e, "id", ["label"])


@query("g18_apply_resolutions", f"""with {sql.LIFECYCLE}, r as (select user_id as asset, min(epoch_us(ts)) as at_us from events where event_type = 'purchase' and value > 150 group by 1)
  select l.asset, event_no, case when end_us is null and at_us is not null then 'closed' when end_us is null then 'open' else 'closed' end as status,
    coalesce(end_us, at_us) as end_us, case when end_us is null and at_us is not null then 'operator_resolved' else end_reason end as end_reason
  from lifecycle l left join r using (asset)""")
def g18(spark, sf):
    p = points(spark, sf)
    e = ev.event_lifecycle(p, ["asset"], ["t_us", "seq"], "t_us").select(
        "asset", "event_no", F.when(F.col("end_us").isNull(), "open").otherwise("closed").alias("status"), "end_us", "end_reason")
    r = p.filter("event_type = 'purchase' and value > 150").select("asset", F.col("t_us").alias("at_us"))
    return ev.apply_resolutions(e, r, "asset")


@query("g04_fault_boundary", f"""with {sql.POINTS}, b as (
  select asset, seq as arrival, fault and k < 50 as boundary, case when fault and k < 50 then t_us - 3600000000 else t_us end as t_us from points), m as (
  select *, case when boundary then max(t_us) over (partition by asset order by arrival) else t_us end as mu from b), l as (
  select *, max(case when boundary then mu end) over (partition by asset order by arrival rows between unbounded preceding and 1 preceding) as lim from m)
  select asset, arrival, boundary, mu as t_us from l where boundary or lim is null or mu > lim""")
def g04(spark, sf):
    p = points(spark, sf).withColumn("arrival", F.col("seq")).withColumn("late", F.col("fault") & (F.col("k") < 50))
    faults = p.filter("late").withColumn("t_us", F.col("t_us") - 3_600_000_000)
    return ev.apply_fault_boundary(p.filter("not late"), faults, ["asset"], "t_us", "seq").select("asset", "arrival", "boundary", "t_us")
