"""SQL text shared by the oracles: the same adapters, stated for a plain SQL engine."""

POINTS = """points as (
  select user_id as asset, event_id as seq, epoch_us(ts) as t_us,
         case when event_type <> 'signup' then least(value, 100.0) end as score,
         event_type = 'error' as fault, cast(json_extract_string(props, '$.k') as bigint) as k, event_type, value
  from events)"""

WINDOWS = """windows as (
  select user_id % 10 as device, epoch_us(ts) // 86400000000 as boot,
         (epoch_us(ts) % 86400000000) // 900000000 as idx, event_id as ordinal,
         epoch_us(ts) % 86400000000 as uptime_us,
         epoch_us(ts) + case when event_type = 'error' then 1500000 else 0 end as captured_us,
         case when event_type = 'signup' then 'sample_gap' else 'valid' end as quality,
         user_id % 3 as site, value, event_type, cast(json_extract_string(props, '$.k') as bigint) as k
  from events)"""

# one row per (device, boot, idx): the first one stored
FIRST_WINDOWS = WINDOWS + """, fw as (
  select * from windows qualify row_number() over (partition by device, boot, idx order by ordinal) = 1)"""

VECTORS = """vectors as (
  select vec_id, cast(label as bigint) as stream, cast(embedding as double[]) as v from embeddings)"""

SNAPSHOTS = VECTORS + """, snapshots as (
  select vec_id, stream, [""" + ", ".join(
    f"list_sum(v[{7 * j + 1}:{7 * j + (7 if j < 8 else 8)}])" for j in range(9)) + """] as x from vectors)"""

LIFECYCLE = POINTS + """, c0 as (
  select asset, seq, t_us, fault, case when not fault then score end as score from points), c1 as (
  select *, case when fault then 'F' when score is null or score not between 0 and 100 then 'N'
                 when score >= 75 then 'O' when score < 50 then 'U' else 'M' end as cls from c0), c2 as (
  select *, row_number() over w as pos, sum(case when cls = 'F' then 1 else 0 end) over w as faults,
         case when lag(cls) over w is distinct from cls then row_number() over w end as st
  from c1 window w as (partition by asset order by t_us, seq)), c3 as (
  select *, max(st) over (partition by asset order by pos) as run from c2), c4 as (
  select *, row_number() over r as run_n, first_value(t_us) over r as run_at, max(score) over r as run_peak
  from c3 window r as (partition by asset, run order by pos)), c5 as (
  select *, case when cls = 'O' and run_n >= 2 then 'open' when cls = 'U' and run_n >= 2 then 'recovered'
                 when cls = 'F' then 'sensor_fault' end as trig from c4), c6 as (
  select *, coalesce(last_value(trig ignore nulls) over (partition by asset order by pos
      rows between unbounded preceding and 1 preceding) = 'open', false) as was_open from c5), c7 as (
  select *, coalesce(trig = 'open', false) and not was_open as opened,
         coalesce(trig <> 'open', false) and was_open as closed from c6), c8 as (
  select *, max(case when opened then pos end) over (partition by asset order by pos) as seg from c7), segs as (
  select asset, seg, max(case when opened then run_at end) as start_us, max(case when closed then t_us end) as end_us,
         max(case when closed then trig end) as end_reason,
         max(case when opened then run_n end) as lead_n, count(case when not opened then score end) as later_n,
         max(case when opened then run_peak else score end) as peak, arg_max(score, pos) as last_value,
         max(case when opened then faults end) as fo, max(case when closed then faults end) as fe
  from c8 where opened or was_open group by asset, seg), m1 as (
  select *, coalesce(lag(end_reason) over w = 'recovered' and start_us - lag(end_us) over w between 0 and 30000000
              and fo = lag(fe) over w, false) as merged
  from segs window w as (partition by asset order by seg)), m2 as (
  select *, sum(case when merged then 0 else 1 end) over (partition by asset order by seg) as event_no,
         lead(seg) over (partition by asset order by seg) as nxt from m1), lifecycle as (
  select asset, cast(event_no as bigint) as event_no, min(start_us) as start_us,
         max(end_us) filter (seg = ls) as end_us, max(end_reason) filter (seg = ls) as end_reason,
         max(peak) as max_score, cast(sum(lead_n + later_n) as bigint) as samples, count(*) - 1 as merge_count,
         arg_max(last_value, seg) as last_score
  from (select *, max(seg) over (partition by asset, event_no) as ls from m2) group by asset, event_no)"""


def incidents(target: str, hit: str, uptime: str) -> str:
    """Recursive walk of every device's numbered windows: three linked hits open, three linked clears of the target close."""
    return FIRST_WINDOWS + f""", i0 as (
  select device, captured_us as t_us, ordinal, value, k, site, quality = 'valid' as ok, row_number() over (partition by device order by captured_us, ordinal) as n from fw), i1 as (
  select *, {target} as target, {uptime} as uptime, case when not ok then 'N' when {hit} then 'O' else 'U' end as cls from i0), i2 as (
  select *, case when coalesce(lag(cls) over w = cls and lag(target) over w = target and uptime - lag(uptime) over w between 630000 and 670000, false) then null else n end as st
  from i1 window w as (partition by device order by n)), i3 as (select *, n - max(st) over (partition by device order by n) + 1 as run_n from i2), i4 as (
  select device, n, t_us, target, ok, case when run_n >= 3 and cls = 'O' then 'open' when run_n >= 3 and cls = 'U' then 'clear' end as trig from i3), walk as (
  select device, 0::bigint as n, null::varchar as live, null::bigint as since, null::varchar as seen, null::varchar as kind, null::varchar as told, null::bigint as at_us, null::bigint as opened_us from (select distinct device from i4)
  union all
  select x.device, x.n, case when live is null then case when trig = 'open' then target end when trig = 'clear' and target = live then null else live end,
         case when live is null then case when trig = 'open' then t_us end when trig = 'clear' and target = live then null else since end,
         case when live is null then 'observing' when ok and target = live then 'observing' else 'unknown' end,
         case when live is null then case when trig = 'open' then 'opened' end when trig = 'clear' and target = live then 'closed'
              when seen <> case when ok and target = live then 'observing' else 'unknown' end then case when ok and target = live then 'observing' else 'unknown' end end,
         coalesce(live, target), t_us, coalesce(since, t_us)
  from walk w join i4 x on x.device = w.device and x.n = w.n + 1), incident_log as (
  select device, told as target, opened_us, kind, at_us from walk where kind is not null)"""
