"""Lifecycle under rules by asset and version, in batch."""

from pyspark.sql import functions as F

from ..operators import rules as ru
from ..plans.registry import query
from ..sources.tables import points, table
from . import sql

_T0, _DAY, _HOUR = 1_704_067_200_000_000, 86_400_000_000, 3_600

# two versions of a rule for each asset; the second one starts on a day of its own, and is inactive for some
RULES = f"""rules as (
  select c_custkey as asset, {_T0} as from_us, 1 as version, true as active, cast(30 + c_custkey % 40 as double) as score_enter,
         greatest(0.0, 30 + c_custkey % 40 - c_nationkey) as score_exit, c_custkey % 3 * {4 * _HOUR}.0 as sec, c_custkey % 4 * {6 * _HOUR} as gap from customer union all
  select c_custkey, {_T0} + (10 + c_custkey % 7) * {_DAY}, 2, c_custkey % 11 <> 3, cast(25 + c_custkey * 7 % 50 as double),
         greatest(0.0, 25 + c_custkey * 7 % 50 - c_nationkey * 2), (c_custkey + 1) % 3 * {2 * _HOUR}.0, {24 * _HOUR} from customer)"""

OVER_POINTS = f""", {RULES}, r0 as (
  select p.asset, seq, t_us, fault, case when not fault then score end as score, 'm' || (k % 3) as model, r.* exclude (asset)
  from points p asof join rules r on p.asset = r.asset and p.t_us >= r.from_us where active or fault), r1 as (
  select *, case when fault then 'F' when score is null or score not between 0 and 100 then 'N' when score >= score_enter then 'O' when score < score_exit then 'U' else 'M' end as cls from r0), r2 as (
  select *, row_number() over w as pos, sum(case when fault then 1 else 0 end) over w as faults,
         case when lag(cls) over w is distinct from cls or lag(version) over w is distinct from version then row_number() over w end as st
  from r1 window w as (partition by asset order by t_us, seq)), r3 as (
  select *, max(st) over (partition by asset order by pos) as run from r2), r4 as (
  select *, first_value(t_us) over r as run_at, first_value(model) over r as run_model, max((score, -pos, model)) over r as top
  from r3 window r as (partition by asset, run order by pos)), r5 as (
  select *, case when cls = 'O' and t_us - run_at >= sec * 1000000 then 'open' when cls = 'U' and t_us - run_at >= sec * 1000000 then 'recovered' when cls = 'F' then 'sensor_fault' end as trig from r4), r6 as (
  select *, coalesce(last_value(trig ignore nulls) over (partition by asset order by pos rows between unbounded preceding and 1 preceding) = 'open', false) as was_open from r5), r7 as (
  select *, coalesce(trig = 'open', false) and not was_open as opened, coalesce(trig <> 'open', false) and was_open as closed from r6), r8 as (
  select *, max(case when opened then pos end) over (partition by asset order by pos) as seg, not opened and score between 0 and 100 as later from r7), rs as (
  select asset, seg, max(case when opened then run_at end) as start_us, max(case when closed then t_us end) as end_us, max(case when closed then trig end) as end_reason,
         max(case when opened then pos - run + 1 end) as lead_n, count(*) filter (later) as later_n, max(case when opened then top when later then (score, -pos, model) end) as peak,
         arg_max(score, pos) filter (opened or later) as last_score, max(case when opened then faults end) as fo, max(case when closed then faults end) as fe,
         max(case when opened then gap end) as gap, max(case when opened then version end) as version, max(case when opened then run_model end) as model,
         max(case when opened then seq end) as trigger_seq, max(case when opened then score end) as trigger_score,
         arg_max(t_us, pos) filter (opened or closed or later) as touched_us, arg_max(score_enter, pos) filter (opened or closed or later) as threshold
  from r8 where opened or was_open group by asset, seg), rm as (
  select *, coalesce(lag(end_reason) over w = 'recovered' and start_us - lag(end_us) over w between 0 and gap * 1000000 and fo = lag(fe) over w, false) as merged
  from rs window w as (partition by asset order by seg)), rn as (
  select *, sum(case when merged then 0 else 1 end) over (partition by asset order by seg) as event_no from rm), ruled as (
  select asset, cast(event_no as bigint) as event_no, min(start_us) as start_us, max(end_us) filter (seg = ls) as end_us, max(end_reason) filter (seg = ls) as end_reason,
         max(peak)[1] as max_score, max(peak)[3] as max_model, cast(sum(lead_n + later_n) as bigint) as samples, count(*) - 1 as merge_count, arg_max(last_score, seg) as last_score,
         cast(arg_min(version, seg) as bigint) as rule_version, arg_min(model, seg) as model, arg_min(trigger_seq, seg) as trigger_seq, arg_min(trigger_score, seg) as trigger_score,
         arg_max(touched_us, seg) as touched_us, arg_max(threshold, seg) as threshold
  from (select *, max(seg) over (partition by asset, event_no) as ls from rn) group by asset, event_no)"""
LIFECYCLE = sql.POINTS + OVER_POINTS


def rule_table(spark, sf):
    """Rules with thresholds of each customer number; the second version starts later and merges within a day."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("asset"), F.col("c_nationkey").alias("n"))
    a, zero = F.col("asset"), F.lit(0)
    one = c.select("asset", F.lit(_T0).alias("from_us"), F.lit(1).alias("version"), F.lit(True).alias("active"), (30 + a % 40).alias("threshold"), F.col("n").alias("hysteresis"),
                   (a % 3 * (4 * _HOUR)).alias("duration_sec"), (a % 4 * (6 * _HOUR)).alias("merge_gap_sec"))
    two = c.select("asset", (_T0 + (10 + a % 7) * _DAY).alias("from_us"), F.lit(2).alias("version"), (a % 11 != 3).alias("active"), (25 + a * 7 % 50).alias("threshold"),
                   (F.col("n") * 2).alias("hysteresis"), ((a + 1) % 3 * (2 * _HOUR)).alias("duration_sec"), (zero + 24 * _HOUR).alias("merge_gap_sec"))
    return ru.rule_rows(one.unionByName(two), ["asset"])


def model_points(spark, sf):
    return points(spark, sf).withColumn("model", F.concat(F.lit("m"), (F.col("k") % 3).cast("string")))


def ruled_events(spark, sf):
    return ru.event_lifecycle_rules(model_points(spark, sf), rule_table(spark, sf), ["asset"], ["t_us", "seq"], "t_us", evidence=["event_type", "value"])


@query("g03_event_lifecycle_rules", f"""with {LIFECYCLE} select asset, event_no, start_us, end_us, end_reason, max_score, max_model, samples, merge_count, last_score, rule_version, model,
  trigger_seq, trigger_score from ruled""")
def g03_rules(spark, sf):
    e = ruled_events(spark, sf)
    return e.select(*[c for c in e.columns if c not in ("trigger", "last")], F.col("trigger.seq").alias("trigger_seq"), F.col("trigger.score").alias("trigger_score"))


@query("g07_rule_event_records", f"""with {LIFECYCLE} select 'EVENT-' || substr(sha256(asset || '|' || start_us || '|' || rule_version), 1, 32) as id, asset, start_us, end_us,
  case when end_us is null then 'open' else 'closed' end as status, end_reason, case when round_even(max_score, 0) >= threshold then 'critical' else 'warning' end as severity,
  (coalesce(end_us, touched_us) - start_us) // 1000000 as duration_sec, cast(round_even(max_score, 0) as bigint) as max_score, cast(round_even(r.last_score, 0) as bigint) as score, samples, merge_count,
  rule_version as threshold_version, model as model_version, max_model as max_score_model_version, p.event_type as trigger_type, p.value as trigger_value
  from ruled r join points p using (asset) where p.seq = trigger_seq""")
def g07_rules(spark, sf):
    r = ru.rule_event_records(ruled_events(spark, sf), ["asset"])
    return r.select(*[c for c in r.columns if c != "trigger"], F.col("trigger.evidence.event_type").alias("trigger_type"), F.col("trigger.evidence.value").alias("trigger_value"))


@query("g06_rules_in_force", f"""with {sql.POINTS}, {RULES} select p.asset, version, count(*) as points, count(*) filter (active) as analysed, min(score_enter) as score_enter, min(score_exit) as score_exit,
  min(sec) as sec_exit, cast(min(gap) as bigint) as merge_gap_sec from points p asof join rules r on p.asset = r.asset and p.t_us >= r.from_us group by p.asset, version""")
def g06_rules(spark, sf):
    r = ru.with_rules(points(spark, sf), rule_table(spark, sf), ["asset"], ["t_us", "seq"], "t_us").where("rule is not null")
    g = r.groupBy("asset", F.col("rule.version").cast("int").alias("version")).agg(F.count(F.lit(1)).alias("points"), F.count_if("rule.active").alias("analysed"), F.min("rule.score_enter").alias("score_enter"),
                                                                                   F.min("rule.score_exit").alias("score_exit"), F.min("rule.sec_exit").alias("sec_exit"), F.min("rule.merge_gap_sec").alias("merge_gap_sec"))
    return g
