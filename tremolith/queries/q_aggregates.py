"""Aggregation and evaluation-metric queries."""

from pyspark.sql import functions as F

from ..functions.numeric import r6
from ..operators import aggregates as ag
from ..plans.registry import query
from ..plans.scan import declared_split, numbered
from ..sources.tables import DAY_US, points, snapshots, table, vectors, windows
from . import sql
from .q_events import _NOW

_COMM_SQL = f"""{sql.POINTS}, comm as (select asset % 10 as device, t_us // 86400000000 as boot, seq as window_id, t_us // 1000 as end_ms, t_us // 1000 - 60000 * (1 + k) as start_ms,
  k % 8 as acknowledged, k % 3 as transportFailures, k % 2 as retryableResponses, 0 as configurationFailures, case when k % 13 = 0 then 1 else 0 end as rejectedPackets,
  k % 8 + k % 3 + k % 2 + case when k % 13 = 0 then 1 else 0 end as attempts, least(k % 5, k % 8 + k % 3 + k % 2) as retries, k % 2 as replayAttempts,
  case when k % 8 > 0 then 10 + k else 0 end as ackLatencyMaxMs, case when k % 8 > 0 then 10 + k + (k % 8 - 1) * 5 else 0 end as ackLatencyTotalMs,
  1 + k % 4 as bufferSamples, (k % 10) * (1 + k % 4) as bufferDepthSum, k % 10 as bufferDepthMax, (k % 10) // 2 as bufferDepthLast, 10 as bufferCapacity, 0 as bufferDropped,
  k as wifiSamples, k // 3 as offlineSamples from points)"""


def comm(spark, sf):
    p = points(spark, sf)
    k = F.col("k")
    reject = F.when(k % 13 == 0, 1).otherwise(0)
    ms = F.floor(F.col("t_us") / 1000)
    return p.select(
        (F.col("asset") % 10).alias("device"), F.floor(F.col("t_us") / DAY_US).alias("boot"), F.col("seq").alias("window_id"),
        ms.alias("end_ms"), (ms - 60_000 * (1 + k)).alias("start_ms"), (k % 8).alias("acknowledged"), (k % 3).alias("transportFailures"),
        (k % 2).alias("retryableResponses"), F.lit(0).cast("long").alias("configurationFailures"), reject.cast("long").alias("rejectedPackets"),
        (k % 8 + k % 3 + k % 2 + reject).alias("attempts"), F.least(k % 5, k % 8 + k % 3 + k % 2).alias("retries"), (k % 2).alias("replayAttempts"),
        F.when(k % 8 > 0, 10 + k).otherwise(0).alias("ackLatencyMaxMs"), F.when(k % 8 > 0, 10 + k + (k % 8 - 1) * 5).otherwise(0).alias("ackLatencyTotalMs"),
        (1 + k % 4).alias("bufferSamples"), ((k % 10) * (1 + k % 4)).alias("bufferDepthSum"), (k % 10).alias("bufferDepthMax"),
        F.floor((k % 10) / 2).alias("bufferDepthLast"), F.lit(10).cast("long").alias("bufferCapacity"), F.lit(0).cast("long").alias("bufferDropped"),
        k.alias("wifiSamples"), F.floor(k / 3).alias("offlineSamples"))


T0, T1 = 1704067230000, 1706659200000
_AGG_SQL = ", ".join(f"cast(coalesce(sum({c}), 0) as bigint) as {c}" for c in ag.ADDITIVE)
_RATE_SQL = """attempts - acknowledged as failures, windows > 0 as hasData, round(100.0 * (attempts - acknowledged) / nullif(attempts, 0), 3) as failureRatePct,
  round(100.0 * retries / nullif(attempts, 0), 3) as retryRatePct, round(ackLatencyTotalMs / nullif(acknowledged, 0)::double, 3) as ackLatencyMeanMs,
  round(bufferDepthSum / nullif(bufferSamples, 0)::double, 3) as bufferDepthSampleMean"""
_COMM_AGG = f"""count(end_ms) as windows, {_AGG_SQL}, max(case when acknowledged > 0 then ackLatencyMaxMs end) as ackLatencyMaxMs, max(bufferDepthMax) as bufferDepthMax,
  arg_max(bufferDepthLast, (end_ms, boot, window_id)) as bufferDepthLast, arg_max(bufferCapacity, (end_ms, boot, window_id)) as bufferCapacity,
  cast(coalesce(sum(end_ms - start_ms), 0) as bigint) as observedDurationMs, min(start_ms) as first_start_ms, max(end_ms) as last_end_ms"""
_W = 3_600_000


@query("a01_comm_buckets", f"""with {_COMM_SQL}, live as (select *, (end_ms - 1) // {_W} * {_W} as bucket_ms from comm where end_ms > {T0} and end_ms <= {T1}), spine as (
  select device, unnest(generate_series({T0 // _W * _W}, {T1} - 1, {_W})) as bucket_ms from (select distinct device from comm)), g as (
  select s.device, s.bucket_ms, {_COMM_AGG}, count(*) filter (start_ms < greatest({T0}, s.bucket_ms)) as crossBoundaryWindows
  from spine s left join live l on l.device = s.device and l.bucket_ms = s.bucket_ms group by s.device, s.bucket_ms) select *, {_RATE_SQL} from g""")
def a01(spark, sf):
    return ag.comm_quality(comm(spark, sf), ["device"], T0, T1, 3600)[0]


@query("a01_comm_summary", f"with {_COMM_SQL}, g as (select device, {_COMM_AGG} from comm where end_ms > {T0} and end_ms <= {T1} group by device) select *, {_RATE_SQL} from g")
def a01s(spark, sf):
    return ag.comm_quality(comm(spark, sf), ["device"], T0, T1, 3600)[1]


@query("a02_site_summary", f"""with {sql.POINTS}, ev as (select asset, c_nationkey as site, case when score >= 95 then 'critical' when score >= 75 then 'warning' else 'device' end as severity,
    case when k % 3 = 0 then 'needs_review' when k % 3 = 1 then 'sensor_issue' else 'confirmed' end as label from points join customer on c_custkey = asset where score >= 60), lv as (
  select asset, arg_max(case when score >= 90 then 'critical' when score >= 60 then 'warning' else 'normal' end, seq) as status from points where score is not null group by asset), r as (
  select c_custkey as asset, c_nationkey as site, greatest(coalesce((select max(case severity when 'normal' then 0 when 'warning' then 1 when 'critical' then 2 end) from ev where ev.asset = c_custkey and label <> 'sensor_issue'), 0),
    coalesce((select case status when 'normal' then 0 when 'warning' then 1 else 2 end from lv where lv.asset = c_custkey), 0)) as r from customer), a as (
  select site, count(*) filter (r = 0) as normal_assets, count(*) filter (r = 1) as warning_assets, count(*) filter (r = 2) as critical_assets from r group by site), d as (
  select s_nationkey as site, count(*) as devices, count(*) filter (s_acctbal >= 0) as online, max(1700000000000000 + s_suppkey) as dl from supplier group by 1), u as (
  select site, count(*) filter (label = 'needs_review') as unreviewed from ev group by site), t as (select c_nationkey as site, max(t_us) as tl from points join customer on c_custkey = asset group by 1)
  select n_nationkey as site, n_name as site_name, coalesce(normal_assets, 0) as normal_assets, coalesce(warning_assets, 0) as warning_assets, coalesce(critical_assets, 0) as critical_assets,
    coalesce(devices, 0) as devices, coalesce(online, 0) as online, coalesce(unreviewed, 0) as unreviewed, greatest(dl, tl) as last_us,
    case when coalesce(critical_assets, 0) > 0 then 'critical' when coalesce(warning_assets, 0) > 0 or coalesce(online, 0) < coalesce(devices, 0) then 'warning' else 'normal' end as status
  from nation left join a on a.site = n_nationkey left join d on d.site = n_nationkey left join u on u.site = n_nationkey left join t on t.site = n_nationkey""")
def a02(spark, sf):
    p = points(spark, sf)
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("asset"), F.col("c_nationkey").alias("site"))
    sited = p.join(c, "asset")
    ev = sited.filter("score >= 60").select(
        "asset", "site", F.when(F.col("score") >= 95, "critical").when(F.col("score") >= 75, "warning").otherwise("device").alias("severity"),
        F.when(F.col("k") % 3 == 0, "needs_review").when(F.col("k") % 3 == 1, "sensor_issue").otherwise("confirmed").alias("label"))
    status = F.when(F.col("score") >= 90, "critical").when(F.col("score") >= 60, "warning").otherwise("normal")
    live = ag.latest_status(p.filter("score is not null").withColumn("s", status), "asset", "s", ["seq"])
    d = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("site"), F.when(F.col("s_acctbal") >= 0, "online").otherwise("offline").alias("health"),
                                            (1_700_000_000_000_000 + F.col("s_suppkey")).alias("last_us"))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("site"), F.col("n_name").alias("site_name"))
    return ag.site_summary(n, c, d, ev, live, sited.select("site", "t_us"), ["sensor_issue"])


@query("a03_latest_status", f"""with {sql.POINTS} select asset, case when s is null then 'unavailable' when s >= 75 then 'critical' when s >= 50 then 'warning' else 'normal' end as status
  from (select asset, score as s from points qualify row_number() over (partition by asset order by t_us // 3600000000 desc, seq desc) = 1)""")
def a03(spark, sf):
    status = F.when(F.col("score").isNull(), "unavailable").when(F.col("score") >= 75, "critical").when(F.col("score") >= 50, "warning").otherwise("normal")
    p = points(spark, sf).withColumns({"s": status, "hour": F.floor(F.col("t_us") / 3_600_000_000)})
    return ag.latest_status(p, "asset", "s", ["hour", "seq"])


_R = lambda *cs: ", ".join(f"round({c}, 6) + 0.0 as {c}" for c in cs)


@query("a04_feature_baseline", f"""with {sql.SNAPSHOTS}, e as (select unnest(x) as v, unnest(range(0, 9)) as feature from snapshots where stream < 5), g as (
  select cast(feature as int) as feature, count(v) as n, avg(v) as mean, stddev_pop(v) as std, min(v) as min, max(v) as max, avg(v) - 3 * stddev_pop(v) as low, avg(v) + 3 * stddev_pop(v) as high from e group by feature)
  select feature, n, {_R('mean', 'std', 'min', 'max', 'low', 'high')} from g""")
def a04(spark, sf):
    b = ag.feature_baseline(snapshots(spark, sf), "x", F.col("stream") < 5)
    return b.select("feature", "n", *[r6(c).alias(c) for c in ("mean", "std", "min", "max", "low", "high")])


@query("a05_signal_baseline", f"""with {sql.POINTS}, e as (select asset, value as rpm, case when asset % 7 = 0 then seq // 2 else seq end as ref, case when asset % 11 = 3 and k % 2 = 0 then 'hz' else 'rpm' end as unit,
    'load-' || (asset % 2) as cond from points where event_type in ('view', 'click') and k % 4 > 0), g as (
  select asset, count(*) as n, case when count(*) < 2 then 'TOO_FEW_SAMPLES' when count(distinct ref) <> count(*) then 'DUPLICATE_REFERENCES' when count(*) filter (rpm < 0) > 0 then 'INVALID_VALUE'
    when count(distinct unit) > 1 or count(distinct cond) > 1 then 'MIXED_UNITS_OR_CONDITIONS' end as refused, avg(rpm) as mean, stddev_pop(rpm) as std, min(rpm) as min, max(rpm) as max,
    avg(rpm) - 3 * stddev_pop(rpm) as low, avg(rpm) + 3 * stddev_pop(rpm) as high from e group by asset)
  select asset, n, refused, {', '.join(f"case when refused is null then round({c}, 6) + 0.0 end as {c}" for c in ('mean', 'std', 'min', 'max', 'low', 'high'))} from g""")
def a05(spark, sf):
    p = points(spark, sf).select(
        "asset", F.col("value").alias("rpm"), F.when(F.col("asset") % 7 == 0, F.floor(F.col("seq") / 2)).otherwise(F.col("seq")).alias("ref"),
        F.when((F.col("asset") % 11 == 3) & (F.col("k") % 2 == 0), "hz").otherwise("rpm").alias("unit"),
        F.concat(F.lit("load-"), F.col("asset") % 2).alias("cond"), "event_type", "k")
    ok = F.col("event_type").isin("view", "click") & (F.col("k") % 4 > 0)
    b = ag.signal_baseline(p, ["asset"], "rpm", "ref", "unit", "cond", ok)
    return b.select("asset", "n", "refused", *[r6(c).alias(c) for c in ("mean", "std", "min", "max", "low", "high")])


@query("a06_event_detail", f"""with {sql.SNAPSHOTS}, w as (select stream, row_number() over (partition by stream order by vec_id) as idx, vec_id, x from snapshots), ev as (
  select vec_id as event, stream, idx as ei from w where vec_id % 5 = 0), h as (select event, ei, w.idx, unnest(w.x) as v, unnest(range(0, 9)) as feature from ev join w on w.stream = ev.stream and w.idx between ei - 4 and ei + 3), g as (
  select event, cast(feature as int) as feature, avg(v) filter (idx < ei) as before_mean, avg(v) filter (idx >= ei) as after_mean, stddev_pop(v) filter (idx < ei) as before_std, stddev_pop(v) filter (idx >= ei) as after_std,
    count(*) filter (idx < ei) as before_n, count(*) filter (idx >= ei) as after_n from h group by event, feature), d as (
  select *, after_mean - before_mean as delta, case when abs(before_mean) > 1e-12 then (after_mean - before_mean) / abs(before_mean) * 100 end as pct_change from g)
  select event, feature, before_n, after_n, {_R('before_mean', 'after_mean', 'before_std', 'after_std', 'delta')}, round(pct_change, 3) + 0.0 as pct_change, before_n <> 4 as before_missing, after_n <> 4 as after_missing from d""")
def a06(spark, sf):
    s = snapshots(spark, sf)
    w = numbered(s, ["stream"], ["vec_id"], declared_split("vec_id"), "idx")
    ev = w.filter("vec_id % 5 = 0").select(F.col("vec_id").alias("event"), "stream", F.col("idx").alias("event_idx"))
    d = ag.event_detail(w, ev, "stream", "idx", "x", 4)
    return d.select("event", "feature", "before_n", "after_n", *[r6(c).alias(c) for c in ("before_mean", "after_mean", "before_std", "after_std", "delta")],
                    (F.round("pct_change", 3) + 0.0).alias("pct_change"), "before_missing", "after_missing")


_STATUS = "case when event_type = 'error' and k < 30 then 'rejected' when event_type = 'signup' and k < 20 then 'duplicate' when k = 99 then 'conflict' else 'accepted' end"


@query("a07_ingest_metrics", f"""with {sql.POINTS}, s as (select asset % 20 as gateway, {_STATUS} as st from points), g as (
  select gateway, count(*) as requests, count(*) filter (st = 'accepted') as accepted, count(*) filter (st = 'duplicate') as duplicates, count(*) filter (st = 'rejected') as rejected, count(*) filter (st = 'conflict') as conflicts from s group by gateway)
  select *, round(100 * ((rejected + conflicts) / requests::double), 2) as error_rate_pct, 100 * ((rejected + conflicts) / requests::double) < 10 as healthy from g""")
def a07(spark, sf):
    s = points(spark, sf).select((F.col("asset") % 20).alias("gateway"), F.expr(_STATUS).alias("st"))
    return ag.ingest_metrics(s, ["gateway"], "st")


@query("a08_dependency_health", f"""with {sql.POINTS}, s as (select asset % 10 as dep, seq, t_us, case when event_type = 'error' then 'degraded' else 'healthy' end as st from points), p as (
  select *, st <> 'degraded' and lag(st) over (partition by dep order by seq) = 'degraded' as up from s), g as (
  select dep, count(*) as reports, count(*) filter (st = 'degraded') as failures, max(t_us) filter (st = 'degraded') as last_failure_us, max(t_us) filter (up) as last_recovery_us, count(*) filter (up) as recoveries, arg_max(st, seq) as status from p group by dep)
  select *, round(100 * (failures / reports::double), 2) as failure_rate_pct from g""")
def a08(spark, sf):
    s = points(spark, sf).select((F.col("asset") % 10).alias("dep"), "seq", "t_us", F.when(F.col("fault"), "degraded").otherwise("healthy").alias("st"))
    return ag.dependency_health(s, "dep", ["seq"], "t_us", "st", declared_split("seq"))


@query("a09_inspect_tables", f"""with {sql.WINDOWS}, s as (select *, case when event_type = 'signup' then 'unavailable' when k % 17 = 0 then 'queued' else 'completed' end as st from windows), g as (
  select device, count(*) as rows, count(*) filter (st = 'queued') as pending, count(*) filter (st = 'unavailable') as unavailable, ({_NOW} - min(captured_us) filter (st = 'queued')) / 1e6 as oldest_pending_sec,
    arg_max(st, ordinal) as latest_status, ({_NOW} - arg_max(captured_us, ordinal)) / 1e6 as latest_age_sec from s group by device)
  select * replace (round(oldest_pending_sec, 6) as oldest_pending_sec, round(latest_age_sec, 6) as latest_age_sec), array_to_string(list_filter([case when rows >= 900 then 'ROW_CAPACITY' end, case when oldest_pending_sec > 2500000 then 'PROCESSING_BACKLOG' end,
    case when not latest_age_sec between -5 and 90000 then 'INPUT_STALE_OR_FUTURE' end, case when latest_status = 'unavailable' then 'INPUT_UNAVAILABLE' end], lambda x: x is not null), ',') as issues from g""")
def a09(spark, sf):
    w = windows(spark, sf).withColumn("st", F.when(F.col("event_type") == "signup", "unavailable").when(F.col("k") % 17 == 0, "queued").otherwise("completed"))
    d = ag.inspect_table(w, ["device"], "st", "captured_us", ["ordinal"], F.lit(_NOW), 1000, 2_500_000, 90_000)
    return d.withColumns({"oldest_pending_sec": F.round("oldest_pending_sec", 6), "latest_age_sec": F.round("latest_age_sec", 6), "issues": F.array_join("issues", ",")})


_LS = "case when k % 4 = 0 then 'verified' when k % 4 = 1 then 'weak' when k % 4 = 2 then 'unlabeled' else 'unmapped' end"


@query("a10_label_counts", f"""with {sql.POINTS}, s as (select asset % 3 as split, {_LS} as st, k % 4 = 0 as ok from points)
  select split, count(*) as rows, count(*) filter (ok) as eligible, count(*) filter (st = 'verified') as verified, count(*) filter (st = 'weak') as weak, count(*) filter (st = 'unlabeled') as unlabeled, count(*) filter (st = 'unmapped') as unmapped from s group by split""")
def a10(spark, sf):
    s = points(spark, sf).select((F.col("asset") % 3).alias("split"), F.expr(_LS).alias("st"), (F.col("k") % 4 == 0).alias("ok"))
    return ag.label_counts(s, ["split"], "st", "ok")


# scored windows: run = asset, label fixed per run, score in [0, 1]
_EVAL_SQL = f"""{sql.POINTS}, ev as (select seq, asset as run, asset % 8 as condition, ['health', 'ball', 'inner', 'outer', 'gear'][asset % 5 + 1] as kind, asset % 5 > 0 as label,
  least((value + case when asset % 5 > 0 then 20 else 0 end) / 200.0, 1.0) as score, asset % 3 as split, k from points)"""


def evaluation(spark, sf):
    p = points(spark, sf)
    a = F.col("asset")
    return p.select("seq", a.alias("run"), (a % 8).alias("condition"),
                    F.element_at(F.array(*[F.lit(x) for x in ("health", "ball", "inner", "outer", "gear")]), (a % 5 + 1).cast("int")).alias("kind"),
                    (a % 5 > 0).alias("label"), F.least((F.col("value") + F.when(a % 5 > 0, 20).otherwise(0)) / 200.0, F.lit(1.0)).alias("score"),
                    (a % 3).alias("split"), "k")


_CONF = "count(*) as n, count(*) filter (label and hit) as tp, count(*) filter (not label and hit) as fp, count(*) filter (label and not hit) as fn, count(*) filter (not label and not hit) as tn"
_RATES = """round(coalesce(tp / nullif(tp + fp, 0)::double, 0.0), 6) as precision, round(tp / nullif(tp + fn, 0)::double, 6) as recall, round(fp / nullif(tn + fp, 0)::double, 6) as fpr,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::double, 0.0), 6) as f1, round((tp + tn) / n::double, 6) as accuracy, round((tp / nullif(tp + fn, 0)::double + tn / nullif(tn + fp, 0)::double) / 2, 6) as balanced_accuracy"""
_RATE_COLS = ("precision", "recall", "fpr", "f1", "accuracy", "balanced_accuracy")


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("a11_binary_metrics", f"with {_EVAL_SQL}, h as (select *, score > 0.35 as hit from ev), g as (select condition, {_CONF} from h group by condition) select *, {_RATES} from g")
def a11(spark, sf):
    return _rounded(ag.binary_metrics(evaluation(spark, sf), ["condition"], F.col("label"), F.col("score") > 0.35), *_RATE_COLS)


@query("a12_roc_auc", f"""with {_EVAL_SQL}, r as (select split, label, rank() over w + (count(*) over (partition by split, score) - 1) / 2.0 as rk from ev window w as (partition by split order by score))
  select split, round((sum(rk) filter (label) - count(*) filter (label) * (count(*) filter (label) + 1) / 2.0) / (count(*) filter (label)::double * count(*) filter (not label)), 6) as auc from r group by split""")
def a12(spark, sf):
    return ag.roc_auc(evaluation(spark, sf), ["split"], F.col("label"), "score").withColumn("auc", F.round("auc", 6))


@query("a12_roc_auc_pooled", f"""with {_EVAL_SQL}, r as (select label, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as rk from ev)
  select round((sum(rk) filter (label) - count(*) filter (label) * (count(*) filter (label) + 1) / 2.0) / (count(*) filter (label)::double * count(*) filter (not label)), 6) as auc from r""")
def a12_pooled(spark, sf):
    return ag.roc_auc(evaluation(spark, sf), [], F.col("label"), "score").withColumn("auc", F.round("auc", 6))


@query("a15_quantiles_pooled", f"""with {_EVAL_SQL}, n as (select q, score, row_number() over (partition by q order by score) - 1 as i, count(*) over (partition by q) as n from ev, (select unnest([0.0, 0.5, 0.95, 1.0]) as q))
  select cast(q as double) as q, score as threshold from n where i = ceil(q * (n - 1))""")
def a15_pooled(spark, sf):
    e = evaluation(spark, sf)
    parts = [ag.quantile_higher(e, [], "score", q, 1e-3).select(F.lit(q).alias("q"), "threshold") for q in (0.0, 0.5, 0.95, 1.0)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("a12_roc_auc_documents", """with d as (select lang, toxic = 1 as label, n_chars / 100000.0 as score from labels join documents using (doc_id)), r as (
  select lang, label, rank() over (partition by lang order by score) + (count(*) over (partition by lang, score) - 1) / 2.0 as rk from d)
  select lang, case when count(*) filter (label) > 0 and count(*) filter (not label) > 0 then round((sum(rk) filter (label) - count(*) filter (label) * (count(*) filter (label) + 1) / 2.0) / (count(*) filter (label)::double * count(*) filter (not label)), 6) end as auc from r group by lang""")
def a12d(spark, sf):
    d = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id").select(
        "lang", (F.col("toxic") == 1).alias("label"), (F.col("n_chars") / 100000.0).alias("score"))
    return ag.roc_auc(d, ["lang"], F.col("label"), "score").withColumn("auc", F.round("auc", 6))


@query("a13_grouped_metrics", f"""with {_EVAL_SQL}, h as (select *, score > 0.35 as hit from ev), g as (
  select run, kind, grouping_id(run, kind) as gid, {_CONF} from h group by grouping sets ((), (run), (kind)))
  select run, kind, case gid when 3 then 'overall' when 1 then 'run' else 'kind' end as scope, n, tp, fp, fn, tn, {_RATES} from g""")
def a13(spark, sf):
    e = evaluation(spark, sf).withColumn("hit", F.col("score") > 0.35)
    return _rounded(ag.grouped_metrics(e, "run", "kind", "label", "hit"), *_RATE_COLS)


@query("a13_macro_fault_recall", f"""with {_EVAL_SQL}, g as (select kind, avg(cast(score > 0.35 as int)) as recall from ev where kind <> 'health' group by kind) select round(avg(recall), 6) as macro_fault_recall from g""")
def a13m(spark, sf):
    e = evaluation(spark, sf).withColumn("hit", F.col("score") > 0.35)
    return _rounded(ag.macro_fault_recall(ag.grouped_metrics(e, "run", "kind", "label", "hit"), "health"), "macro_fault_recall")


_DEC = "case when k % 10 = 0 then -1 when score > 0.35 then 1 else 0 end"


@query("a14_tristate_metrics", f"""with {_EVAL_SQL}, d as (select condition, label, {_DEC} as d from ev)
  select condition, count(*) as windows, count(*) filter (d = -1) as pending, count(*) filter (label) as positive, count(*) filter (not label) as negative, count(*) filter (label and d = 1) as tp,
   count(*) filter (not label and d = 1) as fp, count(*) filter (label and d = -1) as pending_anomaly, count(*) filter (not label and d = -1) as pending_normal,
   round(count(*) filter (d <> -1) / count(*)::double, 6) as coverage, round(count(*) filter (label and d = 1) / nullif(count(*) filter (label), 0)::double, 6) as detected_recall,
   round(count(*) filter (not label and d = 1) / nullif(count(*) filter (not label), 0)::double, 6) as fpr from d group by condition""")
def a14(spark, sf):
    e = evaluation(spark, sf).withColumn("d", F.expr(_DEC))
    return _rounded(ag.tristate_metrics(e, ["condition"], F.col("label"), "d"), "coverage", "detected_recall", "fpr")


_QH = lambda by, q: f"(select {by + ',' if by else ''} score from (select *, row_number() over ({'partition by ' + by if by else ''} order by score) as rn, count(*) over ({'partition by ' + by if by else ''}) as n from nrm) where rn = cast(ceil({q} * (n - 1)) as bigint) + 1)"


@query("a15_normal_threshold", f"""with {_EVAL_SQL}, nrm as (select * from ev where not label), c as {_QH('condition', 0.99)}, p as {_QH('', 0.99)}
  select 'single' as policy, round(arg_min(score, condition), 6) as threshold from c union all select 'pooled', round(score, 6) from p union all select 'max_condition', round(max(score), 6) from c""")
def a15(spark, sf):
    return _rounded(ag.normal_threshold(evaluation(spark, sf), "score", "condition", F.col("label")), "threshold")


@query("a15_quantiles", "\nunion all\n".join(
    (f"with {_EVAL_SQL}, nrm as (select * from ev) " if i == 0 else "") + f"select {q}::double as q, condition, round(score, 6) as threshold from {_QH('condition', q)}" for i, q in enumerate((0.95, 0.975, 0.99))))
def a15q(spark, sf):
    e = evaluation(spark, sf)
    parts = [ag.quantile_higher(e, ["condition"], "score", q, 1e-3).select(F.lit(q).alias("q"), "condition", F.round("threshold", 6).alias("threshold")) for q in (0.95, 0.975, 0.99)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("a16_sigma_threshold", f"with {_EVAL_SQL} select condition, round(avg(score) + 3 * stddev_pop(score), 6) as threshold from ev where not label group by condition")
def a16(spark, sf):
    return _rounded(ag.sigma_threshold(evaluation(spark, sf).filter(~F.col("label")), ["condition"], "score"), "threshold")


@query("a17_run_weights", f"""with {_EVAL_SQL}, w as (select *, count(*) over (partition by run) as rn, count(*) over () as al from ev), c as (select label, count(distinct run) as rs from ev group by label)
  select seq, round(al / (2.0 * rs * rn) * case when w.label then 1.0 else 2.0 end, 6) as weight from w join c on c.label = w.label""")
def a17(spark, sf):
    return ag.run_weights(evaluation(spark, sf), "label", "run", 2.0).select("seq", F.round("weight", 6).alias("weight"))


_POL_SQL = f"""{_EVAL_SQL}, pol as (select unnest([0.25, 0.3, 0.35, 0.4, 0.5]::double[]) as thr), h as (select 'p' || thr as policy, condition, label, score > thr as hit from ev, pol), f as (
  select policy, condition, count(*) filter (label and hit) / nullif(count(*) filter (label), 0)::double as recall, count(*) filter (not label and hit) / nullif(count(*) filter (not label), 0)::double as fpr from h group by policy, condition), s as (
  select policy, round(avg(recall), 6) as mean_recall, round(avg(fpr), 6) as mean_fpr, round(min(recall), 6) as worst_recall, round(max(fpr), 6) as worst_fpr, round(avg((recall + 1 - fpr) / 2), 6) as mean_balanced from f group by policy)"""


def _policies(spark, sf):
    e = evaluation(spark, sf).withColumn("thr", F.explode(F.array(*[F.lit(t) for t in (0.25, 0.3, 0.35, 0.4, 0.5)])))
    m = ag.binary_metrics(e.withColumn("policy", F.concat(F.lit("p"), F.col("thr").cast("string"))), ["policy", "condition"], F.col("label"), F.col("score") > F.col("thr"))
    return _rounded(ag.fold_summary(m, ["policy"]), "mean_recall", "mean_fpr", "worst_recall", "worst_fpr", "mean_balanced")


@query("a18_fold_summary", f"with {_POL_SQL} select * from s")
def a18(spark, sf):
    return _policies(spark, sf)


@query("a18_choose_policy", f"""with {_POL_SQL} select * from s where policy <> 'p0.25' and mean_fpr <= 0.3 and worst_fpr <= 0.6 and mean_recall >= (select mean_recall from s where policy = 'p0.25') - 0.5
  order by mean_recall desc, mean_fpr, policy limit 1""")
def a18c(spark, sf):
    return ag.choose_policy(_policies(spark, sf), "policy", "p0.25", 0.3, 0.6, 0.5)


@query("a19_common_ready", f"""with {_EVAL_SQL}, d as (select seq, unnest(['a', 'b', 'c']) as policy, unnest([case when k % 5 = 0 then -1 else 1 end, case when k % 7 = 0 then -1 else 0 end, 1]) as d from ev)
  select seq, policy, d from d qualify min(d) over (partition by seq) >= 0""")
def a19(spark, sf):
    e = evaluation(spark, sf)
    d = e.select("seq", F.explode(F.array(
        F.struct(F.lit("a").alias("policy"), F.when(F.col("k") % 5 == 0, -1).otherwise(1).alias("d")),
        F.struct(F.lit("b").alias("policy"), F.when(F.col("k") % 7 == 0, -1).otherwise(0).alias("d")),
        F.struct(F.lit("c").alias("policy"), F.lit(1).alias("d")))).alias("x")).select("seq", "x.policy", "x.d")
    return ag.common_ready(d, ["seq"], "d")


@query("a20_error_cases", f"""with {_EVAL_SQL}, h as (select *, score > 0.35 as hit from ev)
  select condition, case when hit then 'false_positive' else 'false_negative' end as kind, seq, row_number() over (partition by condition, hit order by seq) as case_no from h where label <> hit qualify case_no <= 10""")
def a20(spark, sf):
    e = evaluation(spark, sf).drop("kind")
    return ag.error_cases(e, "condition", ["seq"], F.col("label"), F.col("score") > 0.35, 10).select("condition", "kind", "seq", "case_no")


@query("a21_independent_holdout", """select l_suppkey as specimen, count(distinct l_linenumber % 3) as splits from lineitem group by l_suppkey having count(distinct l_linenumber % 3) > 1""")
def a21(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("specimen"), (F.col("l_linenumber") % 3).alias("split"))
    return ag.independent_holdout(l, "specimen", "split")


@query("a22_installation_status", """with p as (select s_nationkey as asset, s_acctbal > 0 as active, case when s_suppkey % 3 = 0 then '' else 'top' end as position, case when s_suppkey % 4 = 0 then null else 'x' end as orientation,
    case when s_suppkey % 5 = 0 then ' ' else 'stud' end as "mountingMethod", case when s_suppkey % 2 = 0 then '' else 'a.jpg' end as "photoRefs" from supplier where s_nationkey % 6 > 0), m as (
  select asset, list_filter([case when trim(coalesce(position, '')) = '' then 'position' end, case when orientation is null then 'orientation' end, case when trim("mountingMethod") = '' then 'mountingMethod' end, case when "photoRefs" = '' then 'photoRefs' end], lambda x: x is not null) as m from p where active), g as (
  select asset, count(*) filter (len(m) = 0) as complete_points, list_sort(list_distinct(flatten(list(m)))) as al from m group by asset)
  select n_nationkey as asset, coalesce(complete_points, 0) as complete_points, case when coalesce(complete_points, 0) > 0 then 'ready' else 'missing' end as status,
    array_to_string(case when coalesce(complete_points, 0) > 0 then [] when al is null then ['activeInstallPoint'] else al end, ',') as missing_fields from nation left join g on g.asset = n_nationkey""")
def a22(spark, sf):
    k = F.col("s_suppkey")
    p = table(spark, sf, "supplier").filter("s_nationkey % 6 > 0").select(
        F.col("s_nationkey").alias("asset"), (F.col("s_acctbal") > 0).alias("active"), F.when(k % 3 == 0, "").otherwise("top").alias("position"),
        F.when(k % 4 != 0, "x").alias("orientation"), F.when(k % 5 == 0, " ").otherwise("stud").alias("mountingMethod"), F.when(k % 2 == 0, "").otherwise("a.jpg").alias("photoRefs"))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("asset"))
    return ag.installation_status(p, n, "asset").withColumn("missing_fields", F.array_join("missing_fields", ","))


_CHK = lambda m: f"case when k % {m} = 0 then 'critical' when k % {m} = 1 then 'attention' when k % {m} = 2 then 'not_checked' else 'ok' end"


@query("a23_environment_status", f"""with {sql.POINTS}, c as (select asset, seq, {_CHK(31)} as dust, {_CHK(37)} as water, {_CHK(41)} as salt from points), r as (
  select *, case when 'critical' in (dust, water, salt) then 'critical' when 'attention' in (dust, water, salt) then 'attention' when 'not_checked' in (dust, water, salt) then 'not_checked' else 'ok' end as s from c)
  select asset, arg_max(s, seq) as environment_status, count(*) as inspections from r group by asset""")
def a23(spark, sf):
    c = points(spark, sf).select("asset", "seq", F.expr(_CHK(31)).alias("dust"), F.expr(_CHK(37)).alias("water"), F.expr(_CHK(41)).alias("salt"))
    return ag.environment_status(c, "asset", ["seq"], ["dust", "water", "salt"])


@query("a24_distribution", f"with {sql.WINDOWS} select device, quality, event_type, count(*) as rows from windows group by all")
def a24(spark, sf):
    return ag.distribution(windows(spark, sf), ["device", "quality", "event_type"])


@query("a25_axis_correlation", f"""with {sql.VECTORS}, e as (select vec_id, unnest(v[1:21]) as x, unnest(v[22:42]) as y, unnest(v[43:63]) as z from vectors)
  select vec_id, round(corr(x, y), 6) + 0.0 as corr_xy, round(corr(x, z), 6) + 0.0 as corr_xz, round(corr(y, z), 6) + 0.0 as corr_yz from e group by vec_id""")
def a25(spark, sf):
    v = vectors(spark, sf).select("vec_id", F.slice("v", 1, 21).alias("x"), F.slice("v", 22, 21).alias("y"), F.slice("v", 43, 21).alias("z"))
    c = ag.axis_correlation(v, "vec_id", ["x", "y", "z"])
    return c.select("vec_id", *[r6(x).alias(x) for x in ("corr_xy", "corr_xz", "corr_yz")])
