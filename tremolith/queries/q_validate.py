"""Validation and source queries: mutated rows of the given tables, judged by the validators."""

from pyspark.sql import functions as F

from ..functions.hashing import feature_digest
from ..functions.numeric import finite_text, r6
from ..operators import aggregates as ag, dedupe as dd, features as fe, validate as va
from ..operators.joins import with_registry
from ..plans.registry import query
from ..plans.scan import declared_split
from ..sources import readers as rd, sinks as sk
from ..sources.tables import DAY_US, points, snapshots, table, vectors, windows
from ..streaming.streams import scratch
from . import sql
from .q_aggregates import _COMM_SQL, comm
from .q_events import _NOW, first_windows

NOW = 1_706_000_000_000_000
HEX32 = "0123456789abcdef0123456789abcdef"


def _stamp(us):
    sec = F.floor(us / 1_000_000)
    return F.date_format(F.timestamp_seconds(sec), "yyyy-MM-dd'T'HH:mm:ss")


def telemetry_json(spark, sf):
    """Telemetry objects as text; ``k`` decides which rule a row breaks."""
    p = points(spark, sf)
    k = F.col("k")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.floor((F.col("t_us") - 1_704_067_200_000_000) / DAY_US).cast("int")).cast("string")
    sec = F.floor(F.pmod(F.col("t_us"), F.lit(DAY_US)) / 1_000_000)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    clock = F.concat_ws(":", two(F.floor(sec / 3600)), two(F.floor(sec % 3600 / 60)), two(sec % 60))
    stamp = F.concat(day, F.lit("T"), clock, F.when(k == 3, "").otherwise("Z"))
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    j = F.concat(
        F.lit('{"timestamp":'), q(stamp), F.lit(',"sequence":'), F.when(k == 4, q(F.col("seq").cast("string"))).otherwise(F.col("seq").cast("string")),
        F.lit(',"siteId":"s1","assetId":"'), F.when(k == 5, " ").otherwise(F.col("asset").cast("string")), F.lit('","deviceId":" dev-'), F.col("asset").cast("string"), F.lit(' "'),
        F.lit(',"vibrationRmsRaw":'), F.when(k == 6, "-1").when(k == 7, "true").when(k == 8, '"12.5"').otherwise(F.col("value").cast("string")),
        F.lit(',"vibrationPeakHz":'), F.when(k == 9, "null").otherwise("50"), F.when(k == 10, "").otherwise(',"vibrationRmsMmS":null'),
        F.lit(',"acousticDb":'), F.when(k == 11, "1").otherwise("null"), F.lit(',"scenarioLabel":'), F.when(k == 12, '"odd"').when(k == 13, '" normal "').otherwise("null"),
        F.lit(',"isSynthetic":'), F.when(k == 14, '"true"').otherwise("false"), F.when(k == 15, ',"extra":1').otherwise(""),
        F.when(k == 16, ',"rpm":10,"rpmStatus":"valid","rpmSource":"enc","rpmMeasuredAt":"2024-01-01T00:00:00Z"')
        .when(k == 17, ',"rpm":10,"rpmStatus":"stale","rpmSource":"enc","rpmMeasuredAt":"2024-01-01T00:00:00Z"')
        .when(k == 18, ',"rpm":null,"rpmStatus":"unavailable","rpmSource":null,"rpmMeasuredAt":null')
        .when(k == 19, ',"rpm":10,"rpmStatus":"valid","rpmSource":"enc","rpmMeasuredAt":"2024-03-01T00:00:00Z"').otherwise(""),
        F.when(k == 20, ',"source":5').otherwise(""), F.when(k == 21, "").otherwise("}"))
    return p.select("seq", "asset", "k", "value", "t_us", j.alias("payload"))


_F1_RULE = f"""case when k in (15, 21) then 'unknown_fields' when k = 5 then 'identifier' when k = 4 or seq < 1 then 'sequence' when k = 3 then 'timestamp' when t_us // 1000000 * 1000000 > {NOW} + 300000000 then 'future'
  when t_us // 1000000 * 1000000 < {NOW} - 15 * 86400000000 then 'retention' when k in (10, 11) then 'raw_only' when k = 12 then 'scenario' when k = 14 then 'is_synthetic' when k in (6, 7) then 'vibration_rms' when k in (17, 19) then 'rpm' when k = 9 then 'vibration_peak' when k = 20 then 'text' end"""


@query("f01_normalize_telemetry", f"""with {sql.POINTS}, r as (select *, {_F1_RULE} as rule from points)
  select seq, rule as error_rule, case when rule = 'raw_only' then 'INVALID_RAW_ONLY_FIELD' when rule is not null then 'INVALID_TELEMETRY_PAYLOAD' end as error_code,
  case when rule is null then 'DEV-' || asset end as device, case when rule is null then case when k = 8 then 12.5 else value end end as vibration from r""")
def f01(spark, sf):
    n = va.normalize_telemetry(telemetry_json(spark, sf).select("seq", "payload"), "payload", F.lit(NOW), 15)
    ok = F.col("error_rule").isNull()
    return n.select("seq", "error_rule", "error_code", F.when(ok, F.col("device")).alias("device"), F.when(ok, F.col("vibration_rms_raw")).alias("vibration"))


@query("f07_quarantine", f"""with {sql.POINTS}, r as (select *, {_F1_RULE} as rule from points) select case when rule = 'raw_only' then 'INVALID_RAW_ONLY_FIELD' when rule is not null then 'INVALID_TELEMETRY_PAYLOAD' else 'good' end as outcome, count(*) as rows from r group by 1""")
def f07(spark, sf):
    n = va.normalize_telemetry(telemetry_json(spark, sf).select("seq", "payload"), "payload", F.lit(NOW), 15)
    good, bad = va.split_quarantine(n, "payload")
    return good.select(F.lit("good").alias("outcome")).unionByName(bad.select(F.col("error_code").alias("outcome"))).groupBy("outcome").agg(F.count(F.lit(1)).alias("rows"))


@query("f03_finite_number", f"""with {sql.POINTS} select seq, case when k % 7 = 0 or k % 7 = 1 or k % 7 = 2 or k % 7 = 3 then null when k % 7 = 4 then value else value end as number from points""")
def f03(spark, sf):
    k = F.col("k") % 7
    t = F.when(k == 0, "NaN").when(k == 1, "true").when(k == 2, "1e999").when(k == 3, "abc").when(k == 4, F.concat(F.lit(" "), F.col("value").cast("string"))).otherwise(F.col("value").cast("string"))
    return points(spark, sf).select("seq", finite_text(t).alias("number"))


_RPM = """case k % 6 when 0 then true when 1 then false when 2 then false when 3 then true when 4 then false else true end"""


@query("f04_validate_rpm", f"with {sql.POINTS} select seq, case when not ({_RPM}) then 'INVALID_TELEMETRY_PAYLOAD' end as error_code from points")
def f04(spark, sf):
    k = F.col("k") % 6
    j = (F.when(k == 0, '{"rpm":1.5}').when(k == 1, '{"rpm":5,"rpmStatus":"valid","rpmSource":null,"rpmMeasuredAt":null}')
         .when(k == 2, '{"rpm":null,"rpmStatus":"stale","rpmSource":"e","rpmMeasuredAt":"2024-01-01T24:00:00Z"}').when(k == 3, '{"rpm":null,"rpmStatus":"stale","rpmSource":"e","rpmMeasuredAt":"2024-01-01T00:00:00+00:00"}')
         .when(k == 4, '{"rpm":null,"rpmStatus":"off","rpmSource":null,"rpmMeasuredAt":null}').otherwise('{"rpm":0,"rpmStatus":"valid","rpmSource":"e","rpmMeasuredAt":"2024-01-01T00:00:00Z"}'))
    return va.validate_rpm(points(spark, sf).select("seq", "t_us", j.alias("payload")), "payload", F.col("t_us") + DAY_US).select("seq", "error_code")


@query("f05_within_retention", f"with {sql.POINTS} select seq from points where t_us between {NOW} - 10 * 86400000000 and {NOW} + 300000000")
def f05(spark, sf):
    return va.within_retention(points(spark, sf), "t_us", F.lit(NOW), 10).select("seq")


@query("f06_device_mapping", f"""with {sql.POINTS}, t as (select seq, case when k = 1 then 99 else s_nationkey end as site, case when k = 2 then asset + 1 else asset end as asset, asset as device from points left join supplier on s_suppkey = asset), a as (select s_suppkey as asset, s_nationkey as site from supplier),
  d as (select s_suppkey as device, s_nationkey as dsite, case when s_acctbal > 1000 then 'active' else 'off' end as mp, case when s_suppkey % 9 = 0 then 'revoked' else 'registered' end as cert from supplier)
  select seq, case when t.site = 99 or t.site is null then 'SITE_NOT_FOUND' when a.asset is null then 'ASSET_NOT_FOUND' when d.dsite <> t.site or t.asset <> t.device or mp <> 'active' then 'DEVICE_MAPPING_MISMATCH' when cert <> 'registered' then 'DEVICE_CERTIFICATE_NOT_ACTIVE' end as error_code
  from t left join a on a.asset = t.asset and a.site = t.site left join d using (device)""")
def f06(spark, sf):
    s = table(spark, sf, "supplier")
    home = s.select(F.col("s_suppkey").alias("__h"), F.col("s_nationkey").alias("home"))
    t = points(spark, sf).join(home, F.col("asset") == F.col("__h"), "left").select(
        "seq", F.when(F.col("k") == 1, 99).otherwise(F.col("home")).alias("site"), F.when(F.col("k") == 2, F.col("asset") + 1).otherwise(F.col("asset")).alias("asset"), F.col("asset").alias("device"))
    d = s.select(F.col("s_suppkey").alias("device"), F.col("s_nationkey").alias("site"), F.col("s_suppkey").alias("asset"), F.when(F.col("s_acctbal") > 1000, "active").otherwise("off").alias("mapping"),
                 F.when(F.col("s_suppkey") % 9 == 0, "revoked").otherwise("registered").alias("certificate"))
    a = s.select(F.col("s_suppkey").alias("asset"), F.col("s_nationkey").alias("site"))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("site"))
    return va.check_device_mapping(with_registry(t, n, a, d)).select("seq", "error_code")


@query("f08_quarantine_dedupe", f"""with {sql.POINTS}, m as (select seq, case when k % 5 > 0 then asset * 10 + k % 3 end as key, k % 2 as body from points where event_type = 'error')
  select seq, case when key is null or seq = min(seq) over (partition by key) then 'accepted' when body = first_value(body) over (partition by key order by seq) then 'duplicate' else 'conflict' end as disposition from m""")
def f08(spark, sf):
    m = points(spark, sf).filter("fault").select("seq", F.when(F.col("k") % 5 > 0, F.col("asset") * 10 + F.col("k") % 3).alias("key"), (F.col("k") % 2).alias("body"))
    return va.dedupe_quarantine(m, "key", ["body"], "seq").select("seq", "disposition")


@query("f09_trusted_labels", f"""with {sql.POINTS} select seq, case when k % 2 = 0 and k % 3 > 0 then event_type end as vibration, null as acoustic from points""")
def f09(spark, sf):
    p = points(spark, sf).select("seq", (F.col("k") % 2 == 0).alias("v"), F.when(F.col("k") % 3 > 0, F.array(F.lit("vibration"))).otherwise(F.array().cast("array<string>")).alias("f"),
                                 F.lit("svc").alias("p"), F.lit(1).alias("s"), F.col("event_type").alias("vibration"), F.col("event_type").alias("acoustic"))
    return va.trusted_labels(p, "v", "f", "p", "s", ["vibration", "acoustic"]).select("seq", "vibration", "acoustic")


@query("f10_validate_window", f"""with {sql.WINDOWS} select ordinal, case when k = 1 then 'identifier' when k = 2 then 'boot' when k = 3 then 'integer' when k in (4, 5) then 'profile' when k = 6 then 'quality' when captured_us not between {NOW} - 2 * 86400000000 and {NOW} + 300000000 then 'time_bounds' end as error_rule from windows""")
def f10(spark, sf):
    k = F.col("k")
    w = windows(spark, sf).select(
        "ordinal", "idx", "uptime_us", "captured_us", F.when(k == 1, "d1").otherwise("D1").alias("device"), F.lit("S1").alias("site"), F.lit("A1").alias("asset"), F.when(k == 2, "zz").otherwise(HEX32).alias("boot"),
        F.when(k == 3, 600).otherwise(512).alias("sample_count"), F.lit(1).alias("schema_version"), F.when(k == 4, 400).otherwise(800).alias("rate_hz"), F.lit("p").alias("profile"), F.lit("g").alias("unit"),
        F.when(k == 5, F.array(F.lit("XY"), F.lit("Z"))).otherwise(F.array(F.lit("X"), F.lit("Y"), F.lit("Z"))).alias("axes"), F.when(k == 6, "odd").otherwise(F.col("quality")).alias("quality"))
    return va.validate_window(w, "p", "g", F.lit(NOW)).select("ordinal", "error_rule")


_JSON = """case k % 6 when 0 then props when 1 then '{"a":1,"a":2}' when 2 then '{"a":NaN}' when 3 then '{"a":1e999}' when 4 then substr(props, 1, length(props) - 1) else '[1, "x", null, true]' end"""


@query("f11_strict_json", f"select event_id as seq, cast(json_extract_string(props, '$.k') as bigint) % 6 in (0, 5) as ok from events")
def f11(spark, sf):
    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.select(F.col("event_id").alias("seq"), va.strict_json_ok(F.expr(_JSON)).alias("ok"))


@query("f12_validate_base21", f"""with {sql.POINTS} select seq, case when event_type = 'signup' and k % 2 = 0 then 'INVALID_WINDOW_WITH_FEATURES' when event_type = 'signup' then null when k % 9 = 1 then 'SAMPLE_COUNT' when k % 9 = 2 then 'INVALID_FEATURES' when k % 9 = 3 then 'INVALID_RMS_PEAK_OR_KURTOSIS' end as error_code from points""")
def f12(spark, sf):
    k = F.col("k")
    v = F.array(*[F.when((k % 9 == 2) & F.lit(i == 20), float("nan")).otherwise(F.lit([0.5, 1.0, 3.0, 0.1, 0.1, 0.1, 0.1][i % 7])) for i in range(21)])
    v = F.transform(v, lambda e, i: F.when((k % 9 == 3) & (i == 8), 0.1).otherwise(e))
    w = points(spark, sf).select("seq", "k", F.when(F.col("event_type") == "signup", "clipped").otherwise("valid").alias("quality"), F.when(k % 9 == 1, 500).otherwise(512).alias("n"),
                                 F.when((F.col("event_type") != "signup") | (k % 2 == 0), v).alias("features"))
    return va.validate_base21(w, "features", "quality", "n").select("seq", "error_code")


def _nine(k):
    return F.map_from_arrays(F.array(*[F.lit(n) for n in va.FEATURES9]), F.array(*[F.lit(1.0 + i) for i in range(9)]))


_SNAP_RULE = f"""case when k = 1 then 'identifier' when k = 2 then 'boot' when k = 3 then 'integer' when k = 4 then 'profile' when k = 5 then 'quality_or_features' when k = 6 then 'integrity' when slot_us - 640000 - off not between {NOW} - 20 * 86400000000 and {NOW} + 300000000 then 'time_bounds'
  when k = 7 then 'slot' when off > 1000000 then 'slot_fit' when k = 9 then 'history_sequence' end"""


@query("f13_validate_snapshot", f"""with {sql.POINTS}, s as (select seq, k, (t_us // 25000000 + 1) * 25000000 as slot_us, (k % 12) * 100000 as off from points) select seq, {_SNAP_RULE} as error_rule from s""")
def f13(spark, sf):
    k = F.col("k")
    slot = (F.floor(F.col("t_us") / 25_000_000) + 1) * 25
    p = points(spark, sf).select(
        "seq", F.when(k == 1, "d 1").otherwise("D1").alias("device"), F.lit("S").alias("site"), F.lit("A").alias("asset"), F.lit("N").alias("sensor"), F.when(k == 2, "x").otherwise(HEX32).alias("boot"), F.lit(1).alias("idx"),
        F.lit(5).alias("uptime_us"), F.when(k == 3, 513).otherwise(512).alias("sample_count"), F.when(k == 4, 100).otherwise(800).alias("rate_hz"), F.lit("dimensionless").alias("unit"), F.lit("valid").alias("quality"),
        F.lit(None).cast("string").alias("reason"), F.when(k != 5, _nine(k)).alias("features"), (k != 6).alias("digest_ok"), (slot * 1_000_000 - 640_000 - (k % 12) * 100_000).alias("captured_us"),
        F.when(k == 7, slot + 1).otherwise(slot).alias("slot"), F.when(k != 9, 1).alias("history_seq"))
    return va.validate_snapshot(p, True, F.lit(NOW), 20 * DAY_US).select("seq", "error_rule")


@query("f14_classify_measurements", f"""with {sql.POINTS} select seq, case k % 6 when 0 then 'absent' when 1 then 'partial' when 2 then 'invalid' when 3 then 'complete' when 4 then 'complete' else 'complete' end as rms_state,
  case k % 6 when 0 then 'absent' when 1 then 'partial' when 2 then 'complete' when 3 then 'invalid' when 4 then 'complete' else 'invalid' end as spectrum_state from points""")
def f14(spark, sf):
    m = F.col("k") % 6
    bins = lambda v: F.array_repeat(F.lit(v), 4)
    none = F.lit(None).cast("array<double>")
    rms = lambda bad: F.when(m == 0, None).when((m == 1) & F.lit(bad), None).when((m == 2) & F.lit(bad), -1.0).when(m == 5, 0.0).otherwise(0.5)
    spec = lambda bad: F.when(m == 0, none).when((m == 1) & F.lit(bad), F.array_repeat(F.lit(1.0), 3)).when((m == 3) & F.lit(bad), F.array_repeat(F.lit(1.0), 5)).when(m == 4, bins(0.5)).otherwise(bins(1.0))
    p = points(spark, sf).select("seq", *[rms(i == 0).alias(f"r{i}") for i in range(3)], *[spec(i == 1).alias(f"s{i}") for i in range(3)], F.lit("valid").alias("q"))
    return va.classify_measurements(p, ["r0", "r1", "r2"], ["s0", "s1", "s2"], "q", 4).select("seq", "rms_state", "spectrum_state")


@query("f15_validate_delivery", f"""with {sql.POINTS}, d as (select seq, k, ['edge-state', 'history', 'feature', 'feature-history'][k % 4 + 1] as policy, k // 4 % 4 as e, k % 7 as a from points)
  select seq, case when k = 50 or e = 3 then 'event_or_state' when policy in ('edge-state', 'history') and k = 52 then 'mode_or_interval' when e = 1 and a <> 3 then 'counters_vs_state' when e = 0 and a >= 3 and not (policy = 'xx') and policy in ('edge-state', 'history', 'feature', 'feature-history') then 'counters_vs_state'
    when k = 60 then 'quality' when policy in ('feature', 'feature-history') and e = 0 and k % 3 = 0 then 'slot' when policy = 'feature' and e = 2 and k % 3 > 0 then 'slot' when policy = 'history' and (e = 0) <> (k % 5 > 0) then 'history_sequence' when policy = 'history' and e = 1 and k % 2 = 1 then 'raw_evidence' end as error_rule from d""")
def f15(spark, sf):
    k = F.col("k")
    e = F.floor(k / 4) % 4
    pol = F.element_at(F.array(*[F.lit(x) for x in ("edge-state", "history", "feature", "feature-history")]), (k % 4 + 1).cast("int"))
    pick = lambda a, b, c: F.when(e == 0, a).when(e == 1, b).otherwise(c)  # the fourth case has an event of no policy
    event = F.when(pol == "edge-state", pick("normal_periodic", "anomaly_enter", "anomaly_periodic")).when(pol == "history", pick("history_periodic", "anomaly_enter", "anomaly_periodic")).otherwise(pick("periodic", "anomaly_start", "anomaly_active"))
    event = F.when(e == 3, "unheard").otherwise(event)
    interval = F.when(pol == "edge-state", pick(F.lit(300), F.lit(0), F.lit(10))).otherwise(pick(F.lit(25), F.lit(0), F.lit(10)))
    p = points(spark, sf).select(
        "seq", pol.alias("policy"), event.alias("event"), F.when(k == 50, "ODD").when(e == 0, "NORMAL").otherwise("ANOMALY_ACTIVE").alias("state"), F.when(e == 1, "immediate").otherwise("periodic").alias("mode"),
        F.when(k == 52, 7).otherwise(interval).alias("interval_sec"), (k % 7).alias("anomaly_count"), F.lit(0).cast("long").alias("normal_count"), F.when(k == 60, "clipped").otherwise("valid").alias("quality"),
        F.when(k % 3 > 0, 25).alias("slot"), F.when(k % 5 > 0, 1).alias("history_seq"), (k % 2 == 0).alias("has_raw"))
    return va.validate_delivery(p).select("seq", "error_rule")


@query("f16_batch_meta", f"""with {sql.POINTS} select seq, case when k = 1 then 'policy' when k = 2 then 'mode' when k = 3 then 'reason' when k = 4 then 'baseline' when k = 5 then 'dropped' end as error_rule from points""")
def f16(spark, sf):
    k = F.col("k")
    p = points(spark, sf).select("seq", F.when(k == 1, "x").otherwise("edge-trigger-batch-v1").alias("policy"), F.when(k == 2, "x").otherwise("replay").alias("mode"), F.when(k == 3, "x").otherwise("severe").alias("reason"),
                                 F.when(k == 4, "").otherwise("b1").alias("baseline"), F.when(k == 5, -1).otherwise(k).alias("dropped"))
    return va.validate_batch_meta(p).select("seq", "error_rule")


@query("f17_expected_interval", f"""with {sql.POINTS} select seq, case k % 3 when 0 then case when fault then 10 else 25 end when 1 then case when fault then 10 else 300 end else 300 end as expected_interval_sec from points""")
def f17(spark, sf):
    k = F.col("k") % 3
    p = points(spark, sf).select("seq", F.when(k == 0, "history").when(k == 1, "edge-state").otherwise("periodic-single").alias("policy"), F.when(F.col("fault"), "ANOMALY_ACTIVE").otherwise("NORMAL").alias("state"))
    return va.expected_interval(p).select("seq", "expected_interval_sec")


@query("f18_validate_summary", f"""with {sql.POINTS} select seq, case when k = 1 then 'identifier' when k = 2 then 'boot' when k = 3 then 'history_sequence' when k = 4 then 'quality' when k = 5 then 'features' when k = 6 then 'integrity' when t_us not between {NOW} - 2 * 86400000000 and {NOW} + 300000000 then 'time_bounds' end as error_rule from points""")
def f18(spark, sf):
    k = F.col("k")
    p = points(spark, sf).select("seq", F.when(k == 1, "").otherwise("D").alias("device"), F.lit("N1").alias("sensor"), F.when(k == 2, "q").otherwise(HEX32).alias("boot"), F.lit(1).alias("idx"), F.lit(1).alias("uptime_us"),
                                 F.when(k == 3, -1).otherwise(4).alias("history_seq"), F.when(k == 4, "odd").otherwise("valid").alias("quality"), F.when(k != 5, _nine(k)).alias("features"), (k != 6).alias("digest_ok"),
                                 F.col("t_us").alias("captured_us"))
    return va.validate_summary(p, F.lit(NOW)).select("seq", "error_rule")


COUNTERS = ag.ADDITIVE + ["ackLatencyMaxMs", "bufferDepthMax", "bufferDepthLast", "bufferCapacity"]


@query("f19_comm_report", f"""with {_COMM_SQL} select window_id, case when window_id < 1 then 'window_id' when window_id % 17 = 3 then 'duration' when end_ms > 1706000000000 + 300000 then 'future' when attempts <> acknowledged + transportFailures + retryableResponses + configurationFailures + rejectedPackets + case when window_id % 19 = 4 then 1 else 0 end or retries > attempts or replayAttempts > attempts then 'attempts'
  when acknowledged = 0 and (ackLatencyTotalMs > 0 or ackLatencyMaxMs > 0) or acknowledged > 0 and not (ackLatencyMaxMs <= ackLatencyTotalMs and ackLatencyTotalMs <= ackLatencyMaxMs * acknowledged) then 'latency'
  when not (bufferDepthLast <= bufferDepthMax and bufferDepthMax <= bufferCapacity and bufferDepthMax <= bufferDepthSum and bufferDepthSum <= bufferDepthMax * bufferSamples and offlineSamples <= wifiSamples) then 'buffer' end as error_rule from comm""")
def f19(spark, sf):
    w = F.col("window_id")
    c = comm(spark, sf).withColumns({"start_uptime_ms": F.lit(0).cast("long"), "end_uptime_ms": F.col("end_ms") - F.col("start_ms") + F.when(w % 17 == 3, 1).otherwise(0),
                                     "rejectedPackets": F.col("rejectedPackets") + F.when(w % 19 == 4, 1).otherwise(0)})
    return va.validate_comm_report(c, F.lit(1706000000000), COUNTERS).select("window_id", "error_rule")


@query("f20_validate_frame", f"""with {sql.VECTORS} select vec_id, case when vec_id % 20 = 1 then 'channels' when vec_id % 20 = 2 then 'profile' when vec_id % 20 = 3 then 'features' when vec_id % 20 = 4 then 'partial_waveform' when vec_id % 20 = 5 then 'request_id' end as error_rule, vec_id % 20 in (0, 2, 3, 5, 6, 7, 8, 9) as has_raw from vectors""")
def f20(spark, sf):
    m = F.col("vec_id") % 20
    raw = m.isin(0, 2, 3, 5, 6, 7, 8, 9) | (m == 1)
    part = lambda i: F.slice("v", 16 * i + 1, 16)
    profile = {"vibrationX": (800, 16, "g"), "vibrationY": (800, 16, "g"), "vibrationZ": (800, 16, "g"), "acoustic": (16000, 16, "pcm24")}
    def ch(i, name):
        rate, n, unit = profile[name]
        s = part(i)
        held = F.when(raw & ~((m == 1) & F.lit(i == 3)) | ((m == 4) & F.lit(i == 0)), s)
        return F.struct(F.when((m == 2) & F.lit(i == 3), 8000).otherwise(rate).alias("rate"), F.lit(n).alias("count"), F.lit(unit).alias("unit"), F.lit(0.5).alias("rms"),
                        F.when((m == 3) & F.lit(i == 1), -1.0).otherwise(0.9).alias("peak"), F.lit(None).cast("double").alias("kurtosis"), F.array(F.lit(0.1), F.lit(0.1), F.lit(0.1)).alias("bands"), held.alias("samples"))
    names = list(profile)
    full = F.map_from_arrays(F.array(*[F.when((m == 1) & F.lit(i == 3), "extra").otherwise(n) for i, n in enumerate(names)]), F.array(*[ch(i, n) for i, n in enumerate(names)]))
    f = vectors(spark, sf).select("vec_id", (F.col("vec_id") + 1).alias("sequence"), F.lit(NOW).alias("captured_us"), full.alias("channels"), F.when(raw & (m != 5), HEX32).when(m == 5, "bad").alias("request_id"))
    return va.validate_frame(f, "channels", F.lit(NOW), profile).select("vec_id", "error_rule", "has_raw")


@query("f21_model_input", f"""with {sql.POINTS} select seq, case when k = 1 then 'model' when k = 2 then 'identifier' when k = 3 then 'integer' when k = 4 then 'sample_bounds' when k = 5 then 'feature_names' when score is null then 'feature_values' when t_us not between {NOW} - 7 * 86400000000 and {NOW} + 300000000 then 'time_bounds' end as error_rule from points""")
def f21(spark, sf):
    k = F.col("k")
    m = F.map_from_arrays(F.array(F.lit("a"), F.when(k == 5, "c").otherwise("b")), F.array(F.col("score"), F.lit(1.0)))
    p = points(spark, sf).select("seq", F.when(k == 1, "m0").otherwise("m1").alias("model"), F.when(k == 2, " s").otherwise("s").alias("source"), F.lit("p1").alias("preprocessing"), F.lit(1).alias("idx"),
                                 F.when(k == 3, 0).otherwise(800).alias("rate_hz"), F.lit(0).alias("start_sample"), F.when(k == 4, 0).otherwise(512).alias("end_sample"), m.alias("features"), F.col("t_us").alias("captured_us"))
    return va.validate_model_input(p, "features", ["a", "b"], "m1", F.lit(NOW)).select("seq", "error_rule")


@query("f22_feature_issues", f"""with {sql.POINTS} select seq, null as feature, 'empty_features' as reason from points where k % 8 = 0
  union all select seq, 'rms', case k % 8 when 1 then 'nan' when 2 then 'inf' when 3 then 'missing' when 4 then 'invalid_type' when 5 then 'invalid_type' end from points where k % 8 between 1 and 5
  union all select seq, 'peak', 'missing_key' from points where k % 8 = 6""")
def f22(spark, sf):
    k = F.col("k") % 8
    v = F.when(k == 1, "NaN").when(k == 2, "-Infinity").when(k == 3, None).when(k == 4, '"1.0"').when(k == 5, "true").otherwise("1.5")
    m = F.when(k == 0, F.create_map().cast("map<string,string>")).when(k == 6, F.create_map(F.lit("rms"), v)).otherwise(F.create_map(F.lit("rms"), v, F.lit("peak"), F.lit("2.0")))
    b = spark.createDataFrame([("rms",), ("peak",)], "feature string")
    return va.feature_issues(points(spark, sf).select("seq", m.alias("m")), "seq", "m", b)


_HEALTH_SQL = f"""{sql.POINTS}, h as (select seq, asset, k, case when k % 9 = 0 then t_us - 172800000000 else t_us end as rep from points), s as (select *, max(rep) over (partition by asset order by seq rows between unbounded preceding and 1 preceding) as top from h)"""


def _health(spark, sf):
    k = F.col("k")
    fault = F.struct(F.when(k == 21, "Bad Code!").otherwise(F.concat(F.lit(" IMU."), k % 4)).alias("code"), F.when(k == 22, "odd").when(k % 2 == 0, "recovered").alias("status"), F.when(k == 23, "fatal").alias("severity"), F.lit("d").alias("detail"))
    p = points(spark, sf).select("asset", "seq", (F.col("t_us") - F.when(k % 9 == 0, 172_800_000_000).otherwise(0)).alias("reported_us"), F.when(k == 1, 10.0).when(k == 2, None).otherwise(-60.0).alias("rssi_dbm"),
                                 F.when(k == 3, -1).otherwise(2).alias("reboot_count"), F.when(k == 4, 101.0).otherwise(50.0).alias("buffer_pct"), F.when(k == 5, F.array_repeat(fault, 33)).otherwise(F.array(fault)).alias("faults"))
    return va.validate_health(p, "asset", "seq", declared_split("seq"))


@query("f23_validate_health", f"with {_HEALTH_SQL} select seq, case when k = 1 then 'rssi' when k = 3 then 'reboot_count' when k = 4 then 'buffer' when k = 5 then 'too_many_faults' when top is not null and rep < top then 'stale' end as error_rule from s")
def f23(spark, sf):
    return _health(spark, sf)[0].select("seq", "error_rule")


@query("f23_sensor_fault_entries", f"""with {_HEALTH_SQL} select seq, case when k = 21 then 'bad code!' else 'imu.' || (k % 4) end as code, case when k = 22 then 'odd' when k % 2 = 0 then 'recovered' else 'active' end as status, case when k = 21 then 'code' when k = 22 then 'status' when k = 23 then 'severity' end as error_rule
  from h, range(0, case when k = 5 then 33 else 1 end)""")
def f23e(spark, sf):
    return _health(spark, sf)[1].select("seq", "code", "status", "error_rule")


@query("f24_connectivity", f"""with {sql.POINTS} select seq, case when k = 1 then 'phase' when k = 2 then 'verdict' when k = 3 then 'rssi_dbm_required' when k = 4 then 'rssi_dbm_range' when value > 200 then 'latency_ms_range' end as error_rule from points""")
def f24(spark, sf):
    k = F.col("k")
    p = points(spark, sf).select("seq", F.when(k == 1, "during").otherwise("before").alias("phase"), F.when(k == 2, "maybe").otherwise("pass").alias("verdict"), F.when(k == 3, None).when(k == 4, 5.0).otherwise(-50.0).alias("rssi_dbm"), F.col("value").alias("latency_ms"))
    return va.validate_connectivity(p, {"rssi_dbm": (-120.0, 0.0), "latency_ms": (0.0, 200.0)}).select("seq", "error_rule")


@query("f25_safe_tabular", r"""select doc_id, case when regexp_matches(ltrim(t, E' \t\r\n'), '^[=+@-]') then '''' || t else t end as t from (
  select doc_id, case doc_id % 6 when 0 then '=' when 1 then '  -' when 2 then '@' when 3 then '' when 4 then E'\t+' else 'x=' end || text as t from documents)""")
def f25(spark, sf):
    m = F.col("doc_id") % 6
    lead = F.when(m == 0, "=").when(m == 1, "  -").when(m == 2, "@").when(m == 3, "").when(m == 4, "\t+").otherwise("x=")
    return va.safe_tabular(table(spark, sf, "documents").select("doc_id", F.concat(lead, "text").alias("t")))


@query("f26_exclude_demo", f"with {sql.POINTS} select seq from points where not (k % 2 = 0 and event_type = 'view')")
def f26(spark, sf):
    return va.exclude_demo(points(spark, sf).withColumn("syn", F.col("k") % 2 == 0), "syn", "event_type", "view").select("seq")


@query("f28_validate_session", f"""with {sql.WINDOWS}, s as (select n_nationkey + cast(n_nationkey >= 9 as int) as session, n_nationkey as dev, 1704067200000000 + n_nationkey * 3600000000 as s0, case when n_nationkey % 7 = 1 then 8 else 6 end as h, case when n_nationkey % 7 = 2 then '' else 'ok' end as prov, case when n_nationkey % 7 = 3 then 'odd' else 'pending' end as rev from nation)
  select ordinal, case when s.session is null then 'unknown_session' when h > 6 or prov = '' then 'metadata' when rev = 'odd' then 'review' when w.k % 10 = 0 then 'scope' when not (captured_us >= s0 - 1 and captured_us + 640000 <= s0 + h * 3600000000 + 1) then 'outside_interval' end as error_rule from windows w left join s on s.session = w.device""")
def f28(spark, sf):
    w = windows(spark, sf).select("ordinal", F.col("device").alias("session"), F.when(F.col("k") % 10 == 0, -1).otherwise(F.col("device")).alias("device"), "captured_us")
    n = F.col("n_nationkey").cast("long")
    start = F.lit(1704067200000000) + n * 3_600_000_000
    own = n + (n >= 9).cast("long")  # device 9 has no session
    s = table(spark, sf, "nation").select(
        own.alias("session"), own.alias("s_device"), start.alias("start_us"), (start + F.when(n % 7 == 1, 8).otherwise(6) * F.lit(3_600_000_000)).alias("end_us"), F.when(n % 7 == 2, "").otherwise("ok").alias("provenance"), F.lit(5).alias("max_missing"),
        F.lit(5).alias("max_invalid"), F.lit(10.0).alias("min_valid_sec"), F.when(n % 7 == 3, "odd").otherwise("pending").alias("review"), F.lit("").alias("reviewer"))
    return va.validate_session(w, s).select("ordinal", "error_rule")


# ------------------------------------------------------------------ sources and sinks

@query("s01_telemetry_lines", f"""with {sql.POINTS} select seq, case when k = 1 then 'INVALID_JSON' when k = 2 then 'MISSING_KEY' when k = 3 then 'INVALID_NUMBER' when k = 4 then 'RAW_ONLY_FIELD' when k = 5 then 'INVALID_BOOLEAN' end as error_code,
  case when k not in (1, 3) then case when k % 2 = 0 then round(value, 6) else round(value + 1, 6) end end as vibration, case when k = 1 then null when k % 3 = 0 then 'cond' else 'lab' end as known from points""")
def s01(spark, sf):
    k = F.col("k")
    key = F.when(k % 2 == 0, "vibration_rms_raw").otherwise("vibrationRmsRaw")
    val = F.when(k % 2 == 0, F.col("value")).otherwise(F.col("value") + 1)
    j = F.concat(F.lit('{"timestamp":"2024-01-01T00:00:00Z"'), F.when(k == 2, "").otherwise(F.concat(F.lit(',"sequence":"'), F.col("seq").cast("string"), F.lit('"'))), F.lit(',"device_id":"d1","'), key, F.lit('":'),
                 F.when(k == 3, '"abc"').otherwise(val.cast("string")), F.when(k == 4, ',"acousticDb":3').otherwise(',"acoustic_db":""'), F.when(k % 3 == 0, ',"known_condition":"cond"').otherwise(',"knownVibrationLabel":"lab"'),
                 F.lit(',"is_synthetic":'), F.when(k == 5, "1").when(k % 2 == 0, '"True"').otherwise("false"), F.when(k == 1, "").otherwise("}"))
    r = rd.parse_telemetry_lines(points(spark, sf).select("seq", j.alias("line")), "line")
    return r.select("seq", "error_code", F.round("vibration_rms_raw", 6).alias("vibration"), F.col("known_vibration_label").alias("known"))


@query("s02_handoff_rows", f"""with {sql.POINTS} select seq, case when k = 1 then 'SCENARIO' when k = 2 then 'NOT_SYNTHETIC' when k = 3 then 'INVALID_VIBRATION_RMS_RAW' when k = 4 then 'INVALID_RPM' when k = 5 then 'INVALID_VIBRATION_PEAK_HZ' end as error_code from points""")
def s02(spark, sf):
    k = F.col("k")
    p = points(spark, sf).select("seq", *[F.lit("x").alias(c) for c in rd.HANDOFF_COLUMNS if c not in ("rpm", "vibration_rms_raw", "vibration_peak_hz", "acoustic_rms_raw", "acoustic_peak_hz", "scenario_label", "is_synthetic")],
                                 F.when(k == 4, "inf").otherwise("").alias("rpm"), F.when(k == 3, "").otherwise(F.col("value").cast("string")).alias("vibration_rms_raw"), F.when(k == 5, "true").otherwise("10").alias("vibration_peak_hz"),
                                 F.lit("").alias("acoustic_rms_raw"), F.lit("1.0").alias("acoustic_peak_hz"), F.when(k == 1, "odd").otherwise("normal").alias("scenario_label"), F.when(k == 2, "False").otherwise("True").alias("is_synthetic"))
    return rd.check_handoff(p).select("seq", "error_code")


@query("s03_window_archive", f"""with {sql.POINTS} select seq, case when k % 6 = 1 or k % 6 = 2 or k % 6 = 3 or k % 6 = 4 then 'INVALID_JSON' end as error_code from points""")
def s03(spark, sf):
    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return rd.parse_window_archive(e.select(F.col("event_id").alias("seq"), F.expr(_JSON).alias("line")), "line").select("seq", "error_code")


@query("s04_waveform_clock", f"""with {sql.VECTORS}, r as (select stream, count(*) * 64 as samples from vectors group by stream) select stream, samples, case when stream = 3 then 'CLOCK_OFF_GRID' when stream in (4, 5) then 'CLOCK_NOT_MONOTONE' end as error_code from r""")
def s04(spark, sf):
    from ..plans.scan import numbered
    v = vectors(spark, sf)
    n = numbered(v, ["stream"], ["vec_id"], declared_split("vec_id"), "n")
    s = n.select("stream", F.posexplode("v").alias("i", "x"), "n").select("stream", ((F.col("n") - 1) * 64 + F.col("i")).alias("pos"))
    # stream 5: two samples exchanged
    swapped = F.when(F.col("pos") == 200, 201).when(F.col("pos") == 201, 200).otherwise(F.col("pos")) / 12800.0
    t = F.when(F.col("stream") == 5, swapped).when((F.col("stream") == 4) & (F.col("pos") == 100), 99 / 12800.0).when((F.col("stream") == 3) & (F.col("pos") > 50), (F.col("pos") + 1) / 12800.0).otherwise(F.col("pos") / 12800.0)
    return rd.check_clock(s.select("stream", "pos", t.alias("t")), "stream", "t", ["pos"], F.floor(F.col("pos") / 4096).cast("long"), minimum=640).select("stream", "samples", "error_code")


@query("s05_recording_metadata", """select p_partkey, case p_partkey % 5 when 0 then 'bend' when 1 then 'health' end as label, case when p_partkey % 5 < 2 then 'speed' end as mode, case when p_partkey % 5 < 2 then p_size end as load_nm, case when p_partkey % 5 < 2 then 3000 end as speed_rpm,
  case when p_partkey % 5 < 2 then 'speed_' || p_size || 'Nm_3000rpm' end as condition, case p_partkey % 5 when 2 then 'UNREVIEWED_LABEL' when 3 then 'UNKNOWN_NAME' when 4 then 'SKIPPED' end as error_code from part""")
def s05(spark, sf):
    m = F.col("p_partkey") % 5
    name = F.concat(F.lit("a/"), F.when(m == 0, "Bend").when(m == 1, "health").when(m == 2, "melted").when(m == 4, "._health").otherwise("x"), F.when(m == 3, "").otherwise("_speed_circulation_"), F.col("p_size").cast("string"), F.lit("Nm_3000rpm.csv"))
    return rd.recording_metadata(table(spark, sf, "part").select("p_partkey", name.alias("path")), "path").drop("path")


@query("s06_wav")
def s06(spark, sf):
    """Each vector written as a 16-bit WAV in the task and read back through the decoder."""
    import io
    import wave as wv

    import numpy as np
    import pandas as pd

    def pack(batches):
        for pdf in batches:
            out = []
            for i, v in zip(pdf["vec_id"], pdf["v"]):
                b = io.BytesIO()
                with wv.open(b, "wb") as w:
                    w.setnchannels(1), w.setsampwidth(2), w.setframerate(16000)
                    w.writeframes(np.clip(np.rint(np.asarray(v) * 32767), -32768, 32767).astype("<i2").tobytes())
                out.append((str(i), b.getvalue()))
            yield pd.DataFrame(out, columns=["path", "content"])
    files = vectors(spark, sf).select("vec_id", "v").mapInPandas(pack, "path string, content binary")
    d = rd.decode_wav(files, "path", "content")
    return d.select("path", "sample_rate", F.size("signal").alias("samples"), F.round(F.aggregate("signal", F.lit(0.0), lambda a, x: a + x * x), 3).alias("energy"))


@query("s07_recording_dim", """with d(no, label, hp, rpm) as (values (97, 'NORMAL', 0, 1797), (98, 'NORMAL', 1, 1772), (105, 'BEARING_FAULT_INNER', 0, 1797), (237, 'BEARING_FAULT_OUTER', 3, 1730), (186, 'BEARING_FAULT_BALL', 1, 1772))
  select c_custkey, label, hp as load_hp, cast(coalesce(case when c_custkey % 2 = 0 then 1500.0 end, rpm) as double) as effective_rpm from customer left join d on no = [97, 98, 105, 237, 186, 5][c_custkey % 6 + 1]""")
def s07(spark, sf):
    no = F.element_at(F.array(*[F.lit(x) for x in (97, 98, 105, 237, 186, 5)]), (F.col("c_custkey") % 6 + 1).cast("int"))
    c = table(spark, sf, "customer").select("c_custkey", no.alias("no"), F.when(F.col("c_custkey") % 2 == 0, 1500.0).alias("rpm"))
    return rd.with_recording_dim(c, "no", "rpm").select("c_custkey", "label", "load_hp", "effective_rpm")


@query("s08_decode_raw_windows", f"""with {sql.VECTORS}, c as (select vec_id, list_transform(v[1:63], lambda x: cast(round_even(x * 8000, 0) as bigint)) as c from vectors), s as (select *, vec_id % 10 as m, list_max(c) > 4095 or list_min(c) < -4096 as big from c)
  select vec_id, case when m = 1 then 'LENGTH' when m = 2 then 'NOT_CANONICAL' when m = 3 then null when big then 'OUT_OF_RANGE' end as error_code, cast(case when m in (1, 2, 3) or big then null else list_sum(list_transform(range(0, 21), lambda i: c[i * 3 + 1])) end as double) as sum_x,
  cast(case when m in (1, 2, 3) or big then null else list_sum(list_transform(range(0, 21), lambda i: c[i * 3 + 3])) end as double) as sum_z from s""")
def s08(spark, sf):
    m = F.col("vec_id") % 10
    c = vectors(spark, sf).select("vec_id", F.transform(F.slice("v", 1, 63), lambda x: F.rint(x * 8000).cast("long")).alias("c"))
    text = rd.encode_int16(F.col("c"))
    bent = F.when(m == 1, F.substring(text, 1, 100)).when(m == 2, F.concat(F.lit("*"), F.substring(text, 2, 400))).when(m == 3, None).otherwise(text)
    d = rd.decode_raw_windows(c.select("vec_id", bent.alias("samples"), F.lit(21).alias("n"), F.when(m == 3, "sample_gap").otherwise("valid").alias("quality")), "samples", "n", "quality")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return d.select("vec_id", "error_code", total("x").alias("sum_x"), total("z").alias("sum_z"))


@query("s09_decode_frames", """select vec_id, null as error_code, round(list_sum(list_transform(embedding, lambda x: cast(x as double))), 6) + 0.0 as total from embeddings""")
def s09(spark, sf):
    import base64

    import numpy as np
    import pandas as pd

    @F.pandas_udf("string")
    def enc(v: pd.Series) -> pd.Series:
        return v.map(lambda a: base64.b64encode(np.asarray(a, "<f4").tobytes()).decode())
    d = rd.decode_frames(vectors(spark, sf).select("vec_id", enc("v").alias("samples"), F.lit(64).alias("n")), "samples", "n")
    return d.select("vec_id", "error_code", r6(F.aggregate("signal", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query("s10_topic_messages", f"""with {sql.POINTS} select seq, case when k = 1 then null else 'U-' || asset end as device, case when k = 1 then 'INVALID_MQTT_TOPIC' when k in (2, 6) then 'INVALID_JSON' when k = 3 then 'INVALID_JSON_BODY' when k = 4 then 'DEVICE_MAPPING_MISMATCH' end as error_code from points""")
def s10(spark, sf):
    k = F.col("k")
    a = F.col("asset").cast("string")
    m = points(spark, sf).select("seq", F.concat(F.lit("/devices/u-"), a, F.when(k == 1, "/state").otherwise("/telemetry")).alias("topic"),
                                 F.when(k == 2, "{").when(k == 3, "[1]").when(k == 4, '{"deviceId":"other"}').when(k == 6, F.concat(F.lit('{"deviceId":"u-'), a, F.lit('","x":NaN}'))).otherwise(F.concat(F.lit('{"deviceId":" u-'), a, F.lit('"}'))).alias("value"))
    return rd.parse_topic_messages(m, "topic", "value").select("seq", "device", "error_code")


@query("s11_telemetry_export", f"""with {sql.POINTS} select t_us as "timestamp", seq as sequence, 'S' as site_id, case when asset % 10 = 0 then '''=' || asset else 'A' || asset end as asset_id, asset as device_id, value as vibration_rms_raw, null as vibration_peak_hz, null as acoustic_rms_raw, null as acoustic_peak_hz, null as rpm, score as anomaly_score, event_type as anomaly_status from points""")
def s11(spark, sf):
    none = F.lit(None).cast("double")
    p = points(spark, sf).select(F.col("t_us").alias("timestamp"), F.col("seq").alias("sequence"), F.lit("S").alias("site_id"), F.when(F.col("asset") % 10 == 0, F.concat(F.lit("="), "asset")).otherwise(F.concat(F.lit("A"), "asset")).alias("asset_id"),
                                 F.col("asset").alias("device_id"), F.col("value").alias("vibration_rms_raw"), none.alias("vibration_peak_hz"), none.alias("acoustic_rms_raw"), none.alias("acoustic_peak_hz"), none.alias("rpm"),
                                 F.col("score").alias("anomaly_score"), F.col("event_type").alias("anomaly_status"))
    return sk.telemetry_export(p)


@query("s12_measurement_export", f"""with {sql.SNAPSHOTS} select vec_id as device_id, case when vec_id % 8 > 0 then round(x[1], 6) + 0.0 end as cf_a_1, case when vec_id % 8 > 0 then round(x[9], 6) + 0.0 end as ku_a_3 from snapshots where stream = 3""")
def s12(spark, sf):
    """All measurements of one asset, from the first to the last one captured."""
    s = snapshots(spark, sf).select(F.lit("S").alias("site_id"), F.col("stream").cast("string").alias("asset_id"), F.col("vec_id").alias("device_id"), F.col("vec_id").alias("ordinal"), (F.col("vec_id") * 25_000_000).alias("captured_us"),
                                    F.when(F.col("vec_id") % 8 > 0, "valid").otherwise("invalid").alias("quality"), *[F.col("x")[i].alias(n) for i, n in enumerate(va.FEATURES9)],
                                    *[F.lit(None).cast("string").alias(c) for c in ("sensor_id", "measured_at", "received_at", "profile_id", "reason", "vibration_rms_g", "dominant_frequency_hz", "rms_status", "frequency_status")])
    ends = s.agg(F.min("captured_us").alias("low"), F.max("captured_us").alias("high")).first()
    e = sk.export_measurements(s, "S", "3", ends.low or 0, ends.high or 0)
    return e.select("device_id", r6("cf_a_1").alias("cf_a_1"), r6("ku_a_3").alias("ku_a_3"))


@query("s15_feature_table", """select 'vibration' as modality, p_type as label, count(*) as rows from part group by p_type union all select 'acoustic', c_mktsegment, count(*) from customer group by c_mktsegment""")
def s15(spark, sf):
    v = table(spark, sf, "part").select(F.col("p_type").alias("label"), F.col("p_size").alias("vib_feature"))
    a = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("label"), F.col("c_acctbal").alias("ac_feature"))
    return rd.build_feature_table(v, a, "label")[1]


@query("s16_frame_rows", f"""with {sql.VECTORS} select vec_id, round(sqrt(list_avg(list_transform(v[1:32], lambda x: x * x))), 6) as a_rms, round(list_max(list_transform(v[33:64], lambda x: abs(x))), 6) as b_peak, 'unlabeled' as label_status, false as training_eligible, 64 as digest_len from vectors""")
def s16(spark, sf):
    v = vectors(spark, sf).select("vec_id", F.slice("v", 1, 32).alias("a"), F.slice("v", 33, 32).alias("b"))
    r = rd.frames_to_feature_rows(v, "vec_id", {"a": ("a", 32), "b": ("b", 16)})
    return r.select("vec_id", F.round("a_rms", 6).alias("a_rms"), F.round("b_peak", 6).alias("b_peak"), "label_status", "training_eligible", F.length("source_digest").alias("digest_len"))


@query("c09_feature_digest")
def c09(spark, sf):
    return snapshots(spark, sf).select("vec_id", feature_digest(F.col("x")).alias("digest"))


@query("u01_union_domains", f"with {sql.POINTS} select event_type, count(*) as rows from (select * from points where k % 2 = 0 union all select * from points where event_type = 'view') group by event_type")
def u01(spark, sf):
    p = points(spark, sf)
    return p.filter("k % 2 = 0").unionByName(p.filter("event_type = 'view'")).groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"))


@query("u04_key_sets", """select s_suppkey as id, 'only_supplier' as side from supplier where s_suppkey not in (select user_id from events) union all select id, 'shared' from (select s_suppkey as id from supplier intersect select user_id from events)""")
def u04(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))
    e = table(spark, sf, "events").select(F.col("user_id").alias("id"))
    return s.subtract(e).withColumn("side", F.lit("only_supplier")).unionByName(s.intersect(e).withColumn("side", F.lit("shared")))


@query("s13_export_dataset", f"""with {sql.POINTS}, r as (select seq, event_type, score, ['train', 'validation', 'test'][asset % 3 + 1] as dataset_split from points), m as (select dataset_split, count(*) as n from r group by dataset_split)
  select r.*, m.n as manifest_rows from r join m using (dataset_split)""")
def s13(spark, sf):
    """Rows by split and their manifest, written and read back."""
    path = scratch(spark, "export")
    split = F.element_at(F.array(F.lit("train"), F.lit("validation"), F.lit("test")), (F.col("asset") % 3 + 1).cast("int"))
    rows = points(spark, sf).select("seq", "event_type", "score", split.alias("dataset_split"))
    sk.export_dataset(rows, rows.groupBy("dataset_split").agg(F.count(F.lit(1)).alias("manifest_rows")), path)
    return spark.read.parquet(f"{path}/rows").join(spark.read.parquet(f"{path}/manifest"), "dataset_split")


@query("s14_publish_version", """select c_custkey, c_name, c_acctbal, 'published reused conflict published reused' as outcomes from customer where c_nationkey < 20""")
def s14(spark, sf):
    """A version, the same again in another order, other content under its id, a second version, and the first as it was."""
    root = scratch(spark, "publish")
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    a, b, outcomes = c.where("c_nationkey < 20"), c.where("c_nationkey >= 20"), []
    for version, rows in (("A", a), ("A", a.repartition(3)), ("A", b), ("B", b), ("A", a)):
        try:
            outcomes.append(sk.publish_version(rows, version, root, c.columns, len(outcomes)))
        except ValueError:
            outcomes.append("conflict")
    return sk.read_current(spark, root).select("c_custkey", "c_name", "c_acctbal", F.lit(" ".join(outcomes)).alias("outcomes"))
