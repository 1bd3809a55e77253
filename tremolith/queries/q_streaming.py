"""Streaming runs over the events file, drained and compared with their batch meaning."""

from pyspark.sql import functions as F

from ..functions.numeric import micros
from ..plans.registry import query
from ..plans.scan import declared_split, numbered
from ..sources.tables import points, table
from ..streaming import pipeline as pl, streams as st
from . import q_rules, sql


def _stream(spark, sf):
    schema = table(spark, sf, "events").schema
    e = st.read_files(spark, sf, "events.parquet", schema)
    t = micros("ts")
    return e.select(F.col("user_id").alias("asset"), F.col("event_id").alias("seq"), t.alias("t_us"), F.timestamp_micros(t).alias("ts"),
                    F.when(F.col("event_type") != "signup", F.least("value", F.lit(100.0))).alias("score"), (F.col("event_type") == "error").alias("fault"),
                    F.get_json_object("props", "$.k").cast("long").alias("k"), "event_type", "value")


@query("t01_stream_lifecycle", f"with {sql.LIFECYCLE} select * from lifecycle")
def t01(spark, sf):
    st.use_rocksdb(spark)
    log = st.drain(st.stream_lifecycle(_stream(spark, sf).select("asset", "t_us", "seq", "score", "fault")), st.scratch(spark, "lifecycle"))
    return st.latest_events(log).select("asset", "event_no", "start_us", "end_us", "end_reason", "max_score", "samples", "merge_count", "last_score")


@query("t03_stream_dedupe", f"with {sql.POINTS} select asset, k, count(*) as rows from (select distinct asset, k from points) group by asset, k")
def t03(spark, sf):
    st.use_rocksdb(spark)
    d = st.stream_dedupe(_stream(spark, sf).select("asset", "k", "ts"), ["asset", "k"], "ts", "60 days")
    return st.drain(d, st.scratch(spark, "dedupe")).groupBy("asset", "k").agg(F.count(F.lit(1)).alias("rows"))


@query("t04_stream_buckets", f"""with {sql.POINTS}, b as (select asset % 10 as device, (t_us - 1000) // 3600000000 * 3600000000 as bucket_us, k from points)
  select device, bucket_us, count(*) as rows, cast(sum(k) as bigint) as total from b group by device, bucket_us""")
def t04(spark, sf):
    st.use_rocksdb(spark)
    s = _stream(spark, sf).withColumn("device", F.col("asset") % 10)
    make = lambda d: st.stream_buckets(d, ["device"], "ts", "1 hour", "10 minutes", F.count(F.lit(1)).alias("rows"), F.sum("k").alias("total"))
    return st.drain_to_end(s, make, st.scratch(spark, "buckets"), "ts")


@query("t05_stream_persistence", f"""with {sql.FIRST_WINDOWS}, v as (select device, boot, idx, quality, cast(value > 60 as int) as hit from fw), ok as (
  select *, idx - row_number() over (partition by device, boot order by idx) as isl from v where quality = 'valid'), p as (
  select device, boot, idx, case when count(*) over w = 3 then cast(sum(hit) over w >= 2 as int) else -1 end as d from ok window w as (partition by device, boot, isl order by idx rows 2 preceding))
  select device, boot, idx, coalesce(d, -1) as decision from v left join p using (device, boot, idx)""")
def t05(spark, sf):
    from .q_events import first_windows
    st.use_rocksdb(spark)
    root = st.scratch(spark, "persistence")
    w = first_windows(spark, sf).select("device", "boot", "idx", (F.col("quality") == "valid").alias("ok"), (F.col("value") > 60).alias("hit"))
    w.write.parquet(f"{root}/in")
    s = spark.readStream.schema(w.schema).parquet(f"{root}/in")
    return st.drain(st.stream_persistence(s, 3, 2), root + "/run")


@query("t06_stream_sessions", f"""with {sql.POINTS}, f as (select *, t_us - lag(t_us) over (partition by asset order by t_us) >= 7200000000 as brk from points), g as (
  select *, sum(case when brk then 1 else 0 end) over (partition by asset order by t_us) as sid from f), a as (select asset, min(t_us) as start_us, max(t_us) as end_us, count(*) as rows from g group by asset, sid)
  select asset, start_us, rows from a""")
def t06(spark, sf):
    st.use_rocksdb(spark)
    make = lambda d: st.stream_sessions(d, ["asset"], "ts", "2 hours", "10 minutes", F.count(F.lit(1)).alias("rows"))
    return st.drain_to_end(_stream(spark, sf), make, st.scratch(spark, "sessions"), "ts")


@query("t10_stream_liveness", f"""with {sql.POINTS}, n as (select asset, t_us // 1000 as ms, lead(t_us) over (partition by asset order by t_us) // 1000 as nxt, max(t_us) over () // 1000 as wm from points), g as (select * from n where coalesce(nxt, wm) - ms > 36000000)
  select asset, 'device_offline' as event_type, ms + 36000000 as at_ms from g union all select asset, 'device_recovered', nxt from g where nxt is not null""")
def t10(spark, sf):
    st.use_rocksdb(spark)
    return st.drain(st.stream_liveness(_stream(spark, sf), 36_000), st.scratch(spark, "liveness"))


@query("t12_stream_multi_sink", f"with {sql.POINTS} select case when fault then 'quarantine' else 'good' end as sink, count(*) as rows, min(seq) as first_seq from points group by 1")
def t12(spark, sf):
    root = st.scratch(spark, "sinks")
    write = st.idempotent_sink(f"{root}/tables", lambda b: {"good": b.filter("not fault"), "quarantine": b.filter("fault")})
    s = _stream(spark, sf).select("asset", "seq", "t_us", "fault")
    st.drain_batches(s, root, write, "append")
    read = lambda n: spark.read.parquet(f"{root}/tables/{n}").select(F.lit(n).alias("sink"), "seq")
    return read("good").unionByName(read("quarantine")).groupBy("sink").agg(F.count(F.lit(1)).alias("rows"), F.min("seq").alias("first_seq"))


@query("g10_incidents_keyed_state", f"with recursive {sql.incidents('site::varchar', 'value > 15', 'n * 650000')} select device, kind, count(*) as rows from incident_log group by device, kind")
def g10_keyed(spark, sf):
    """Whole window stream per device with changing targets."""
    from .q_events import first_windows
    st.use_rocksdb(spark)
    root = st.scratch(spark, "incidents")
    w = first_windows(spark, sf)
    n = numbered(w, ["device"], ["captured_us", "ordinal"], declared_split("captured_us"), "place")
    w = n.select("device", F.col("captured_us").alias("t_us"), F.col("place").alias("idx"), (F.col("place") * 650_000).alias("uptime_us"),
                 F.col("site").cast("string").alias("target"), (F.col("quality") == "valid").alias("ok"), (F.col("value") > 15).alias("hit"))
    w.write.parquet(f"{root}/in")
    s = spark.readStream.schema(w.schema).parquet(f"{root}/in")
    return st.drain(st.stream_incidents(s), root + "/run").groupBy("device", "kind").agg(F.count(F.lit(1)).alias("rows"))


# ------------------------------------------------------------------ the whole pipeline

_SPLIT = q_rules._T0 + 10 * q_rules._DAY  # no second rule starts before


def _send(df, root, name, run):
    """Rows as one micro-batch of a stream, of as many files as they have partitions; ``run`` takes it in and stops."""
    df.write.mode("append").parquet(f"{root}/{name}")
    run()


def _ruled_points(spark, sf):
    p = q_rules.model_points(spark, sf)
    return p.select(F.col("asset").cast("string").alias("asset"), F.lit("live").alias("lane"), F.concat(F.lit("D"), F.col("asset").cast("string")).alias("device"), "seq", "t_us", F.col("seq").alias("arrival"),
                    "score", "fault", "model", F.lit("accepted").alias("disposition"))


_EVENTS = ["asset", "event_no", "start_us", "end_us", "end_reason", "max_score", "max_model", "samples", "merge_count", "last_score", "rule_version", "model", "trigger_seq", "trigger_score"]


def _source(spark, root, name, schema):
    return spark.readStream.schema(schema).parquet(f"{root}/{name}")


def _of(updates, *more):
    return pl.current_events(updates).select(F.col("asset").cast("long").alias("asset"), *more, *_EVENTS[1:])


@query("t08_stream_rule_change", f"with {q_rules.LIFECYCLE} select {', '.join(_EVENTS)} from ruled")
def t08(spark, sf):
    """Second versions of the rules arrive on their own stream with the third of four micro-batches; the first ones are the initial state."""
    st.use_rocksdb(spark)
    root = st.scratch(spark, "rule-change")
    p, rules = _ruled_points(spark, sf), q_rules.rule_table(spark, sf)
    early = F.col("t_us") < _SPLIT
    rules.limit(0).write.parquet(f"{root}/rules")
    write = st.idempotent_sink(f"{root}/tables", pl.log_tables)
    run = lambda: st.drain_batches(pl.lifecycle_stream(_source(spark, root, "points", p.schema), _source(spark, root, "rules", rules.schema), rules.where("version = 1")), root, write, "append")
    for part, middle in ((early, _SPLIT - 5 * q_rules._DAY), (~early, _SPLIT + 10 * q_rules._DAY)):
        if part is not early:
            rules.where("version = 2").write.mode("append").parquet(f"{root}/rules")
        for late in (False, True):
            _send(p.where(part & ((F.col("t_us") > middle) == late)), root, "points", run)
    return _of(spark.read.parquet(f"{root}/tables/updates"))


_NOW_US, _MEAN, _STD = 1_706_700_000_000_000, 20.0, 30.0

# what is left of the lines after normalising: whole seconds, no sign-up rows, sequences from one, scored by range
_SCORED = f"""points as (
  select user_id as asset, event_id as seq, epoch_us(ts) // 1000000 * 1000000 as t_us, event_type = 'error' as fault, cast(json_extract_string(props, '$.k') as bigint) as k,
         cast(round_even(least(100.0, greatest(0.0, abs(value - {_MEAN}) / {_STD} - 1.0) / 1.0 * 100.0), 0) as double) as score
  from events where event_type <> 'signup' and event_id >= 1)"""


def telemetry_lines(spark, sf):
    """A telemetry line of each event; sign-up rows lack a valid amplitude.  Some are sent again as they were, some with
    another amplitude, both after all others of their file."""
    p = q_rules.model_points(spark, sf).withColumn("lane", F.lit("live"))
    twice = p.where("k % 10 in (3, 4)").withColumns({"value": F.when(F.col("k") % 10 == 4, F.col("value") + 1).otherwise(F.col("value")), "again": F.lit(1)})
    p = p.withColumn("again", F.lit(0)).unionByName(twice)
    text = lambda c: F.concat(F.lit('"'), c.cast("string"), F.lit('"'))
    stamp = F.date_format(F.timestamp_seconds(F.floor(F.col("t_us") / 1_000_000)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    payload = F.concat(F.lit('{"timestamp":'), text(stamp), F.lit(',"sequence":'), F.col("seq").cast("string"), F.lit(',"siteId":"s1","assetId":'), text(F.col("asset")), F.lit(',"deviceId":'),
                       text(F.concat(F.lit("D"), F.col("asset").cast("string"))), F.lit(',"vibrationRmsRaw":'), F.when(F.col("event_type") == "signup", "-1").otherwise(F.col("value").cast("string")),
                       F.lit(',"vibrationPeakHz":50,"vibrationRmsMmS":null,"acousticDb":null,"scenarioLabel":null,"isSynthetic":false}'))
    return p.select((F.col("seq") + F.col("again") * 1_000_000_000).alias("arrival"), payload.alias("payload"), "lane", "fault", "model", "t_us")


@query("t01_stream_pipeline", f"""with {_SCORED}{q_rules.OVER_POINTS} select {', '.join(_EVENTS)} from ruled""")
def t01_pipeline(spark, sf):
    """Lines to events in one query: four micro-batches, a restart after each, repeated and contradicting lines, new rules."""
    st.use_rocksdb(spark)
    root, updates = _pipeline(spark, sf)
    return _of(updates["updates"])


def _pipeline(spark, sf):
    root = st.scratch(spark, "pipeline")
    lines, rules = telemetry_lines(spark, sf), q_rules.rule_table(spark, sf)
    early, keep = F.col("t_us") < _SPLIT, [c for c in lines.columns if c != "t_us"]
    rules.limit(0).write.parquet(f"{root}/rules")
    log = lambda: pl.telemetry_stream(_source(spark, root, "lines", lines.select(*keep).schema), F.lit(_NOW_US), _MEAN, _STD, 1.0,
                                      _source(spark, root, "rules", rules.schema), rules.where("version = 1"), 40)
    write = st.idempotent_sink(f"{root}/tables", pl.log_tables)
    for first in (True, False):
        if not first:
            rules.where("version = 2").write.mode("append").parquet(f"{root}/rules")
        part = lines.where(early == first)
        middle = F.col("t_us") > _SPLIT + (-5 if first else 10) * q_rules._DAY
        for late in (False, True):
            _send(part.where(middle == late).select(*keep), root, "lines", lambda: st.drain_batches(log(), root, write, "append"))
    return root, {n: spark.read.parquet(f"{root}/tables/{n}") for n in ("updates", "late", "repeated", "quarantine", "quiet")}


@query("t01_stream_pipeline_log", f"""with {sql.POINTS}, l as (
  select *, 0 as again from points union all select *, 1 from points where k % 10 in (3, 4)), q as (
  select *, case when event_type = 'signup' then 'vibration_rms' end as broken from l), j as (
  select case when seq < 1 then 'quarantined' when broken is not null then 'quarantined' when again = 1 and k % 10 = 3 then 'duplicate' when again = 1 then 'conflict' else 'point' end as kind,
         case when seq < 1 then 'sequence' else broken end as reason from q)
  select kind, reason, count(*) as rows from j group by kind, reason""")
def t01_log(spark, sf):
    """Every line has one log row: broken, repeated, contradicting, or a point."""
    st.use_rocksdb(spark)
    _, tables = _pipeline(spark, sf)
    rows = [t.select(F.when(F.col("kind").isin("quarantined", "duplicate", "conflict"), F.col("kind")).otherwise("point").alias("kind"), F.when(F.col("kind") == "quarantined", F.col("end_reason")).alias("reason"))
            for t in tables.values()]
    both = rows[0]
    for r in rows[1:]:
        both = both.unionByName(r)
    return both.groupBy("kind", "reason").agg(F.count(F.lit(1)).alias("rows"))


@query("t03_stream_conflicts", f"""with {sql.POINTS} select asset, seq, 0 as again, 'accepted' as disposition from points union all
  select asset, seq, 1, case when k % 10 = 3 then 'duplicate' else 'conflict' end from points where k % 10 in (3, 4) union all select asset, seq, 2, 'duplicate' from points where k % 10 = 4""")
def t03_conflicts(spark, sf):
    """Copies and contradictions in later micro-batches; a copy of the accepted content stays a duplicate after a conflict."""
    st.use_rocksdb(spark)
    root = st.scratch(spark, "conflicts")
    p = _ruled_points(spark, sf).join(points(spark, sf).select("seq", "k", F.col("value").alias("v")), "seq").withColumn("value", F.col("v"))
    again = lambda n, where, value: p.where(where).withColumns({"arrival": F.col("arrival") + n * 1_000_000_000, "value": value})
    names = [f.split()[0] for f in pl.POINT.split(", ")]
    run = lambda: st.drain(pl.dedupe_stream(_source(spark, root, "in", p.select(*names).schema), F.sha2(F.col("value").cast("string"), 256)), root + "/run")
    for part in (p, again(1, "k % 10 in (3, 4)", F.when(F.col("k") % 10 == 4, F.col("v") + 1).otherwise(F.col("v"))), again(2, "k % 10 = 4", F.col("v"))):
        _send(part.select(*names), root, "in", run)
    out = spark.read.schema(pl.SEEN).parquet(f"{root}/run/out")
    return out.select(F.col("asset").cast("long").alias("asset"), "seq", F.floor(F.col("arrival") / 1_000_000_000).cast("int").alias("again"), "disposition")


@query("t02_stream_late_output", f"""with {sql.POINTS}, f as (select *, case when k % 9 = 0 then 2 when t_us < {_SPLIT} then 0 else 1 end as file from points), m as (
  select asset, file, max((t_us, seq)) as top from f group by asset, file), b as (
  select f.*, (select max(top) from m where m.asset = f.asset and m.file < f.file) as before from f)
  select asset, seq, case when before is not null and (t_us, seq) <= before then 'late' else 'accepted' end as sink from b""")
def t02_late(spark, sf):
    """Late points in a table of their own, written in the same micro-batch as the others; together they are all points."""
    st.use_rocksdb(spark)
    root = st.scratch(spark, "late")
    p = _ruled_points(spark, sf).join(points(spark, sf).select("seq", "k"), "seq")
    write = st.idempotent_sink(f"{root}/tables", lambda b: {"late": b.where("kind = 'late'"), "accepted": b.where("kind <> 'late'")})
    log = lambda: pl.lifecycle_stream(_source(spark, root, "in", p.drop("k").schema), None, q_rules.rule_table(spark, sf).where("version = 1"))
    for part in (p.where(f"k % 9 <> 0 and t_us < {_SPLIT}"), p.where(f"k % 9 <> 0 and t_us >= {_SPLIT}"), p.where("k % 9 = 0")):
        _send(part.drop("k"), root, "in", lambda: st.drain_batches(log(), root, write, "append"))
    read = lambda n: spark.read.parquet(f"{root}/tables/{n}").select(F.col("asset").cast("long").alias("asset"), "seq", F.lit(n).alias("sink"))
    return read("late").unionByName(read("accepted"))


def _lane_sql(lane, where):
    return f"select '{lane}' as lane, * from (with {sql.POINTS.replace('from events)', f'from events where {where})')}{q_rules.OVER_POINTS} select {', '.join(_EVENTS)} from ruled)"


@query("t09_stream_lanes", _lane_sql("live", "true") + " union all " + _lane_sql("history", f"epoch_us(ts) < {_SPLIT}"))
def t09(spark, sf):
    """A back-fill of the first days on the history lane, sent after newer live points, neither moves nor meets live state."""
    st.use_rocksdb(spark)
    root = st.scratch(spark, "lanes")
    p = _ruled_points(spark, sf)
    write = st.idempotent_sink(f"{root}/tables", pl.log_tables)
    log = lambda: pl.lifecycle_stream(_source(spark, root, "in", p.schema), None, q_rules.rule_table(spark, sf), ("live", "history"))
    for part in (p, p.where(F.col("t_us") < _SPLIT).withColumn("lane", F.lit("history"))):
        _send(part, root, "in", lambda: st.drain_batches(log(), root, write, "append"))
    return _of(spark.read.parquet(f"{root}/tables/updates"), "lane")
