"""Join, label, split, search and alert queries."""

from pyspark.sql import functions as F

from ..functions.numeric import bucket, micros
from ..operators import alerts as al, datasets as ds, joins as jn, search as se
from ..plans.registry import query
from ..plans.scan import declared_split
from ..sources.tables import DAY_US, HOUR_US, points, table, windows
from . import sql
from .q_aggregates import evaluation, _EVAL_SQL
from .q_events import _NOW, first_windows

# purchases open [ts, ts + value minutes] for their asset
_SPANS_SQL = f"""{sql.POINTS}, spans as (select asset, seq as event_id, t_us as start_us, t_us + cast(value * 60000000 as bigint) as end_us, k % 2 = 0 as verified,
  ['bearing', 'needs_review', 'Imbalance', 'unknown-x'][k % 4 + 1] as label, case when k % 5 = 0 then 'click' end as source from points where event_type = 'purchase'), pts as (
  select asset, seq, t_us, event_type as source, score, value, k from points)"""


def spans(spark, sf):
    p = points(spark, sf).filter("event_type = 'purchase'")
    return p.select("asset", F.col("seq").alias("event_id"), F.col("t_us").alias("start_us"), (F.col("t_us") + (F.col("value") * 60_000_000).cast("long")).alias("end_us"),
                    (F.col("k") % 2 == 0).alias("verified"),
                    F.element_at(F.array(*[F.lit(x) for x in ("bearing", "needs_review", "Imbalance", "unknown-x")]), (F.col("k") % 4 + 1).cast("int")).alias("label"),
                    F.when(F.col("k") % 5 == 0, "click").alias("source"))


def pts(spark, sf):
    return points(spark, sf).select("asset", "seq", "t_us", F.col("event_type").alias("source"), "score", "value", "k")


_BEST = """best as (select p.*, s.event_id, s.label, s.verified, s.start_us as event_start_us from pts p left join spans s on s.asset = p.asset and p.t_us between s.start_us and s.end_us
  and (s.source is null or s.source = p.source) qualify row_number() over (partition by p.seq order by s.verified desc nulls last, s.start_us desc nulls last, s.event_id desc nulls last) = 1)"""


@query("j01_registry", f"""with {sql.POINTS}, t as (select seq, asset % 28 as site, asset, asset % 120 as device from points), n as (select n_nationkey as site from nation), a as (select c_custkey as asset, c_nationkey as site from customer),
  d as (select s_suppkey as device, s_nationkey as dsite, s_suppkey as dasset, case when s_acctbal > 0 then 'active' else 'paused' end as mapping from supplier)
  select seq, n.site is not null as site_known, a.asset is not null as asset_known, d.device is not null as device_known, mapping as d_mapping from t left join n using (site) left join a on a.asset = t.asset and a.site = t.site left join d using (device)""")
def j01(spark, sf):
    t = points(spark, sf).select("seq", (F.col("asset") % 28).alias("site"), "asset", (F.col("asset") % 120).alias("device"))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("site"))
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("asset"), F.col("c_nationkey").alias("site"))
    d = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("device"), F.col("s_nationkey").alias("site"), F.col("s_suppkey").alias("asset"),
                                            F.when(F.col("s_acctbal") > 0, "active").otherwise("paused").alias("mapping"), F.lit("registered").alias("certificate"))
    return jn.with_registry(t, n, a, d).select("seq", "site_known", "asset_known", "device_known", "d_mapping")


@query("j02_label_events", f"with {_SPANS_SQL}, {_BEST} select seq, event_id, label, verified, event_start_us from best")
def j02(spark, sf):
    return jn.label_events(pts(spark, sf), spans(spark, sf), ["asset"], "t_us", "seq").select("seq", "event_id", "label", "verified", "event_start_us")


@query("j03_event_context", f"""with {_SPANS_SQL} select s.event_id, count(*) as points, min(p.seq) as first_seq, max(p.seq) as last_seq, round(avg(p.score), 6) as mean_score
  from spans s join pts p on p.asset = s.asset and abs(p.t_us - s.start_us) <= 21600000000 group by s.event_id""")
def j03(spark, sf):
    c = jn.event_context(spans(spark, sf).drop("source"), pts(spark, sf), ["asset"], "start_us", "t_us", 21_600_000_000)
    return c.groupBy("event_id").agg(F.count(F.lit(1)).alias("points"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.round(F.avg("score"), 6).alias("mean_score"))


@query("j04_nearest_point", f"""with {_SPANS_SQL}, o as (select * from pts where source <> 'purchase') select s.event_id, o.seq as near_seq, o.t_us as near_t_us from spans s left join o on o.asset = s.asset and abs(o.t_us - s.start_us) <= 21600000000
  qualify row_number() over (partition by s.event_id order by abs(o.t_us - s.start_us), o.t_us, o.seq) = 1""")
def j04(spark, sf):
    other = pts(spark, sf).filter("source <> 'purchase'")
    return jn.nearest_point(spans(spark, sf).drop("source"), other, ["asset"], "event_id", "start_us", "t_us", ["t_us", "seq"], ["seq", "t_us"], 21_600_000_000).select(
        "event_id", "near_seq", "near_t_us")


@query("j05_install_as_of", f"""with {_SPANS_SQL}, h as (select asset, t_us, seq as version, k % 6 > 0 as active from points where event_type = 'view')
  select s.event_id, h.version, h.active from spans s asof left join h on h.asset = s.asset and s.start_us >= h.t_us""")
def j05(spark, sf):
    h = points(spark, sf).filter("event_type = 'view'").select("asset", "t_us", F.col("seq").alias("version"), (F.col("k") % 6 > 0).alias("active"))
    return jn.as_of(spans(spark, sf).drop("source"), h, ["asset"], "start_us", "t_us", ["version", "active"]).select("event_id", "version", "active")


@query("j06_applied_rule", f"""with {_SPANS_SQL}, e as (select event_id, asset, asset % 4 as version from spans), r as (select s_suppkey as asset, s_nationkey % 4 as version, s_acctbal as threshold from supplier)
  select event_id, e.version, r.threshold, r.asset is not null as rule_found from e left join r on r.asset = e.asset and r.version = e.version""")
def j06(spark, sf):
    e = spans(spark, sf).select("event_id", "asset", (F.col("asset") % 4).alias("version"))
    r = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("asset"), (F.col("s_nationkey") % 4).cast("long").alias("version"), F.col("s_acctbal").alias("threshold"))
    return jn.applied_rule(e, r, "asset", "version", ["threshold"]).select("event_id", "version", "threshold", "rule_found")


@query("j07_with_jobs", """select o_orderkey, o_orderstatus, count(l_orderkey) as lines, round(sum(l_quantity), 6) as qty from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey, o_orderstatus""")
def j07(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum("l_quantity"), 6).alias("qty"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return jn.with_jobs(o, lines, ["o_orderkey"]).fillna(0, ["lines"])


@query("j08_with_previous", f"with {sql.FIRST_WINDOWS} select a.device, a.boot, a.idx, b.quality as prev_quality, b.ordinal as prev_ordinal from fw a left join fw b on b.device = a.device and b.boot = a.boot and b.idx = a.idx - 1")
def j08(spark, sf):
    return jn.with_previous(first_windows(spark, sf), ["device", "boot"], "idx", ["quality", "ordinal"]).select("device", "boot", "idx", "prev_quality", "prev_ordinal")


_MAP_SQL = """m(src, target) as (values ('bearing', 'BRG'), ('IMBALANCE', 'imb'), ('5-low', 'low'), ('2-high', 'HIGH')), tx(code) as (values ('UNKNOWN-X'), ('1-URGENT'), ('LOW'))"""


def _mapping(spark):
    return (spark.createDataFrame([("bearing", "BRG"), ("IMBALANCE", "imb"), ("5-low", "low"), ("2-high", "HIGH")], "source_label string, target string"),
            spark.createDataFrame([("UNKNOWN-X",), ("1-URGENT",), ("LOW",)], "code string"))


@query("j11_map_labels", f"""with {_MAP_SQL} select o_orderkey, coalesce(upper(m.target), tx.code) as target_label from orders left join m on lower(m.src) = lower(trim(o_orderpriority)) left join tx on tx.code = upper(trim(o_orderpriority))""")
def j11(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return jn.map_labels(o, "o_orderpriority", *_mapping(spark)).select("o_orderkey", "target_label")


@query("j13_pair_cyclic", """with l as (select c_custkey, c_nationkey % 5 as grp, row_number() over (partition by c_nationkey % 5 order by sha256('42:' || c_custkey)) as i from customer), r as (
  select s_suppkey, s_nationkey % 5 as grp, row_number() over (partition by s_nationkey % 5 order by sha256('42:' || s_suppkey)) as j, count(*) over (partition by s_nationkey % 5) as n from supplier)
  select l.grp, c_custkey, s_suppkey from l join r on r.grp = l.grp and (l.i - 1) % r.n + 1 = r.j""")
def j13(spark, sf):
    l = table(spark, sf, "customer").select("c_custkey", (F.col("c_nationkey") % 5).alias("grp"))
    r = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_nationkey") % 5).alias("grp"))
    return jn.pair_cyclic(l, r, "grp", "c_custkey", "s_suppkey", 42).select("grp", "c_custkey", "s_suppkey")


@query("j14_device_map", """select seq, 'DEV-' || lpad(cast(dense_rank() over (order by asset) as varchar), 3, '0') as device from (select event_id as seq, user_id as asset from events)""")
def j14(spark, sf):
    p = points(spark, sf).select("seq", "asset")
    return jn.device_map(p, "asset", bucket("asset", 100_000)).select("seq", "device")


@query("j16_spine", f"""with {sql.POINTS}, s as (select asset, unnest(generate_series(1704067200000000, 1706659200000000 - 1, 86400000000)) as bucket from (select distinct asset from points))
  select s.asset, s.bucket, count(p.seq) as rows, count(*) filter (p.fault) as faults from s left join points p on p.asset = s.asset and p.t_us // 86400000000 * 86400000000 = s.bucket group by s.asset, s.bucket""")
def j16(spark, sf):
    return jn.spine_join(points(spark, sf), ["asset"], "t_us", 1704067200000000, 1706659200000000, DAY_US, {"rows": F.count(F.lit(1)), "faults": F.count_if("fault")})


# ------------------------------------------------------------------ datasets

_TRUST = "case when k % 3 = 0 then ['vibration', 'scenario'] when k % 3 = 1 then ['acoustic'] else [] end"
_GT_SQL = f"""{_SPANS_SQL}, {_BEST}, {_MAP_SQL}, f as (select seq, asset, t_us, event_id, label as event_label, event_id is not null and verified and label <> 'needs_review' as event_verified, k,
    case when k % 3 = 0 and k % 4 = 1 then 'bearing' when k % 3 = 0 and k % 4 = 2 then ' ' end as vib, case when k % 3 = 1 and k % 2 = 1 then 'unknown-x' end as ac, case when k % 3 = 0 and k % 7 = 0 then 'mystery' end as sc from best), g as (
  select *, case when event_verified then event_label when trim(vib) <> '' then trim(vib) when ac is not null then ac when sc is not null then sc end as ground_truth_label,
    case when event_verified then 'event_review' when trim(vib) <> '' then 'known_vibration_label' when ac is not null then 'known_acoustic_label' when sc is not null then 'scenario_label' end as ground_truth_source from f), h as (
  select g.*, coalesce(upper(m.target), tx.code) as target_label from g left join m on lower(m.src) = lower(ground_truth_label) left join tx on tx.code = upper(ground_truth_label)), rows as (
  select *, case when ground_truth_label is not null then case when target_label is not null then 'verified' else 'unmapped' end when event_id is not null and not event_verified and trim(event_label) <> '' then 'weak' else 'unlabeled' end as label_status from h)"""


def dataset(spark, sf):
    p = jn.label_events(pts(spark, sf), spans(spark, sf), ["asset"], "t_us", "seq")
    k = F.col("k")
    arr = lambda *xs: F.array(*[F.lit(x) for x in xs])
    f = p.select("seq", "asset", "t_us", "event_id", F.col("label").alias("event_label"), "k", "value",
                 F.coalesce(F.col("event_id").isNotNull() & F.col("verified") & (F.col("label") != "needs_review"), F.lit(False)).alias("event_verified"),
                 F.when(k % 4 == 1, "bearing").when(k % 4 == 2, " ").alias("vibration"), F.when(k % 2 == 1, "unknown-x").alias("acoustic"),
                 F.when(k % 7 == 0, "mystery").alias("scenario"),
                 F.when(k % 3 == 0, arr("vibration", "scenario")).when(k % 3 == 1, arr("acoustic")).otherwise(F.array().cast("array<string>")).alias("trusted"))
    return ds.dataset_rows(f, *_mapping(spark))


@query("l01_ground_truth", f"with {_GT_SQL} select seq, ground_truth_label, ground_truth_source, target_label from rows")
def l01(spark, sf):
    return dataset(spark, sf).select("seq", "ground_truth_label", "ground_truth_source", "target_label")


@query("l02_dataset_rows", f"with {_GT_SQL} select seq, asset, event_id, event_label, label_status, label_status = 'verified' as training_eligible from rows")
def l02(spark, sf):
    return dataset(spark, sf).select("seq", "asset", "event_id", "event_label", "label_status", "training_eligible")


@query("l03_label_fields", """with m(src, target) as (values ('ECONOMY', 'NORMAL'), ('SMALL', 'ANOMALY'), ('STANDARD', 'ANOMALY')), p as (select p_partkey, case when p_partkey % 9 = 0 then ' ' else p_type end as lab, case when p_size % 2 = 0 then 'acoustic' else 'vibration' end as modality from part), g as (
  select *, case when trim(lab) <> '' then trim(lab) end as g from p) select p_partkey, g as ground_truth_label, case when g is not null then 'dataset_registration' end as ground_truth_source, case when modality = 'acoustic' then g end as known_acoustic_label,
  m.target as target_label, case when m.target is not null then 'tax-1' end as target_label_taxonomy_version, case when g is null then 'unlabeled' when m.target is not null then 'verified' else 'unmapped' end as label_status, m.target is not null as training_eligible from g left join m on m.src = g.g""")
def l03(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 9 == 0, " ").otherwise(F.col("p_type")).alias("lab"),
                                        F.when(F.col("p_size") % 2 == 0, "acoustic").otherwise("vibration").alias("modality"))
    m = spark.createDataFrame([("ECONOMY", "NORMAL"), ("SMALL", "ANOMALY"), ("STANDARD", "ANOMALY")], "source_label string, target string")
    return ds.label_fields(p, "lab", "modality", m, "tax-1").drop("lab", "modality")


RATIOS = {"train": 0.7, "validation": 0.15, "test": 0.15}


@query("l04_hash_split", """with v as (select l_suppkey, l_orderkey, l_linenumber, l_partkey, cast('0x' || substr(sha256('s:' || l_suppkey), 1, 8) as bigint) / 4294967295.0 as v from lineitem)
  select l_suppkey, count(*) as rows, min(case when v < 0.7 then 'train' when v < 0.7::double + 0.15::double then 'validation' else 'test' end) as dataset_split from v group by l_suppkey""")
def l04(spark, sf):
    l = table(spark, sf, "lineitem").select("l_suppkey")
    return ds.hash_split(l, F.concat(F.lit("s:"), "l_suppkey"), RATIOS).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("rows"), F.min("dataset_split").alias("dataset_split"))


@query("l05_stratified_split", """with g as (select l_suppkey, median(l_extendedprice / 20) as med from lineitem group by l_suppkey), s as (
  select l_suppkey, row_number() over (order by 'rpm-' || cast(cast(floor(med / 100) * 100 as bigint) as varchar), sha256(cast(l_suppkey as varchar))) as pos from g), n as (select count(*) as n from g), r(sp, ratio, ix) as (values ('train', 0.7::double, 0), ('validation', 0.15::double, 1), ('test', 0.15::double, 2)), t as (
  select sp, ratio, ix, n, floor(n * ratio) as base, n * ratio - floor(n * ratio) as frac from r, n), u as (select *, row_number() over (order by frac desc, ratio desc, ix) as rk, n - sum(base) over () as spare from t), tg as (
  select sp, ratio, ix, cast(base + case when rk <= spare then 1 else 0 end as bigint) as t from u), items as (select sp, ratio, ix, t, unnest(range(0, t)) as j from tg), q as (
  select sp, row_number() over (order by j / t::double, ratio desc, ix) as pos from items) select l_suppkey, sp as dataset_split from s join q using (pos)""")
def l05(spark, sf):
    l = table(spark, sf, "lineitem").select("l_suppkey", (F.col("l_extendedprice") / 20).alias("rpm"))
    return ds.stratified_group_split(l, "l_suppkey", "rpm", RATIOS)


@query("l06_group_split", """select l_returnflag as label, 3::bigint as splits, true as leak_free, true as near_shares, count(distinct l_suppkey) as groups, count(*) as rows from lineitem group by l_returnflag""")
def l06(spark, sf):
    """Per label: splits reached, no group in two splits, and row shares within a tenth of the ratios."""
    l = table(spark, sf, "lineitem").select("l_suppkey", F.col("l_returnflag").alias("label"))
    s = ds.group_split(l, "l_suppkey", "label", RATIOS)
    once = s.groupBy("l_suppkey").agg((F.count(F.lit(1)) == 1).alias("once"))
    j = l.join(s, "l_suppkey").join(once, "l_suppkey")
    share = lambda x: F.abs(F.count_if(F.col("dataset_split") == x) / F.count(F.lit(1)) - RATIOS[x]) < 0.1
    return j.groupBy("label").agg(F.count_distinct("dataset_split").alias("splits"), F.every("once").alias("leak_free"), (share("train") & share("validation") & share("test")).alias("near_shares"),
                                  F.count_distinct("l_suppkey").alias("groups"), F.count(F.lit(1)).alias("rows"))


@query("l07_load_split", "select l_linenumber - 1 as load, case l_linenumber - 1 when 0 then 'test' when 1 then 'validation' when 2 then 'train' when 3 then 'train' end as dataset_split, case when l_linenumber > 4 then 'UNKNOWN_LOAD' end as error_code, count(*) as rows from lineitem group by l_linenumber")
def l07(spark, sf):
    l = table(spark, sf, "lineitem").select((F.col("l_linenumber") - 1).alias("load"))
    return ds.load_split(l, "load").groupBy("load", "dataset_split", "error_code").agg(F.count(F.lit(1)).alias("rows"))


@query("l08_condition_holdout", """with c as (select distinct l_returnflag as mode, l_linenumber as condition from lineitem), r as (select *, row_number() over (partition by mode order by sha256('42:' || condition)) as r from c)
  select mode, condition, case r when 1 then 'test' when 2 then 'validation' else 'train' end as dataset_split from r""")
def l08(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("mode"), F.col("l_linenumber").alias("condition"))
    return ds.condition_holdout(l, "mode", "condition")


@query("l09_run_split", """with c as (select distinct o_orderpriority as ctx, o_custkey as run from orders), r as (select *, row_number() over (partition by ctx order by sha256('42:' || run)) as r, count(*) over (partition by ctx) as n from c)
  select ctx, run, case when n < 2 then null when r <= ceil(n * 0.25) then 'evaluation' else 'calibration' end as dataset_split from r""")
def l09(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("ctx"), F.col("o_custkey").alias("run"))
    return ds.run_split(o, ["ctx"], "run")


@query("l10_condition_folds", f"""with {_EVAL_SQL} select f as fold, case when condition = f then 'evaluate' when condition in ((f + 1) % 8, (f + 5) % 8) then 'calibrate' else 'fit' end as role, count(*) as rows, round(avg(score), 6) as mean_score
  from ev, range(0, 8) t(f) group by all""")
def l10(spark, sf):
    f = ds.condition_folds(evaluation(spark, sf), "condition", 2)
    return f.groupBy(F.col("fold").cast("long").alias("fold"), "role").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("score"), 6).alias("mean_score"))


@query("l11_freeze_dataset", f"""with {_GT_SQL} select count(*) as rows, count(distinct asset) as assets, count(*) filter (label_status = 'verified') as verified, true as leak_free, true as repeat_refused from rows where t_us between 1704500000000000 and 1706000000000000""")
def l11(spark, sf):
    d = dataset(spark, sf).withColumn("site", F.col("asset") % 3)
    scoped = ds.apply_source_filters(d, [], [], (1704400000000000, 1706000000000000), (1704500000000000, None), "t_us").withColumn("rpm", F.col("value") * 10)
    rows, manifest = ds.freeze_dataset(scoped, "asset", "rpm", RATIOS, ["seq", "k"], "target_label", "DS")
    again = ds.freeze_dataset(scoped, "asset", "rpm", RATIOS, ["seq", "k"], "target_label", "DS", manifest)[1]
    per = rows.groupBy("asset").agg(F.count_distinct("dataset_split").alias("splits"))
    leak = per.agg((F.max("splits") == 1).alias("leak_free"), F.count(F.lit(1)).alias("assets")).withColumn("one", F.lit(1))
    total = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if("training_eligible").alias("verified")).withColumn("one", F.lit(1))
    refused = again.select(F.col("duplicate_of").isNotNull().alias("repeat_refused")).withColumn("one", F.lit(1))
    return total.join(leak, "one").join(refused, "one").select("rows", "assets", "verified", "leak_free", "repeat_refused")


@query("l12_verify_dataset", f"""with {sql.POINTS} select asset, case when asset % 9 = 0 then 'only_first' when bool_or(k = 50) then 'changed' else 'same' end as verdict from points group by asset""")
def l12(spark, sf):
    a = points(spark, sf).select("asset", "seq", "score", "k")
    b = a.filter("asset % 9 > 0").withColumn("k", F.when(F.col("k") == 50, 51).otherwise(F.col("k")))
    return ds.verify_dataset(a, b, ["seq", "k"], ["asset"])


_ACT = "case when event_type = 'view' then 'register' when event_type = 'click' then 'freeze' when event_type = 'purchase' then 'approve' when event_type = 'error' then 'activate' else 'retire' end"


@query("l13_registry_state", f"""with {sql.POINTS}, l as (select asset as version, seq, {_ACT} as action, case when asset % 4 = 0 then k // 50 else asset end as digest from points)
  select version, arg_max(case action when 'register' then 'draft' when 'freeze' then 'frozen' when 'approve' then 'approved' when 'activate' then 'active' else 'approved' end, seq) as state, arg_max(digest, seq) as digest, count(*) as actions,
    bool_or(action = 'approve') as ever_approved, count(distinct digest) as digests from l group by version""")
def l13(spark, sf):
    return ds.registry_state(_registry_log(spark, sf), "version", ["seq"])


def _registry_log(spark, sf):
    return points(spark, sf).select(F.col("asset").alias("version"), "seq", F.expr(_ACT).alias("action"),
                                    F.when(F.col("asset") % 4 == 0, F.floor(F.col("k") / 50)).otherwise(F.col("asset")).alias("digest"))


@query("l13_rollback_ok", f"""with {sql.POINTS}, l as (select asset as version, seq, {_ACT} as action, case when asset % 4 = 0 then k // 50 else asset end as digest from points)
  select version, coalesce(min(seq) filter (action = 'approve') < max(seq) filter (action = 'activate') and count(distinct digest) = 1, false) as rollback_ok from l group by version""")
def l13r(spark, sf):
    return ds.rollback_ok(_registry_log(spark, sf), "version", ["seq"])


@query("l14_manifest", f"""with {_GT_SQL}, w as (select sha256('k=' || k || chr(31) || 'seq=' || seq) as h from rows), c as (select count(*) as rows, cast(sum(cast(cast('0x' || substr(h, 1, 12) as bigint) as hugeint)) % 2305843009213693951 as bigint) as digest_a,
    cast(sum(cast(cast('0x' || substr(h, 13, 12) as bigint) as hugeint)) % 2305843009213693951 as bigint) as digest_b from w), n as (select cast(asset % 3 as varchar) || '/' || coalesce(target_label, 'none') as key, count(*) as n from rows group by 1)
  select 'DS-' || substr(sha256('DS:' || rows || ':' || digest_a || ':' || digest_b), 1, 12) as id, rows, digest_a, digest_b, (select '{{' || string_agg('"' || key || '":' || n, ',' order by key, n) || '}}' from n) as counts from c""")
def l14(spark, sf):
    d = dataset(spark, sf).withColumn("split", (F.col("asset") % 3).cast("string"))
    return ds.build_manifest(d, "DS", ["seq", "k"], "split", "target_label")


@query("l15_training_rows", """select l_orderkey, l_linenumber, l_partkey, l_suppkey, true as complete, round(l_discount, 6) as v1, round(l_extendedprice, 6) as v2, round(l_tax, 6) as v3, 3 as width from lineitem""")
def l15(spark, sf):
    l = table(spark, sf, "lineitem")
    t = ds.training_rows(l, ["l_tax", "l_quantity", "l_discount", "l_extendedprice"], ["l_quantity"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    v = F.col("vector")
    return t.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "complete", *[F.round(v[i], 6).alias(f"v{i + 1}") for i in range(3)], F.size(v).alias("width"))


@query("l15_training_sequences", f"""with {sql.POINTS}, p as (select asset, seq, value, (row_number() over (partition by asset order by seq) - 1) // 5 as chunk from points)
  select asset, chunk, min(seq) as first, round(sum(value), 6) as total from p group by asset, chunk having count(*) = 5""")
def l15s(spark, sf):
    p = points(spark, sf).withColumn("v", F.array("value"))
    s = ds.training_sequences(p, ["asset"], "seq", "v", 5, declared_split("seq"))
    return s.select("asset", "chunk", "first", F.round(F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x[0]), 6).alias("total"))


@query("l16_source_filters", f"""with {sql.POINTS} select asset, count(*) as rows from points where t_us between 1704500000000000 and 1706000000000000 and asset % 3 in (0, 2) and asset < 90 group by asset""")
def l16(spark, sf):
    p = points(spark, sf).withColumn("site", F.col("asset") % 3)
    f = ds.apply_source_filters(p, [0, 2], list(range(90)), (1704400000000000, 1706000000000000), (1704500000000000, None), "t_us")
    return f.groupBy("asset").agg(F.count(F.lit(1)).alias("rows"))


_REV = "case when k % 4 = 0 then 'confirmed_anomaly' when k % 4 = 1 then 'sensor_issue' when k % 4 = 2 then 'bogus' else 'normal_false_positive' end"


def _reviews(spark, sf):
    p = points(spark, sf)
    ev = p.groupBy(F.col("asset").alias("event_id")).agg(F.lit("needs_review").alias("label"), F.lit("n0").alias("note"))
    rv = p.filter("event_type = 'click'").select(F.col("asset").alias("event_id"), F.expr(_REV).alias("new_label"), F.when(F.col("k") % 3 == 0, F.concat(F.lit("n"), "k")).alias("note"),
                                                 F.when(F.col("k") % 11 == 0, " ").otherwise("op").alias("changed_by"), F.lit("seen").alias("reason"), F.col("t_us").alias("at_us"), F.col("seq").alias("review_id"))
    return ds.apply_reviews(ev, rv, "event_id", ["confirmed_anomaly", "sensor_issue", "normal_false_positive"])


_REV_SQL = f"""{sql.POINTS}, ok as (select asset as event_id, {_REV} as nl, case when k % 3 = 0 then 'n' || k end as note, t_us, seq from points where event_type = 'click' and k % 4 <> 2 and k % 11 > 0)"""


@query("l17_reviews_current", f"""with {_REV_SQL}, l as (select * from ok qualify row_number() over (partition by event_id order by t_us desc, seq desc) = 1), e as (select distinct asset as event_id from points)
  select event_id, coalesce(nl, 'needs_review') as label, coalesce(l.note, 'n0') as note, t_us as reviewed_us from e left join l using (event_id)""")
def l17(spark, sf):
    return _reviews(spark, sf)[0]


@query("l17_review_log", f"with {_REV_SQL} select event_id, seq as review_id, nl as new_label, coalesce(lag(nl) over (partition by event_id order by t_us, seq), 'needs_review') as previous_label from ok")
def l17l(spark, sf):
    return _reviews(spark, sf)[1].select("event_id", "review_id", "new_label", "previous_label")


@query("l18_history_view", f"with {sql.POINTS} select asset, seq, t_us as valid_from, lead(t_us) over (partition by asset order by t_us, seq) as valid_to from points where event_type = 'view'")
def l18(spark, sf):
    p = points(spark, sf).filter("event_type = 'view'").select("asset", "seq", "t_us")
    v = ds.history_view(p.withColumn("at_us", F.col("t_us")), ["asset"], "at_us", ["t_us", "seq"], declared_split("t_us"))
    return v.drop("t_us")


@query("l18_log_as_of", f"with {sql.POINTS} select asset, seq, k from points where t_us <= 1705300000000000 qualify row_number() over (partition by asset order by t_us desc, seq desc) = 1")
def l18a(spark, sf):
    return ds.log_as_of(points(spark, sf).select("asset", "seq", "k", "t_us"), ["asset"], "t_us", ["t_us", "seq"], F.lit(1705300000000000)).drop("t_us")


# ------------------------------------------------------------------ search and paging

_EVT_SQL = f"""{sql.POINTS}, evt as (select seq as id, asset, asset % 25 as site, t_us as at_us, value as score, k % 2 = 0 as reviewed, case when value >= 100 then 'critical' else 'warning' end as severity from points where value > 50)"""


def evt(spark, sf):
    return points(spark, sf).filter("value > 50").select(
        F.col("seq").alias("id"), "asset", (F.col("asset") % 25).alias("site"), F.col("t_us").alias("at_us"), F.col("value").alias("score"),
        (F.col("k") % 2 == 0).alias("reviewed"), F.when(F.col("value") >= 100, "critical").otherwise("warning").alias("severity"))


@query("o01_search_events", f"with {_EVT_SQL} select * from evt where severity = 'critical' and site in (1, 2, 3, 4, 5) and at_us between 1704200000000000 and 1706500000000000 order by not reviewed desc, at_us desc, id offset 20 limit 20")
def o01(spark, sf):
    return se.search_events(evt(spark, sf), "unreviewed_desc", 2, 20, 1704200000000000, 1706500000000000, severity="critical", site=[1, 2, 3, 4, 5])


@query("o01_search_events_score", f"with {_EVT_SQL} select * from evt where reviewed order by score desc, at_us desc, id limit 50")
def o01s(spark, sf):
    return se.search_events(evt(spark, sf), "score_desc", 1, 50, reviewed=True)


@query("o02_search_devices", "select s_suppkey as device, s_nationkey as site, s_acctbal > 0 as active from supplier where s_nationkey in (1, 3, 5, 7, 9, 11) and s_acctbal > 0 order by s_suppkey limit 10")
def o02(spark, sf):
    d = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("device"), F.col("s_nationkey").alias("site"), (F.col("s_acctbal") > 0).alias("active"))
    return se.search_devices(d, 1, 10, site=[1, 3, 5, 7, 9, 11], active=True)


@query("o03_page_after", f"with {_EVT_SQL} select id, at_us, true as has_more from evt where at_us < 1706000000000000 order by at_us desc, id desc limit 100")
def o03(spark, sf):
    return se.page_after(evt(spark, sf).select("id", "at_us"), "at_us", "id", (1706000000000000, -1), 100)


@query("o04_latest_snapshots", f"""with {sql.WINDOWS} select device, ordinal, row_number() over (partition by device order by captured_us desc, k % 2 = 0, ordinal desc) as place from windows qualify place <= 12""")
def o04(spark, sf):
    w = windows(spark, sf).withColumn("late", F.col("k") % 2 == 0)
    return se.latest_snapshots(w, ["device"], 12).select("device", "ordinal", "place")


@query("o05_canonical_order", f"with {sql.POINTS} select t_us, asset, seq, value from points order by t_us, asset, seq")
def o05(spark, sf):
    return se.canonical_order(points(spark, sf).select("t_us", "asset", "seq", "value"), ["t_us", "asset", "seq", "value"])


@query("o06_page_history", "select o_orderkey, o_custkey, o_totalprice from orders where o_orderstatus in ('F', 'P') order by o_totalprice desc, o_orderkey offset 100 limit 50")
def o06(spark, sf):
    o = table(spark, sf, "orders")
    return se.page_history(o, {"o_orderstatus": ["F", "P"]}, [("o_totalprice", False), ("o_orderkey", True)], 3, 50).select("o_orderkey", "o_custkey", "o_totalprice")


_SCN = "case when event_type = 'error' then 'vibration_anomaly' when event_type = 'signup' then 'acoustic_anomaly' when event_type = 'purchase' then 'combined_anomaly' else 'normal' end"


@query("o07_phase_order", f"""with {sql.POINTS}, s as (select seq, {_SCN} as scenario from points), n as (select *, row_number() over (partition by scenario order by seq) as p, count(*) filter (scenario = 'normal') over () as n from s)
  select seq, scenario, case when scenario = 'vibration_anomaly' then 1 when scenario = 'acoustic_anomaly' then 3 when scenario = 'combined_anomaly' then 5 when p <= n // 3 then 0 when p <= 2 * (n // 3) then 2 else 4 end as phase, p as phase_pos from n""")
def o07(spark, sf):
    p = points(spark, sf).select("seq", F.expr(_SCN).alias("scenario"))
    return se.phase_order(p, "scenario", ["seq"], declared_split("seq"))


@query("o08_due_deliveries", f"""with {sql.POINTS} select event_type as channel, seq as id from points where k % 2 = 0 and t_us <= 1705500000000000 qualify row_number() over (partition by event_type order by t_us, seq) <= 100""")
def o08(spark, sf):
    d = points(spark, sf).select(F.col("event_type").alias("channel"), F.col("seq").alias("id"), F.col("t_us").alias("due_us"), F.when(F.col("k") % 2 == 0, "pending").otherwise("sent").alias("status"))
    return se.due_deliveries(d, "channel", "due_us", "id", F.lit(1705500000000000), 100).select("channel", "id")


@query("f29_telemetry_for", "select event_id as seq, epoch_us(ts) as t_us from events where user_id = 8 and ts between timestamp '2024-01-02 12:53:20' and timestamp '2024-01-23 08:53:20'")
def f29(spark, sf):
    e = table(spark, sf, "events").withColumnsRenamed({"user_id": "asset", "event_id": "seq"})
    return se.telemetry_for(e, asset=8, low="2024-01-02 12:53:20", high="2024-01-23 08:53:20", at="ts").select("seq", micros("ts").alias("t_us"))


@query("f27_visible_to", f"with {_EVT_SQL} select site, count(*) as rows from evt where site in (1, 4, 9) group by site")
def f27(spark, sf):
    return se.visible_to(evt(spark, sf), "site", [1, 4, 9]).groupBy("site").agg(F.count(F.lit(1)).alias("rows"))


# ------------------------------------------------------------------ alerts

def policies(spark, sf):
    k = F.col("s_suppkey")
    none = F.array().cast("array<bigint>")
    return table(spark, sf, "supplier").select(
        k.alias("policy_id"), F.when(k % 3 == 0, "critical").otherwise("warning").alias("severity"),
        F.when(k % 4 == 0, none).otherwise(F.array(F.col("s_nationkey").cast("long"), (F.col("s_nationkey") + 1).cast("long"))).cast("array<string>").alias("site_ids"),
        F.when(k % 5 < 4, none).otherwise(F.array(k, k + 25, k + 50)).cast("array<string>").alias("asset_ids"),
        F.when(k % 7 > 0, none).otherwise(F.array(F.col("s_nationkey").cast("long"))).cast("array<string>").alias("scope_site_ids"),
        F.when(k % 2 == 0, "22:00").otherwise("06:00").alias("work_start"), F.when(k % 2 == 0, "05:59").otherwise("18:30").alias("work_end"),
        (F.col("s_acctbal") > 0).alias("enabled"), F.array(F.lit("web"), F.lit("email"), F.lit("email")).alias("channels"),
        F.array(F.concat(F.lit("u"), k % 3), F.lit("ops")).alias("recipients"), (300 * (k % 5 + 1)).alias("cooldown_sec"))


_POLICY_SQL = f"""{_EVT_SQL}, pol as (select s_suppkey as policy_id, case when s_suppkey % 3 = 0 then 'critical' else 'warning' end as severity, case when s_suppkey % 4 = 0 then [] else [s_nationkey, s_nationkey + 1] end as site_ids,
    case when s_suppkey % 5 < 4 then [] else [s_suppkey, s_suppkey + 25, s_suppkey + 50] end as asset_ids, case when s_suppkey % 7 > 0 then [] else [s_nationkey] end as scope_ids, case when s_suppkey % 2 = 0 then '22:00' else '06:00' end as ws,
    case when s_suppkey % 2 = 0 then '05:59' else '18:30' end as we, s_acctbal > 0 as enabled, 300 * (s_suppkey % 5 + 1) as cooldown_sec, 'u' || (s_suppkey % 3) as who from supplier), mt as (
  select e.id as event_id, e.asset, e.at_us, e.reviewed, p.*, strftime(make_timestamp(e.at_us), '%H:%M') as mi from evt e join pol p on p.severity = e.severity and (len(site_ids) = 0 or list_contains(site_ids, e.site)) and (len(asset_ids) = 0 or list_contains(asset_ids, e.asset))
    and (len(scope_ids) = 0 or list_contains(scope_ids, e.site))), sup as (
  select *, case when not enabled then 'disabled' when reviewed then 'reviewed' when not (case when ws <= we then mi between ws and we else mi >= ws or mi <= we end) then 'outside_work_hours' end as suppressed from mt)"""


def _minute():
    m = F.floor(F.pmod(F.col("at_us"), F.lit(DAY_US)) / 60_000_000)
    return F.concat_ws(":", F.lpad(F.floor(m / 60).cast("string"), 2, "0"), F.lpad((m % 60).cast("string"), 2, "0"))


def _events_text(spark, sf):
    e = evt(spark, sf)
    return e.withColumns({"event_id": F.col("id"), "site": F.col("site").cast("string"), "asset": F.col("asset").cast("string")}).drop("id")


def _matches(spark, sf, listed=True):
    return al.match_policies(_events_text(spark, sf), policies(spark, sf), _minute(), listed=listed)


@query("j09_match_policies", f"with {_POLICY_SQL} select policy_id, event_id from sup")
def j09(spark, sf):
    return _matches(spark, sf).select("policy_id", "event_id")


@query("n01_policy_matches", f"with {_POLICY_SQL} select policy_id, event_id, suppressed from sup")
def n01(spark, sf):
    return _matches(spark, sf).select("policy_id", "event_id", "suppressed")


@query("n01_policy_reasons", f"""with {_POLICY_SQL}, g as (select policy_id, count(*) filter (suppressed = 'disabled') as disabled, count(*) filter (suppressed = 'reviewed') as reviewed, count(*) filter (suppressed = 'outside_work_hours') as outside_work_hours,
  count(*) filter (suppressed is null) as deliver, count(*) as in_scope from sup group by policy_id) select policy_id, coalesce(disabled, 0) as disabled, coalesce(g.reviewed, 0) as reviewed, coalesce(outside_work_hours, 0) as outside_work_hours, coalesce(deliver, 0) as deliver,
  coalesce(in_scope, 0) as in_scope, (select count(*) from evt) - coalesce(in_scope, 0) as mismatch from pol left join g using (policy_id)""")
def n01r(spark, sf):
    return al.policy_reason(_events_text(spark, sf), policies(spark, sf), _minute())


@query("n02_plan_deliveries", f"""with {_POLICY_SQL}, d as (select event_id, policy_id, unnest(['web', 'email', 'email']) as channel, unnest(['site-operators', who, 'ops']) as recipient, enabled from sup where suppressed is null)
  select event_id || '|' || policy_id || '|' || channel || '|' || recipient || '|false' as dedupe_key from d where event_id % 10 > 0 or channel <> 'web'""")
def n02(spark, sf):
    m = _matches(al.planning_session(spark), sf, listed=False)
    sent = al.plan_deliveries(m.filter("event_id % 10 = 0")).filter("channel = 'web'")
    return al.plan_deliveries(m, sent).select("dedupe_key")


@query("n03_cooldown", f"""with recursive {sql.POINTS}, c as (select asset % 5 as policy, asset // 5 as target, seq, t_us, row_number() over (partition by asset % 5, asset // 5 order by t_us, seq) as n from points where value > 30), w as (
  select policy, target, n, seq, t_us as last, true as kept from c where n = 1 union all
  select w.policy, w.target, c.n, c.seq, case when c.t_us - w.last >= 43200000000 then c.t_us else w.last end, c.t_us - w.last >= 43200000000 from w join c on c.policy = w.policy and c.target = w.target and c.n = w.n + 1)
  select policy, target, seq, kept from w""")
def n03(spark, sf):
    p = points(spark, sf).filter("value > 30").select((F.col("asset") % 5).alias("policy"), F.floor(F.col("asset") / 5).alias("target"), "seq", "t_us", F.lit(43_200).alias("cd"))
    return al.apply_cooldown(p, ["policy", "target"], "t_us", "seq", "cd").select("policy", "target", "seq", "kept")


_SENT = f"""{sql.POINTS}, e as (
  select asset % 5 as policy, asset // 5 as target, t_us // 3600000000 * 3600000000 as t_us, seq, (k % 4) * 21600 as cd from points where value > 20 and k % 6 <> 0), s as (
  select asset % 5 as policy, asset // 5 as target, t_us // 3600000000 * 3600000000 as t_us, seq from points where value > 20 and k % 12 = 0), c as (
  select *, row_number() over (partition by policy, target order by t_us, seq) as n from (select *, false as gone from e union all select policy, target, t_us, seq, 0, true from s))"""


@query("n03_cooldown_sent", f"""with recursive {_SENT}, w as (
  select policy, target, n, seq, gone, t_us as last, true as kept from c where n = 1 union all
  select w.policy, w.target, c.n, c.seq, c.gone, case when c.gone or c.t_us - w.last >= c.cd * 1000000 then c.t_us else w.last end, c.gone or c.t_us - w.last >= c.cd * 1000000
  from w join c on c.policy = w.policy and c.target = w.target and c.n = w.n + 1)
  select policy, target, seq, kept from w where not gone""")
def n03_sent(spark, sf):
    """Cool-downs of none to eighteen hours by row, times on the hour (ties), and deliveries that went out before."""
    p = points(spark, sf).where("value > 20").select((F.col("asset") % 5).alias("policy"), F.floor(F.col("asset") / 5).alias("target"), (F.floor(F.col("t_us") / HOUR_US) * HOUR_US).alias("t_us"), "seq",
                                                     (F.col("k") % 4 * 21_600).alias("cd"), "k")
    kept = al.apply_cooldown(p.where("k % 6 <> 0"), ["policy", "target"], "t_us", "seq", "cd", sent=p.where("k % 12 = 0").select("policy", "target", "t_us", "seq"))
    return kept.select("policy", "target", "seq", "kept")


@query("n04_next_attempt", f"""with {sql.POINTS}, a as (select seq, k % 3 as a0, event_type = 'click' as ok, event_type <> 'error' as retryable from points)
  select seq, a0 + 1 as attempts, case when ok then 'sent' when retryable and a0 + 1 < 3 then 'pending' else 'failed' end as status, case when not ok and retryable and a0 + 1 < 3 then {_NOW} + cast(least(60, pow(2, a0 + 1)) * 1000000 as bigint) end as due_us from a""")
def n04(spark, sf):
    a = points(spark, sf).select("seq", (F.col("k") % 3).alias("attempts"), (F.col("event_type") == "click").alias("success"), (F.col("event_type") != "error").alias("retryable"))
    return al.next_attempt(a, F.lit(_NOW)).select("seq", "attempts", "status", "due_us")


@query("n05_notification_allowed", f"""with {sql.POINTS}, i as (select seq as id, asset as device, asset % 25 as site, asset, t_us as transition_us, k % 3 as model, event_type = 'view' as unk, event_type in ('view', 'click', 'error') as tr from points where value > 60), l as (
  select asset as device, max(t_us) as c, arg_max(event_type <> 'signup', seq) as v, arg_max(k % 3, seq) as m from points group by asset), d as (select s_suppkey as device, s_nationkey as site, case when s_acctbal > 0 then 'active' else 'off' end as mp from supplier)
  select id, coalesce(tr and mp = 'active' and d.site % 2 = i.site % 2 and m = model and v and ({_NOW} - c) / 1e6 between -5 and 864000 and ({_NOW} - transition_us) / 1e6 between -5 and 864000 and not unk, false) as allowed from i left join l using (device) left join d using (device)""")
def n05(spark, sf):
    p = points(spark, sf)
    i = p.filter("value > 60").select(F.col("seq").alias("id"), F.col("asset").alias("device"), (F.col("asset") % 25 % 2).alias("site"), "asset", F.col("t_us").alias("transition_us"), (F.col("k") % 3).alias("model"),
                                      F.when(F.col("event_type") == "view", "unknown").otherwise("observing").alias("observation"),
                                      F.when(F.col("event_type").isin("view", "click", "error"), "open").otherwise("none").alias("transition"))
    l = p.groupBy(F.col("asset").alias("device")).agg(F.max("t_us").alias("captured_us"), F.max_by(F.col("event_type") != "signup", "seq").alias("valid"), F.max_by(F.col("k") % 3, "seq").alias("model"))
    d = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("device"), (F.col("s_nationkey") % 2).cast("long").alias("site"), F.col("s_suppkey").alias("asset"), F.when(F.col("s_acctbal") > 0, "active").otherwise("off").alias("mapping"))
    return al.notification_allowed(i, l, d, F.lit(_NOW), 864_000).select("id", "allowed")
