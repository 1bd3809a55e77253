"""Waveform feature and scoring queries on the 64-sample vectors."""

import math

from pyspark.sql import functions as F

from ..functions.numeric import r6
from ..operators import events as ev, features as fe, scoring as sc
from ..plans.registry import query
from ..plans.scan import declared_split, numbered
from ..sources.tables import points, snapshots, table, vectors
from . import sql
from .q_joins import spans
from .q_sequence import _REASON_SQL, with_24

AUDIO = 16_000.0

# discrete Fourier transform stated as a sum over samples: (id, k) -> re, im
def _dft(src, ident, arr, n=64):
    return f"""smp as (select {ident}, unnest({arr}) as s, unnest(range(0, {n})) as i from {src}), spc as (
  select {ident}, k, pow(sum(s * cos(2 * pi() * k * i / {n})), 2) + pow(sum(s * sin(2 * pi() * k * i / {n})), 2) as p from smp, range(0, {n // 2 + 1}) t(k) group by {ident}, k)"""


def _r(*cs, d=6):
    return ", ".join(f"round({c}, {d}) + 0.0 as {c}" for c in cs)


@query("e01_segment", f"""with {sql.VECTORS}, s as (select vec_id, unnest(range(0, 49, 8)) as start, v from vectors)
  select vec_id, start, start + 16 as "end", round(list_sum(v[start + 1:start + 16]), 6) + 0.0 as total from s""")
def e01(spark, sf):
    s = fe.segment(vectors(spark, sf).select("vec_id", "v"), "v", 16, 8)
    return s.select("vec_id", "start", "end", r6(F.aggregate("window", F.lit(0.0), lambda a, x: a + x)).alias("total"))


_FRAMES = f"""{sql.VECTORS}, fr as (select vec_id, unnest(range(0, 49, 8)) as st, v from vectors), f as (select vec_id, st, v[st + 1:st + 16] as w from fr), m as (
  select vec_id, st, w, list_avg(w) as mu, sqrt(list_avg(list_transform(w, lambda x: x * x))) as rms from f), k as (select vec_id, rms,
    list_avg(list_transform(w, lambda x: pow(x - mu, 4))) / pow(list_avg(list_transform(w, lambda x: pow(x - mu, 2))), 2) - 3 as ku,
    list_sum(list_transform(range(2, 17), lambda i: abs(sign(w[i]) - sign(w[i - 1])))) / 15.0 / 2 as zc from m), fs as (
  select vec_id, avg(rms) as rms_mean, stddev_pop(rms) as rms_std, avg(zc) as zcr_mean, avg(ku) as kurtosis_mean, stddev_pop(ku) as kurtosis_std from k group by vec_id)"""


@query("e02_frame_stats", f"with {_FRAMES} select vec_id, {_r('rms_mean', 'rms_std', 'zcr_mean', 'kurtosis_mean', 'kurtosis_std')} from fs")
def e02(spark, sf):
    s = fe.frame_stats(vectors(spark, sf).select("vec_id", "v"), "v", 16, 8).drop("v")
    return s.select("vec_id", *[r6(c).alias(c) for c in s.columns if c != "vec_id"])


_SHAPE = f"""{sql.VECTORS}, {_dft('vectors', 'vec_id', 'v')}, tot as (select vec_id, sum(p) + 1e-12 as tp, sum(p * k * 250.0) / (sum(p) + 1e-12) as cen from spc group by vec_id), cum as (
  select s.vec_id, s.k, p, sum(p) over (partition by s.vec_id order by s.k) as cp, tp, cen from spc s join tot using (vec_id)), sh as (
  select vec_id, any_value(cen) as spectral_centroid, sqrt(sum(pow(k * 250.0 - cen, 2) * p) / any_value(tp)) as spectral_bandwidth, min(k) filter (cp >= 0.85 * tp) * 250.0::double as spectral_rolloff,
   {', '.join(f'sum(p) filter (k * 250 >= {lo} and k * 250 < {hi}) / any_value(tp) as band_{lo}_{hi}Hz' for lo, hi in zip(fe.EDGES, fe.EDGES[1:]))} from cum group by vec_id)"""
_BANDS = [f"band_{lo}_{hi}Hz" for lo, hi in zip(fe.EDGES, fe.EDGES[1:])]


@query("e03_band_energy", f"with {_SHAPE} select vec_id, {_r(*_BANDS)} from sh")
def e03(spark, sf):
    s = fe.band_energy(vectors(spark, sf).select("vec_id", "v"), "v", AUDIO)
    return s.select("vec_id", *[r6(c).alias(c) for c in _BANDS])


@query("e04_spectral_shape", f"with {_SHAPE} select vec_id, {_r('spectral_centroid', 'spectral_bandwidth', 'spectral_rolloff', d=4)} from sh")
def e04(spark, sf):
    s = fe.spectral_shape(vectors(spark, sf).select("vec_id", "v"), "v", AUDIO)
    return s.select("vec_id", *[(F.round(c, 4) + 0.0).alias(c) for c in ("spectral_centroid", "spectral_bandwidth", "spectral_rolloff")])


@query("e05_mfcc")
def e05(spark, sf):
    m = fe.mfcc(vectors(spark, sf).select("vec_id", "v"), "v", AUDIO, 13, 32, 8, 20)
    return m.select("vec_id", F.transform("mfcc", lambda x: F.round(x, 6)).alias("mfcc"))


_NAMES = sorted(fe.feature_names(0, fe.EDGES, True))


@query("e06_features", f"""with {_FRAMES}, {_SHAPE.replace(sql.VECTORS + ', ', '')}, pk as (select vec_id, arg_max(k, (p, -k)) * 250.0::double as vibration_peak_hz from spc where k > 0 group by vec_id)
  select vec_id, {', '.join(f'round({n}, 4) + 0.0 as f{i}' for i, n in enumerate(_NAMES))} from fs join sh using (vec_id) join pk using (vec_id)""")
def e06(spark, sf):
    s = fe.features_named(vectors(spark, sf).select("vec_id", "v"), "v", AUDIO, 16, 8, 0, fe.EDGES, True)
    return s.select("vec_id", *[(F.round(F.col("features")[i], 4) + 0.0).alias(f"f{i}") for i in range(len(_NAMES))])


@query("e06_features26")
def e06f(spark, sf):
    s = fe.features_named(vectors(spark, sf).select("vec_id", "v"), "v", AUDIO, 32, 8, 13, fe.EDGES, False, 20)
    return s.select("vec_id", F.size("features").alias("width"), F.forall("features", lambda x: ~F.isnan(x)).alias("finite"))


@query("e07_rms_peak", f"""with {sql.VECTORS}, {_dft('vectors', 'vec_id', 'v')} select vec_id, round(sqrt(list_avg(list_transform(v, lambda x: x * x))), 6) as rms, arg_max(k, (p, -k)) * 12.5::double as peak_hz from vectors join spc using (vec_id) where k > 0 group by vec_id, v""")
def e07(spark, sf):
    s = fe.rms_peak(vectors(spark, sf).select("vec_id", "v"), "v", 800.0)
    return s.select("vec_id", F.round("rms", 6).alias("rms"), "peak_hz")


@query("e08_vibration_features", f"""with {sql.VECTORS}, c as (select vec_id, list_transform(v, lambda x: x - list_avg(v)) as c from vectors), {_dft('c', 'vec_id', 'c')}, pk as (select vec_id, arg_max(k, (p, -k)) * 12.5::double as peak_hz from spc where k > 0 group by vec_id), m as (
  select vec_id, sqrt(list_avg(list_transform(c, lambda x: x * x))) as rms, list_avg(list_transform(c, lambda x: pow(x, 4))) as m4, list_max(list_transform(c, lambda x: abs(x))) as peak from c)
  select vec_id, round(round(rms, 8), 6) as rms, round(round(rms, 8), 6) as std, round(round(m4 / (pow(rms, 4) + 1e-12), 8), 6) as kurtosis, round(round(peak, 8), 6) as peak, round(round(peak / (rms + 1e-12), 8), 6) as crest, peak_hz from m join pk using (vec_id)""")
def e08(spark, sf):
    s = fe.vibration_features(vectors(spark, sf).select("vec_id", "v"), "v", 800.0)
    return s.select("vec_id", *[F.round(c, 6).alias(c) for c in ("rms", "std", "kurtosis", "peak", "crest")], "peak_hz")


# three neighbouring vectors are the axes of one window; the last window may miss axes
_XYZ_SQL = f"""{sql.VECTORS}, xyz as (select vec_id // 3 as win, vec_id % 3 as ax, case when (vec_id // 3) % 25 = 7 and vec_id % 3 = 1 then list_transform(v, lambda x: 0.25) when (vec_id // 3) % 25 = 9 then list_transform(v, lambda x: x * 400) else v end as v from vectors), okw as (
  select win, case when count(*) < 3 then 'sample_gap' when max(list_max(list_transform(v, lambda x: abs(x)))) >= 16 then 'outside_adxl16g_range' when min(list_var_pop(v)) <= 1e-16 then 'constant_or_near_constant_axis' end as reason from xyz group by win), cen as (
  select win, ax, win * 3 + ax as id, list_transform(v, lambda x: x - list_avg(v)) as c from xyz), tap as (select id, win, ax, c, list_transform(range(1, 65), lambda i: c[i] * (0.5 - 0.5 * cos(2 * pi() * (i - 1) / 64))) as t from cen), {_dft('tap', 'id', 't')}, ax21 as (
  select tap.win, tap.ax, tap.id, sqrt(list_avg(list_transform(c, lambda x: x * x))) as f0, list_max(list_transform(c, lambda x: abs(x))) as f1, list_avg(list_transform(c, lambda x: pow(x, 4))) / pow(list_avg(list_transform(c, lambda x: x * x)), 2) as f2 from tap), hn as (
  select sum(pow(0.5 - 0.5 * cos(2 * pi() * i / 64), 2)) as h from range(0, 64) t(i)), bnd as (select id, {', '.join(f'coalesce(sum(p * case when k = 32 then 1 else 2 end / (64 * h)) filter (k > 0 and k * 12.5 >= {lo} and k * 12.5 < {hi}), 0) as f{3 + i}' for i, (lo, hi) in enumerate(((0, 50), (50, 100), (100, 200), (200, 350))))} from spc, hn group by id), per as (
  select win, ax, f0, f1, f2, f3, f4, f5, f6 from ax21 join bnd using (id))"""


def xyz(spark, sf):
    v = vectors(spark, sf).withColumns({"win": F.floor(F.col("vec_id") / 3), "ax": F.col("vec_id") % 3})
    bent = (F.when((F.col("win") % 25 == 7) & (F.col("ax") == 1), F.transform("v", lambda x: F.lit(0.25)))
            .when(F.col("win") % 25 == 9, F.transform("v", lambda x: x * 400)).otherwise(F.col("v")))
    axis = lambda i: F.max(F.when(F.col("ax") == i, bent)).alias("xyz"[i])
    return v.groupBy("win").agg(axis(0), axis(1), axis(2))


def _long21(df, n=21):
    """One row per window and axis with seven values."""
    per = n // 3
    e = df.select("win", "reason", "features", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("ax"))
    return e.select("win", F.col("ax").cast("long").alias("ax"), "reason", *[(F.round(F.get("features", F.col("ax") * per + i), 6) + 0.0).alias(f"f{i}") for i in range(per)])


@query("e09_base21", f"""with {_XYZ_SQL} select w.win, a.ax, reason, {', '.join(f'case when reason is null then round(f{i}, 6) + 0.0 end as f{i}' for i in range(7))}
  from okw w cross join range(0, 3) a(ax) left join per on per.win = w.win and per.ax = a.ax""")
def e09(spark, sf):
    return _long21(fe.base21(xyz(spark, sf), "x", "y", "z", 64))


_S66 = f"""{_XYZ_SQL}, sup as (select id, k, k * 12.5::double as f, p from spc where k > 0 and k * 12.5 < 350), st as (select id, sum(p) as tp, count(*) as nb from sup group by id), fr as (select sup.id, k, f, p / tp as q, nb, sum(p / tp) over (partition by sup.id order by k) as cq from sup join st using (id)), ce as (
  select id, sum(q * f) as cen from fr group by id), shp as (select fr.id, {', '.join(f'coalesce(sum(q) filter (f >= {lo} and f < {hi}), 0) as g{i}' for i, (lo, hi) in enumerate(((0, 25), (25, 50), (50, 75), (75, 100), (100, 150), (150, 200), (200, 275), (275, 350))))},
   -sum(q * ln(q)) / ln(any_value(nb)) as g8, any_value(cen) as g9, sqrt(sum(q * pow(f - cen, 2))) as g10, arg_max(f, (q, -k)) as g11, max(q) as g12, min(f) filter (cq >= 0.85) as g13 from fr join ce using (id) group by fr.id)"""


@query("e10_spectral66_shape", f"""with {_S66} select w.win, a.ax, reason, {', '.join(f'case when reason is null then round(g{i}, 4) + 0.0 end as g{i}' for i in range(14))}
  from okw w cross join range(0, 3) a(ax) left join shp on shp.id = w.win * 3 + a.ax""")
def e10(spark, sf):
    s = fe.spectral66(xyz(spark, sf), "x", "y", "z", 64)
    e = s.select("win", "reason", "features", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("ax"))
    return e.select("win", F.col("ax").cast("long").alias("ax"), "reason", *[(F.round(F.get("features", 21 + F.col("ax") * 14 + i), 4) + 0.0).alias(f"g{i}") for i in range(14)])


@query("e10_spectral66_corr", f"""with {_XYZ_SQL}, c as (select win, {', '.join(f"any_value(c) filter (ax = {i}) as c{i}" for i in range(3))} from cen group by win)
  select win, reason, {', '.join(f'case when reason is null then round(list_inner_product(c{a}, c{b}) / sqrt(list_inner_product(c{a}, c{a}) * list_inner_product(c{b}, c{b})), 6) + 0.0 end as corr_{n}' for a, b, n in ((0, 1, 'xy'), (0, 2, 'xz'), (1, 2, 'yz')))} from okw left join c using (win)""")
def e10c(spark, sf):
    s = fe.spectral66(xyz(spark, sf), "x", "y", "z", 64)
    return s.select("win", "reason", *[(F.round(F.get("features", F.lit(63 + i)), 6) + 0.0).alias(f"corr_{n}") for i, n in enumerate(("xy", "xz", "yz"))])


@query("e11_ratios36", f"""with {_XYZ_SQL} select w.win, a.ax, reason, {', '.join(f'case when reason is null then round(f{i} / (f3 + f4 + f5 + f6), 6) + 0.0 end as r{i}' for i in (3, 4, 5, 6))}, case when reason is null then round(f1 / f0, 6) + 0.0 end as crest,
  case when reason is null then round(ln(1 + f0 / 0.01), 6) + 0.0 end as log_rms from okw w cross join range(0, 3) a(ax) left join per on per.win = w.win and per.ax = a.ax""")
def e11(spark, sf):
    b = fe.base21(xyz(spark, sf), "x", "y", "z", 64).withColumnRenamed("reason", "why")
    d = fe.derive_variant(b, "features", "log_ratios36")
    e = d.select("win", F.col("why").alias("reason"), "derived", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("ax"))
    at = lambda base, per, i: F.round(F.get("derived", base + F.col("ax") * per + i), 6) + 0.0
    return e.select("win", F.col("ax").cast("long").alias("ax"), "reason", *[at(21, 5, i).alias(f"r{i + 3}") for i in range(4)], at(21, 5, 4).alias("crest"), at(0, 7, 0).alias("log_rms"))


@query("e12_edge_statistics", f"""with {sql.VECTORS}, b as (select vec_id, unnest([0, 1]) as blk, v from vectors), c as (select vec_id * 2 + blk as id, vec_id, list_transform(v[blk * 32 + 1:blk * 32 + 32], lambda x: x - list_avg(v[blk * 32 + 1:blk * 32 + 32])) as c from b), {_dft('c', 'id', 'c', 32)}, e as (
  select id // 2 as vec_id, {', '.join(f'sum(p * case when k = 16 then 1 else 2 end) filter ({w}) / 1024 / 2 as band{i}' for i, w in enumerate(('k = 1', 'k >= 2 and k < 4', 'k >= 4')))} from spc group by 1)
  select vec_id, round(sqrt(list_avg(list_transform(v, lambda x: x * x))), 6) as rms, round(list_max(list_transform(v, lambda x: abs(x))), 6) as peak, round(list_avg(list_transform(v, lambda x: pow(x - list_avg(v), 4))) / pow(list_var_pop(v), 2), 6) as kurtosis, {_r('band0', 'band1', 'band2')} from vectors join e using (vec_id)""")
def e12(spark, sf):
    s = fe.edge_statistics(vectors(spark, sf).select("vec_id", "v"), "v", 32)
    return s.select("vec_id", *[r6(c).alias(c) for c in ("rms", "peak", "kurtosis", "band0", "band1", "band2")])


@query("e13_counts_to_g", f"""with {sql.VECTORS}, c as (select vec_id, list_transform(v, lambda x: cast(round_even(x * 12000, 0) as bigint)) as c from vectors), r as (select *, len(list_filter(c, lambda x: x <= -4096 or x >= 4095)) > 0 as bad from c)
  select vec_id, case when bad then 'clipped' end as reason, case when not bad then round(list_sum(c) * 0.0039::double, 6) + 0.0 end as total_g from r""")
def e13(spark, sf):
    c = vectors(spark, sf).select("vec_id", F.transform("v", lambda x: F.rint(x * 12000).cast("long")).alias("c"))
    g = fe.counts_to_g(c, "c")
    return g.select("vec_id", "reason", r6(F.aggregate("g", F.lit(0.0), lambda a, x: a + x)).alias("total_g"))


@query("e14_quantize", f"""with {sql.VECTORS}, q as (select vec_id, v, list_transform(v, lambda x: round_even(x / 0.0039, 0) * 0.0039) as q from vectors) select vec_id, round(list_sum(q), 6) + 0.0 as total, round(list_sum(case when vec_id % 2 = 0 then q else v end), 6) + 0.0 as augmented from q""")
def e14(spark, sf):
    q = fe.augment_even(fe.quantize(vectors(spark, sf).select("vec_id", "v"), "v"), "vec_id", "v", "quantized")
    total = lambda c: r6(F.aggregate(c, F.lit(0.0), lambda a, x: a + x))
    return q.select("vec_id", total("quantized").alias("total"), total("augmented").alias("augmented"))


_BESSEL = lambda x: f"(select sum(pow(({x}) / 2, 2 * m) / pow(gamma(m + 1.0), 2)) from range(0, 40) b(m))"


@query("e15_decimate", f"""with {sql.VECTORS}, l as (select stream, (row_number() over (partition by stream order by vec_id) - 1) * 64 as base, v from vectors), s as (select stream, base + i as pos, x from (select stream, base, unnest(v) as x, unnest(range(0, 64)) as i from l)), n as (select stream, max(pos) + 1 as n from s group by stream), tp as (
  select k, case when k = 512 then 350 * 2 / 12800.0 else sin(pi() * 350 * 2 / 12800.0 * (k - 512)) / (pi() * (k - 512)) end * {_BESSEL('8.6 * sqrt(1 - pow((k - 512) / 512.0, 2))')} as h from range(0, 1025) t(k)), nt as (select k, h / sum(h) over () as h from tp), o as (
  select stream, unnest(range(32, cast(ceil(n / 16.0) as bigint) - 32)) as j from n)
  select o.stream, o.j - 32 as pos, round(sum(s.x * nt.h), 6) + 0.0 as x from o join s on s.stream = o.stream and s.pos between o.j * 16 - 512 and o.j * 16 + 512 join nt on nt.k = o.j * 16 - s.pos + 512 group by o.stream, o.j""")
def e15(spark, sf):
    v = vectors(spark, sf)
    n = numbered(v, ["stream"], ["vec_id"], declared_split("vec_id"), "n")
    s = n.select("stream", F.posexplode("v").alias("i", "x"), "n").select("stream", ((F.col("n") - 1) * 64 + F.col("i")).alias("pos"), "x")
    d = fe.decimate(s, "stream", "pos", "x", block=2048)
    return d.select("stream", "pos", r6("x").alias("x"))


@query("e16_measured_vibration", f"""with {_XYZ_SQL}, m as (select win, sqrt(sum(list_avg(list_transform(v, lambda x: x * x)))) as r, count(*) as axes from xyz group by win), p as (select a.win, unnest(list_transform(range(1, 65), lambda i: abs(a.v[i]) + abs(b.v[i]) + abs(c.v[i]))) as p, unnest(range(1, 65)) as i from xyz a join xyz b on b.win = a.win and b.ax = 1 join xyz c on c.win = a.win and c.ax = 2 where a.ax = 0)
  select win, round(any_value(case when axes = 3 then r end), 6) as vibration_rms_g, arg_max(i, (round(p, 12), -i)) * 1.5625::double as dominant_hz from m left join p using (win) group by win""")
def e16(spark, sf):
    w = xyz(spark, sf)
    rms = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, v: a + v * v) / F.size(c))
    w = w.select("win", *[rms(c).alias(f"r{c}") for c in "xyz"], *[F.transform(c, lambda v: F.abs(v)).alias(f"s{c}") for c in "xyz"])
    m = fe.measured_vibration(w, ["rx", "ry", "rz"], ["sx", "sy", "sz"])
    return m.select("win", F.round("vibration_rms_g", 6).alias("vibration_rms_g"), "dominant_hz")


@query("e17_moments9", f"""with {_XYZ_SQL}, m as (select win, ax, list_max(list_transform(v, lambda x: abs(x))) / sqrt(list_avg(list_transform(v, lambda x: x * x))) as cf, list_var_pop(v) as va, list_avg(list_transform(v, lambda x: pow(x - list_avg(v), 3))) as m3, list_avg(list_transform(v, lambda x: pow(x - list_avg(v), 4))) as m4 from xyz)
  select win, {', '.join(f"round(max(cf) filter (ax = {i - 1}), 6) as cf_a_{i}, round(max(m3 / pow(va, 1.5)) filter (ax = {i - 1} and va > 0), 4) + 0.0 as sk_a_{i}, round(max(m4 / pow(va, 2)) filter (ax = {i - 1} and va > 0), 4) as ku_a_{i}" for i in (1, 2, 3))} from m group by win""")
def e17(spark, sf):
    m = fe.moments9(xyz(spark, sf), "x", "y", "z")
    return m.select("win", *[F.round(f"cf_a_{i}", 6).alias(f"cf_a_{i}") for i in (1, 2, 3)], *[(F.round(f"sk_a_{i}", 4) + 0.0).alias(f"sk_a_{i}") for i in (1, 2, 3)],
                    *[F.round(f"ku_a_{i}", 4).alias(f"ku_a_{i}") for i in (1, 2, 3)])


@query("e18_prepare_input", f"""with {_XYZ_SQL} select win, case when win % 6 = 5 then 'fifo_overrun' when win % 6 = 4 then 'UNSUPPORTED_PROFILE' when win % 6 = 3 then null when win % 6 = 0 then case when reason = 'sample_gap' then reason end else reason end as unavailable,
  case when win % 6 = 5 or win % 6 = 4 then null when win % 6 = 3 then 9 when win % 6 = 0 then case when reason is distinct from 'sample_gap' then 192 end when reason is null then case win % 6 when 1 then 21 else 66 end end as width from okw""")
def e18(spark, sf):
    w = xyz(spark, sf)
    m = F.col("win") % 6
    w = w.withColumns({"profile": F.when(m == 0, "raw").when(m == 1, "base21").when(m == 2, "spectral66").when(m == 3, "nine").otherwise("other"),
                       "quality": F.when(m == 5, "fifo_overrun").otherwise("valid"), "nine": F.slice("x", 1, 9)})
    p = fe.prepare_input(w, "profile", "x", "y", "z", "nine", "quality", 64)
    return p.select("win", "unavailable", F.when(F.col("model_input").isNotNull(), F.size("model_input")).alias("width"))


@query("e19_scenarios", """with v as (select p_partkey, case when p_size % 3 = 0 then 'NORMAL' else 'BALL' end as vl, row_number() over (order by sha256('7:' || p_partkey)) as i from part), a as (select s_suppkey, case when s_nationkey % 2 = 0 then 'NORMAL' else 'ABNORMAL' end as al, row_number() over (order by sha256('7:' || s_suppkey)) as j, count(*) over () as n from supplier)
  select p_partkey, s_suppkey, case when vl = 'NORMAL' and al = 'NORMAL' then 'normal' when al = 'NORMAL' then 'vibration_anomaly' when vl = 'NORMAL' then 'acoustic_anomaly' else 'combined_anomaly' end as scenario from v join a on (i - 1) % n + 1 = j""")
def e19(spark, sf):
    from ..operators.joins import pair_cyclic
    v = table(spark, sf, "part").select(F.lit(1).alias("g"), "p_partkey", F.when(F.col("p_size") % 3 == 0, "NORMAL").otherwise("BALL").alias("vl"))
    a = table(spark, sf, "supplier").select(F.lit(1).alias("g"), "s_suppkey", F.when(F.col("s_nationkey") % 2 == 0, "NORMAL").otherwise("ABNORMAL").alias("al"))
    return pair_cyclic(v, a, "g", "p_partkey", "s_suppkey", 7).select("p_partkey", "s_suppkey", fe.scenario(F.col("vl"), F.col("al")).alias("scenario"))


# ------------------------------------------------------------------ scoring

@query("x01_score_rms", f"""with {sql.POINTS}, b as (select asset, avg(value) as mean, stddev_pop(value) as std from points where event_type in ('view', 'click') and value < 120 group by asset), s as (
  select seq, case when event_type = 'signup' then null when k % 50 = 0 then -1.0 else value end as v, mean, std from points join b using (asset)), d as (
  select *, abs(v - mean) / std as dev, case when v >= 0 and std > 0 then cast(round_even(least(100.0, greatest(0.0, abs(v - mean) / std - 1) / 1 * 100.0), 0) as int) end as sc from s)
  select seq, sc as anomaly_score, case when sc is null then 'unavailable' when sc >= 75 then 'critical' when sc >= 50 then 'warning' else 'normal' end as anomaly_status, case when sc is not null then round(dev, 2) end as sigma from d""")
def x01(spark, sf):
    p = points(spark, sf)
    b = p.filter("event_type in ('view', 'click') and value < 120").groupBy("asset").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    s = p.join(b, "asset").withColumn("v", F.when(F.col("event_type") == "signup", None).when(F.col("k") % 50 == 0, -1.0).otherwise(F.col("value"))).withColumn("sg", F.lit(1.0))
    r = sc.score_rms(s, "v", "mean", "std", "sg")
    return r.select("seq", "anomaly_score", "anomaly_status", F.when(F.col("evidence").isNotNull(), F.round(F.abs(F.col("v") - F.col("mean")) / F.col("std"), 2)).alias("sigma"))


@query("x02_score_signals", f"""with {sql.POINTS}, t as (select seq, asset, value as vib, case when k % 6 > 0 then k / 100.0 end as ac, cast(k * 10 as double) as rpm, case when k % 5 = 0 then 'stale' else 'valid' end as rs, case when k % 7 = 0 then 'mm' else 'g' end as vu, 'raw' as au from points), e as (
  select seq, asset, f, v, u, rs from t, lateral (values ('acousticRmsRaw', ac, au), ('rpm', rpm, null), ('vibrationRmsRaw', vib, vu)) l(f, v, u)), b as (
  select s_suppkey as asset, f, lo, hi, sc, un from supplier, (values ('vibrationRmsRaw', 10.0, 60.0, 50.0, 'g'), ('acousticRmsRaw', 0.2, 0.5, 0.4, 'raw'), ('rpm', 200.0, 600.0, 300.0, 'rpm')) l(f, lo, hi, sc, un) where s_suppkey % 3 < 2 or f <> 'rpm'), j as (
  select seq, e.f, case when v is null or v < 0 then 'missing_or_invalid' when e.f = 'rpm' and rs <> 'valid' then 'rpm_not_measured' when e.f <> 'rpm' and u <> un then 'unit_mismatch' end as why,
   cast(round_even(least(100.0, greatest(lo - v, v - hi, 0.0) / sc * 100.0), 0) as int) as s from e join b on b.asset = e.asset and b.f = e.f), g as (
  select seq, max(case when why is null then s end) as anomaly_score, string_agg(f || ':' || coalesce(why, 'evaluated'), ',' order by f) as evidence from j group by seq)
  select seq, anomaly_score, coalesce(evidence, '') as evidence, case when anomaly_score is null then 'unavailable' when anomaly_score >= 75 then 'critical' when anomaly_score >= 50 then 'warning' else 'normal' end as anomaly_status from t left join g using (seq)""")
def x02(spark, sf):
    k = F.col("k")
    t = points(spark, sf).select("seq", "asset", F.col("value").alias("vib"), F.when(k % 6 > 0, k / 100.0).alias("ac"), (k * 10).cast("double").alias("rpm"),
                                 F.when(k % 5 == 0, "stale").otherwise("valid").alias("rs"), F.when(k % 7 == 0, "mm").otherwise("g").alias("vu"), F.lit("raw").alias("au"))
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(lo).alias("low"), F.lit(hi).alias("high"), F.lit(s).alias("scale"), F.lit(u).alias("unit_note")) for f, lo, hi, s, u in
                     (("vibrationRmsRaw", 10.0, 60.0, 50.0, "g"), ("acousticRmsRaw", 0.2, 0.5, 0.4, "raw"), ("rpm", 200.0, 600.0, 300.0, "rpm"))])
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("asset"), F.explode(rows).alias("b")).select("asset", "b.*").filter("asset % 3 < 2 or field <> 'rpm'")
    r = sc.score_signals(t, b, ["seq"], "asset", {"vibrationRmsRaw": ("vib", "vu"), "acousticRmsRaw": ("ac", "au"), "rpm": ("rpm", None)}, "rs")
    return r.withColumn("evidence", F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["field"], e["status"])), ","))


@query("x03_bind_baselines", """with r as (select c_custkey as rule_id, c_nationkey as site, c_custkey % 130 as asset, case when c_custkey % 10 = 0 then 'temp' else 'rpm' end as field, 'B' || (c_custkey % 130) as bv, 'rpm' as feature, case when c_custkey % 7 = 0 then 'hz' else 'rpm' end as unit_note, case when c_custkey % 9 = 0 then 0.0 else 2.0 end as scale from customer), b as (
  select 'B' || s_suppkey as v, s_nationkey as site, s_suppkey as asset, 'rpm' as feature, case when s_suppkey % 8 = 0 then 10.0 else 0.0 end as low, 5.0 as high from supplier)
  select rule_id, case when field = 'temp' then 'INVALID_SIGNAL_BASELINE' when b.v is null then 'SIGNAL_BASELINE_SCOPE' when low > high or scale <= 0 or unit_note <> 'rpm' then 'INVALID_SIGNAL_BASELINE' end as error_code from r left join b on b.v = r.bv and b.site = r.site and b.asset = r.asset""")
def x03(spark, sf):
    k = F.col("c_custkey")
    r = table(spark, sf, "customer").select(k.alias("rule_id"), F.col("c_nationkey").alias("site"), (k % 130).alias("asset"), F.when(k % 10 == 0, "temp").otherwise("rpm").alias("field"),
                                            F.concat(F.lit("B"), k % 130).alias("baseline_version"), F.lit("rpm").alias("feature"), F.when(k % 7 == 0, "hz").otherwise("rpm").alias("unit_note"),
                                            F.when(k % 9 == 0, 0.0).otherwise(2.0).alias("scale"))
    s = F.col("s_suppkey")
    b = table(spark, sf, "supplier").select(F.concat(F.lit("B"), s).alias("version"), F.col("s_nationkey").alias("site"), s.alias("asset"), F.lit("rpm").alias("feature"),
                                            F.when(s % 8 == 0, 10.0).otherwise(0.0).alias("low"), F.lit(5.0).alias("high"))
    return sc.bind_baselines(r, b).select("rule_id", "error_code")


@query("x04_feature_deviations", f"""with {sql.SNAPSHOTS}, e as (select vec_id, stream, unnest(x) as v, unnest(range(0, 9)) as f from snapshots), b as (select f, avg(v) as mean, stddev_pop(v) as std from e where stream < 5 group by f)
  select vec_id, 'f' || f as feature, round(abs(v - mean) / std, 6) as deviation_sigma, abs(v - mean) > 2 * std as outlier from e join b using (f)""")
def x04(spark, sf):
    s = snapshots(spark, sf)
    m = s.withColumn("m", F.map_from_entries(F.transform("x", lambda v, i: F.struct(F.concat(F.lit("f"), i).alias("k"), v.alias("v")))))
    b = s.filter("stream < 5").select(F.posexplode("x").alias("i", "v")).groupBy(F.concat(F.lit("f"), "i").alias("feature")).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    return sc.feature_deviations(m, "vec_id", "m", b, 2.0).select("vec_id", "feature", F.round("deviation_sigma", 6).alias("deviation_sigma"), "outlier")


@query("x04_stored_ranges", f"""with {sql.SNAPSHOTS}, e as (select vec_id, stream, unnest(x) as v, unnest(range(0, 9)) as f from snapshots), b as (
  select f, avg(v) as mean, case when f in (6, 7) then 0.0 else stddev_pop(v) end as std, case f when 5 then 9.0 when 6 then avg(v) - 0.25 when 8 then null else avg(v) - 0.5 end as low, case when f = 6 then avg(v) + 0.25 else avg(v) + 0.5 end as high
  from e where stream < 5 group by f), c as (select *, case when f in (5, 8) then 'INVALID_STORED_RANGE' when f = 7 then 'RANGE_DISAGREES_WITH_TOLERANCE' end as issue from b)
  select vec_id, 'f' || f as feature, case when issue is null and std <> 0 then round(abs(v - mean) / std, 6) end as deviation_sigma, case when issue is null then v < low or v > high end as outlier, issue as baseline_issue from e join c using (f)""")
def x04_stored(spark, sf):
    """Stored ranges: sound ones, a reversed one, one without a limit, and two of zero variance with and without the tolerance."""
    s = snapshots(spark, sf)
    m = s.withColumn("m", F.map_from_entries(F.transform("x", lambda v, i: F.struct(F.concat(F.lit("f"), i).alias("k"), v.alias("v")))))
    b = s.filter("stream < 5").select(F.posexplode("x").alias("f", "v")).groupBy("f").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("dev"))
    f, half = F.col("f"), F.when(F.col("f") == 6, 0.25).otherwise(0.5)
    b = b.select(F.concat(F.lit("f"), "f").alias("feature"), "mean", F.when(f.isin(6, 7), 0.0).otherwise(F.col("dev")).alias("std"),
                 F.when(f == 5, 9.0).when(f == 8, None).otherwise(F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))
    r = sc.feature_deviations(m, "vec_id", "m", b, None, 0.25)
    return r.select("vec_id", "feature", F.round("deviation_sigma", 6).alias("deviation_sigma"), "outlier", "baseline_issue")


_ACTIVE = [i for i in range(45) if i % 11 != 5]
_N = len(_ACTIVE)
MODEL = {"center": [0.01 * (i % 5) for i in range(45)], "scale": [0.2 + 0.05 * (i % 4) for i in range(45)], "active": _ACTIVE, "pca_mean": [0.02 * (i % 3) for i in range(_N)],
         "pca_axes": [[1.0 if i == 0 else 0.0 for i in range(_N)], [math.sqrt(0.5) if i in (1, 2) else 0.0 for i in range(_N)]], "thresholds": [4.0, 2.5]}
FORECAST = {"input_mean": [0.01 * (i % 3) for i in range(36)], "input_std": [0.3 + 0.01 * i for i in range(36)], "weights": [[math.cos(i * 3 + j) / 6 for j in range(9)] for i in range(36)],
            "target_mean": [1.4] * 9, "target_std": [0.5] * 9, "target_lower": [0.2] * 9, "target_upper": [3.0] * 9, "input_limit": 9.0,
            "center": [0.0] * 36, "scale": [0.2] * 36, "active": [i for i in range(36) if i % 7 != 3]}


def _list(xs):
    return "[" + ", ".join(repr(float(x)) + "::double" for x in xs) + "]"


_NOV_SQL = f"""{_REASON_SQL}, hx as (select c.vec_id, c.x, s.x as hx, row_number() over (partition by c.vec_id order by s.vec_id desc) as rn from cur c join s on s.stream = c.stream and s.vec_id < c.vec_id), mm as (
  select vec_id, any_value(x) as x, [{', '.join(f'avg(hx[{j}])' for j in range(1, 10))}] as mu, [{', '.join(f'stddev_pop(hx[{j}])' for j in range(1, 10))}] as sd, any_value(hx) filter (rn = 1) as lst from hx where rn <= 24 group by vec_id having count(*) = 24), vv as (
  select vec_id, list_concat(list_concat(list_concat(x, mu), list_concat(sd, list_transform(range(1, 10), lambda i: x[i] - lst[i]))), list_transform(range(1, 10), lambda i: x[i] - mu[i])) as v from mm), zz as (
  select vec_id, list_transform({[i + 1 for i in _ACTIVE]}, lambda i: (v[i] - ({_list(MODEL['center'])})[i]) / ({_list(MODEL['scale'])})[i]) as z from vv), cc as (
  select vec_id, z, list_transform(range(1, {_N + 1}), lambda i: least(20.0, greatest(-20.0, z[i])) - ({_list(MODEL['pca_mean'])})[i]) as c from zz), rr as (
  select vec_id, list_max(list_transform(z, lambda a: abs(a))) as robust, (list_sum(list_transform(c, lambda a: a * a)) - pow(c[1], 2) - pow((c[2] + c[3]) * sqrt(0.5), 2)) / {_N} as pca from cc)"""


@query("x05_novelty", f"with {_NOV_SQL} select vec_id, round(robust, 6) as robust, round(pca, 6) as pca, round(greatest(robust / 4.0, pca / 2.5), 6) as score from rr")
def x05(spark, sf):
    h = with_24(spark, sf).filter(F.size("history") == 24).withColumn("rows", F.transform("history", lambda e: e["x"]))
    return sc.novelty_score(h, "x", "rows", MODEL).select("vec_id", *[F.round(c, 6).alias(c) for c in ("robust", "pca", "score")])


_FC_SQL = f"""h13 as (select c.vec_id, s.x as hx, row_number() over (partition by c.vec_id order by s.vec_id desc) as rn from cur c join s on s.stream = c.stream and s.vec_id <= c.vec_id where not c.event), m13 as (
  select vec_id, any_value(hx) filter (rn = 1) as l, any_value(hx) filter (rn = 13) as o, [{', '.join(f'avg(hx[{j}])' for j in range(1, 10))}] as mu, [{', '.join(f'stddev_pop(hx[{j}])' for j in range(1, 10))}] as sd from h13 where rn <= 13 group by vec_id having count(*) = 13), v13 as (
  select vec_id, list_concat(list_concat(l, mu), list_concat(sd, list_transform(range(1, 10), lambda i: l[i] - o[i]))) as v from m13), fc as (
  select vec_id, list_max(list_transform({[i + 1 for i in FORECAST['active']]}, lambda i: abs(v[i] / 0.2))) as input_robust, [{', '.join(f"list_sum(list_transform(range(1, 37), lambda i: (v[i] - 0.01 * ((i - 1) % 3)) / (0.3 + 0.01 * (i - 1)) * cos((i - 1) * 3 + {j}) / 6)) * 0.5 + 1.4" for j in range(9))}] as f from v13), fg as (
  select *, case when input_robust > 9.0 then 'FORECAST_INPUT_OUT_OF_DISTRIBUTION' when list_min(f) < 0.2 or list_max(f) > 3.0 or least(f[1], f[2], f[3], f[7], f[8], f[9]) < 1 then 'FORECAST_OUTPUT_OUT_OF_RANGE' end as why from fc)"""


@query("x06_forecast", f"with {_REASON_SQL}, {_FC_SQL} select vec_id, round(f[1], 6) as f0, round(f[5], 6) as f4, round(f[9], 6) as f8 from fg")
def x06(spark, sf):
    f = sc.forecast(_thirteen(spark, sf), "rows", FORECAST)
    return f.select("vec_id", *[F.round(F.col("forecast")[j], 6).alias(f"f{j}") for j in (0, 4, 8)])


def _thirteen(spark, sf):
    h = with_24(spark, sf, 12).filter((F.size("history") == 12) & ~F.col("event"))
    return h.withColumn("rows", F.concat(F.transform("history", lambda e: e["x"]), F.array("x")))


@query("x07_forecast_guard", f"with {_REASON_SQL}, {_FC_SQL} select vec_id, round(input_robust, 6) as input_robust, why as forecast_reason from fg")
def x07(spark, sf):
    g = sc.forecast_guard(sc.forecast(_thirteen(spark, sf), "rows", FORECAST), FORECAST)
    return g.select("vec_id", F.round("input_robust", 6).alias("input_robust"), "forecast_reason")


@query("x08_evaluate_snapshots", f"""with {_NOV_SQL}, {_FC_SQL}, j12 as (select c.vec_id, c.event, c.captured_us, c.uptime_us, s.vec_id as hv, s.valid as hvalid, s.captured_us as hc, s.uptime_us as hu, s.dc, s.du, row_number() over (partition by c.vec_id order by s.vec_id desc) as rn from cur c left join s on s.stream = c.stream and s.vec_id < c.vec_id), r12 as (
  select vec_id, any_value(event) as event, count(hv) as n, bool_and(hvalid) as ok, bool_and(rn = 12 or (abs(dc / 1e6 - 25) <= 1.000001 and abs((dc - du) / 1e6) <= 1.000001)) as cont, max(case when rn = 1 then (captured_us - hc) / 1e6 end) as delay, max(case when rn = 1 then (uptime_us - hu) / 1e6 end) as up from j12 where rn <= 12 group by vec_id), f12 as (
  select vec_id, case when event then 'FORECAST_REQUIRES_SCHEDULED_RECORD' when n <> 12 then 'FORECAST_HISTORY_INSUFFICIENT' when not ok then 'FORECAST_HISTORY_QUALITY_OR_SCOPE' when not cont or not (abs(delay - 25) <= 1.000001 and abs(delay - up) <= 1.000001 and up > 0) then 'FORECAST_HISTORY_DISCONTINUITY' end as why from r12)
  select c.vec_id, case when r.reason is null then 'completed' else 'unavailable' end as status, 'VERIFIER_' || r.reason as reason, case when r.reason is null then round(greatest(robust / 4.0, pca / 2.5), 6) end as score, case when r.reason is null then greatest(robust / 4.0, pca / 2.5) > 1 end as verdict,
    case when c.event then 'not_applicable' when coalesce(f12.why, fg.why) is null then 'completed' else 'unavailable' end as forecast_status, coalesce(f12.why, fg.why) as forecast_reason
  from cur c join reasons r using (vec_id) left join rr using (vec_id) join f12 using (vec_id) left join fg using (vec_id)""")
def x08(spark, sf):
    e = sc.evaluate_snapshots(with_24(spark, sf), MODEL, FORECAST)
    return e.select("vec_id", "status", "reason", F.round("score", 6).alias("score"), "verdict", "forecast_status", "forecast_reason")


@query("x09_scaler", f"""with {sql.SNAPSHOTS}, e as (select vec_id, unnest(x) as v, unnest(range(0, 9)) as f from snapshots), b as (select f, avg(v) as mean, stddev_pop(v) as std from e group by f)
  select vec_id, round(sum(abs((v - mean) / std)), 6) as total, round(max((v - mean) / std), 6) as top from e join b using (f) group by vec_id""")
def x09(spark, sf):
    s = snapshots(spark, sf)
    z = sc.scale(s, "x", sc.fit_scaler(s, "x"))
    return z.select("vec_id", F.round(F.aggregate("scaled", F.lit(0.0), lambda a, v: a + F.abs(v)), 6).alias("total"), F.round(F.array_max("scaled"), 6).alias("top"))


_W = lambda n, m, s: [[math.sin(s + i * 7 + j * 3) / 3 for j in range(m)] for i in range(n)]
NAMES9 = [f"f{i}" for i in range(9)]
DENSE = {"names": NAMES9, "feature_names": NAMES9, "mean": [0.0] * 9, "std": [0.5] * 9, "threshold": 0.9, "checksum": "sha256:demo", "expected_checksum": "sha256:demo",
         "layers": [(_W(16, 9, 1), [0.1] * 16), (_W(8, 16, 2), [0.0] * 8), (_W(16, 8, 3), [0.05] * 16), (_W(9, 16, 4), [0.0] * 9)]}
LSTM = {**DENSE, "encoder": (_W(32, 9, 1), _W(32, 8, 2), [0.0] * 32), "decoder": (_W(32, 8, 3), _W(32, 8, 4), [0.1] * 32), "output": (_W(9, 8, 5), [0.0] * 9)}


def _layer(src, out, n, m, s, b, relu):
    body = f"list_sum(list_transform(range(0, {m}), lambda j: {src}[j + 1] * sin({s} + i * 7 + j * 3) / 3)) + {b}"
    return f"list_transform(range(0, {n}), lambda i: {'greatest(0.0, ' + body + ')' if relu else body}) as {out}"


@query("x10_autoencoder_dense", f"""with {sql.SNAPSHOTS}, a as (select vec_id, list_transform(x, lambda v: v / 0.5) as z from snapshots), b as (select *, {_layer('z', 'h1', 16, 9, 1, 0.1, True)} from a), c as (select *, {_layer('h1', 'h2', 8, 16, 2, 0.0, True)} from b), d as (
  select *, {_layer('h2', 'h3', 16, 8, 3, 0.05, True)} from c), e as (select *, {_layer('h3', 'o', 9, 16, 4, 0.0, False)} from d), g as (select vec_id, list_avg(list_transform(range(1, 10), lambda i: pow(o[i] - z[i], 2))) as err from e)
  select vec_id, round(err, 3) as error, 'completed' as status from g""")
def x10(spark, sf):
    s = sc.score_autoencoder(snapshots(spark, sf), "x", DENSE)
    return s.select("vec_id", F.round("error", 3).alias("error"), "status")


@query("x10_autoencoder_lstm")
def x10l(spark, sf):
    from ..operators.sequence import make_sequences
    s = snapshots(spark, sf)
    n = numbered(s, ["stream"], ["vec_id"], declared_split("vec_id"), "idx")
    q = make_sequences(n, ["stream"], "idx", 5, F.col("x"), declared_split("idx"))
    return sc.score_autoencoder(q, "sequence", LSTM, True).select("stream", "start_idx", F.round("error", 4).alias("error"), "status")


@query("x12_apply_threshold", f"""with {sql.POINTS}, s as (select seq, score, cast(k as double) as thr, ['>', '>=', '<', '<='][k % 4 + 1] as op, case when k % 13 = 0 then 'MODEL_BUSY' end as r from points)
  select seq, case when r is null and score is not null then 'completed' else 'unavailable' end as status, case when r is null and score is not null then case op when '>' then score > thr when '>=' then score >= thr when '<' then score < thr else score <= thr end end as verdict,
   case when r is not null then r when score is null then 'INVALID_MODEL_OUTPUT' end as why from s""")
def x12(spark, sf):
    k = F.col("k")
    s = points(spark, sf).select("seq", "score", k.cast("double").alias("thr"), F.element_at(F.array(*[F.lit(o) for o in (">", ">=", "<", "<=")]), (k % 4 + 1).cast("int")).alias("op"),
                                 F.when(k % 13 == 0, "MODEL_BUSY").alias("r"))
    return sc.apply_threshold(s, "score", "thr", "op", "r").select("seq", "status", "verdict", "why")


@query("x13_result_status", f"""with {sql.WINDOWS}, m as (select s_suppkey as device, 'p' || (s_nationkey % 2) as profile, s_acctbal > 2000 as ok from supplier), j as (
  select ordinal, quality, captured_us, k % 3 = 0 as inferred, m.ok, m.device is not null as has from windows w left join m on m.device = w.device and m.profile = 'p' || (w.k % 2))
  select ordinal, case when quality <> 'valid' or captured_us < 1705000000000000 then 'unavailable' when not has then 'waiting_model' when not ok then 'unavailable' when inferred then 'completed' else 'queued' end as status,
    case when quality <> 'valid' then quality when captured_us < 1705000000000000 then 'MEASUREMENT_EXPIRED' when not has then 'MODEL_NOT_CONFIGURED' when not ok then 'MODEL_INPUT_CONTRACT_MISMATCH' end as status_reason from j""")
def x13(spark, sf):
    from ..sources.tables import windows
    w = windows(spark, sf).select("ordinal", "device", "quality", "captured_us", F.concat(F.lit("p"), F.col("k") % 2).alias("profile"), (F.col("k") % 3 == 0).alias("inferred"))
    m = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("device"), F.concat(F.lit("p"), F.col("s_nationkey") % 2).alias("profile"),
                                                                    F.lit("m1").alias("model"), (F.col("s_acctbal") > 2000).alias("contract_ok"))
    return sc.result_status(w, m, F.lit(1705000000000000), 0).select("ordinal", "status", "status_reason")


@query("x14_score_windows")
def x14(spark, sf):
    b = fe.base21(xyz(spark, sf), "x", "y", "z", 64)
    model = {"names": fe.BASE21, "feature_names": fe.BASE21, "mean": [0.0] * 21, "std": [1.0] * 21, "threshold": 2.0, "checksum": "c", "expected_checksum": "c",
             "layers": [(_W(16, 21, 1), [0.1] * 16), (_W(8, 16, 2), [0.0] * 8), (_W(16, 8, 3), [0.05] * 16), (_W(21, 16, 4), [0.0] * 21)]}
    return sc.score_autoencoder(b, "features", model).select("win", "reason", F.round("error", 3).alias("error"), "verdict", "status")


@query("p01_score_with", f"with {sql.POINTS} select seq, value * 2 + k as score, value * 2 + k > 150 as verdict, 'completed' as status from points")
def p01(spark, sf):
    return sc.score_with(points(spark, sf), lambda d: d["value"] * 2 + d["k"], ["value", "k"], ["seq"], 150.0).select("seq", "score", "verdict", "status")
