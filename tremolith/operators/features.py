"""Waveform rows to feature rows.  Moments stay native; spectra run as Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import spectra as sp
from ..functions.numeric import finite

RATE = 800.0
G_PER_COUNT = 0.0039
EDGES = (0, 500, 1000, 2000, 4000, 8000)
AXIS_NAMES = ("rms_ac_g", "peak_ac_g", "kurtosis_pearson", "power_0_50_g2", "power_50_100_g2", "power_100_200_g2", "power_200_350_g2")
BASE21 = [f"vibration{axis}.{name}" for axis in "XYZ" for name in AXIS_NAMES]
SHAPE_NAMES = tuple(f"ratio_{lo}_{hi}" for lo, hi in sp.RATIO_BANDS) + (
    "entropy_normalized", "centroid_hz", "bandwidth_hz", "peak_hz", "peak_power_fraction", "rolloff85_hz")
SPECTRAL66 = BASE21 + [f"vibration{axis}.{name}" for axis in "XYZ" for name in SHAPE_NAMES] + ["correlation.XY", "correlation.XZ", "correlation.YZ"]
RESULT = "values array<double>, reason string"


def _batches(series: pd.Series, width: int | None = None):
    """Row positions grouped by array length, so each group is one rectangular NumPy batch."""
    sizes = np.array([-1 if v is None else len(v) for v in series])
    for n in np.unique(sizes):
        if n > 0 and (width is None or n == width):
            at = np.flatnonzero(sizes == n)
            yield at, np.stack([np.asarray(series.iloc[i], dtype=np.float64) for i in at])


def _array_kernel(fn):
    """Wrap ``fn((N, n)) -> (N, m)`` as an Arrow function column; unusable rows give null."""
    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        out = [None] * len(v)
        for at, x in _batches(v):
            usable = np.isfinite(x).all(-1)
            if usable.any():
                for i, row in zip(at[usable], fn(x[usable])):
                    out[i] = row
        return pd.Series(out)
    return run


def _xyz_kernel(fn, samples: int, rate: float):
    """Wrap ``fn((N, 3, n)) -> (values, reason)``; null values always come with a reason."""
    @F.pandas_udf(RESULT)
    def run(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.DataFrame:
        values, reason = [None] * len(x), np.full(len(x), "sample_gap", dtype=object)
        whole = np.array([all(a is not None and len(a) == samples for a in t) for t in zip(x, y, z)], dtype=bool)
        at = np.flatnonzero(whole)
        if len(at):
            w = np.stack([np.stack([np.asarray(s.iloc[i], dtype=np.float64) for i in at]) for s in (x, y, z)], 1)
            v, why = fn(w, rate)
            why = np.where((why == "") & ~np.isfinite(v).all(-1), "nonfinite_features", why)
            for i, row, r in zip(at, v, why):
                values[i], reason[i] = (row, None) if r == "" else (None, r)
        return pd.DataFrame({"values": values, "reason": reason})
    return run


# ------------------------------------------------------------------ windowing

def segment(df: DataFrame, samples: str, size: int, hop: int) -> DataFrame:
    """Fixed windows with a hop; an incomplete tail is dropped; the sample span is kept."""
    starts = F.when(F.size(samples) >= size, F.sequence(F.lit(0), F.size(samples) - size, F.lit(hop)))
    return df.select("*", F.explode(starts).alias("start")).withColumns(
        {"window": F.slice(F.col(samples), F.col("start") + 1, size), "end": F.col("start") + size}).drop(samples)


# ------------------------------------------------------------------ audio / bearing features

def features_named(df: DataFrame, samples: str, rate: float, size: int = 2048, hop: int = 512, n_mfcc: int = 13,
                   edges: tuple = EDGES, peak: bool = False, n_mels: int = 128) -> DataFrame:
    """Feature vector in alphabetical name order; with ``peak`` the peak frequency joins as one more."""
    names = sorted(feature_names(n_mfcc, edges, peak))

    def fn(x):
        f = sp.features26(x, rate, size, hop, n_mfcc, edges, n_mels)
        if peak:
            f["vibration_peak_hz"] = sp.peak_hz(x, rate)
        return np.stack([f[n] for n in names], -1)
    return df.withColumn("features", _array_kernel(fn)(F.col(samples)))


def feature_names(n_mfcc: int = 13, edges: tuple = EDGES, peak: bool = False) -> list[str]:
    names = ["rms_mean", "rms_std", "zcr_mean", "kurtosis_mean", "kurtosis_std", "spectral_centroid", "spectral_bandwidth", "spectral_rolloff"]
    names += [f"band_{lo}_{hi}Hz" for lo, hi in zip(edges, edges[1:])] + [f"mfcc_{i + 1}" for i in range(n_mfcc)]
    return names + (["vibration_peak_hz"] if peak else [])


def frame_stats(df: DataFrame, samples: str, size: int, hop: int) -> DataFrame:
    order = ("rms_mean", "rms_std", "zcr_mean", "kurtosis_mean", "kurtosis_std")
    def fn(x):
        f = sp.frame_stats(x, size, hop)
        return np.stack([f[n] for n in order], -1)
    return _named(df, samples, fn, order)


def band_energy(df: DataFrame, samples: str, rate: float, edges: tuple = EDGES) -> DataFrame:
    order = [f"band_{lo}_{hi}Hz" for lo, hi in zip(edges, edges[1:])]
    return _named(df, samples, lambda x: np.stack(list(sp.band_energy(x, rate, edges).values()), -1), order)


def spectral_shape(df: DataFrame, samples: str, rate: float) -> DataFrame:
    order = ("spectral_centroid", "spectral_bandwidth", "spectral_rolloff")
    return _named(df, samples, lambda x: np.stack(list(sp.spectral_shape(x, rate).values()), -1), order)


def mfcc(df: DataFrame, samples: str, rate: float, n: int = 13, size: int = 2048, hop: int = 512, n_mels: int = 128) -> DataFrame:
    return df.withColumn("mfcc", _array_kernel(lambda x: sp.mfcc_mean(x, rate, n, size, hop, n_mels))(F.col(samples)))


def rms_peak(df: DataFrame, samples: str, rate: float) -> DataFrame:
    """RMS in the JVM, peak frequency as an Arrow batch."""
    peak = _array_kernel(lambda x: sp.peak_hz(x, rate)[:, None])
    rms = F.sqrt(F.aggregate(samples, F.lit(0.0), lambda a, v: a + v * v) / F.size(samples))
    return df.withColumns({"rms": rms, "peak_hz": peak(F.col(samples))[0]})


def vibration_features(df: DataFrame, samples: str, rate: float) -> DataFrame:
    order = ("rms", "std", "kurtosis", "peak", "crest", "peak_hz")
    return _named(df, samples, lambda x: sp.vibration_summary(x, rate), order)


def edge_statistics(df: DataFrame, samples: str, block: int) -> DataFrame:
    order = ("rms", "peak", "kurtosis", "band0", "band1", "band2")
    out = _named(df, samples, lambda x: sp.edge_statistics(x, block), order)
    return out.withColumn("kurtosis", F.when(~F.isnan("kurtosis"), F.col("kurtosis")))


def _named(df: DataFrame, samples: str, fn, names) -> DataFrame:
    k = df.withColumn("__f", _array_kernel(fn)(F.col(samples)))
    return k.select(*df.columns, *[F.col("__f")[i].alias(n) for i, n in enumerate(names)])


# ------------------------------------------------------------------ XYZ window features

def base21(df: DataFrame, x: str, y: str, z: str, samples: int = 512, rate: float = RATE) -> DataFrame:
    """21 features and a reason; a window that cannot be measured has null features, never zeros."""
    return df.withColumn("__r", _xyz_kernel(sp.base21, samples, rate)(x, y, z)).select(*df.columns, F.col("__r.values").alias("features"), "__r.reason")


def spectral66(df: DataFrame, x: str, y: str, z: str, samples: int = 512, rate: float = RATE) -> DataFrame:
    """66 features; the first 21 are rounded through single precision as the transport does."""
    r = df.withColumn("__r", _xyz_kernel(sp.spectral66, samples, rate)(x, y, z))
    v = F.col("__r.values")
    return r.select(*df.columns, round32(v, 21).alias("features"), "__r.reason")


def round32(values: Column, first: int) -> Column:
    """Leading values through float32 and back."""
    return F.transform(values, lambda v, i: F.when(i < first, v.cast("float").cast("double")).otherwise(v))


def derive_variant(df: DataFrame, values: str, variant: str) -> DataFrame:
    """base21, ratios36 or log_ratios36 with a reason for invalid vectors; all in the JVM."""
    if variant not in ("base21", "ratios36", "log_ratios36"):
        raise ValueError("unknown variant")
    v = F.col(values)
    at = lambda o, i: F.get(v, F.lit(o + i))
    usable = (F.size(v) == 21) & F.forall(v, lambda e: finite(e) & e.between(0, 1e12))
    axis_ok = [(at(o, 0) > 1e-8) & (at(o, 1) >= at(o, 0) * (1 - 1e-9)) & (at(o, 2) >= 1 - 1e-9) for o in (0, 7, 14)]
    total = {o: at(o, 3) + at(o, 4) + at(o, 5) + at(o, 6) for o in (0, 7, 14)}
    good = lambda c: F.coalesce(c, F.lit(False))
    reason = F.when(~good(usable), "INVALID_FEATURES").when(~good(axis_ok[0] & axis_ok[1] & axis_ok[2]), "INVALID_RMS_PEAK_OR_KURTOSIS")
    out = v
    if variant != "base21":
        reason = reason.when(~good((total[0] > 1e-16) & (total[7] > 1e-16) & (total[14] > 1e-16)), "INSUFFICIENT_BAND_ENERGY")
        extra = [e for o in (0, 7, 14) for e in (*[at(o, i) / total[o] for i in (3, 4, 5, 6)], at(o, 1) / at(o, 0))]
        if variant == "log_ratios36":
            out = F.transform(v, lambda e, i: F.when(i % 7 < 2, F.log1p(e / 0.01)).when(i % 7 == 2, e).otherwise(F.log1p(e / 0.0001)))
        out = F.concat(out, F.array(*extra))
    return df.withColumn("reason", reason).withColumn("derived", F.when(F.col("reason").isNull(), out))


def counts_to_g(df: DataFrame, counts: str) -> DataFrame:
    """Counts to g; any sample on a rail marks the whole window clipped."""
    c = F.col(counts)
    clipped = F.exists(c, lambda v: (v <= -4096) | (v >= 4095))
    return df.withColumns({"reason": F.when(clipped, "clipped"), "g": F.when(~clipped, F.transform(c, lambda v: v * F.lit(G_PER_COUNT)))})


def quantize(df: DataFrame, g: str) -> DataFrame:
    """Resolution stress: nearest-even counts and back, rails rejected."""
    q = df.withColumn("__q", F.transform(F.col(g), lambda v: F.rint(v / F.lit(G_PER_COUNT))))
    clipped = F.exists("__q", lambda v: (v <= -4096) | (v >= 4095))
    return q.withColumns({"reason": F.when(clipped, "clipped"), "quantized": F.when(~clipped, F.transform("__q", lambda v: v * F.lit(G_PER_COUNT)))}).drop("__q")


def augment_even(df: DataFrame, start: str, clean: str, quantized: str) -> DataFrame:
    return df.withColumn("augmented", F.when(F.col(start) % 2 == 0, F.col(quantized)).otherwise(F.col(clean)))


def moments9(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """Crest factor of the raw signal, skewness and Pearson kurtosis of the centred one, per axis."""
    out = df
    for i, c in enumerate((x, y, z), 1):
        n = F.size(c).cast("double")
        total = lambda f: F.aggregate(F.col(c), F.lit(0.0), lambda a, v: a + f(v))
        out = out.withColumn(f"__m{i}", F.aggregate(F.col(c), F.lit(0.0), lambda a, v: a + v) / n)
        m = F.col(f"__m{i}")
        power = lambda k: F.aggregate(F.transform(F.col(c), lambda v: F.pow(v - m, F.lit(float(k)))), F.lit(0.0), lambda a, v: a + v) / n
        out = out.withColumns({f"__v{i}": power(2), f"__s{i}": power(3), f"__k{i}": power(4),
                               f"cf_a_{i}": F.array_max(F.transform(F.col(c), lambda v: F.abs(v))) / F.sqrt(total(lambda v: v * v) / n)})
        v = F.col(f"__v{i}")
        out = out.withColumns({f"sk_a_{i}": F.when(v > 0, F.col(f"__s{i}") / F.pow(v, F.lit(1.5))), f"ku_a_{i}": F.when(v > 0, F.col(f"__k{i}") / (v * v))})
    return out.drop(*[f"__{p}{i}" for p in "mvsk" for i in (1, 2, 3)])


def measured_vibration(df: DataFrame, rms: list[str], spectrum: list[str], bin_hz: float = 1.5625) -> DataFrame:
    """Vector RMS and the dominant frequency of the summed spectrum (first bin on ties, none when empty)."""
    r = F.sqrt(sum((F.col(c) * F.col(c) for c in rms[1:]), F.col(rms[0]) * F.col(rms[0])))
    a, b, c = (F.col(s) for s in spectrum)
    powers = F.zip_with(F.zip_with(a, b, lambda p, q: p + q), c, lambda p, q: p + q)
    p = df.withColumn("__p", powers)
    top = F.array_max("__p")
    ready = F.size("__p") > 0
    return p.withColumns({
        "vibration_rms_g": r, "rms_status": F.when(r.isNull(), "unavailable").otherwise("available"),
        "dominant_hz": F.when(ready & (top > 0), F.array_position(F.col("__p"), top) * bin_hz),
        "frequency_status": F.when(~F.coalesce(ready, F.lit(False)) | top.isNull(), "unavailable").when(top > 0, "available").otherwise("no_peak")}).drop("__p")


def prepare_input(df: DataFrame, profile: str, x: str, y: str, z: str, features: str, quality: str, samples: int = 512,
                  rate: float = RATE) -> DataFrame:
    """Model input by declared profile: raw, base21, spectral66 or nine features; otherwise a reason, never padding."""
    keys = df.columns
    ok = F.col(quality) == "valid"
    no = lambda d, why: d.select(*keys, F.lit(None).cast("array<double>").alias("model_input"), why.alias("unavailable"))
    live = df.filter(ok)
    nine = (F.size(features) == 9) & F.forall(features, lambda v: finite(v))
    parts = [no(df.filter(~ok), F.col(quality)), no(live.filter(~F.col(profile).isin("raw", "base21", "spectral66", "nine")), F.lit("UNSUPPORTED_PROFILE")),
             live.filter(F.col(profile) == "nine").select(*keys, F.when(nine, F.col(features)).alias("model_input"),
                                                          F.when(~F.coalesce(nine, F.lit(False)), "INPUT_PREPARATION_FAILED").alias("unavailable"))]
    whole = (F.size(x) == samples) & (F.size(y) == samples) & (F.size(z) == samples)
    flat = F.flatten(F.transform(F.arrays_zip(x, y, z), lambda s: F.array(s[x], s[y], s[z])))
    parts.append(live.filter(F.col(profile) == "raw").select(*keys, F.when(whole, flat).alias("model_input"), F.when(~F.coalesce(whole, F.lit(False)), "sample_gap").alias("unavailable")))
    b = base21(live.filter(F.col(profile) == "base21"), x, y, z, samples, rate) if features != "features" else None
    if b is None:
        raise ValueError("the nine-feature column must not be called 'features'")
    parts.append(b.select(*keys, round32(F.col("features"), 21).alias("model_input"), F.col("reason").alias("unavailable")))
    s = spectral66(live.filter(F.col(profile) == "spectral66"), x, y, z, samples, rate)
    parts.append(s.select(*keys, F.col("features").alias("model_input"), F.col("reason").alias("unavailable")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def decimate(df: DataFrame, run: str, pos: str, value: str, factor: int = 16, trim: int = 32, taps: int = 1025,
             cutoff: float = 350.0, rate: float = 12800.0, block: int = 16_384) -> DataFrame:
    """Low-pass and keep every ``factor``-th sample of long recordings, edges trimmed.

    A recording is cut into blocks; samples within half a filter of a border are copied to the
    neighbour block, so each block filters on its own and no task holds a whole recording.
    """
    half = taps // 2
    if block % factor or trim * factor < half:
        raise ValueError("block must be a multiple of the factor and the trim must cover the filter")
    h = sp.lowpass(taps, cutoff, rate)
    b = F.floor(F.col(pos) / block)
    offset = F.col(pos) - b * block
    # one filter half may span several small blocks
    reach = half // block + 1
    near = F.array_distinct(F.array(*[F.floor((F.col(pos) + d) / block) for d in (-half, 0, half)])) if reach == 1 else F.sequence(
        F.floor((F.col(pos) - half) / block), F.floor((F.col(pos) + half) / block))
    spread = df.select(run, pos, value, F.explode(near).alias("__blk")).filter("__blk >= 0")
    packed = spread.groupBy(run, "__blk").agg(F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(value).cast("double").alias("v")))).alias("s"))
    length = df.groupBy(run).agg((F.max(pos) + 1).alias("__n"))
    j = packed.join(length, run).select(run, "__blk", "__n", F.element_at("s", 1)["p"].alias("first"), F.transform("s", lambda e: e["v"]).alias("v"))

    @F.pandas_udf("array<struct<j:bigint,y:double>>")
    def filt(blk: pd.Series, n: pd.Series, first: pd.Series, v: pd.Series) -> pd.Series:
        out = []
        for b_, n_, f_, x in zip(blk, n, first, v):
            lo, hi = b_ * block // factor, (b_ + 1) * block // factor
            last = -(-n_ // factor) - trim
            js = np.arange(max(lo, trim), min(hi, last))
            if len(js) == 0:
                out.append([])
                continue
            view = np.lib.stride_tricks.sliding_window_view(np.asarray(x, dtype=np.float64), taps)
            y = view[js * factor - half - f_] @ h[::-1]
            out.append([{"j": int(a), "y": float(c)} for a, c in zip(js, y)])
        return pd.Series(out)

    e = j.select(run, F.explode(filt("__blk", "__n", "first", "v")).alias("o"))
    return e.select(run, (F.col("o.j") - trim).alias(pos), F.col("o.y").alias(value))


def scenario(vibration: Column, acoustic: Column) -> Column:
    """Four-way scenario of a vibration and an acoustic label."""
    v, a = vibration == "NORMAL", acoustic == "NORMAL"
    return F.when(v & a, "normal").when(~v & a, "vibration_anomaly").when(v & ~a, "acoustic_anomaly").otherwise("combined_anomaly")
