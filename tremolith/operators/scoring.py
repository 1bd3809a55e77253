"""Scores, novelty, forecasts, adapters and result status."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import models as md, spectra as sp
from ..functions.numeric import finite, half_even
from .sequence import history_reason


def status_of(score: Column) -> Column:
    return F.when(score.isNull(), "unavailable").when(score >= 75, "critical").when(score >= 50, "warning").otherwise("normal")


def score_rms(df: DataFrame, value: str, mean: str, std: str, sigma: str) -> DataFrame:
    """0 inside k sigma, rising linearly to 100 at 2k sigma; null or negative input is unavailable."""
    v = F.col(value)
    dev = F.abs(v - F.col(mean)) / F.col(std)
    ok = finite(v) & (v >= 0) & (F.col(std) > 0)
    raw = F.least(F.lit(100.0), F.greatest(F.lit(0.0), dev - F.col(sigma)) / F.col(sigma) * 100.0)
    out = df.withColumn("anomaly_score", F.when(ok, half_even(raw).cast("int")))
    return out.withColumns({
        "anomaly_status": status_of(F.col("anomaly_score")),
        "evidence": F.when(ok, F.struct(v.alias("value"), F.col(mean).alias("mean"), F.col(std).alias("std"), half_even(dev, 3).alias("deviation_sigma"),
                                        (F.col(mean) - F.col(sigma) * F.col(std)).alias("low"), (F.col(mean) + F.col(sigma) * F.col(std)).alias("high")))})


def score_signals(df: DataFrame, bindings: DataFrame, point: list[str], asset: str, signals: dict[str, tuple[str, str | None]],
                  rpm_status: str) -> DataFrame:
    """Range score per bound signal and the maximum of the available ones; a point without bound signals is unavailable.

    ``signals`` maps a field name to its value column and unit column (null for rpm);
    ``bindings``: asset, field, low, high, scale, unit_note, rule_version.
    """
    entry = lambda f, v, u: F.struct(F.lit(f).alias("field"), F.col(v).alias("value"), (F.col(u) if u else F.lit(None).cast("string")).alias("unit"))
    e = df.select(*point, F.col(asset).alias("__asset"), F.col(rpm_status).alias("__rpm"),
                  F.explode(F.array(*[entry(f, v, u) for f, (v, u) in signals.items()])).alias("s"))
    b = bindings.select(F.col(asset).alias("__basset"), F.col("field").alias("__field"), "low", "high", "scale", "unit_note")
    j = e.join(b, (F.col("__asset") == F.col("__basset")) & (F.col("s.field") == F.col("__field")), "left")
    bound = F.col("__field").isNotNull()
    v = F.col("s.value")
    why = (F.when(~F.coalesce(finite(v) & (v >= 0), F.lit(False)), "missing_or_invalid")
           .when((F.col("s.field") == "rpm") & ~F.col("__rpm").eqNullSafe("valid"), "rpm_not_measured")
           .when((F.col("s.field") != "rpm") & ~F.col("s.unit").eqNullSafe(F.col("unit_note")), "unit_mismatch"))
    distance = F.greatest(F.col("low") - v, v - F.col("high"), F.lit(0.0))
    score = F.when(bound & why.isNull(), half_even(F.least(F.lit(100.0), distance / F.col("scale") * 100.0)).cast("int"))
    g = j.select(*point, bound.alias("__bound"), F.col("s.field").alias("field"), score.alias("score"), F.coalesce(why, F.lit("evaluated")).alias("status"))
    # a point meets at most one binding per field, so its evidence list is bounded by the field list
    g = g.groupBy(*point).agg(F.max("score").alias("anomaly_score"), F.sort_array(F.collect_list(F.when(F.col("__bound"), F.struct("field", "status", "score")))).alias("evidence"))
    return g.withColumn("anomaly_status", status_of(F.col("anomaly_score")))


def bind_baselines(rules: DataFrame, baselines: DataFrame) -> DataFrame:
    """Rule selections joined to baselines with the first failing check as error code.

    ``rules``: rule_id, site, asset, field, baseline_version, feature, unit_note, scale;
    ``baselines``: version, site, asset, feature, low, high.
    """
    b = baselines.select(F.col("version").alias("__v"), F.col("site").alias("__s"), F.col("asset").alias("__a"), F.col("feature").alias("__f"), "low", "high")
    versions = baselines.select(F.col("version").alias("__kv"), F.col("site").alias("__ks"), F.col("asset").alias("__ka")).distinct()
    j = (rules.join(versions, (F.col("baseline_version") == F.col("__kv")) & (F.col("site") == F.col("__ks")) & (F.col("asset") == F.col("__ka")), "left")
         .join(b, (F.col("baseline_version") == F.col("__v")) & (F.col("site") == F.col("__s")) & (F.col("asset") == F.col("__a")) & (F.col("feature") == F.col("__f")), "left"))
    limit = 1e100
    bounds = finite("low") & finite("high") & (F.col("low") <= F.col("high")) & (F.abs("low") <= limit) & (F.abs("high") <= limit)
    unit = (F.trim("unit_note") != "") & (F.length("unit_note") <= 200) & ((F.col("field") != "rpm") | (F.col("unit_note") == "rpm"))
    bad = lambda c: ~F.coalesce(c, F.lit(False))
    code = (F.when(bad(F.col("field").isin("vibrationRmsRaw", "acousticRmsRaw", "rpm") & (F.trim("feature") != "")), "INVALID_SIGNAL_BASELINE")
            .when(F.col("__kv").isNull(), "SIGNAL_BASELINE_SCOPE")
            .when(bad(bounds & finite("scale") & (F.col("scale") > 0) & (F.col("scale") <= limit) & unit), "INVALID_SIGNAL_BASELINE"))
    return j.select(*rules.columns, "low", "high", code.alias("error_code"))


def feature_deviations(df: DataFrame, key: str, features: str, baseline: DataFrame, sigma: float | None = 3.0, tolerance: float | None = None) -> DataFrame:
    """Per feature the distance from its baseline in sigmas and whether it is an outlier.

    Without ``tolerance`` the range is recomputed as mean +/- sigma * std and zero variance is skipped; with it
    the stored range decides and a zero-variance feature has no sigma but keeps its absolute tolerance.  A stored range that
    is not finite, is reversed, or for zero variance is not mean +/- tolerance judges nothing; ``baseline_issue`` names it.
    """
    if tolerance is not None and not 0 <= tolerance < float("inf"):
        raise ValueError("tolerance must be a finite number, not below zero")
    e = df.select(key, F.explode(features).alias("feature", "value")).filter(finite("value"))
    b = baseline.select(F.col("feature").alias("__f"), "mean", "std", *(["low", "high"] if tolerance is not None else []))
    j = e.join(b, F.col("feature") == F.col("__f")).drop("__f")
    if tolerance is None:
        j = j.filter(F.col("std") > 1e-12).withColumns({"low": F.col("mean") - sigma * F.col("std"), "high": F.col("mean") + sigma * F.col("std")})
        issue = F.lit(None).cast("string")
    else:
        numbers = [F.coalesce(finite(c), F.lit(False)) for c in ("mean", "std", "low", "high")]
        sound = numbers[0] & numbers[1] & numbers[2] & numbers[3] & (F.col("std") >= 0) & (F.col("low") <= F.col("high"))
        agrees = (F.col("std") != 0) | ((F.col("low") == F.col("mean") - tolerance) & (F.col("high") == F.col("mean") + tolerance))
        issue = F.when(~F.coalesce(sound, F.lit(False)), "INVALID_STORED_RANGE").when(~agrees, "RANGE_DISAGREES_WITH_TOLERANCE")
    return j.select(key, "feature", "value", F.when(issue.isNull() & (F.col("std") != 0), F.abs(F.col("value") - F.col("mean")) / F.col("std")).alias("deviation_sigma"),
                    F.when(issue.isNull(), (F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))).alias("outlier"), *([issue.alias("baseline_issue")] if tolerance is not None else []))


# ------------------------------------------------------------------ history models

def _vectors(v: pd.Series, rows: int, width: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """Positions and the (N, rows, width) batch of flat arrays of the expected length; other rows are left out."""
    at = np.array([i for i, a in enumerate(v) if a is not None and len(a) == rows * width], dtype=int)
    x = np.stack([np.asarray(v.iloc[i], float) for i in at]).reshape(len(at), rows, width) if len(at) else np.zeros((0, rows, width))
    sound = np.isfinite(x).all((1, 2))
    return at[sound], x[sound]


def novelty_score(df: DataFrame, current: str, rows: str, model: dict) -> DataFrame:
    """Robust deviation and clipped PCA residual of (current, mean, std, change, offset) against a reference.

    ``model``: center, scale, active, pca_mean, pca_axes, thresholds.  Needs 24 history vectors per row; the
    history and the current vector travel as one flat array to a batched kernel.
    """
    @F.pandas_udf("robust double, pca double, score double")
    def run(v: pd.Series) -> pd.DataFrame:
        out = np.full((len(v), 3), np.nan)
        at, x = _vectors(v, 25)
        if len(at):
            out[at] = md.novelty(x[:, -1], x[:, :-1], model)
        return pd.DataFrame(out, columns=["robust", "pca", "score"])

    flat = F.flatten(F.concat(F.col(rows), F.array(F.col(current))))
    d = df.withColumn("__n", run(flat))
    value = lambda c: F.when(~F.isnan(F.col("__n")[c]), F.col("__n")[c])
    return d.select(*df.columns, value("robust").alias("robust"), value("pca").alias("pca"), value("score").alias("score"))


def forecast(df: DataFrame, rows: str, model: dict) -> DataFrame:
    """Ridge forecast of nine features from 13 vectors (last, mean, std, change), never clipped."""
    @F.pandas_udf("forecast_input array<double>, forecast array<double>")
    def run(v: pd.Series) -> pd.DataFrame:
        vec, out = [None] * len(v), [None] * len(v)
        at, x = _vectors(v, 13)
        if len(at):
            for i, a, b in zip(at, *md.ridge(x, model)):
                vec[i], out[i] = a, b
        return pd.DataFrame({"forecast_input": vec, "forecast": out})

    d = df.withColumn("__f", run(F.flatten(F.col(rows))))
    return d.select(*df.columns, F.col("__f.forecast_input").alias("forecast_input"), F.col("__f.forecast").alias("forecast"))


# positions of the forecast that are physically at least one (fixed values)
AT_LEAST_ONE = (0, 1, 2, 6, 7, 8)


def forecast_guard(df: DataFrame, model: dict) -> DataFrame:
    """Reject an unusual input or an output outside the fitted or physical bounds."""
    active = [int(i) for i in model["active"]]
    x = F.col("forecast_input")
    z = [F.abs((F.get(x, F.lit(i)) - float(model["center"][i])) / float(model["scale"][i])) for i in active]
    d = df.withColumn("input_robust", F.greatest(*z))
    f = F.col("forecast")
    inside = F.lit(True)
    for j in range(9):
        v = F.get(f, F.lit(j))
        inside = inside & finite(v) & v.between(float(model["target_lower"][j]), float(model["target_upper"][j]))
        if j in AT_LEAST_ONE:
            inside = inside & (v >= 1)
    reason = F.when(F.col("input_robust") > float(model["input_limit"]), "FORECAST_INPUT_OUT_OF_DISTRIBUTION").when(~F.coalesce(inside, F.lit(False)), "FORECAST_OUTPUT_OUT_OF_RANGE")
    return d.withColumn("forecast_reason", reason)


def evaluate_snapshots(df: DataFrame, event_model: dict, forecast_model: dict) -> DataFrame:
    """Verifier and forecast per snapshot with independent status and reason.

    Needs ``history`` (24 prior entries) and the current entry fields captured_us, uptime_us, seq, slot, valid, x.
    """
    entry = F.struct("captured_us", "uptime_us", "seq", "slot", "valid")
    last12 = F.when(F.size("history") <= 12, F.col("history")).otherwise(F.slice("history", -12, 12))
    d = df.withColumns({"v_reason": history_reason(F.col("history"), entry, 24), "__last12": last12})
    d = d.withColumn("f_reason", F.when(F.col("slot").isNull(), "FORECAST_REQUIRES_SCHEDULED_RECORD").otherwise(
        F.concat(F.lit("FORECAST_"), history_reason(F.col("__last12"), entry, 12))))
    d = d.withColumns({"__rows": F.when(F.col("v_reason").isNull(), F.transform("history", lambda h: h["x"])),
                       "__rows13": F.when(F.col("f_reason").isNull(), F.concat(F.transform("__last12", lambda h: h["x"]), F.array(F.col("x"))))})
    d = novelty_score(d, "x", "__rows", event_model)
    d = forecast_guard(forecast(d, "__rows13", forecast_model), forecast_model)
    bad = F.col("v_reason").isNull() & ~F.coalesce(finite("score"), F.lit(False))
    v = F.when(F.col("v_reason").isNotNull(), F.concat(F.lit("VERIFIER_"), "v_reason")).when(bad, "VERIFIER_OUTPUT_INVALID")
    f = F.coalesce("f_reason", "forecast_reason")
    return d.select(*df.columns, F.when(v.isNull(), "completed").otherwise("unavailable").alias("status"), v.alias("reason"),
                    F.when(v.isNull(), F.col("score")).alias("score"), F.when(v.isNull(), F.col("robust")).alias("robust"), F.when(v.isNull(), F.col("pca")).alias("pca"),
                    F.when(v.isNull(), F.col("score") > 1).alias("verdict"),
                    F.when(F.col("slot").isNull(), "not_applicable").when(f.isNull(), "completed").otherwise("unavailable").alias("forecast_status"),
                    f.alias("forecast_reason"), F.when(f.isNull(), F.col("forecast")).alias("forecast"))


# ------------------------------------------------------------------ scaler, autoencoder, adapters

def fit_scaler(df: DataFrame, vector: str) -> DataFrame:
    """Mean and population deviation per position; a near-constant position scales by one."""
    e = df.select(F.posexplode(vector).alias("position", "v"))
    g = e.groupBy("position").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    return g.withColumn("std", F.when(F.col("std") < 1e-8, 1.0).otherwise(F.col("std")))


def scale(df: DataFrame, vector: str, scaler: DataFrame) -> DataFrame:
    """Standardise with the one-row packed scaler (as wide as one vector, so it is broadcast)."""
    packed = scaler.agg(F.sort_array(F.collect_list(F.struct("position", "mean", "std"))).alias("__s")).withColumn("__one", F.lit(1))
    j = df.withColumn("__one", F.lit(1)).join(F.broadcast(packed), "__one")
    return j.withColumn("scaled", F.zip_with(F.col(vector), F.col("__s"), lambda v, s: (v - s["mean"]) / s["std"])).drop("__one", "__s")


def score_autoencoder(df: DataFrame, vector: str, model: dict, sequence: bool = False) -> DataFrame:
    """Reconstruction error of a dense stack or an LSTM pair against a threshold.

    ``model``: names (order of the vector), feature_names (order the model wants), mean, std, threshold,
    checksum, expected_checksum and ``layers`` or encoder/decoder/output weights.
    """
    if model["checksum"] != model["expected_checksum"]:
        raise ValueError("model checksum differs from the pinned one")
    if sorted(model["names"]) != sorted(model["feature_names"]):
        raise ValueError("feature names differ from the model's")
    pick = np.array([model["names"].index(n) for n in model["feature_names"]])
    mean, std = np.asarray(model["mean"], float), np.asarray(model["std"], float)
    shape = "array<array<double>>" if sequence else "array<double>"

    def errors(x: np.ndarray) -> np.ndarray:
        z = ((x[..., pick] - mean) / std).astype(np.float32)
        if not sequence:
            return ((sp.dense_forward(z, model["layers"]) - z) ** 2).mean(-1)
        hidden = sp.lstm(z, *[np.asarray(w, np.float32) for w in model["encoder"]])[:, -1]
        again = np.repeat(hidden[:, None], z.shape[1], 1)
        w, b = model["output"]
        back = sp.lstm(again, *[np.asarray(m, np.float32) for m in model["decoder"]]) @ np.asarray(w, np.float32).T + np.asarray(b, np.float32)
        return ((back - z) ** 2).mean((1, 2))

    @F.pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        out = np.full(len(v), np.nan)
        at = [i for i, a in enumerate(v) if a is not None and len(a)]
        if at:
            x = np.stack([np.stack(v.iloc[i]).astype(float) if sequence else np.asarray(v.iloc[i], float) for i in at])
            good = np.isfinite(x.reshape(len(x), -1)).all(-1)
            if good.any():
                out[np.asarray(at)[good]] = errors(x[good])
        return pd.Series(out)

    e = df.withColumn("__e", run(F.col(vector).cast(shape)))
    ok = finite("__e")
    return e.withColumns({"error": F.when(ok, F.col("__e")), "verdict": F.when(ok, F.col("__e") > float(model["threshold"])),
                          "status": F.when(ok, "completed").otherwise("unavailable")}).drop("__e")


def classify(df: DataFrame, model, features: str, threshold: float) -> DataFrame:
    """Anomaly probability of a fitted Spark ML classifier; the verdict is strictly above the threshold."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    scored = model.transform(df.withColumn(model.getFeaturesCol(), array_to_vector(F.col(features))))
    p = vector_to_array("probability")[1]
    return scored.select(*df.columns, p.alias("score"), (p > threshold).alias("verdict"))


def apply_threshold(df: DataFrame, score: str, threshold: str, comparison: str, reason: str) -> DataFrame:
    """Compare by the declared operator; a given reason or a non-finite score is unavailable."""
    s, t, op = F.col(score), F.col(threshold), F.col(comparison)
    ok = F.col(reason).isNull() & F.coalesce(finite(s), F.lit(False)) & op.isin(">", ">=", "<", "<=")
    verdict = F.when(op == ">", s > t).when(op == ">=", s >= t).when(op == "<", s < t).otherwise(s <= t)
    return df.withColumns({"status": F.when(ok, "completed").otherwise("unavailable"), "verdict": F.when(ok, verdict),
                           "why": F.when(ok, None).otherwise(F.coalesce(F.col(reason), F.lit("INVALID_MODEL_OUTPUT")))})


def result_status(df: DataFrame, models: DataFrame, now_us: Column, retention_us: int) -> DataFrame:
    """Lifecycle status of each stored input against the model registered for its scope.

    ``df``: device, profile, quality, captured_us, inferred; ``models``: device, profile, model, contract_ok.
    """
    m = models.select(F.col("device").alias("__d"), F.col("profile").alias("__p"), F.col("model"), F.col("contract_ok"))
    j = df.join(m, (F.col("device") == F.col("__d")) & (F.col("profile") == F.col("__p")), "left").drop("__d", "__p")
    expired = F.col("captured_us") < now_us - retention_us
    status = (F.when(F.col("quality") != "valid", "unavailable").when(expired, "unavailable").when(F.col("model").isNull(), "waiting_model")
              .when(~F.col("contract_ok"), "unavailable").when(F.col("inferred"), "completed").otherwise("queued"))
    why = (F.when(F.col("quality") != "valid", F.col("quality")).when(expired, "MEASUREMENT_EXPIRED").when(F.col("model").isNull(), "MODEL_NOT_CONFIGURED")
           .when(~F.col("contract_ok"), "MODEL_INPUT_CONTRACT_MISMATCH"))
    return j.withColumns({"status": status, "status_reason": why})


def score_with(df: DataFrame, predict: Callable[[pd.DataFrame], pd.Series], inputs: list[str], keep: list[str], threshold: float,
               comparison: str = ">") -> DataFrame:
    """Plug in a local predictor: batches of input columns to one score each; NaN means unavailable."""
    schema = ", ".join(f"`{c}` {dict(df.dtypes)[c]}" for c in keep) + ", score double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[keep].assign(score=np.asarray(predict(pdf[inputs]), dtype=float))

    out = df.select(*dict.fromkeys([*keep, *inputs])).mapInPandas(run, schema)
    out = out.withColumns({"__t": F.lit(float(threshold)), "__c": F.lit(comparison), "__r": F.lit(None).cast("string")})
    return apply_threshold(out, "score", "__t", "__c", "__r").drop("__t", "__c", "__r")
