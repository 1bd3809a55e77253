"""Validators: every one adds ``error_code`` (first failing rule, null when good) and drops no row.

Good and quarantined rows are two filters on that column (:func:`split_quarantine`).
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import col, finite, first_failure
from ..plans.scan import running_max, scan
from ..session import cut

# accepted telemetry keys, scenarios and quality states (fixed values)
TELEMETRY_FIELDS = ["timestamp", "sequence", "siteId", "assetId", "deviceId", "rpm", "rpmStatus", "rpmMeasuredAt", "rpmSource", "vibrationRmsRaw",
                    "vibrationRmsMmS", "vibrationPeakHz", "acousticRmsRaw", "acousticDb", "acousticPeakHz", "scenarioLabel", "knownVibrationLabel",
                    "knownAcousticLabel", "source", "isSynthetic", "vibrationUnitNote", "acousticUnitNote"]
SCENARIOS = ["normal", "vibration_anomaly", "acoustic_anomaly", "combined_anomaly"]
QUALITY = ["valid", "fifo_overrun", "sensor_unavailable", "sample_gap", "clipped", "constant_axis", "processing_overflow"]
SNAPSHOT_REASONS = ["fifo_overrun", "insufficient_samples", "timeout", "non_finite", "zero_variance", "sensor_unavailable", "no_valid_window"]
FEATURES9 = [f"{kind}_a_{axis}" for kind in ("cf", "sk", "ku") for axis in (1, 2, 3)]
ZONED = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?([Zz]|[+-]\d{2}:?\d{2})$"
STRICT_STAMP = r"^\d{4}-\d{2}-\d{2}[Tt]([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d{1,6})?([Zz]|[+-]([01]\d|2[0-3]):[0-5]\d)$"
BOOT = r"^[0-9a-f]{32}$"
IDENT = r"^[A-Z0-9][A-Z0-9._-]{0,99}$"
MAX_SAFE = 2**53 - 1


def instant_us(c) -> Column:
    """Zoned RFC 3339 text to epoch microseconds; text without a zone or with hour 24 is null."""
    c = F.trim(col(c))
    return F.when(c.rlike(ZONED), F.unix_micros(F.try_to_timestamp(F.upper(c))))


def split_quarantine(df: DataFrame, payload: str) -> tuple[DataFrame, DataFrame]:
    """Good rows, and rejected rows with their code and original payload.

    The judged rows are written once to the checkpoint folder, so two outputs do not validate twice.
    """
    df = cut(df)
    good = df.filter(F.col("error_code").isNull()).drop("error_code")
    return good, df.filter(F.col("error_code").isNotNull()).select("error_code", F.col(payload).alias("payload"))


# ------------------------------------------------------------------ JSON

def strict_json_ok(c) -> Column:
    """True for one JSON document without duplicate keys, NaN/Infinity, overflowing numbers or lone surrogates."""
    @F.pandas_udf("boolean")
    def check(texts: pd.Series) -> pd.Series:
        def once(items):
            out = dict(items)
            if len(out) != len(items):
                raise ValueError("duplicate key")
            return out

        def constant(name):
            raise ValueError(name)

        def sound(v) -> bool:
            if isinstance(v, float):
                return math.isfinite(v)
            if isinstance(v, str):
                return not any(0xD800 <= ord(ch) <= 0xDFFF for ch in v)
            if isinstance(v, dict):
                return all(sound(k) and sound(x) for k, x in v.items())
            return all(map(sound, v)) if isinstance(v, list) else True

        def ok(t) -> bool:
            try:
                return t is not None and sound(json.loads(t, object_pairs_hook=once, parse_constant=constant))
            except (ValueError, RecursionError):
                return False
        return texts.map(ok).astype(bool)
    return check(col(c))


class Payload:
    """Typed access to the members of one JSON object column.

    ``df`` gains the type and the text of every named member, so the document is parsed once and each
    member is read once, however many rules look at it.
    """

    def __init__(self, df: DataFrame, text: str, keys: list[str]):
        schema = ", ".join(f"`{k}` variant" for k in keys)
        parsed = df.withColumns({"__doc": F.from_json(F.col(text), schema), "__keys": F.json_object_keys(F.col(text))})
        self.df = parsed.withColumns({**{f"__k_{k}": F.schema_of_variant(F.col("__doc")[k]) for k in keys},
                                      **{f"__s_{k}": F.try_variant_get(F.col("__doc")[k], "$", "string") for k in keys}}).drop("__doc")
        self.added = ["__keys", *[f"__{p}_{k}" for p in "ks" for k in keys]]
        self.keys = F.col("__keys")
        self.sound = self.keys.isNotNull() & (F.size(self.keys) == F.size(F.array_distinct(self.keys)))

    def has(self, key: str) -> Column:
        """Present, with a value or with null."""
        return F.col(f"__k_{key}").isNotNull()

    def kind(self, key: str) -> Column:
        return F.col(f"__k_{key}")

    def text(self, key: str) -> Column:
        """Any scalar as text."""
        return F.col(f"__s_{key}")

    def null(self, key: str) -> Column:
        return F.coalesce(self.kind(key) == "VOID", F.lit(True))

    def text_of(self, key: str) -> Column:
        return F.when(self.kind(key) == "STRING", self.text(key))

    def integer(self, key: str) -> Column:
        return F.when(self.kind(key) == "BIGINT", self.text(key).try_cast("bigint"))

    def number(self, key: str) -> Column:
        v = self.text(key).try_cast("double")
        return F.when((self.kind(key) != "BOOLEAN") & finite(v), v)

    def flag(self, key: str) -> Column:
        return F.when(self.kind(key) == "BOOLEAN", self.text(key) == "true")

    def optional_number(self, key: str) -> Column:
        return self.null(key) | self.number(key).isNotNull()

    def optional_text(self, key: str) -> Column:
        return self.null(key) | (self.kind(key) == "STRING")


def rpm_rule(p: Payload, at_us: Column) -> Column:
    """True when the RPM observation contract holds (or only a legacy nullable rpm is present)."""
    keys = ["rpmStatus", "rpmMeasuredAt", "rpmSource"]
    legacy = ~(p.has(keys[0]) | p.has(keys[1]) | p.has(keys[2]))
    status, source, stamp, rpm = p.text_of("rpmStatus"), p.text_of("rpmSource"), p.text_of("rpmMeasuredAt"), p.number("rpm")
    source_ok = p.null("rpmSource") | ((F.trim(source) != "") & (F.length(source) <= 160) & ~source.rlike(r"[\p{Cntrl}]"))
    stamp_ok = p.null("rpmMeasuredAt") | (stamp.rlike(STRICT_STAMP) & ~stamp.endswith("-00:00") & (instant_us(stamp) <= at_us))
    has_source, has_stamp = ~p.null("rpmSource"), ~p.null("rpmMeasuredAt")
    measured = has_source & has_stamp & (p.kind("rpm") != "STRING") & (rpm >= 0) & ~F.coalesce(p.flag("isSynthetic"), F.lit(False))
    by_status = (F.when(status == "valid", measured).when(~p.null("rpm"), F.lit(False)).when(status == "stale", has_source & has_stamp)
                 .when(status == "unavailable", ~has_stamp).otherwise(F.lit(True)))
    full = (p.has("rpm") & p.has(keys[0]) & p.has(keys[1]) & p.has(keys[2]) & status.isin("valid", "unavailable", "stale", "invalid")
            & source_ok & stamp_ok & by_status & (~has_stamp | has_source))
    return F.when(legacy, p.optional_number("rpm")).otherwise(F.coalesce(full, F.lit(False)))


def normalize_telemetry(df: DataFrame, payload: str, now_us: Column, retention_days: int = 30, future_sec: int = 300) -> DataFrame:
    """One telemetry object per row to typed columns plus ``error_code``/``error_rule``."""
    p = Payload(df, payload, TELEMETRY_FIELDS)
    base = p.df.withColumn("t_us", instant_us(p.text_of("timestamp")))
    t = F.col("t_us")
    ident = lambda k: F.upper(F.trim(p.text_of(k)))
    known = F.size(F.array_except(p.keys, F.array(*[F.lit(f) for f in TELEMETRY_FIELDS]))) == 0
    raw_only = [F.coalesce(p.kind(k) == "VOID", F.lit(False)) for k in ("vibrationRmsMmS", "acousticDb")]
    scenario = p.has("scenarioLabel") & (p.null("scenarioLabel") | F.trim(p.text_of("scenarioLabel")).isin(SCENARIOS))
    rule = first_failure(
        (p.sound & known, "unknown_fields"), ((ident("siteId") != "") & (ident("assetId") != "") & (ident("deviceId") != ""), "identifier"),
        (p.integer("sequence") >= 1, "sequence"), (t.isNotNull(), "timestamp"), (t <= now_us + future_sec * 1_000_000, "future"),
        (t >= now_us - retention_days * 86_400_000_000, "retention"), (raw_only[0] & raw_only[1], "raw_only"), (scenario, "scenario"),
        (p.flag("isSynthetic").isNotNull(), "is_synthetic"), (p.number("vibrationRmsRaw") >= 0, "vibration_rms"),
        (p.null("acousticRmsRaw") | (p.number("acousticRmsRaw") >= 0), "acoustic_rms"), (rpm_rule(p, t), "rpm"),
        (p.number("vibrationPeakHz").isNotNull(), "vibration_peak"), (p.optional_number("acousticPeakHz"), "acoustic_peak"),
        (p.optional_text("knownVibrationLabel") & p.optional_text("knownAcousticLabel") & p.optional_text("source")
         & p.optional_text("vibrationUnitNote") & p.optional_text("acousticUnitNote"), "text"))
    blank = lambda k: F.when(F.trim(p.text_of(k)) != "", F.trim(p.text_of(k)))
    r = base.withColumn("error_rule", rule)
    return r.withColumns({
        "error_code": F.when(F.col("error_rule") == "raw_only", "INVALID_RAW_ONLY_FIELD").when(F.col("error_rule").isNotNull(), "INVALID_TELEMETRY_PAYLOAD"),
        "site": ident("siteId"), "asset": ident("assetId"), "device": ident("deviceId"), "sequence": p.integer("sequence"),
        "rpm": p.number("rpm"), "rpm_status": p.text_of("rpmStatus"), "vibration_rms_raw": p.number("vibrationRmsRaw"), "vibration_peak_hz": p.number("vibrationPeakHz"),
        "acoustic_rms_raw": p.number("acousticRmsRaw"), "acoustic_peak_hz": p.number("acousticPeakHz"), "scenario_label": blank("scenarioLabel"),
        "known_vibration_label": blank("knownVibrationLabel"), "known_acoustic_label": blank("knownAcousticLabel"), "source": blank("source"),
        "is_synthetic": p.flag("isSynthetic")}).drop(*p.added)


def validate_rpm(df: DataFrame, payload: str, at_us: Column) -> DataFrame:
    p = Payload(df, payload, ["rpm", "rpmStatus", "rpmMeasuredAt", "rpmSource", "isSynthetic"])
    return p.df.withColumn("error_code", F.when(~rpm_rule(p, at_us), "INVALID_TELEMETRY_PAYLOAD")).drop(*p.added)


def within_retention(df: DataFrame, t_us: str, now_us: Column, days: int, future_sec: int = 300) -> DataFrame:
    """Event-time bounds; with a partition column derived from time this prunes files."""
    return df.filter(F.col(t_us).between(now_us - days * 86_400_000_000, now_us + future_sec * 1_000_000))


def check_device_mapping(df: DataFrame) -> DataFrame:
    """Error code from the registry columns added by ``joins.with_registry``."""
    return df.withColumn("error_code", first_failure(
        (F.col("site_known"), "SITE_NOT_FOUND"), (F.col("asset_known"), "ASSET_NOT_FOUND"), (F.col("device_known"), "DEVICE_NOT_FOUND"),
        ((F.col("d_site") == F.col("site")) & (F.col("d_asset") == F.col("asset")) & (F.col("d_mapping") == "active"), "DEVICE_MAPPING_MISMATCH"),
        (F.col("d_certificate") == "registered", "DEVICE_CERTIFICATE_NOT_ACTIVE")))


def dedupe_quarantine(df: DataFrame, key: str, content: list[str], order: str) -> DataFrame:
    """Rejected messages by idempotency key: same fingerprint repeats, another one conflicts; no key always stores."""
    from .dedupe import dedupe_with_conflicts, row_digest
    d = df.withColumn("fingerprint", row_digest(content))
    keyed = dedupe_with_conflicts(d.filter(F.col(key).isNotNull()), [key], order, "fingerprint")
    return keyed.unionByName(d.filter(F.col(key).isNull()).withColumn("disposition", F.lit("accepted")))


def trusted_labels(df: DataFrame, verified: str, fields: str, principal: str, submitted: str, labels: list[str]) -> DataFrame:
    """Labels count only when the server verified their provenance and it lists the field."""
    ok = F.col(verified) & F.col(principal).isNotNull() & F.col(submitted).isNotNull()
    return df.withColumns({c: F.when(F.coalesce(ok & F.array_contains(F.col(fields), c), F.lit(False)), F.col(c)) for c in labels})


# ------------------------------------------------------------------ windows and snapshots

def _whole(c: str, low: int, high: int) -> Column:
    return F.col(c).between(low, high)


def validate_window(df: DataFrame, profile: str, unit: str, now_us: Column, retention_us: int = 2 * 86_400_000_000) -> DataFrame:
    """Common measurement envelope of 800 Hz XYZ windows."""
    upper = lambda c: (F.trim(c) != "") & (F.col(c) == F.upper(F.trim(c)))
    rule = first_failure(
        (upper("device") & upper("site") & upper("asset"), "identifier"), (F.col("boot").rlike(BOOT), "boot"),
        (_whole("idx", 0, 2**31 - 1) & _whole("uptime_us", 0, MAX_SAFE) & _whole("sample_count", 0, 512), "integer"),
        ((F.col("schema_version") == 1) & (F.col("rate_hz") == 800) & (F.col("profile") == profile) & (F.col("unit") == unit)
         & (F.concat_ws("", "axes") == "XYZ") & (F.size("axes") == 3), "profile"), (F.col("quality").isin(QUALITY), "quality"),
        (F.col("captured_us").between(now_us - retention_us, now_us + 300_000_000), "time_bounds"))
    return df.withColumn("error_rule", rule).withColumn("error_code", F.when(F.col("error_rule").isNotNull(), "INVALID_VIBRATION_WINDOW"))


def validate_base21(df: DataFrame, features: str, quality: str, count: str) -> DataFrame:
    """Valid windows need 512 samples and sound features; invalid ones must carry null features."""
    v = F.col(features)
    at = lambda i: F.get(v, F.lit(i))
    shape = (F.size(v) == 21) & F.forall(v, lambda e: finite(e) & e.between(0, 1e12))
    axes = F.lit(True)
    for o in (0, 7, 14):
        axes = axes & (at(o) > 1e-8) & (at(o + 1) >= at(o) * (1 - 1e-9)) & (at(o + 2) >= 1 - 1e-9)
    ok = F.col(quality) == "valid"
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return df.withColumn("error_code", F.when(ok & (F.col(count) != 512), "SAMPLE_COUNT").when(ok & no(shape), "INVALID_FEATURES")
                         .when(ok & no(axes), "INVALID_RMS_PEAK_OR_KURTOSIS").when(~ok & v.isNotNull(), "INVALID_WINDOW_WITH_FEATURES"))


def validate_snapshot(df: DataFrame, history: bool, now_us: Column, retention_us: int = 2 * 86_400_000_000) -> DataFrame:
    """Feature-only snapshot envelope with the slot rules of its schedule.

    Columns: device, site, asset, sensor, boot, idx, uptime_us, sample_count, rate_hz, unit, quality, reason, features
    (map), digest_ok, captured_us, slot, history_seq.
    """
    names = [F.col(c).rlike(IDENT) for c in ("device", "site", "asset", "sensor")]
    ok = F.col("quality") == "valid"
    f = F.col("features")
    nine = (F.size(f) == 9) & (F.size(F.array_except(F.map_keys(f), F.array(*[F.lit(n) for n in FEATURES9]))) == 0) & F.forall(
        F.map_values(f), lambda v: finite(v) & (F.abs(v) <= 1e12))
    state = F.when(ok, (F.col("sample_count") == 512) & F.col("reason").isNull() & nine).when(
        F.col("quality") == "invalid", f.isNull() & F.col("reason").isin(SNAPSHOT_REASONS)).otherwise(F.lit(False))
    slot, at = F.col("slot"), F.col("captured_us") / 1e6
    schedule = F.pmod(slot, F.lit(25)) == 0 if history else F.pmod(slot, F.lit(60)).isin(0, 25, 50)
    width = F.lit(1.640) if history else F.when(F.pmod(slot, F.lit(60)) == 0, 10.0).otherwise(25.0)
    inside = F.when(ok, (at >= slot - width) & (at + 0.640 <= slot + 0.000001)).otherwise(F.abs(at - slot) <= 0.000001)
    seq = F.col("history_seq")
    sequence = F.when(slot.isNull(), seq.isNull()).otherwise(F.coalesce(seq.between(0, 2**31 - 1), F.lit(False))) if history else F.lit(True)
    rule = first_failure(
        (names[0] & names[1] & names[2] & names[3], "identifier"), (F.col("boot").rlike(BOOT), "boot"),
        (_whole("idx", 0, 2**31 - 1) & _whole("uptime_us", 0, MAX_SAFE) & _whole("sample_count", 0, 512), "integer"),
        ((F.col("rate_hz") == 800) & (F.col("unit") == "dimensionless"), "profile"), (state, "quality_or_features"), (F.col("digest_ok"), "integrity"),
        (F.col("captured_us").between(now_us - retention_us, now_us + 300_000_000), "time_bounds"),
        (slot.isNull() | (slot.between(0, MAX_SAFE) & schedule), "slot"), (slot.isNull() | inside, "slot_fit"), (sequence, "history_sequence"))
    return df.withColumn("error_rule", rule).withColumn("error_code", F.when(F.col("error_rule").isNotNull(), "INVALID_EDGE_FEATURE_SNAPSHOT"))


def classify_measurements(df: DataFrame, rms: list[str], spectrum: list[str], quality: str, bins: int = 256) -> DataFrame:
    """Optional RMS and spectrum groups: complete, partial, absent or invalid; zero RMS demands a zero spectrum."""
    r = [F.col(c) for c in rms]
    s = [F.col(c) for c in spectrum]
    every = lambda cs: cs[0] & cs[1] & cs[2]
    bad_r = [c.isNotNull() & ~F.coalesce(finite(c) & c.between(0, 1e12), F.lit(False)) for c in r]
    whole_r = every([c.isNotNull() for c in r])
    rms_state = (F.when(bad_r[0] | bad_r[1] | bad_r[2], "invalid").when(every([c.isNull() for c in r]), "absent")
                 .when(whole_r & (F.col(quality) != "valid"), "invalid").when(whole_r, "complete").otherwise("partial"))
    over = lambda c: c.isNotNull() & ((F.size(c) > bins) | F.exists(c, lambda v: v.isNotNull() & ~F.coalesce(finite(v) & v.between(0, 1e24), F.lit(False))))
    full = lambda c: F.coalesce((F.size(c) == bins) & ~F.exists(c, lambda v: v.isNull()), F.lit(False))
    whole_s = every([full(c) for c in s])
    clash = F.lit(False)
    for a, b in zip(r, s):
        clash = clash | F.coalesce((a == 0) & F.exists(b, lambda v: v != 0), F.lit(False))
    d = df.withColumn("rms_state", rms_state)
    spectrum_state = (F.when(over(s[0]) | over(s[1]) | over(s[2]), "invalid").when(every([c.isNull() for c in s]), "absent")
                      .when(whole_s & ((F.col(quality) != "valid") | ((F.col("rms_state") == "complete") & clash)), "invalid")
                      .when(whole_s, "complete").otherwise("partial"))
    return d.withColumn("spectrum_state", spectrum_state)


# delivery rules per policy (fixed values): event or reason, state ('*' = any), mode, interval
DELIVERY = [("edge-state", "normal_periodic", "NORMAL", "periodic", 300), ("edge-state", "anomaly_enter", "ANOMALY_ACTIVE", "immediate", 0),
            ("edge-state", "anomaly_periodic", "ANOMALY_ACTIVE", "periodic", 10), ("edge-state", "normal_recovered", "NORMAL", "immediate", 0),
            ("history", "history_periodic", "*", "periodic", 25), ("history", "anomaly_enter", "ANOMALY_ACTIVE", "immediate", 0),
            ("history", "anomaly_periodic", "ANOMALY_ACTIVE", "periodic", 10), ("history", "normal_recovered", "NORMAL", "immediate", 0),
            ("feature", "periodic", "NORMAL", None, None), ("feature", "anomaly_start", "ANOMALY_ACTIVE", None, None),
            ("feature", "anomaly_active", "ANOMALY_ACTIVE", None, None), ("feature", "recovery", "NORMAL", None, None),
            ("feature-history", "periodic", "*", None, None), ("feature-history", "anomaly_start", "ANOMALY_ACTIVE", None, None),
            ("feature-history", "anomaly_active", "ANOMALY_ACTIVE", None, None), ("feature-history", "recovery", "NORMAL", None, None)]
ENTER = ["anomaly_enter", "anomaly_start"]
RECOVER = ["normal_recovered", "recovery"]


def delivery_rules(spark) -> DataFrame:
    return spark.createDataFrame(DELIVERY, "policy string, event string, r_state string, r_mode string, r_interval int")


def validate_delivery(df: DataFrame) -> DataFrame:
    """Event x state x mode x counters against the policy table.

    Columns: policy, event, state, mode, interval_sec, anomaly_count, normal_count, quality, slot, history_seq, has_raw.
    """
    rules = delivery_rules(df.sparkSession).withColumnsRenamed({"policy": "__p", "event": "__e"})
    j = df.join(F.broadcast(rules), (F.col("policy") == F.col("__p")) & (F.col("event") == F.col("__e")), "left")
    a, n, ev = F.col("anomaly_count"), F.col("normal_count"), F.col("event")
    state = F.col("state").isin("NORMAL", "ANOMALY_ACTIVE") & ((F.col("r_state") == "*") | (F.col("r_state") == F.col("state")))
    mode = F.col("r_mode").isNull() | ((F.col("mode") == F.col("r_mode")) & (F.col("interval_sec") == F.col("r_interval")))
    steady = F.col("policy") != "edge-state"
    counters = (~((a > 0) & (n > 0)) & (~ev.isin(ENTER) | ((a == 3) & (n == 0))) & (~ev.isin(RECOVER) | ((a == 0) & (n == 5)))
                & ~(F.when(steady, F.col("state") == "NORMAL").otherwise(ev == "normal_periodic") & (a >= 3))
                & ~(F.when(steady, F.col("state") == "ANOMALY_ACTIVE").otherwise(ev == "anomaly_periodic") & (n >= 5)))
    sound = (F.col("quality") == "valid") | ~(ev.isin(ENTER + RECOVER) | (a > 0) | (n > 0))
    feature = F.col("policy").isin("feature", "feature-history")
    slot = (~(feature & (ev == "periodic")) | F.col("slot").isNotNull()) & (~((F.col("policy") == "feature") & (ev == "anomaly_active")) | F.col("slot").isNull())
    seq = (F.col("policy") != "history") | ((ev == "history_periodic") == F.col("history_seq").isNotNull())
    raw = ~((F.col("policy") == "history") & (ev == "anomaly_enter")) | F.col("has_raw")
    rule = first_failure((F.col("r_state").isNotNull() & state, "event_or_state"), (mode, "mode_or_interval"), (a.between(0, 2**31 - 1) & n.between(0, 2**31 - 1), "counter"),
                         (counters, "counters_vs_state"), (sound, "quality"), (slot, "slot"), (seq, "history_sequence"), (raw, "raw_evidence"))
    return j.select(*df.columns, rule.alias("error_rule"))


BATCH_REASONS = ["none", "rms_low", "rms_high", "severe", "quality", "baseline_missing", "storage_pressure", "recovery_hold"]


def validate_batch_meta(df: DataFrame) -> DataFrame:
    return df.withColumn("error_rule", first_failure(
        (F.col("policy") == "edge-trigger-batch-v1", "policy"), (F.col("mode").isin("periodic", "priority", "replay"), "mode"), (F.col("reason").isin(BATCH_REASONS), "reason"),
        (F.length("baseline").between(1, 64), "baseline"), (F.col("dropped").between(0, MAX_SAFE), "dropped")))


def expected_interval(df: DataFrame) -> DataFrame:
    """Expected seconds until the next report by policy and board state."""
    active = F.col("state") == "ANOMALY_ACTIVE"
    sec = (F.when(F.col("policy").isin("feature", "feature-history", "history"), F.when(active, 10).otherwise(25))
           .when((F.col("policy") == "edge-state") & active, 10).otherwise(300))
    return df.withColumn("expected_interval_sec", sec)


def validate_summary(df: DataFrame, now_us: Column, retention_us: int = 2 * 86_400_000_000) -> DataFrame:
    """Nine-feature source summary: identity, quality, finite features, digest, time."""
    f = F.col("features")
    nine = (F.size(f) == 9) & (F.size(F.array_except(F.map_keys(f), F.array(*[F.lit(n) for n in FEATURES9]))) == 0) & F.forall(F.map_values(f), lambda v: finite(v) & (F.abs(v) <= 1e12))
    rule = first_failure(
        (F.col("device").rlike(IDENT) & F.col("sensor").rlike(IDENT), "identifier"), (F.col("boot").rlike(BOOT), "boot"),
        (_whole("idx", 0, 2**31 - 1) & _whole("uptime_us", 0, MAX_SAFE), "integer"), (F.col("history_seq").isNull() | _whole("history_seq", 0, 2**31 - 1), "history_sequence"),
        (F.col("quality").isin(QUALITY), "quality"), (F.when(f.isNull(), F.col("quality") != "valid").otherwise(nine), "features"), (F.col("digest_ok"), "integrity"),
        (F.col("captured_us").between(now_us - retention_us, now_us + 300_000_000), "time_bounds"))
    return df.withColumn("error_rule", rule)


def validate_comm_report(df: DataFrame, now_ms: Column, counters: list[str]) -> DataFrame:
    """Counter algebra and clock agreement of a communication-quality window."""
    c = F.col
    failures = c("transportFailures") + c("retryableResponses") + c("configurationFailures") + c("rejectedPackets")
    whole = F.lit(True)
    for name in counters:
        whole = whole & F.coalesce(c(name).between(0, MAX_SAFE), F.lit(False))
    latency = F.when(c("acknowledged") == 0, (c("ackLatencyTotalMs") == 0) & (c("ackLatencyMaxMs") == 0)).otherwise(
        (c("ackLatencyMaxMs") <= c("ackLatencyTotalMs")) & (c("ackLatencyTotalMs") <= c("ackLatencyMaxMs") * c("acknowledged")))
    buffer = (c("bufferCapacity").between(1, 1_000_000) & (c("bufferSamples") >= 1) & (c("bufferDepthLast") <= c("bufferDepthMax")) & (c("bufferDepthMax") <= c("bufferCapacity"))
              & (c("bufferDepthMax") <= c("bufferDepthSum")) & (c("bufferDepthSum") <= c("bufferDepthMax") * c("bufferSamples")) & (c("offlineSamples") <= c("wifiSamples")))
    span = c("end_ms") - c("start_ms")
    return df.withColumn("error_rule", first_failure(
        (_whole("window_id", 1, 2**32 - 1), "window_id"), ((c("start_ms") >= 0) & (span >= 60_000) & (span == c("end_uptime_ms") - c("start_uptime_ms")), "duration"),
        (c("end_ms") <= now_ms + 300_000, "future"), (whole, "counters"),
        ((c("attempts") == c("acknowledged") + failures) & (c("retries") <= c("attempts")) & (c("replayAttempts") <= c("attempts")), "attempts"),
        (latency, "latency"), (buffer, "buffer")))


# channels of an analysis frame (fixed values): rate, samples, unit
CHANNELS = {"vibrationX": (800, 512, "g"), "vibrationY": (800, 512, "g"), "vibrationZ": (800, 512, "g"), "acoustic": (16000, 10240, "pcm24")}


def validate_frame(df: DataFrame, channels: str, now_us: Column, profile: dict = CHANNELS, retention_us: int = 7 * 86_400_000_000) -> DataFrame:
    """Frame of synchronised channels: map name -> struct(rate, count, unit, rms, peak, kurtosis, bands, samples)."""
    m = F.col(channels)
    names = F.size(F.array_except(F.map_keys(m), F.array(*[F.lit(n) for n in profile]))) + F.abs(F.size(m) - len(profile)) == 0
    spec, feats = F.lit(True), F.lit(True)
    raw = []
    in_range = lambda v: finite(v) & v.between(0, 1e30)
    for name, (rate, count, unit) in profile.items():
        ch = F.try_element_at(m, F.lit(name))
        spec = spec & (ch["rate"] == rate) & (ch["count"] == count) & (ch["unit"] == unit)
        feats = feats & in_range(ch["rms"]) & in_range(ch["peak"]) & (ch["kurtosis"].isNull() | in_range(ch["kurtosis"])) & (F.size(ch["bands"]) == 3) & F.forall(ch["bands"], in_range)
        raw.append(ch["samples"].isNotNull().cast("int"))
    count = sum(raw[1:], raw[0])
    request = F.when(count == len(profile), F.coalesce(F.col("request_id").rlike(BOOT), F.lit(False))).otherwise(F.col("request_id").isNull())
    d = df.withColumn("error_rule", first_failure(
        (F.col("sequence").between(1, 2**32 - 1), "sequence"), (F.col("captured_us").between(now_us - retention_us, now_us + 60_000_000), "time_bounds"),
        (names, "channels"), (spec, "profile"), (feats, "features"), (count.isin(0, len(profile)), "partial_waveform"), (request, "request_id")))
    return d.withColumn("has_raw", count == len(profile))


def validate_model_input(df: DataFrame, features: str, names: list[str], model: str, now_us: Column, retention_us: int = 7 * 86_400_000_000) -> DataFrame:
    """Prepared input: exact feature names, sample bounds, pinned model, finite values."""
    f = F.col(features)
    same = (F.size(f) == len(names)) & (F.size(F.array_except(F.map_keys(f), F.array(*[F.lit(n) for n in names]))) == 0)
    width = F.col("end_sample") - F.col("start_sample")
    text = (F.col("source") == F.trim("source")) & F.length("source").between(1, 128) & (F.length("preprocessing") >= 1)
    return df.withColumn("error_rule", first_failure(
        (F.col("model") == model, "model"), (text, "identifier"), (_whole("idx", 0, 2**31 - 1) & _whole("rate_hz", 1, 192_000), "integer"),
        (width.between(1, 10_000_000) & (F.col("start_sample") >= 0), "sample_bounds"), (same, "feature_names"),
        (F.forall(F.map_values(f), lambda v: finite(v) & (F.abs(v) <= 1e100)), "feature_values"),
        (F.col("captured_us").between(now_us - retention_us, now_us + 300_000_000), "time_bounds")))


def feature_issues(df: DataFrame, key: str, features: str, baseline: DataFrame | None = None) -> DataFrame:
    """Quality issues of a map of feature texts: empty, missing_key, missing, invalid_type, nan, inf.

    A healthy row yields no output; ``features`` maps names to JSON value text (null = null value).
    """
    m = F.col(features)
    empty = df.filter(m.isNull() | (F.size(m) == 0)).select(key, F.lit(None).cast("string").alias("feature"), F.lit("empty_features").alias("reason"))
    e = df.select(key, F.explode(features).alias("feature", "v"))
    v = F.col("v")
    number = v.try_cast("double")
    reason = (F.when(v.isNull(), "missing").when(v.startswith('"') | F.lower(v).isin("true", "false") | number.isNull() & ~F.lower(v).isin("nan", "infinity", "-infinity"), "invalid_type")
              .when(F.isnan(number) | (F.lower(v) == "nan"), "nan").when(F.abs(number) == float("inf"), "inf"))
    out = empty.unionByName(e.select(key, "feature", reason.alias("reason")).filter("reason is not null"))
    if baseline is None:
        return out
    want = df.filter(F.size(m) > 0)
    names = baseline.agg(F.collect_set("feature").alias("__names")).withColumn("__one", F.lit(1))
    gap = want.withColumn("__one", F.lit(1)).join(F.broadcast(names), "__one").select(key, F.explode(F.array_except("__names", F.map_keys(m))).alias("feature"), F.lit("missing_key").alias("reason"))
    return out.unionByName(gap)


# ------------------------------------------------------------------ devices, sessions, exports

def validate_health(df: DataFrame, key: str, order: str, split: Column | None) -> tuple[DataFrame, DataFrame]:
    """Device health ranges and staleness, and the exploded sensor-fault entries with their own code.

    ``faults``: array of struct(code, status, severity, detail).  A report older than one that arrived before is stale.
    """
    c = F.col
    seen = scan(df, [key], [order], split, __top=running_max(c("reported_us"), inclusive=False))
    rule = first_failure(
        (c("rssi_dbm").isNull() | c("rssi_dbm").between(-120, 0), "rssi"), (c("reboot_count").isNull() | c("reboot_count").between(0, 2**31 - 1), "reboot_count"),
        (c("buffer_pct").isNull() | c("buffer_pct").between(0, 100), "buffer"), (F.coalesce(F.size("faults"), F.lit(0)) <= 32, "too_many_faults"),
        (c("__top").isNull() | (c("reported_us") >= c("__top")), "stale"))
    reports = seen.withColumn("error_rule", rule).drop("__top")
    e = df.select(key, order, F.explode("faults").alias("f"))
    code = F.lower(F.trim(c("f.code")))
    frule = first_failure((code.rlike(r"^[a-z0-9][a-z0-9_.-]{0,63}$"), "code"), (F.lower(F.trim(F.coalesce("f.status", F.lit("active")))).isin("active", "recovered"), "status"),
                          (F.lower(F.trim(F.coalesce("f.severity", F.lit("warning")))).isin("warning", "critical"), "severity"),
                          (F.length(F.coalesce("f.detail", F.lit(""))) <= 500, "detail"))
    return reports, e.select(key, order, code.alias("code"), F.lower(F.trim(F.coalesce("f.status", F.lit("active")))).alias("status"), frule.alias("error_rule"))


def validate_connectivity(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    rules = [(F.col("phase").isin("before", "after"), "phase"), (F.col("verdict").isin("pass", "fail"), "verdict")]
    for c, (low, high) in ranges.items():
        rules += [(F.col(c).isNotNull(), f"{c}_required"), (finite(c) & F.col(c).between(low, high), f"{c}_range")]
    return df.withColumn("error_rule", first_failure(*rules))


def safe_tabular(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Neutralise spreadsheet formulas in text columns."""
    names = cols or [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    lead = lambda c: F.regexp_replace(c, r"^[ \t\r\n]+", "").rlike(r"^[=+\-@]")
    return df.withColumns({c: F.when(lead(F.col(c)), F.concat(F.lit("'"), c)).otherwise(F.col(c)) for c in names})


def exclude_demo(df: DataFrame, synthetic: str, source: str, demo_source: str) -> DataFrame:
    return df.filter(~F.coalesce(F.col(synthetic) & (F.col(source) == demo_source), F.lit(False)))


def validate_session(windows: DataFrame, sessions: DataFrame, window_us: int = 640_000) -> DataFrame:
    """Windows against their session: known, same scope, fully inside, sound metadata.

    ``sessions``: session, s_device, start_us, end_us, provenance, max_missing, max_invalid, min_valid_sec, review, reviewer.
    """
    j = windows.join(sessions, "session", "left")
    c = F.col
    meta = (c("end_us") - c("start_us")).between(1, 6 * 3_600_000_000) & (F.trim("provenance") != "") & (c("max_missing") >= 0) & (c("max_invalid") >= 0) & c("min_valid_sec").between(1e-9, 21600)
    review = c("review").isin("pending", "confirmed_normal", "rejected") & ((c("review") != "confirmed_normal") | (F.trim("reviewer") != ""))
    rule = first_failure((c("start_us").isNotNull(), "unknown_session"), (c("session").cast("string").rlike(r"^[A-Za-z0-9_.-]{1,128}$"), "session_id"), (meta, "metadata"), (review, "review"),
                         (c("device") == c("s_device"), "scope"), ((c("captured_us") >= c("start_us") - 1) & (c("captured_us") + window_us <= c("end_us") + 1), "outside_interval"))
    return j.select(*windows.columns, rule.alias("error_rule"))
