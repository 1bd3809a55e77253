"""File and message sources; each parses text or bytes columns so it works on any Spark input."""

from __future__ import annotations

import base64
import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.numeric import finite, first_failure, finite_text
from ..operators.validate import Payload, SCENARIOS, strict_json_ok
from ..plans.scan import first_of, numbered, prev, scan

HANDOFF_COLUMNS = ["timestamp", "device_id", "asset_id", "rpm", "vibration_rms_raw", "vibration_peak_hz", "acoustic_rms_raw", "acoustic_peak_hz",
                   "known_vibration_label", "known_acoustic_label", "scenario_label", "source", "is_synthetic", "vibration_unit_note", "acoustic_unit_note"]


# ------------------------------------------------------------------ telemetry

def parse_telemetry_lines(df: DataFrame, line: str) -> DataFrame:
    """JSON lines with snake_case or camelCase keys to the external record; camelCase wins when present."""
    pairs = {"rpm": ("rpm", "rpm"), "vibration_rms_raw": ("vibration_rms_raw", "vibrationRmsRaw"), "vibration_peak_hz": ("vibration_peak_hz", "vibrationPeakHz"),
             "acoustic_rms_raw": ("acoustic_rms_raw", "acousticRmsRaw"), "acoustic_peak_hz": ("acoustic_peak_hz", "acousticPeakHz")}
    texts = {"site": ("site_id", "siteId"), "asset": ("asset_id", "assetId"), "device": ("device_id", "deviceId"), "scenario_label": ("scenario_label", "scenarioLabel"),
             "known_acoustic_label": ("known_acoustic_label", "knownAcousticLabel"), "vibration_unit_note": ("vibration_unit_note", "vibrationUnitNote"),
             "acoustic_unit_note": ("acoustic_unit_note", "acousticUnitNote")}
    other = [("is_synthetic", "isSynthetic"), ("vibration_rms_mm_s", "vibrationRmsMmS"), ("acoustic_db", "acousticDb"), ("known_vibration_label", "knownVibrationLabel"),
             ("timestamp", "sequence"), ("source", "known_condition")]
    keys = list(dict.fromkeys(k for pair in [*pairs.values(), *texts.values(), *other] for k in pair))
    p = Payload(df, line, keys)

    def either(snake: str, camel: str, get) -> Column:
        return F.when(p.has(camel), get(camel)).otherwise(get(snake))

    text = p.text
    blank = lambda k: p.null(k) | (text(k) == "")
    number = lambda s, c: either(s, c, lambda k: F.when(~blank(k), finite_text(text(k))))
    bad_number = lambda s, c: either(s, c, lambda k: ~blank(k) & finite_text(text(k)).isNull())
    flag = either("is_synthetic", "isSynthetic", lambda k: F.when(F.lower(text(k)).isin("true", "false"), F.lower(text(k)) == "true"))
    raw_only = either("vibration_rms_mm_s", "vibrationRmsMmS", blank) & either("acoustic_db", "acousticDb", blank)
    vib_label = F.coalesce(F.nullif(either("known_vibration_label", "knownVibrationLabel", text), F.lit("")), text("known_condition"))
    bad = [bad_number(s, c) for s, c in pairs.values()]
    any_bad = bad[0] | bad[1] | bad[2] | bad[3] | bad[4]
    code = first_failure((p.sound, "INVALID_JSON"), (text("timestamp").isNotNull() & text("sequence").try_cast("long").isNotNull(), "MISSING_KEY"),
                         (~any_bad, "INVALID_NUMBER"), (raw_only, "RAW_ONLY_FIELD"), (flag.isNotNull(), "INVALID_BOOLEAN"))
    return p.df.select("*", text("timestamp").alias("timestamp"), text("sequence").try_cast("long").alias("sequence"),
                     *[either(s, c, text).alias(n) for n, (s, c) in texts.items()], *[number(s, c).alias(n) for n, (s, c) in pairs.items()],
                     vib_label.alias("known_vibration_label"), text("source").alias("source"), flag.alias("is_synthetic"), code.alias("error_code")).drop(*p.added)


def read_telemetry_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return parse_telemetry_lines(spark.read.text(path).filter(F.trim("value") != ""), "value")


def check_handoff(df: DataFrame) -> DataFrame:
    """Scenario enum, synthetic flag and numeric fields of hand-off rows given as text columns."""
    missing = sorted(set(HANDOFF_COLUMNS) - set(df.columns))
    if missing:
        raise ValueError("missing required columns: " + ", ".join(missing))
    empty = lambda c: F.col(c).isNull() | (F.col(c) == "")
    optional = lambda c: empty(c) | finite_text(F.col(c)).isNotNull()
    needed = lambda c: ~empty(c) & finite_text(F.col(c)).isNotNull()
    rules = [(F.col("scenario_label").isin(SCENARIOS), "SCENARIO"), (F.lower("is_synthetic") == "true", "NOT_SYNTHETIC")]
    rules += [(needed(c), f"INVALID_{c.upper()}") for c in ("vibration_rms_raw", "vibration_peak_hz")]
    rules += [(optional(c), f"INVALID_{c.upper()}") for c in ("rpm", "acoustic_rms_raw", "acoustic_peak_hz")]
    rules += [(empty(c), f"RAW_ONLY_{c.upper()}") for c in ("vibration_rms_mm_s", "acoustic_db") if c in df.columns]
    return df.withColumn("error_code", first_failure(*rules))


def read_handoff_csv(spark: SparkSession, path: str) -> DataFrame:
    return check_handoff(spark.read.option("header", True).csv(path))


def parse_topic_messages(df: DataFrame, topic: str, value: str) -> DataFrame:
    """``devices/{id}/telemetry`` messages: strict JSON object whose deviceId equals the topic's."""
    parts = F.filter(F.split(F.trim(F.col(topic)), "/"), lambda s: s != "")
    p = Payload(df, value, ["deviceId"])
    topic_ok = (F.size(parts) == 3) & (F.get(parts, F.lit(0)) == "devices") & (F.get(parts, F.lit(2)) == "telemetry")
    device = F.upper(F.trim(F.get(parts, F.lit(1))))
    body = F.upper(F.trim(F.coalesce(p.text("deviceId"), F.lit(""))))
    code = first_failure((topic_ok, "INVALID_MQTT_TOPIC"), (strict_json_ok(value), "INVALID_JSON"), (p.keys.isNotNull(), "INVALID_JSON_BODY"),
                         (device == body, "DEVICE_MAPPING_MISMATCH"))
    return p.df.select("*", F.when(topic_ok, device).alias("device"), code.alias("error_code")).drop(*p.added)


# ------------------------------------------------------------------ window archives and payloads

def parse_window_archive(df: DataFrame, line: str, max_bytes: int = 128_000) -> DataFrame:
    """One JSON window per line; blank, oversized, duplicate-key and NaN lines are rejected."""
    return df.withColumn("error_code", first_failure(((F.trim(line) != "") & (F.octet_length(line) <= max_bytes), "INVALID_LINE"), (strict_json_ok(line), "INVALID_JSON")))


def read_window_archive(spark: SparkSession, path: str) -> DataFrame:
    return parse_window_archive(spark.read.text(path), "value")


def write_window_archive(df: DataFrame, line: str, session: str, path: str) -> None:
    df.select(session, F.col(line).alias("value")).write.partitionBy(session).mode("errorifexists").text(path)


def encode_int16(counts: Column) -> Column:
    """Base64 of little-endian int16 values, built in the JVM."""
    word = lambda v: F.lpad(F.hex(F.pmod(v.cast("long"), F.lit(65536))), 4, "0")
    swapped = F.transform(counts, lambda v: F.concat(F.substring(word(v), 3, 2), F.substring(word(v), 1, 2)))
    return F.regexp_replace(F.base64(F.unhex(F.array_join(swapped, ""))), r"[\r\n]", "")


def _decode(kind: str, per_sample: int, limit: float | tuple):
    @F.pandas_udf("values array<double>, error_code string")
    def run(text: pd.Series, count: pd.Series) -> pd.DataFrame:
        values, codes = [], []
        for t, n in zip(text, count):
            code, out = None, None
            want = int(n) * per_sample
            if not isinstance(t, str) or len(t) != 4 * ((want + 2) // 3):
                code = "LENGTH"
            else:
                try:
                    body = base64.b64decode(t, validate=True)
                    canonical = len(body) == want and base64.b64encode(body).decode() == t
                except ValueError:
                    canonical = False
                if not canonical:
                    code = "NOT_CANONICAL"
                else:
                    out = np.frombuffer(body, dtype=kind).astype(np.float64)
                    low, high = limit if isinstance(limit, tuple) else (-limit, limit)
                    if not (np.isfinite(out).all() and (out >= low).all() and (out <= high).all()):
                        code, out = "OUT_OF_RANGE", None
            values.append(out)
            codes.append(code)
        return pd.DataFrame({"values": values, "error_code": codes})
    return run


def decode_raw_windows(df: DataFrame, samples: str, count: str, quality: str) -> DataFrame:
    """Interleaved XYZ int16 windows; a null payload is fine only for a window that is not valid."""
    d = _decode("<i2", 6, (-4096.0, 4095.0))(F.col(samples), F.col(count))
    r = df.withColumn("__d", d)
    absent = F.col(samples).isNull() & (F.col(quality) != "valid")
    v = F.col("__d.values")
    axis = lambda k: F.filter(v, lambda x, i: i % 3 == k)
    return r.select(*df.columns, axis(0).alias("x"), axis(1).alias("y"), axis(2).alias("z"), F.when(~absent, F.col("__d.error_code")).alias("error_code"))


def decode_frames(df: DataFrame, samples: str, count: str, limit: float = 1e9) -> DataFrame:
    """Float32 little-endian channels."""
    r = df.withColumn("__d", _decode("<f4", 4, limit)(F.col(samples), F.col(count)))
    return r.select(*df.columns, F.col("__d.values").alias("signal"), F.col("__d.error_code").alias("error_code"))


# ------------------------------------------------------------------ recordings

def check_clock(df: DataFrame, run: str, t: str, order: list[str], split: Column, rate: float = 12800.0, tolerance: float = 0.000051, minimum: int = 8192) -> DataFrame:
    """Per recording: strictly increasing clock on the sample grid, enough samples, finite values.

    Samples stand in the stored order ``order``, never in that of the clock, which is what is judged; ``split`` must not
    decrease along it.
    """
    n = numbered(df, [run], order, split, "__n")
    s = scan(n, [run], ["__n"], F.floor(F.col("__n") / 100_000).cast("long"), __p=prev(t), __a=first_of(t))
    off = F.abs((F.col(t) - F.col("__a")) - (F.col("__n") - 1) / F.lit(rate))
    g = s.groupBy(run).agg(F.count(F.lit(1)).alias("samples"), F.count_if(F.col("__p").isNotNull() & (F.col(t) <= F.col("__p"))).alias("not_increasing"),
                           F.max(off).alias("grid_error"), F.count_if(~finite(t)).alias("nonfinite"))
    code = first_failure((F.col("nonfinite") == 0, "NONFINITE"), ((F.col("samples") >= minimum) & (F.col("not_increasing") == 0), "CLOCK_NOT_MONOTONE"), (F.col("grid_error") <= tolerance, "CLOCK_OFF_GRID"))
    return g.withColumn("error_code", code)


WAVEFORM_SCHEMA = "t double, c1 double, c2 double, c3 double, c4 double, c5 double, c6 double, c7 double, c8 double"


def read_waveform_csv(spark: SparkSession, path: str, minimum: int = 8192) -> tuple[DataFrame, DataFrame]:
    """Nine-column recordings to XYZ rows (columns 4-6) of sound files, and the verdict per file."""
    raw = spark.read.schema(WAVEFORM_SCHEMA).csv(path).withColumn("run", F.col("_metadata.file_path"))
    # place in the file: where the row's split begins, then the row's number in the task that reads the split
    placed = raw.withColumns({"__block": F.col("_metadata.file_block_start"), "__row": F.monotonically_increasing_id()})
    verdict = check_clock(placed, "run", "t", ["__block", "__row"], F.col("__block"), minimum=minimum)
    good = raw.join(verdict.filter("error_code is null").select("run"), "run", "left_semi")
    return good.select("run", "t", F.col("c3").alias("x"), F.col("c4").alias("y"), F.col("c5").alias("z")), verdict


# reviewed labels of recording names (fixed values)
RECORDING_LABELS = ["health", "bearing_ball_h", "bearing_ball_l", "bearing_inner_h", "bearing_inner_l", "bearing_outer_h", "bearing_outer_l", "bearing_outer_h_and_inner_h",
                    "bend", "broken_bar", "broken_bar_and_bearing_inner_h", "broken_bar_and_bearing_outer_h", "dynamic_eccentricity", "dynamic_eccentricity_and_bearing_inner_h",
                    "dynamic_eccentricity_and_bearing_outer_h", "static_eccentricity_h", "static_eccentricity_l", "static_eccentricity_h_and_bearing_inner_h",
                    "static_eccentricity_h_and_bearing_outer_h", "winding_h", "winding_l", "winding_h_and_bearing_inner_h", "winding_h_and_bearing_outer_h", "unbalance",
                    "imbalance", "voltage_unbalance_h", "voltage_unbalance_l"]
RECORDING_NAME = r"(?i)^(.+)_(speed|torque)_circulation_(\d+)Nm_(\d+)rpm(?:_(\d{12})(d)?)?\.csv$"


def recording_metadata(df: DataFrame, path: str) -> DataFrame:
    """Label, mode, load and speed from the file name; an unreviewed label or unknown name is an error code."""
    name = F.element_at(F.split(F.col(path), "/"), -1)
    part = lambda i: F.regexp_extract(name, RECORDING_NAME, i)
    label, hit = F.lower(part(1)), name.rlike(RECORDING_NAME)
    skip = name.startswith("._") | F.array_contains(F.split(F.col(path), "/"), "__MACOSX") | ~F.lower(name).endswith(".csv")
    unsafe = F.col(path).startswith("/") | F.array_contains(F.split(F.col(path), "/"), "..")
    code = (F.when(unsafe, "UNSAFE_PATH").when(skip, "SKIPPED").when(~hit, "UNKNOWN_NAME").when(~label.isin(RECORDING_LABELS), "UNREVIEWED_LABEL"))
    keep = lambda c: F.when(code.isNull(), c)
    return df.select("*", keep(label).alias("label"), keep(F.lower(part(2))).alias("mode"), keep(part(3).try_cast("int")).alias("load_nm"), keep(part(4).try_cast("int")).alias("speed_rpm"),
                     keep(F.concat_ws("_", F.lower(part(2)), F.concat(part(3), F.lit("Nm")), F.concat(part(4), F.lit("rpm")))).alias("condition"), code.alias("error_code"))


# bearing recordings: specimen, label and the file numbers at 0..3 HP; rated speed per load (fixed values)
LOAD_RPM = (1797, 1772, 1750, 1730)
SPECIMENS = [("CWRU-NORMAL-BASELINE", "NORMAL", (97, 98, 99, 100)), ("CWRU-IR-0007", "BEARING_FAULT_INNER", (105, 106, 107, 108)),
             ("CWRU-IR-0014", "BEARING_FAULT_INNER", (169, 170, 171, 172)), ("CWRU-IR-0021", "BEARING_FAULT_INNER", (209, 210, 211, 212)),
             ("CWRU-BALL-0007", "BEARING_FAULT_BALL", (118, 119, 120, 121)), ("CWRU-BALL-0014", "BEARING_FAULT_BALL", (185, 186, 187, 188)),
             ("CWRU-BALL-0021", "BEARING_FAULT_BALL", (222, 223, 224, 225)), ("CWRU-OR-0007", "BEARING_FAULT_OUTER", (130, 131, 132, 133)),
             ("CWRU-OR-0014", "BEARING_FAULT_OUTER", (197, 198, 199, 200)), ("CWRU-OR-0021", "BEARING_FAULT_OUTER", (234, 235, 236, 237))]


def recording_dim(spark: SparkSession) -> DataFrame:
    rows = [(n, s, label, hp, LOAD_RPM[hp]) for s, label, files in SPECIMENS for hp, n in enumerate(files)]
    return spark.createDataFrame(rows, "file_no int, specimen string, label string, load_hp int, rated_rpm int")


def with_recording_dim(df: DataFrame, file_no: str, rpm: str) -> DataFrame:
    """Recording attributes by file number; measured speed first, else the rated speed of the load."""
    d = recording_dim(df.sparkSession).withColumnRenamed("file_no", "__no")
    j = df.join(F.broadcast(d), F.col(file_no) == F.col("__no"), "left").drop("__no")
    return j.withColumn("effective_rpm", F.coalesce(F.col(rpm).cast("double"), F.col("rated_rpm").cast("double")))


def pcm_to_float(frames: bytes, width: int, channels: int) -> np.ndarray:
    """Channel 0 of integer PCM scaled to [-1, 1]; 8-bit silence is its midpoint."""
    if width == 3:
        b = np.frombuffer(frames, np.uint8).reshape(-1, 3).astype(np.int32)
        raw = b[:, 0] | (b[:, 1] << 8) | (b[:, 2] << 16)
        data, top = np.where(raw >= 1 << 23, raw - (1 << 24), raw) * 256.0, float(2**31 - 1)
    else:
        data = np.frombuffer(frames, {1: np.uint8, 2: "<i2", 4: "<i4"}[width]).astype(np.float64)
        top = float(2 ** (8 * width - 1) - 1)
    data = data.reshape(-1, channels)[:, 0]
    return (data - 128.0) / 128.0 if width == 1 else data / top


def decode_wav(df: DataFrame, path: str, content: str) -> DataFrame:
    """Binary WAV files to (path, sample_rate, signal)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p, c in zip(pdf[path], pdf[content]):
                with wave.open(io.BytesIO(c)) as w:
                    out.append((p, w.getframerate(), pcm_to_float(w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels())))
            yield pd.DataFrame(out, columns=["path", "sample_rate", "signal"])
    return df.select(path, content).mapInPandas(run, "path string, sample_rate int, signal array<double>")


def read_wav(spark: SparkSession, pattern: str) -> DataFrame:
    """WAV files of one common rate; mixed rates are refused."""
    files = spark.read.format("binaryFile").load(pattern)
    out = decode_wav(files, "path", "content")
    rates = out.agg(F.count_distinct("sample_rate").alias("n")).first()["n"]
    if rates > 1:
        raise ValueError("recordings with different sample rates cannot be mixed")
    return out


def build_feature_table(vibration: DataFrame, acoustic: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Both modalities with their own feature columns in one table, and the label distribution."""
    both = vibration.withColumn("modality", F.lit("vibration")).unionByName(acoustic.withColumn("modality", F.lit("acoustic")), allowMissingColumns=True)
    return both, both.groupBy("modality", label).count().withColumnRenamed("count", "rows")


def frames_to_feature_rows(df: DataFrame, frame: str, channels: dict[str, tuple[str, int]]) -> DataFrame:
    """Capture to an unlabeled training row: one column per channel.feature plus a source digest.

    ``channels`` maps a name to its sample array column and FFT block size.
    """
    from ..operators.features import edge_statistics
    out = df
    for name, (samples, block) in channels.items():
        s = edge_statistics(out.withColumn("__s", F.col(samples)), "__s", block).drop("__s")
        out = s.withColumnsRenamed({"rms": f"{name}_rms", "peak": f"{name}_peak", "kurtosis": f"{name}_kurtosis", **{f"band{i}": f"{name}_band{i}" for i in range(3)}})
    digest = F.sha2(F.concat_ws("|", F.col(frame).cast("string"), *[F.to_json(F.struct(s)) for s, _ in channels.values()]), 256)
    return out.withColumns({"source_digest": digest, "target_label": F.lit(None).cast("string"), "label_status": F.lit("unlabeled"), "training_eligible": F.lit(False)})

