"""Kernels, codecs, files, splits and versions on small fixtures."""

import base64
import hashlib
import json
import math
import struct
import threading
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremolith.functions import spectra as sp
from tremolith.functions.hashing import feature_digest
from tremolith.operators import aggregates as ag, datasets as ds, features as fe, scoring as sc, validate as va
from tremolith.sources import readers as rd, sinks as sk


def window(n=512, rate=800.0, noise=3):
    t = np.arange(n) / rate
    r = np.random.default_rng(noise)
    return np.stack([0.2 * np.sin(2 * np.pi * f * t) + 0.01 * r.standard_normal(n) for f in (23.4375, 64.0625, 104.6875)])


def test_base21_and_66_on_a_known_window(spark):
    w = window()
    df = spark.createDataFrame([(1, *[a.tolist() for a in w]), (2, [0.0] * 512, *[a.tolist() for a in w[:2]]), (3, [0.1] * 5, *[a.tolist() for a in w[:2]]),
                                (4, (w[0] * 100).tolist(), *[a.tolist() for a in w[:2]]), (5, [float("nan")] * 512, *[a.tolist() for a in w[:2]])],
                               "id int, x array<double>, y array<double>, z array<double>")
    rows = {r["id"]: r for r in fe.spectral66(df, "x", "y", "z").collect()}
    f = rows[1]["features"]
    assert len(f) == 66 and abs(f[0] - 0.2 / math.sqrt(2)) < 2e-3
    assert abs(f[21 + 11] - 23.4375) < 1e-9 and abs(f[21 + 14 + 11] - 64.0625) < 1e-9
    assert all(v == float(np.float32(v)) for v in f[:21])
    assert [rows[i]["reason"] for i in (2, 3, 4, 5)] == ["constant_or_near_constant_axis", "sample_gap", "outside_adxl16g_range", "nonfinite_samples"]
    assert all(rows[i]["features"] is None for i in (2, 3, 4, 5))


def test_variants_and_rails(spark):
    base = [[0.5, 1.0, 3.0, 0.1, 0.2, 0.3, 0.4] * 3, [0.5, 0.4, 3.0, 0.1, 0.2, 0.3, 0.4] * 3, [0.5, 1.0, 3.0, 0.0, 0.0, 0.0, 0.0] * 3, [1.0] * 20]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(base)], "id int, f array<double>")
    r = {x["id"]: x for x in fe.derive_variant(df, "f", "ratios36").collect()}
    assert len(r[0]["derived"]) == 36 and r[0]["derived"][21:26] == pytest.approx([0.1, 0.2, 0.3, 0.4, 2.0])
    assert [r[i]["reason"] for i in (1, 2, 3)] == ["INVALID_RMS_PEAK_OR_KURTOSIS", "INSUFFICIENT_BAND_ENERGY", "INVALID_FEATURES"]
    c = spark.createDataFrame([([1, 4094],), ([1, 4095],)], "c array<int>")
    assert [x["reason"] for x in fe.counts_to_g(c, "c").collect()] == [None, "clipped"]


def test_decimation_equals_direct_filter(spark):
    x = np.random.default_rng(1).standard_normal(9000)
    df = spark.createDataFrame([("r", i, float(v)) for i, v in enumerate(x)], "run string, pos long, v double")
    got = [r["v"] for r in fe.decimate(df, "run", "pos", "v", block=1024).orderBy("pos").collect()]
    full = np.convolve(x, sp.lowpass(), "same")[::16][32:-32]
    assert len(got) == len(full) and np.allclose(got, full, atol=1e-9)


def test_native_moments_and_measurement(spark):
    w = window(64)
    df = spark.createDataFrame([tuple(a.tolist() for a in w)], "x array<double>, y array<double>, z array<double>")
    m = fe.moments9(df, "x", "y", "z").first()
    d = w[0] - w[0].mean()
    assert m["ku_a_1"] == pytest.approx((d ** 4).mean() / (d ** 2).mean() ** 2) and m["cf_a_1"] == pytest.approx(abs(w[0]).max() / math.sqrt((w[0] ** 2).mean()))
    s = spark.createDataFrame([(3.0, 4.0, 12.0, [0.0, 1.0, 1.0], [0.0, 1.0, 1.0], [0.0, 0.0, 0.0]), (0.0, 0.0, 0.0, [0.0], [0.0], [0.0])],
                              "a double, b double, c double, x array<double>, y array<double>, z array<double>")
    rows = fe.measured_vibration(s, ["a", "b", "c"], ["x", "y", "z"]).collect()
    assert rows[0]["vibration_rms_g"] == 13.0 and rows[0]["dominant_hz"] == 2 * 1.5625 and rows[1]["frequency_status"] == "no_peak"


def test_digest_and_codecs(spark):
    v = [1.5, -2.0, 3.25]
    df = spark.createDataFrame([(v,), (None,)], "v array<double>")
    assert [r[0] for r in df.select(feature_digest(F.col("v"))).collect()] == [hashlib.sha256(struct.pack("<3d", *v)).hexdigest(), hashlib.sha256(b"").hexdigest()]
    c = spark.createDataFrame([([1, -2, 4095],)], "c array<long>")
    assert c.select(rd.encode_int16(F.col("c"))).first()[0] == base64.b64encode(struct.pack("<3h", 1, -2, 4095)).decode()


def test_json_screening(spark):
    texts = ['{"a":1}', '{"a":1,"a":2}', '{"a":NaN}', '{"a":1e999}', '{"a":1} x', '"\\ud800"', None, '[1,{"b":null}]']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r["ok"] for r in df.orderBy("i").select(va.strict_json_ok("t").alias("ok")).collect()] == [True, False, False, False, False, False, False, True]


def test_file_sources(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text("\n".join([
        json.dumps({"timestamp": "2026-01-01T00:00:00Z", "sequence": 1, "device_id": "d", "vibration_rms_raw": "1.5", "is_synthetic": "TRUE", "acoustic_db": ""}),
        json.dumps({"timestamp": "2026-01-01T00:00:00Z", "sequence": 2, "deviceId": "e", "vibrationRmsRaw": None, "isSynthetic": False, "vibrationRmsMmS": 3}), "{bad"]))
    rows = {r["sequence"]: r for r in rd.read_telemetry_jsonl(spark, str(tmp_path / "t.jsonl")).collect()}
    assert rows[1]["vibration_rms_raw"] == 1.5 and rows[1]["is_synthetic"] and rows[1]["error_code"] is None
    assert rows[2]["device"] == "e" and rows[2]["error_code"] == "RAW_ONLY_FIELD" and rows[None]["error_code"] == "INVALID_JSON"
    head = ",".join(rd.HANDOFF_COLUMNS)
    (tmp_path / "h.csv").write_text(head + "\n" + ",".join(["t", "d", "a", "", "1", "2", "", "", "N", "N", "normal", "s", "True", "u", "u"]) + "\n"
                                    + ",".join(["t", "d", "a", "x", "1", "2", "", "", "N", "N", "normal", "s", "True", "u", "u"]) + "\n")
    assert sorted(str(r["error_code"]) for r in rd.read_handoff_csv(spark, str(tmp_path / "h.csv")).collect()) == ["INVALID_RPM", "None"]
    for name, channels, width, frames in (("a", 1, 2, struct.pack("<3h", 0, 32767, -32767)), ("b", 2, 1, bytes([128, 0, 255, 0]))):
        with wave.open(str(tmp_path / f"{name}.wav"), "wb") as w:
            w.setnchannels(channels), w.setsampwidth(width), w.setframerate(16000)
            w.writeframes(frames)
    sig = {r["path"][-5:]: r["signal"] for r in rd.read_wav(spark, str(tmp_path / "*.wav")).collect()}
    assert sig["a.wav"] == [0.0, 1.0, -1.0] and sig["b.wav"] == [0.0, 127 / 128]
    good = "\n".join(f"{i / 12800:.6f},0,0,1,2,3,0,0,0" for i in range(200))
    (tmp_path / "wave").mkdir()
    (tmp_path / "wave" / "good.csv").write_text(good)
    (tmp_path / "wave" / "bad.csv").write_text("\n".join(f"{i / 12000:.6f},0,0,1,2,3,0,0,0" for i in range(200)))
    xyz, verdict = rd.read_waveform_csv(spark, str(tmp_path / "wave"), minimum=100)
    assert xyz.count() == 200 and [r["error_code"] for r in verdict.orderBy("error_code").collect()] == [None, "CLOCK_OFF_GRID"]


def test_archive_roundtrip_and_exports(spark, tmp_path):
    df = spark.createDataFrame([("s1", '{"i":1}'), ("s2", '{"i":NaN}')], "session string, line string")
    rd.write_window_archive(df, "line", "session", str(tmp_path / "arc"))
    back = rd.read_window_archive(spark, str(tmp_path / "arc"))
    assert sorted((r["session"], r["error_code"] or "") for r in back.collect()) == [("s1", ""), ("s2", "INVALID_JSON")]
    rows = spark.createDataFrame([(1, "=x", "train"), (2, "y", "test")], "id int, t string, dataset_split string")
    sk.export_dataset(rows, ds.build_manifest(rows, "DS", ["id"], "dataset_split", "t"), str(tmp_path / "d"))
    assert {r["t"] for r in spark.read.parquet(str(tmp_path / "d/rows")).collect()} == {"'=x", "y"}


def test_two_writers_of_one_version(spark, tmp_path):
    """Both write, one claims; with other content the other one fails, and what is read is whole and the claimed one."""
    root, out = str(tmp_path), []

    def write(n):
        try:
            out.append((n, sk.publish_version(spark.range(n).withColumn("v", F.col("id") * 2), "V", root, ["id", "v"], n)))
        except ValueError:
            out.append((n, "conflict"))

    writers = [threading.Thread(target=write, args=(n,)) for n in (100, 200, 300)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(o for _, o in out) == ["conflict", "conflict", "published"]
    (winner,) = [n for n, o in out if o == "published"]
    assert sk.read_current(spark, root).count() == winner and len(list((tmp_path / "data").iterdir())) == 1


def test_versions_are_immutable(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    root = str(tmp_path / "v")
    assert sk.publish_version(a, "DS-1", root, ["id", "v"], 10) == "published"
    assert sk.publish_version(a, "DS-1", root, ["id", "v"], 11) == "reused"
    with pytest.raises(ValueError):
        sk.publish_version(a.limit(1), "DS-1", root, ["id", "v"], 12)
    sk.publish_version(a.limit(1), "DS-2", root, ["id", "v"], 13)
    assert sk.current_version(spark, root) == "DS-2" and sk.read_current(spark, root).count() == 1


def test_split_sequence_equals_the_greedy(spark):
    for groups, ratios in ((7, (0.7, 0.15, 0.15)), (20, (0.6, 0.2, 0.2)), (33, (0.5, 0.5, 0.0)), (3, (0.8, 0.1, 0.1)), (50, (0.34, 0.33, 0.33))):
        r = dict(zip(ds.SPLITS, ratios))
        target = ds.split_targets(groups, r)
        left, want = dict(target), []
        for _ in range(groups):
            pick = max((s for s in ds.SPLITS if left[s] > 0), key=lambda s: (left[s] / target[s], r[s], -ds.SPLITS.index(s)))
            left[pick] -= 1
            want.append(pick)
        got = [x["dataset_split"] for x in ds.split_sequence(spark, target, r).orderBy("pos").collect()]
        assert got == want and all(target[s] >= 1 for s in ds.SPLITS if r[s] > 0)


def test_group_split_covers_labels_without_leaks(spark):
    rows = [(g, lab) for g in range(30) for lab in ("N", "A")[: 1 + g % 2] for _ in range(3)]
    df = spark.createDataFrame(rows, "g int, label string")
    s = df.join(ds.group_split(df, "g", "label", {"train": 0.6, "validation": 0.2, "test": 0.2}), "g")
    assert s.groupBy("g").agg(F.count_distinct("dataset_split").alias("n")).filter("n > 1").count() == 0
    assert s.select("label", "dataset_split").distinct().count() == 6
    with pytest.raises(ValueError):
        ds.group_split(df.filter("g < 2"), "g", "label", {"train": 0.6, "validation": 0.2, "test": 0.2})


def test_quantile_auc_and_weights(spark):
    df = spark.createDataFrame([(i / 100, i % 3 == 0, i % 7) for i in range(100)], "s double, label boolean, run int")
    assert ag.quantile_higher(df, [], "s", 0.99, 1e-3).first()["threshold"] == 0.99
    tied = spark.createDataFrame([(0.5, True), (0.5, False), (0.9, True), (0.1, False)], "s double, label boolean")
    assert ag.roc_auc(tied, [], F.col("label"), "s").first()["auc"] == 0.875
    none = spark.createDataFrame([(0.5, False)], "s double, label boolean")
    assert ag.binary_metrics(none, [], F.col("label"), F.col("s") > 0.5).first()["recall"] is None


def test_feature_deviations_zero_variance(spark):
    df = spark.createDataFrame([(1, {"a": 2.0, "b": 5.0, "c": float("nan")})], "id int, f map<string,double>")
    base = spark.createDataFrame([("a", 1.0, 0.0, 1.0, 1.0), ("b", 1.0, 2.0, -5.0, 7.0), ("c", 0.0, 1.0, -3.0, 3.0)], "feature string, mean double, std double, low double, high double")
    legacy = {r["feature"]: (r["deviation_sigma"], r["outlier"]) for r in sc.feature_deviations(df, "id", "f", base).collect()}
    assert legacy == {"b": (2.0, False)}
    stored = {r["feature"]: (r["deviation_sigma"], r["outlier"]) for r in sc.feature_deviations(df, "id", "f", base, tolerance=0.0).collect()}
    assert stored == {"a": (None, True), "b": (2.0, False)}


def test_mel_filters_and_lstm_shapes():
    bank = sp.mel_bank(16000, 512, 40)
    assert bank.shape == (40, 257) and (bank >= 0).all() and (bank.sum(1) > 0).all()
    h = sp.lstm(np.ones((2, 5, 3), np.float32), np.zeros((16, 3)), np.zeros((16, 4)), np.zeros(16))
    assert h.shape == (2, 5, 4) and np.allclose(h, 0)


def test_snapshot_slot_rules(spark):
    us = lambda s: int(s * 1e6)
    nine = {n: 1.0 for n in va.FEATURES9}
    mk = lambda i, at, slot, seq, q="valid", reason=None, f=nine: (i, "D", "S", "A", "N", "0" * 32, 1, 1, 512, 800, "dimensionless", q, reason, f, True, us(at), slot, seq)
    rows = [mk(1, 998.36, 1000, 1), mk(2, 999.36, 1000, 1), mk(3, 998.3, 1000, 1), mk(4, 998.5, 1001, 1), mk(5, 998.5, 1000, None), mk(6, 1000, 1000, 1, "invalid", "timeout", None), mk(7, 999, 1000, 1, "invalid", "timeout", None),
            mk(8, 998.5, None, 1), mk(9, 998.5, None, None)]
    df = spark.createDataFrame(rows, "id int, device string, site string, asset string, sensor string, boot string, idx int, uptime_us long, sample_count int, rate_hz int, unit string, quality string, reason string, "
                                     "features map<string,double>, digest_ok boolean, captured_us long, slot long, history_seq long")
    got = {r["id"]: r["error_rule"] for r in va.validate_snapshot(df, True, F.lit(us(1000))).collect()}
    assert got == {1: None, 2: None, 3: "slot_fit", 4: "slot", 5: "history_sequence", 6: None, 7: "slot_fit", 8: "history_sequence", 9: None}
