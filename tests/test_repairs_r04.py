"""Cases of the fourth review that used to fail by time or disk at size."""

import json
from itertools import groupby

from pyspark.sql import functions as F

from tests.test_repairs_r03 import _scopes
from tremolith.operators import alerts as al, joins as jn
from tremolith.streaming import pipeline as pl, streams as st

RULES = "asset string, from_us long, version long, active boolean, score_enter double, score_exit double, n_enter int, n_exit int, sec_enter double, sec_exit double, merge_gap_sec long"


def _line(seq, value, **other):
    return json.dumps({"timestamp": "2024-01-02T00:00:00Z", "sequence": seq, "siteId": "s1", "assetId": "a1", "deviceId": "D1", "vibrationRmsRaw": value, "vibrationPeakHz": 50, "vibrationRmsMmS": None,
                       "acousticDb": None, "scenarioLabel": None, "isSynthetic": False} | other)


def _log(spark, payloads):
    st.use_rocksdb(spark)
    lines = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "arrival long, payload string").coalesce(1)
    lines = lines.withColumns({"lane": F.lit("live"), "fault": F.lit(False), "model": F.lit("m")})
    rules = spark.createDataFrame([("A1", 0, 1, True, 75.0, 50.0, 1, 1, 0.0, 0.0, 30), ("A2", 0, 1, True, 75.0, 50.0, 1, 1, 0.0, 0.0, 30)], RULES)
    return pl.telemetry_stream(lines, F.lit(1_706_700_000_000_000), 20.0, 30.0, 1.0, rules.where("asset = 'A2'"), rules.where("asset = 'A1'"), 40)


def test_lines_are_parsed_once(spark):
    """Broken lines and points leave the same pass: no member is parsed anew for a rule or for a second branch."""
    plan = _log(spark, [_line(1, 90)])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_broken_lines_travel_with_points(spark, monkeypatch):
    """In one call of the processors with rules: broken lines get their rule and nothing else, sequences stay whole numbers."""
    monkeypatch.setattr(pl, "SHARDS", 1)
    far = 2**53 + 1
    rows = _log(spark, [_line(far, 90), _line(far, 90), _line(far, 91), _line(0, 5), _line(far + 2, -1), "{", _line(7, 5, assetId=" "), _line(far + 2, 90)]).collect()
    got = {r.arrival: r for r in rows}
    assert len(rows) == len(got) == 8
    assert {k: (r.kind, r.seq) for k, r in got.items() if r.kind != "quarantined"} == {0: ("started", far), 1: ("duplicate", far), 2: ("conflict", far), 7: ("updated", far + 2)}
    assert {k: r.end_reason for k, r in got.items() if r.kind == "quarantined"} == {3: "sequence", 4: "vibration_rms", 5: "unknown_fields", 6: "identifier"}
    assert all(r.lane == "live" and (r.asset, r.device, r.seq, r.t_us, r.score, r.event_no, r.start_us) == (None,) * 7 for r in rows if r.kind == "quarantined")


def test_pairs_come_in_runs(spark, monkeypatch):
    """Each policy meets the events of its key in runs, which a file stores once a policy; no run is longer than the bound."""
    monkeypatch.setattr(jn, "LIST_RUN", 64, raising=False)
    e = spark.range(1000).select(F.col("id").alias("event_id"), F.lit("a").alias("site"), F.lit("x").alias("asset"), F.lit("w").alias("severity"))
    none = F.array().cast("array<string>")
    p = spark.range(30).select(F.col("id").alias("policy_id"), F.lit("w").alias("severity"), *[none.alias(c) for c in ("site_ids", "asset_ids", "scope_site_ids")])
    rows = [(r.policy_id, r.event_id) for r in jn.match_scopes(e, p).collect()]
    assert len(rows) == 30_000 and set(rows) == {(k, i) for k in range(30) for i in range(1000)}
    runs = [len(list(own)) for _, own in groupby(rows, key=lambda r: r[0])]
    assert len(runs) == 30 * 16 and max(runs) == 64


def test_lists_and_single_events_match_alike(spark, monkeypatch):
    monkeypatch.setattr(jn, "BROADCAST_ROWS", 30)
    monkeypatch.setattr(jn, "TASK_PAIRS", 50)
    monkeypatch.setattr(jn, "LIST_TASKS", 3)
    monkeypatch.setattr(jn, "LIST_RUN", 2)
    e, p, want = _scopes(spark)
    for listed in (True, False):
        m = al.match_policies(e, p, F.col("minute"), listed=listed)
        assert m.columns == [*e.columns, *[c for c in p.columns if c != "severity"], "suppressed"]
        got = [((r.policy_id, r.event_id), r.suppressed) for r in m.collect()]
        assert len(got) == len(want) and dict(got) == want
