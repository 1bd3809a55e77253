"""Rules by asset and version: batch against the keyed state machine, and the bounded conflict state."""

import random

import pytest
from pyspark.sql import functions as F

from tremolith.operators import rules as ru
from tremolith.streaming import pipeline as pl, streams as st

SEC = 1_000_000
RULES = "asset long, from_us long, version long, active boolean, threshold double, hysteresis double, duration_sec double, n_enter int, n_exit int, merge_gap_sec long"


def random_case(seed):
    rng = random.Random(seed)
    rules, points = [], []
    for asset in range(12):
        t = rng.randrange(0, 50)
        for version in range(rng.randrange(0, 4)):
            level = rng.choice([40.0, 50.0, 60.0])
            rules.append((asset, t * SEC, version, rng.random() > 0.15, level, rng.choice([0.0, 10.0, 80.0]), rng.choice([0.0, 3.0]), rng.choice([1, 2]), rng.choice([1, 2]), rng.choice([0, 5, 30])))
            t += rng.randrange(0, 120)
        at = 0
        for seq in range(150):
            at += rng.choice([0, 1, 1, 2, 7])
            score = rng.choice([None, float("nan"), 101.0, -1.0]) if rng.random() < 0.06 else round(rng.uniform(20, 80) / 10) * 10.0
            points.append((asset, at * SEC, seq, score, rng.random() < 0.03, rng.choice([None, "a", "b"])))
    return rules, points


def by_state(rules, points):
    """Events of the state machine, point by point."""
    out = {}
    for asset in {p[0] for p in points}:
        own = [[r[1], r[2], r[3], r[4], max(0.0, r[4] - r[5]), r[7], r[8], r[6], r[6], r[9]] for r in rules if r[0] == asset]
        s = {"rules": sorted(own)}
        for _, t, seq, score, fault, model in sorted((p for p in points if p[0] == asset), key=lambda p: (p[1], p[2])):
            kind, e = pl.RuledLifecycle()._point(s, t, seq, score, fault, model)
            if e is not None and kind in pl.EVENT_KINDS:
                out[asset, e["no"]] = (e["start"], e["end"], e["reason"], e["peak"], e["peak_model"], e["n"], e["merges"], e["last"], e["version"], e["model"], e["by"][0])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_batch_equals_state(spark, seed):
    rules, points = random_case(seed)
    frame = spark.createDataFrame(points, "asset long, t_us long, seq long, score double, fault boolean, model string").repartition(3)
    table = ru.rule_rows(spark.createDataFrame(rules, RULES), ["asset"])
    got = ru.event_lifecycle_rules(frame, table, ["asset"], ["t_us", "seq"], "t_us", bucket_us=40 * SEC).collect()
    mine = {(r.asset, r.event_no): (r.start_us, r.end_us, r.end_reason, r.max_score, r.max_model, r.samples, r.merge_count, r.last_score, r.rule_version, r.model, r.trigger.seq) for r in got}
    want = by_state(rules, points)
    assert mine == want and len(want) > 25 and any(v[6] for v in want.values())


def test_rule_change_resets_entry_and_keeps_event(spark):
    rules = [(1, 0, 1, True, 50.0, 10.0, 0.0, 2, 2, 0), (1, 10 * SEC, 2, True, 70.0, 10.0, 0.0, 2, 2, 0)]
    scores = [(9, 60.0), (10, 80.0), (11, 90.0), (12, 65.0), (13, 55.0), (14, 55.0)]  # the first one counted for version 1 only
    points = [(1, t * SEC, t, v, False, None) for t, v in scores]
    frame = spark.createDataFrame(points, "asset long, t_us long, seq long, score double, fault boolean, model string")
    events = ru.event_lifecycle_rules(frame, ru.rule_rows(spark.createDataFrame(rules, RULES), ["asset"]), ["asset"], ["t_us", "seq"], "t_us")
    (e,) = events.collect()
    assert (e.start_us, e.end_us, e.rule_version, e.samples, e.model, e.trigger.seq) == (10 * SEC, 14 * SEC, 2, 5, "unknown", 11)
    (r,) = ru.rule_event_records(events, ["asset"]).collect()
    assert (r.severity, r.duration_sec, r.status, r.threshold_version) == ("critical", 4, "closed", 2)


def test_no_rule_no_event(spark):
    points = spark.createDataFrame([(1, SEC, 1, 90.0, False, "m")], "asset long, t_us long, seq long, score double, fault boolean, model string")
    none = ru.rule_rows(spark.createDataFrame([], RULES), ["asset"])
    assert ru.event_lifecycle_rules(points, none, ["asset"], ["t_us", "seq"], "t_us").count() == 0
    assert ru.event_lifecycle_rules(points.where("false"), none, ["asset"], ["t_us", "seq"], "t_us").count() == 0


def test_conflicts_beyond_the_bound(spark, tmp_path):
    """Three sequences are remembered; using one keeps it, the one not used for longest is forgotten."""
    st.use_rocksdb(spark)
    sent = [[(1, "a"), (2, "b"), (3, "c")], [(1, "a"), (4, "d"), (1, "x")], [(2, "z"), (3, "c"), (1, "a")]]
    n = 0
    for batch in sent:
        rows = [("A", "live", dev, seq, seq, 0.0, False, content, n + k) for k, (seq, content) in enumerate(batch) for dev in ("d1", "d2")]
        n += len(batch)
        spark.createDataFrame(rows, pl.POINT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(pl.POINT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = st.drain(pl.dedupe_stream(s, F.col("model"), 3), str(tmp_path / "run")).collect()
    for dev in ("d1", "d2"):
        rows = [(r.seq, r.disposition, r.evicted) for r in sorted(got, key=lambda r: r.arrival) if r.device == dev]
        assert rows == [(1, "accepted", 0), (2, "accepted", 0), (3, "accepted", 0), (1, "duplicate", 0), (4, "accepted", 1), (1, "conflict", 1),
                        (2, "accepted", 2), (3, "accepted", 3), (1, "accepted", 4)]
