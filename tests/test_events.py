"""Lifecycle, persistence and streaming against an independent state machine."""

import random

import pytest

from pyspark.sql import functions as F

from tremolith.operators import alerts as al, dedupe as dd, events as ev
from tremolith.streaming import streams as st

SEC = 1_000_000


def machine(rows, c):
    """Plain walk over one asset's points: list of [start, end, reason, peak, samples, merges]."""
    out, cur, done = [], None, None
    run_in, run_out = [], []
    for t, score, fault in rows:
        if fault:
            if cur:
                cur[1], cur[2] = t, "sensor_fault"
            cur = done = None
            run_in, run_out = [], []
            continue
        if score is None:
            run_in, run_out = [], []
            continue
        if cur is None:
            run_in = run_in + [(t, score)] if score >= c.enter else []
            if len(run_in) >= c.n_enter and t - run_in[0][0] >= c.sec_enter * SEC:
                peak = max(s for _, s in run_in)
                if done and 0 <= run_in[0][0] - done[1] <= c.merge_gap_sec * SEC:
                    cur, done = done, None
                    cur[1:] = [None, None, max(cur[3], peak), cur[4] + len(run_in), cur[5] + 1]
                else:
                    cur = [run_in[0][0], None, None, peak, len(run_in), 0]
                    out.append(cur)
                run_in, run_out = [], []
            continue
        cur[3], cur[4] = max(cur[3], score), cur[4] + 1
        run_out = run_out + [t] if score < c.exit else []
        if len(run_out) >= c.n_exit and t - run_out[0] >= c.sec_exit * SEC:
            cur[1], cur[2] = t, "recovered"
            done, cur, run_out = cur, None, []
    return [tuple(e) for e in out]


def random_points(seed, n=300):
    r = random.Random(seed)
    rows, t, level = [], 0, 40.0
    for i in range(n):
        t += r.choice([1, 5, 20]) * SEC
        if r.random() < 0.15:
            level = r.choice([30.0, 60.0, 75.0, 90.0])
        score = None if r.random() < 0.05 else min(100.0, max(0.0, level + r.choice([-5.0, 0.0, 5.0])))
        rows.append((t, i, score, r.random() < 0.03))
    return rows


CONFIGS = [ev.Lifecycle(), ev.Lifecycle(80, 50, 3, 2, 10, 5, 60), ev.Lifecycle(75, 75, 1, 1, 0, 0, 0)]


def _points(spark, seeds):
    data = [(s, *r) for s in seeds for r in random_points(s)]
    return spark.createDataFrame(data, "asset long, t_us long, seq long, score double, fault boolean")


def test_lifecycle_equals_the_walk(spark):
    df = _points(spark, range(12)).cache()
    for cfg, width in [(c, w) for c in CONFIGS for w in (300 * SEC, None)]:
        got = {}
        for e in ev.event_lifecycle(df, ["asset"], ["t_us", "seq"], "t_us", cfg, width).collect():
            got.setdefault(e["asset"], []).append((e["start_us"], e["end_us"], e["end_reason"], e["max_score"], e["samples"], e["merge_count"]))
        for s in range(12):
            want = machine([(t, sc, f) for t, _, sc, f in random_points(s)], cfg)
            assert sorted(got.get(s, [])) == sorted(want), (s, cfg)


def test_stream_restart_equals_batch_and_rejects_late_points(spark, tmp_path):
    st.use_rocksdb(spark)
    df = _points(spark, range(5))
    cut_at = 1_500 * SEC
    inbox, root = str(tmp_path / "in"), str(tmp_path / "run")
    df.filter(F.col("t_us") < cut_at).coalesce(1).write.parquet(inbox)
    run = lambda: st.drain(st.stream_lifecycle(spark.readStream.schema(df.schema).parquet(inbox)), root)
    run()
    late = df.filter((F.col("t_us") < cut_at) & (F.col("asset") == 0)).limit(1)
    df.filter(F.col("t_us") >= cut_at).unionByName(late).coalesce(1).write.mode("append").parquet(inbox)
    log = run()
    assert log.filter("kind = 'rejected'").count() == 1
    got = sorted((r["asset"], r["start_us"], r["end_us"], r["max_score"], r["samples"], r["merge_count"]) for r in st.latest_events(log).collect())
    batch = ev.event_lifecycle(df, ["asset"], ["t_us", "seq"], "t_us")
    want = sorted((r["asset"], r["start_us"], r["end_us"], r["max_score"], r["samples"], r["merge_count"]) for r in batch.collect())
    assert repr(got) == repr(want)


def test_rule_change_resets_candidate_but_keeps_open_event():
    p = st.EventLifecycle(ev.Lifecycle())
    s = {"rule": "rule-1"}
    assert p._step(s, 0, 90.0, False) is None
    s.update(n_in=0)  # what a new rule version does
    assert p._step(s, SEC, 90.0, False) is None
    assert p._step(s, 2 * SEC, 90.0, False) == "started"
    s.update(n_in=0, n_out=0)
    assert p._step(s, 3 * SEC, 90.0, False) == "updated"


def test_lanes_do_not_move_each_other(spark, tmp_path):
    st.use_rocksdb(spark)
    rows = [(1, SEC * t, t, 90.0, False, lane) for lane, ts in (("live", (100, 101)), ("history", (1, 2))) for t in ts]
    df = spark.createDataFrame(rows, "asset long, t_us long, seq long, score double, fault boolean, lane string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    log = st.drain(st.stream_lifecycle(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), lane="lane"), str(tmp_path / "run"))
    assert log.filter("kind = 'started'").count() == 2 and log.filter("kind = 'rejected'").count() == 0


def test_admission_one_file_per_batch(spark, tmp_path):
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    s = st.read_files(spark, str(tmp_path / "in"), "*.parquet", spark.range(1).schema, 1)
    st.drain_batches(s, str(tmp_path / "run"), lambda b, i: seen.append((i, b.count())), "append")
    assert [n for _, n in seen if n] == [10, 10, 10]


def test_repeated_batch_overwrites_itself(spark, tmp_path):
    write = st.idempotent_sink(str(tmp_path), lambda b: {"all": b})
    write(spark.range(5), 0)
    write(spark.range(5), 0)
    assert spark.read.parquet(str(tmp_path / "all")).count() == 5


def test_persistence_edges(spark):
    rows = [(1, 0, True, True), (1, 1, True, True), (1, 2, True, False), (1, 3, True, True), (1, 4, True, True), (1, 5, True, True), (1, 7, True, True), (2, 6, True, True)]
    df = spark.createDataFrame(rows, "run long, idx long, hit boolean, ok boolean")
    got = {(r["run"], r["idx"]): (r["single"], r["three_consecutive"]) for r in ev.persistence(df, ["run"], "idx", "hit", "ok", index_bucket=2).collect()}
    assert got == {(1, 0): (1, -1), (1, 1): (1, -1), (1, 2): (-1, -1), (1, 3): (1, -1), (1, 4): (1, -1), (1, 5): (1, 1), (1, 7): (1, -1), (2, 6): (1, -1)}


@pytest.mark.parametrize("index_bucket", [2, 7])
def test_persistence_against_brute_force(spark, index_bucket):
    r = random.Random(index_bucket)
    rows = [(k, i, r.choice([True, True, False, None]), r.random() < 0.9) for k in ("a", None) for i in range(120) if r.random() < 0.93]
    got = {(x["k"], x["i"]): x.asDict() for x in ev.persistence(spark.createDataFrame(rows, "k string, i long, hit boolean, ok boolean"), ["k"], "i", "hit", "ok", index_bucket=index_bucket).collect()}
    known = {(k, i): (bool(hit), ok) for k, i, hit, ok in rows}
    assert len(got) == len(rows)
    for (k, i), x in got.items():
        for name, (width, need) in ev.POLICIES.items():
            last = [known.get((k, i - n), (False, False)) for n in range(width)]
            assert x[name] == (int(sum(h for h, _ in last) >= need) if all(ok for _, ok in last) else -1), (k, i, name)


def test_cooldown_against_brute_force(spark):
    r = random.Random(5)
    rows = [("p", "hot" if r.random() < 0.7 else "cold", r.randrange(0, 4000) * SEC, i, 60) for i in range(250)]
    df = spark.createDataFrame(rows, "policy string, asset string, t long, id long, cd int")
    got = {x["id"]: x["kept"] for x in al.apply_cooldown(df, ["policy", "asset"], "t", "id", "cd", 200 * SEC).collect()}
    for asset in "hot", "cold":
        last = None
        for _, _, t, i, cd in sorted((x for x in rows if x[1] == asset), key=lambda x: (x[2], x[3])):
            keep = last is None or t - last >= cd * SEC
            last = t if keep else last
            assert got[i] == keep


def _served(spans):
    """Brute force: (key, start, end, order) in arrival order against all accepted before."""
    taken, out = {}, {}
    for k, s, e, i in sorted(spans, key=lambda x: (x[3], x[1], x[2])):
        mine = taken.setdefault(k, [])
        out[(k, i)] = all(not (s < b and e > a) for a, b in mine)
        mine += [(s, e)] if out[(k, i)] else []
    return out


@pytest.mark.parametrize("kind, width", [("random", 300), ("along", None), ("against", 300), ("alternating", None), ("nested", 300), ("points", 20)])
def test_overlaps_against_brute_force(spark, kind, width):
    r = random.Random(5)
    n = 60
    spans = {
        "random": [("d" if r.random() < 0.7 else None, s, s + r.randrange(1, 90), i) for i in range(n) for s in [r.randrange(0, 1200)]],
        "along": [("d", 20 * i, 20 * i + 30 + i % 3, i) for i in range(n)],
        "against": [("d", -20 * i, -20 * i + 30 + i % 3, i) for i in range(n)],
        "alternating": [("d", 20 * i, 20 * i + 30, (i // 12) * 1000 + (i if i // 12 % 2 else -i)) for i in range(n)],
        "nested": [("d", i, 2 * n - i, n - i if i % 2 else i) for i in range(n)],
        "points": [("d", s, s + r.choice([0, 0, 1, 7]), i) for i in range(n) for s in [r.randrange(0, 60)]]}[kind]
    df = spark.createDataFrame(spans, "k string, s long, e long, i long")
    got = {(x["k"], x["i"]): x["accepted"] for x in dd.reject_overlaps(df, ["k"], "s", "e", "i", width).collect()}
    assert got == _served(spans)


def test_overlaps_without_bounds_and_empty(spark):
    schema = "k string, s long, e long, i long"
    rows = [("a", None, 5, 0), ("a", 1, None, 1), ("a", 9, 2, 2), ("a", 3, 6, 3), ("a", 5, 7, 4), ("a", 5, 7, None)]
    got = dd.reject_overlaps(spark.createDataFrame(rows, schema), ["k"], "s", "e", "i").filter("accepted").collect()
    assert [(x["s"], x["e"], x["i"]) for x in got] == [(5, 7, None)]  # a null order comes first
    assert dd.reject_overlaps(spark.createDataFrame([], schema), ["k"], "s", "e", "i", 10).count() == 0


def test_open_incident_ignores_other_targets(spark, tmp_path):
    st.use_rocksdb(spark)
    steps = [("a", True)] * 3 + [("b", True)] * 4 + [("a", False)] * 2 + [("b", False)] + [("a", False)] * 3 + [("b", True)] * 3
    rows = [(1, i * 650_000, i, i * 650_000, target, True, hit) for i, (target, hit) in enumerate(steps)]
    df = spark.createDataFrame(rows, "device long, t_us long, idx long, uptime_us long, target string, ok boolean, hit boolean")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = st.drain(st.stream_incidents(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))), str(tmp_path / "run"))
    got = [(r["at_us"] // 650_000, r["target"], r["kind"]) for r in out.orderBy("at_us").collect()]
    assert got == [(2, "a", "opened"), (3, "a", "unknown"), (7, "a", "observing"), (9, "a", "unknown"), (10, "a", "observing"), (12, "a", "closed"), (15, "b", "opened")]
