"""Cases that used to give wrong answers or never ended."""

import random

import pytest
from pyspark.sql import functions as F

from tremolith.operators import alerts as al, datasets as ds, dedupe as dd, joins as jn
from tremolith.sources import readers as rd


def test_exchanged_samples_are_rejected(spark, tmp_path):
    for name, swap in (("good", False), ("bad", True)):
        t = [i / 12800.0 for i in range(700)]
        if swap:
            t[300], t[301] = t[301], t[300]
        (tmp_path / f"{name}.csv").write_text("".join(f"{x:.9f},1,2,3,4,5,6,7,8\n" for x in t))
    good, verdict = rd.read_waveform_csv(spark, str(tmp_path), minimum=640)
    codes = {r.run.rsplit("/", 1)[-1]: r.error_code for r in verdict.collect()}
    assert codes == {"good.csv": None, "bad.csv": "CLOCK_NOT_MONOTONE"} and good.count() == 700


def test_null_keys_and_ties(spark):
    rows = [(None, 1, 1, "a"), (None, 1, 1, "b"), (None, 1, 2, "a"), (5, None, 3, "x"), (5, None, 3, "x"), (7, 1, 9, "q")]
    df = spark.createDataFrame(rows, "k1 int, k2 int, o int, d string")
    got = sorted((str(r.k1), str(r.k2), r.o, r.d, r.disposition) for r in dd.dedupe_with_conflicts(df, ["k1", "k2"], "o", "d").collect())
    assert got == [("5", "None", 3, "x", "accepted"), ("5", "None", 3, "x", "duplicate"), ("7", "1", 9, "q", "accepted"),
                   ("None", "1", 1, "a", "accepted"), ("None", "1", 1, "b", "conflict"), ("None", "1", 2, "a", "duplicate")]


def test_open_span_holds_its_first_instant(spark):
    points = spark.createDataFrame([(1, 10, 100), (2, 10, 101)], "id int, k int, t long")
    spans = spark.createDataFrame([(10, 100, None, "e")], "k int, s long, e long, name string")
    assert [(r.id, r.name) for r in jn.interval_join(points, spans, ["k"], "t", "s", "e").collect()] == [(1, "e")]


@pytest.mark.parametrize("bucket_us", [None, 3_000_000])
def test_no_cooldown_keeps_all(spark, bucket_us):
    rows = [(1, i // 2 * 1_000_000, i, 0) for i in range(8)] + [(2, i * 1_000_000, i, 2) for i in range(8)]
    df = spark.createDataFrame(rows, "p int, t long, id int, cd int")
    got = {(r.p, r.id) for r in al.apply_cooldown(df, ["p"], "t", "id", "cd", bucket_us).where("kept").collect()}
    assert got == {(1, i) for i in range(8)} | {(2, i) for i in (0, 2, 4, 6)}


def test_cooldown_by_row_with_sent_deliveries(spark):
    """Against a walk: waits that differ by row, none among them, ties, null keys, repeated rows, deliveries sent before."""
    r = random.Random(3)
    rows = [(r.choice([None, "p"]), r.choice(["a", "a", "a", "b"]), r.randrange(0, 900) * 1_000_000, i // 2 if i % 40 < 2 else i, r.choice([0, 20, 20, 45, 90])) for i in range(400)]
    sent = [(r.choice([None, "p"]), "a", r.randrange(0, 900) * 1_000_000, 10_000 + i) for i in range(12)] + [(rows[7][0], rows[7][1], rows[7][2], rows[7][3])]
    df = spark.createDataFrame(rows, "policy string, asset string, t long, id long, cd int").repartition(4)
    gone = spark.createDataFrame(sent, "policy string, asset string, t long, id long")
    for out, bucket_us in ((None, 50_000_000), (gone, 50_000_000), (gone, None)):
        got = sorted((x.policy or "", x.asset, x.t, x.id, x.cd, x.kept) for x in al.apply_cooldown(df, ["policy", "asset"], "t", "id", "cd", bucket_us, out).collect())
        want, before = [], set(sent) if out is not None else set()
        for key in {x[:2] for x in rows}:
            own = [(t, i, 1, cd) for p, a, t, i, cd in rows if (p, a) == key] + [(t, i, 0, 0) for p, a, t, i in before if (p, a) == key]
            done, last = {i for p, a, _, i in before if (p, a) == key}, None
            for t, i, real, cd in sorted(own, key=lambda x: (x[0], x[1])):
                keep = not real or i in done or last is None or t - last >= cd * 1_000_000
                last = t if keep else last
                if real:
                    want.append((key[0] or "", key[1], t, i, cd, keep))
        assert [(*g[:4], g[5]) for g in got] == [(*w[:4], w[5]) for w in sorted(want)], out is not None


def test_targets_are_nearest_with_one_at_least():
    assert ds.split_targets(10, {"train": 0.7, "validation": 0.15, "test": 0.15}) == {"train": 7, "validation": 2, "test": 1}
    assert ds.split_targets(3, {"train": 0.98, "validation": 0.01, "test": 0.01}) == {"train": 1, "validation": 1, "test": 1}
    assert ds.split_targets(9, {"train": 0.5, "validation": 0.5, "test": 0.0}) == {"train": 5, "validation": 4, "test": 0}
    with pytest.raises(ValueError):
        ds.split_targets(2, {"train": 0.6, "validation": 0.2, "test": 0.2})


def test_group_split_fills_by_rows_and_follows_the_seed(spark):
    df = spark.range(4000).select((F.col("id") % 200).alias("g"), F.when(F.col("id") % 200 < 150, "N").otherwise("A").alias("label"))
    ratios = {"train": 0.6, "validation": 0.2, "test": 0.2}
    first, again, other = (ds.group_split(df, "g", "label", ratios, seed) for seed in (1, 1, 2))
    shares = {r.dataset_split: r.n for r in df.join(first, "g").groupBy("dataset_split").agg((F.count(F.lit(1)) / 4000).alias("n")).collect()}
    assert all(abs(shares[s] - ratios[s]) < 0.03 for s in ratios)
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(first) == key(again) != key(other)


def test_too_few_groups_is_an_error_unless_asked(spark):
    g = spark.createDataFrame([(1, "a"), (2, "a")], "g int, s string")
    ratios = {"train": 0.6, "validation": 0.2, "test": 0.2}
    with pytest.raises(ValueError):
        ds.interleaved_split(g, "g", "s", ratios)
    assert ds.interleaved_split(g, "g", "s", ratios, "hash").count() == 2


def test_bulk_items_tied_in_order(spark):
    rows = [(1, "b1", 5, "x"), (1, "b1", 5, "y"), (1, "b2", 5, "x"), (2, "b1", 1, None), (2, "b1", 1, None)]
    items, totals = dd.bulk_ingest(spark.createDataFrame(rows, "k int, b string, o int, d string"), "b", ["k"], ["o"], "d", F.lit(True))
    got = sorted((r.k, str(r.d), r.item_status) for r in items.collect())
    assert got == [(1, "x", "accepted"), (1, "x", "duplicate"), (1, "y", "rejected"), (2, "None", "accepted"), (2, "None", "duplicate")]
    assert sum(r.accepted for r in totals.collect()) == 2
