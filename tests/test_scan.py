"""Bucketed scans equal plain windows, also when one key holds most rows."""

import random

from pyspark.sql import Window, functions as F

from tremolith.functions.numeric import bucket
from tremolith.plans import scan as sc


def _rows(seed, n=400):
    r = random.Random(seed)
    out, t = [], 0
    for i in range(n):
        t += r.choice([0, 1, 1, 5, 40])
        out.append(("hot" if r.random() < 0.6 else r.choice("abc"), t, i, r.choice([None, r.randint(-5, 9)])))
    return out


def test_every_item_equals_the_plain_window(spark):
    df = spark.createDataFrame(_rows(1), "k string, t long, i long, v int")
    got = sc.scan(df, ["k"], ["t", "i"], bucket("t", 30), prev=sc.prev("v"), nxt=sc.following("v"), first=sc.first_of("v"), total=sc.running_sum("v"),
                  before=sc.running_sum("v", False), top=sc.running_max("v"), low=sc.running_min("v", False), last=sc.last_set("v"),
                  last_before=sc.last_set("v", False), ahead=sc.next_set("v"), ahead_excl=sc.next_set("v", False))
    w = Window.partitionBy("k").orderBy("t", "i")
    upto, past = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    want = df.select("k", "t", "i", "v", F.lag("v").over(w).alias("prev"), F.lead("v").over(w).alias("nxt"), F.first("v").over(upto).alias("first"),
                     zero(F.sum("v").over(upto)).alias("total"), zero(F.sum("v").over(past)).alias("before"), F.max("v").over(upto).alias("top"),
                     F.min("v").over(past).alias("low"), F.last("v", True).over(upto).alias("last"), F.last("v", True).over(past).alias("last_before"),
                     F.first("v", True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("ahead"),
                     F.first("v", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("ahead_excl"))
    cols = want.columns
    assert sorted(map(repr, (tuple(r[c] for c in cols) for r in got.collect()))) == sorted(map(repr, map(tuple, want.collect())))


def test_history_and_runs(spark):
    rows = _rows(2)
    df = spark.createDataFrame(rows, "k string, t long, i long, v int")
    h = {r["i"]: r["history"] for r in sc.history(df, ["k"], ["t", "i"], bucket("t", 25), F.col("i"), 7).collect()}
    for key in "hot", "a", "b", "c":
        ids = [r[2] for r in sorted(rows, key=lambda r: (r[1], r[2])) if r[0] == key]
        for at, i in enumerate(ids):
            assert h[i] == ids[max(0, at - 7):at]
    p = sc.numbered(df, ["k"], ["t", "i"], bucket("t", 25), "pos")
    p = sc.scan(p, ["k"], ["t", "i"], bucket("t", 25), was=sc.prev(F.coalesce("v", F.lit(-99))))
    r = sc.runs(p, ["k"], ["t", "i"], bucket("t", 25), F.col("was").isNull() | (F.col("was") != F.coalesce("v", F.lit(-99))), F.col("t"))
    got = {x["i"]: (x["run_n"], x["run_at"]) for x in r.collect()}
    for key in "hot", "a", "b", "c":
        n, at, was = 0, None, object()
        for _, t, i, v in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            n, at = (n + 1, at) if v == was else (1, t)
            was = v
            assert got[i] == (n, at)


def test_empty_input(spark):
    df = spark.createDataFrame([], "k string, t long, v int")
    assert sc.scan(df, ["k"], ["t"], bucket("t", 5), p=sc.prev("v")).count() == 0


def test_declared_split_equals_the_plain_window(spark, monkeypatch):
    df = spark.createDataFrame(_rows(3, 1000), "k string, t long, i long, v int")
    monkeypatch.setattr(sc, "POSITIONS", 9)
    split = sc.declared_split("t")
    assert df.groupBy("k", split.alias("b")).count().filter("k = 'hot'").count() > 5
    with_split = sc.scan(df, ["k"], ["t", "i"], split, s=sc.running_sum("v"))
    plain = sc.scan(df, ["k"], ["t", "i"], None, s=sc.running_sum("v"))
    assert sorted(map(tuple, with_split.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
