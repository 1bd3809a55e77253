"""Run queries beside their SQL oracles: python -m tests.compare SF [name-substring ...]"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, bool):
        return v
    return v


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differs(spark_df, con, sql):
    got_cols, got = table_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    want_cols, want = table_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}", len(got)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}", len(got)
    bad = [(g, w) for g, w in zip(got, want) if repr(g) != repr(w)]
    bad = [(g, w) for g, w in bad if g != w]
    return (f"{len(bad)} rows differ, first {bad[0]}" if bad else None), len(got)


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    from tremolith.session import build_session
    import __spark_entry__ as entry
    spark = build_session("local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    failed = []
    for name, fn in entry.queries().items():
        if len(sys.argv) > 2 and not any(name.startswith(a) for a in sys.argv[2:]):
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                why, n = differs(df, con, oracles[name])
            else:
                why, n = None, df.count()
        except Exception as error:
            why, n = f"{type(error).__name__}: {str(error)[:600]}", -1
        print(f"{'FAIL' if why else 'ok  '} {name:34s} {n:7d} rows {time.time()-t:6.2f}s {'' if name in oracles else '(no oracle)'} {why or ''}", flush=True)
        if why:
            failed.append(name)
    print("failed:", failed)
