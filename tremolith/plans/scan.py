"""Ordered scans over keyed streams that never hold a whole key in one task.

A window partitioned by the stream key alone puts a hot stream into a single task.  Here every
stream is cut into buckets that are monotone in its order (an hour, a day, ten thousand indices).
A local window runs inside each (key, bucket); a partial aggregate shrinks each bucket to one
summary row; a second window over the summaries yields what each bucket inherits from the buckets
before (or after) it; the two are joined on (key, bucket).  Results equal the plain window exactly.

The bucket is declared (see :func:`declared_split`).  A split of ``None`` means the caller knows from its schema that every
key fits a task; the scan is then the plain window with one shuffle and one sort.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numeric import col
from ..session import cut


@dataclass(frozen=True)
class Item:
    kind: str
    expr: Column
    inclusive: bool = True


def prev(expr) -> Item:
    """Value of ``expr`` on the preceding row of the stream."""
    return Item("prev", col(expr))


def following(expr) -> Item:
    """Value of ``expr`` on the next row of the stream."""
    return Item("next", col(expr))


def running_sum(expr, inclusive: bool = True) -> Item:
    return Item("sum", col(expr), inclusive)


def running_max(expr, inclusive: bool = True) -> Item:
    return Item("max", col(expr), inclusive)


def running_min(expr, inclusive: bool = True) -> Item:
    return Item("min", col(expr), inclusive)


def last_set(expr, inclusive: bool = True) -> Item:
    """Latest non-null value so far: the state left behind by trigger rows."""
    return Item("last", col(expr), inclusive)


def next_set(expr, inclusive: bool = True) -> Item:
    """Earliest non-null value from here on."""
    return Item("ahead", col(expr), inclusive)


def first_of(expr) -> Item:
    """Value on the first row of the stream (its anchor)."""
    return Item("first", col(expr))


# declared bucket widths: a day of microseconds for times, ten thousand for positions and identifiers
DAY_US = 86_400_000_000
POSITIONS = 10_000


def declared_width(at: str, width: int | None = None) -> int:
    """``width``, or a day for a name that ends in ``_us`` or ``__t``, or POSITIONS."""
    return width or (DAY_US if at.endswith("_us") or at.endswith("__t") else POSITIONS)


def declared_split(at: str, width: int | None = None) -> Column:
    """Bucket over the numeric order column ``at``, of the declared width.  It is fixed by the schema, so plans neither
    count rows nor differ by size."""
    return F.floor(F.col(at) / F.lit(declared_width(at, width))).cast("long")


def _join_back(local: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    renamed = carry.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate([*keys, "__b"])],
                           *[F.col(c) for c in carry.columns if c.startswith("__c_")])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate([*keys, "__b"])])
    return local.join(renamed, same, "inner")


def _plain(df: DataFrame, keys: list[str], order: list[str], items: dict[str, Item]) -> DataFrame:
    near = Window.partitionBy(*keys).orderBy(*order)
    back = Window.partitionBy(*keys).orderBy(*[F.col(o).desc() for o in order])
    start = Window.unboundedPreceding
    made = {
        "prev": lambda e, i: F.lag(e).over(near), "next": lambda e, i: F.lead(e).over(near), "first": lambda e, i: F.first(e).over(near.rowsBetween(start, 0)),
        "sum": lambda e, i: F.coalesce(F.sum(e).over(near.rowsBetween(start, i)), F.lit(0)), "max": lambda e, i: F.max(e).over(near.rowsBetween(start, i)),
        "min": lambda e, i: F.min(e).over(near.rowsBetween(start, i)), "last": lambda e, i: F.last(e, ignorenulls=True).over(near.rowsBetween(start, i)),
        "ahead": lambda e, i: F.last(e, ignorenulls=True).over(back.rowsBetween(start, i))}
    base = df.withColumns({f"__e_{n}": i.expr for n, i in items.items()})
    keep = [F.col(c) for c in df.columns if c not in items]
    return base.select(*keep, *[made[i.kind](F.col(f"__e_{n}"), 0 if i.inclusive else -1).alias(n) for n, i in items.items()])


def scan(df: DataFrame, keys: list[str], order: list[str], bucket: Column | None, **items: Item) -> DataFrame:
    """Add one column per item; ``bucket`` must never decrease along ``order``."""
    if bucket is None:
        return _plain(df, keys, order, items)
    names = list(df.columns)
    base = df.withColumns({"__b": bucket, **{
        f"__e_{n}": F.struct(i.expr.alias("v")) if i.kind in ("prev", "next", "first") else i.expr
        for n, i in items.items()}})
    at = F.struct(*[F.col(o) for o in order])
    near = Window.partitionBy(*keys, "__b").orderBy(*order)
    back = Window.partitionBy(*keys, "__b").orderBy(*[F.col(o).desc() for o in order])
    far = Window.partitionBy(*keys).orderBy("__b")
    before = far.rowsBetween(Window.unboundedPreceding, -1)
    away = Window.partitionBy(*keys).orderBy(F.col("__b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    local, summary, carried, result = {}, [], {}, {}
    for n, i in items.items():
        e, s, c = F.col(f"__e_{n}"), F.col(f"__s_{n}"), F.col(f"__c_{n}")
        here = F.col(f"__l_{n}")
        stop = 0 if i.inclusive else -1
        frame = near.rowsBetween(Window.unboundedPreceding, stop)
        if i.kind == "prev":
            local[f"__l_{n}"] = F.lag(e).over(near)
            summary.append(F.max_by(e, at).alias(f"__s_{n}"))
            carried[f"__c_{n}"] = F.lag(s).over(far)
            result[n] = F.coalesce(here, c)["v"]
        elif i.kind == "next":
            local[f"__l_{n}"] = F.lead(e).over(near)
            summary.append(F.min_by(e, at).alias(f"__s_{n}"))
            carried[f"__c_{n}"] = F.lead(s).over(far)
            result[n] = F.coalesce(here, c)["v"]
        elif i.kind == "first":
            summary.append(F.min_by(e, at).alias(f"__s_{n}"))
            carried[f"__c_{n}"] = F.first(s).over(far.rowsBetween(Window.unboundedPreceding, 0))
            result[n] = c["v"]
        elif i.kind == "sum":
            local[f"__l_{n}"] = F.sum(e).over(frame)
            summary.append(F.sum(e).alias(f"__s_{n}"))
            carried[f"__c_{n}"] = F.sum(s).over(before)
            result[n] = F.coalesce(here, F.lit(0)) + F.coalesce(c, F.lit(0))
        elif i.kind in ("max", "min"):
            fn, pick = (F.max, F.greatest) if i.kind == "max" else (F.min, F.least)
            local[f"__l_{n}"] = fn(e).over(frame)
            summary.append(fn(e).alias(f"__s_{n}"))
            carried[f"__c_{n}"] = fn(s).over(before)
            result[n] = pick(here, c)
        elif i.kind == "last":
            local[f"__l_{n}"] = F.last(e, ignorenulls=True).over(frame)
            summary.append(F.max_by(e, F.when(e.isNotNull(), at)).alias(f"__s_{n}"))
            carried[f"__c_{n}"] = F.last(s, ignorenulls=True).over(before)
            result[n] = F.coalesce(here, c)
        elif i.kind == "ahead":
            local[f"__l_{n}"] = F.last(e, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, stop))
            summary.append(F.min_by(e, F.when(e.isNotNull(), at)).alias(f"__s_{n}"))
            carried[f"__c_{n}"] = F.last(s, ignorenulls=True).over(away)
            result[n] = F.coalesce(here, c)
        else:
            raise ValueError(i.kind)
    shrunk = base.groupBy(*keys, "__b").agg(*summary)
    carry = shrunk.select(*keys, "__b", *[v.alias(k) for k, v in carried.items()])
    joined = _join_back(base.withColumns(local) if local else base, carry, keys)
    return joined.select(*[F.col(n) for n in names if n not in items], *[v.alias(k) for k, v in result.items()])


def ranged_sum(df: DataFrame, order: str, value: str, name: str, inclusive: bool = True) -> DataFrame:
    """Running sum of ``value`` along ``order`` over a whole table without a key, for values of ``order`` that are distinct.

    Rows are dealt to tasks by ranges of ``order`` and written with the number of their range, so the ranges stay what they
    are; each range is summed by itself, and the sums before it (one number a range) are added.  No task sees more than its
    range, and the driver one row a range.
    """
    spark = df.sparkSession
    parts = cut(df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), order).withColumn("__part", F.spark_partition_id()))
    totals, before, ahead = parts.groupBy("__part").agg(F.sum(value).alias("s")).orderBy("__part").collect(), 0, []
    for r in totals:
        ahead.append((r["__part"], before))
        before += r["s"]
    carry = spark.createDataFrame(ahead, "__part int, __ahead long")
    frame = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = parts.withColumn("__here", F.coalesce(F.sum(value).over(frame), F.lit(0)))
    return local.join(F.broadcast(carry), "__part").withColumn(name, F.col("__here") + F.col("__ahead")).drop("__part", "__here", "__ahead")  # one row a range


def history(df: DataFrame, keys: list[str], order: list[str], bucket: Column | None, value: Column, n: int,
            name: str = "history") -> DataFrame:
    """Add an array of the ``n`` preceding values, oldest first (shorter at stream start)."""
    names = [c for c in df.columns if c != name]
    if bucket is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-n, -1)
        plain = df.withColumn("__v", value).withColumn("__l", F.collect_list(F.struct(F.col("__v").alias("v"))).over(w))
        return plain.select(*names, F.transform("__l", lambda x: x["v"]).alias(name))
    base = df.withColumns({"__b": bucket, "__v": value})
    near = Window.partitionBy(*keys, "__b").orderBy(*order)
    back = Window.partitionBy(*keys, "__b").orderBy(*[F.col(o).desc() for o in order])
    far = Window.partitionBy(*keys).orderBy("__b").rowsBetween(-n, -1)
    tail = (base.withColumn("__rn", F.row_number().over(back)).filter(F.col("__rn") <= n)
            .groupBy(*keys, "__b")
            .agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col("__rn").alias("r"), F.col("__v").alias("v"))), asc=False),
                             lambda s: s["v"]).alias("__tail")))
    carry = tail.select(*keys, "__b", _last(F.flatten(F.collect_list("__tail").over(far)), n).alias("__c_tail"))
    local = base.withColumn("__l", F.collect_list(F.struct(F.col("__v").alias("v"))).over(near.rowsBetween(-n, -1)))
    both = F.concat(F.col("__c_tail"), F.transform("__l", lambda s: s["v"]))
    return _join_back(local, carry, keys).select(*names, _last(both, n).alias(name))


def _last(array: Column, n: int) -> Column:
    return F.when(F.size(array) <= n, array).otherwise(F.slice(array, -n, n))


def numbered(df: DataFrame, keys: list[str], order: list[str], bucket: Column | None, name: str = "pos") -> DataFrame:
    """Dense 1-based position of every row in its stream."""
    return scan(df, keys, order, bucket, **{name: running_sum(F.lit(1).cast("long"))})


def runs(df: DataFrame, keys: list[str], order: list[str], bucket: Column | None, start: Column, at: Column) -> DataFrame:
    """Run bookkeeping for rows whose boolean ``start`` opens a new run.

    Adds ``run_id`` (position of the first row), ``run_n`` (1-based place in the run) and
    ``run_at`` (value of ``at`` on the first row).  Needs a dense ``pos`` column.
    """
    marked = scan(df, keys, order, bucket,
                  __run=last_set(F.when(start, F.struct(F.col("pos").alias("p"), at.alias("t")))))
    return marked.withColumns({
        "run_id": F.col("__run")["p"], "run_n": F.col("pos") - F.col("__run")["p"] + 1,
        "run_at": F.col("__run")["t"]}).drop("__run")
