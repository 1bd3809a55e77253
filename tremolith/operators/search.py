"""Filters, sorts, paging and due work; one helper serves every history list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SORTS = {"unreviewed_desc": [("unreviewed", False), ("at_us", False), ("id", True)], "occurredAt_asc": [("at_us", True), ("id", True)],
         "occurredAt_desc": [("at_us", False), ("id", True)], "score_desc": [("score", False), ("at_us", False), ("id", True)]}


def ordered(df: DataFrame, keys: list[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in keys]


def page_history(df: DataFrame, where: dict, sort: list[tuple[str, bool]], page: int, size: int, at: str | None = None,
                 low: int | None = None, high: int | None = None) -> DataFrame:
    """Equality or any-of filters, inclusive time bounds, an order and one page."""
    if low is not None and high is not None and low > high:
        raise ValueError("the lower time bound is after the upper one")
    for c, v in where.items():
        if v is not None:
            df = df.filter(F.col(c).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(c) == v)
    if at and low is not None:
        df = df.filter(F.col(at) >= low)
    if at and high is not None:
        df = df.filter(F.col(at) <= high)
    return df.orderBy(*ordered(df, sort)).offset((page - 1) * size).limit(size)


def search_events(df: DataFrame, sort: str = "occurredAt_desc", page: int = 1, size: int = 50, low=None, high=None, **where) -> DataFrame:
    return page_history(df.withColumn("unreviewed", ~F.col("reviewed")), where, SORTS[sort], page, size, "at_us", low, high).drop("unreviewed")


def search_devices(df: DataFrame, page: int = 1, size: int = 50, **where) -> DataFrame:
    return page_history(df, where, [("device", True)], page, size)


def page_after(df: DataFrame, at: str, ident: str, cursor: tuple | None, n: int) -> DataFrame:
    """Keyset page in (at, id) descending order; ``has_more`` tells whether a further page exists."""
    if cursor is not None:
        df = df.filter((F.col(at) < cursor[0]) | ((F.col(at) == cursor[0]) & (F.col(ident) < cursor[1])))
    top = df.orderBy(F.col(at).desc(), F.col(ident).desc()).limit(n + 1)
    # the window sees at most n + 1 rows
    w = Window.orderBy(F.col(at).desc(), F.col(ident).desc())
    r = top.withColumns({"__r": F.row_number().over(w), "has_more": F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) > n})
    return r.filter(F.col("__r") <= n).drop("__r")


def latest_snapshots(df: DataFrame, key: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(F.col("captured_us").desc(), F.col("late").asc(), F.col("ordinal").desc())
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def canonical_order(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.orderBy(*cols)


def phase_order(df: DataFrame, scenario: str, order: list[str], split: Column | None) -> DataFrame:
    """Readable replay order: normal thirds between the anomaly groups; ties keep the source order."""
    from ..plans.scan import numbered
    pos = numbered(df, [scenario], order, split, "__p")
    n = df.filter(F.col(scenario) == "normal").agg(F.count(F.lit(1)).alias("__n")).withColumn("__one", F.lit(1))
    third = F.floor(F.col("__n") / 3)
    j = pos.withColumn("__one", F.lit(1)).join(n, "__one")
    phase = (F.when(F.col(scenario) == "vibration_anomaly", 1).when(F.col(scenario) == "acoustic_anomaly", 3)
             .when(F.col(scenario) == "combined_anomaly", 5).when(F.col("__p") <= third, 0).when(F.col("__p") <= 2 * third, 2).otherwise(4))
    return j.select(*df.columns, phase.alias("phase"), F.col("__p").alias("phase_pos"))


def due_deliveries(df: DataFrame, channel: str, due: str, ident: str, now_us: Column, n: int) -> DataFrame:
    """Pending deliveries that are due, earliest first, at most ``n`` per channel."""
    w = Window.partitionBy(channel).orderBy(due, ident)
    return df.filter((F.col("status") == "pending") & (F.col(due) <= now_us)).withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r")


def telemetry_for(df: DataFrame, site=None, asset=None, device=None, low=None, high=None, at: str = "t_us") -> DataFrame:
    """Inclusive read filters; a reversed range is an error.

    ISO text bounds are cast to the type of ``at``, so a stored timestamp column is filtered in the file scan.
    """
    if low is not None and high is not None and low > high:
        raise ValueError("from must not be later than to")
    for c, v in (("site", site), ("asset", asset), ("device", device)):
        df = df if v is None else df.filter(F.col(c) == v)
    bound = lambda v: F.lit(v).cast(df.schema[at].dataType) if isinstance(v, str) else v
    out = df if low is None else df.filter(F.col(at) >= bound(low))
    return out if high is None else out.filter(F.col(at) <= bound(high))


def visible_to(df: DataFrame, site: str, allowed: list) -> DataFrame:
    return df if "*" in allowed else df.filter(F.col(site).isin(list(allowed)))
