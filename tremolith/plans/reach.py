"""Reachability along chains by pointer doubling: what a walk would visit, without walking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..session import cut


def reach(sure: DataFrame, links: DataFrame) -> DataFrame:
    """All ``a`` that can be reached from those of ``sure`` (a) over ``links`` (a, b), one link at most from each node.

    After round k everything within 2**k links is known, so a chain of n rows takes log2(n) rounds of two joins.  Rounds are
    cut by written checkpoints.  Chains must not run in circles nor into one another.
    """
    jump, found = cut(links.select("a", "b")), [cut(sure.select("a"))]
    while True:
        new = cut(reduce(DataFrame.unionByName, found).join(jump, "a").select(F.col("b").alias("a")))
        if new.isEmpty():
            return reduce(DataFrame.unionByName, found)
        found.append(new)
        jump = cut(jump.alias("x").join(jump.alias("y"), F.col("x.b") == F.col("y.a")).select("x.a", "y.b"))
