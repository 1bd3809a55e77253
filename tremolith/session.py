"""Session defaults and lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", name: str = "tremolith", shuffle: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; a cluster supplies its own."""
    return (
        SparkSession.builder.master(master)
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # methods above 8000 bytes are not compiled by the JVM; wide validators run faster in split form
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def _checkpoint_ready(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        shared = tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp")
    context.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the written rows.

    Multi-pass scans read their input twice per pass; cutting between passes keeps the
    plan linear and survives executor loss because the files are on shared storage.
    """
    _checkpoint_ready(df.sparkSession)
    return df.checkpoint(eager=True)
