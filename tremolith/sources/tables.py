"""Adapters that read the star-schema tables as condition-monitoring inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.numeric import micros

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score stream: one asset per user; ``signup`` rows carry no score, ``error`` rows are sensor faults."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("asset"), F.col("event_id").alias("seq"), micros("ts").alias("t_us"),
        F.when(F.col("event_type") != "signup", F.least("value", F.lit(100.0))).alias("score"),
        (F.col("event_type") == "error").alias("fault"),
        F.get_json_object("props", "$.k").cast("long").alias("k"), "event_type", "value")


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurement windows: ten devices, a boot per day, a 15-minute index; collisions are kept."""
    e = table(spark, sf_dir, "events")
    t = micros("ts")
    of_day = F.pmod(t, F.lit(DAY_US))
    return e.select(
        F.pmod("user_id", F.lit(10)).alias("device"), F.floor(t / DAY_US).cast("long").alias("boot"),
        F.floor(of_day / (900 * 1_000_000)).cast("long").alias("idx"), F.col("event_id").alias("ordinal"),
        of_day.alias("uptime_us"),
        (t + F.when(F.col("event_type") == "error", F.lit(1_500_000)).otherwise(F.lit(0))).alias("captured_us"),
        F.when(F.col("event_type") == "signup", "sample_gap").otherwise("valid").alias("quality"),
        F.pmod("user_id", F.lit(3)).alias("site"), "value", "event_type",
        F.get_json_object("props", "$.k").cast("long").alias("k"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 64 floats of each embedding as doubles; stream = label, order = vec_id."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("label").cast("long").alias("stream"), F.col("embedding").cast("array<double>").alias("v"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine-feature snapshots: sums of seven neighbouring floats, the last one of eight."""
    v = vectors(spark, sf_dir)
    nine = F.array(*[F.aggregate(F.slice("v", 7 * j + 1, 7 if j < 8 else 8), F.lit(0.0), lambda a, x: a + x)
                     for j in range(9)])
    return v.select("vec_id", "stream", nine.alias("x"))
