"""Exports and immutable versioned publishing."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.dedupe import set_digest
from ..operators.validate import safe_tabular

TELEMETRY_COLUMNS = ["timestamp", "sequence", "site_id", "asset_id", "device_id", "vibration_rms_raw", "vibration_peak_hz", "acoustic_rms_raw", "acoustic_peak_hz",
                     "rpm", "anomaly_score", "anomaly_status"]
FEATURES9 = [f"{kind}_a_{axis}" for kind in ("cf", "sk", "ku") for axis in (1, 2, 3)]
MEASUREMENT_COLUMNS = ["site_id", "asset_id", "device_id", "sensor_id", "measured_at", "received_at", "profile_id", "quality", "reason", *FEATURES9,
                       "vibration_rms_g", "dominant_frequency_hz", "rms_status", "frequency_status"]


def telemetry_export(df: DataFrame) -> DataFrame:
    """The fixed telemetry columns in canonical order."""
    return safe_tabular(df.select(*TELEMETRY_COLUMNS)).orderBy("timestamp", "device_id", "sequence")


def export_telemetry_csv(df: DataFrame, path: str) -> None:
    telemetry_export(df).write.option("header", True).mode("errorifexists").csv(path)


def export_measurements(df: DataFrame, site: str, asset: str, low_us: int, high_us: int, limit: int | None = None, most_days: int | None = None) -> DataFrame:
    """Snapshot measurements of one asset in (captured, ordinal) order; over ``most_days`` or ``limit``, if given, is an error."""
    if low_us > high_us:
        raise ValueError("from must not be later than to")
    if most_days is not None and high_us - low_us > most_days * 86_400_000_000:
        raise ValueError(f"export at most {most_days} days at a time")
    hit = df.filter((F.col("site_id") == site) & (F.col("asset_id") == asset) & F.col("captured_us").between(low_us, high_us))
    if limit is not None and hit.select("ordinal").limit(limit + 1).count() > limit:
        raise ValueError(f"export exceeds {limit} measurements; choose a shorter period")
    ok = F.col("quality") == "valid"
    clean = hit.withColumns({c: F.when(ok, F.col(c)) for c in FEATURES9})
    return clean.orderBy("captured_us", "ordinal").select(*MEASUREMENT_COLUMNS)


def export_dataset(rows: DataFrame, manifest: DataFrame, path: str, split: str = "dataset_split") -> None:
    safe_tabular(rows).write.partitionBy(split).mode("errorifexists").parquet(f"{path}/rows")
    manifest.write.mode("errorifexists").parquet(f"{path}/manifest")


def _claim(spark: SparkSession, path: str, text: str) -> bool:
    """Create ``path`` with ``text`` unless it exists, in one step: a finished file is renamed without overwriting.

    The rename decides between writers on file systems whose rename is atomic; a store without one needs its own commit.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    ready = jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_{uuid.uuid4().hex}")
    fs = target.getFileSystem(conf)
    out = fs.create(ready, False)
    out.write(bytearray(text.encode()))
    out.close()
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(ready, target, none)
    except Py4JJavaError as error:
        fs.delete(ready, False)
        if "FileAlreadyExists" not in error.java_exception.getClass().getName():
            raise
        return False
    return True


def publish_version(df: DataFrame, version: str, root: str, content: list[str], published_us: int) -> str:
    """Write an immutable version; the same id with the same content is reused, with other content it conflicts.

    Rows go to a folder of their own first.  Then the version is claimed by creating one file that names the folder, which
    only one writer can do; another one compares its content with the claim, gives up its folder and either reuses the
    version or fails.  A writer that dies before its claim leaves the version free.
    """
    spark = df.sparkSession
    folder = uuid.uuid4().hex
    df.write.mode("errorifexists").parquet(f"{root}/data/{folder}")
    mine = set_digest(spark.read.parquet(f"{root}/data/{folder}"), content).first()
    outcome = "published"
    if not _claim(spark, f"{root}/claims/{version}.json", json.dumps({"version": version, "folder": folder, **mine.asDict()})):
        spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration()).delete(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/data/{folder}"), True)
        claim = _claims(spark, root).where(F.col("version") == version).first()
        if any(claim[c] != mine[c] for c in ("rows", "digest_a", "digest_b")):
            raise ValueError(f"version {version} already exists with different content")
        outcome = "reused"
    pointer = spark.createDataFrame([(version, published_us, mine["rows"], mine["digest_a"], mine["digest_b"])],
                                    "version string, published_us long, rows long, digest_a long, digest_b long")
    pointer.write.mode("append").parquet(f"{root}/pointer")
    return outcome


def _claims(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema("version string, folder string, rows long, digest_a long, digest_b long").json(f"{root}/claims")


def current_version(spark: SparkSession, root: str) -> str:
    log = spark.read.parquet(f"{root}/pointer")
    return log.agg(F.max_by("version", F.struct("published_us", "version")).alias("v")).first()["v"]


def read_current(spark: SparkSession, root: str) -> DataFrame:
    claim = _claims(spark, root).where(F.col("version") == current_version(spark, root)).first()
    return spark.read.parquet(f"{root}/data/{claim['folder']}")
