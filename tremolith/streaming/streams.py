"""Structured Streaming forms of the batch operators and the sinks that make them restartable."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from ..operators.dedupe import upsert_latest
from ..operators.events import Lifecycle
from ..session import _checkpoint_ready

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
UPDATES = ("asset long, event_no long, revision long, kind string, start_us long, end_us long, end_reason string, max_score double, "
           "samples long, merge_count long, last_score double, at_us long")


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    _checkpoint_ready(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def read_files(spark: SparkSession, folder: str, pattern: str, schema: StructType, files_per_trigger: int = 1000) -> DataFrame:
    """File stream with admission control: at most ``files_per_trigger`` files join a micro-batch."""
    return (spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).parquet(folder))


def drain(df: DataFrame, root: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything available into parquet and hand back the written table."""
    q = (df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{root}/state").option("path", f"{root}/out")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{root}/out")


def drain_batches(df: DataFrame, root: str, write: Callable[[DataFrame, int], None], mode: str = "update") -> None:
    q = (df.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").foreachBatch(write).trigger(availableNow=True).start())
    q.awaitTermination()


def idempotent_sink(path: str, split: Callable[[DataFrame], dict[str, DataFrame]]) -> Callable[[DataFrame, int], None]:
    """Several tables per micro-batch, each under its batch id, so a repeated batch overwrites itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for name, part in split(batch).items():
                part.write.mode("overwrite").parquet(f"{path}/{name}/batch_id={batch_id}")
        finally:
            batch.unpersist()
    return write


def latest_events(updates: DataFrame) -> DataFrame:
    """Current event rows from the update log."""
    rows = updates.filter("kind <> 'rejected'")
    return upsert_latest(rows, rows.limit(0), ["asset", "event_no"], "revision")


# ------------------------------------------------------------------ lifecycle

class EventLifecycle(StatefulProcessor):
    """One asset's entry, exit, merge and fault-boundary state over ordered score points.

    Rows of a micro-batch are put in (time, sequence) order; a row at or before the last processed one is
    reported as rejected.  A rule-version change resets the pending candidate and exit run, never the open event.
    """

    FIELDS = UPDATES

    def __init__(self, cfg: Lifecycle, rule_version: str = "rule-1"):
        self.cfg = asdict(cfg)
        self.rule_version = rule_version

    def init(self, handle) -> None:
        self.memory = handle.getValueState("memory", "body string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = json.loads(self.memory.get()[0]) if self.memory.exists() else {}
        if s.get("rule") != self.rule_version:
            s.update(rule=self.rule_version, n_in=0, n_out=0)
        out = []
        batch = pd.concat(list(rows)).sort_values(["t_us", "seq"])
        for t, q, score, fault in zip(batch["t_us"].tolist(), batch["seq"].tolist(), batch["score"].tolist(), batch["fault"].tolist()):
            if s.get("last") is not None and [t, q] <= s["last"]:
                out.append(self._row(key[0], s, s.get("event") or {"no": s.get("no", 0)}, "rejected", t))
                continue
            s["last"] = [t, q]
            kind = self._step(s, t, score, fault)
            if kind:
                out.append(self._row(key[0], s, s["event"] or s["done"], kind, t))
                if kind == "closed" and fault:
                    s["done"] = None
        self.memory.update((json.dumps(s),))
        names = [f.split()[0] for f in UPDATES.split(", ")]
        yield pd.DataFrame(out, columns=names)

    def _step(self, s: dict, t: int, score, fault: bool) -> str | None:
        c = self.cfg
        event = s.get("event")
        if fault:
            s.update(n_in=0, n_out=0, event=None)
            s["done"] = None
            if event is None:
                return None
            event.update(end=t, reason="sensor_fault", rev=event["rev"] + 1)
            s["done"] = event
            return "closed"
        if score is None or score != score or not 0 <= score <= 100:
            s.update(n_in=0, n_out=0)
            return None
        if event is None:
            if score < c["enter"]:
                s["n_in"] = 0
                return None
            fresh = not s.get("n_in")
            s.update(n_in=s.get("n_in", 0) + 1, t_in=t if fresh else s["t_in"], top=score if fresh else max(score, s["top"]))
            if s["n_in"] < c["n_enter"] or t - s["t_in"] < c["sec_enter"] * 1e6:
                return None
            done = s.get("done")
            if done and 0 <= s["t_in"] - done["end"] <= c["merge_gap_sec"] * 1_000_000:
                done.update(end=None, reason=None, merges=done["merges"] + 1, peak=max(done["peak"], s["top"]), n=done["n"] + s["n_in"], last=score, rev=done["rev"] + 1)
                s.update(event=done, done=None, n_in=0, n_out=0)
                return "merged"
            s["no"] = s.get("no", 0) + 1
            s["event"] = {"no": s["no"], "start": s["t_in"], "end": None, "reason": None, "peak": s["top"], "n": s["n_in"], "merges": 0, "last": score, "rev": 0}
            s.update(n_in=0, n_out=0)
            return "started"
        event.update(peak=max(event["peak"], score), n=event["n"] + 1, last=score, rev=event["rev"] + 1)
        if score >= c["exit"]:
            s["n_out"] = 0
            return "updated"
        s["t_out"] = s["t_out"] if s.get("n_out") else t
        s["n_out"] = s.get("n_out", 0) + 1
        if s["n_out"] < c["n_exit"] or t - s["t_out"] < c["sec_exit"] * 1e6:
            return "updated"
        event.update(end=t, reason="recovered")
        s.update(done=event, event=None, n_out=0)
        return "closed"

    @staticmethod
    def _row(asset, s: dict, e: dict, kind: str, t: int) -> tuple:
        return (asset, e.get("no"), e.get("rev"), kind, e.get("start"), e.get("end"), e.get("reason"), e.get("peak"), e.get("n"), e.get("merges"), e.get("last"), t)

    def close(self) -> None:
        pass


def stream_lifecycle(points: DataFrame, cfg: Lifecycle = Lifecycle(), rule_version: str = "rule-1", lane: str | None = None) -> DataFrame:
    """Update log of asset events; with ``lane`` history and live rows keep separate state.

    ``points``: asset, t_us, seq, score, fault.
    """
    keys = ["asset"] + ([lane] if lane else [])
    return points.groupBy(*keys).transformWithStateInPandas(EventLifecycle(cfg, rule_version), UPDATES, "Append", "None")


class Incidents(StatefulProcessor):
    """Three-hit incidents of a device whose target or model may change.

    While an incident is open another target's hits neither close it nor open a second one; input that
    cannot be judged, or belongs to another target, makes the observation unknown.
    """

    def init(self, handle) -> None:
        self.memory = handle.getValueState("memory", "body string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        s = json.loads(self.memory.get()[0]) if self.memory.exists() else {"hits": []}
        out = []
        for r in pd.concat(list(rows)).sort_values(["t_us", "idx"]).itertuples(index=False):
            out += [(key[0], *row) for row in self.step(s, int(r.t_us), int(r.idx), int(r.uptime_us), r.target, bool(r.ok), bool(r.hit))]
        self.memory.update((json.dumps(s),))
        yield pd.DataFrame(out, columns=["device", "target", "opened_us", "kind", "at_us"])

    @staticmethod
    def step(s: dict, t: int, idx: int, uptime: int, target: str, ok: bool, hit: bool) -> list[tuple]:
        linked = s.get("target") == target and s.get("idx") == idx - 1 and 630_000 <= uptime - s.get("uptime", -1) <= 670_000
        s["hits"] = ((s["hits"] if linked else []) + [hit])[-3:] if ok else []
        s.update(target=target, idx=idx, uptime=uptime)
        live, out = s.get("open"), []
        if live is None:
            if s["hits"] == [True] * 3:
                s["open"] = {"target": target, "at": t, "seen": "observing"}
                out.append((target, t, "opened", t))
            return out
        seen = "observing" if ok and live["target"] == target else "unknown"
        if live["target"] == target and s["hits"] == [False] * 3:
            s["open"] = None
            out.append((target, live["at"], "closed", t))
        elif live["seen"] != seen:
            live["seen"] = seen
            out.append((live["target"], live["at"], seen, t))
        return out

    def close(self) -> None:
        pass


def stream_incidents(df: DataFrame) -> DataFrame:
    """``df``: device, t_us, idx, uptime_us, target (asset, model and threshold as text), ok, hit."""
    return df.groupBy("device").transformWithStateInPandas(Incidents(), "device long, target string, opened_us long, kind string, at_us long", "Append", "None")


# ------------------------------------------------------------------ count windows, timers

class Persistence(StatefulProcessor):
    """Causal N-of-M decisions per stream from a ring of the last hits."""

    def __init__(self, width: int, need: int):
        self.width, self.need = width, need

    def init(self, handle) -> None:
        self.ring = handle.getValueState("ring", "last long, hits string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, hits = self.ring.get() if self.ring.exists() else (None, "")
        batch = pd.concat(list(rows)).sort_values("idx")
        out = []
        for i, ok, hit in zip(batch["idx"].tolist(), batch["ok"].tolist(), batch["hit"].tolist()):
            if last is not None and i != last + 1:
                hits = ""
            last = i
            hits = (hits + ("1" if hit else "0"))[-self.width:] if ok else ""
            out.append(int(hits.count("1") >= self.need) if len(hits) == self.width else -1)
        self.ring.update((last, hits))
        yield batch.assign(decision=out)[["device", "boot", "idx", "decision"]]

    def close(self) -> None:
        pass


def stream_persistence(windows: DataFrame, width: int, need: int) -> DataFrame:
    return windows.groupBy("device", "boot").transformWithStateInPandas(Persistence(width, need), "device long, boot long, idx long, decision int", "Append", "None")


class Liveness(StatefulProcessor):
    """Offline and recovered events from event-time timers."""

    def __init__(self, offline_sec: int):
        self.limit_ms = offline_sec * 1000

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "last_ms long, offline boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, offline = self.seen.get() if self.seen.exists() else (None, False)
        out = []
        for ms in sorted((pd.concat(list(rows))["t_us"] // 1000).tolist()):
            if last is not None and ms <= last:
                continue
            if last is not None and ms - last > self.limit_ms:
                if not offline:
                    out.append((key[0], "device_offline", last + self.limit_ms))
                out.append((key[0], "device_recovered", ms))
            last, offline = ms, False
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(last + self.limit_ms + 1)
        self.seen.update((last, offline))
        yield pd.DataFrame(out, columns=["asset", "event_type", "at_ms"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, offline = self.seen.get()
        self.seen.update((last, True))
        out = [] if offline else [(key[0], "device_offline", last + self.limit_ms)]
        yield pd.DataFrame(out, columns=["asset", "event_type", "at_ms"])

    def close(self) -> None:
        pass


def stream_liveness(points: DataFrame, offline_sec: int, lateness: str = "0 seconds") -> DataFrame:
    """``points``: asset, t_us and a timestamp ``ts`` that drives the watermark."""
    keyed = points.withWatermark("ts", lateness).select("asset", "t_us", "ts")
    return keyed.groupBy("asset").transformWithStateInPandas(Liveness(offline_sec), "asset long, event_type string, at_ms long", "Append", "EventTime")


# ------------------------------------------------------------------ built-in windows

def stream_dedupe(df: DataFrame, keys: list[str], ts: str, lateness: str) -> DataFrame:
    """Exact copies inside the lateness horizon are dropped; older state is forgotten."""
    return df.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(keys)


def stream_buckets(df: DataFrame, keys: list[str], ts: str, width: str, lateness: str, *aggs: Column) -> DataFrame:
    """Tumbling buckets by window end: an end on the boundary belongs to the earlier bucket."""
    shifted = df.withColumn("__e", F.col(ts) - F.expr("interval 1 millisecond")).withWatermark("__e", lateness)
    return shifted.groupBy(*keys, F.window("__e", width).alias("__w")).agg(*aggs).withColumn("bucket_us", F.unix_micros("__w.start")).drop("__w")


def stream_sessions(df: DataFrame, keys: list[str], ts: str, gap: str, lateness: str, *aggs: Column) -> DataFrame:
    """Sessions of points no further apart than the gap."""
    g = df.withWatermark(ts, lateness).groupBy(*keys, F.session_window(ts, gap).alias("__s")).agg(*aggs)
    return g.withColumn("start_us", F.unix_micros("__s.start")).drop("__s")


def with_end_mark(df: DataFrame, root: str) -> DataFrame:
    """The stream and, beside it, the folder that :func:`send_end_mark` writes to."""
    spark = df.sparkSession
    spark.createDataFrame([], df.schema).write.mode("ignore").parquet(f"{root}/end")
    return df.unionByName(spark.readStream.schema(df.schema).parquet(f"{root}/end"))


def send_end_mark(df: DataFrame, root: str, ts: str) -> None:
    """Say that the input has ended: a row without a key, later than all others, lets the watermark pass every open bucket and
    session of the others.  Its own stays open, so no result holds it."""
    spark = df.sparkSession
    row = spark.createDataFrame([(0,)], "x int").select(*[(F.lit("9999-01-01").cast("timestamp") if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema.fields])
    row.write.mode("append").parquet(f"{root}/end")


def drain_to_end(df: DataFrame, make: Callable[[DataFrame], DataFrame], root: str, ts: str) -> DataFrame:
    """Run ``make`` over all that is available, end the input, and run it on until everything open is written."""
    marked = with_end_mark(df, root)
    drain(make(marked), root)
    send_end_mark(df, root, ts)
    return drain(make(marked), root)


def replay(df: DataFrame, root: str, write: Callable[[DataFrame, int], None], interval: str):
    """Paced replay: one admitted file per interval (set ``files_per_trigger=1`` on the source)."""
    return df.writeStream.option("checkpointLocation", f"{root}/state").foreachBatch(write).trigger(processingTime=interval).start()
