"""The continuous telemetry pipeline as one streaming query.

Lines are normalised by columns, de-duplicated in keyed state with conflict detection, scored by columns and turned into
asset events by a second keyed state that also takes the rules as input.  Both states are chained in one query, so a
restart resumes them together.  A broken line goes the same way and meets no state: the lines are read and judged once.  The
query writes one log row for each line, and the sink splits it into tables, each under the micro-batch's number, so a repeated
batch replaces itself.
"""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData, functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.rules import RULE
from ..operators.scoring import score_rms
from ..operators.validate import normalize_telemetry

POINT = "asset string, lane string, device string, seq long, t_us long, value double, fault boolean, model string, arrival long"
#: ``broken`` names the rule that a line breaks; such a row is passed on and reaches no state.
SEEN = POINT + ", broken string, disposition string, evicted long"
LOG = ("asset string, lane string, device string, seq long, t_us long, arrival long, score double, kind string, event_no long, revision long, start_us long, end_us long, end_reason string, "
       "max_score double, max_model string, samples long, merge_count long, last_score double, rule_version long, model string, trigger_seq long, trigger_us long, trigger_score double")
#: Groups of keys that a stateful processor takes at once; log rows that it hands on at once.
SHARDS, MOST_OUT = 128, 20_000
#: Log rows that carry an event as it then stands.
EVENT_KINDS = ("started", "merged", "updated", "closed")


def _names(ddl: str) -> list[str]:
    return [f.split()[0] for f in ddl.split(", ")]


def by_shard(df: DataFrame, *keys: str) -> GroupedData:
    """Rows grouped for a stateful processor that takes SHARDS groups of keys.  What a call costs beside its rows is paid once a
    shard; the state of each key is an element of the shard's list, read and written at once.  Broken rows, whose keys say
    nothing, are spread over all shards."""
    own = F.xxhash64(*keys)
    if "broken" in df.columns:
        own = F.when(F.col("broken").isNull(), own).otherwise(F.xxhash64("arrival"))
    return df.withColumn("shard", F.pmod(own, F.lit(SHARDS)).cast("int")).groupBy("shard")


def _judged(points: DataFrame) -> DataFrame:
    """Points with ``broken``, null where nothing judged them.  What a broken row says of itself is zero: a null among whole
    numbers would make floats of all numbers of its batch."""
    if "broken" not in points.columns:
        return points.withColumn("broken", F.lit(None).cast("string"))
    return points.withColumns({c: F.when(F.col("broken").isNull(), F.col(c)).otherwise(0) for c in ("seq", "t_us")})


def _stored(state) -> dict[tuple, str]:
    """The body of each key in a list of (key..., body)."""
    return {tuple(e[:-1]): e[-1] for e in state.get()} if state.exists() else {}


def _store(state, bodies: dict[tuple, str]) -> None:
    if bodies:
        state.put([(*key, body) for key, body in bodies.items()])


class ConflictDedupe(StatefulProcessor):
    """First content of each (device, sequence) is accepted, the same again is a duplicate, other content a conflict.

    At most ``bound`` sequences of a device are remembered; the one not used for longest goes first and ``evicted`` counts
    those gone so far.  A sequence that was evicted counts as new.
    """

    def __init__(self, bound: int = 1024):
        self.bound = bound

    def init(self, handle) -> None:
        self.memory = handle.getListState("memory", "device string, body string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        whole = batch["broken"].isna()
        if not whole.all():
            yield batch[~whole].assign(disposition="quarantined", evicted=0)[_names(SEEN)]
            batch = batch[whole]
            if batch.empty:
                return
        batch = batch.sort_values(["device", "arrival"], kind="stable")
        bodies, dispositions, gone = _stored(self.memory), [], []
        for device, own in groupby(zip(batch["device"].tolist(), batch["seq"].tolist(), batch["digest"].tolist()), key=itemgetter(0)):
            # the sequences of a device, the one not used for longest first
            stored, evicted = json.loads(bodies[device,]) if (device,) in bodies else ([], 0)
            known = OrderedDict(stored)
            for _, seq, digest in own:
                before = known.get(seq)
                dispositions.append("accepted" if before is None else "duplicate" if before == digest else "conflict")
                if before is None or before == digest:
                    known[seq] = digest
                    known.move_to_end(seq)
                    if len(known) > self.bound:
                        known.popitem(last=False)
                        evicted += 1
                gone.append(evicted)
            bodies[device,] = json.dumps([list(known.items()), evicted])
        _store(self.memory, bodies)
        batch = batch.assign(disposition=dispositions, evicted=gone)
        yield batch[_names(SEEN)]

    def close(self) -> None:
        pass


def dedupe_stream(points: DataFrame, digest: Column, bound: int = 1024) -> DataFrame:
    """``points`` (see POINT, and ``broken``) with ``disposition`` and ``evicted``; state is kept by device."""
    return by_shard(_judged(points).select(*_names(POINT), "broken", digest.alias("digest")), "device").transformWithStateInPandas(ConflictDedupe(bound), SEEN, "Append", "None")


class RuledLifecycle(StatefulProcessor):
    """Events of each (asset, lane) from points and rules that arrive in the same stream.

    Rule rows of a micro-batch are learnt before its points; a point falls under the latest rule that applies at its time.  A
    new rule resets the pending entry and the exit run and keeps an open event.  Points go in (time, sequence) order within a
    micro-batch; one that is not after the last processed point is ``late`` and changes nothing.  One log row a point.
    """

    def init(self, handle) -> None:
        self.memory = handle.getListState("memory", "asset string, lane string, body string")

    @staticmethod
    def _learn(bodies: dict[tuple, str], own: tuple, rules: list) -> dict:
        s = json.loads(bodies[own]) if own in bodies else {"rules": []}
        s["rules"] = sorted(s["rules"] + rules)
        return s

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        bodies = _stored(self.memory)
        for own, rules in self._rules(initialState).items():
            bodies[own] = json.dumps(self._learn(bodies, own, rules))
        _store(self.memory, bodies)

    @staticmethod
    def _rules(rows: pd.DataFrame) -> dict[tuple, list]:
        """The rules of each (asset, lane)."""
        found: dict[tuple, list] = {}
        for r in rows[["asset", "lane", "from_us", *RULE]].itertuples(index=False):
            found.setdefault((r.asset, r.lane), []).append([int(r.from_us), int(r.version), bool(r.active), float(r.score_enter), float(r.score_exit), int(r.n_enter), int(r.n_exit), float(r.sec_enter), float(r.sec_exit),
                                                            int(r.merge_gap_sec)])
        return found

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        learnt = self._rules(batch[batch["from_us"].notna()])
        points = batch[batch["from_us"].isna()]
        whole = points["broken"].isna()
        if not whole.all():
            bad = points[~whole]
            yield pd.DataFrame({"lane": bad["lane"], "arrival": bad["arrival"], "kind": bad["disposition"], "end_reason": bad["broken"]}, columns=_names(LOG), dtype=object)
            points = points[whole]
        points = points.sort_values(["asset", "lane", "t_us", "seq", "arrival"])
        bodies, out = _stored(self.memory), []
        fields = ["asset", "lane", "device", "seq", "t_us", "arrival", "score", "fault", "model", "disposition"]
        for own, mine in groupby(zip(*[points[f].tolist() for f in fields]), key=itemgetter(0, 1)):
            s = self._learn(bodies, own, learnt.pop(own, []))
            for _, _, device, seq, t, arrival, score, fault, model, disposition in mine:
                seq, t, arrival = int(seq), int(t), int(arrival)
                event, kind = None, disposition
                if disposition == "accepted":
                    if s.get("last") is not None and [t, seq] <= s["last"]:
                        kind = "late"
                    else:
                        kind, event = self._point(s, t, seq, score, bool(fault), model)
                out.append(self._row(own, device, seq, t, arrival, score, kind, event))
                if len(out) == MOST_OUT:
                    yield pd.DataFrame(out, columns=_names(LOG), dtype=object)
                    out = []
            # rules that no later point can fall under are forgotten
            if s.get("last"):
                past = [r for r in s["rules"] if r[0] <= s["last"][0]]
                s["rules"] = past[-1:] + [r for r in s["rules"] if r[0] > s["last"][0]]
            bodies[own] = json.dumps(s)
        for own, rules in learnt.items():
            bodies[own] = json.dumps(self._learn(bodies, own, rules))
        _store(self.memory, bodies)
        yield pd.DataFrame(out, columns=_names(LOG), dtype=object)

    def _point(self, s: dict, t: int, seq: int, score, fault: bool, model) -> tuple[str, dict | None]:
        rule = next((r for r in reversed(s["rules"]) if r[0] <= t), None)
        if rule is None or not (rule[2] or fault):
            return "unruled", None
        s["last"] = [t, seq]
        if s.get("rule") != rule[1:]:
            s.update(rule=rule[1:], entry=None, exit=None)
        kind = self._step(s, rule, t, seq, score, fault, model if isinstance(model, str) else "unknown")
        return kind or "quiet", (s.get("event") or s.get("done") or s.get("ended")) if kind else None

    @staticmethod
    def _step(s: dict, rule: list, t: int, seq: int, score, fault: bool, model: str) -> str | None:
        _, version, _, enter, leave, n_enter, n_exit, sec_enter, sec_exit, gap = rule
        event = s.get("event")
        if fault:
            # a fault ends the event for good: nothing merges across it
            s.update(entry=None, exit=None, event=None, done=None, ended=event)
            if event is None:
                return None
            event.update(end=t, reason="sensor_fault", rev=event["rev"] + 1)
            return "closed"
        if score is None or score != score or not 0 <= score <= 100:
            s.update(entry=None, exit=None)
            return None
        if event is None:
            if score < enter:
                s["entry"] = None
                return None
            e = s.get("entry") or {"n": 0, "t": t, "model": model, "top": score, "top_model": model}
            if score > e["top"]:
                e.update(top=score, top_model=model)
            e["n"] += 1
            s["entry"] = e
            if e["n"] < n_enter or t - e["t"] < sec_enter * 1e6:
                return None
            s.update(entry=None, exit=None)
            done = s.get("done")
            if done and 0 <= e["t"] - done["end"] <= gap * 1_000_000:
                if e["top"] > done["peak"]:
                    done.update(peak=e["top"], peak_model=e["top_model"])
                done.update(end=None, reason=None, merges=done["merges"] + 1, n=done["n"] + e["n"], last=score, rev=done["rev"] + 1)
                s.update(event=done, done=None)
                return "merged"
            s["no"] = s.get("no", 0) + 1
            s["event"] = {"no": s["no"], "start": e["t"], "end": None, "reason": None, "peak": e["top"], "peak_model": e["top_model"], "n": e["n"], "merges": 0, "last": score, "rev": 0,
                          "version": version, "model": e["model"], "by": [seq, t, score]}
            return "started"
        if score > event["peak"]:
            event.update(peak=score, peak_model=model)
        event.update(n=event["n"] + 1, last=score, rev=event["rev"] + 1)
        if score >= leave:
            s["exit"] = None
            return "updated"
        x = s.get("exit") or {"n": 0, "t": t}
        x["n"] += 1
        s["exit"] = x
        if x["n"] < n_exit or t - x["t"] < sec_exit * 1e6:
            return "updated"
        event.update(end=t, reason="recovered")
        s.update(done=event, event=None, exit=None)
        return "closed"

    @staticmethod
    def _row(key, device, seq: int, t: int, arrival: int, score, kind: str, e: dict | None) -> tuple:
        own = (key[0], key[1], device, seq, t, arrival, None if score is None or score != score else float(score), kind)
        if e is None:
            return own + (None,) * 15
        return own + (e["no"], e["rev"], e["start"], e["end"], e["reason"], float(e["peak"]), e["peak_model"], e["n"], e["merges"], float(e["last"]), e["version"], e["model"], *e["by"][:2], float(e["by"][2]))

    def close(self) -> None:
        pass


def lifecycle_stream(points: DataFrame, rules: DataFrame | None = None, known: DataFrame | None = None, lanes: tuple[str, ...] = ("live",)) -> DataFrame:
    """Log of ``points`` (asset, lane, device, seq, t_us, arrival, score, fault, model, disposition, and ``broken``) under the rules
    of a second stream, ``known`` being those in force before the first row; rules hold in each of ``lanes``."""
    kinds = ", ".join(["from_us long", "version long", "active boolean", "score_enter double", "score_exit double", "n_enter int", "n_exit int", "sec_enter double", "sec_exit double", "merge_gap_sec long"])
    of_lane = lambda r: r.select(F.col("asset").cast("string").alias("asset"), F.explode(F.array(*[F.lit(x) for x in lanes])).alias("lane"), *["from_us", *RULE], *[F.lit(0).cast("long").alias(c) for c in ("seq", "t_us", "arrival")])
    both = _judged(points).select("asset", "lane", "device", "seq", "t_us", "arrival", "score", "fault", "model", "disposition", "broken")
    both = both.select("*", *[F.lit(None).cast(k.split()[1]).alias(k.split()[0]) for k in kinds.split(", ")])
    if rules is not None:
        both = both.unionByName(of_lane(rules), allowMissingColumns=True)
    start = None if known is None else by_shard(of_lane(known), "asset", "lane")
    return by_shard(both, "asset", "lane").transformWithStateInPandas(RuledLifecycle(), LOG, "Append", "None", start)


def telemetry_stream(lines: DataFrame, now_us: Column, mean: float, std: float, sigma: float, rules: DataFrame | None = None, known: DataFrame | None = None, retention_days: int = 30, bound: int = 1024,
                     lanes: tuple[str, ...] = ("live",)) -> DataFrame:
    """Lines (arrival, payload, lane, fault, model) to the log: normalise, de-duplicate, score, lifecycle, in one query.

    ``mean``, ``std`` and ``sigma`` are the baseline of the range score.  A line that breaks a rule of the contract gets a log
    row of kind ``quarantined`` (the rule as its reason) and reaches no state.
    """
    typed = normalize_telemetry(lines, "payload", now_us, retention_days)
    # no filter on the rule: pushed below the parsed members it would parse a line again for each of them
    points = typed.select("asset", "lane", "device", F.col("sequence").alias("seq"), "t_us", F.col("vibration_rms_raw").alias("value"), "fault", "model", "arrival", F.col("error_rule").alias("broken"))
    # the lane and the health of the device are not part of what was sent
    digest = F.sha2(F.concat_ws("\x1f", "asset", F.col("t_us").cast("string"), F.col("value").cast("string")), 256)
    seen = dedupe_stream(points, digest, bound)
    based = seen.withColumns({"mean": F.lit(float(mean)), "std": F.lit(float(std)), "sigma": F.lit(float(sigma))})
    scored = score_rms(based, "value", "mean", "std", "sigma").withColumn("score", F.col("anomaly_score").cast("double"))
    return lifecycle_stream(scored, rules, known, lanes)


def log_tables(batch: DataFrame) -> dict[str, DataFrame]:
    """What the sink writes of a micro-batch: event updates, late points, duplicates and conflicts, broken lines, all others."""
    kind = F.col("kind")
    return {"updates": batch.where(kind.isin(*EVENT_KINDS)), "late": batch.where(kind == "late"), "repeated": batch.where(kind.isin("duplicate", "conflict")),
            "quarantine": batch.where(kind == "quarantined"), "quiet": batch.where(kind.isin("quiet", "unruled"))}


def current_events(updates: DataFrame) -> DataFrame:
    """Each (asset, lane, event_no) as its last revision left it."""
    rest = [c for c in updates.columns if c not in ("asset", "lane", "event_no", "revision")]
    # a closing row repeats the revision of the update it completes: of equal revisions the closed one counts
    at = F.struct("revision", F.col("end_us").isNotNull().alias("closed"))
    last = updates.groupBy("asset", "lane", "event_no").agg(F.max_by(F.struct(*rest), at).alias("r"))
    return last.select("asset", "lane", "event_no", "r.*")
