"""The bridge's idempotent decisions, replayed over a recorded log: one pure transition, driven by a batch or a stream."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mutaspark.schema import FAULTS

STATUS = {f: s for f, s, _ in FAULTS}
RAN = {f: ran for f, _, ran in FAULTS}


@dataclass(frozen=True)
class Entry:
    """What is known of a scope: who owns it, of which payload, and how it ended."""

    request_id: str
    fingerprint: str
    phase: str  # started, done
    outcome: str = ""
    status: int = 0
    fault: str = ""
    answered: bool = True
    purge_after: int = 0

    def claims(self, replayable: bool) -> bool:
        """Whether a retry gets this outcome rather than a run of its own."""
        if self.phase == "started":
            return True
        return not (self.outcome == "NotExecuted" or (self.outcome == "OutcomeUnknown" and replayable))


@dataclass
class State:
    """A scope's entry, and until when the requests that were answered without owning it are remembered; `decide` changes it in place. pruned: how many were left when the expired ones last went."""

    entry: Entry | None = None
    answered: dict[str, int] = field(default_factory=dict)
    pruned: int = 0

    def remember(self, request_id: str, until: int, now: int) -> None:
        self.answered[request_id] = until
        if len(self.answered) > 2 * self.pruned + 64:
            self.answered = {r: t for r, t in self.answered.items() if t >= now}
            self.pruned = len(self.answered)

    def keep_until(self) -> int | None:
        """When nothing of it is needed any more; None while a started entry waits for its end, which may come whenever."""
        if self.entry and not self.entry.purge_after:
            return None
        return max([self.entry.purge_after if self.entry else 0, *self.answered.values()])


@dataclass(frozen=True)
class Settings:
    """skew and window in microseconds; by partition: watermark, below which all is settled, and memory_start, below which nothing is executed; blind_until: keyed requests that aren't known aren't executed before; tries: of what may be run again, until its outcome is known."""

    skew: int = 30_000_000
    retention: int = 86_400_000_000
    memory_start: tuple[tuple[int, int], ...] = ()
    blind_until: int = 0
    tries: int = 3
    watermark: tuple[tuple[int, int], ...] = ()


def outcome(status: int, fault: str, upstream: int) -> str:
    ran = RAN.get(fault, "none") if fault else "done"
    if fault and ran != "done":
        return "OutcomeUnknown" if ran == "unknown" else "NotExecuted"
    return "Succeeded" if 200 <= (upstream if fault else status) < 300 else "Failed"


def decide(state: State, c: dict, settings: Settings = Settings()) -> tuple[State, dict | None]:
    """(state, decision) after a command; no decision where nothing is published.

    c: request_id, fingerprint, partition, offset, now, expires_at (microseconds), keyed, authentic, routed,
    stale, secret (whether it carries one), drift, replayable, and the recorded attempt: attempt_status (None:
    there was none), attempt_fault, attempt_upstream. A command without an attempt that isn't replayable left a
    started entry behind when its bridge died. Where they are known: own, whether an attempt of this very command
    is under way, and called, whether its call went out (own with an attempt_status: it was answered);
    redacted_fingerprint, of a command without its secret; and attempts, the answers (status, fault, upstream) to
    further tries of a replayable command whose outcome stayed unknown.
    """
    e, rid = state.entry, c["request_id"]
    if e and e.purge_after and c["now"] > e.purge_after:
        e = state.entry = None
    if c["offset"] < dict(settings.watermark).get(c["partition"], 0):
        return state, None
    if not c["routed"] or not c["authentic"]:
        return state, None
    if rid in state.answered:
        return state, None

    def end(action: str, status: int, fault: str, own: bool, upstream: int = 0, fingerprint: str | None = None) -> tuple[State, dict]:
        what = outcome(status, fault, upstream)
        decision = {"action": action, "status": status, "fault": fault, "outcome": what, "replay_of": "", "result": True}
        keep = c["expires_at"] + 2 * settings.skew
        if own:
            kept = max(keep, c["now"] + settings.retention) if c["keyed"] else keep
            state.entry = Entry(rid, fingerprint or c["fingerprint"], "done", what, status, fault, True, kept)
        else:
            state.remember(rid, keep, c["now"])
        return state, decision

    def refuse(fault: str, own: bool, fingerprint: str | None = None):
        return end("refuse", STATUS[fault], fault, own, fingerprint=fingerprint)

    def answered():
        tries = [(c["attempt_status"], c["attempt_fault"], c["attempt_upstream"]), *((x["status"], x["fault"], x["upstream"]) for x in c.get("attempts") or ())]
        for status, fault, upstream in tries[: settings.tries]:
            if not (c["replayable"] and fault == "outcome_unknown"):
                break
        return end("execute", int(status), fault or "", True, int(upstream or 0))

    def execute():
        if c["attempt_status"] is not None:
            return answered()
        if c["replayable"]:
            return refuse("outcome_unknown", True)
        state.entry = Entry(rid, c["fingerprint"], "started")
        return state, {"action": "started", "status": 0, "fault": "", "outcome": "", "replay_of": "", "result": False}

    if c["offset"] < dict(settings.memory_start).get(c["partition"], 0):
        if e and e.request_id == rid and e.phase == "done" and e.answered:
            return state, None
        return refuse("outcome_unknown", e is None or e.request_id == rid or not e.claims(False))
    if e and e.request_id == rid:
        if e.phase == "done":
            return state, None
        if c.get("own") and c["attempt_status"] is not None:
            return answered()
        if c.get("own") and not c.get("called") and not c["drift"]:
            return execute()
        if not c["drift"] and c["replayable"] and not c["stale"]:
            return execute()
        return refuse("outcome_unknown", True)
    if c["stale"]:
        return refuse("command_stale", e is None)
    if c["secret"]:
        return refuse("secret_in_command", e is None, c.get("redacted_fingerprint"))
    if c["drift"]:
        return refuse("operation_mismatch", e is None)
    if e:
        if e.fingerprint != c["fingerprint"]:
            return refuse("idempotency_key_reused", False)
        if e.claims(c["replayable"]):
            if e.phase == "done":
                decision = {"action": "replay", "status": e.status, "fault": e.fault, "outcome": e.outcome, "replay_of": e.request_id, "result": False}
                state.remember(rid, c["expires_at"] + 2 * settings.skew, c["now"])
                return state, decision
            return refuse("idempotency_in_flight", False)
    if c["keyed"] and c["now"] < settings.blind_until:
        return refuse("outcome_unknown", False)
    if c.get("called") and c["attempt_status"] is None and not c["replayable"]:
        return refuse("outcome_unknown", True)
    return execute()


INPUT = ("dedup_key", "request_id", "fingerprint", "partition", "offset", "now", "expires_at", "keyed", "authentic", "routed", "stale", "secret", "drift", "replayable", "attempt_status", "attempt_fault", "attempt_upstream")
#: What a log may hold beside; null where it doesn't.
OPTIONAL = {"own": "boolean", "called": "boolean", "redacted_fingerprint": "string", "attempts": "array<struct<status: int, fault: string, upstream: int>>"}
OUTPUT = "dedup_key string, request_id string, partition int, offset long, action string, status int, fault string, outcome string, replay_of string, result boolean"


def inputs(commands: DataFrame) -> DataFrame:
    """The columns that `decide` takes."""
    have = set(commands.columns)
    return commands.select(*INPUT, *[F.col(n) if n in have else F.lit(None).cast(t).alias(n) for n, t in OPTIONAL.items()])


def plain(row) -> dict:
    """A row of pandas or Arrow as plain values; NaN and NA are None."""
    return {k: _plain(v) for k, v in row.items()}


def _plain(v):
    if isinstance(v, (list, np.ndarray)):
        return [plain(x if isinstance(x, dict) else x.asDict()) for x in v]
    return None if v is None or v is pd.NA or v != v else v.item() if hasattr(v, "item") else v


def decided(c: dict, d: dict) -> dict:
    return {"dedup_key": c["dedup_key"], "request_id": c["request_id"], "partition": c["partition"], "offset": c["offset"], **d}


#: An entry of a scope as a row: what a snapshot of the memory holds, and what a machine may start from.
ENTRY = "dedup_key string, request_id string, fingerprint string, phase string, outcome string, status int, fault string, answered boolean, purge_after long"
_SEED = "struct<" + ",".join(x.strip().replace(" ", ":") for x in ENTRY.split(",")[1:]) + ">"


def replayed(commands: DataFrame, settings: Settings = Settings(), entries: DataFrame | None = None) -> DataFrame:
    """Decisions over a bounded log. A scope's commands are decided in log order, in one pass over sorted partitions: only one scope's state is held, however many commands it has. entries (columns ENTRY): what the memory holds at the start."""
    names = [x.split()[0] for x in OUTPUT.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, State()
        for frame in frames:
            out = []
            for c in map(plain, frame.to_dict("records")):
                if c["dedup_key"] != key:
                    key, state = c["dedup_key"], State()
                if c.get("seed") is not None:  # sorts before the scope's commands
                    state.entry = entry_of(c["seed"])
                    continue
                state, d = decide(state, c, settings)
                if d:
                    out.append(decided(c, d))
            yield pd.DataFrame(out, columns=names)

    rows, order = inputs(commands), ["dedup_key", "partition", "offset"]
    if entries is not None:
        rows, order = rows.withColumn("seed", F.lit(None).cast(_SEED)).withColumn("last", F.lit(1)), ["dedup_key", "last", "partition", "offset"]
        seeds = entries.select("dedup_key", F.struct(*[x.split()[0] for x in ENTRY.split(", ")][1:]).cast(_SEED).alias("seed"), F.lit(0).alias("last"))
        rows = rows.unionByName(seeds, allowMissingColumns=True)
    return rows.repartition("dedup_key").sortWithinPartitions(*order).drop("last").mapInPandas(run, OUTPUT)


def entry_of(seed) -> Entry:
    """An entry from a row of ENTRY's fields, without its key."""
    x = plain(seed if isinstance(seed, dict) else seed.asDict())
    return Entry(x["request_id"], x["fingerprint"], x["phase"], x["outcome"] or "", int(x["status"] or 0), x["fault"] or "", bool(x["answered"]), int(x["purge_after"] or 0))


def genesis(log: DataFrame, now_us: int, window_us: int) -> DataFrame:
    """Where a memory starts that knows nothing: for each partition of a command log (partition, offset, timestamp) memory_start, below which nothing is executed; scan_from, from where commands of the idempotency window claim their scopes; and blind, whether some of those may have been deleted already."""
    rows = log.groupBy("partition").agg((F.max("offset") + 1).alias("memory_start"), F.min("offset").alias("first"), F.min(F.when(F.unix_micros("timestamp") >= now_us - window_us, F.col("offset"))).alias("in_window"))
    rows = rows.withColumn("scan_from", F.coalesce("in_window", "memory_start"))
    return rows.select("partition", "memory_start", "scan_from", ((F.col("first") > 0) & (F.col("scan_from") <= F.col("first"))).alias("blind"))


def started(settings: Settings, starts: DataFrame, now_us: int, window_us: int) -> Settings:
    """Settings of a machine whose memory starts so: a row a partition."""
    rows = starts.collect()
    blind = now_us + window_us if any(r.blind for r in rows) else 0
    return replace(settings, memory_start=tuple(sorted((r.partition, r.memory_start) for r in rows)), blind_until=max(settings.blind_until, blind))


def claims(commands: DataFrame, starts: DataFrame, window_us: int, state: DataFrame | None = None) -> DataFrame:
    """Entries (ENTRY) that keyed commands between scan_from and memory_start leave in a memory that starts after them: their outcome is unknown, and a retry gets that instead of a run. commands: columns of INPUT, verified or not, as a claim only ever withholds a run. state: entries that are there, which stay.

    A scope's first command claims it. Partial aggregation; a scope that occurs often is no heavier than others. The
    starts, a row a partition, go to the commands: where all have one partition, the key of the join is constant and
    Spark would else pair each part of the commands with each part of the starts.
    """
    rows = commands.where("keyed").join(F.broadcast(starts.select("partition", "scan_from", "memory_start")), "partition").where("offset >= scan_from and offset < memory_start")
    if state is not None:
        rows = rows.join(state.select("dedup_key"), "dedup_key", "left_anti")
    first = rows.groupBy("dedup_key").agg(F.min(F.struct("partition", "offset", "request_id", "fingerprint", "now")).alias("first"))
    return first.selectExpr(
        "dedup_key", "first.request_id", "first.fingerprint", "'done' as phase", "'OutcomeUnknown' as outcome", f"{STATUS['outcome_unknown']} as status", "'outcome_unknown' as fault", "false as answered", f"first.now + {window_us}L as purge_after"
    )


def remembered(commands: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """What is left in memory at the end of a bounded log: dedup_key, the request that owns it, and until when it is kept (null: a started one waits for its end)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, State()
        row = lambda: [(key, state.entry.request_id, state.entry.purge_after or None)] if state.entry else []
        for frame in frames:
            out = []
            for c in map(plain, frame.to_dict("records")):
                if c["dedup_key"] != key:
                    out += row()
                    key, state = c["dedup_key"], State()
                state, _ = decide(state, c, settings)
            yield pd.DataFrame(out, columns=["dedup_key", "request_id", "purge_after"])
        yield pd.DataFrame(row(), columns=["dedup_key", "request_id", "purge_after"])

    return inputs(commands).repartition("dedup_key").sortWithinPartitions("dedup_key", "partition", "offset").mapInPandas(run, "dedup_key string, request_id string, purge_after long")
