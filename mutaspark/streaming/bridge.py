"""The idempotent machine on typed state: an entry a scope and a marker a request that was answered, each read and written by itself; scopes are dealt to buckets, which Spark groups by."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from mutaspark.operators.machine import ENTRY, OUTPUT, Entry, Settings, decide, decided, entry_of, inputs

_FIELDS = [x.split()[0] for x in ENTRY.split(", ")][1:]
_OUT = [x.split()[0] for x in OUTPUT.split(", ")]
#: Groups that Spark hands over: what a group costs by itself is a few milliseconds, what a scope in it costs is a few lookups.
BUCKETS = 4096


class Markers:
    """One scope's markers in its bucket's map."""

    def __init__(self, store, dedup_key: str):
        self.store, self.dedup_key = store, dedup_key

    def containsKey(self, key: tuple) -> bool:
        return self.store.containsKey((self.dedup_key, *key))

    def updateValue(self, key: tuple, value: tuple) -> None:
        self.store.updateValue((self.dedup_key, *key), value)


class Scope:
    """What `decide` takes as a scope's state. Its entry is read once and written once a batch; markers of answered requests stay in the store, where one is looked up or set at a time."""

    def __init__(self, entry: Entry | None, markers):
        self.entry, self.markers, self.answered = entry, markers, self

    def __contains__(self, request_id: str) -> bool:
        return self.markers.containsKey((request_id,))

    def remember(self, request_id: str, until: int, now: int) -> None:
        self.markers.updateValue((request_id,), (until,))


class Bridge(StatefulProcessor):
    """Decides the commands of a bucket's scopes, each scope's in log order. Markers go by the store's own expiry; an entry goes when its time is over, by the command's clock and then the machine's: at the first end of a span of sweep_ms after that, when a timer has its bucket looked through."""

    def __init__(self, settings: Settings, marker_ms: int, taken_us: int | None, sweep_ms: int = 3_600_000):
        self.settings, self.marker_ms, self.taken_us, self.sweep_ms = settings, marker_ms, taken_us, sweep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "dedup_key string", ENTRY.split(", ", 1)[1] + ", goes_at long")
        self.markers = handle.getMapState("answered", "dedup_key string, request_id string", "until long", self.marker_ms)

    def _held(self, dedup_key: str) -> Entry | None:
        row = self.entries.getValue((dedup_key,))
        return None if row is None else entry_of(dict(zip(_FIELDS, row[:-1], strict=True)))

    def _keep(self, dedup_key: str, entry: Entry | None, before: Entry | None, now: int, clock: int) -> int:
        """Writes what has changed; now: the newest command's time in microseconds, clock: the machine's in milliseconds. When a bucket has to be looked through for it; 0: not for this one."""
        if entry == before:
            return 0
        if entry is None:
            self.entries.removeKey((dedup_key,))
            return 0
        # a started one waits for its end, whenever that comes
        goes_at = clock + max(1000, (entry.purge_after - now) // 1000) if entry.purge_after else 0
        self.entries.updateValue((dedup_key,), (*[getattr(entry, f) for f in _FIELDS], goes_at))
        return -(-goes_at // self.sweep_ms) * self.sweep_ms

    def _set_timers(self, sweeps: set[int]) -> None:
        if sweeps := sweeps - {0}:
            for at in sweeps - set(self.handle.listTimers()):
                self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        from mutaspark.streaming.stateful import _in_order

        out, sweeps, clock = [], set(), timerValues.getCurrentProcessingTimeInMs()
        for dedup_key, commands in groupby(_in_order(rows, "dedup_key"), lambda c: c["dedup_key"]):
            before = self._held(dedup_key)
            scope, now = Scope(before, Markers(self.markers, dedup_key)), 0
            for c in commands:
                now = max(now, c["now"])
                scope, d = decide(scope, c, self.settings)
                if d:
                    out.append(decided(c, d))
            sweeps.add(self._keep(dedup_key, scope.entry, before, now, clock))
        self._set_timers(sweeps)
        yield pd.DataFrame(out, columns=_OUT)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        over = [k for k, v in self.entries.iterator() if 0 < v[-1] <= expiredTimerInfo.getExpiryTimeInMs()]
        for k in over:
            self.entries.removeKey(tuple(k))
        yield pd.DataFrame([], columns=_OUT)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        clock = timerValues.getCurrentProcessingTimeInMs()
        now = clock * 1000 if self.taken_us is None else self.taken_us
        self._set_timers({self._keep(row["dedup_key"], entry_of(row), None, now, clock) for row in initialState.to_dict("records")})

    def close(self) -> None:
        pass


def bridged(commands: DataFrame, settings: Settings = Settings(), entries: DataFrame | None = None, taken_us: int | None = None, marker_s: int = 86_400, buckets: int = BUCKETS, sweep_s: int = 3600) -> DataFrame:
    """A stream of commands with what the bridge decides of each, as `machine.replayed` does over a bounded log.

    entries (columns ENTRY, one row a scope): what the memory starts from, a compacted snapshot or the claims of a
    genesis; taken in by the first batch only. taken_us: when they were taken, from which on their time runs (now, if
    not told). A scope of many answered requests costs no more a batch than what
    the batch asks for. marker_s: how long an answered request is remembered after it was; beyond the longest life of
    a command and the clocks' skew. buckets: to how many groups scopes are dealt by their hash. A task holds one
    group's commands of a batch; the number stays with the checkpoint, as its state lies by group. sweep_s: the span
    at whose end entries go whose time is over; what is decided doesn't depend on it.
    """
    dealt = lambda rows: rows.withColumn("bucket", F.pmod(F.xxhash64("dedup_key"), F.lit(buckets)).cast("int")).groupBy("bucket")
    start = None if entries is None else dealt(entries.select("dedup_key", *_FIELDS))
    return dealt(inputs(commands)).transformWithStateInPandas(Bridge(settings, marker_s * 1000, taken_us, sweep_s * 1000), OUTPUT, "Append", "ProcessingTime", start)
