"""Stateful streams: events at most once, and the idempotent machine. State is in RocksDB; batch and stream share their transitions."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from mutaspark.functions import columns as C
from mutaspark.operators.machine import OUTPUT, Entry, Settings, State, decide, decided, inputs, plain

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENTS = "request_id string, partition int, offset long, completed_us long, kind string, reason string, details string, event_topic string, event_key string, event_value string, topic string, service string, operation_id string, event_type string, traceparent string"
FIELDS = [x.split()[0] for x in EVENTS.split(", ")]


def _in_order(frames: Iterator[pd.DataFrame], *by: str) -> list[dict]:
    """A key's rows of one batch in log order, within each value of by; sources don't keep it."""
    return [plain(r) for r in pd.concat(list(frames)).sort_values([*by, "partition", "offset"]).to_dict("records")]


#: Groups that requests are dealt to by their hash, and those in which rows pass that need no state: what a group costs by itself is a few milliseconds.
BUCKETS, PASSING = 1024, 256


class Firsts(StatefulProcessor):
    """Turns events into failures whose request has had one, each bucket's in log order. A request's first place is read and written by itself, once a batch, and goes by the store's own expiry."""

    def __init__(self, buckets: int, keep_ms: int):
        self.buckets, self.keep_ms = buckets, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.firsts = handle.getMapState("firsts", "request_id string", "partition int, offset long", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0] >= self.buckets:
            for frame in rows:
                yield frame[FIELDS]
            return
        frame = pd.concat(list(rows), ignore_index=True).sort_values(["once_key", "partition", "offset"], ignore_index=True)
        again, first = frame.duplicated("once_key").to_numpy(), {}
        for i in (~again).nonzero()[0]:
            request, place = frame["once_key"][i], (int(frame["partition"][i]), int(frame["offset"][i]))
            held = self.firsts.getValue((request,))
            if held is None:
                self.firsts.updateValue((request,), place)
            again[i] = held is not None
            first[request] = place if held is None else held
        out = frame[FIELDS].astype({"kind": object, "reason": object, "details": object})
        out.loc[again, "kind"], out.loc[again, "reason"] = "failure", "duplicate_result"
        out.loc[again, "details"] = ["derived from/{}/{}".format(*first[request]) for request in frame["once_key"][again]]
        yield out

    def close(self) -> None:
        pass


def events_once(candidates: DataFrame, window_s: int, now_us: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """A stream of derived events (columns EVENTS, null where there are none) with duplicates and events beyond the window turned into failures; none is dropped, and rows that aren't events pass as they are.

    Age is judged before, without state. An event that gets to the state is younger than the window; where it came
    from is kept for two windows and an hour, by which clocks may differ, after it was seen. No row is late. All rows
    take one way through one plan: what derives them runs once. now_us: fixed, for tests; else the time of the batch.
    buckets: to how many groups requests are dealt by their hash; a task holds one group's events of a batch, and the
    number stays with the checkpoint, as its state lies by group.
    """
    have = set(candidates.columns)
    candidates = candidates.withColumns({n: F.lit(None).cast("string") for n in FIELDS if n not in have})
    now = F.lit(now_us) if now_us is not None else F.unix_micros(F.current_timestamp())
    old = (F.col("kind") == "event") & (now - F.col("completed_us") > window_s * 1_000_000)
    rows = candidates.withColumns({"kind": F.when(old, "failure").otherwise(F.col("kind")), "reason": F.when(old, "beyond_dedup_window").otherwise(F.col("reason"))}).select(*FIELDS)
    event = F.coalesce(F.col("kind") == "event", F.lit(False))
    dealt = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    keyed = rows.withColumn("once_key", C.empty_if_null("request_id"))
    keyed = keyed.withColumn("bucket", F.when(event, dealt(buckets, "once_key")).otherwise(F.lit(buckets) + dealt(PASSING, "topic", "partition", "offset")))
    return keyed.groupBy("bucket").transformWithStateInPandas(Firsts(buckets, (2 * window_s + 3600) * 1000), EVENTS, "Append", "ProcessingTime")


def packed(state: State) -> str:
    return json.dumps({"entry": asdict(state.entry) if state.entry else None, "answered": state.answered, "pruned": state.pruned})


def unpacked(text: str) -> State:
    raw = json.loads(text)
    return State(Entry(**raw["entry"]) if raw["entry"] else None, raw["answered"], raw["pruned"])


def decisions(commands: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """A stream of commands with what the bridge decides of each: `decide`, driven with one scope's state.

    A scope's state goes when all it remembers has expired: the time that is left at its last command, by the
    command's own clock, runs on by that of the machine. No command is dropped for being late.
    """
    names = [x.split()[0] for x in OUTPUT.split(", ")]

    def step(key, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        state, out, now = unpacked(held.get[0]) if held.exists else State(), [], 0
        for c in _in_order(frames):
            now = max(now, c["now"])
            state, d = decide(state, c, settings)
            if d:
                out.append(decided(c, d))
        if (until := state.keep_until()) == 0:
            if held.exists:
                held.remove()
        else:
            held.update((packed(state),))
            if until is not None:
                held.setTimeoutDuration(max(1000, (until - now) // 1000))
        yield pd.DataFrame(out, columns=names)

    return inputs(commands).groupBy("dedup_key").applyInPandasWithState(step, OUTPUT, "state string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def run_to_end(stream: DataFrame, checkpoint: str, write, mode: str = "append", empty_batches: bool = False):
    """Runs a stream over what there is now, with its state in RocksDB, and waits. write: a foreachBatch function. empty_batches: whether a batch without data follows where the watermark has moved; timers of the machine's clock would ask for such batches without end."""
    spark = stream.sparkSession
    own = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": str(empty_batches).lower()}
    before = {key: spark.conf.get(key, None) for key in own}
    for key, value in own.items():
        spark.conf.set(key, value)
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return query
