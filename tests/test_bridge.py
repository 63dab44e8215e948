"""The machine on typed state: against the batch, from an initial memory, and what a batch costs a scope that remembers much."""

import time

import pandas as pd
from pyspark.sql import functions as F

from mutaspark.operators import machine as M
from mutaspark.operators.machine import ENTRY, Entry, Settings, decide, replayed
from mutaspark.sinks.commits import Commits, publish_outputs
from mutaspark.streaming import stateful
from mutaspark.streaming.bridge import Bridge, Scope, bridged
from test_machine import S, command, rows


def key(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())


def streamed(spark, path, parts, settings=Settings(), entries=None, taken_us=None):
    """Decisions of a stream that gets its commands in parts, each run a restart from its checkpoint."""
    for k, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(f"{path}/log")
        stream = spark.readStream.schema(part.schema).parquet(f"{path}/log")
        stateful.run_to_end(bridged(stream, settings, entries, taken_us), f"{path}/checkpoint", publish_outputs(f"{path}/out", lambda b: {"decisions": b}))
    return Commits(spark, f"{path}/out").read("decisions").drop("batch")


def test_typed_state_decides_as_the_batch(spark, tmp_path):
    commands = rows(spark)
    parts = [commands.where("offset < 100"), commands.where("offset between 100 and 199"), commands.where("offset >= 200")]
    assert key(streamed(spark, tmp_path, parts)) == key(replayed(commands))


def test_a_marker_is_set_and_looked_up_by_itself():
    class Store(dict):
        calls = 0

        def containsKey(self, k):
            Store.calls += 1
            return k in self

        def updateValue(self, k, v):
            Store.calls += 1
            self[k] = v

    store = Store({(f"old{i}",): (1,) for i in range(10_000)})
    scope = Scope(Entry("r0", "f", "done", "Succeeded", 201, "", True, 10**12), store)
    scope, d = decide(scope, command("new", fingerprint="f"), Settings())
    assert d["action"] == "replay" and Store.calls == 2 and len(store) == 10_001
    assert decide(scope, command("old7"), Settings())[1] is None and Store.calls == 3


def log_of(spark):
    """Commands of two partitions, from long before a memory starts to after it: scopes used before and after, before only, after only, and without a key."""
    make = lambda rid, scope, partition, offset, now, **over: command(rid, dedup_key=scope, partition=partition, offset=offset, now=now * S, expires_at=(now + 300) * S, **over)
    out = [
        make("o1", "i:old", 0, 10, 1000), make("a1", "i:a", 0, 11, 90_000), make("a2", "i:a", 0, 12, 90_010, fingerprint="g"), make("b1", "i:b", 1, 7, 90_020), make("n1", "r:n1", 1, 8, 90_030, keyed=False),
        make("a3", "i:a", 0, 13, 100_100), make("a4", "i:a", 0, 14, 100_110, fingerprint="g"), make("b2", "i:b", 1, 9, 100_120, replayable=True), make("c1", "i:c", 1, 10, 100_130), make("o2", "i:old", 0, 15, 100_140), make("c2", "i:c", 1, 11, 100_150),
    ]
    kinds = "string string string int long long long boolean boolean boolean boolean boolean boolean boolean int string int".split()
    return spark.createDataFrame([tuple(c[x] for x in M.INPUT) for c in out], ", ".join(f"{n} {k}" for n, k in zip(M.INPUT, kinds, strict=True)))


def test_genesis(spark, tmp_path):
    commands, now, window = log_of(spark), 100_000 * S, 20_000 * S
    before, after = commands.where(f"now < {now}"), commands.where(f"now >= {now}")
    starts = M.genesis(before.withColumn("timestamp", F.timestamp_micros("now")), now, window)
    assert sorted(tuple(r) for r in starts.collect()) == [(0, 13, 11, False), (1, 9, 7, True)]
    claims = M.claims(commands, starts, window)
    assert {r.dedup_key: (r.request_id, r.fingerprint, r.outcome, r.answered, r.purge_after) for r in claims.collect()} == {"i:a": ("a1", "f", "OutcomeUnknown", False, 90_000 * S + window), "i:b": ("b1", "f", "OutcomeUnknown", False, 90_020 * S + window)}
    held = spark.createDataFrame([("i:a", "x", "f", "done", "Succeeded", 201, "", True, 10**12)], ENTRY)
    assert [r.dedup_key for r in M.claims(commands, starts, window, held).collect()] == ["i:b"]
    settings = M.started(Settings(), starts, now, window)
    assert settings.memory_start == ((0, 13), (1, 9)) and settings.blind_until == now + window
    sighted = M.started(Settings(), starts.withColumn("blind", F.lit(False)), now, window)
    told = {r.request_id: (r.action, r.fault) for r in replayed(after, sighted, claims).collect()}
    # A retry of a claimed key gets "unknown"; another payload is refused; what may run again does; a key of long ago is free.
    assert told == {"a3": ("replay", "outcome_unknown"), "a4": ("refuse", "idempotency_key_reused"), "b2": ("execute", ""), "c1": ("execute", ""), "o2": ("execute", ""), "c2": ("replay", "")}
    blind = {r.request_id: (r.action, r.fault) for r in replayed(after, settings, claims).collect()}
    assert blind["c1"] == blind["o2"] == ("refuse", "outcome_unknown") and blind["a3"] == ("replay", "outcome_unknown")
    # Commands below the start that come again are never executed.
    again = {r.request_id: (r.action, r.fault) for r in replayed(commands, sighted, claims).collect()}
    assert again["o1"] == again["n1"] == ("refuse", "outcome_unknown")
    parts = [after.where("offset < 14 and offset > 9"), after.where("offset >= 14 or offset <= 9")]
    for k, (setting, entries) in enumerate([(sighted, claims), (settings, claims)]):
        assert key(streamed(spark, tmp_path / str(k), parts, setting, entries, now)) == key(replayed(after, setting, entries))


class Handle(dict):
    """A processor's handle over plain maps, with its timers; counts what the store is asked."""

    calls = 0

    class Map(dict):
        def _asked(f):
            def g(self, *a):
                Handle.calls += 1
                return f(self, *a)

            return g

        getValue, updateValue, removeKey, containsKey = map(_asked, (dict.get, dict.__setitem__, dict.pop, dict.__contains__))
        iterator = lambda self: iter(list(self.items()))

    def getMapState(self, name, *_):
        return self.setdefault(name, Handle.Map())

    def listTimers(self):
        return iter(self.setdefault("timers", []))

    def registerTimer(self, at):
        self["timers"].append(at)


class Clock:
    def __init__(self, ms):
        self.getCurrentProcessingTimeInMs = self.getExpiryTimeInMs = lambda: ms


def test_a_call_decides_many_scopes():
    """A group that Spark hands over holds many scopes, each with an entry and markers of its own; a new scope asks the store three times, and timers are one a span."""
    bridge, handle, hour = Bridge(Settings(), 86_400_000, 0), Handle(), 3_600_000
    bridge.init(handle)
    seeds = [(f"i:{i}", "x", "f", "done", "Succeeded", 201, "", True, (5 if i < 2 else 9) * 3600 * S) for i in range(4)]
    bridge.handleInitialState((1,), pd.DataFrame(seeds, columns=[x.split()[0] for x in ENTRY.split(", ")]), Clock(10))
    assert len(handle["entries"]) == 4 and sorted(handle["timers"]) == [6 * hour, 10 * hour]
    frame = lambda *cs: iter([pd.DataFrame([{**dict.fromkeys(M.OPTIONAL), **c} for c in cs])])
    new = [command(f"n{i}", dedup_key=f"r:{i}", offset=9 - i, keyed=False) for i in range(5)]
    Handle.calls = 0
    (out,) = bridge.handleInputRows((1,), frame(*new), Clock(10))
    assert set(out.action) == {"execute"} and set(out.dedup_key) == {f"r:{i}" for i in range(5)} and Handle.calls == 15
    (out,) = bridge.handleInputRows((1,), frame(command("b", dedup_key="i:1", offset=12), command("a", dedup_key="i:1", offset=11, fingerprint="g"), command("s", dedup_key="q", offset=10, attempt_status=None)), Clock(10))
    assert [(r.request_id, r.action, r.replay_of) for r in out.itertuples()] == [("a", "refuse", ""), ("b", "replay", "x"), ("s", "started", "")]
    assert set(handle["answered"]) == {("i:1", "a"), ("i:1", "b")} and sorted(handle["timers"]) == [hour, 6 * hour, 10 * hour]
    for at, left in ((hour, {"i:0", "i:1", "i:2", "i:3", "q"}), (6 * hour, {"i:2", "i:3", "q"}), (10 * hour, {"q"})):
        list(bridge.handleExpiredTimer((1,), Clock(at), Clock(at)))
        assert {k for (k,) in handle["entries"]} == left


def test_entries_go_by_timer(spark, tmp_path):
    """Of a bucket's entries those go from the store whose time is over."""
    commands = rows(spark).where("offset < 2").withColumns({"dedup_key": F.concat(F.lit("k"), "offset"), "keyed": F.col("offset") == 1, "expires_at": F.col("now") - 60 * S, "stale": F.lit(False)})
    for k, part in enumerate([commands, commands.where("offset = 0").withColumns({"request_id": F.lit("z"), "dedup_key": F.lit("z")})]):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        stream = spark.readStream.schema(commands.schema).parquet(f"{tmp_path}/log")
        stateful.run_to_end(bridged(stream, buckets=1, sweep_s=1), f"{tmp_path}/checkpoint", publish_outputs(f"{tmp_path}/out", lambda b: {"decisions": b}))
        if k == 0:
            time.sleep(3)
    left = spark.read.format("statestore").option("stateVarName", "entries").load(f"{tmp_path}/checkpoint")
    assert {r.user_map_key.dedup_key if hasattr(r, "user_map_key") else r[1][0] for r in left.collect()} == {"k1", "z"}


def test_commands_of_one_partition_are_not_paired_with_parts_of_the_starts(spark):
    commands = rows(spark).withColumn("partition", F.lit(0))
    starts = M.genesis(commands.withColumn("timestamp", F.timestamp_micros("now")), 200 * S, 200 * S)
    plan = M.claims(commands, starts, 200 * S)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastExchange" in plan
