"""The idempotent machine's decision table, and batch against stream."""

import pytest

from mutaspark.operators.machine import INPUT, Entry, Settings, State, decide, replayed
from mutaspark.sinks import write_outputs
from mutaspark.streaming import stateful

S = 1_000_000


def command(rid="r1", **over):
    base = {
        "dedup_key": "i:1", "request_id": rid, "fingerprint": "f", "partition": 0, "offset": 0, "now": 100 * S, "expires_at": 400 * S, "keyed": True, "authentic": True, "routed": True, "stale": False, "secret": False,
        "drift": False, "replayable": False, "attempt_status": 201, "attempt_fault": None, "attempt_upstream": None,
    }
    return base | over


def play(*commands, settings=Settings(), state=None):
    out, state = [], state or State()
    for c in commands:
        state, d = decide(state, c, settings)
        out.append(None if d is None else (d["action"], d["status"], d["fault"], d["replay_of"]))
    return out, state


def test_retry_gets_the_stored_answer():
    out, _ = play(command(), command("r2"))
    assert out == [("execute", 201, "", ""), ("replay", 201, "", "r1")]


def test_another_payload_is_refused_even_if_nothing_ran():
    out, _ = play(command(attempt_fault="upstream_unavailable", attempt_status=503), command("r2", fingerprint="g"))
    assert out[1] == ("refuse", 422, "idempotency_key_reused", "")


def test_what_did_not_run_runs_again():
    out, _ = play(command(attempt_fault="upstream_unavailable", attempt_status=503), command("r2"))
    assert [o[0] for o in out] == ["execute", "execute"]


@pytest.mark.parametrize("replayable, action", [(True, "execute"), (False, "replay")])
def test_unknown_outcomes_claim_unless_replayable(replayable, action):
    out, _ = play(command(attempt_fault="outcome_unknown", attempt_status=502, replayable=replayable), command("r2", replayable=replayable))
    assert out[1][0] == action


def test_redelivery_is_silent():
    assert play(command(), command())[0][1] is None
    assert play(command(), command("r2", fingerprint="g"), command("r2", fingerprint="g"))[0][2] is None


@pytest.mark.parametrize("over, fault", [({"stale": True}, "command_stale"), ({"secret": True}, "secret_in_command"), ({"drift": True}, "operation_mismatch")])
def test_refusals_in_order(over, fault):
    assert play(command(**over))[0][0][2] == fault
    assert play(command(stale=True, secret=True, drift=True))[0][0][2] == "command_stale"


def test_forged_and_misrouted_leave_no_trace():
    for over in ({"authentic": False}, {"routed": False}):
        out, state = play(command(**over))
        assert out == [None] and state == State()


@pytest.mark.parametrize("replayable, again", [(False, ("refuse", 502, "outcome_unknown", "")), (True, ("execute", 201, "", ""))])
def test_crash_after_started(replayable, again):
    started = State(Entry("r1", "f", "started"))
    assert play(command(replayable=replayable), state=started)[0] == [again]


def test_in_flight():
    assert play(command("r2"), state=State(Entry("r1", "f", "started")))[0][0][2] == "idempotency_in_flight"


def test_crash_before_any_answer_leaves_started():
    out, state = play(command(attempt_status=None))
    assert out[0][0] == "started" and state.entry.phase == "started"


def test_before_memory_nothing_runs():
    out, _ = play(command(offset=5), settings=Settings(memory_start=((0, 10),)))
    assert out[0][2] == "outcome_unknown"


def test_blind_window_spares_unkeyed():
    blind = Settings(blind_until=200 * S)
    assert play(command(), settings=blind)[0][0][2] == "outcome_unknown"
    assert play(command(keyed=False), settings=blind)[0][0][0] == "execute"


def test_retention():
    late = 100 * S + 86_400 * S + 1
    assert play(command(), command("r2", now=late, expires_at=late + 300 * S))[0][1][0] == "execute"


def test_below_the_watermark_all_is_settled():
    assert play(command(offset=3), command("r2", offset=4), settings=Settings(watermark=((0, 4),)))[0] == [None, ("execute", 201, "", "")]


def test_own_attempts_go_on():
    """A started command whose own attempt was answered is completed with it; one whose call never went out is executed; any other ends as unknown."""
    at = lambda **over: play(command(**over), state=State(Entry("r1", "f", "started")))[0]
    assert at(own=True, called=True) == at(own=True, called=False) == [("execute", 201, "", "")]
    assert at(own=True, called=False, attempt_status=None)[0][0] == "started"
    assert at(own=True, called=True, attempt_status=None) == at(own=True, called=False, attempt_status=None, drift=True) == [("refuse", 502, "outcome_unknown", "")]
    assert play(command(called=True, attempt_status=None))[0] == [("refuse", 502, "outcome_unknown", "")]


def test_a_secret_is_not_part_of_what_is_remembered():
    _, state = play(command(secret=True, redacted_fingerprint="g"))
    assert state.entry.fingerprint == "g"
    assert play(command("r2", fingerprint="g", now=101 * S), state=state)[0][0][0] == "execute"  # nothing ran: it claims nothing


def test_tries_end_with_a_known_outcome():
    unknown, known = {"status": 502, "fault": "outcome_unknown", "upstream": None}, {"status": 200, "fault": None, "upstream": None}
    first = {"attempt_status": 502, "attempt_fault": "outcome_unknown"}
    assert play(command(**first, replayable=True, attempts=[unknown, known]))[0] == [("execute", 200, "", "")]
    assert play(command(**first, replayable=True, attempts=[unknown, unknown, known]))[0] == [("execute", 502, "outcome_unknown", "")]
    assert play(command(**first, replayable=False, attempts=[known]))[0] == [("execute", 502, "outcome_unknown", "")]


def test_answered_requests_are_forgotten():
    state = State()
    for i in range(1000):
        state, _ = decide(state, command(f"r{i}", fingerprint="f" if i == 0 else "g", now=(100 + i) * S, expires_at=(110 + i) * S), Settings())
    assert len(state.answered) < 400 and state.entry.request_id == "r0" and state.keep_until() == state.entry.purge_after


def rows(spark):
    import random

    r = random.Random(5)
    out = []
    for i in range(300):
        c = command(f"r{r.randrange(200)}", dedup_key=f"k{r.randrange(40)}", fingerprint=r.choice("ffg"), offset=i, attempt_fault=r.choice([None, None, "outcome_unknown", "upstream_unavailable"]), stale=r.random() < 0.05, replayable=r.random() < 0.3)
        c["attempt_status"] = {None: 201, "outcome_unknown": 502, "upstream_unavailable": 503}[c["attempt_fault"]]
        out.append(tuple(c[x] for x in INPUT))
    kinds = "string string string int long long long boolean boolean boolean boolean boolean boolean boolean int string int".split()
    return spark.createDataFrame(out, ", ".join(f"{n} {k}" for n, k in zip(INPUT, kinds, strict=True)))


def test_batch_is_stream(spark, tmp_path):
    commands = rows(spark)
    for k, part in enumerate([commands.where("offset < 100"), commands.where("offset between 100 and 199"), commands.where("offset >= 200")]):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        stream = spark.readStream.schema(commands.schema).parquet(str(tmp_path / "log"))
        stateful.run_to_end(stateful.decisions(stream), str(tmp_path / "checkpoint"), write_outputs(str(tmp_path / "out"), lambda b: {"decisions": b}))  # restarts from its checkpoint each time
    streamed = spark.read.parquet(str(tmp_path / "out" / "decisions")).drop("batch")
    key = lambda df: sorted(tuple(str(v) for v in r) for r in df.collect())
    assert key(streamed) == key(replayed(commands))


def test_events_at_most_once_in_a_stream(spark, tmp_path):
    fields = "request_id string, partition int, offset long, completed_us long, kind string, reason string, details string, event_topic string, event_key string, event_value string"
    make = lambda rid, offset, at=50 * S: (rid, 0, offset, at, "event", None, None, "t", "k", "{}")
    for batch in ([make("a", 0), make("b", 1), make("a", 2)], [make("b", 3), make("c", 4, -10_000 * S)]):
        spark.createDataFrame(batch, fields).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(fields).parquet(str(tmp_path / "in"))
        stateful.run_to_end(stateful.events_once(stream, 3600, 60 * S), str(tmp_path / "checkpoint"), write_outputs(str(tmp_path / "out"), lambda b: {k: b.where(f"kind = '{k}'") for k in ("event", "failure")}))
    read = lambda k: sorted((r.request_id, r.offset, r.reason, r.details) for r in spark.read.parquet(str(tmp_path / "out" / k)).collect())
    assert [x[:2] for x in read("event")] == [("a", 0), ("b", 1)]
    failed = read("failure")
    assert failed == [("a", 2, "duplicate_result", "derived from/0/0"), ("b", 3, "duplicate_result", "derived from/0/1"), ("c", 4, "beyond_dedup_window", None)]


def test_many_requests_events_at_most_once_in_few_groups(spark, tmp_path):
    """Requests share groups, not their firsts: repeats in a batch and of an earlier one are told, whatever order they come in; what isn't an event passes as it is, without a time too."""
    event = lambda k, offset, partition=0: (f"r{k}", partition, offset, 50 * S, "event", None, None, "t", f"k{k}", "{}", "topic")
    other = [(None, 1, 9000, None, "failure", "not_authentic", "[]", None, None, None, "topic"), ("r5", 1, 9001, 50 * S, "none", None, None, None, None, None, "topic")]
    batches = [[*map(event, range(1000), range(1010, 10, -1)), event(7, 3), event(7, 2), *other], [event(k, 5000 + k, 1) for k in range(500, 1500)]]
    fields = "request_id string, partition int, offset long, completed_us long, kind string, reason string, details string, event_topic string, event_key string, event_value string, topic string"
    for batch in batches:
        spark.createDataFrame(batch, fields).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(fields).parquet(str(tmp_path / "in"))
        stateful.run_to_end(stateful.events_once(stream, 3600, 60 * S, buckets=3), str(tmp_path / "checkpoint"), write_outputs(str(tmp_path / "out"), lambda b: {"rows": b}))
    got = {(r.partition, r.offset): r for r in spark.read.parquet(str(tmp_path / "out" / "rows")).collect()}
    assert len(got) == 2004 and {k for k, r in got.items() if r.kind == "event"} == {(0, 1010 - k) for k in range(1000) if k != 7} | {(0, 2)} | {(1, 5000 + k) for k in range(1000, 1500)}
    assert all(got[1, 5000 + k][:2] == (f"r{k}", 1) and (got[1, 5000 + k].reason, got[1, 5000 + k].details) == ("duplicate_result", f"derived from/0/{1010 - k}") for k in range(500, 1000))
    assert {got[p].details for p in ((0, 3), (0, 1003))} == {"derived from/0/2"}
    assert [(got[p].request_id, got[p].completed_us, got[p].kind, got[p].reason, got[p].details) for p in ((1, 9000), (1, 9001))] == [(None, None, "failure", "not_authentic", "[]"), ("r5", 50 * S, "none", None, None)]
