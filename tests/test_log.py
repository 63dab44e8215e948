"""Reading a log: verification verdicts, audit of forged and unreadable records, derivation failures, sinks."""

import base64
import json

from pyspark.sql import functions as F

from mutaspark.functions import codec as K
from mutaspark.operators import flows as W
from mutaspark.operators import records as R
from mutaspark.sinks import json_lines, latency_report, topic_table
from mutaspark.schema import LOG, NAMING
from mutaspark.sources import logs

GATEWAY, BRIDGE = b"g" * 32, b"b" * 32
RID = "0" * 25 + "1"


def command(**over):
    base = {
        "v": 1, "requestId": RID, "service": "orders", "operationId": "createOrder", "method": "POST", "pathTemplate": "/orders", "path": "/orders", "caller": {"application": "app", "instance": "app-1"},
        "headers": {"content-type": ["application/json"]}, "body": {"json": {"a": 1}}, "replyTo": "http.responses.gw-1", "deadline": "2024-01-01T00:00:10Z", "issuedAt": "2024-01-01T00:00:00Z", "expiresAt": "2024-01-01T00:05:00Z",
    }
    return base | over


def result(c, **over):
    response = {"v": 1, "requestId": c["requestId"], "status": 201, "headers": {}, "body": None}
    return {"v": 1, "type": "CreateOrderSucceeded", "outcome": "Succeeded", "command": c, "response": response, "completedAt": "2024-01-01T00:00:01Z"} | over


def record(offset, value, kind, seed=GATEWAY, kid="g1", topic="http.requests.orders", key="r:" + RID, committed=True, signed=None):
    raw = value if isinstance(value, bytes) else json.dumps(value).encode()
    signature = K.sign(seed, f"{NAMING.sign_domain}{kind.replace('.', '/')}".encode() + b"\0" + raw) if signed is None else signed
    headers = [("mut-type", kind.encode()), ("mut-kid", kid.encode()), ("mut-sig", base64.b64encode(signature))]
    return (key.encode(), raw, topic, 0, offset, None, headers, committed)


def frame(spark, rows):
    return spark.createDataFrame(rows, LOG)


def trust(spark):
    return R.key_trust([("gateway", "g1", K.public_key(GATEWAY)), ("bridge", "b1", K.public_key(BRIDGE))], spark)


def test_command_verdicts(spark):
    c = command()
    rows = [
        record(0, c, "command.v1"), record(1, c, "command.v1", seed=BRIDGE), record(2, c, "command.v1", kid="nobody"), record(3, c, "command.v1", signed=b""), record(4, c | {"extra": 1}, "command.v1"),
        record(5, c, "command.v1", topic="http.requests.other"), record(6, c, "command.v1", key="r:other"), record(7, c | {"method": "GET"}, "command.v1"), record(8, c | {"expiresAt": "2024-01-01T03:00:00Z"}, "command.v1"),
        record(9, c, "result.v1", seed=BRIDGE, kid="b1"), record(10, c | {"body": {"x": 1}}, "command.v1"), record(11, b"not json", "command.v1"),
    ]
    now = F.expr("timestamp '2024-01-01 00:01:00'")
    got = {r.offset: (r.verdict, r.reason) for r in R.verified_commands(frame(spark, rows), trust(spark), "orders", now).collect()}
    bad = lambda why: ("not_authentic", why)
    assert got == {0: ("ok", None), 1: bad("altered"), 2: bad("unknown_key"), 3: bad("unsigned"), 4: bad("decode"), 5: bad("other_service"), 6: bad("record_key"), 7: bad("invalid_method"), 8: ("stale", "lifetime"), 9: bad("type"), 10: bad("decode"), 11: bad("decode")}


def test_audit_reports_forgeries_and_keeps_secrets_out(spark):
    c = command(idempotencyKey="very-secret-key")
    rows = [record(0, c, "command.v1"), record(1, c, "command.v1", signed=b"x" * 64), record(2, result(c), "result.v1", seed=BRIDGE, kid="b1", topic="http.results.orders"), record(3, b"junk", "result.v1", topic="http.results.orders"), record(4, c, "odd.v1"), record(5, c, "command.v1", committed=False)]
    out = R.audit_entries(frame(spark, rows), trust(spark)).orderBy("offset").collect()
    assert [(r.kind, r.authenticity) for r in out] == [("requested", "authentic"), ("requested", "not-authentic"), ("completed", "authentic"), ("unreadable", "not-authentic"), ("unreadable", "not-authentic")]
    assert out[0].idempotent and out[2].status == 201 and out[3].request_id is None and out[3].service == "orders"
    assert "very-secret-key" not in str(out)


def test_result_verdicts(spark):
    c = command()
    mk = lambda offset, value, **k: record(offset, value, "result.v1", seed=BRIDGE, kid="b1", **({"topic": "http.results.orders"} | k))
    replayed = result(c)
    replayed["response"] = replayed["response"] | {"replayOf": RID}
    rows = [mk(0, result(c)), mk(1, result(c), topic="http.results.other"), mk(2, result(c, outcome="Failed")), mk(3, b"{"), mk(4, replayed)]
    got = {r.offset: (r.verdict, r.reason) for r in R.decoded_results(frame(spark, rows), trust(spark)).collect()}
    assert got == {0: ("ok", None), 1: ("not_authentic", "other_topic"), 2: ("undecodable", "invalid_outcome"), 3: ("undecodable", "decode"), 4: ("undecodable", "invalid_replayed")}


def test_sources_and_sinks(spark, tmp_path):
    rows = frame(spark, [record(i, command(), "command.v1", topic=t) for i, t in enumerate(["http.requests.orders", "http.results.orders", "xhttp.requests.y", "orders.events"])])
    rows.write.parquet(str(tmp_path / "log"))
    log = logs.read_log(spark, str(tmp_path / "log"))
    assert logs.of_topics(log, logs.stream_topics(["orders.events"])).count() == 3
    assert logs.between(log, "http.requests.orders", 0, 0, 1).count() == 1 and logs.end_offsets(log).count() == 4
    json_lines(R.audit_entries(log), str(tmp_path / "audit"))
    assert spark.read.json(str(tmp_path / "audit")).count() == 4
    query = R.audit_entries(logs.stream_log(spark, str(tmp_path / "log"))).writeStream.format("json").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "streamed"))
    query.awaitTermination()
    assert spark.read.json(str(tmp_path / "streamed")).count() == 4
    assert topic_table(spark, {"orders": 4}, NAMING).count() == 4
    assert "direct" in latency_report(spark.createDataFrame([("direct", 1.0, 1.0, 1.0, 1.0, 1.0)], "target string, p50 double, p95 double, p99 double, max double, mean double"))


def test_traces_keep_every_record_of_a_long_request(spark):
    hot = spark.range(2500).selectExpr("'hot' as request_id", "'event' as kind", "timestamp_micros(id * id div 9) as at", "'t' as topic", "cast(id % 4 as int) as partition", "id as offset")
    same = spark.range(1200).selectExpr("'same'", "'event'", "timestamp'2024-01-01 00:00:00'", "'t'", "0", "id")
    few = spark.range(6).selectExpr("if(id < 3, 'few', null)", "'event'", "if(id = 1, null, timestamp_micros(id))", "'t'", "0", "id")
    records = hot.union(same).union(few)
    want = {}
    for r in records.collect():
        want.setdefault(r.request_id, []).append(tuple(r[1:]))
    got = {}
    for r in W.traces(records).orderBy("request_id", "chunk").collect():
        assert r.n == len(want[r.request_id]) and r.chunk == len(got.get(r.request_id, [])) // 1000 and len(r.records) <= 1000
        got.setdefault(r.request_id, []).extend((x.kind, x["at"], x.topic, x.partition, x.offset) for x in r.records)
    assert got == {k: sorted(v, key=lambda x: (x[1] is not None, x[1].timestamp() if x[1] else 0, *x[3:])) for k, v in want.items()}
