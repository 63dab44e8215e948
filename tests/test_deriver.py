"""The deriver over signed logs: what it writes of genuine, repeated, forged and unreadable results, in one batch and as a stream that goes on."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from mutaspark.functions import codec as K
from mutaspark.functions import compiled
from mutaspark.operators import records as R
from mutaspark.plans.adapters import contract
from mutaspark.schema import LOG, NAMING
from mutaspark.streaming import deriver

SEED = b"d" * 32
DAY = "2024-03-05T"
NOW = "2024-03-05 12:00:00"


def signed(offset, value, kind, key, topic="http.results.orders", seed=SEED, at="09:00:00"):
    raw = value if isinstance(value, bytes) else json.dumps(value).encode()
    signature = K.sign(seed, f"{NAMING.sign_domain}{kind.replace('.', '/')}".encode() + b"\0" + raw)
    headers = [(NAMING.type_header, kind.encode()), (NAMING.key_header, b"b1"), (NAMING.signature_header, base64.b64encode(signature))]
    import datetime

    return (key.encode(), raw, topic, 0, offset, datetime.datetime.fromisoformat(DAY + at), headers, True)


def answer(n, status=201, body=None, **over):
    return {"v": 1, "requestId": f"{n:026d}", "status": status, "headers": {"content-type": ["application/json"]}, "body": body} | over


def outcome(n, status=201, body={"json": {"id": "o-1"}}, at="09:00:00", **over):  # noqa: B006
    command = {
        "v": 1, "requestId": f"{n:026d}", "service": "orders", "operationId": "createOrder", "method": "POST", "pathTemplate": "/orders", "path": "/orders", "caller": {"application": "shop", "instance": "shop-2"},
        "headers": {}, "body": {"json": {"customerId": f"c{n}", "items": [{"quantity": n}]}}, "replyTo": "http.responses.gw-1", "deadline": f"{DAY}09:00:10Z", "issuedAt": f"{DAY}08:59:59Z", "expiresAt": f"{DAY}09:05:00Z", "traceparent": f"00-{n}",
    }
    what = "Succeeded" if status < 300 else "Failed"
    return {"v": 1, "type": f"CreateOrder{what}", "outcome": what, "command": command, "response": answer(n, status, body), "completedAt": f"{DAY}{at}Z"} | over


def log(spark):
    make = lambda offset, n, **over: signed(offset, outcome(n, **over), "result.v1", f"r:{n:026d}")
    rows = [
        make(0, 1), make(1, 2, body={"json": {"id": "o-2"}}), make(2, 1), make(3, 3, status=400), make(4, 4, body={"json": {"no": "id"}}), make(5, 5, at="01:00:00"),
        signed(6, outcome(6), "result.v1", "r:x", seed=b"e" * 32), signed(7, b"nonsense", "result.v1", "r:y"), signed(8, outcome(8), "result.v1", "r:z", topic="http.results.payments"), make(9, 9, body={"odd": 1}), make(10, 2),
    ]
    return spark.createDataFrame(rows, LOG), R.key_trust([("bridge", "b1", K.public_key(SEED))], spark)


FAILED = {2: "duplicate_result", 4: "evaluation_failed", 5: "beyond_dedup_window", 6: "not_authentic", 7: "undecodable_result", 8: "not_authentic", 9: "undecodable_result", 10: "duplicate_result"}


def test_one_batch(spark):
    rows, keys = log(spark)
    out = deriver.outputs(deriver.derived_once(rows, keys, contract(), F.lit(NOW).cast("timestamp"), 7 * 3600))
    assert {r.result.offset: r.reason for r in out["failures"].collect()} == FAILED
    events = {r.key.decode(): (json.loads(r.value), {h.key: h.value.decode() for h in r.headers}) for r in out["events"].collect()}
    assert {k: v[0] for k, v in events.items()} == {"o-1": {"customer": "c1", "id": "o-1", "quantity": 1, "source": "orders"}, "o-2": {"customer": "c2", "id": "o-2", "quantity": 2, "source": "orders"}}
    assert events["o-2"][1]["ce_id"] == f"{2:026d}" and events["o-2"][1]["ce_traceparent"] == "00-2" and events["o-2"][1]["ce_type"] == "OrderCreated"


def test_a_stream_that_goes_on(spark, tmp_path):
    rows, keys = log(spark)
    import datetime

    now = int(datetime.datetime.fromisoformat(NOW + "+00:00").timestamp() * 1e6)
    for part in ("offset <= 1", "offset between 2 and 6", "offset > 6"):
        rows.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        stream = spark.readStream.schema(LOG).parquet(str(tmp_path / "log"))
        deriver.run(stream, keys, contract(), str(tmp_path / "out"), str(tmp_path / "checkpoint"), 7 * 3600, now_us=now)
    read = lambda name: spark.read.parquet(str(tmp_path / "out" / name)).drop("batch")
    assert {r.result.offset: r.reason for r in read("failures").collect()} == FAILED
    batch = deriver.outputs(deriver.derived_once(rows, keys, contract(), F.lit(NOW).cast("timestamp"), 7 * 3600))
    texts = lambda df: sorted(str((r.topic, bytes(r.key), bytes(r.value), sorted((h.key, bytes(h.value)) for h in r.headers))) for r in df.collect())
    assert texts(read("events")) == texts(batch["events"])
    pointers = lambda df: sorted(str((r.key, r.reason, r.request_id, tuple(r.result), [d.split(":")[0] for d in r.details])) for r in df.collect())
    assert pointers(read("failures")) == pointers(batch["failures"])


def test_a_streamed_log_keeps_its_firsts_by_bucket(spark, tmp_path):
    """One group a request would cost a batch some milliseconds for each of its events."""
    rows, keys = log(spark)
    rows.where("offset <= 2").coalesce(1).write.parquet(str(tmp_path / "log"))
    query = deriver.run(spark.readStream.schema(LOG).parquet(str(tmp_path / "log")), keys, contract(), str(tmp_path / "out"), str(tmp_path / "checkpoint"), 365_000 * 86_400)
    (held,) = query.lastProgress["stateOperators"]
    assert "transformWithState" in held["operatorName"], held["operatorName"]
    assert {n: spark.read.parquet(str(tmp_path / "out" / n)).count() for n in ("events", "failures")} == {"events": 2, "failures": 1}


def test_a_log_is_verified_and_derived_once(spark):
    """Telling repeated events from first ones is no second way through what derives them; and repeats point at their first, whatever its partition and their number."""
    rows, keys = log(spark)
    out = deriver.derived_once(rows, keys, contract(), F.lit(NOW).cast("timestamp"), 7 * 3600)
    plan = out.groupBy("kind", "reason").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [signature_holds(") == 1 and plan.count("ArrowEvalPython [render(") == 1
    many = rows.where("offset = 0").crossJoin(spark.range(300).withColumnRenamed("id", "k")).withColumns({"offset": F.col("k"), "partition": (2 - F.col("k") % 3).cast("int")}).drop("k")
    found = deriver.derived_once(many, keys, contract(), F.lit(NOW).cast("timestamp"), 7 * 3600).select("partition", "offset", "kind", "details").collect()
    assert [(r.partition, r.offset) for r in found if r.kind == "event"] == [(0, 2)] and len(found) == 300
    assert {(r.kind, *r.details) for r in found if (r.partition, r.offset) != (0, 2)} == {("failure", "derived from/0/2")}


def test_responses_travel_under_their_request(spark):
    kind, topic = "response.v1", "http.responses.gw-1"
    rows = [
        signed(0, answer(1), kind, f"{1:026d}", topic), signed(1, answer(1), kind, f"{2:026d}", topic), signed(2, answer(1, 99), kind, f"{1:026d}", topic), signed(3, b"{", kind, f"{1:026d}", topic),
        signed(4, answer(1), kind, f"{1:026d}", topic, seed=b"e" * 32), signed(5, outcome(1), "result.v1", f"{1:026d}", topic), signed(6, answer(1, 502, fault="outcome_unknown"), kind, f"{1:026d}", topic),
    ]
    got = {r.offset: (r.verdict, r.reason) for r in R.decoded_responses(spark.createDataFrame(rows, LOG), R.key_trust([("bridge", "b1", K.public_key(SEED))], spark)).collect()}
    assert got == {0: ("ok", None), 1: ("not_authentic", "record_key"), 2: ("undecodable", "invalid_status_range"), 3: ("undecodable", "decode"), 4: ("not_authentic", "altered"), 5: ("not_authentic", "type"), 6: ("ok", None)}


@pytest.mark.skipif(not compiled.library(), reason="no libcrypto here")
def test_both_ways_to_sign_agree():
    import random

    r = random.Random(6)
    for _ in range(12):
        seed, message = r.randbytes(32), r.randbytes(r.randrange(300))
        public, signature = K.public_key(seed), K.plain_sign(seed, message)
        assert compiled.sign(seed, message) == signature and compiled.verifies(public, message, signature) and K.plain_verifies(public, message, signature)
        at = r.randrange(64)
        bad = signature[:at] + bytes([signature[at] ^ 1 << r.randrange(8)]) + signature[at + 1 :]
        assert not K.verifies(public, message, bad) and not K.plain_verifies(public, message, bad)
    for public in (b"\xff" * 32, b"", b"\x02" + b"\0" * 31):
        assert K.verifies(public, message, signature) == K.plain_verifies(public, message, signature) == False  # noqa: E712
