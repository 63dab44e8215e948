"""Commands from requests, tokens, state records, feed items."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from mutaspark.functions import codec as K
from mutaspark.operators import gateway as G
from mutaspark.operators import records as R
from mutaspark.plans.adapters import contract
from mutaspark.schema import LOG

SEED = b"k" * 32


def token(head=None, claims=None, seed=SEED):
    enc = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    text = enc({"alg": "EdDSA", "kid": "a"} | (head or {})) + "." + enc({k: v for k, v in ({"iss": "i", "aud": "gw", "exp": 200, "iat": 100, "sub": "app", "instance": "1"} | (claims or {})).items() if v is not None})
    return f"Bearer {text}." + base64.urlsafe_b64encode(K.sign(seed, text.encode())).decode().rstrip("=")


@pytest.mark.parametrize(
    "value, why",
    [
        (token(), None), (None, "missing"), ("Basic x", "not_bearer"), ("Bearer a b", "malformed_header"), ("Bearer x.y", "malformed"), (token({"alg": "none"}), "algorithm"), (token({"kid": "z"}), "unknown_key"), (token(seed=b"o" * 32), "signature"),
        (token(claims={"iss": "x"}), "issuer"), (token(claims={"aud": "x"}), "audience"), (token(claims={"aud": ["x", "gw"]}), None), (token(claims={"exp": None}), "no_expiry"), (token(claims={"exp": 50}), "expired"), (token(claims={"nbf": 500}), "not_yet_valid"),
        (token(claims={"iat": None}), "no_time_of_issue"), (token(claims={"iat": 900}), "issued_in_the_future"), (token(claims={"sub": ""}), "no_subject"), (token(claims={"instance": None}), "no_instance"),
    ],
)
def test_tokens(value, why):
    assert G.token_refusal(value, {"a": K.public_key(SEED)}, "i", "gw", 120) == why


def test_commands_of_requests(spark):
    rows = [("0" * 26, "POST", "/orders", "a=1&api_token=s&b=%20", b'{"x":1}', "k1"), ("1" + "0" * 25, "GET", "/orders", "", b"", None), ("2" + "0" * 25, "PUT", "/orders/o%2F1", "", b"<raw>", None), ("3" + "0" * 25, "POST", "/nowhere", "", b"", None)]
    df = spark.createDataFrame(rows, "request_id string, method string, path string, raw_query string, body binary, idempotency_key string")
    df = df.withColumns({"at": F.expr("timestamp '2024-01-01 00:00:00'"), "application": F.lit("app"), "caller_instance": F.lit("app-1"), "headers": F.expr("map('Authorization', array('s'), 'Content-Type', array('application/json'))")})
    out = G.commands_of(df, contract(), "gw-1").withColumns({"headers": F.expr("array(named_struct('key', 'mut-type', 'value', cast('command.v1' as binary)))"), "partition": F.lit(0), "offset": F.lit(0), "timestamp": F.lit(None).cast("timestamp")})
    got = {r.command.requestId[0]: r for r in R.decoded(out, "command.v1", "command").collect()}
    assert set(got) == {"0", "2"}
    assert got["0"].command.rawQuery == "a=1&b=%20" and list(got["0"].command.headers) == ["content-type"] and got["0"].command.body == '{"json":{"x":1}}' and bytes(got["0"].key).startswith(b"i:")
    assert got["2"].command.pathParams == {"orderId": "o/1"} and K.decode_body(got["2"].command.body) == (b"<raw>", None)
    assert R.audit_entries(out).where("kind = 'requested'").count() == 2


def test_state_records(spark):
    def row(topic, partition, key, value, signed_for=None, kid="b1"):
        frame = lambda t, p, k, v: b"".join(str(len(f)).encode() + b":" + f for f in (t.encode(), str(p).encode(), k, v or b"")) + (b"d" if v is None else b"v")
        signature = K.sign(SEED, b"mutations/state/v1\0" + frame(*(signed_for or (topic, partition, key, value))))
        return (key, value, topic, partition, 0, None, [("mut-kid", kid.encode()), ("mut-sig", base64.b64encode(signature))], True)

    rows = [row("s", 0, b"k", b"v"), row("s", 1, b"k", None), row("s", 2, b"k", b"v", ("s", 0, b"k", b"v")), row("s", 3, b"k", None, ("s", 3, b"k", b"")), row("s", 4, b"k", b"v", kid="x")]
    keys = R.key_trust([("bridge", "b1", K.public_key(SEED)), ("gateway", "x", K.public_key(SEED))], spark)
    got = {r.partition: r.verdict for r in G.state_records(spark.createDataFrame(rows, LOG), keys).collect()}
    assert got == {0: "authentic", 1: "authentic", 2: "altered", 3: "altered", 4: "unknown_key"}


def test_feed_items_and_strict_json(spark):
    mk = lambda kind, value, *more: (b"k", value, "t", 0, 0, None, [("mut-type", kind), *more], True)
    rows = [mk(b"command.v1", b'{"requestId":"r","operationId":"o","headers":{"cookie":["c"]}}'), mk(b"result.v1", b'{"outcome":"Failed","command":{"requestId":"r"}}'), mk(b"command.v1", b"\xff"), mk(b"", b"{}", ("ce_id", b"e"), ("ce_type", b"T"))]
    got = G.feed_items(spark.createDataFrame(rows, LOG)).collect()
    assert [(r.kind, r.request_id) for r in got] == [("command", "r"), ("result", "r"), ("unreadable", None), ("event", "e")] and got[0].secrets == ["cookie"] and got[2].value.startswith("base64:")
    rows = spark.createDataFrame([("application/json; charset=utf-8", '{"a":1}'), ("text/plain", "{}"), ("application/json", "[1]"), ("application/json", '{"b":1}'), ("application/json", "{")], "ct string, body string")
    assert [r.s for r in rows.select(G.strict_json(F.col("ct"), F.col("body"), ["a"]).alias("s")).collect()] == [None, 415, 400, 400, 400]
