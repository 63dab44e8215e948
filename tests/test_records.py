"""Codecs, columns and rules."""

import base64

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mutaspark.functions import codec as K
from mutaspark.functions import columns as C
from mutaspark.functions import validation as V
from mutaspark.operators import records as R


@given(st.binary(max_size=200))
def test_bodies_come_back(raw):
    assert K.decode_body(K.encode_body(raw)) == (raw, None)


@pytest.mark.parametrize("raw, inline", [(b'{"a":1}', True), (b'{"a": 1}', False), (b'"<"', False), (b'"\xe2\x80\xa8"', False), (b"\xff", False), (b"12.50", True), (b"a=1&b=2", False), (b"null", True)])
def test_inline(raw, inline):
    assert K.encode_body(raw).startswith('{"json"') == inline


@pytest.mark.parametrize("wire, problem", [("[]", "not_an_object"), ("{}", "neither_set"), ('{"json":1,"base64":"eA=="}', "both_set"), ('{"x":1}', "unknown_field:x"), ('{"base64":"!"}', "bad_base64"), ('{"json":1} 2', "trailing_data"), ("{", "malformed")])
def test_bodies_refused(wire, problem):
    assert K.decode_body(wire) == (None, problem)


def test_large_body_refused():
    assert K.decode_body('{"base64":"' + base64.b64encode(b"x" * ((1 << 20) + 1)).decode() + '"}')[1] == "too_large"


def test_partitioner():
    assert [K.murmur2(x) for x in (b"21", b"foobar", b"abc")] == [-973932308, -790332482, 479470107]  # public vectors


def test_signatures():
    seed = bytes.fromhex("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb")  # RFC 8032, test 2
    public = bytes.fromhex("3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c")
    assert K.public_key(seed) == public
    signature = K.sign(seed, b"\x72")
    assert signature.hex().startswith("92a009a9f0d4cab8720e820b5f642540") and K.verifies(public, b"\x72", signature)
    assert not K.verifies(public, b"\x73", signature) and not K.verifies(public, b"\x72", signature[:-1] + b"\xff") and not K.verifies(public, b"\x72", b"")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_scope_ignores_instance_and_keeps_fields_apart(spark):
    lit = lambda *x: [F.lit(v) for v in x]
    a = one(spark, C.dedup_key(*lit("r", "app", "svc", "op", "k")))
    assert a == one(spark, C.dedup_key(*lit("other", "app", "svc", "op", "k"))) != one(spark, C.dedup_key(*lit("r", "ap", "psvc", "op", "k")))
    assert one(spark, C.dedup_key(*lit("r", "app", "svc", "op", ""))) == one(spark, C.dedup_key(*lit("r", "app", "svc", "op", None))) == "r:r"


def test_headers(spark):
    h = spark.sql("select map('Content-Type', array('a'), 'Connection', array('X-One, x-two'), 'X-One', array('1'), 'X-TWO', array('2'), 'Cookie', array('c'), 'X-None', array(), 'Set-Cookie', array('s')) as h")
    assert sorted(h.select(C.transported("h")["content-type"].alias("a"), F.map_keys(C.transported("h")).alias("k")).first().k) == ["content-type", "set-cookie"]
    assert sorted(h.select(F.map_keys(C.transported("h", False)).alias("k")).first().k) == ["content-type", "cookie", "set-cookie"]


def test_record_header_is_the_first(spark):
    h = F.array(*[F.struct(F.lit("a").alias("key"), F.lit(v).cast("binary").alias("value")) for v in ("1", "2")])
    assert one(spark, C.record_header(h, "a")) == "1" and one(spark, C.record_header(h, "b")) == ""


def test_small_functions(spark):
    assert one(spark, C.service_of_host(F.lit("Orders.example.com:8080"))) == "orders"
    assert one(spark, C.service_of_topic(F.lit("http.results.pay"))) == "pay" and one(spark, C.service_of_topic(F.lit("x"))) is None
    assert one(spark, C.result_type(F.lit("createOrder"), F.lit("Failed"))) == "CreateOrderFailed" and one(spark, C.result_type(F.lit(""), F.lit("Failed"))) == "Failed"
    assert one(spark, C.is_ulid(F.lit("01ARZ3NDEKTSV4RRFFQ69G5FAV"))) and not one(spark, C.is_ulid(F.lit("81ARZ3NDEKTSV4RRFFQ69G5FAV")))
    assert one(spark, C.ulid_millis(F.lit("01ARZ3NDEKTSV4RRFFQ69G5FAV"))) == 1469922850259
    assert one(spark, C.query_values(F.lit("a=1&b=%20&a=&a"), "a")) == ["1", "", ""]
    assert one(spark, C.without_parameters(F.lit("a=1&to%6ben=s&b=%20"), ["token"])) == "a=1&b=%20"
    assert bytes(one(spark, C.cut_bytes(F.lit("é" * 5), 3))) == "é".encode() + b"\xc3"
    assert one(spark, C.printable(F.lit(b"\xff\x00")))["text"].startswith("base64:") and one(spark, C.printable(F.lit("é" * 9000)))["cut"]


@pytest.mark.parametrize("status, fault, upstream, expected", [(201, None, None, "Succeeded"), (404, None, None, "Failed"), (502, "outcome_unknown", None, "OutcomeUnknown"), (503, "command_stale", None, "NotExecuted"), (502, "response_too_large", 201, "Succeeded"), (502, "response_incomplete", 500, "Failed"), (500, "no_such", None, "NotExecuted")])
def test_outcomes(spark, status, fault, upstream, expected):
    assert one(spark, C.outcome_of(F.lit(status), F.lit(fault).cast("string"), F.lit(upstream).cast("int"))) == expected


@pytest.mark.parametrize("issued, expires, verdict", [("00:00:00", "00:05:00", "fresh"), ("00:00:00", "02:00:00", "lifetime"), ("00:10:31", "00:11:00", "future"), ("00:10:30", "00:11:00", "fresh"), ("00:00:00", "00:09:29", "expired"), ("00:00:00", "00:09:30", "fresh")])
def test_freshness(spark, issued, expires, verdict):
    at = lambda t: F.expr(f"timestamp '2024-01-01 {t}'")
    now = "00:10:00" if verdict != "fresh" or issued > "00:10" or expires == "00:09:30" else "00:04:00"
    assert one(spark, V.freshness(at(issued), at(expires), at(now))) == verdict


def test_state(spark):
    log = spark.createDataFrame([("a", "1", 0), ("b", "1", 1), ("a", None, 2), ("b", "2", 3), ("c", "9", 4)], "key string, value string, offset long")
    assert sorted(map(tuple, R.latest_by_key(log).collect())) == [("b", "2", 3), ("c", "9", 4)]
    assert sorted(map(tuple, R.earliest_by_key(log, "key", "value").collect()))[0][:2] == ("a", "1")


def test_keys_refused(spark):
    for keys in ([("gateway", "", b"x" * 32)], [("gateway", "k", b"x")], [("king", "k", b"x" * 32)], [("gateway", "k", b"x" * 32)] * 2):
        with pytest.raises(ValueError):
            R.key_trust(keys, spark)
