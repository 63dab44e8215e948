"""Records of the mutation stream: their fields, their fixed values, and the names that a deployment may choose."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Naming:
    """Names on the wire. Defaults are ours; a reader of other logs sets those of their writers."""

    header_prefix: str = "mut-"
    command_topics: str = "http.requests."
    reply_topics: str = "http.responses."
    result_topics: str = "http.results."
    problem_urn: str = "urn:mutations:"
    sign_domain: str = "mutations/"
    extensions: str = "x-mut-"

    @property
    def event_extension(self) -> str:
        return f"{self.extensions}event"

    @property
    def retry_extension(self) -> str:
        return f"{self.extensions}retry-safe"

    @property
    def type_header(self) -> str:
        return f"{self.header_prefix}type"

    @property
    def key_header(self) -> str:
        return f"{self.header_prefix}kid"

    @property
    def signature_header(self) -> str:
        return f"{self.header_prefix}sig"


NAMING = Naming()
VERSION = 1
MAX_BODY = 1 << 20

# Record types, and the role that signs each.
COMMAND, RESPONSE, RESULT = "command.v1", "response.v1", "result.v1"
FAILURE, DEDUP = "event-failure.v1", "event-dedup.v1"
SIGNED_BY = {COMMAND: "gateway", RESPONSE: "bridge", RESULT: "bridge"}

MUTATIONS = ("POST", "PUT", "PATCH", "DELETE")

# Fault, status that the caller gets, whether the service ran.
FAULTS = [
    ("outcome_unknown", 502, "unknown"),
    ("upstream_unavailable", 503, "none"),
    ("command_stale", 503, "none"),
    ("operation_mismatch", 502, "none"),
    ("idempotency_key_reused", 422, "none"),
    ("idempotency_in_flight", 409, "none"),
    ("response_too_large", 502, "done"),
    ("response_incomplete", 502, "done"),
    ("secret_in_command", 502, "none"),
]
OUTCOMES = ("Succeeded", "Failed", "NotExecuted", "OutcomeUnknown")

# Headers of one connection only, and those that carry a caller's secrets.
HOP_HEADERS = ("connection", "keep-alive", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade", "content-length", "host", "expect")
SECRET_HEADERS = ("authorization", "proxy-authorization", "cookie", "x-api-key")

# Why a result yields no event although it should.
FAILURE_REASONS = (
    "unknown_operation", "operation_mismatch", "body_not_relayed", "evaluation_failed", "undecodable_result",
    "not_authentic", "misrouted", "duplicate_result", "beyond_dedup_window",
)


def _struct(ddl: str) -> T.StructType:
    """From "name type" pairs; types are Spark's short names or one of the structures below."""
    known = {"headers": T.MapType(T.StringType(), T.ArrayType(T.StringType())), "params": T.MapType(T.StringType(), T.StringType())}
    simple = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "timestamp": T.TimestampType(), "binary": T.BinaryType(), "boolean": T.BooleanType()}
    known |= {k: v for k, v in STRUCTS.items()}
    return T.StructType([T.StructField(n, (simple | known)[t]) for n, t in (x.split() for x in ddl.split(","))])


STRUCTS: dict[str, T.DataType] = {}
RECORD_HEADERS = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.BinaryType())]))
#: A topic's log with the columns of Spark's Kafka source, and whether the record's transaction was committed.
LOG = T.StructType([*_struct("key binary,value binary,topic string,partition int,offset long,timestamp timestamp").fields, T.StructField("headers", RECORD_HEADERS), T.StructField("committed", T.BooleanType())])
CALLER = STRUCTS["caller"] = _struct("application string,instance string")
BODY = STRUCTS["body"] = _struct("json string,base64 string")
POSITION = STRUCTS["position"] = _struct("topic string,partition int,offset long")
#: Times stay text: Spark's timestamps lose nanoseconds, and text that is emitted again must not change.
COMMAND_FIELDS = STRUCTS["command"] = _struct(
    "v int,requestId string,service string,operationId string,method string,pathTemplate string,path string,rawQuery string,pathParams params,caller caller,"
    "headers headers,body string,idempotencyKey string,traceparent string,replyTo string,deadline string,issuedAt string,expiresAt string"
)
RESPONSE_FIELDS = STRUCTS["response"] = _struct("v int,requestId string,status int,headers headers,body string,fault string,upstreamStatus int,replayOf string")
RESULT_FIELDS = _struct("v int,type string,outcome string,command command,response response,completedAt string")
AUDIT_FIELDS = _struct(
    "kind string,at timestamp,request_id string,service string,operation_id string,method string,path string,application string,instance string,authenticity string,"
    "auth_error string,idempotent boolean,outcome string,status int,fault string,error string,topic string,partition int,offset long"
)
