"""Rules of records: each is a Column that names what is broken, so one pass reports all of it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mutaspark.functions import columns as C
from mutaspark.schema import MAX_BODY, NAMING, VERSION, Naming


def broken(*rules: tuple[str, Column]) -> Column:
    """Names of the rules whose condition holds, in order. A condition that is null counts as broken."""
    return F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(True)), name) for name, bad in rules]), lambda x: x.isNotNull())


def command_problems(c: Column, body_bytes: Column | None = None, naming: Naming = NAMING) -> Column:
    """All rules that a command, a struct, breaks. The struct is computed once."""
    size = F.lit(0) if body_bytes is None else body_bytes
    return C.bound(F.struct(c.alias("command"), size.alias("size")), lambda x: _command_problems(x["command"], x["size"], naming))


def _command_problems(c: Column, size: Column, naming: Naming) -> Column:
    key = C.empty_if_null(c["idempotencyKey"])
    where = F.concat(C.empty_if_null(c["path"]), C.empty_if_null(c["rawQuery"]))
    instance = F.substring(c["replyTo"], len(naming.reply_topics) + 1, 1 << 30)
    issued, deadline, expires = (c[x].cast("timestamp") for x in ("issuedAt", "deadline", "expiresAt"))
    rules = broken(
        ("version", c["v"] != VERSION),
        ("request_id", ~C.is_ulid(c["requestId"])),
        ("service", ~c["service"].rlike(C.SERVICE_NAME)),
        ("operation_id", C.empty_if_null(c["operationId"]) == ""),
        ("method", ~C.is_mutation(c["method"])),
        ("path_start", ~(c["path"].startswith("/") & c["pathTemplate"].startswith("/"))),
        ("path_characters", where.rlike("[ \\r\\n\\x00#]")),
        ("caller", (C.empty_if_null(c["caller"]["application"]) == "") | (C.empty_if_null(c["caller"]["instance"]) == "")),
        ("body_size", size > MAX_BODY),
        ("key_length", F.octet_length(key) > 255),
        ("key_characters", key.rlike("[^\\x20-\\x7e]")),
        ("reply_to", ~(c["replyTo"].startswith(naming.reply_topics) & instance.rlike(C.SERVICE_NAME))),
        ("times", ~((issued <= deadline) & (deadline < expires))),
    )
    return F.concat(rules, F.transform(C.header_problems(c["headers"]), lambda p: F.concat(F.lit("header_"), p)))


def response_problems(r: Column) -> Column:
    """All rules that a response, a struct, breaks. A service's own status goes with a fault exactly where the service ran."""
    return C.bound(r, _response_problems)


def _response_problems(r: Column) -> Column:
    fault, upstream = C.empty_if_null(r["fault"]), F.coalesce(r["upstreamStatus"], F.lit(0))
    ran = (fault != "") & F.coalesce(C.fault_execution(fault) == "done", F.lit(False))
    known = C.fault_status(fault)
    rules = broken(
        ("version", r["v"] != VERSION),
        ("request_id", ~C.is_ulid(r["requestId"])),
        ("status_range", ~r["status"].between(200, 599)),
        ("fault_unknown", (fault != "") & known.isNull()),
        ("fault_status", F.coalesce((fault != "") & (known != r["status"]), F.lit(False))),
        ("upstream_presence", ran != (upstream != 0)),
        ("upstream_range", ran & (upstream != 0) & ~upstream.between(200, 599)),
        ("replay_of", (C.empty_if_null(r["replayOf"]) != "") & ~C.is_ulid(r["replayOf"])),
    )
    return F.concat(rules, F.transform(C.header_problems(r["headers"], request=False), lambda p: F.concat(F.lit("header_"), p)))


def result_problem(res: Column, naming: Naming = NAMING) -> Column:
    """The first rule that a result, a struct, breaks, or null."""
    return C.bound(res, lambda x: C.bound(F.struct(x.alias("result"), _command_problems(x["command"], F.lit(0), naming).alias("command"), _response_problems(x["response"]).alias("response")), lambda y: _result_problem(y["result"], y["command"], y["response"])))


def _result_problem(res: Column, command: Column, response: Column) -> Column:
    c, r = res["command"], res["response"]
    outcome = C.outcome_of(r["status"], r["fault"], r["upstreamStatus"])
    return (
        F.when(F.coalesce(res["v"] != VERSION, F.lit(True)), "version")
        .when(F.size(command) > 0, F.concat(F.lit("command_"), command[0]))
        .when(F.size(response) > 0, F.concat(F.lit("response_"), response[0]))
        .when(r["requestId"] != c["requestId"], "request_ids_differ")
        .when(C.empty_if_null(r["replayOf"]) != "", "replayed")
        .when(F.coalesce((res["outcome"] != outcome) | (res["type"] != C.result_type(c["operationId"], outcome)), F.lit(True)), "outcome")
        .when(res["completedAt"].cast("timestamp").isNull(), "completed_at")
    )


def freshness(issued: Column, expires: Column, now: Column, skew_s: int = 30, max_ttl_s: int = 3600) -> Column:
    """fresh, or why an authentic command is stale: lifetime, future or expired, in that order. Times are compared in microseconds."""
    us = F.unix_micros
    return (
        F.when(us(expires) - us(issued) > max_ttl_s * 1_000_000, "lifetime")
        .when(us(issued) > us(now) + skew_s * 1_000_000, "future")
        .when(us(now) > us(expires) + skew_s * 1_000_000, "expired")
        .otherwise("fresh")
    )


def durability_problem(brokers: Column, replication: Column, min_insync: Column, unclean: Column) -> Column:
    """Why a topic could lose an acknowledged write, or null. One broker can promise no more than itself."""
    return (
        F.when(unclean, "unclean_election")
        .when(brokers <= 1, None)
        .when(replication < 2, "single_replica")
        .when(min_insync < 2, "single_acknowledgement")
    )
