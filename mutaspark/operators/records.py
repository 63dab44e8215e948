"""From a topic's log to typed records: decode, authenticate, verify."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mutaspark import schema as S
from mutaspark.functions import columns as C
from mutaspark.functions import validation as V
from mutaspark.functions.codec import body_bytes, signature_holds
from mutaspark.schema import NAMING, Naming

KNOWN_FIELDS = {S.COMMAND: [f.name for f in S.COMMAND_FIELDS.fields], S.RESPONSE: [f.name for f in S.RESPONSE_FIELDS.fields], S.RESULT: [f.name for f in S.RESULT_FIELDS.fields]}


def committed(log: DataFrame) -> DataFrame:
    """Records of committed transactions; a log without that column holds no others."""
    return log.where("coalesce(committed, true)") if "committed" in log.columns else log


def typed(log: DataFrame, naming: Naming = NAMING) -> DataFrame:
    """The log with each record's type, key id and signature from its headers (the first of each name)."""
    h = lambda name: C.record_header("headers", name)
    return log.withColumns({"record_type": h(naming.type_header), "key_id": h(naming.key_header), "signature": F.try_to_binary(h(naming.signature_header), F.lit("base64"))})


FIELDS = {S.COMMAND: S.COMMAND_FIELDS, S.RESPONSE: S.RESPONSE_FIELDS, S.RESULT: S.RESULT_FIELDS}


def json_text(value: Column) -> Column:
    """A record's value as text where it is JSON."""
    return C.bound(value.cast("string"), lambda text: F.when(F.is_valid_utf8(text) & C.is_json(text), text))


def decoded(log: DataFrame, kind: str, as_: str) -> DataFrame:
    """The log with a record of one type as a struct, null where it isn't JSON of that shape, and `unknown_fields`, which strict readers refuse. Bodies stay as they are on the wire."""
    known = F.array(*[F.lit(n.lower()) for n in KNOWN_FIELDS[kind]])
    keys = F.transform(F.json_object_keys("value_text"), lambda k: F.lower(k))
    parsed = F.from_json("value_text", FIELDS[kind], {"mode": "PERMISSIVE"})
    return log.withColumn("value_text", json_text(F.col("value"))).withColumns({as_: parsed, "unknown_fields": F.array_except(keys, known)}).drop("value_text")


def decoded_by_type(log: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """The log with a column for each of several types (type: column); each record is parsed once, as its own type."""
    rows = log.withColumn("value_text", F.when(F.col("record_type").isin(*kinds), json_text(F.col("value"))))
    own = {as_: F.when(F.col("record_type") == kind, F.from_json("value_text", FIELDS[kind], {"mode": "PERMISSIVE"})) for kind, as_ in kinds.items()}
    return rows.withColumns(own).drop("value_text")


def with_bodies(records: DataFrame, wire: Column | str, as_: str = "body") -> DataFrame:
    """Adds a body's bytes and what is wrong with it, byte for byte as it was sent."""
    return records.withColumn(as_, body_bytes(F.col(wire) if isinstance(wire, str) else wire))


def authenticated(log: DataFrame, keys: DataFrame, naming: Naming = NAMING) -> DataFrame:
    """Adds `authenticity`: authentic, or why not. keys: role, kid, public (32 bytes), a small trusted table.

    The cheap checks come first: a known type, a signature that is there, a key of the role that signs this type;
    only what passes is verified. A signature made for one type of record never holds for another. The keys go to
    the records: dealt out by role and key, a whole log would meet in one task, and a stream would stay so.
    """
    roles = F.create_map(*[F.lit(x) for kv in S.SIGNED_BY.items() for x in kv])
    rows = typed(log, naming).withColumn("signer_role", F.try_element_at(roles, F.col("record_type")))
    trusted = keys.select(F.col("role").alias("trusted_role"), F.col("kid").alias("trusted_kid"), "public")
    rows = rows.join(F.broadcast(trusted), (F.col("signer_role") == F.col("trusted_role")) & (F.col("key_id") == F.col("trusted_kid")), "left")
    early = (
        F.when(F.col("signer_role").isNull(), "unknown_type")
        .when(F.coalesce(F.octet_length("signature"), F.lit(0)) == 0, "unsigned")
        .when(F.col("public").isNull(), "unknown_key")
    )
    domain = F.concat(F.lit(naming.sign_domain), F.regexp_replace("record_type", "[.]", "/"))
    holds = signature_holds(F.when(F.col("early").isNull(), F.col("public")), domain, F.col("value"), F.col("signature"))
    rows = rows.withColumn("early", early).withColumn("holds", holds)
    return rows.withColumn("authenticity", F.coalesce("early", F.when(F.col("holds"), "authentic").otherwise("altered"))).drop("early", "holds", "public", "trusted_role", "trusted_kid", "signer_role")


def verified_commands(log: DataFrame, keys: DataFrame, service: str, now: Column, skew_s: int = 30, max_ttl_s: int = 3600, naming: Naming = NAMING) -> DataFrame:
    """Commands with a `verdict`: ok, stale (authentic, but outside of its time) or not_authentic, and `reason`.

    In order: type, signature, strict decode, validity, service and topic, record key, freshness.
    """
    rows = decoded(authenticated(log, keys, naming), S.COMMAND, "command")
    c = F.col("command")
    rows = with_bodies(rows, F.col("command.body"))
    problems = V.command_problems(c, F.coalesce(F.octet_length("body.raw"), F.lit(0)), naming)
    own_key = C.dedup_key(c["requestId"], c["caller"]["application"], c["service"], c["operationId"], c["idempotencyKey"])
    fresh = V.freshness(c["issuedAt"].cast("timestamp"), c["expiresAt"].cast("timestamp"), now, skew_s, max_ttl_s)
    reason = (
        F.when(F.col("record_type") != S.COMMAND, "type")
        .when(F.col("authenticity") != "authentic", F.col("authenticity"))
        .when(c.isNull() | (F.size("unknown_fields") > 0) | F.col("body.problem").isNotNull(), "decode")
        .when(F.size(problems) > 0, F.concat(F.lit("invalid_"), problems[0]))
        .when((c["service"] != service) | (F.col("topic") != C.topic_of("command", F.lit(service), naming)), "other_service")
        .when(F.col("key").cast("string") != own_key, "record_key")
        .when(fresh != "fresh", fresh)
    )
    rows = rows.withColumn("reason", reason)
    return rows.withColumn("verdict", F.when(F.col("reason").isNull(), "ok").when(F.col("reason").isin("lifetime", "future", "expired"), "stale").otherwise("not_authentic"))


def decoded_results(log: DataFrame, keys: DataFrame, naming: Naming = NAMING) -> DataFrame:
    """Results with a `verdict`: ok, not_authentic or undecodable, and `reason`. A genuine result copied to another service's topic isn't authentic there."""
    rows = decoded(authenticated(log, keys, naming), S.RESULT, "result")
    r = F.col("result")
    problem = V.result_problem(r, naming)
    reason = (
        F.when(F.col("record_type") != S.RESULT, "type")
        .when(F.col("authenticity") != "authentic", F.col("authenticity"))
        .when(r.isNull(), "decode")
        .when(problem.isNotNull(), F.concat(F.lit("invalid_"), problem))
        .when(F.col("topic") != C.topic_of("result", r["command"]["service"], naming), "other_topic")
    )
    rows = rows.withColumn("reason", reason)
    undecodable = (F.col("reason") == "decode") | F.col("reason").startswith("invalid_")
    return rows.withColumn("verdict", F.when(F.col("reason").isNull(), "ok").when(undecodable, "undecodable").otherwise("not_authentic"))


def decoded_responses(log: DataFrame, keys: DataFrame, naming: Naming = NAMING) -> DataFrame:
    """Responses with a `verdict`: ok, not_authentic or undecodable, and `reason`. A response travels under its request's id; a genuine one under another key isn't authentic there."""
    rows = decoded(authenticated(log, keys, naming), S.RESPONSE, "response")
    r = F.col("response")
    problems = V.response_problems(r)
    reason = (
        F.when(F.col("record_type") != S.RESPONSE, "type")
        .when(F.col("authenticity") != "authentic", F.col("authenticity"))
        .when(r.isNull(), "decode")
        .when(F.size(problems) > 0, F.concat(F.lit("invalid_"), problems[0]))
        .when(~F.col("key").cast("string").eqNullSafe(r["requestId"]), "record_key")
    )
    rows = rows.withColumn("reason", reason)
    undecodable = (F.col("reason") == "decode") | F.col("reason").startswith("invalid_")
    return rows.withColumn("verdict", F.when(F.col("reason").isNull(), "ok").when(undecodable, "undecodable").otherwise("not_authentic"))


def new_results(commands: DataFrame, naming: Naming = NAMING) -> DataFrame:
    """Results of answered commands, as they are made: `result` with its outcome, type and time, and `problem`, the first rule that it breaks, or null. Rows: command and response (structs of the schema) and completed_at."""
    c, r = F.col("command"), F.col("response")
    bad = {"outcome_made": C.outcome_of(r["status"], r["fault"], r["upstreamStatus"]), "command_bad": V.command_problems(c, naming=naming), "response_bad": V.response_problems(r)}
    rows, outcome = commands.withColumns(bad), F.col("outcome_made")
    at = F.date_format("completed_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    made = F.struct(F.lit(S.VERSION).alias("v"), C.result_type(c["operationId"], outcome).alias("type"), outcome.alias("outcome"), c.alias("command"), r.alias("response"), at.alias("completedAt"))
    problem = (
        F.when(F.size("command_bad") > 0, F.concat(F.lit("command_"), F.col("command_bad")[0])).when(F.size("response_bad") > 0, F.concat(F.lit("response_"), F.col("response_bad")[0]))
        .when(r["requestId"] != c["requestId"], "request_ids_differ").when(C.empty_if_null(r["replayOf"]) != "", "replayed").when(F.col("completed_at").isNull(), "completed_at")
    )
    return rows.withColumns({"result": made, "problem": problem}).drop(*bad)


def audit_entries(log: DataFrame, keys: DataFrame | None = None, naming: Naming = NAMING) -> DataFrame:
    """One flat row for each command or result of a log, forged ones included: who asked for what, and what became of it.

    Bodies, headers, queries and the value of a key never get in. A row that can't be read keeps its place and
    why. Authenticity is told apart from readability; without keys it is unverified. A pure map.
    """
    rows = committed(log)
    rows = authenticated(rows, keys, naming) if keys is not None else typed(rows, naming).withColumn("authenticity", F.lit("unverified"))
    rows = decoded_by_type(rows, {S.COMMAND: "own", S.RESULT: "result"})
    is_command, is_result = F.col("record_type") == S.COMMAND, F.col("record_type") == S.RESULT
    c = F.when(is_command, F.col("own")).when(is_result, F.col("result.command"))
    r, result = F.col("result.response"), F.col("result")
    command_bad, result_bad = V.command_problems(F.col("own"), naming=naming), V.result_problem(result, naming)
    error = (
        F.when(is_command, F.when(F.col("own").isNull(), "not a command").when(F.size(command_bad) > 0, F.array_join(command_bad, ",")))
        .when(is_result, F.when(result.isNull(), "not a result").otherwise(result_bad))
        .otherwise(F.concat(F.lit("record type "), F.col("record_type")))
    )
    rows = rows.withColumn("error", F.substring(error, 1, 200))
    good = lambda x: F.when(F.col("error").isNull(), x)
    result_only = lambda x: F.when(F.col("error").isNull() & is_result, x)
    authentic = F.when(F.col("authenticity").isin("authentic", "unverified"), F.col("authenticity")).otherwise("not-authentic")
    columns = {
        "kind": F.when(F.col("error").isNotNull(), "unreadable").when(is_command, "requested").otherwise("completed"),
        "at": F.coalesce(result_only(result["completedAt"].cast("timestamp")), good(c["issuedAt"].cast("timestamp")), F.col("timestamp")),
        "request_id": good(c["requestId"]), "service": F.coalesce(good(c["service"]), C.service_of_topic("topic", naming)), "operation_id": good(c["operationId"]),
        "method": good(c["method"]), "path": good(c["path"]), "application": good(c["caller"]["application"]), "instance": good(c["caller"]["instance"]),
        "authenticity": authentic, "auth_error": F.when(authentic == "not-authentic", F.col("authenticity")),
        "idempotent": good(C.empty_if_null(c["idempotencyKey"]) != ""), "outcome": result_only(result["outcome"]),
        "status": result_only(F.when(F.coalesce(r["upstreamStatus"], F.lit(0)) != 0, r["upstreamStatus"]).otherwise(r["status"])), "fault": result_only(r["fault"]),
        "error": F.col("error"), "topic": F.col("topic"), "partition": F.col("partition"), "offset": F.col("offset"),
    }
    return rows.select(*[x.alias(n) for n, x in columns.items()])


def latest_by_key(changes: DataFrame, key: str = "key", value: str = "value", offset: str = "offset") -> DataFrame:
    """A compacted log's present state: each key's last value; a null value deletes. Partial aggregation, no sort."""
    last = changes.groupBy(key).agg(F.max_by(F.struct(value, offset), offset).alias("last"))
    return last.select(key, f"last.{value}", f"last.{offset}").where(F.col(value).isNotNull())


def earliest_by_key(changes: DataFrame, key: str, value: str, offset: str = "offset") -> DataFrame:
    """Each key's first value: what was there first stays."""
    return changes.groupBy(key).agg(F.min_by(value, offset).alias(value), F.min(offset).alias(offset))


def offsets_at(log: DataFrame, since: Column) -> DataFrame:
    """For each partition the first offset not before a time, else its end."""
    return log.groupBy("topic", "partition").agg(F.coalesce(F.min(F.when(F.col("timestamp") >= since, F.col("offset"))), F.max("offset") + 1).alias("offset"))


def low_watermarks(log: DataFrame, settled: Column) -> DataFrame:
    """For each partition the lowest offset that isn't settled, else its end."""
    return log.groupBy("topic", "partition").agg(F.coalesce(F.min(F.when(~settled, F.col("offset"))), F.max("offset") + 1).alias("watermark"))


def consumer_lag(log: DataFrame, positions: DataFrame) -> DataFrame:
    """Records of each partition beyond a reader's position (topic, partition, position); none read where it has none."""
    ends = log.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("end_offset"))
    return ends.join(positions, ["topic", "partition"], "left").withColumn("lag", F.col("end_offset") - F.coalesce("position", F.lit(0)))


def key_trust(keys: list[tuple[str, str, bytes]], spark) -> DataFrame:
    """Trusted keys as a table. Ids are 1 to 64 characters and occur once in a role."""
    seen = set()
    for role, kid, public in keys:
        if not (0 < len(kid) <= 64 and len(public) == 32 and role in ("gateway", "bridge")) or (role, kid) in seen:
            raise ValueError(f"key {role}/{kid}")
        seen.add((role, kid))
    return spark.createDataFrame(keys, T.StructType([T.StructField("role", T.StringType()), T.StructField("kid", T.StringType()), T.StructField("public", T.BinaryType())]))
