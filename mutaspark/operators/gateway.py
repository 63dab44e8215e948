"""What a gateway and a bridge do around the log: commands from requests, callers' tokens, state records, feed items, counters."""

from __future__ import annotations

import base64
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mutaspark import schema as S
from mutaspark.contract import Contract
from mutaspark.functions import columns as C
from mutaspark.functions.codec import body_wire, signature_holds, verifies
from mutaspark.operators.flows import resolved
from mutaspark.schema import NAMING, Naming

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def commands_of(requests: DataFrame, contract: Contract, instance: str, timeout_s: int = 10, ttl_s: int = 300, naming: Naming = NAMING) -> DataFrame:
    """Command records (key, value, topic) of logged requests that resolve to a mutation.

    requests: request_id, at, method, path, raw_query, application, caller_instance, headers, body (bytes),
    idempotency_key. Secrets that the contract declares and hop-by-hop headers stay behind; a query keeps the
    bytes and order of what is left.
    """
    rows = resolved(requests.where(C.is_mutation("method")), contract).where("route = 'found'")
    secret = [*contract.secrets.headers, "idempotency-key"]
    headers = F.map_filter(C.transported("headers"), lambda n, _: ~n.isin(*secret))
    query = C.without_parameters("raw_query", list(contract.secrets.query)) if contract.secrets.query else C.empty_if_null("raw_query")
    after = lambda s: F.date_format(F.col("at") + F.expr(f"interval {s} seconds"), ISO)
    none = lambda c: F.nullif(C.empty_if_null(c), F.lit(""))
    command = F.struct(
        F.lit(S.VERSION).alias("v"), F.col("request_id").alias("requestId"), F.lit(contract.service).alias("service"), F.col("operation_id").alias("operationId"), "method", F.col("template").alias("pathTemplate"),
        "path", none(query).alias("rawQuery"), F.when(F.size("path_params") > 0, F.col("path_params")).alias("pathParams"), F.struct("application", F.col("caller_instance").alias("instance")).alias("caller"),
        headers.alias("headers"), F.lit("@body@").alias("body"), none("idempotency_key").alias("idempotencyKey"), F.lit(naming.reply_topics + instance).alias("replyTo"),
        after(timeout_s).alias("deadline"), after(0).alias("issuedAt"), after(ttl_s).alias("expiresAt"),
    )
    key = C.dedup_key("request_id", "application", F.lit(contract.service), "operation_id", "idempotency_key")
    value = F.replace(F.to_json(command), F.lit('"@body@"'), body_wire(F.col("body")))
    return rows.select(key.cast("binary").alias("key"), value.cast("binary").alias("value"), F.lit(naming.command_topics + contract.service).alias("topic"), "request_id")


def _part(text: str) -> dict:
    raw = base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))
    out = json.loads(raw)
    if not isinstance(out, dict):
        raise ValueError(text)
    return out


def token_refusal(token: str | None, public: dict[str, bytes], issuer: str, audience: str, now: int, leeway: int = 30) -> str | None:
    """Why a caller's bearer token isn't accepted, or None. EdDSA only; issuer, audience, expiry, time of issue, subject and instance are required."""
    scheme, _, text = (token or "").partition(" ")
    if not token:
        return "missing"
    if scheme.lower() != "bearer" or not text:
        return "not_bearer"
    if " " in text.strip():
        return "malformed_header"
    try:
        head, claims, signature = text.split(".")
        header, body, raw = _part(head), _part(claims), base64.urlsafe_b64decode(signature + "=" * (-len(signature) % 4))
    except (ValueError, TypeError):
        return "malformed"
    if header.get("alg") != "EdDSA":
        return "algorithm"
    if header.get("kid") not in public:
        return "unknown_key"
    if not verifies(public[header["kid"]], f"{head}.{claims}".encode(), raw):
        return "signature"
    number = lambda k: isinstance(body.get(k), (int, float)) and not isinstance(body.get(k), bool)
    if body.get("iss") != issuer:
        return "issuer"
    if audience not in (body["aud"] if isinstance(body.get("aud"), list) else [body.get("aud")]):
        return "audience"
    if not number("exp"):
        return "no_expiry"
    if now > body["exp"] + leeway:
        return "expired"
    if number("nbf") and now < body["nbf"] - leeway:
        return "not_yet_valid"
    if not number("iat"):
        return "no_time_of_issue"
    if now < body["iat"] - leeway:
        return "issued_in_the_future"
    return "no_subject" if not body.get("sub") else "no_instance" if not body.get("instance") else None


def token_refusals(public: dict[str, bytes], issuer: str, audience: str, leeway: int = 30):
    """`token_refusal` over columns of a request log: (token, seconds) to a reason or null."""

    @F.pandas_udf(T.StringType())
    def refused(token: pd.Series, now: pd.Series) -> pd.Series:
        return pd.Series([token_refusal(t, public, issuer, audience, int(n), leeway) for t, n in zip(token, now, strict=True)], dtype=object)

    return refused


def state_frame(topic: Column, partition: Column, key: Column, value: Column) -> Column:
    """What the signature of a state record is over: its place, key and value, each with its length, and whether it deletes."""
    nothing = F.lit("").cast("binary")
    fields = (topic.cast("binary"), partition.cast("string").cast("binary"), F.coalesce(key, nothing), F.coalesce(value, nothing))
    framed = [x for f in fields for x in (F.octet_length(f).cast("string").cast("binary"), F.lit(":").cast("binary"), f)]
    return F.concat(*framed, F.when(value.isNull(), F.lit("d")).otherwise("v").cast("binary"))


def state_records(log: DataFrame, keys: DataFrame, naming: Naming = NAMING) -> DataFrame:
    """A state changelog with `verdict`: a record's signature is over its topic, partition, key and value, deletions too, so none can be moved. A reader stops at any verdict but authentic."""
    h = lambda n: C.record_header("headers", n)
    rows = log.withColumns({"key_id": h(naming.key_header), "signature": F.try_to_binary(h(naming.signature_header), F.lit("base64"))})
    trusted = keys.where("role = 'bridge'").select(F.col("kid").alias("trusted_kid"), "public")
    rows = rows.join(F.broadcast(trusted), F.col("key_id") == F.col("trusted_kid"), "left")
    framed = state_frame(F.col("topic"), F.col("partition"), F.col("key"), F.col("value"))
    holds = signature_holds(F.col("public"), F.lit(f"{naming.sign_domain}state/v1"), framed, F.col("signature"))
    early = F.when(F.coalesce(F.octet_length("signature"), F.lit(0)) == 0, "unsigned").when(F.col("public").isNull(), "unknown_key")
    return rows.withColumns({"early": early, "holds": holds}).withColumn("verdict", F.coalesce("early", F.when(F.col("holds"), "authentic").otherwise("altered"))).drop("early", "holds", "public", "trusted_kid")


def feed_items(log: DataFrame, naming: Naming = NAMING) -> DataFrame:
    """Records of all topics for display: kind (command, result, response, event or unreadable), what identifies them, value and key as text, which secret headers they carry, and what is wrong."""
    kind_header, id_header = C.record_header("headers", naming.type_header), C.record_header("headers", "ce_id")
    text = F.when(F.is_valid_utf8(F.col("value").cast("string")), F.col("value").cast("string"))
    good = C.is_json(text)
    at = lambda *paths: F.coalesce(*[F.get_json_object(text, p) for p in paths])
    kind = F.when(id_header != "", "event").when(~F.coalesce(good, F.lit(False)), "unreadable").when(kind_header == S.COMMAND, "command").when(kind_header == S.RESULT, "result").when(kind_header == S.RESPONSE, "response").otherwise("unreadable")
    rid = F.when(id_header != "", id_header).otherwise(at("$.command.requestId", "$.requestId"))
    headers = F.from_json(at("$.command.headers", "$.headers"), "map<string,array<string>>")
    shown = C.printable("value")
    return log.select(
        kind.alias("kind"), rid.alias("request_id"), F.when(id_header != "", C.record_header("headers", "ce_type")).otherwise(at("$.command.operationId", "$.operationId")).alias("what"), at("$.outcome").alias("outcome"),
        shown["text"].alias("value"), shown["cut"].alias("cut"), C.printable("key")["text"].alias("key"), C.caller_secrets(F.coalesce(headers, F.create_map().cast("map<string,array<string>>"))).alias("secrets"),
        F.when(kind == "unreadable", F.substring(F.concat(F.lit("type "), kind_header), 1, 300)).alias("error"), "topic", "partition", "offset", "timestamp",
    )


def counters(decisions: DataFrame) -> DataFrame:
    """How often each thing was done: executed, replayed, refused, started, and results made."""
    n = lambda a: F.count_if(F.col("action") == a)
    return decisions.agg(n("execute").alias("executed"), n("replay").alias("replayed"), n("refuse").alias("refused"), n("started").alias("started"), F.count_if("result").alias("results"))


def observed(batch: DataFrame, name: str = "derivation"):
    """A batch with its counts of events and failures as metrics, gathered while it runs: (rows, observation)."""
    from pyspark.sql import Observation

    watch = Observation(name)
    return batch.observe(watch, F.count_if(F.col("kind") == "event").alias("events"), F.count_if(F.col("kind") == "failure").alias("failures")), watch


def event_topics(contracts: list[Contract]) -> list[str]:
    return sorted({o.event.topic for c in contracts for o in c.operations if o.event})


def idempotency_window_s(retention_s: int = 86_400, max_ttl_s: int = 3600, skew_s: int = 30) -> int:
    """How long a key is remembered at least."""
    return retention_s + max_ttl_s + 2 * skew_s


def strict_json(content_type: Column, text: Column, known: list[str], most: int = 1 << 20) -> Column:
    """The status with which a strict reader refuses a JSON request, or null: 415 another media type, 413 too large, 400 not one object or unknown fields."""
    media = F.lower(F.trim(F.split_part(C.empty_if_null(content_type), F.lit(";"), F.lit(1))))
    unknown = F.size(F.array_except(F.json_object_keys(text), F.array(*[F.lit(k) for k in known])))
    return F.when(media != "application/json", 415).when(F.octet_length(text) > most, 413).when(~F.coalesce(C.is_json(text), F.lit(False)) | F.json_object_keys(text).isNull() | (unknown > 0), 400)
