"""The driver's tables read as mutation traffic: each event is an exchange of a request and its answer. Deterministic, in Spark and, for the oracles, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mutaspark.contract import Contract, load
from mutaspark.functions import columns as C

CONTRACT = """
openapi: 3.0.3
info: {title: Orders, version: 1.0.0}
components:
  securitySchemes:
    key: {type: apiKey, in: query, name: api_token}
    login: {type: http, scheme: bearer}
paths:
  /orders:
    post:
      operationId: createOrder
      responses: {'201': {description: created}, '400': {description: refused}}
      x-mut-event:
        on: 201
        topic: orders.events
        type: OrderCreated
        key: $.response.body.id
        value: {id: $.response.body.id, customer: $.request.body.customerId, quantity: '$.request.body.items[0].quantity', source: orders}
    get: {operationId: listOrders, responses: {'200': {description: all}}}
  /orders/{orderId}:
    get: {operationId: getOrder, responses: {'200': {description: one}}}
    put: {operationId: replaceOrder, responses: {'200': {description: replaced}}}
    delete: {operationId: deleteOrder, responses: {'204': {description: gone}}}
  /orders/search:
    post: {operationId: searchOrders, responses: {'200': {description: found}}, x-mut-retry-safe: true}
"""
SERVICE = "orders"


def contract() -> Contract:
    return load(SERVICE, CONTRACT)


#: Bytes of a scanned file that one task takes on: an exchange costs far more to make, sign and check than to read.
SPREAD_BYTES = 1 << 20


def spread(scan: DataFrame) -> DataFrame:
    """A scan's rows dealt out evenly over tasks whose number grows with its files. Splits of a Parquet file can't tell: a row group is read by one of them, and a file may be a single one."""
    size = int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return scan.repartition(max(scan.sparkSession.sparkContext.defaultParallelism, -(-size // SPREAD_BYTES)))


def exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an event: who asked what of which service, and what became of it. Views are reads, which never enter the log."""
    e = spread(spark.read.parquet(f"{sf_dir}/events.parquet")).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props")
    kinds = {
        "signup": ("POST", "orders", "createOrder", "/orders", 201), "purchase": ("POST", "payments", "createCharge", "/charges", 201),
        "click": ("PUT", "orders", "replaceOrder", "/orders/{orderId}", 200), "error": ("DELETE", "orders", "deleteOrder", "/orders/{orderId}", 204),
        "view": ("GET", "orders", "getOrder", "/orders/{orderId}", 200),
    }
    by = lambda at: F.expr("case event_type " + " ".join(f"when '{k}' then {v[at]!r}" for k, v in kinds.items()) + " end")
    fault = F.expr("case event_id % 40 when 1 then 'outcome_unknown' when 2 then 'upstream_unavailable' when 3 then 'command_stale' when 4 then 'response_too_large' when 5 then 'response_incomplete' when 6 then 'operation_mismatch' when 7 then 'secret_in_command' end")
    k = F.get_json_object("props", "$.k").cast("long")
    x = e.select(
        "event_id", "ts", "user_id", "value", k.alias("k"), F.lpad(F.col("event_id").cast("string"), 26, "0").alias("request_id"), by(0).alias("method"), by(1).alias("service"), by(2).alias("operation_id"),
        by(3).alias("template"), F.concat(F.lit("app-"), F.col("user_id") % 5).alias("application"), F.concat(F.lit("app-"), F.col("user_id") % 5, F.lit("-"), F.col("user_id") % 15).alias("instance"),
        F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("k-"), k.cast("string"))).alias("idempotency_key"), fault.alias("fault"), F.when(F.col("event_id") % 10 == 8, 400).otherwise(by(4)).alias("b_status"),
        F.col("ts").alias("issued_at"), (F.col("ts") + F.expr("interval 10 seconds")).alias("deadline"), (F.col("ts") + F.expr("interval 5 minutes")).alias("expires_at"),
        F.timestamp_micros(F.unix_micros(F.col("ts")) + (F.col("event_id") * 7919) % 12000 * 1000).alias("completed_at"),
        (F.col("event_id") % 4).cast("int").alias("partition"), F.col("event_id").alias("offset"),
    )
    path = F.when(F.col("template") == "/orders/{orderId}", F.concat(F.lit("/orders/o-"), F.col("user_id"))).otherwise(F.col("template"))
    body = F.when(F.col("operation_id").isin("createOrder", "replaceOrder"), F.format_string('{"customerId":"c-%d","items":[{"sku":"s-%d","quantity":%d}]}', F.col("user_id"), F.col("k"), F.col("event_id") % 3 + 1))
    body = body.when(F.col("operation_id") == "createCharge", F.format_string('{"accountId":"a-%d","amountCents":%d,"currency":"EUR"}', F.col("user_id"), F.floor(F.col("value")).cast("long"))).otherwise("")
    ran = C.fault_execution("fault") == "done"
    x = x.withColumns({"path": path, "body": body, "upstream_status": F.when(ran, F.col("b_status")), "status": F.coalesce(C.fault_status("fault"), F.col("b_status"))})
    return x.withColumn("outcome", C.outcome_of("status", "fault", "upstream_status"))


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exchanges(spark, sf_dir).where(C.is_mutation("method"))


#: The same as `exchanges` for DuckDB, as CTEs; `m` has the mutations.
SQL = """x0 as (select event_id, ts, user_id, value, cast(json_extract_string(props, '$.k') as bigint) as k, lpad(event_id::varchar, 26, '0') as request_id,
  case event_type when 'signup' then 'POST' when 'purchase' then 'POST' when 'click' then 'PUT' when 'error' then 'DELETE' when 'view' then 'GET' end as method,
  case event_type when 'purchase' then 'payments' else 'orders' end as service,
  case event_type when 'signup' then 'createOrder' when 'purchase' then 'createCharge' when 'click' then 'replaceOrder' when 'error' then 'deleteOrder' when 'view' then 'getOrder' end as operation_id,
  case event_type when 'signup' then '/orders' when 'purchase' then '/charges' else '/orders/{orderId}' end as template,
  'app-' || (user_id % 5)::varchar as application, 'app-' || (user_id % 5)::varchar || '-' || (user_id % 15)::varchar as instance,
  case event_id % 40 when 1 then 'outcome_unknown' when 2 then 'upstream_unavailable' when 3 then 'command_stale' when 4 then 'response_too_large' when 5 then 'response_incomplete' when 6 then 'operation_mismatch' when 7 then 'secret_in_command' end as fault,
  case when event_id % 10 = 8 then 400 when event_type in ('signup', 'purchase') then 201 when event_type = 'error' then 204 else 200 end as b_status,
  ts as issued_at, ts + interval 10 seconds as deadline, ts + interval 5 minutes as expires_at, ts + to_milliseconds((event_id * 7919) % 12000) as completed_at,
  (event_id % 4)::int as "partition", event_id as "offset" from events),
x as (select *, case when event_id % 3 <> 0 then 'k-' || k::varchar end as idempotency_key,
  case when template = '/orders/{orderId}' then '/orders/o-' || user_id::varchar else template end as path,
  case when operation_id in ('createOrder', 'replaceOrder') then '{"customerId":"c-' || user_id::varchar || '","items":[{"sku":"s-' || k::varchar || '","quantity":' || (event_id % 3 + 1)::varchar || '}]}'
    when operation_id = 'createCharge' then '{"accountId":"a-' || user_id::varchar || '","amountCents":' || floor(value)::bigint::varchar || ',"currency":"EUR"}' else '' end as body,
  case when fault in ('response_too_large', 'response_incomplete') then b_status end as upstream_status,
  case when fault in ('upstream_unavailable', 'command_stale') then 503 when fault is not null then 502 else b_status end as status from x0),
xo as (select *, case when fault is null then case when status between 200 and 299 then 'Succeeded' else 'Failed' end
  when fault = 'outcome_unknown' then 'OutcomeUnknown' when upstream_status is null then 'NotExecuted'
  when upstream_status between 200 and 299 then 'Succeeded' else 'Failed' end as outcome from x),
m as (select * from xo where method in ('POST', 'PUT', 'PATCH', 'DELETE'))
"""
#: F10's digest of fields, in SQL.
HASH = lambda *f: "sha256(" + " || ".join(f"strlen({x})::varchar || ':' || {x}" for x in f) + ")"
DEDUP_KEY_SQL = f"case when idempotency_key is null then 'r:' || request_id else 'i:' || {HASH('application', 'service', 'operation_id', 'idempotency_key')} end"
FINGERPRINT_SQL = HASH("method", "path", "''", "'application/json'", "body")


def keyed(rows: DataFrame) -> DataFrame:
    """Mutations with their scope and the fingerprint of their payload."""
    scope = C.dedup_key("request_id", "application", "service", "operation_id", "idempotency_key")
    print_ = C.fingerprint("method", "path", F.lit(""), F.lit("application/json"), "body")
    return rows.withColumns({"dedup_key": scope, "fingerprint": print_})
