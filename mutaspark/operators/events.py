"""Events from results: which facts a contract's mappings state, at most once each, and every reason why not."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mutaspark.contract import Contract
from mutaspark.contract.expressions import Exchange, Unresolved, render_key, render_value
from mutaspark.functions import columns as C
from mutaspark.functions.codec import partition_of


def operations_table(spark: SparkSession, contracts: list[Contract]) -> DataFrame:
    """The contracts' operations as a small table: what records are resolved and explained against."""
    rows = [(o.service, o.id, o.method, o.template, o.mutation, o.replayable, e.on if (e := o.event) else None, e.topic if e else None, e.type if e else None) for c in contracts for o in c.operations]
    return spark.createDataFrame(rows, "op_service string, op_id string, op_method string, op_template string, mutation boolean, replayable boolean, event_on int, event_topic string, event_type string")


def explained(results: DataFrame, operations: DataFrame) -> DataFrame:
    """Whether a result fires an event (`fires`), and the reason if not. Rows have service, operation_id, status, fault, upstream_status.

    The answers of a service that ran count by its own status, also where its body was lost.
    """
    known = operations.select("op_service").distinct().withColumnRenamed("op_service", "known_service")
    rows = results.join(F.broadcast(known), F.col("service") == F.col("known_service"), "left")
    rows = rows.join(F.broadcast(operations), (F.col("service") == F.col("op_service")) & (F.col("operation_id") == F.col("op_id")), "left")
    ran, fault = C.fault_execution("fault"), C.empty_if_null("fault")
    own = F.when(fault == "", F.col("status")).otherwise(F.col("upstream_status"))
    reason = (
        F.when(F.col("known_service").isNull(), "unknown_service")
        .when(F.col("event_on").isNull(), "no_event_declared")
        .when((fault != "") & (ran == "none"), "not_called")
        .when((fault != "") & (ran == "unknown"), "outcome_unknown")
        .when((fault != "") & (F.col("upstream_status") == F.col("event_on")), "body_not_relayed")
        .when((own != F.col("event_on")) | (C.outcome_of("status", "fault", "upstream_status") != "Succeeded"), "other_status")
    )
    return rows.withColumn("reason", reason).withColumn("fires", F.col("reason").isNull()).drop("known_service", "op_service", "op_id", "op_method", "op_template", "mutation", "replayable")


def derivation_verdict(service: Column, method: Column, template: Column, fault: Column, upstream: Column, status: Column, own_service: str) -> Column:
    """event, none or why a derivation fails, before any expression is evaluated. Needs the columns of `operations_table` beside the result's."""
    ran = C.fault_execution(fault)
    return (
        F.when(service != own_service, "operation_mismatch")
        .when(F.col("op_id").isNull(), "unknown_operation")
        .when((F.col("op_method") != method) | (F.col("op_template") != template), "operation_mismatch")
        .when(F.col("event_on").isNull(), "none")
        .when((C.empty_if_null(fault) != "") & (ran == "done") & (upstream == F.col("event_on")), "body_not_relayed")
        .when((C.empty_if_null(fault) != "") | (status != F.col("event_on")), "none")
        .otherwise("event")
    )


RENDERED = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType()), T.StructField("problems", T.ArrayType(T.StringType()))])


def renderer(contract: Contract):
    """A function of columns by an Arrow UDF that evaluates a mapping's whole template in one go, each body parsed once: (operation_id, request body, response body, path parameters, query, request headers, response headers) to key, value and problems. What no mapping reads isn't sent to Python."""
    mappings = {o.id: o.event for o in contract.operations if o.event}
    read = {e.source for m in mappings.values() for e in (m.key, *m.value.expressions())}

    def one(operation, request, response, params, query, sent, received):
        m = mappings.get(operation)
        if m is None:
            return None, None, []
        x = Exchange(request, response, dict(params) if params is not None else {}, query or "", dict(sent) if sent is not None else {}, dict(received) if received is not None else {})
        problems: list[str] = []
        key = None
        try:
            key = render_key(x, m.key)
        except Unresolved as wrong:
            problems.append(f"key ({m.key.text}): {wrong}")
        value = render_value(x, m.value, problems)
        return (None, None, problems) if problems else (key, value, [])

    @F.pandas_udf(RENDERED)
    def render(operation: pd.Series, request: pd.Series, response: pd.Series, params: pd.Series, query: pd.Series, sent: pd.Series, received: pd.Series) -> pd.DataFrame:
        rows = zip(operation, request, response, params, query, sent, received, strict=True)
        return pd.DataFrame([one(*r) for r in rows], columns=["key", "value", "problems"], dtype=object)

    def of_columns(operation, request, response, params, query, sent, received) -> Column:
        given = {"request.body": request, "response.body": response, "request.pathParams": params, "request.query": query, "request.headers": sent, "response.headers": received}
        return render(operation, *[c if source in read else F.lit(None).cast("string") for source, c in given.items()])

    return of_columns


def derived(results: DataFrame, contract: Contract, partitions: int | None = None) -> DataFrame:
    """Results with `kind` (event, failure, none), `reason`, `details`, `event_key`, `event_value` and the mapping's topic and type.

    Rows: topic, partition, offset, record_key, verdict (of decoded_results), service, operation_id, method,
    path_template, request_id, completed_at, status, fault, upstream_status, request_body, response_body (bytes),
    path_params, raw_query, request_headers, response_headers. partitions: of the result topic; then a record on
    another partition than its key's is a failure. Only rows that may be events reach the UDF.
    """
    spark = results.sparkSession
    ops = operations_table(spark, [contract]).drop("op_service", "mutation", "replayable")
    rows = results.join(F.broadcast(ops), F.col("operation_id") == F.col("op_id"), "left")
    stage = F.when(F.col("verdict") == "not_authentic", "not_authentic").when(F.col("verdict") == "undecodable", "undecodable_result")
    if partitions:
        rows = rows.withColumn("own_partition", partition_of("record_key", partitions))
        stage = stage.when(F.col("own_partition") != F.col("partition"), "misrouted")
    by = derivation_verdict(F.col("service"), F.col("method"), F.col("path_template"), F.col("fault"), F.col("upstream_status"), F.col("status"), contract.service)
    rows = rows.withColumn("stage", stage.otherwise(by))
    render = renderer(contract)
    asked = [F.when(F.col("stage") == "event", F.col(c)) for c in ("operation_id", "request_body", "response_body", "path_params", "raw_query", "request_headers", "response_headers")]
    rows = rows.withColumn("rendered", render(*asked))
    bad = F.size("rendered.problems") > 0
    reason = F.when(~F.col("stage").isin("event", "none"), F.col("stage")).when(bad, "evaluation_failed")
    rows = rows.withColumn("reason", reason).withColumn("kind", F.when(F.col("reason").isNotNull(), "failure").when(F.col("stage") == "event", "event").otherwise("none"))
    return rows.withColumns({"details": F.col("rendered.problems"), "event_key": F.col("rendered.key"), "event_value": F.col("rendered.value")}).drop("stage", "rendered", "own_partition", "op_id", "op_method", "op_template", "event_on")


def at_most_once(rows: DataFrame, now: Column, window_s: int) -> DataFrame:
    """Of rows of kind event, the first of each request in log order stays one; others become failures that point at it. Events completed before the window are failures too: nobody can tell whether they were emitted.

    Age is judged first. All rows take one way through one plan: what derives them, signatures above all, runs once.
    Rows are dealt out by request, those that aren't events by their place, and each request's are read in log order;
    only what follows an event's first is told of it, so no request is held in memory, however many results it has.
    """
    old = F.unix_micros(now) - F.unix_micros("completed_at") > window_s * 1_000_000
    aged = (F.col("kind") == "event") & old
    place = F.struct("partition", "offset")
    live = rows.withColumn("reason", F.when(aged, "beyond_dedup_window").otherwise(F.col("reason"))).withColumn("kind", F.when(aged, "failure").otherwise(F.col("kind")))
    told = (F.col("kind") == "event") & F.col("request_id").isNotNull()
    live = live.withColumns({"once_request": F.when(told, F.col("request_id")), "once_place": F.when(~F.coalesce(told, F.lit(False)), F.xxhash64("partition", "offset"))})
    in_order = Window.partitionBy("once_request", "once_place").orderBy("partition", "offset").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = live.withColumn("first_place", F.first(place).over(in_order))
    again = F.col("once_request").isNotNull() & (F.col("first_place") != place)
    details = F.when(again, F.array(F.concat_ws("/", F.lit("derived from"), F.col("first_place.partition").cast("string"), F.col("first_place.offset").cast("string")))).otherwise(F.col("details"))
    found = found.withColumns({"details": details, "reason": F.when(again, "duplicate_result").otherwise(F.col("reason")), "kind": F.when(again, "failure").otherwise(F.col("kind"))})
    return found.drop("once_request", "once_place", "first_place")


def failure_pointers(rows: DataFrame) -> DataFrame:
    """Failures as records that point at the result and never copy it; keyed by request, or by place where there is none."""
    place = F.concat_ws("/", "topic", F.col("partition").cast("string"), F.col("offset").cast("string"))
    key = F.coalesce(F.nullif(C.empty_if_null("request_id"), F.lit("")), place)
    position = F.struct("topic", "partition", "offset").alias("result")
    return rows.where("kind = 'failure'").select(key.alias("key"), F.lit(1).alias("v"), "reason", F.coalesce("details", F.array().cast("array<string>")).alias("details"), "service", "operation_id", "request_id", position)


def cloud_events(rows: DataFrame) -> DataFrame:
    """Events as records of their topics in CloudEvents' binary mode: what describes them in headers, the value as it is."""
    at = F.date_format("completed_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    pairs = {"ce_specversion": F.lit("1.0"), "ce_id": F.col("request_id"), "ce_source": C.event_source("service", "operation_id"), "ce_type": F.col("event_type"), "ce_time": at, "content-type": F.lit("application/json")}
    if "traceparent" in rows.columns:
        pairs["ce_traceparent"] = F.nullif(F.col("traceparent"), F.lit(""))
    headers = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.cast("binary").alias("value")) for k, v in pairs.items()]), lambda h: h["value"].isNotNull())
    return rows.where("kind = 'event'").select(F.col("event_topic").alias("topic"), F.col("event_key").cast("binary").alias("key"), F.col("event_value").cast("binary").alias("value"), headers.alias("headers"))
