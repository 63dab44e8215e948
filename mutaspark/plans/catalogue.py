"""The registry that the driver reads: query name to callable, and query name to DuckDB SQL. Each runs an operator over the adapted tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mutaspark.functions import columns as C
from mutaspark.functions import validation as V
from mutaspark.functions.codec import partition_of
from mutaspark.operators import events as E
from mutaspark.operators import flows as W
from mutaspark.operators import machine as M
from mutaspark.operators import records as R
from mutaspark.operators import routes
from mutaspark.schema import FAULTS
from mutaspark.plans.adapters import DEDUP_KEY_SQL, FINGERPRINT_SQL, HASH, SERVICE, SQL, contract, exchanges, keyed, mutations

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
AS_OF = "timestamp '2024-01-31 00:00:00'"
US = 1_000_000


def query(sql: str | None = None):
    """Registers a query under its function's name. sql: the oracle, after the adapters' CTEs."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql if sql.lstrip().startswith("with ") else f"with {SQL}{sql}"
        return f

    return register


def _table(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Outcomes.


@query("""select service, operation_id, upper(operation_id[1]) || operation_id[2:] || outcome as result_type, count(*) as n, count(*) filter (completed_at > deadline) as late
  from m group by all""")
def mutation_ledger(spark, sf_dir):
    rows = mutations(spark, sf_dir).withColumn("result_type", C.result_type("operation_id", "outcome"))
    return rows.groupBy("service", "operation_id", "result_type").agg(F.count("*").alias("n"), F.count_if(F.col("completed_at") > F.col("deadline")).alias("late"))


@query("select service, count(*) filter (method = 'GET') as reads, count(*) filter (method <> 'GET') as writes from xo group by service")
def passthrough_share(spark, sf_dir):
    write = C.is_mutation("method")
    return exchanges(spark, sf_dir).groupBy("service").agg(F.count_if(~write).alias("reads"), F.count_if(write).alias("writes"))


@query("select fault, status, outcome, count(*) as n from m where fault is not null group by all")
def fault_dimension(spark, sf_dir):
    return mutations(spark, sf_dir).where("fault is not null").groupBy("fault", "status", "outcome").agg(F.count("*").alias("n"))


def _log(spark, sf_dir) -> DataFrame:
    """Results and their commands as a topic log, in wire form; bodies inline. Every 97th record is junk, every 101st wasn't committed."""
    x = keyed(mutations(spark, sf_dir))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    headers = F.create_map(F.lit("content-type"), F.array(F.lit("application/json")))
    params = F.when(F.col("template") == "/orders/{orderId}", F.create_map(F.lit("orderId"), F.concat(F.lit("o-"), F.col("user_id"))))
    body = F.when(F.col("body") != "", F.concat(F.lit('{"json":'), F.col("body"), F.lit("}"))).otherwise("null")
    command = F.struct(
        F.lit(1).alias("v"), F.col("request_id").alias("requestId"), "service", F.col("operation_id").alias("operationId"), "method", F.col("template").alias("pathTemplate"), "path", params.alias("pathParams"),
        F.struct("application", "instance").alias("caller"), headers.alias("headers"), F.lit("@body@").alias("body"), F.col("idempotency_key").alias("idempotencyKey"),
        F.lit("http.responses.gw-1").alias("replyTo"), iso("deadline").alias("deadline"), iso("issued_at").alias("issuedAt"), iso("expires_at").alias("expiresAt"),
    )
    answer = F.struct(F.lit(1).alias("v"), F.col("request_id").alias("requestId"), "status", headers.alias("headers"), F.lit("@answer@").alias("body"), "fault", F.col("upstream_status").alias("upstreamStatus"))
    result = F.struct(F.lit(1).alias("v"), C.result_type("operation_id", "outcome").alias("type"), "outcome", command.alias("command"), answer.alias("response"), iso("completed_at").alias("completedAt"))
    made = F.when((F.col("status") == 201) & F.col("fault").isNull(), F.concat(F.lit('{"json":{"id":"o-'), F.col("event_id").cast("string"), F.lit('"}}'))).otherwise("null")
    filled = lambda s: F.replace(F.replace(F.to_json(s), F.lit('"@body@"'), body), F.lit('"@answer@"'), made)
    head = lambda t: F.array(F.struct(F.lit("mut-type").alias("key"), F.lit(t).cast("binary").alias("value")))
    junk = F.col("event_id") % 97 == 0
    base = [F.col("dedup_key").cast("binary").alias("key"), "partition", "offset", (F.col("event_id") % 101 != 0).alias("committed")]
    commands = x.select(*base, filled(command).cast("binary").alias("value"), C.topic_of("command", "service").alias("topic"), F.col("issued_at").alias("timestamp"), head("command.v1").alias("headers"))
    results = x.select(*base, F.when(junk, F.lit("junk")).otherwise(filled(result)).cast("binary").alias("value"), C.topic_of("result", "service").alias("topic"), F.col("completed_at").alias("timestamp"), head("result.v1").alias("headers"))
    return commands.unionByName(results)


@query("""select kind, service, outcome, fault, idempotent, count(*) as n, sum(status)::bigint as statuses, min(seen) as first_at from (
  select 'requested' as kind, service, null as outcome, null as fault, idempotency_key is not null as idempotent, null as status, issued_at as seen from m where event_id % 101 <> 0
  union all select case when event_id % 97 = 0 then 'unreadable' else 'completed' end, service, case when event_id % 97 <> 0 then outcome end, case when event_id % 97 <> 0 then fault end,
    case when event_id % 97 <> 0 then idempotency_key is not null end, case when event_id % 97 <> 0 then coalesce(upstream_status, status) end, completed_at from m where event_id % 101 <> 0) group by all""")
def audit_entries(spark, sf_dir):
    rows = R.audit_entries(_log(spark, sf_dir))
    return rows.groupBy("kind", "service", "outcome", "fault", "idempotent").agg(F.count("*").alias("n"), F.sum("status").alias("statuses"), F.min("at").alias("first_at"))


# Idempotency.


@query(f"select request_id, {DEDUP_KEY_SQL} as dedup_key from m")
def dedup_keys(spark, sf_dir):
    return keyed(mutations(spark, sf_dir)).select("request_id", "dedup_key")


@query(f"select request_id, {FINGERPRINT_SQL} as fingerprint from m")
def fingerprints(spark, sf_dir):
    return keyed(mutations(spark, sf_dir)).select("request_id", "fingerprint")


_SCOPED = f"k as (select *, {DEDUP_KEY_SQL} as dedup_key, {FINGERPRINT_SQL} as fingerprint from m)"
_VERDICTS = f""", {_SCOPED}, f as (select *, first_value(fingerprint) over w as first_print, row_number() over w as rn from k window w as (partition by dedup_key order by "partition", "offset")),
v as (select *, case when rn = 1 then 'original' when fingerprint = first_print then 'replay' else 'reused' end as verdict from f) """


@query(_VERDICTS + "select request_id, verdict from v")
def idempotency_verdicts(spark, sf_dir):
    return W.verdicts(keyed(mutations(spark, sf_dir))).select("request_id", "verdict")


@query(_VERDICTS + "select service, (idempotency_key is not null) as keyed, verdict, count(*) as n, count(distinct dedup_key) as scopes from v group by all")
def distinct_outcomes_per_scope(spark, sf_dir):
    rows = W.verdicts(keyed(mutations(spark, sf_dir))).withColumn("keyed", F.col("idempotency_key").isNotNull())
    return rows.groupBy("service", "keyed", "verdict").agg(F.count("*").alias("n"), F.countDistinct("dedup_key").alias("scopes"))


def _recorded(spark, sf_dir, faults: bool) -> DataFrame:
    """Mutations as input of the machine: their recorded attempts are what the service answered."""
    x = keyed(mutations(spark, sf_dir))
    own = F.col("fault") if faults else F.lit(None).cast("string")
    attempt = F.when(own.isin("outcome_unknown", "upstream_unavailable", "response_too_large", "response_incomplete"), own)
    return x.select(
        "dedup_key", "request_id", "fingerprint", F.lit(0).alias("partition"), "offset", F.unix_micros("issued_at").alias("now"), F.unix_micros("expires_at").alias("expires_at"), F.col("idempotency_key").isNotNull().alias("keyed"),
        F.lit(True).alias("authentic"), F.lit(True).alias("routed"), F.coalesce(own == "command_stale", F.lit(False)).alias("stale"), F.coalesce(own == "secret_in_command", F.lit(False)).alias("secret"),
        F.coalesce(own == "operation_mismatch", F.lit(False)).alias("drift"), F.col("method").isin("PUT", "DELETE").alias("replayable"),
        F.when(attempt.isNotNull(), C.fault_status(attempt)).otherwise(F.col("b_status")).alias("attempt_status"), attempt.alias("attempt_fault"), F.when(C.fault_execution(attempt) == "done", F.col("b_status")).alias("attempt_upstream"),
    )


def _machine_sql(of: str = "m", seeds: str = "") -> str:
    """The decision table as a recursive query: each step decides a scope's next command from what the step before left. of: the mutations; seeds: a CTE of that name with what scopes start from."""
    refused = "case when stale then 'command_stale' when secret then 'secret_in_command' when drift then 'operation_mismatch' end"
    status = "case {f} " + " ".join(f"when '{f}' then {s}" for f, s, _ in FAULTS) + " end"
    ran = "case {f} " + " ".join(f"when '{f}' then '{r}'" for f, _, r in FAULTS) + " end"
    live = "(r.owner is not null and k.now <= r.purge)"
    claimed = f"({live} and not (r.entry_outcome = 'NotExecuted' or (r.entry_outcome = 'OutcomeUnknown' and k.replayable)))"
    action = f"case when k.refused is not null then 'refuse' when {live} and r.entry_print <> k.fingerprint then 'reuse' when {claimed} then 'replay' else 'execute' end"

    def step(source: str) -> str:
        return f"""select k.*, {action} as act, {live} as was, r.owner as o, r.entry_print as p, r.entry_outcome as eo, r.entry_status as es, r.entry_fault as ef, r.purge as pu from {source}"""

    made = "case when act = 'refuse' then 'NotExecuted' else own_outcome end"
    owns = "(act = 'execute' or (act = 'refuse' and not was))"
    carried = f"""select * exclude (act, was, o, p, eo, es, ef, pu), act, o as before_owner, eo as before_outcome, es as before_status, ef as before_fault, {made} as made_outcome,
      case when {owns} then request_id when was then o end as owner, case when {owns} then fingerprint when was then p end as entry_print, case when {owns} then {made} when was then eo end as entry_outcome,
      case when {owns} then case when act = 'refuse' then {status.format(f="refused")} else attempt_status end when was then es end as entry_status, case when {owns} then coalesce(case when act = 'refuse' then refused else attempt_fault end, '') when was then ef end as entry_fault,
      case when {owns} then greatest(expires + {60 * US}, case when keyed then now + {86_400 * US} else 0 end) when was then pu end as purge"""
    nothing = "(select null::varchar as owner, null::varchar as entry_print, null::varchar as entry_outcome, null::int as entry_status, null::varchar as entry_fault, null::bigint as purge) r"
    attempt = "case when fault in ('outcome_unknown', 'upstream_unavailable', 'response_too_large', 'response_incomplete') then fault end"
    return f"""with recursive {SQL}, s as (select *, {DEDUP_KEY_SQL} as dedup_key, {FINGERPRINT_SQL} as fingerprint, epoch_us(issued_at) as now, epoch_us(expires_at) as expires, idempotency_key is not null as keyed,
  coalesce(fault = 'command_stale', false) as stale, coalesce(fault = 'secret_in_command', false) as secret, coalesce(fault = 'operation_mismatch', false) as drift, method in ('PUT', 'DELETE') as replayable, {attempt} as attempt_fault from {of}),
{seeds}a as (select *, {refused} as refused, coalesce({status.format(f="attempt_fault")}, b_status) as attempt_status from s),
k as (select dedup_key, request_id, "offset", fingerprint, now, expires, keyed, replayable, refused, attempt_fault, attempt_status, row_number() over (partition by dedup_key order by "offset") as rn,
  case when attempt_fault is null or {ran.format(f="attempt_fault")} = 'done' then case when b_status between 200 and 299 then 'Succeeded' else 'Failed' end when {ran.format(f="attempt_fault")} = 'unknown' then 'OutcomeUnknown' else 'NotExecuted' end as own_outcome from a),
d as ({carried} from ({step("k left join seeds r on k.dedup_key = r.dedup_key where k.rn = 1" if seeds else f"k, {nothing} where k.rn = 1")}) union all {carried} from ({step("k join d r on k.dedup_key = r.dedup_key and k.rn = r.rn + 1")}))
select dedup_key, request_id, 0 as "partition", "offset", case act when 'reuse' then 'refuse' else act end as action,
  case act when 'refuse' then {status.format(f="refused")} when 'reuse' then 422 when 'replay' then before_status else attempt_status end as status,
  case act when 'refuse' then refused when 'reuse' then 'idempotency_key_reused' when 'replay' then before_fault else coalesce(attempt_fault, '') end as fault,
  case act when 'reuse' then 'NotExecuted' when 'replay' then before_outcome else made_outcome end as outcome, case act when 'replay' then before_owner else '' end as replay_of, act <> 'replay' as result from d"""


@query(_machine_sql())
def command_machine_replay(spark, sf_dir):
    return M.replayed(_recorded(spark, sf_dir, True))


@query(f""", {_SCOPED}, f as (select *, first_value(fingerprint) over w as first_print, first_value(request_id) over w as first_id, row_number() over w as rn from k window w as (partition by dedup_key order by "offset"))
select request_id, case when rn = 1 then 'execute' when fingerprint = first_print then 'replay' else 'refuse' end as action, case when rn > 1 and fingerprint = first_print then first_id else '' end as replay_of from f""")
def command_machine_reduced(spark, sf_dir):
    """Without faults and within one memory: nothing expires, so what comes first in a scope decides."""
    forever = M.Settings(retention=10_000 * 86_400 * US)
    return M.replayed(_recorded(spark, sf_dir, False), forever).select("request_id", "action", "replay_of")


@query(f""", {_SCOPED}, e as (select dedup_key, min("offset") as born from k where "offset" < 5000 group by dedup_key)
select count(*) as unclaimed from k where "offset" >= 5000 and dedup_key not in (select dedup_key from e)""")
def genesis_claims(spark, sf_dir):
    rows = keyed(mutations(spark, sf_dir))
    return W.unclaimed(rows.where("offset >= 5000"), rows.where("offset < 5000")).agg(F.count("*").alias("unclaimed"))


# Events.


def _results(spark, sf_dir, service: str = SERVICE) -> DataFrame:
    """Results of one service as the derivation takes them, every 50th twice."""
    x = keyed(mutations(spark, sf_dir)).where(F.col("service") == service)
    made = F.when((F.col("status") == 201) & F.col("fault").isNull() & (F.col("event_id") % 29 != 0), F.concat(F.lit('{"id":"o-'), F.col("event_id").cast("string"), F.lit('"}'))).otherwise("{}")
    headers = F.create_map(F.lit("content-type"), F.array(F.lit("application/json")))
    rows = x.select(
        C.topic_of("result", "service").alias("topic"), "partition", "offset", F.col("dedup_key").alias("record_key"), F.lit("ok").alias("verdict"), "service", "operation_id", "method", F.col("template").alias("path_template"),
        "request_id", "completed_at", "status", "fault", "upstream_status", F.col("body").cast("binary").alias("request_body"), made.cast("binary").alias("response_body"),
        F.create_map().cast("map<string,string>").alias("path_params"), F.lit("").alias("raw_query"), headers.alias("request_headers"), headers.alias("response_headers"),
    )
    places = F.expr("case when cast(request_id as bigint) % 50 = 11 then array(offset, offset + 1000000000) else array(offset) end")
    return rows.select(*[F.explode(places).alias("offset") if c == "offset" else c for c in rows.columns])


_DERIVED = """, r as (select *, 0 as copy from m where service = 'orders' union all select *, 1 as copy from m where service = 'orders' and event_id % 50 = 11),
d as (select *, "offset" + copy * 1000000000 as place, case when operation_id <> 'createOrder' then 'none' when fault in ('response_too_large', 'response_incomplete') and upstream_status = 201 then 'body_not_relayed'
  when fault is not null or status <> 201 then 'none' when event_id % 29 = 0 then 'evaluation_failed' else 'event' end as step from r),
a as (select *, case when step = 'event' and date_diff('microsecond', completed_at, timestamp '2024-01-31 00:00:00') > 20 * 86400 * 1000000::bigint then 'beyond_dedup_window' when step = 'event' and copy = 1 then 'duplicate_result' else step end as final from d) """


@query(_DERIVED + """select 'orders.events' as event_topic, 'OrderCreated' as event_type, 'o-' || event_id::varchar as event_key,
  '{"customer":"c-' || user_id::varchar || '","id":"o-' || event_id::varchar || '","quantity":' || (event_id % 3 + 1)::varchar || ',"source":"orders"}' as event_value from d where step = 'event'""")
def event_derivation(spark, sf_dir):
    rows = E.derived(_results(spark, sf_dir), contract())
    return rows.where("kind = 'event'").select("event_topic", "event_type", "event_key", "event_value")


@query(_DERIVED + "select step as reason, count(*) as n from d where step not in ('none', 'event') group by step")
def derivation_failures(spark, sf_dir):
    return E.derived(_results(spark, sf_dir), contract()).where("kind = 'failure'").groupBy("reason").agg(F.count("*").alias("n"))


@query(_DERIVED + """select case when final in ('event', 'none') then final else 'failure' end as kind, case when final not in ('event', 'none') then final end as reason, count(*) as n, min(place) as first_place from a group by all""")
def event_dedup(spark, sf_dir):
    rows = E.at_most_once(E.derived(_results(spark, sf_dir), contract()), F.expr(AS_OF), 20 * 86400)
    return rows.groupBy("kind", "reason").agg(F.count("*").alias("n"), F.min("offset").alias("first_place"))


@query(_DERIVED + """select lpad(event_id::varchar, 26, '0') as key, final as reason, "partition" as result_partition, place as result_offset from a where final not in ('none', 'event')""")
def failure_pointers(spark, sf_dir):
    rows = E.at_most_once(E.derived(_results(spark, sf_dir), contract()), F.expr(AS_OF), 20 * 86400)
    return E.failure_pointers(rows).select("key", "reason", F.col("result.partition").alias("result_partition"), F.col("result.offset").alias("result_offset"))


@query(_DERIVED + """select 'orders.events' as topic, 'o-' || event_id::varchar as key, lpad(event_id::varchar, 26, '0') as ce_id, '/services/orders/operations/createOrder' as ce_source from a where final = 'event'""")
def cloud_events(spark, sf_dir):
    rows = E.cloud_events(E.at_most_once(E.derived(_results(spark, sf_dir), contract()), F.expr(AS_OF), 20 * 86400))
    return rows.select("topic", F.col("key").cast("string").alias("key"), C.record_header("headers", "ce_id").alias("ce_id"), C.record_header("headers", "ce_source").alias("ce_source"))


@query("""select operation_id, case when service <> 'orders' then 'unknown_service' when operation_id <> 'createOrder' then 'no_event_declared' when fault in ('response_too_large', 'response_incomplete') then case when upstream_status = 201 then 'body_not_relayed' else 'other_status' end
  when fault = 'outcome_unknown' then 'outcome_unknown' when fault is not null then 'not_called' when status <> 201 then 'other_status' end as reason, count(*) as n from m group by all""")
def expect_explain(spark, sf_dir):
    rows = E.explained(mutations(spark, sf_dir), E.operations_table(spark, [contract()]))
    return rows.groupBy("operation_id", "reason").agg(F.count("*").alias("n"))


# Pairing, traces, feeds.


@query("""select pairing, count(*) as n from (select case when q.event_id is null then 'orphan' when d.event_id is null then 'in_flight' else 'completed' end as pairing
  from (select event_id from m where event_id % 13 <> 0) q full join (select event_id from m where event_id % 17 <> 0) d using (event_id)) group by pairing""")
def requested_vs_completed(spark, sf_dir):
    x = mutations(spark, sf_dir)
    rows = W.paired(x.where("event_id % 13 <> 0").select("request_id", "issued_at"), x.where("event_id % 17 <> 0").select("request_id", "completed_at"))
    return rows.groupBy("pairing").agg(F.count("*").alias("n"))


@query("""select case when event_id % 19 = 0 then 'none' when completed_at > deadline then 'late' else 'in_time' end as delivery, count(*) as n, count(*) filter (event_id % 23 = 0 and event_id % 19 <> 0) as dropped from m group by all""")
def reply_delivery(spark, sf_dir):
    x = mutations(spark, sf_dir)
    replies = x.where("event_id % 19 <> 0").select("request_id", F.col("completed_at").alias("replied_at"))
    again = x.where("event_id % 19 <> 0 and event_id % 23 = 0").select("request_id", (F.col("completed_at") + F.expr("interval 1 second")).alias("replied_at"))
    rows = W.delivered(x.select("request_id", "deadline"), replies.union(again))
    return rows.groupBy("delivery").agg(F.count("*").alias("n"), F.sum("dropped").alias("dropped"))


@query("""select request_id, count(*) as n, min(seen) as started, max(seen) as ended from (select request_id, issued_at as seen from m union all select request_id, completed_at from m union all
  select request_id, completed_at + interval 1 second from m where operation_id = 'createOrder' and outcome = 'Succeeded') group by request_id""")
def traces(spark, sf_dir):
    return W.traces(_trace_rows(spark, sf_dir)).where("chunk = 0").select("request_id", "n", "started", "ended")


@query("""select request_id, row_number() over (partition by request_id order by "at", kind) as rank, kind, "at", "partition", "offset" from (select request_id, 'command' as kind, issued_at as "at", "partition", "offset" from m
  union all select request_id, 'result', completed_at, "partition", "offset" from m union all select request_id, 'event', completed_at + interval 1 second, "partition", "offset" from m where operation_id = 'createOrder' and outcome = 'Succeeded')""")
def trace_records(spark, sf_dir):
    most = 2  # a request here has three records at most: so some are in chunks
    rows = W.traces(_trace_rows(spark, sf_dir), most).select("request_id", "chunk", F.posexplode("records").alias("place", "r"))
    return rows.select("request_id", (F.col("chunk") * most + F.col("place") + 1).alias("rank"), "r.kind", "r.at", "r.partition", "r.offset")


def _trace_rows(spark, sf_dir):
    x = mutations(spark, sf_dir)
    part = lambda rows, kind, at: rows.select("request_id", F.lit(kind).alias("kind"), at.alias("at"), F.lit("t").alias("topic"), "partition", "offset")
    return part(x, "command", F.col("issued_at")).union(part(x, "result", F.col("completed_at"))).union(part(x.where("operation_id = 'createOrder' and outcome = 'Succeeded'"), "event", F.col("completed_at") + F.expr("interval 1 second")))


@query("""select request_id, replay_of, (event_id % 7 <> 0) as found, case when event_id % 7 <> 0 then 201 end as original_status from (select request_id, event_id, request_id || '-o' as replay_of from m)""")
def replay_chain(spark, sf_dir):
    x = mutations(spark, sf_dir)
    replays = x.select("request_id", F.lit(201).alias("status"), F.concat("request_id", F.lit("-o")).alias("replay_of"))
    originals = x.where("event_id % 7 <> 0").select(F.concat("request_id", F.lit("-o")).alias("request_id"), F.lit(201).alias("status"), F.lit("").alias("replay_of"))
    return W.replay_chain(replays.union(originals)).select("request_id", "replay_of", "found", "original_status")


@query("""select event_id as seq, operation_id from m order by event_id desc limit 500""")
def feed_tail(spark, sf_dir):
    return W.feed(mutations(spark, sf_dir).withColumn("seq", F.col("event_id")), ["event_id"]).select("seq", "operation_id")


@query("""select event_id as seq, operation_id from m where event_id > 9000 order by event_id desc limit 500""")
def feed_resume(spark, sf_dir):
    return W.feed(mutations(spark, sf_dir).withColumn("seq", F.col("event_id")), ["event_id"], after=9000).select("seq", "operation_id")


@query("""select application, issued_at as "at", state from (select *, lag(state) over (partition by application order by issued_at, event_id) as before from (
  select *, case when outcome in ('Succeeded', 'Failed') then 'up' else 'down' end as state from m)) where before is null or state <> before""")
def state_changes(spark, sf_dir):
    x = mutations(spark, sf_dir).withColumn("state", F.when(F.col("outcome").isin("Succeeded", "Failed"), "up").otherwise("down")).withColumn("at_id", F.struct("issued_at", "event_id"))
    return W.state_changes(x, "application", "at_id", "state").select("application", F.col("issued_at").alias("at"), "state")


# Latency and availability.

_MS = "date_diff('millisecond', issued_at, completed_at)"


def _timed(spark, sf_dir):
    ms = ((F.unix_micros("completed_at") - F.unix_micros("issued_at")) / 1000).cast("long")
    return mutations(spark, sf_dir).withColumn("ms", ms)


@query(f"""select service, count(*) as n, quantile_disc({_MS}, 0.5) as p50, quantile_disc({_MS}, 0.95) as p95, quantile_disc({_MS}, 0.99) as p99, max({_MS}) as max, sum({_MS})::bigint // count(*) as mean from m group by service""")
def latency_quantiles_nearest(spark, sf_dir):
    q = W.quantiles_nearest(_timed(spark, sf_dir), ["service"], "ms")
    return q.withColumn("mean", F.floor("mean").cast("long"))


@query(f""", s as (select service, {_MS} as ms, row_number() over (partition by service order by {_MS}) - 1 as i, count(*) over (partition by service) as n from m)
select service, max(n) as n, max(ms) filter (i = least(n - 1, n * 50 // 100)) as p50, max(ms) filter (i = least(n - 1, n * 95 // 100)) as p95, max(ms) filter (i = least(n - 1, n * 99 // 100)) as p99, max(ms) as max from s group by service""")
def latency_quantiles_floor(spark, sf_dir):
    return W.quantiles_floor(_timed(spark, sf_dir), ["service"], "ms").drop("mean")


@query(f""", s as (select service, {_MS} as ms from m), q as (select service, quantile_disc(ms, 0.5) as p50, quantile_disc(ms, 0.95) as p95, quantile_disc(ms, 0.99) as p99, max(ms) as max from s group by service)
select max(p50) filter (service = 'payments') - max(p50) filter (service = 'orders') as p50, max(p95) filter (service = 'payments') - max(p95) filter (service = 'orders') as p95,
  max(p99) filter (service = 'payments') - max(p99) filter (service = 'orders') as p99, max(max) filter (service = 'payments') - max(max) filter (service = 'orders') as max from q""")
def latency_added(spark, sf_dir):
    return W.added_latency(W.quantiles_nearest(_timed(spark, sf_dir), ["service"], "ms"), "service", "orders", "payments").drop("mean")


@query(f"""select operation_id, phase, quantile_disc(ms, 0.95) as p95, sum(ms)::bigint as total from (select operation_id, 'started' as phase, {_MS} // 10 as ms from m union all
  select operation_id, 'upstream', {_MS} // 2 from m union all select operation_id, 'total', {_MS} from m) group by all""")
def latency_phases(spark, sf_dir):
    rows = _timed(spark, sf_dir).selectExpr("operation_id", "ms div 10 as started", "ms div 2 as upstream", "ms as total")
    rows = W.phases(rows, ["started", "upstream", "total"])
    return rows.groupBy("operation_id", "phase").agg(F.expr("cast(percentile_disc(0.95) within group (order by ms) as bigint)").alias("p95"), F.sum("ms").alias("total"))


@query("""select service, count(*) as n, round(count(*) / (date_diff('microsecond', min(completed_at), max(completed_at)) / 1e6), 9) as per_second from m group by service""")
def throughput(spark, sf_dir):
    return W.throughput(mutations(spark, sf_dir), ["service"], "completed_at").withColumn("per_second", F.round("per_second", 9))


@query("""select time_bucket(interval 5 seconds, completed_at) as bucket, count(*) filter (outcome = 'Succeeded') as ok, count(*) filter (outcome <> 'Succeeded') as failed from m group by 1""")
def availability_5s(spark, sf_dir):
    return W.availability(mutations(spark, sf_dir), "completed_at", F.col("outcome") == "Succeeded")


@query(""", b as (select time_bucket(interval 5 seconds, completed_at) as bucket, count(*) filter (outcome <> 'Succeeded') as failed from m group by 1)
select min(bucket) as recovered from b where failed = 0 and bucket > timestamp '2024-01-10 00:00:00'""")
def recovered_at(spark, sf_dir):
    buckets = W.availability(mutations(spark, sf_dir), "completed_at", F.col("outcome") == "Succeeded")
    return W.recovered_at(buckets, F.expr("timestamp '2024-01-10 00:00:00'"))


# Invariants and ledgers.


@query(""", claims as (select 'a-' || event_id::varchar as account, event_id, case when fault is null and status = 201 then '201' when fault = 'outcome_unknown' then 'unknown' when fault in ('upstream_unavailable', 'command_stale') then 'not-applied' else 'other' end as verdict from m where operation_id = 'createCharge'),
debits as (select *, case when event_id % 211 = 0 then 2 when event_id % 223 = 0 then 0 when verdict = '201' then 1 when event_id % 227 = 0 then 1 else 0 end as n from claims)
select case when n > 1 then 'double_debit' when verdict = '201' and n <> 1 then 'created_without_debit' when verdict = 'not-applied' and n <> 0 then 'debited_though_refused' end as violation, account as subject, n::bigint as n from debits
  where n > 1 or (verdict = '201' and n <> 1) or (verdict = 'not-applied' and n <> 0)
union all select 'results_per_request', request_id, 2 from m where event_id % 307 = 0""")
def invariants(spark, sf_dir):
    x = mutations(spark, sf_dir)
    charges = x.where("operation_id = 'createCharge'").withColumn("account", F.concat(F.lit("a-"), F.col("event_id").cast("string")))
    claims = charges.withColumn("verdict", W.client_verdict(F.col("status"), F.coalesce("fault", F.lit("")), F.lit(False)))
    n = F.expr("case when event_id % 211 = 0 then 2 when event_id % 223 = 0 then 0 when verdict = '201' then 1 when event_id % 227 = 0 then 1 else 0 end")
    debits = claims.select("account", n.alias("n")).where("n > 0").select("account", F.explode(F.expr("sequence(1, n)"))).groupBy("account").agg(F.count("*").alias("n"))
    results = x.select("request_id").union(x.where("event_id % 307 = 0").select("request_id"))
    return W.violations(claims.select("account", "verdict"), debits, results)


@query("""select verdict, (idempotency_key is not null) as keyed, count(*) as n from (select *, case when fault is null and status = 201 then '201' when fault = 'outcome_unknown' then 'unknown' when fault in ('upstream_unavailable', 'command_stale') then 'not-applied' else 'other' end as verdict from m) group by all""")
def verdict_matrix(spark, sf_dir):
    x = mutations(spark, sf_dir).withColumn("verdict", W.client_verdict(F.col("status"), F.coalesce("fault", F.lit("")), F.lit(False))).withColumn("keyed", F.col("idempotency_key").isNotNull())
    return x.groupBy("verdict", "keyed").agg(F.count("*").alias("n"))


@query(""", w as (select user_id, event_id, operation_id from m where operation_id in ('createOrder', 'replaceOrder', 'deleteOrder')),
b as (select user_id, max(event_id) filter (operation_id = 'createOrder') as born, max(event_id) as last, arg_max(operation_id, event_id) as op from w group by user_id)
select 'o-' || b.user_id::varchar as order_id, count(*) filter (w.event_id >= born) as version, '"o-' || b.user_id::varchar || '-' || (count(*) filter (w.event_id >= born))::varchar || '"' as etag from b join w using (user_id) where born is not null and op <> 'deleteOrder' group by b.user_id""")
def order_ledger(spark, sf_dir):
    x = mutations(spark, sf_dir).where("service = 'orders'")
    writes = x.select(F.concat(F.lit("o-"), F.col("user_id").cast("string")).alias("order_id"), "offset", (F.col("operation_id") == "deleteOrder").alias("deleted"), (F.col("operation_id") == "createOrder").alias("created"), "body")
    return W.order_ledger(writes).select("order_id", "version", "etag")


@query("""select 'a-' || u.user_id::varchar as account, coalesce(n, 0) as debit_count, coalesce(cents, 0)::bigint as debited_cents from (select distinct user_id from events) u left join
  (select user_id, count(*) as n, sum(floor(value)::bigint) as cents from m where operation_id = 'createCharge' and outcome = 'Succeeded' group by user_id) using (user_id)""")
def account_ledger(spark, sf_dir):
    x = exchanges(spark, sf_dir).withColumn("account", F.concat(F.lit("a-"), F.col("user_id").cast("string")))
    charges = x.where("operation_id = 'createCharge' and outcome = 'Succeeded'").select("account", F.floor("value").cast("long").alias("amount_cents"))
    return W.account_ledger(charges, x)


@query("""select array_to_string(list_filter([case when event_id % 5 = 0 then 'customer' end, case when event_id % 7 = 0 then 'items' end, case when event_id % 7 <> 0 and event_id % 3 = 0 then 'item:0' end], lambda p: p is not null), ',') as problems, count(*) as n from m group by 1""")
def order_validation(spark, sf_dir):
    item = F.struct(F.lit("s").alias("sku"), (F.col("event_id") % 3).cast("int").alias("quantity"))
    items = F.when(F.col("event_id") % 7 == 0, F.array().cast("array<struct<sku:string,quantity:int>>")).otherwise(F.array(item))
    problems = W.order_problems(F.when(F.col("event_id") % 5 == 0, " ").otherwise("c"), items)
    return mutations(spark, sf_dir).select(F.array_join(problems, ",").alias("problems")).groupBy("problems").agg(F.count("*").alias("n"))


# Routes, headers, secrets.


def _requests(spark, sf_dir):
    e = exchanges(spark, sf_dir)
    path = F.expr("case event_id % 8 when 0 then '/orders' when 1 then '/orders/search' when 2 then concat('/orders/o%2F', user_id) when 3 then '/orders/' when 4 then '/orders/..' when 5 then '/orders/%zz' when 6 then '/nothing/here/at/all' else concat('/orders/o-', user_id) end")
    return e.withColumns({"path": path, "said": F.col("operation_id")}).drop("operation_id", "template")


_ROUTED = """, q as (select event_id, user_id, method, case event_id % 8 when 0 then '/orders' when 1 then '/orders/search' when 2 then '/orders/{orderId}' when 7 then '/orders/{orderId}' end as template from x),
rt as (select *, case when template = '/orders' then case method when 'POST' then 'createOrder' when 'GET' then 'listOrders' end when template = '/orders/search' then case method when 'POST' then 'searchOrders' end
  when template = '/orders/{orderId}' then case method when 'GET' then 'getOrder' when 'PUT' then 'replaceOrder' when 'DELETE' then 'deleteOrder' end end as operation_id from q) """


@query(_ROUTED + """select event_id, template, operation_id, case when template is null then 'not_found' when operation_id is null then 'method_not_allowed' else 'found' end as route,
  case when event_id % 8 = 2 then 'o/' || user_id::varchar when event_id % 8 = 7 then 'o-' || user_id::varchar end as order_id from rt""")
def route_resolution(spark, sf_dir):
    return W.resolved(_requests(spark, sf_dir), contract()).select("event_id", "template", "operation_id", "route", F.try_element_at("path_params", F.lit("orderId")).alias("order_id"))


@query(_ROUTED + """select event_id, template, operation_id, case when template is null then 'not_found' when operation_id is null then 'method_not_allowed' else 'found' end as route,
  case when event_id % 8 = 2 then 'o/' || user_id::varchar when event_id % 8 = 7 then 'o-' || user_id::varchar end as order_id from rt""")
def route_lookup(spark, sf_dir):
    """The same against a table of templates."""
    return routes.looked_up(_requests(spark, sf_dir), [contract()]).select("event_id", "template", "operation_id", "route", F.try_element_at("path_params", F.lit("orderId")).alias("order_id"))


@query(_ROUTED + """select template, method, case template when '/orders' then 'GET,POST' when '/orders/search' then 'POST' else 'DELETE,GET,PUT' end as allow, count(*) as n from rt where template is not null and operation_id is null group by all""")
def method_not_allowed(spark, sf_dir):
    rows = W.resolved(_requests(spark, sf_dir), contract()).where("route = 'method_not_allowed'")
    return rows.groupBy("template", "method", F.array_join("allow", ",").alias("allow")).agg(F.count("*").alias("n"))


@query("""select case when service = 'payments' then 'unresolved' when event_id % 11 = 0 then 'another_operation' when template = '/orders/{orderId}' and event_id % 13 = 0 then 'other_parameters' end as drift, count(*) as n from m group by 1""")
def spec_drift(spark, sf_dir):
    x = mutations(spark, sf_dir)
    said = F.when(F.col("event_id") % 11 == 0, "somethingElse").otherwise(F.col("operation_id"))
    value = F.when(F.col("event_id") % 13 == 0, "other").otherwise(F.concat(F.lit("o-"), F.col("user_id").cast("string")))
    params = F.when(F.col("template") == "/orders/{orderId}", F.create_map(F.lit("orderId"), value))
    return W.drifted(x.withColumns({"operation_id": said, "path_params": params}), contract()).groupBy("drift").agg(F.count("*").alias("n"))


def _headers(spark, sf_dir):
    x = mutations(spark, sf_dir)
    one = lambda v: F.array(F.lit(v))
    pairs = [F.lit("Content-Type"), one("application/json"), F.lit("Connection"), F.when(F.col("event_id") % 2 == 0, one("keep-alive, X-Drop")).otherwise(one("close")), F.lit("X-Drop"), one("1"), F.lit("Authorization"), one("Bearer x"), F.lit("X-Empty"), F.array().cast("array<string>"), F.lit("Set-Cookie"), one("s=1")]
    return x.withColumn("headers", F.create_map(*pairs))


@query("""select event_id, case when event_id % 2 = 0 then 'content-type,set-cookie' else 'content-type,set-cookie,x-drop' end as request_names, case when event_id % 2 = 0 then 'authorization,content-type,set-cookie' else 'authorization,content-type,set-cookie,x-drop' end as response_names from m""")
def header_filter(spark, sf_dir):
    names = lambda request: F.array_join(F.array_sort(F.map_keys(C.transported("headers", request))), ",")
    return _headers(spark, sf_dir).select("event_id", names(True).alias("request_names"), names(False).alias("response_names"))


@query("select event_id, 'hop_by_hop:host,not_a_token:Bad Name' || case when event_id % 2 = 0 then ',caller_secret:cookie' else '' end as problems from m")
def header_problems(spark, sf_dir):
    one = F.array(F.lit("v"))
    h = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("host"), one, F.lit("Bad Name"), one, F.lit("cookie"), one)).otherwise(F.create_map(F.lit("host"), one, F.lit("Bad Name"), one))
    found = C.header_problems(h)
    order = F.concat(F.filter(found, lambda p: ~p.startswith("caller")), F.filter(found, lambda p: p.startswith("caller")))
    return mutations(spark, sf_dir).select("event_id", F.array_join(order, ",").alias("problems"))


@query("""select event_id, case when event_id % 3 = 0 then 'header authorization,' else '' end || 'header cookie' || case when event_id % 2 = 0 then ',query parameter api_token' else '' end as found,
  case when event_id % 2 = 0 then 'a=1&b=%20' else 'a=1&b=%20' end as raw_query from m""")
def redact_secrets(spark, sf_dir):
    one = F.array(F.lit("v"))
    x = mutations(spark, sf_dir)
    headers = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("authorization"), one, F.lit("cookie"), one)).otherwise(F.create_map(F.lit("cookie"), one))
    raw = F.when(F.col("event_id") % 2 == 0, "a=1&api%5Ftoken=s3&b=%20").otherwise("a=1&b=%20")
    rows = W.redacted(x.withColumns({"headers": headers, "raw_query": raw}), contract())
    return rows.select("event_id", F.array_join("found", ",").alias("found"), "raw_query")


@query("""select "partition", "offset", 1 as n_secrets from m where event_id % 1000 = 7""")
def secret_scan(spark, sf_dir):
    x = mutations(spark, sf_dir)
    value = F.when(F.col("event_id") % 1000 == 7, "token s3cr3t-value inside").otherwise(F.col("body"))
    log = x.select(F.lit("t").alias("topic"), "partition", "offset", F.col("request_id").cast("binary").alias("key"), value.cast("binary").alias("value"), F.array(F.struct(F.lit("h").alias("key"), F.lit("v").cast("binary").alias("value"))).alias("headers"))
    return W.secrets_on_topics(log, ["another-secret", "s3cr3t-value"]).select("partition", "offset", F.size("secrets").alias("n_secrets"))


@query("""select side, path, n from (select 'direct' as side, path, count(*) as n from m where event_id % 31 = 0 group by path union all select 'gateway', path, count(*) from m where event_id % 37 = 0 group by path)""")
def parity_diff(spark, sf_dir):
    x = mutations(spark, sf_dir)
    rows = W.parity(x.where("event_id % 37 <> 0").select("request_id", "path"), x.where("event_id % 31 <> 0").select("request_id", "path"))
    both = rows.groupBy("side", "path").agg(F.count("*").alias("n"))
    return both


ORACLES["parity_diff"] = f"""with {SQL}, a as (select request_id, path from m where event_id % 37 <> 0), b as (select request_id, path from m where event_id % 31 <> 0)
select side, path, count(*) as n from (select 'direct' as side, path from (select * from a except all select * from b) union all select 'gateway', path from (select * from b except all select * from a)) group by all"""


@query("select lower(split_part(regexp_replace(regexp_extract(url, '://([^/?#]+)', 1), ':[0-9]+$', ''), '.', 1)) as label, count(*) as n from pages group by 1")
def host_labels(spark, sf_dir):
    return _table(spark, sf_dir, "pages").groupBy(C.service_of_host(F.regexp_extract("url", "://([^/?#]+)", 1)).alias("label")).agg(F.count("*").alias("n"))


@query("""select page_id, list_extract(list_transform(list_filter(string_split(split_part(split_part(url, '?', 2), '#', 1), '&'), lambda p: split_part(p, '=', 1) = 'page'), lambda p: split_part(p, '=', 2)), 1) as page from pages""")
def query_parameters(spark, sf_dir):
    raw = F.split_part(F.split_part("url", F.lit("?"), F.lit(2)), F.lit("#"), F.lit(1))
    return _table(spark, sf_dir, "pages").select("page_id", F.try_element_at(C.query_values(raw, "page"), F.lit(1)).alias("page"))


# Validity, freshness, routing, signatures.


@query("""select array_to_string(list_filter([case when event_id % 11 = 0 then 'version' end, case when event_id % 13 = 0 then 'request_id' end, case when event_id % 17 = 0 then 'service' end, case when method = 'GET' then 'method' end,
  case when event_id % 19 = 0 then 'path_characters' end, case when event_id % 23 = 0 then 'key_characters' end, case when event_id % 29 = 0 then 'reply_to' end, case when event_id % 31 = 0 then 'times' end], lambda p: p is not null), ',') as problems, count(*) as n from x group by 1""")
def command_validation_errors(spark, sf_dir):
    x = exchanges(spark, sf_dir)
    odd = lambda k, bad, good: F.when(F.col("event_id") % k == 0, bad).otherwise(good)
    c = F.struct(
        odd(11, 2, 1).alias("v"), odd(13, "not-a-ulid", F.col("request_id")).alias("requestId"), odd(17, "Bad_Name", F.col("service")).alias("service"), F.col("operation_id").alias("operationId"), "method", F.col("template").alias("pathTemplate"),
        odd(19, "/a b", F.col("path")).alias("path"), F.lit("").alias("rawQuery"), F.struct("application", "instance").alias("caller"), F.create_map(F.lit("content-type"), F.array(F.lit("a/b"))).alias("headers"),
        odd(23, "kéy", "key").alias("idempotencyKey"), odd(29, "elsewhere", "http.responses.gw-1").alias("replyTo"), F.col("deadline"), F.col("issued_at").alias("issuedAt"), odd(31, F.col("issued_at"), F.col("expires_at")).alias("expiresAt"),
    )
    return x.select(F.array_join(V.command_problems(c), ",").alias("problems")).groupBy("problems").agg(F.count("*").alias("n"))


@query("""select array_to_string(list_filter([case when event_id % 11 = 0 then 'status_range' end, case when event_id % 11 <> 0 and event_id % 13 = 0 then 'fault_unknown' end, case when event_id % 17 = 0 then 'upstream_presence' end], lambda p: p is not null), ',') as problems, count(*) as n from m group by 1""")
def response_validation_errors(spark, sf_dir):
    x = mutations(spark, sf_dir)
    out_of_range, unknown = F.col("event_id") % 11 == 0, F.col("event_id") % 13 == 0
    r = F.struct(F.lit(1).alias("v"), F.col("request_id").alias("requestId"), F.when(out_of_range, 99).otherwise(200).alias("status"), F.when(~out_of_range & unknown, "odd").otherwise("").alias("fault"), F.when(F.col("event_id") % 17 == 0, 201).alias("upstreamStatus"), F.lit("").alias("replayOf"), F.create_map().cast("map<string,array<string>>").alias("headers"))
    return x.select(F.array_join(V.response_problems(r), ",").alias("problems")).groupBy("problems").agg(F.count("*").alias("n"))


@query("""select case when event_id % 41 = 0 then 'lifetime' when issued_at > timestamp '2024-01-15 00:00:30' then 'future' when expires_at < timestamp '2024-01-14 23:59:30' then 'expired' else 'fresh' end as freshness, count(*) as n from m group by 1""")
def freshness(spark, sf_dir):
    expires = F.when(F.col("event_id") % 41 == 0, F.col("issued_at") + F.expr("interval 2 hours")).otherwise(F.col("expires_at"))
    verdict = V.freshness(F.col("issued_at"), expires, F.expr("timestamp '2024-01-15 00:00:00'"))
    return mutations(spark, sf_dir).groupBy(verdict.alias("freshness")).agg(F.count("*").alias("n"))


@query()
def partition_check(spark, sf_dir):
    rows = keyed(mutations(spark, sf_dir)).withColumn("own_partition", partition_of("dedup_key", 12))
    return rows.groupBy("own_partition").agg(F.count("*").alias("n"), F.min("request_id").alias("first"))


# Logs and state.


@query("""select user_id, arg_max(event_type, event_id) as last_type, max(event_id) as "offset" from events group by user_id having arg_max(event_type, event_id) <> 'error'""")
def compacted_state(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("last_type"), F.col("event_id").alias("offset"))
    return R.latest_by_key(e, "user_id", "last_type", "offset")


ORACLES["compacted_state"] = """select user_id, last_type, "offset" from (select user_id, event_type as last_type, event_id as "offset", row_number() over (partition by user_id order by event_id desc) as rn from events) where rn = 1 and last_type <> 'error'"""


@query("""select user_id, event_type as first_type, event_id as "offset" from (select *, row_number() over (partition by user_id order by event_id) as rn from events) where rn = 1""")
def earliest_layout(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("first_type"), F.col("event_id").alias("offset"))
    return R.earliest_by_key(e, "user_id", "first_type", "offset")


def _positions(spark, sf_dir):
    return mutations(spark, sf_dir).select(F.lit("t").alias("topic"), "partition", "offset", F.col("issued_at").alias("timestamp"), "fault")


@query("""select 't' as topic, "partition", coalesce(min("offset") filter (issued_at >= timestamp '2024-01-20 00:00:00'), max("offset") + 1) as "offset" from m group by "partition" """)
def offsets_by_time(spark, sf_dir):
    return R.offsets_at(_positions(spark, sf_dir), F.expr("timestamp '2024-01-20 00:00:00'"))


@query("""select 't' as topic, "partition", coalesce(min("offset") filter (fault = 'outcome_unknown'), max("offset") + 1) as watermark from m group by "partition" """)
def low_watermark(spark, sf_dir):
    return R.low_watermarks(_positions(spark, sf_dir), ~F.col("fault").eqNullSafe(F.lit("outcome_unknown")))


@query("""select 't' as topic, "partition", max("offset") + 1 as end_offset, case when "partition" = 3 then null else 100 end as position, max("offset") + 1 - case when "partition" = 3 then 0 else 100 end as lag from m group by "partition" """)
def consumer_lag(spark, sf_dir):
    read = spark.createDataFrame([("t", p, 100) for p in range(3)], "topic string, partition int, position int")
    return R.consumer_lag(_positions(spark, sf_dir), read)


@query("""select event_id, case when event_id % 13 = 0 then 'unclean_election' when 1 + k % 4 <= 1 then null when least(1 + k % 4, 1 + user_id % 3) < 2 then 'single_replica' when 1 + event_id % 3 < 2 then 'single_acknowledgement' end as problem from x""")
def state_health(spark, sf_dir):
    """Whether state topics could lose what they acknowledged: each event describes one, its brokers, replicas, acknowledgements and elections."""
    x, k = exchanges(spark, sf_dir), F.col("k") % 4 + 1
    replicas = F.least(k, F.col("user_id") % 3 + 1)  # no more than brokers
    return x.select("event_id", V.durability_problem(k, replicas, F.col("event_id") % 3 + 1, F.col("event_id") % 13 == 0).alias("problem"))


@query("""select service, count(distinct "partition") as partitions, count(distinct "partition") = 4 as as_laid_out from m group by service""")
def layout_check(spark, sf_dir):
    rows = mutations(spark, sf_dir).groupBy("service").agg(F.countDistinct("partition").alias("partitions"))
    return rows.withColumn("as_laid_out", F.col("partitions") == 4)


@query("""select event_id, case when event_id % 9 = 0 then 404 when event_id % 8 = 0 then 401 when event_id % 7 = 0 then 405 when event_id % 6 = 0 then 404 when event_id % 5 = 0 then 503 when event_id % 4 = 0 then 400 when event_id % 3 = 0 then 413 when event_id % 11 = 0 then 400 end as refused from x""")
def gateway_refusals(spark, sf_dir):
    i = F.col("event_id")
    route = F.when(i % 7 == 0, "method_not_allowed").when(i % 6 == 0, "not_found").otherwise("found")
    size = F.when(i % 3 == 0, 1 << 21).otherwise(10)
    status = W.refusal(i % 9 != 0, i % 8 != 0, route, i % 5 != 0, i % 4 != 0, size, i % 11 != 0, F.lit(True))
    return exchanges(spark, sf_dir).select("event_id", status.alias("refused"))


@query("""select case when event_id % 5 = 0 then 'upstream_unavailable' when event_id % 7 = 0 then 'outcome_unknown' when event_id % 3 = 0 then 'response_incomplete' when event_id % 11 = 0 then 'response_too_large' end as fault, count(*) as n from m group by 1""")
def upstream_faults(spark, sf_dir):
    i = F.col("event_id")
    fault = W.upstream_fault(i % 5 != 0, F.when(i % 7 != 0, F.lit(200)), i % 3 == 0, F.when(i % 11 == 0, 1 << 21).otherwise(1), F.lit(True))
    return mutations(spark, sf_dir).groupBy(fault.alias("fault")).agg(F.count("*").alias("n"))


@query("select doc_id, sha256(left(text, 16)) as head, strlen(text) > 16384 as cut from documents where text is not null and text = regexp_replace(text, '[^\\x00-\\x7f]', '', 'g')")
def printable_values(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").where("text is not null").where(~F.col("text").rlike("[^\\x00-\\x7f]"))
    shown = C.printable("text")
    return d.select("doc_id", F.sha2(F.substring(shown["text"], 1, 16), 256).alias("head"), shown["cut"].alias("cut"))


@query(f"select doc_id, {HASH('text', 'lang')} as digest from documents where text is not null and lang is not null")
def text_digests(spark, sf_dir):
    return _table(spark, sf_dir, "documents").where("text is not null and lang is not null").select("doc_id", C.hash_fields("text", "lang").alias("digest"))


@query()
def printable_documents(spark, sf_dir):
    """What is shown of every document, whole, in any language; SQL can't express the cut in bytes."""
    shown = C.printable("text")
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2(shown["text"], 256).alias("shown"), shown["cut"].alias("cut"))


@query()
def document_digests(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", C.hash_fields("text", "lang").alias("digest"))


@query("select conv_id, count(*) as turns, string_agg(role, '>' order by turn) as roles from conversations group by conv_id")
def conversation_order(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ">").alias("roles"))


ORACLES["conversation_order"] = "select conv_id, count(*) as turns, string_agg(role, '>' order by turn, role) as roles from conversations group by conv_id"


# Spark's own: windows, cubes, sessions.


@query("select date_trunc('hour', issued_at) as hour, service, count(*) as n from m group by all")
def ext_hourly(spark, sf_dir):
    return mutations(spark, sf_dir).groupBy(F.window("issued_at", "1 hour")["start"].alias("hour"), "service").agg(F.count("*").alias("n"))


@query("select service, operation_id, outcome, count(*) as n from m group by cube (service, operation_id, outcome)")
def ext_outcome_cube(spark, sf_dir):
    return mutations(spark, sf_dir).cube("service", "operation_id", "outcome").agg(F.count("*").alias("n"))


@query(""", s as (select user_id, issued_at, case when date_diff('microsecond', lag(issued_at) over (partition by user_id order by issued_at, event_id), issued_at) <= 6 * 3600 * 1000000::bigint then 0 else 1 end as fresh from m)
select user_id, sum(fresh)::bigint as sessions from s group by user_id""")
def ext_sessions(spark, sf_dir):
    gap = F.unix_micros("issued_at") - F.lag(F.unix_micros("issued_at")).over(_by_user())
    rows = mutations(spark, sf_dir).withColumn("fresh", F.when(gap <= 6 * 3600 * US, 0).otherwise(1))
    return rows.groupBy("user_id").agg(F.sum("fresh").alias("sessions"))


def _by_user():
    from pyspark.sql import Window

    return Window.partitionBy("user_id").orderBy("issued_at", "event_id")
