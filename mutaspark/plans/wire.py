"""Queries of what travels and how: addresses, headers, bodies, refusals, feeds, tokens, state records; with their SQL where it can say the same."""

from __future__ import annotations

import base64
import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mutaspark import schema as S
from mutaspark.contract import load
from mutaspark.functions import codec as K
from mutaspark.functions import columns as C
from mutaspark.functions import validation as V
from mutaspark.operators import events as E
from mutaspark.operators import flows as W
from mutaspark.operators import gateway as G
from mutaspark.operators import machine as M
from mutaspark.operators import records as R
from mutaspark.operators import routes
from mutaspark.plans.adapters import DEDUP_KEY_SQL, SERVICE, contract, exchanges, keyed, mutations, spread
from mutaspark.plans.catalogue import US, _log, _recorded, query
from mutaspark.schema import NAMING
from mutaspark.sinks import topics_needed
from mutaspark.sources import logs
from mutaspark.streaming import deriver

#: Whose keys sign the adapted log.
GATEWAY, BRIDGE = b"gateway of the adapted log".ljust(32), b"bridge of the adapted log".ljust(32)


# Addresses and ids.


@query("select request_id, case when event_id % 4 = 0 then path when event_id % 4 = 1 then path else path || '?a=' || k || '&b' end as url from m")
def request_urls(spark, sf_dir):
    raw = F.when(F.col("event_id") % 4 == 1, "").when(F.col("event_id") % 4 > 1, F.concat(F.lit("a="), F.col("k").cast("string"), F.lit("&b")))
    return mutations(spark, sf_dir).select("request_id", C.request_url("path", raw).alias("url"))


@query("""select event_id, list_sum(list_transform(range(10), lambda i: strpos('0123456789ABCDEFGHJKMNPQRSTVWXYZ', substr(ulid, i::int + 1, 1)) - 1 << (5 * (9 - i::int))))::bigint as millis
  from (select event_id, '01' || substr(replace(replace(replace(upper(md5(event_id::varchar)), 'U', '0'), 'I', '0'), 'L', '0'), 1, 24) as ulid from events)""")
def ulid_times(spark, sf_dir):
    """Ids of all base-32 digits that hexadecimal has; both cases are read."""
    digest = F.upper(F.md5(F.col("event_id").cast("string")))
    ulid = F.concat(F.lit("01"), F.substring(digest, 1, 24))
    mixed = F.when(F.col("event_id") % 2 == 0, ulid).otherwise(F.lower(ulid))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", C.ulid_millis(mixed).alias("millis"))


_DIGITS = lambda x, n: f"list_aggregate(list_transform(range({n}), lambda i: substr('0123456789ABCDEFGHJKMNPQRSTVWXYZ', ((({x}) >> (5 * ({n - 1} - i::int))) & 31)::int + 1, 1)), 'string_agg', '')"


@query(f"""select event_id, {_DIGITS("epoch_us(ts) // 1000", 10)} || {_DIGITS("('0x' || substr(md5(event_id::varchar), 1, 10))::bigint", 8)} || {_DIGITS("('0x' || substr(md5(event_id::varchar), 11, 10))::bigint", 8)} as ulid, true as valid, epoch_us(ts) // 1000 as millis from x""")
def ulids_minted(spark, sf_dir):
    """An id for every event, of its time and 80 bits of its digest, and its time read back."""
    x = exchanges(spark, sf_dir)
    bits = lambda at: F.conv(F.substring(F.md5(F.col("event_id").cast("string").cast("binary")), at, 10), 16, 10)
    made = x.select("event_id", C.ulid(F.unix_millis("ts"), bits(1), bits(11)).alias("ulid"))
    return made.select("event_id", "ulid", C.is_ulid("ulid").alias("valid"), C.ulid_millis("ulid").alias("millis"))


@query("""select topic, service, count(*) as n from (select unnest([('http.requests.' || service, service), ('http.responses.' || instance, instance), ('http.results.' || service, service), (service || '.events', null)]) as x from m) s(x),
  lateral (select x[1] as topic, x[2] as service) group by all""")
def topic_services(spark, sf_dir):
    """Names of topics and back; other topics belong to no service."""
    m = mutations(spark, sf_dir)
    topics = F.array(C.topic_of("command", "service"), C.topic_of("reply", "instance"), C.topic_of("result", "service"), F.concat("service", F.lit(".events")))
    rows = m.select(F.explode(topics).alias("topic"))
    return rows.groupBy("topic", C.service_of_topic("topic").alias("service")).agg(F.count("*").alias("n"))


# Bodies.

_RAW_SQL = """case event_id % 8 when 0 then '' when 1 then '{"k":' || k || '}' when 2 then '{ "k": ' || k || ' }' when 3 then '{"k":"<' || k || '>"}' when 4 then 'k=' || k when 5 then k::varchar when 6 then '[1.0,"é",null]' else '{"k":"a b\t' || k || '"' end"""
_INLINE_SQL = "event_id % 8 in (1, 5, 6)"


def _raw_bodies(spark, sf_dir) -> DataFrame:
    k = F.col("k").cast("string")
    by = [F.lit(""), F.concat(F.lit('{"k":'), k, F.lit("}")), F.concat(F.lit('{ "k": '), k, F.lit(" }")), F.concat(F.lit('{"k":"<'), k, F.lit('>"}')), F.concat(F.lit("k="), k), k, F.lit('[1.0,"é",null]'), F.concat(F.lit('{"k":"a b\t'), k, F.lit('"'))]
    raw = by[-1]
    for i, b in enumerate(by[:-1]):
        raw = F.when(F.col("event_id") % 8 == i, b).otherwise(raw)
    return mutations(spark, sf_dir).select("request_id", "event_id", raw.cast("binary").alias("raw"))


@query(f"""select request_id, case when raw = '' then 'null' when {_INLINE_SQL} then '{{"json":' || raw || '}}' else '{{"base64":"' || to_base64(encode(raw)) || '"}}' end as wire from (select *, {_RAW_SQL} as raw from m)""")
def bodies_on_the_wire(spark, sf_dir):
    return _raw_bodies(spark, sf_dir).select("request_id", K.body_wire("raw").alias("wire"))


@query(f"""select request_id, case when event_id % 13 = 0 then null else sha256(raw) end as sha256,
  case when event_id % 13 <> 0 then null when event_id % 39 = 0 then 'both_set' when event_id % 39 = 13 then 'neither_set' else 'unknown_field:hex' end as problem from (select *, {_RAW_SQL} as raw from m)""")
def bodies_read_back(spark, sf_dir):
    """What was sent, byte for byte; and wrappers that aren't one."""
    odd = F.when(F.col("event_id") % 39 == 0, '{"json":1,"base64":"MQ=="}').when(F.col("event_id") % 39 == 13, "{}").otherwise('{"hex":"31"}')
    rows = _raw_bodies(spark, sf_dir).withColumn("wire", F.when(F.col("event_id") % 13 == 0, odd).otherwise(K.body_wire("raw")))
    rows = R.with_bodies(rows, "wire")
    return rows.select("request_id", F.when(F.col("body.problem").isNull(), F.sha2(F.coalesce("body.raw", F.lit("").cast("binary")), 256)).alias("sha256"), F.col("body.problem").alias("problem"))


# Headers, requests and answers.


def _headers(*entries) -> F.Column:
    """A map of headers from (name, value or null)."""
    pairs = F.array(*[F.struct(F.lit(n).alias("key"), F.when(v.isNotNull(), F.array(v)).alias("value")) for n, v in entries])
    return F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull()))


def _entries(m) -> F.Column:
    """A map of headers as sorted text."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "|")))), ",")


@query(f"select request_id, array_to_string(list_filter([x for x in {list(S.SECRET_HEADERS)} if (x = 'authorization' and event_id % 3 = 0) or (x = 'cookie' and event_id % 5 = 0) or (x = 'x-api-key' and event_id % 7 = 0)], lambda x: x is not null), ',') as secrets from m")
def caller_secret_headers(spark, sf_dir):
    one = lambda n: F.when(F.col("event_id") % n == 0, "s")
    headers = _headers(("x-api-key", one(7)), ("cookie", one(5)), ("authorization", one(3)), ("accept", F.lit("*")))
    return mutations(spark, sf_dir).select("request_id", F.array_join(C.caller_secrets(headers), ",").alias("secrets"))


@query("""select request_id, '{"type":"urn:mutations:' || fault || '","title":"T","status":' || status || case when event_id % 2 = 0 then ',"detail":"d' || k || '"' else '' end || ',"requestId":"' || request_id || '"}' as body from m where fault is not null""")
def problem_documents(spark, sf_dir):
    detail = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("d"), F.col("k").cast("string"))).otherwise("")
    return mutations(spark, sf_dir).where("fault is not null").select("request_id", C.problem_body("fault", F.lit("T"), F.col("status"), detail, F.col("request_id")).alias("body"))


@query("""select request_id, 'content-type=application/json,' || case when event_id % 6 = 0 then 'idempotent-replayed=true,' else '' end || 'x-request-id=' || request_id as headers, status <> 204 as has_body from m""")
def restored_responses(spark, sf_dir):
    """Answers as their callers get them: the service's own claims about the id and replays don't pass."""
    sent = _headers(("content-type", F.lit("application/json")), ("x-request-id", F.lit("theirs")), ("idempotent-replayed", F.when(F.col("event_id") % 4 == 0, "true")))
    replay = F.when(F.col("event_id") % 6 == 0, F.col("request_id"))
    return mutations(spark, sf_dir).select("request_id", _entries(W.restored_headers(sent, F.col("request_id"), replay)).alias("headers"), W.has_body(F.col("status")).alias("has_body"))


_UPSTREAM_SQL = """array_to_string(list_sort(list_filter(['accept=*', case when idempotency_key is not null then 'idempotency-key=' || idempotency_key end, case when event_id % 4 = 0 then 'traceparent=00-' || k end,
  'x-caller-application=' || application, 'x-caller-instance=' || instance, 'x-request-id=' || request_id], lambda x: x is not null)), ',')"""


def _upstream(rows: DataFrame) -> DataFrame:
    sent = _headers(("accept", F.lit("*")), ("cookie", F.lit("c")), ("x-api-token", F.lit("s")), ("x-caller-application", F.lit("forged")))
    trace = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("00-"), F.col("k").cast("string")))
    shape = W.upstream_headers(sent, F.col("application"), F.col("instance"), F.col("request_id"), trace, F.col("idempotency_key"), ["x-api-token"])
    return rows.select("request_id", C.request_url("path", F.lit("")).alias("url"), _entries(shape).alias("headers"))


@query(f"select request_id, path as url, {_UPSTREAM_SQL} as headers from m")
def upstream_requests(spark, sf_dir):
    """Logged requests as the service gets them."""
    return _upstream(mutations(spark, sf_dir))


@query(f"select request_id, path as url, {_UPSTREAM_SQL} as headers from xo where method = 'GET'")
def passthrough_requests(spark, sf_dir):
    """Reads, which go straight to the service in the same shape."""
    return _upstream(exchanges(spark, sf_dir).where(~C.is_mutation("method")))


@query("""select request_id, case when event_id % 5 = 0 then 415 when event_id % 5 = 1 then 413 when event_id % 5 = 2 then 400 when event_id % 5 = 3 then 400 end as refused from m""")
def strict_requests(spark, sf_dir):
    which = F.col("event_id") % 5
    kind = F.when(which == 0, "text/json").otherwise("Application/JSON; charset=utf-8")
    text = F.when(which == 1, F.concat(F.lit('{"a":"'), F.repeat(F.lit("x"), 2000), F.lit('"}'))).when(which == 2, '{"a":1}{}').when(which == 3, '{"a":1,"c":2}').otherwise('{"a":1,"b":null}')
    return mutations(spark, sf_dir).select("request_id", G.strict_json(kind, text, ["a", "b"], 1000).alias("refused"))


@query("""select event_id, case when user_id % 3 = 2 then 415 when strlen(body) > 16 then 413 when not json_valid(body) then 400 when len(list_filter(json_keys(body), lambda k: k <> 'k')) > 0 then 400 end as refused from (
  select event_id, user_id, case event_type when 'purchase' then props || props when 'click' then replace(props, '"k"', '"z"') when 'error' then substr(props, 1, length(props) - 1) else props end as body from events)""")
def uploads_checked(spark, sf_dir):
    """Every event's properties as a request's body: as they are, twice, under another name, or cut; sent under three media types."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.get(F.array(F.lit("application/json"), F.lit("APPLICATION/JSON ; charset=utf-8"), F.lit("text/plain")), F.col("user_id") % 3)
    body = F.expr("""case event_type when 'purchase' then props || props when 'click' then replace(props, '"k"', '"z"') when 'error' then substring(props, 1, length(props) - 1) else props end""")
    return e.select("event_id", G.strict_json(kind, body, ["k"], 16).alias("refused"))


@query("""with i as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, sku, quantity) - 1 as place from (
    select l_orderkey, l_linenumber, l_partkey, case when l_discount < 0.005 then ' ' else 'p-' || l_partkey end as sku, cast(floor(l_quantity) as int) - 3 as quantity from lineitem)),
  p as (select l_orderkey, string_agg('item:' || place, ',' order by place) filter (trim(sku) = '' or quantity < 1) as bad from i group by l_orderkey)
select o_orderkey, concat_ws(',', case when c_name is null or c_acctbal < 0 then 'customer' end, case when p.l_orderkey is null then 'items' end, bad) as problems from orders left join customer on c_custkey = o_custkey left join p on l_orderkey = o_orderkey""")
def orders_validated(spark, sf_dir):
    """Every order with its lines and its customer, as a request: customers in debt are left out, lines without discount have no article, and three of each line's pieces are gone."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sku = F.when(F.col("l_discount") < 0.005, " ").otherwise(F.concat(F.lit("p-"), F.col("l_partkey").cast("string")))
    line = F.struct("l_linenumber", "l_partkey", sku.alias("sku"), (F.floor("l_quantity").cast("int") - 3).alias("quantity"))
    items = read("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))  # an order's lines
    customer = F.when(F.col("c_acctbal") < 0, " ").otherwise(F.col("c_name"))
    rows = read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey"), "left").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    shown = F.transform("lines", lambda x: F.struct(x["sku"].alias("sku"), x["quantity"].alias("quantity")))
    return rows.select("o_orderkey", F.array_join(W.order_problems(customer, shown), ",").alias("problems"))


@query("""select charge, count(*) as n from (select case when event_id % 9 = 0 then case when event_id % 2 = 0 then 'amount,currency' else 'currency' end when event_id % 2 = 0 then 'amount' else '' end as charge from m where service = 'payments') group by charge""")
def charge_checks(spark, sf_dir):
    amount, currency = F.when(F.col("event_id") % 2 == 0, 0).otherwise(F.col("k")), F.when(F.col("event_id") % 9 == 0, "eur").otherwise("EUR")
    amount = F.when(F.col("event_id") % 2 == 1, F.greatest(amount, F.lit(1))).otherwise(amount)
    rows = mutations(spark, sf_dir).where("service = 'payments'")
    return rows.groupBy(F.array_join(W.charge_problems(amount, currency), ",").alias("charge")).agg(F.count("*").alias("n"))


@query("select application, count(*) filter (operation_id = 'createOrder' and outcome = 'Succeeded') as orders from m group by application")
def customer_orders(spark, sf_dir):
    placed = (F.col("operation_id") == "createOrder") & (F.col("outcome") == "Succeeded")
    return mutations(spark, sf_dir).groupBy("application").agg(F.count_if(placed).alias("orders"))


@query("""select o_orderkey, o_orderstatus, row_number() over (order by o_orderkey) as place from orders where o_orderstatus = 'O' order by o_orderkey limit 200""")
def orders_listed(spark, sf_dir):
    """A page of a listing: the first 200 open orders by their id."""
    page = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderstatus = 'O'").select("o_orderkey", "o_orderstatus").orderBy("o_orderkey").limit(200)
    return page.withColumn("place", F.expr("row_number() over (order by o_orderkey)"))


@query("""select request_id, case when event_id % 2 = 0 then 'accept:*|content-type:a|content-type:b|x-request-id:' || request_id else 'accept:*|x-request-id:' || request_id end as headers from m""")
def headers_listed(spark, sf_dir):
    return mutations(spark, sf_dir).select("request_id", F.array_join(W.listed_headers(_two_types()), "|").alias("headers"))


def _two_types() -> F.Column:
    types = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("a"), F.lit("b")))
    pairs = F.array(F.struct(F.lit("x-request-id").alias("key"), F.array("request_id").alias("value")), F.struct(F.lit("content-type").alias("key"), types.alias("value")), F.struct(F.lit("accept").alias("key"), F.array(F.lit("*")).alias("value")))
    return F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull()))


@query("""select request_id, method || ' ' || path as call, status, (epoch_us(completed_at) - epoch_us(issued_at)) / 1000.0 as duration_ms, idempotency_key is not null as retryable,
  case when status in (200, 201, 204) and fault is null then null else coalesce(fault, 'status ' || status) end as failure from m""")
def exchanges_shown(spark, sf_dir):
    return W.shown_exchanges(mutations(spark, sf_dir)).select("request_id", "call", "status", "duration_ms", "retryable", "failure")


# Logs.


@query("""select kind, count(*) as n, min("offset") as first from (select 'command' as kind, "offset", issued_at as written, service, event_id from m union all select 'result', "offset", completed_at, service, event_id from m)
  where service = 'orders' and event_id % 101 <> 0 and written >= timestamp '2024-01-10 00:00:00' group by kind""")
def log_slice(spark, sf_dir):
    """Committed records of chosen topics from a time on."""
    log = R.committed(logs.of_topics(_log(spark, sf_dir), r"http\.(requests|results)\.orders"))
    late = logs.since(log, F.expr("timestamp '2024-01-10 00:00:00'"))
    kind = F.when(F.col("topic").startswith("http.requests."), "command").otherwise("result")
    return late.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.min("offset").alias("first"))


@query("""select 'http.results.' || service as topic, "partition", max("offset") + 1 as end_offset, count(*) filter ("offset" between 1000 and 1999) as between_n from m group by service, "partition" """)
def drained_topics(spark, sf_dir):
    """Ends of all partitions, aborted records included, and what lies in one stretch of each."""
    log = logs.of_topics(_log(spark, sf_dir), r"http\.results\..*")
    ends = logs.end_offsets(log)
    parts = [logs.between(log, f"http.results.{s}", p, 1000, 2000) for s in ("orders", "payments") for p in range(4)]
    some = parts[0]
    for p in parts[1:]:
        some = some.union(p)
    counts = some.groupBy("topic", "partition").agg(F.count("*").alias("between_n"))
    return ends.join(counts, ["topic", "partition"], "left").fillna(0, ["between_n"])


@query("""select kind, service, count(*) as n, count(distinct request_id) as requests from (
  select 'command' as kind, service, request_id from m union all select case when event_id % 97 = 0 then 'unreadable' else 'result' end, service, case when event_id % 97 <> 0 then request_id end from m) group by all""")
def feed_of_topics(spark, sf_dir):
    items = G.feed_items(_log(spark, sf_dir))
    return items.groupBy("kind", C.service_of_topic("topic").alias("service")).agg(F.count("*").alias("n"), F.countDistinct("request_id").alias("requests"))


@query("""select n as seq, request_id from (select request_id, row_number() over (order by event_id) as n from m) order by n desc limit 500""")
def feed_numbered(spark, sf_dir):
    """A feed that nobody has numbered: its last records, with their places in the whole."""
    return W.feed(mutations(spark, sf_dir), ["event_id"]).select("seq", "request_id")


@query("""select topic, count(*) as n from (select unnest(['http.requests.' || service, 'http.results.' || service]) as topic from m union all select 'orders.events' from m where operation_id = 'createOrder' and outcome = 'Succeeded' union all
  select 'stock.events' from m where operation_id = 'replaceOrder') where topic <> 'stock.events' group by topic""")
def watched_topics(spark, sf_dir):
    """Of all topics with records, those that a watcher follows: the stream's own by pattern, and the event topics that contracts declare."""
    x = mutations(spark, sf_dir)
    events = x.where("operation_id = 'createOrder' and outcome = 'Succeeded'").select(F.lit("orders.events").alias("topic"))
    others = x.where("operation_id = 'replaceOrder'").select(F.lit("stock.events").alias("topic"))
    records = _log(spark, sf_dir).select("topic").union(events).union(others)
    return logs.of_topics(records, logs.stream_topics(G.event_topics([contract()]))).groupBy("topic").agg(F.count("*").alias("n"))


@query(""", s as (select service, count(distinct "partition")::int as n from m group by service) select topic, partitions, cleanup, retention_ms::bigint as retention_ms, 8388608::bigint as max_message_bytes from s,
  lateral (values ('http.requests.' || service, n, 'delete', null), ('http.responses.' || service, 1, 'delete', 3600000), ('http.results.' || service, n, 'delete', null), ('state.' || service, n, 'compact', null)) t(topic, partitions, cleanup, retention_ms)""")
def topic_layout(spark, sf_dir):
    """The topics that the log's services need, by the partitions their commands have."""
    services = mutations(spark, sf_dir).groupBy("service").agg(F.countDistinct("partition").cast("int").alias("partitions"))
    return topics_needed(services, NAMING)


@query(f"""select dedup_key, min(request_id) as first, count(*) as n from (select *, {DEDUP_KEY_SQL} as dedup_key from m where service = 'orders') group by dedup_key""")
def commands_of_requests(spark, sf_dir):
    """Requests as a gateway puts them on the log, read back from there."""
    x = mutations(spark, sf_dir).where(F.col("service") == SERVICE)
    headers = F.create_map(F.lit("Content-Type"), F.array(F.lit("application/json")), F.lit("Authorization"), F.array(F.lit("secret")))
    requests = x.select("request_id", F.col("issued_at").alias("at"), "method", "path", F.lit("").alias("raw_query"), "application", F.col("instance").alias("caller_instance"), headers.alias("headers"), F.col("body").cast("binary").alias("body"), "idempotency_key")
    made = G.commands_of(requests, contract(), "gw-1").select(F.col("key").cast("string").alias("dedup_key"), "value", F.lit(S.COMMAND).alias("record_type"))
    read = R.decoded_by_type(made, {S.COMMAND: "command"})
    good = read.where((F.size(V.command_problems(F.col("command"))) == 0) & ~F.map_contains_key(F.col("command.headers"), "authorization"))
    return good.groupBy("dedup_key").agg(F.min("command.requestId").alias("first"), F.count("*").alias("n"))


@query("""select kind, count(*) as n, count(*) filter (json_valid(body)) as json from (select 'props' as kind, props as body from events union all select 'cut', substr(props, 1, length(props) - 1) from events union all select 'twice', props || props from events
  union all select 'text', text from documents union all select 'page', html from pages union all select 'said', '"' || replace(replace(replace(replace(text, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(9), '\\t') || '"' from conversations) where body is not null group by kind""")
def json_bodies(spark, sf_dir):
    """Which of all bodies that the tables hold are one JSON value and nothing else, whatever they are said to be."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    props = read("events").select("props")
    quoted = F.concat(F.lit('"'), F.replace(F.replace(F.replace(F.replace(F.col("text"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t")), F.lit('"'))
    kinds = {
        "props": props.select(F.col("props").alias("body")), "cut": props.select(F.expr("substring(props, 1, length(props) - 1)").alias("body")), "twice": props.select(F.concat("props", "props").alias("body")),
        "text": read("documents").select(F.col("text").alias("body")), "page": read("pages").select(F.col("html").alias("body")), "said": read("conversations").select(quoted.alias("body")),
    }
    rows = None
    for kind, df in kinds.items():
        own = df.where("body is not null").groupBy(F.lit(kind).alias("kind")).agg(F.count("*").alias("n"), F.count_if(C.is_json("body")).alias("json"))
        rows = own if rows is None else rows.unionByName(own)
    return rows


@query("""select request_id, 'c-' || user_id as key, '{"first":"' || event_type || '"}' as value from (select m.*, event_type from m join events using (event_id)) where operation_id = 'createOrder' and event_id % 5 <> 0""")
def header_mappings(spark, sf_dir):
    """Mappings that read headers, whatever the case of their names: the first value counts; where there is none, there is no event."""
    document = json.dumps({"openapi": "3.0.0", "info": {}, "paths": {"/o": {"post": {"operationId": "createOrder", "responses": {"201": {}}, NAMING.event_extension: {
        "on": 201, "topic": "t", "type": "T", "key": "$.request.headers.X-Customer", "value": {"first": "$.response.headers.x-kind"}}}}}})
    x = mutations(spark, sf_dir).where("operation_id = 'createOrder'")
    sent = F.create_map(F.lit("x-customer"), F.when(F.col("event_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("c-"), F.col("user_id").cast("string")), F.lit("another"))))
    received = F.create_map(F.lit("x-kind"), F.array(F.lit("signup"), F.lit("x")))
    nothing = F.lit(b"")
    rendered = E.renderer(load("orders", document))(F.col("operation_id"), nothing, nothing, F.create_map().cast("map<string,string>"), F.lit(""), sent, received)
    return x.select("request_id", rendered["key"].alias("key"), rendered["value"].alias("value")).where("key is not null")


@query("""select doc_id, sha256(unhex(substr(hex(encode(text)), 1, 400))) as digest, least(strlen(text), 200) as bytes from documents""")
def cut_texts(spark, sf_dir):
    """Every document's first 200 bytes, wherever they fall in a character."""
    cut = C.cut_bytes("text", 200)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.sha2(cut, 256).alias("digest"), F.octet_length(cut).cast("long").alias("bytes"))


# Signed logs.


def signed_log(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The adapted log signed by its writers, whole; of every 31 records one is altered afterwards, one unsigned, one signed by the other role. And the keys to trust."""
    log = _log(spark, sf_dir)
    kind = C.record_header("headers", NAMING.type_header)
    command = kind == S.COMMAND
    domain = F.concat(F.lit(NAMING.sign_domain), F.regexp_replace(kind, "[.]", "/"))
    odd = F.col("offset") % 31
    by_gateway = F.when(odd == 7, ~command).otherwise(command)
    signature = F.when(by_gateway, K.signatures(GATEWAY)(F.when(by_gateway, domain), F.when(by_gateway, F.col("value")))).otherwise(K.signatures(BRIDGE)(F.when(~by_gateway, domain), F.when(~by_gateway, F.col("value"))))
    header = lambda n, v: F.struct(F.lit(n).alias("key"), v.cast("binary").alias("value"))
    own = F.concat(F.col("headers"), F.array(header(NAMING.key_header, F.when(command, "g").otherwise("b"))), F.when(odd != 5, F.array(header(NAMING.signature_header, F.col("made")))).otherwise(F.array().cast("array<struct<key:string,value:binary>>")))
    rows = log.withColumn("made", signature).withColumn("headers", own).drop("made")
    rows = rows.withColumn("value", F.when(odd == 3, F.concat("value", F.lit(" ").cast("binary"))).otherwise(F.col("value")))
    return rows, R.key_trust([("gateway", "g", K.public_key(GATEWAY)), ("bridge", "b", K.public_key(BRIDGE))], spark)


_AUTHENTIC_SQL = """case when event_id % 31 = 5 then 'unsigned' when event_id % 31 in (3, 7) then 'altered' else 'authentic' end"""


@query(f"select {_AUTHENTIC_SQL} as authenticity, kind, count(*) as n from m, (values ('command.v1'), ('result.v1')) t(kind) group by all")
def signed_records(spark, sf_dir):
    """Every signature of a whole log."""
    log, keys = signed_log(spark, sf_dir)
    return R.authenticated(log, keys).groupBy("authenticity", F.col("record_type").alias("kind")).agg(F.count("*").alias("n"))


@query(f"""select verdict, reason, count(*) as n from (select case when a <> 'authentic' then a when issued_at > timestamp '2024-01-15 00:00:30' then 'future' when expires_at < timestamp '2024-01-14 23:59:30' then 'expired' end as reason,
  case when a <> 'authentic' then 'not_authentic' when issued_at > timestamp '2024-01-15 00:00:30' or expires_at < timestamp '2024-01-14 23:59:30' then 'stale' else 'ok' end as verdict
  from (select *, {_AUTHENTIC_SQL} as a from m where service = 'orders')) group by all""")
def verified_commands(spark, sf_dir):
    log, keys = signed_log(spark, sf_dir)
    rows = R.verified_commands(logs.of_topics(log, r"http\.requests\.orders"), keys, SERVICE, F.expr("timestamp '2024-01-15 00:00:00'"))
    return rows.groupBy("verdict", "reason").agg(F.count("*").alias("n"))


@query(f"""select case when a <> 'authentic' then 'not_authentic' when event_id % 97 = 0 then 'undecodable' else 'ok' end as verdict, case when a <> 'authentic' then a when event_id % 97 = 0 then 'decode' end as reason, count(*) as n
  from (select *, {_AUTHENTIC_SQL} as a from m) group by all""")
def verified_results(spark, sf_dir):
    log, keys = signed_log(spark, sf_dir)
    return R.decoded_results(logs.of_topics(log, r"http\.results\..*"), keys).groupBy("verdict", "reason").agg(F.count("*").alias("n"))


@query("""select case when reason is null then 'ok' when reason in ('decode', 'invalid_status_range') then 'undecodable' else 'not_authentic' end as verdict, reason, count(*) as n from (
  select case when event_id % 31 = 5 then 'unsigned' when event_id % 31 in (3, 7) then 'altered' when event_id % 19 = 0 then 'decode' when event_id % 23 = 0 then 'invalid_status_range' when event_id % 17 = 0 then 'record_key' end as reason from m) group by all""")
def verified_responses(spark, sf_dir):
    """Every answer as a signed response; some altered, unsigned, signed by the other role, cut, out of range, or under another request's key."""
    x, e = mutations(spark, sf_dir), F.col("event_id")
    headers = F.create_map(F.lit("content-type"), F.array(F.lit("application/json")))
    answer = F.struct(F.lit(S.VERSION).alias("v"), F.col("request_id").alias("requestId"), F.when(e % 23 == 0, 99).otherwise(F.col("status")).alias("status"), headers.alias("headers"), "fault", F.col("upstream_status").alias("upstreamStatus"))
    value = F.when(e % 19 == 0, "{").otherwise(F.to_json(answer)).cast("binary")
    rows = x.select("event_id", "request_id", "instance", "completed_at", value.alias("value"))
    domain = F.lit(f"{NAMING.sign_domain}{S.RESPONSE.replace('.', '/')}")
    by_gateway = e % 31 == 7
    made = F.when(by_gateway, K.signatures(GATEWAY)(F.when(by_gateway, domain), F.when(by_gateway, F.col("value")))).otherwise(K.signatures(BRIDGE)(F.when(~by_gateway, domain), F.when(~by_gateway, F.col("value"))))
    header = lambda n, v: F.struct(F.lit(n).alias("key"), v.cast("binary").alias("value"))
    own = F.array(header(NAMING.type_header, F.lit(S.RESPONSE)), header(NAMING.key_header, F.lit("b")), header(NAMING.signature_header, F.when(e % 31 != 5, F.col("made"))))
    rows = rows.withColumn("made", made).withColumn("headers", F.filter(own, lambda h: h["value"].isNotNull()))
    log = rows.select(
        F.when(e % 17 == 0, "another").otherwise(F.col("request_id")).cast("binary").alias("key"), F.when(e % 31 == 3, F.concat("value", F.lit(" ").cast("binary"))).otherwise(F.col("value")).alias("value"),
        C.topic_of("reply", "instance").alias("topic"), F.lit(0).alias("partition"), e.alias("offset"), F.col("completed_at").alias("timestamp"), "headers",
    )
    keys = R.key_trust([("gateway", "g", K.public_key(GATEWAY)), ("bridge", "b", K.public_key(BRIDGE))], spark)
    return R.decoded_responses(log, keys).groupBy("verdict", "reason").agg(F.count("*").alias("n"))


@query(f"""select kind, reason, count(*) as n from (select case when a <> 'authentic' or event_id % 97 = 0 then 'failure' when operation_id = 'createOrder' and upstream_status = 201 and fault is not null then 'failure' when operation_id = 'createOrder' and status = 201 and fault is null then 'event' else 'none' end as kind,
  case when a <> 'authentic' then 'not_authentic' when event_id % 97 = 0 then 'undecodable_result' when operation_id = 'createOrder' and upstream_status = 201 and fault is not null then 'body_not_relayed' end as reason
  from (select *, {_AUTHENTIC_SQL} as a from m where service = 'orders' and event_id % 101 <> 0)) group by all""")
def derivation_of_signed_log(spark, sf_dir):
    """The deriver over a whole signed log: verified, derived, at most once."""
    log, keys = signed_log(spark, sf_dir)
    rows = deriver.derived_once(logs.of_topics(log, r"http\.results\.orders"), keys, contract(), F.expr("timestamp '2024-01-31 00:00:00'"), 60 * 86_400)
    return rows.groupBy("kind", "reason").agg(F.count("*").alias("n"))


@query("""select upper(operation_id[1]) || operation_id[2:] || outcome as type, count(*) as n, 0::bigint as broken from m group by all""")
def results_made(spark, sf_dir):
    """Results as a bridge makes them of a command and its answer, each checked by the rules of results."""
    log = _log(spark, sf_dir)
    x = mutations(spark, sf_dir).select(F.col("offset").alias("at"), "status", "fault", F.col("upstream_status").alias("up"), "completed_at")
    commands = R.decoded_by_type(R.typed(log).where(F.col("topic").startswith(NAMING.command_topics)), {S.COMMAND: "command"}).join(x, F.col("offset") == F.col("at"))
    blank = F.create_map().cast("map<string,array<string>>")
    response = F.struct(F.lit(1).alias("v"), F.col("command.requestId").alias("requestId"), "status", blank.alias("headers"), F.lit(None).cast("string").alias("body"), "fault", F.col("up").alias("upstreamStatus"), F.lit(None).cast("string").alias("replayOf"))
    made = R.new_results(commands.withColumn("response", response).select("command", "response", "completed_at"))
    return made.groupBy("result.type").agg(F.count("*").alias("n"), F.count_if(F.col("problem").isNotNull()).alias("broken"))


@query("""select case when event_id % 4 = 0 then 'altered' when event_id % 4 = 1 then 'unsigned' else 'authentic' end as verdict, count(*) as n from events group by 1""")
def state_record_verdicts(spark, sf_dir):
    """A changelog of all events, deletions among them; every fourth record was moved to another partition, every fourth isn't signed."""
    e = spread(spark.read.parquet(f"{sf_dir}/events.parquet"))
    key, value = F.col("user_id").cast("string").cast("binary"), F.when(F.col("event_id") % 3 != 0, F.col("event_type").cast("binary"))
    log = e.select("event_id", key.alias("key"), value.alias("value"), F.lit("state.orders").alias("topic"), (F.col("event_id") % 4).cast("int").alias("partition"))
    framed = G.state_frame(F.col("topic"), F.when(F.col("event_id") % 4 == 0, F.col("partition") + 1).otherwise(F.col("partition")), F.col("key"), F.col("value"))
    made = K.signatures(BRIDGE)(F.lit(f"{NAMING.sign_domain}state/v1"), framed)
    header = lambda n, v: F.struct(F.lit(n).alias("key"), v.cast("binary").alias("value"))
    signed = log.withColumn("headers", F.array(header(NAMING.key_header, F.lit("b")), header(NAMING.signature_header, F.when(F.col("event_id") % 4 != 1, made).otherwise(""))))
    return G.state_records(signed, R.key_trust([("bridge", "b", K.public_key(BRIDGE))], spark)).groupBy("verdict").agg(F.count("*").alias("n"))


#: What is changed in every tenth token, and how it is refused.
TOKENS = [None, ("missing", "drop"), ("not_bearer", "scheme"), ("algorithm", {"alg": "none"}), ("unknown_key", {"kid": "x"}), ("signature", "flip"), ("issuer", {"iss": "x"}), ("audience", {"aud": ["x"]}), ("expired", {"exp": -100}), ("no_instance", {"instance": ""})]


@F.pandas_udf(T.StringType())
def _token(event_id: pd.Series, now: pd.Series) -> pd.Series:
    part = lambda x: base64.urlsafe_b64encode(x if isinstance(x, bytes) else json.dumps(x).encode()).decode().rstrip("=")
    out = []
    for i, n in zip(event_id, now, strict=True):
        change = (TOKENS[i % 10] or (None, {}))[1]
        fields = {"alg": "EdDSA", "kid": "k", "iss": "i", "aud": "a", "exp": 300, "iat": 0, "sub": "s", "instance": "s-1"} | (change if isinstance(change, dict) else {})
        head = part({x: fields.pop(x) for x in ("alg", "kid")})
        body = part(fields | {x: int(n) + fields[x] for x in ("exp", "iat")})
        raw = K.sign(GATEWAY, f"{head}.{body}".encode())
        raw = bytes([raw[0] ^ 1]) + raw[1:] if change == "flip" else raw
        out.append(None if change == "drop" else f"{'Basic' if change == 'scheme' else 'Bearer'} {head}.{body}.{part(raw)}")
    return pd.Series(out, dtype=object)


@query("select " + "case event_id % 10 " + " ".join(f"when {i} then '{t[0]}'" for i, t in enumerate(TOKENS) if t) + " end as refused, count(*) as n from m group by 1")
def token_refusals(spark, sf_dir):
    """A signed token for every mutation, nine in ten spoilt in one way each."""
    now = F.unix_seconds("issued_at")
    refused = G.token_refusals({"k": K.public_key(GATEWAY)}, "i", "a")
    return mutations(spark, sf_dir).groupBy(refused(_token("event_id", now), now).alias("refused")).agg(F.count("*").alias("n"))


# State and memory.


@query(f"""select dedup_key, request_id, greatest(epoch_us(expires_at) + 60000000, case when idempotency_key is not null then epoch_us(issued_at) + {10_000 * 86_400 * US} else 0 end) as purge_after
  from (select *, {DEDUP_KEY_SQL} as dedup_key from m) qualify row_number() over (partition by dedup_key order by "offset") = 1""")
def purge_times(spark, sf_dir):
    """Who owns each scope and until when it is remembered, by the machine's own state."""
    return M.remembered(_recorded(spark, sf_dir, False), M.Settings(retention=10_000 * 86_400 * US))


@query("""select "partition", "commit", count(*) as n, min("offset") as first, max("offset") as last from (
  select "partition", "offset", (row_number() over (partition by "partition" order by "offset") - 1) // 256 as "commit" from m) group by all""")
def group_commits(spark, sf_dir):
    rows = W.commit_groups(mutations(spark, sf_dir).select(F.lit("t").alias("topic"), "partition", "offset"))
    return rows.groupBy("partition", "commit").agg(F.count("*").alias("n"), F.min("offset").alias("first"), F.max("offset").alias("last"))


@query("""select request_id, epoch_us(expires_at) + 60000000 as purge_after from m where idempotency_key is null and epoch_us(expires_at) + 60000000 < epoch_us(timestamp '2024-01-20 00:00:00')
  order by purge_after, 'r:' || request_id limit 512""")
def purged_entries(spark, sf_dir):
    """One round of purging what the machine remembers of requests without a key."""
    state = M.remembered(_recorded(spark, sf_dir, False)).where("dedup_key like 'r:%'")
    return W.purgeable(state, F.expr("timestamp '2024-01-20 00:00:00'")).select("request_id", "purge_after")


@query("select count(*) filter (epoch_us(timestamp '2024-01-31 00:00:00') - epoch_us(issued_at) > 90060::bigint * 1000000) as forgotten, count(*) as n, 90060 as window_s from m")
def memory_window(spark, sf_dir):
    window = G.idempotency_window_s()
    age = F.unix_micros(F.expr("timestamp '2024-01-31 00:00:00'")) - F.unix_micros("issued_at")
    return mutations(spark, sf_dir).agg(F.count_if(age > window * US).alias("forgotten"), F.count("*").alias("n"), F.lit(window).alias("window_s"))


#: What a bridge that died left of a command, by the command's id: nothing, a started entry, or its end.
_LEFT = "case event_id % 3 when 1 then 'started' when 2 then 'done' end"
_OWN_OUTCOME = "case when attempt_fault in ('response_too_large', 'response_incomplete') or attempt_fault is null then case when b_status between 200 and 299 then 'Succeeded' else 'Failed' end when attempt_fault = 'outcome_unknown' then 'OutcomeUnknown' else 'NotExecuted' end"


@query(f"""select request_id, case when refused is not null and (entry is null or refused = 'outcome_unknown') then 'refuse' when entry = 'started' and not replayable then 'refuse' else 'execute' end as action,
    case when refused is not null and entry is null then 'NotExecuted' when refused is not null or (entry = 'started' and not replayable) then 'OutcomeUnknown' else {_OWN_OUTCOME} end as outcome
  from (select *, {_LEFT} as entry, method in ('PUT', 'DELETE') as replayable, case when fault in ('outcome_unknown', 'upstream_unavailable', 'response_too_large', 'response_incomplete') then fault end as attempt_fault,
    case when {_LEFT} = 'started' and fault in ('command_stale', 'operation_mismatch') then 'outcome_unknown' when {_LEFT} is null and fault in ('command_stale', 'secret_in_command', 'operation_mismatch') then fault end as refused from m)
  where coalesce(entry <> 'done', true)""")
def crash_outcomes(spark, sf_dir):
    """Every command delivered again to a bridge that comes back: where one had started, it is run again only if it may be; where it had ended, nothing is said twice."""
    x = mutations(spark, sf_dir).select(F.col("request_id").alias("id"), F.expr(_LEFT).alias("left"))
    commands = _recorded(spark, sf_dir, True).withColumn("dedup_key", F.concat(F.lit("r:"), F.col("request_id")))
    entries = commands.join(x, F.col("request_id") == F.col("id")).where("left is not null")
    done = F.col("left") == "done"
    entries = entries.select(
        "dedup_key", "request_id", "fingerprint", F.col("left").alias("phase"), F.when(done, "Succeeded").otherwise("").alias("outcome"), F.when(done, 201).otherwise(0).alias("status"), F.lit("").alias("fault"), F.lit(True).alias("answered"),
        F.when(done, F.col("expires_at")).otherwise(F.lit(0)).alias("purge_after"),
    )
    return M.replayed(commands, entries=entries).select("request_id", "action", "outcome")


@query("""select count(*) filter (action = 'execute') as executed, count(*) filter (action = 'replay') as replayed, count(*) filter (action = 'refuse') as refused, 0::bigint as started, count(*) filter (action <> 'replay') as results from (
  select case when rn = 1 then 'execute' when fingerprint = first_print then 'replay' else 'refuse' end as action from (select *, first_value(fingerprint) over w as first_print, row_number() over w as rn from (
    select *, """ + DEDUP_KEY_SQL + """ as dedup_key, sha256(strlen(method)::varchar || ':' || method || strlen(path)::varchar || ':' || path || '0:' || '16:application/json' || strlen(body)::varchar || ':' || body) as fingerprint from m) window w as (partition by dedup_key order by "offset")))""")
def machine_counters(spark, sf_dir):
    forever = M.Settings(retention=10_000 * 86_400 * US)
    return G.counters(M.replayed(_recorded(spark, sf_dir, False), forever))


@query("""select problem, count(*) as n from (select 'missing' as problem from m where operation_id = 'createOrder' and outcome = 'Succeeded' and event_id % 10 = 3 union all
  select 'spurious' from m where operation_id = 'replaceOrder' and event_id % 20 = 9) group by problem""")
def events_missing_and_spurious(spark, sf_dir):
    x = mutations(spark, sf_dir)
    placed = (F.col("operation_id") == "createOrder") & (F.col("outcome") == "Succeeded")
    events = x.where((placed & (F.col("event_id") % 10 != 3)) | ((F.col("operation_id") == "replaceOrder") & (F.col("event_id") % 20 == 9)))
    return W.missing_and_spurious(x.where(placed).select("request_id"), events.select("request_id")).groupBy("problem").agg(F.count("*").alias("n"))


@query("""select count(*) filter (operation_id = 'createOrder' and status = 201 and fault is null) as events, count(*) filter (operation_id = 'createOrder' and upstream_status = 201 and fault is not null) as failures from m where service = 'orders'""")
def derivation_counts(spark, sf_dir):
    """Counts that a batch gathers while it runs."""
    x = mutations(spark, sf_dir).where("service = 'orders'")
    rows = E.explained(x, E.operations_table(spark, [contract()])).withColumn("kind", F.when(F.col("fires"), "event").when(F.col("reason") == "body_not_relayed", "failure").otherwise("none"))
    watched, watch = G.observed(rows)
    watched.select("kind").write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(watch.get["events"], watch.get["failures"])], "events long, failures long")


# Contracts.

#: Documents by the remainder of a supplier's key: paths, as JSON with the supplier's name in it.
_OPERATION = '"responses": {"200": {"description": "done"}}'
DOCUMENTS = [
    f'"/NAME": {{"post": {{"operationId": "lend", {_OPERATION}}}}}',
    f'"/{{a}}/NAME": {{"post": {{"operationId": "a", {_OPERATION}}}}}, "/{{b}}/NAME": {{"put": {{"operationId": "b", {_OPERATION}}}}}',
    f'"/NAME": {{"put": {{{_OPERATION}}}}}',
    f'"/NAME": {{"get": {{{_OPERATION}}}}}',
    f'"/NAME.{{kind}}": {{"post": {{"operationId": "lend", {_OPERATION}}}}}',
    f'"/NAME": {{"post": {{"operationId": "lend", {_OPERATION}}}}}, "/b": {{"post": {{"operationId": "lend", {_OPERATION}}}}}',
    f'"/NAME": {{"post": {{"operationId": "lend", "{NAMING.extensions}x": 1, {_OPERATION}}}}}',
    f'"/NAME": {{"post": {{"operationId": "lend", "{NAMING.retry_extension}": "yes", {_OPERATION}}}}}',
    f'"/NAME": {{"post": {{"operationId": "lend", "{NAMING.retry_extension}": true, {_OPERATION}}}, "put": {{"operationId": "set", {_OPERATION}}}}}',
]


@query("""select s_suppkey, s_suppkey % 9 in (0, 3, 8) as served, case s_suppkey % 9 when 0 then 1 when 3 then 1 when 8 then 2 else 0 end as operations,
  case when s_suppkey % 9 in (0, 3, 8) then '/supplier-' || s_suppkey end as template from supplier""")
def contracts_served(spark, sf_dir):
    """A document a supplier, each compiled where it lies: what is ambiguous, unnamed or unknown is refused."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    paths = F.get(F.array(*map(F.lit, DOCUMENTS)), F.col("s_suppkey").cast("long") % len(DOCUMENTS))
    text = F.concat(F.lit('{"openapi": "3.0.0", "info": {}, "paths": {'), F.replace(paths, F.lit("NAME"), F.concat(F.lit("supplier-"), F.col("s_suppkey").cast("string"))), F.lit("}}"))
    found = routes.compiled_documents(s.select("s_suppkey", F.lit("library").alias("service"), text.alias("document")))
    return found.select("s_suppkey", "served", F.size("operations").alias("operations"), F.get("operations", F.lit(0))["template"].alias("template"))


@query("""select request_id, '{"exact":' || (9007199254740993 + event_id)::varchar || ',"text":"a\\u003cb","zeros":' || k || '.50}' as value from m""")
def exact_numbers(spark, sf_dir):
    """A mapping's template over numbers that doubles can't hold: their digits stay."""
    document = json.dumps({"openapi": "3.0.0", "info": {}, "paths": {"/o": {"post": {"operationId": "createOrder", "responses": {"201": {}}, NAMING.event_extension: {
        "on": 201, "topic": "t", "type": "T", "key": "$.response.body.id", "value": {"zeros": "$.response.body.zeros", "exact": "$.response.body.id", "text": "a<b"}}}}}})
    x = mutations(spark, sf_dir)
    body = F.format_string('{"id":%d,"zeros":%d.50}', F.col("event_id") + F.lit(9007199254740993), F.col("k")).cast("binary")
    none = F.create_map().cast("map<string,array<string>>")
    rendered = E.renderer(load("orders", document))(F.lit("createOrder"), F.lit(b""), body, F.create_map().cast("map<string,string>"), F.lit(""), none, none)
    return x.select("request_id", rendered["value"].alias("value"))
