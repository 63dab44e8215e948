"""Questions about the whole stream: pairing, latency, availability, invariants, traces, ledgers, routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mutaspark.contract import Contract
from mutaspark.contract.document import PARAMETER, segments_of, specificity
from mutaspark.functions import columns as C

# Pairing.


def paired(requested: DataFrame, completed: DataFrame, on: str = "request_id") -> DataFrame:
    """Every request with its result: `pairing` is completed, in_flight, or orphan for results that nobody asked for. A request with several results has a row for each."""
    left = requested.withColumnsRenamed({c: f"requested_{c}" for c in requested.columns if c != on}).withColumn("was_requested", F.lit(True))
    right = completed.withColumnsRenamed({c: f"completed_{c}" for c in completed.columns if c != on}).withColumn("was_completed", F.lit(True))
    rows = left.join(right, on, "full")
    how = F.when(F.col("was_requested").isNull(), "orphan").when(F.col("was_completed").isNull(), "in_flight").otherwise("completed")
    return rows.withColumn("pairing", how).drop("was_requested", "was_completed")


def delivered(commands: DataFrame, replies: DataFrame) -> DataFrame:
    """Commands (request_id, deadline) with the first of their replies (request_id, replied_at): in_time, late or none, and how many more replies were dropped."""
    first = replies.groupBy("request_id").agg(F.min("replied_at").alias("replied_at"), (F.count("*") - 1).alias("dropped"))
    rows = commands.join(first, "request_id", "left")
    return rows.withColumn("delivery", F.when(F.col("replied_at").isNull(), "none").when(F.col("replied_at") > F.col("deadline"), "late").otherwise("in_time")).fillna({"dropped": 0})


def unclaimed(commands: DataFrame, state: DataFrame, key: str = "dedup_key") -> DataFrame:
    """Commands whose scope no state knows."""
    return commands.join(state.select(key).distinct(), key, "left_anti")


def missing_and_spurious(expected: DataFrame, events: DataFrame, key: str = "request_id") -> DataFrame:
    """Facts without an event (missing) and events without a fact (spurious)."""
    lost = expected.join(events.select(key), key, "left_anti").select(key, F.lit("missing").alias("problem"))
    return lost.union(events.join(expected.select(key), key, "left_anti").select(key, F.lit("spurious").alias("problem")))


def replay_chain(responses: DataFrame) -> DataFrame:
    """Replayed responses with the response they repeat, and whether that exists."""
    first = responses.where(C.empty_if_null("replay_of") == "").select(F.col("request_id").alias("original_id"), F.col("status").alias("original_status"))
    return responses.where(C.empty_if_null("replay_of") != "").join(first, F.col("replay_of") == F.col("original_id"), "left").withColumn("found", F.col("original_id").isNotNull()).drop("original_id")


def verdicts(commands: DataFrame, scope: str = "dedup_key") -> DataFrame:
    """Commands of a scope beside its first: original, replay (same payload) or reused (another). Rows: scope, fingerprint, partition, offset.

    The first is found by partial aggregation and joined back, not by a window over the scope.
    """
    first = commands.groupBy(scope).agg(F.min(F.struct("partition", "offset", "fingerprint")).alias("first"))
    rows = commands.join(first.withColumnRenamed(scope, "first_scope"), F.col(scope) == F.col("first_scope")).drop("first_scope")
    same_place = F.struct("partition", "offset") == F.struct("first.partition", "first.offset")
    return rows.withColumn("verdict", F.when(same_place, "original").when(F.col("fingerprint") == F.col("first.fingerprint"), "replay").otherwise("reused")).drop("first")


# Latency and availability.


def quantiles_nearest(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """p50, p95, p99 by nearest rank, maximum and mean."""
    kind = rows.schema[value].dataType  # a rank picks a value, so it keeps its type
    q = [F.expr(f"percentile_disc({p / 100}) within group (order by {value})").cast(kind).alias(f"p{p}") for p in (50, 95, 99)]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *q, F.max(value).alias("max"), F.avg(value).alias("mean"))


def quantiles_floor(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """p50, p95, p99 by the place floor(n * p). Values are counted first, so what is ranked is as many rows as there are distinct values, and no group is gathered whole."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("c"))
    keys = ", ".join(by) or "1"
    run = counts.selectExpr("*", f"sum(c) over (partition by {keys} order by {value}) as upto", f"sum(c) over (partition by {keys}) as n")
    at = lambda p: F.min(F.expr(f"case when upto > least(n - 1, n * {p} div 100) then {value} end")).alias(f"p{p}")
    return run.groupBy(*by).agg(F.max("n").alias("n"), at(50), at(95), at(99), F.max(value).alias("max"), (F.sum(F.col(value) * F.col("c")) / F.max("n")).alias("mean"))


def added_latency(quantiles: DataFrame, target: str, direct: str, gateway: str) -> DataFrame:
    """The gateway's quantiles less the direct ones."""
    pick = lambda t, c: F.max(F.when(F.col(target) == t, F.col(c)))
    return quantiles.agg(*[(pick(gateway, c) - pick(direct, c)).alias(c) for c in ("p50", "p95", "p99", "max", "mean")])


def phases(timings: DataFrame, names: list[str], by: str = "operation_id") -> DataFrame:
    """A row for each timing and phase: by, phase, ms."""
    pairs = ", ".join(f"'{n}', {n}" for n in names)
    return timings.selectExpr(by, f"stack({len(names)}, {pairs}) as (phase, ms)")


def throughput(rows: DataFrame, by: list[str], at: str) -> DataFrame:
    """Rows a second between the first and the last; null for a single instant."""
    wall = (F.unix_micros(F.max(at)) - F.unix_micros(F.min(at))) / 1e6
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.when(wall > 0, F.count("*") / wall).alias("per_second"))


def availability(rows: DataFrame, at: str, ok: Column, every: str = "5 seconds") -> DataFrame:
    """Good and failed calls in tumbling windows."""
    w = F.window(at, every)
    return rows.groupBy(w).agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed")).select(F.col("window.start").alias("bucket"), "ok", "failed")


def recovered_at(buckets: DataFrame, crash: Column) -> DataFrame:
    """The first bucket after a crash without a failure."""
    return buckets.where((F.col("bucket") > crash) & (F.col("failed") == 0)).agg(F.min("bucket").alias("recovered"))


# Invariants.


def client_verdict(status: Column, problem: Column, transport_error: Column) -> Column:
    """What a client was told."""
    return (
        F.when(transport_error, "transport-error")
        .when(status == 201, "201")
        .when(status == 504, "504")
        .when(problem == "outcome_unknown", "unknown")
        .when(problem.isin("transport_unavailable", "upstream_unavailable", "command_stale"), "not-applied")
        .otherwise("other")
    )


def violations(claims: DataFrame, debits: DataFrame, results: DataFrame) -> DataFrame:
    """What must never be: two debits for one claim, a 201 without a debit, a debit that the client was told didn't happen, two results for one request. claims: account, verdict; debits: account, n; results: request_id."""
    rows = claims.join(debits, "account", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    wrong = F.when(F.col("n") > 1, "double_debit").when((F.col("verdict") == "201") & (F.col("n") != 1), "created_without_debit").when((F.col("verdict") == "not-applied") & (F.col("n") != 0), "debited_though_refused")
    first = rows.withColumn("violation", wrong).where("violation is not null").select("violation", F.col("account").alias("subject"), F.col("n").cast("long").alias("n"))
    again = results.groupBy("request_id").agg(F.count("*").alias("n")).where("n > 1")
    return first.union(again.select(F.lit("results_per_request").alias("violation"), F.col("request_id").alias("subject"), "n"))


# Traces and feeds.


def traces(records: DataFrame, most: int = 1000) -> DataFrame:
    """All records of one request, over topics, in time. Rows: request_id, kind, at, topic, partition, offset.

    A request has a row for each `most` of its records: chunk, from 0, and records, an array; n, started and ended
    are the whole request's. Chunks of a long request are numbered by cells of its time, so no task needs all of it.
    """
    place = F.struct("at", "kind", "topic", "partition", "offset")
    counted = records.groupBy("request_id").agg(F.count("*").alias("n"), F.min("at").alias("started"), F.max("at").alias("ended"))
    rows = records.select(F.col("request_id").alias("of"), place.alias("record")).join(counted, F.expr("of <=> request_id")).drop("of")
    each = ["request_id", "n", "started", "ended"]
    lists = lambda x: x.groupBy(*each, "chunk").agg(F.array_sort(F.collect_list("record")).alias("records"))
    few = rows.where(F.col("n") <= most).withColumn("chunk", F.lit(0).cast("long"))
    since = lambda at: F.unix_micros(at) - F.unix_micros("started")
    cell = F.floor(since(F.col("record.at")) / F.greatest(since(F.col("ended")), F.lit(1)) * F.floor(F.col("n") / most))
    many = rows.where(F.col("n") > most).withColumn("cell", F.coalesce(cell, F.lit(0)))
    cells = many.groupBy(F.col("request_id").alias("of"), F.col("cell").alias("in")).agg(F.count("*").alias("size"))
    cells = cells.withColumn("before", F.expr("coalesce(sum(size) over (partition by of order by `in` rows between unbounded preceding and 1 preceding), 0)"))
    many = many.withColumn("at_cell", F.expr("row_number() over (partition by request_id, cell order by record)")).join(cells, F.expr("request_id <=> of and cell = `in`"))
    many = many.withColumn("chunk", F.floor((F.col("before") + F.col("at_cell") - 1) / most))
    return lists(few).unionByName(lists(many))


def feed(records: DataFrame, by: list[str], after: int | None = None, most: int = 500) -> DataFrame:
    """The last records of a feed by its sequence number, newest first; with `after`, those beyond a reader's place. A feed without `seq` is numbered from 1 in its order: its newest records are picked first, and only they are numbered, down from the count of all."""
    if "seq" in records.columns:
        rows = records if after is None else records.where(F.col("seq") > after)
        return rows.orderBy(F.desc("seq")).limit(most)
    last = records.orderBy(*[F.desc(c) for c in by]).limit(most)
    back = F.expr("row_number() over (order by " + ", ".join(f"{c} desc" for c in by) + ")")
    rows = last.withColumn("seq", records.agg(F.count("*")).scalar() - back + 1)
    return (rows if after is None else rows.where(F.col("seq") > after)).orderBy(F.desc("seq"))


def listed_headers(headers: Column) -> Column:
    """Headers for display: name:value, by name, the values of one name in their order."""
    entries = F.transform(F.map_entries(headers), lambda e: F.transform(e["value"], lambda v, i: F.struct(e["key"].alias("name"), i.alias("place"), v.alias("value"))))
    return F.transform(F.array_sort(F.flatten(entries)), lambda x: F.concat(x["name"], F.lit(":"), x["value"]))


def shown_exchanges(calls: DataFrame) -> DataFrame:
    """Calls as a page shows them: the request's line, status and duration, whether a retry is safe to offer (it has a key), and what went wrong. Rows: method, path, status, fault, idempotency_key, issued_at, completed_at."""
    took = (F.unix_micros("completed_at") - F.unix_micros("issued_at")) / 1000
    failure = F.when((C.empty_if_null("fault") != ""), F.col("fault")).when(~F.col("status").between(200, 299), F.concat(F.lit("status "), F.col("status").cast("string")))
    return calls.withColumns({"call": F.concat_ws(" ", "method", "path"), "duration_ms": took, "retryable": C.empty_if_null("idempotency_key") != "", "failure": failure})


def state_changes(health: DataFrame, component: str = "component", at: str = "at", state: str = "state") -> DataFrame:
    """Only rows in which a component's state differs from the one before."""
    before = F.expr(f"lag({state}) over (partition by {component} order by {at})")
    return health.withColumn("before", before).where(~F.col(state).eqNullSafe(F.col("before"))).drop("before")


# Commits.


def commit_groups(records: DataFrame, most: int = 256) -> DataFrame:
    """Records with the transaction they are written in: `commit`, from 0 in each partition, of up to `most` neighbours in log order. A partition is written in its order by one writer, so its size bounds the work."""
    place = F.expr("row_number() over (partition by topic, partition order by offset)")
    return records.withColumn("commit", F.floor((place - 1) / most))


def purgeable(state: DataFrame, now: Column, most: int = 512, key: str = "dedup_key") -> DataFrame:
    """The entries that one round of purging removes: at most `most` of those that have expired, the longest expired first."""
    return state.where(F.col("purge_after") < F.unix_micros(now)).orderBy("purge_after", key).limit(most)


# Ledgers.


def order_ledger(writes: DataFrame) -> DataFrame:
    """Orders as they are now: the last write of each, with its version (one for each write since it was created) and ETag. Rows: order_id, offset, deleted, created, and what else an order has."""
    last = writes.groupBy("order_id").agg(F.max_by(F.struct(*[c for c in writes.columns if c != "order_id"]), "offset").alias("last"), F.max(F.when(F.col("created"), F.col("offset"))).alias("born"))
    rows = writes.select("order_id", F.col("offset").alias("written")).join(last, "order_id")
    live = rows.groupBy("order_id").agg(F.count_if(F.col("written") >= F.col("born")).alias("version"), F.first("last").alias("last"), F.first("born").alias("born"))
    live = live.where(F.col("born").isNotNull() & ~F.col("last.deleted"))
    etag = F.concat(F.lit('"'), "order_id", F.lit("-"), F.col("version").cast("string"), F.lit('"'))
    return live.select("order_id", "version", etag.alias("etag"), "last.*").drop("deleted", "created", "offset")


def account_ledger(charges: DataFrame, accounts: DataFrame | None = None) -> DataFrame:
    """Debits of each account, count and sum in cents; zeroes for accounts without any."""
    sums = charges.groupBy("account").agg(F.count("*").alias("debit_count"), F.sum("amount_cents").alias("debited_cents"))
    return sums if accounts is None else accounts.select("account").distinct().join(sums, "account", "left").fillna(0, ["debit_count", "debited_cents"])


def order_problems(customer: Column, items: Column) -> Column:
    """What is wrong with an order: a blank customer, no items, or an item without sku or with a quantity below one, by its place."""
    bad = F.filter(F.transform(items, lambda x, i: F.when((F.trim(C.empty_if_null(x["sku"])) == "") | (F.coalesce(x["quantity"], F.lit(0)) < 1), F.concat(F.lit("item:"), i.cast("string")))), lambda p: p.isNotNull())
    head = F.filter(F.array(F.when(F.trim(C.empty_if_null(customer)) == "", "customer"), F.when(F.coalesce(F.size(items), F.lit(0)) < 1, "items")), lambda p: p.isNotNull())
    return F.concat(head, F.coalesce(bad, F.array().cast("array<string>")))


def charge_problems(amount_cents: Column, currency: Column) -> Column:
    return F.filter(F.array(F.when(F.coalesce(amount_cents, F.lit(0)) < 1, "amount"), F.when(~F.coalesce(currency.rlike("^[A-Z]{3}\\z"), F.lit(False)), "currency")), lambda p: p.isNotNull())


# Routes.


def resolved(requests: DataFrame, contract: Contract, method: str = "method", path: str = "path") -> DataFrame:
    """Requests with operation_id, template and path_params; `route` is found, method_not_allowed (with `allow`, sorted) or not_found.

    Templates are compiled to conditions on decoded segments: rows aren't joined with routes. The best template
    for a path, a literal before a parameter from the left, is chosen before its methods are looked at.
    """
    templates = sorted({o.template for o in contract.operations}, key=specificity)

    def routed(x: Column) -> Column:
        """template, path_params, operation_id, allow of a row's method, path and decoded segments."""
        segments = x["segments"]
        usable = segments.isNotNull() & F.forall(segments, lambda s: F.coalesce(~s.isin("", ".", ".."), F.lit(False)))
        chosen = F.lit(None).cast("struct<template:string,path_params:map<string,string>,operation_id:string,allow:array<string>>")
        for t in reversed(templates):
            parts = segments_of(t)
            fits = usable & (F.size(segments) == len(parts))
            names = {}
            for i, p in enumerate(parts):
                here = F.try_element_at(segments, F.lit(i + 1))
                if m := PARAMETER.fullmatch(p):
                    names[m[1]] = here
                else:
                    fits = fits & (here == p)
            own = {o.method: o.id for o in contract.operations if o.template == t}
            by_method = F.try_element_at(F.create_map(*[F.lit(x) for kv in own.items() for x in kv]), x["method"])
            made = F.create_map(*[x for n, v in names.items() for x in (F.lit(n), v)]) if names else F.create_map().cast("map<string,string>")
            chosen = F.when(fits, F.struct(F.lit(t).alias("template"), made.alias("path_params"), by_method.alias("operation_id"), F.array(*[F.lit(m) for m in sorted(own)]).alias("allow"))).otherwise(chosen)
        return chosen

    raw = F.when(F.col(path) == "/", F.array().cast("array<string>")).otherwise(F.split(F.substring(F.col(path), 2, 1 << 30), "/"))
    # A plus is itself in a path.
    segments = F.when(F.col(path).startswith("/"), F.transform(raw, lambda s: F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B")))))
    rows = requests.withColumn("routed", C.bound(F.struct(segments.alias("segments"), F.col(method).alias("method")), routed))
    rows = rows.withColumns({n: F.col(f"routed.{n}") for n in ("template", "path_params", "operation_id", "allow")})
    route = F.when(F.col("routed").isNull(), "not_found").when(F.col("operation_id").isNull(), "method_not_allowed").otherwise("found")
    return rows.withColumn("route", route).withColumn("allow", F.when(F.col("route") == "method_not_allowed", F.col("allow"))).drop("routed")


def drifted(commands: DataFrame, contract: Contract) -> DataFrame:
    """Commands (operation_id, template, path_params, method, path) with `drift`, why this contract makes something else of them, or null. Maps are compared by their sorted entries."""
    said = commands.withColumnsRenamed({"operation_id": "said_id", "template": "said_template", "path_params": "said_params"})
    rows = resolved(said, contract)
    entries = lambda m: F.array_sort(F.map_entries(F.coalesce(F.col(m), F.create_map().cast("map<string,string>"))))
    drift = F.when(F.col("route") != "found", "unresolved").when((F.col("operation_id") != F.col("said_id")) | (F.col("template") != F.col("said_template")), "another_operation").when(entries("path_params") != entries("said_params"), "other_parameters")
    return rows.withColumn("drift", drift)


# Secrets and parity.


def redacted(commands: DataFrame, contract: Contract) -> DataFrame:
    """Commands (headers, raw_query) without the credentials that the contract declares and without cookies; `found` names where they were, sorted, never what they were."""
    headers, query = [*contract.secrets.headers, "cookie"], list(contract.secrets.query)
    in_headers = F.transform(F.filter(F.map_keys("headers"), lambda n: n.isin(*headers)), lambda n: F.concat(F.lit("header "), n))
    parts = F.transform(F.split(C.empty_if_null("raw_query"), "&"), lambda p: F.try_url_decode(F.split_part(p, F.lit("="), F.lit(1))))
    in_query = F.transform(F.filter(parts, lambda k: F.coalesce(k.isin(*query), F.lit(False)) if query else F.lit(False)), lambda k: F.concat(F.lit("query parameter "), k))
    rows = commands.withColumn("found", F.array_sort(F.concat(F.coalesce(in_headers, F.array().cast("array<string>")), in_query)))
    clean = F.size("found") == 0
    kept = F.map_filter("headers", lambda n, _: ~n.isin(*headers))
    less = C.without_parameters("raw_query", query) if query else F.col("raw_query")
    return rows.withColumns({"headers": F.when(clean, F.col("headers")).otherwise(kept), "raw_query": F.when(clean, F.col("raw_query")).otherwise(less)})


def parity(direct: DataFrame, gateway: DataFrame) -> DataFrame:
    """Rows that only one side has, duplicates counted."""
    return direct.exceptAll(gateway).withColumn("side", F.lit("direct")).union(gateway.exceptAll(direct).withColumn("side", F.lit("gateway")))


def secrets_on_topics(log: DataFrame, secrets: list[str]) -> DataFrame:
    """Records of a whole log that hold any of the given secrets, in key, value or headers; which one is told by its place in the list."""
    hay = F.concat_ws("\n", F.col("key").cast("string"), F.col("value").cast("string"), F.array_join(F.transform("headers", lambda h: h["value"].cast("string")), "\n"))
    which = F.filter(F.array(*[F.when(hay.contains(s), F.lit(i)) for i, s in enumerate(secrets)]), lambda x: x.isNotNull())
    return log.select("topic", "partition", "offset", which.alias("secrets")).where(F.size("secrets") > 0)


# Gateway.


def refusal(known_service: Column, authenticated: Column, route: Column, up: Column, key_ok: Column, body_bytes: Column, body_read: Column, valid: Column, most: int = 1 << 20) -> Column:
    """The status with which a gateway refuses a request, in the order in which it looks, or null."""
    return (
        F.when(~known_service, 404).when(~authenticated, 401).when(route == "method_not_allowed", 405).when(route == "not_found", 404).when(~up, 503)
        .when(~key_ok, 400).when(body_bytes > most, 413).when(~body_read, 400).when(~valid, 400)
    )


def upstream_fault(connected: Column, status: Column, cut: Column, body_bytes: Column, relayable: Column, most: int = 1 << 20) -> Column:
    """The fault of a recorded call, or null: before a connection nothing ran; after it, what isn't known is said so."""
    return (
        F.when(~connected, "upstream_unavailable").when(status.isNull(), "outcome_unknown").when(~relayable, "outcome_unknown")
        .when(cut, "response_incomplete").when(body_bytes > most, "response_too_large")
    )


def restored_headers(headers: Column, request_id: Column, replay_of: Column, id_header: str = "x-request-id") -> Column:
    """A response's headers for its caller: with the caller's own request id, and marked if it is a replay."""
    base = F.map_filter(headers, lambda n, _: ~n.isin(id_header, "idempotent-replayed"))
    extra = F.map_from_arrays(F.array(F.lit(id_header)), F.array(F.array(request_id)))
    mark = F.map_from_arrays(F.array(F.lit("idempotent-replayed")), F.array(F.array(F.lit("true"))))
    return F.when(C.empty_if_null(replay_of) != "", F.map_concat(base, extra, mark)).otherwise(F.map_concat(base, extra))


def has_body(status: Column) -> Column:
    return ~status.isin(204, 304)


def upstream_headers(headers: Column, application: Column, instance: Column, request_id: Column, traceparent: Column, idempotency_key: Column, secrets: list[str]) -> Column:
    """What a service gets: the transported headers without secrets; who called, the request id, the trace and the key set from the signed command."""
    own = {"x-caller-application": application, "x-caller-instance": instance, "x-request-id": request_id, "traceparent": traceparent, "idempotency-key": idempotency_key}
    base = F.map_filter(headers, lambda n, _: ~n.isin(*own, *secrets, "cookie"))
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.array(v).alias("value")) for k, v in own.items()]), lambda e: C.empty_if_null(e["value"][0]) != "")
    return F.map_concat(base, F.map_from_entries(entries))
