"""Queries of what runs on and is kept: streams over a growing log, outputs published together, feeds, snapshots; with their SQL."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mutaspark.operators import machine as M
from mutaspark.operators import records as R
from mutaspark.plans.adapters import DEDUP_KEY_SQL, FINGERPRINT_SQL, contract, mutations
from mutaspark.plans.catalogue import US, _log, _machine_sql, _recorded, query
from mutaspark.plans.wire import _AUTHENTIC_SQL, signed_log
from mutaspark.schema import LOG
from mutaspark.sinks import json_lines
from mutaspark.sinks.commits import Commits, numbered, publish_outputs
from mutaspark.sources import logs
from mutaspark.sources.state import Snapshots
from mutaspark.sources.topics import TopicLog
from mutaspark.streaming import deriver, metrics, pairing, stateful
from mutaspark.streaming.bridge import bridged


def working_folder(spark: SparkSession, what: str) -> str:
    """A new folder under the one that driver and executors share, spark.checkpoint.dir; it goes when the application ends. Only a local session without one gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        base = tempfile.mkdtemp(prefix="mutaspark-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        base = f"file://{base}"
    path = f"{base}/{what}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def parts(rows: DataFrame, by: str, n: int) -> list[Column]:
    """Conditions that cut rows into n runs of a column's range."""
    low, high = rows.agg(F.min(by), F.max(by)).first()
    if low is None:
        return [F.lit(True)] + [F.lit(False)] * (n - 1)
    cuts = [low + (high - low) * k / n for k in range(1, n)]
    ends = [None, *cuts, None]
    return [(F.lit(True) if a is None else F.col(by) >= F.lit(a)) & (F.lit(True) if b is None else F.col(by) < F.lit(b)) for a, b in zip(ends, ends[1:], strict=False)]


# Pairing.


@query("""select request_id, min(told) as replied_at, case when min(told) is null then 'none' when min(told) > any_value(due) then 'late' else 'in_time' end as delivery, greatest(count(told) - 1, 0) as dropped
  from (select request_id, ts + interval 10 seconds as due, unnest(case when event_id % 7 = 0 then [cast(null as timestamp)] when event_id % 11 = 0 then [completed_at, completed_at + interval 2 seconds] else [completed_at] end) as told from m) group by request_id""")
def replies_streamed(spark, sf_dir):
    """Requests and replies as two streams that arrive in two batches, each run a restart: of every seven requests one is never answered, of every eleven one twice; answers of over ten seconds are late."""
    folder = working_folder(spark, "replies")
    x = mutations(spark, sf_dir).select("event_id", "request_id", "issued_at", "deadline", "completed_at")
    replies = F.when(F.col("event_id") % 7 == 0, F.array()).when(F.col("event_id") % 11 == 0, F.array("completed_at", F.col("completed_at") + F.expr("interval 2 seconds"))).otherwise(F.array("completed_at"))
    commands = x.select("request_id", "issued_at", "deadline")
    answers = x.select("request_id", F.explode(replies.cast("array<timestamp>")).alias("replied_at"))
    sides = {"commands": (commands, "issued_at"), "replies": (answers, "replied_at")}
    cuts = parts(commands, "issued_at", 2)
    # What follows a day after the last record: it moves the clock on, and isn't decided itself.
    last = answers.agg((F.max("replied_at") + F.expr("interval 1 day")).alias("at")).where("at is not null")
    after = {"commands": last.select(F.lit("end").alias("request_id"), F.col("at").alias("issued_at"), F.col("at").alias("deadline")), "replies": last.select(F.lit("end").alias("request_id"), F.col("at").alias("replied_at"))}
    for k, cut in enumerate(cuts):
        for name, (rows, at) in sides.items():
            some = rows.withColumnRenamed(at, "issued_at").where(cut).withColumnRenamed("issued_at", at) if at != "issued_at" else rows.where(cut)
            some = some.unionByName(after[name]) if k == len(cuts) - 1 else some
            some.write.mode("append").parquet(f"{folder}/{name}")
        read = lambda name: spark.readStream.schema(sides[name][0].schema).parquet(f"{folder}/{name}")
        stateful.run_to_end(pairing.delivered_stream(read("commands"), read("replies")), f"{folder}/checkpoint", publish_outputs(f"{folder}/out", lambda b: {"deliveries": b}), empty_batches=True)
    return Commits(spark, f"{folder}/out").read("deliveries").select("request_id", "replied_at", "delivery", "dropped")


# Outputs that appear together.


@query(f"""select output, what, count(*) as n from (select case when kind = 'event' then 'events' else 'failures' end as output, reason as what from (
    select case when a <> 'authentic' or event_id % 97 = 0 then 'failure' when operation_id = 'createOrder' and upstream_status = 201 and fault is not null then 'failure' when operation_id = 'createOrder' and status = 201 and fault is null then 'event' else 'none' end as kind,
      case when a <> 'authentic' then 'not_authentic' when event_id % 97 = 0 then 'undecodable_result' when operation_id = 'createOrder' and upstream_status = 201 and fault is not null then 'body_not_relayed' end as reason
    from (select *, {_AUTHENTIC_SQL} as a from m where service = 'orders' and event_id % 101 <> 0)) where kind <> 'none') group by all
  union all select 'positions', "partition"::varchar, max("offset") + 1 from m where service = 'orders' and event_id % 101 <> 0 group by "partition\"""")
def outputs_published(spark, sf_dir):
    """The deriver as a stream over two parts of a signed log, each run a restart. A writer that died before it published has left files behind in the second batch's place; nobody sees them."""
    folder = working_folder(spark, "published")
    log, keys = signed_log(spark, sf_dir)
    log = logs.of_topics(log, r"http\.results\.orders").select(*[f.name if f.name in log.columns else F.lit(True).alias(f.name) for f in LOG.fields])
    keys = spark.createDataFrame(keys.collect(), keys.schema)
    commits = Commits(spark, f"{folder}/out")
    for k in range(2):
        log.where(F.col("offset") % 2 == k).write.mode("append").parquet(f"{folder}/log")
        deriver.run(spark.readStream.schema(LOG).parquet(f"{folder}/log"), keys, contract(), commits.path, f"{folder}/checkpoint", 60 * 86_400, now_us=1_706_659_200_000_000)
        if k == 0:
            commits.read("events").drop("batch").write.parquet(commits.place("events", 1, "died"))
    events = commits.read("events").select(F.lit("events").alias("output"), F.lit(None).cast("string").alias("what"))
    failures = commits.read("failures").select(F.lit("failures").alias("output"), F.col("reason").alias("what"))
    counts = events.union(failures).groupBy("output", "what").agg(F.count("*").alias("n"))
    return counts.union(deriver.reached(commits).select(F.lit("positions"), F.col("partition").cast("string"), F.col("position").cast("long")))


@query(f"""select "offset" % 2 as batch, count(*) filter (kind = 'event') as events, count(*) filter (kind = 'failure') as failures, count(*) filter (kind = 'none') as nothing from (
    select "offset", case when a <> 'authentic' or event_id % 97 = 0 then 'failure' when operation_id = 'createOrder' and upstream_status = 201 and fault is not null then 'failure' when operation_id = 'createOrder' and status = 201 and fault is null then 'event' else 'none' end as kind
    from (select *, {_AUTHENTIC_SQL} as a from m where service = 'orders' and event_id % 101 <> 0)) group by all""")
def derivation_progress(spark, sf_dir):
    """What a listener was told of each batch of the deriver while it ran: no pass over the outputs counts them again."""
    folder = working_folder(spark, "progress")
    log, keys = signed_log(spark, sf_dir)
    log = logs.of_topics(log, r"http\.results\.orders").select(*[f.name if f.name in log.columns else F.lit(True).alias(f.name) for f in LOG.fields])
    keys = spark.createDataFrame(keys.collect(), keys.schema)
    progress = metrics.Progress()
    spark.streams.addListener(progress)
    try:
        for k in range(2):
            log.where(F.col("offset") % 2 == k).write.mode("append").parquet(f"{folder}/log")
            progress.ended.clear()
            deriver.run(spark.readStream.schema(LOG).parquet(f"{folder}/log"), keys, contract(), f"{folder}/out", f"{folder}/checkpoint", 60 * 86_400, now_us=1_706_659_200_000_000)
            progress.ended.wait(60)  # what a listener is told comes after the query's end
    finally:
        spark.streams.removeListener(progress)
    told = progress.table(spark).where("input_rows > 0")
    return told.select("batch", *[F.col("counted")[n].alias(n) for n in ("events", "failures", "nothing")])


@query("""select kind, count(*) as n, sum(n) as written from (select 'requested' as kind, case when event_id % 7 = 0 then 2 else 1 end as n from m where event_id % 101 <> 0
  union all select case when event_id % 97 = 0 then 'unreadable' else 'completed' end, case when event_id % 7 = 0 then 2 else 1 end from m where event_id % 101 <> 0) group by kind""")
def audit_lines(spark, sf_dir):
    """Audit rows as JSON lines, written at least once: a part is written again, as after a writer's restart, and a reader tells rows by their place in the log."""
    folder = f"{working_folder(spark, 'lines')}/audit"
    rows = R.audit_entries(_log(spark, sf_dir))
    json_lines(rows, folder)
    json_lines(rows.where("offset % 7 = 0"), folder)
    read = spark.read.schema("kind string, topic string, partition int, offset long").json(folder)
    once = read.groupBy("topic", "partition", "offset").agg(F.first("kind").alias("kind"), F.count("*").alias("written"))
    return once.groupBy("kind").agg(F.count("*").alias("n"), F.sum("written").alias("written"))


# Feeds and snapshots.


@query("""select row_number() over (order by event_id % 3, event_id) as seq, request_id from m""")
def feed_kept(spark, sf_dir):
    """A feed numbered in three batches, of which each is tried twice: no gap, and no number twice."""
    commits = Commits(spark, f"{working_folder(spark, 'feed')}")
    rows = mutations(spark, sf_dir).select("event_id", "request_id")
    for k in range(3):
        some = rows.where(F.col("event_id") % 3 == k)
        if not numbered(commits, k, some, ["event_id"]) or numbered(commits, k, some, ["event_id"]):
            raise RuntimeError(f"batch {k}")
    return commits.read("feed").select("seq", "request_id")


@query("""select key, arg_max(value, event_id) as value, max(event_id) as "offset" from (select 'o-' || user_id as key, case when event_type = 'error' then 'gone' else event_type || ':' || event_id end as value, event_id from events)
  group by key having arg_max(value, event_id) <> 'gone'""")
def state_kept(spark, sf_dir):
    """A changelog in four batches, its snapshot taken after the second and read with what came later."""
    folder = working_folder(spark, "state")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    value = F.when(F.col("event_type") != "error", F.concat_ws(":", "event_type", F.col("event_id").cast("string")))
    changes = events.select(F.concat(F.lit("o-"), F.col("user_id").cast("string")).alias("key"), value.alias("value"), F.col("event_id").alias("offset"))
    kept = Snapshots(Commits(spark, f"{folder}/changes"), Commits(spark, f"{folder}/snapshots"))
    for k, cut in enumerate(parts(changes, "offset", 4)):
        kept.changes.publish(k, {"changes": changes.where(cut)})
        if k == 1:
            kept.compact()
    return kept.state()


# A memory that starts anew.

#: When the memory starts, and the idempotency window before it, in microseconds.
BEGAN, WINDOW = 1_705_276_800 * US, 5 * 86_400 * US
_CLAIMED_SQL = f"""seeds as (select dedup_key, arg_min(request_id, "offset") as owner, arg_min(fingerprint, "offset") as entry_print, 'OutcomeUnknown' as entry_outcome, 502 as entry_status, 'outcome_unknown' as entry_fault, min(epoch_us(issued_at)) + {WINDOW} as purge
  from (select *, {DEDUP_KEY_SQL} as dedup_key, {FINGERPRINT_SQL} as fingerprint from m where idempotency_key is not null and epoch_us(issued_at) >= {BEGAN - WINDOW} and epoch_us(issued_at) < {BEGAN}) group by dedup_key),
"""


@query(_machine_sql(f"(select * from m where epoch_us(issued_at) >= {BEGAN})", _CLAIMED_SQL))
def machine_from_genesis(spark, sf_dir):
    """The machine as a stream over typed state, in two runs, whose memory starts in the middle of the log: scopes that the window before it used are claimed, their outcome unknown."""
    folder = working_folder(spark, "genesis")
    commands = _recorded(spark, sf_dir, True)
    before, after = commands.where(F.col("now") < BEGAN), commands.where(F.col("now") >= BEGAN)
    starts = M.genesis(before.select("partition", "offset", F.timestamp_micros("now").alias("timestamp")), BEGAN, WINDOW)
    settings, entries = M.started(M.Settings(), starts, BEGAN, WINDOW), M.claims(before, starts, WINDOW)
    commits = Commits(spark, f"{folder}/out")
    for cut in parts(after, "offset", 2):
        after.where(cut).write.mode("append").parquet(f"{folder}/log")
        stream = spark.readStream.schema(after.schema).parquet(f"{folder}/log")
        stateful.run_to_end(bridged(stream, settings, entries, BEGAN), f"{folder}/checkpoint", publish_outputs(commits.path, lambda b: {"decisions": b}))
    return commits.read("decisions").drop("batch")


# The topic source.


@query("""select topic, "partition", count(*) as n, min(event_id) as first, max(event_id) as last from (
  select 'http.requests.' || service as topic, "partition", event_id from m union all select 'http.results.' || service, "partition", event_id from m) where event_id % 101 <> 0 and topic <> 'http.requests.payments' group by all""")
def topics_streamed(spark, sf_dir):
    """The adapted log as topics that grow, read as a stream by pattern: results come as a new topic between two batches, each run a restart; one topic isn't asked for."""
    folder = working_folder(spark, "topics")
    spark.dataSource.register(TopicLog)
    log = _log(spark, sf_dir)
    log = log.select(*[f.name if f.name in log.columns else F.lit(True).alias(f.name) for f in LOG.fields])
    commits = Commits(spark, f"{folder}/out")
    requests = F.col("topic").startswith("http.requests.")
    first, _ = cuts = parts(mutations(spark, sf_dir).select("offset"), "offset", 2)
    for k, cut in enumerate(cuts):
        some = log.where(cut & requests) if k == 0 else log.where(cut | (first & ~requests))  # with the new topics' earlier records
        some.repartition("topic", "partition").sortWithinPartitions("topic", "partition", "offset").write.mode("append").partitionBy("topic", "partition").parquet(f"{folder}/log")
        stream = spark.readStream.format("topic_log").option("path", f"{folder}/log").option("pattern", r"http\.requests\.orders|http\.results\..*").load()
        stateful.run_to_end(stream.select("topic", "partition", "offset"), f"{folder}/checkpoint", publish_outputs(commits.path, lambda b: {"read": b}))
    return commits.read("read").groupBy("topic", "partition").agg(F.count("*").alias("n"), F.min("offset").alias("first"), F.max("offset").alias("last"))
