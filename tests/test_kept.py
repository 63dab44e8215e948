"""What runs on and is kept: outputs published together, feeds, snapshots, paired streams, the topic source, and plans that stay small."""

import datetime
import glob
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from mutaspark.operators import flows as W
from mutaspark.operators import gateway as G
from mutaspark.operators import records as R
from mutaspark.plans.adapters import SERVICE, contract, mutations
from mutaspark.sinks.commits import Commits, feed_after, numbered, publish_outputs
from mutaspark.sources.state import Snapshots
from mutaspark.sources.topics import Stream, TopicLog
from mutaspark.streaming import deriver, pairing, stateful

SMALL = "/root/testdata/sf0.001"


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


# Outputs.


def test_a_batch_that_dies_between_outputs_shows_none(spark, tmp_path):
    commits = Commits(spark, str(tmp_path / "out"))
    good, bad = spark.range(3), spark.range(1).select(F.raise_error(F.lit("dies here")).alias("id"))
    assert commits.read("a") is None and commits.last() is None and commits.published().count() == 0
    with pytest.raises(Exception, match="dies here"):
        commits.publish(0, {"a": good, "b": bad})
    assert commits.read("a") is None and glob.glob(f"{tmp_path}/out/a/batch=0/*")
    assert commits.publish(0, {"a": good, "b": good}, {"x": 1}) and not commits.publish(0, {"a": spark.range(99), "b": good})
    assert values(commits.read("a"), "id", "batch") == [(0, 0), (1, 0), (2, 0)] and commits.read("b").count() == 3 and commits.read("c") is None
    assert commits.publish(3, {"a": spark.range(10, 11)}, lambda: {"x": 2}) and commits.last() == (3, {"x": "2"})
    assert values(commits.read("a", after=0), "id") == [(10,)] and commits.read("a", after=3) is None


def test_of_two_writers_one_publishes(spark, tmp_path):
    first, second = Commits(spark, str(tmp_path)), Commits(spark, str(tmp_path))
    assert first.publish(0, {"a": lambda: (second.publish(0, {"a": spark.range(5)}), spark.range(2))[1]}) is False
    assert first.read("a").count() == 5


def test_a_stream_publishes_each_batch_once(spark, tmp_path):
    tries = []

    def split(batch):
        tries.append(1)
        out = {"even": batch.where("id % 2 = 0"), "odd": batch.where("id % 2 = 1")}
        return out if len(tries) != 2 else out | {"odd": batch.select(F.raise_error(F.lit("dies here")).cast("long").alias("id"))}

    for k in range(3):
        spark.range(10 * k, 10 * k + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run = lambda: stateful.run_to_end(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), str(tmp_path / "checkpoint"), publish_outputs(str(tmp_path / "out"), split))
        if k == 1:
            with pytest.raises(Exception, match="dies here"):
                run()
        run()
    commits = Commits(spark, str(tmp_path / "out"))
    assert values(commits.read("even"), "id") == [(i,) for i in range(0, 30, 2)] and values(commits.read("odd"), "id") == [(i,) for i in range(1, 30, 2)]


# Feeds and snapshots.


def test_feed_numbers_have_no_gap(spark, tmp_path):
    commits = Commits(spark, str(tmp_path))
    rows = lambda *ids: spark.createDataFrame([(i, f"r{i}") for i in ids], "id long, name string").repartition(3)
    assert numbered(commits, 0, rows(5, 3, 9, 3), ["id"]) and numbered(commits, 1, rows().limit(0), ["id"]) and numbered(commits, 2, rows(*range(100)), ["id"])
    assert not numbered(commits, 2, rows(7), ["id"])
    got = values(commits.read("feed"), "seq", "id")
    assert [s for s, _ in got] == list(range(1, 105)) and [i for _, i in got] == [3, 3, 5, 9, *range(100)]
    assert [r.seq for r in feed_after(commits, 3, 4).collect()] == [4, 5, 6, 7] and feed_after(commits, 104) is None
    with pytest.raises(ValueError, match="batch -1"):
        numbered(commits, -1, rows(1), ["id"])


def test_snapshot_and_tail_are_the_whole_log(spark, tmp_path):
    kept = Snapshots(Commits(spark, str(tmp_path / "c")), Commits(spark, str(tmp_path / "s")))
    assert kept.state() is None and not kept.compact()
    put = lambda k, *rows: kept.changes.publish(k, {"changes": spark.createDataFrame(rows, "key string, value string, offset long")})
    put(0, ("a", "1", 0), ("b", "1", 1), ("c", "1", 2))
    assert kept.compact() and not kept.compact()
    put(1, ("a", None, 3), ("b", "2", 4))
    put(2, ("d", "1", 5), ("b", "3", 6))
    assert values(kept.state(), "key", "value", "offset") == [("b", "3", 6), ("c", "1", 2), ("d", "1", 5)]
    plan = kept.tail()[1]._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*batch[^\]]*> 0", plan)  # the first batch's files aren't opened
    assert kept.compact() and kept.tail()[1] is None
    assert values(kept.state(), "key", "value") == [("b", "3"), ("c", "1"), ("d", "1")]
    put(3, ("a", "9", 7))
    assert values(kept.state(), "key", "value")[0] == ("a", "9")


# Pairing.


def test_streamed_pairs_are_those_of_a_batch(spark, tmp_path):
    t = lambda s: datetime.datetime.fromtimestamp(1_700_000_000 + s)
    commands = [("a", t(0), t(10)), ("b", t(1), t(11)), ("c", t(2), t(12)), ("d", t(20), t(30)), ("e", t(21), t(31))]
    replies = [("a", t(5)), ("a", t(6)), ("b", t(15)), ("x", t(3)), ("d", t(30)), ("e", t(95))]
    batches = [(commands[:3], replies[:1] + replies[3:4]), (commands[3:], replies[1:3] + replies[4:5]), ([("end", t(9000), t(9000))], replies[5:] + [("end", t(9000))])]
    kinds = {"c": "request_id string, issued_at timestamp, deadline timestamp", "r": "request_id string, replied_at timestamp"}
    for sides in batches:
        for (name, kind), rows in zip(kinds.items(), sides, strict=True):
            spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        stream = lambda name: spark.readStream.schema(kinds[name]).parquet(str(tmp_path / name))
        query = stateful.run_to_end(pairing.delivered_stream(stream("c"), stream("r")), str(tmp_path / "checkpoint"), publish_outputs(str(tmp_path / "out"), lambda b: {"out": b}), empty_batches=True)
    got = values(Commits(spark, str(tmp_path / "out")).read("out"), "request_id", "delivery", "dropped")
    # e was answered after its wait was over
    assert got == [("a", "in_time", 1), ("b", "late", 0), ("c", "none", 0), ("d", "in_time", 0), ("e", "none", 0)]
    whole = W.delivered(spark.createDataFrame(commands[:4], kinds["c"]), spark.createDataFrame(replies[:5], kinds["r"]))
    assert values(whole, "request_id", "delivery", "dropped") == got[:4]
    # Only what is still open is held: the last request, with its reply, and their pair.
    assert sum(s["numRowsTotal"] for s in query.lastProgress["stateOperators"]) <= 3


# The topic source.


def test_topics_grow_and_are_read_once(spark, tmp_path):
    spark.dataSource.register(TopicLog)
    root = str(tmp_path / "log")

    def segment(topic, partition, first, committed):
        rows = [(f"k{first + i}".encode(), b"v", first + i, c) for i, c in enumerate(committed)]
        df = spark.createDataFrame(rows, "key binary, value binary, offset long, committed boolean").withColumns({"timestamp": F.timestamp_seconds("offset"), "headers": F.expr("array(named_struct('key', 'a', 'value', cast('b' as binary)))")})
        df.coalesce(1).write.mode("append").parquet(f"{root}/topic={topic}/partition={partition}")

    def run(**options):
        stream = spark.readStream.format("topic_log").options(path=root, pattern="a.*", **options).load()
        stateful.run_to_end(stream, str(tmp_path / "checkpoint"), publish_outputs(str(tmp_path / "out"), lambda b: {"out": b}))
        rows = Commits(spark, str(tmp_path / "out")).read("out")
        return values(rows, "topic", "partition", "offset") if rows is not None else []

    segment("a1", 0, 0, [True, False, True])
    segment("b", 0, 0, [True])
    have = [("a1", 0, 0), ("a1", 0, 2)]
    assert run() == have and run() == have
    segment("a1", 0, 10, [True, None, True])  # the middle one's transaction is open: nothing from there on; offsets before are no records
    segment("a1", 0, 13, [True])
    segment("a2", 1, 0, [True, True])
    have += [("a1", 0, 10), ("a2", 1, 0), ("a2", 1, 1)]
    assert run() == sorted(have)
    for file in glob.glob(f"{root}/topic=a1/partition=0/*.parquet"):
        t = pq.read_table(file)
        if t["offset"][0].as_py() == 10:
            pq.write_table(t.set_column(t.column_names.index("committed"), "committed", pa.array([True, False, True])), file)
    for _ in range(4):  # a record at a time
        got = run(records=1)
    assert got == sorted([*have, ("a1", 0, 12), ("a1", 0, 13)])
    rows = spark.read.format("topic_log").option("path", root).load()
    assert rows.count() == 8 and rows.first().headers[0].key == "a" and rows.where("offset = 10").first().timestamp.second == 10


def test_one_run_reads_topics_to_their_ends(tmp_path):
    for partition in range(3):
        place = tmp_path / f"topic=a/partition={partition}"
        place.mkdir(parents=True)
        pq.write_table(pa.table({"offset": pa.array([0, 2_000_000 + partition], pa.int64()), "committed": [True, True]}), place / "one.parquet")
    assert Stream({"path": str(tmp_path)}).latestOffset() == {f"a/{p}": 2_000_001 + p for p in range(3)}
    assert Stream({"path": str(tmp_path), "records": "30"}).latestOffset() == {f"a/{p}": 10 for p in range(3)}


# Plans.


def test_composed_operators_have_small_plans(spark, tmp_path):
    """From requests over commands on a log to verified commands and audit rows, one plan: no operator copies what the one before computes."""
    x = mutations(spark, SMALL).where(F.col("service") == SERVICE)
    headers = F.create_map(F.lit("Content-Type"), F.array(F.lit("application/json")))
    requests = x.select("request_id", F.col("issued_at").alias("at"), "method", "path", F.lit("").alias("raw_query"), "application", F.col("instance").alias("caller_instance"), headers.alias("headers"), F.col("body").cast("binary").alias("body"), "idempotency_key")
    made = G.commands_of(requests, contract(), "gw-1")
    log = made.select("key", "value", "topic", F.lit(0).alias("partition"), F.monotonically_increasing_id().alias("offset"), F.current_timestamp().alias("timestamp"), F.expr("array(named_struct('key', 'mut-type', 'value', cast('command.v1' as binary)))").alias("headers"), F.lit(True).alias("committed"))
    keys = R.key_trust([("gateway", "g", b"\1" * 32)], spark)
    for rows in (R.audit_entries(log, keys), R.verified_commands(log, keys, SERVICE, F.current_timestamp()), deriver.derivations(log, keys, contract())):
        plan = rows.where(F.col(rows.columns[-1]).isNotNull())._jdf.queryExecution().optimizedPlan().toString()
        assert len(plan) < 200_000, len(plan)
    assert R.audit_entries(log).where("error is null").count() == made.count() > 0


def test_trusted_keys_go_to_the_records(spark):
    log = mutations(spark, SMALL).select(F.col("request_id").cast("binary").alias("key"), F.col("body").cast("binary").alias("value"), F.lit("t").alias("topic"), "partition", F.expr("array(named_struct('key', 'mut-type', 'value', cast('command.v1' as binary)))").alias("headers"))
    keys = R.key_trust([("gateway", "g", b"\1" * 32), ("bridge", "b", b"\2" * 32)], spark)
    for rows in (R.authenticated(log, keys), G.state_records(log, keys)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
