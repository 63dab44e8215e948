"""From the results on a log to the events they state: verified, derived, at most once, and written; in one batch or as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mutaspark.contract import Contract
from mutaspark.operators import events as E
from mutaspark.operators import records as R
from mutaspark.schema import NAMING, Naming
from mutaspark.sinks.commits import Commits, publish_outputs
from mutaspark.streaming import metrics, stateful


def derivations(log: DataFrame, keys: DataFrame, contract: Contract, partitions: int | None = None, naming: Naming = NAMING) -> DataFrame:
    """Each result of a log with what is derived from it (see `events.derived`), before duplicates are told. keys: see `records.authenticated`. partitions: of the result topic, where its records' places are to be checked."""
    rows = R.with_bodies(R.with_bodies(R.decoded_results(log, keys, naming), "result.command.body", "asked"), "result.response.body", "made")
    c, r = F.col("result.command"), F.col("result.response")
    broken = F.col("asked.problem").isNotNull() | F.col("made.problem").isNotNull()
    verdict = F.when((F.col("verdict") == "ok") & broken, "undecodable").otherwise(F.col("verdict"))
    known = lambda x: F.when(F.col("verdict") == "ok", x)  # noqa: E731  # nothing else is told of what can't be trusted
    columns = {
        "record_key": F.col("key").cast("string"), "verdict": verdict, "service": known(c["service"]), "operation_id": known(c["operationId"]), "method": known(c["method"]), "path_template": known(c["pathTemplate"]),
        "request_id": known(c["requestId"]), "completed_at": F.coalesce(known(F.col("result.completedAt").cast("timestamp")), F.col("timestamp")), "status": r["status"], "fault": r["fault"], "upstream_status": r["upstreamStatus"],
        "request_body": F.col("asked.raw"), "response_body": F.col("made.raw"), "path_params": c["pathParams"], "raw_query": c["rawQuery"], "request_headers": c["headers"], "response_headers": r["headers"], "traceparent": known(c["traceparent"]),
    }
    return E.derived(rows.select("topic", "partition", "offset", *[x.alias(n) for n, x in columns.items()]), contract, partitions)


def derived_once(log: DataFrame, keys: DataFrame, contract: Contract, now: Column, window_s: int, partitions: int | None = None, naming: Naming = NAMING) -> DataFrame:
    """`derivations` of a bounded log, each request's event at most once."""
    return E.at_most_once(derivations(R.committed(log), keys, contract, partitions, naming), now, window_s)


def outputs(rows: DataFrame) -> dict[str, DataFrame]:
    """What derived rows write: events and failures, as records."""
    return {"events": E.cloud_events(rows), "failures": E.failure_pointers(rows)}


def positions(rows: DataFrame) -> DataFrame:
    """How far results were read: for each partition the offset after the last."""
    return rows.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("position"))


def reached(commits: Commits) -> DataFrame | None:
    """Positions that all published batches together have reached."""
    rows = commits.read("positions")
    return None if rows is None else rows.groupBy("topic", "partition").agg(F.max("position").alias("position"))


def run(log: DataFrame, keys: DataFrame, contract: Contract, path: str, checkpoint: str, window_s: int, partitions: int | None = None, now_us: int | None = None, naming: Naming = NAMING):
    """Runs over what there is of a streamed log, and goes on from its checkpoint the next time. Each batch publishes its events, its failures and how far it has read at once, under `path` (see `Commits`); a batch that has to run again is published once. A `metrics.Progress` that listens to the session gets each batch's counts."""
    rows = derivations(R.committed(log), keys, contract, partitions, naming)
    rows = rows.withColumns({"completed_us": F.unix_micros("completed_at"), "details": F.to_json("details")})
    rows = rows.select(*stateful.FIELDS)
    once = metrics.counted(stateful.events_once(rows, window_s, now_us), metrics.derivation_counts())

    def split(batch: DataFrame) -> dict[str, DataFrame]:
        texts = F.coalesce(F.from_json("details", "array<string>"), F.when(F.col("details").isNotNull(), F.array("details")))
        return outputs(batch.withColumns({"details": texts, "completed_at": F.timestamp_micros("completed_us")})) | {"positions": positions(batch)}

    return stateful.run_to_end(once, checkpoint, publish_outputs(path, split))
