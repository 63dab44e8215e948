"""What a stream did, batch by batch, told while it runs."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

COUNTS = "batch long, counted map<string,long>, input_rows long, state_rows long, dropped_by_watermark long, watermark string, lag map<string,long>"


def derivation_counts() -> dict[str, Column]:
    """What to observe of derived rows: events, failures and what yields neither."""
    of = lambda kind: F.count_if(F.col("kind") == kind)
    return {"events": of("event"), "failures": of("failure"), "nothing": of("none")}


def counted(stream: DataFrame, counts: dict[str, Column], name: str = "counts") -> DataFrame:
    """The stream, whose rows are counted on their way: no pass of its own, and no shuffle."""
    return stream.observe(name, *[c.alias(n) for n, c in counts.items()])


class Progress(StreamingQueryListener):
    """Gathers each batch's observed counts, its rows, state and watermark, and how far its sources lag behind by topic and partition, as rows of COUNTS. then: called with each, to send it on. Batches without rows count as zeros; the last `keep` batches are kept."""

    def __init__(self, name: str = "counts", then: Callable[[dict], None] | None = None, keep: int = 10_000):
        self.name, self.then, self.keep = name, then, keep
        self.rows: list[dict] = []
        self.lock, self.ended = threading.Lock(), threading.Event()

    def onQueryStarted(self, event) -> None:
        self.ended.clear()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = p.observedMetrics.get(self.name)
        row = {
            "batch": p.batchId, "counted": {k: int(v or 0) for k, v in seen.asDict().items()} if seen is not None else {}, "input_rows": sum(s.numInputRows for s in p.sources),
            "state_rows": sum(o.numRowsTotal for o in p.stateOperators), "dropped_by_watermark": sum(o.numRowsDroppedByWatermark for o in p.stateOperators), "watermark": p.eventTime.get("watermark"), "lag": lag(p.sources),
        }
        with self.lock:
            self.rows = [*self.rows[1 - self.keep :], row] if self.keep > 1 else [row]
        if self.then:
            self.then(row)

    def onQueryTerminated(self, event) -> None:
        self.ended.set()

    def table(self, spark: SparkSession) -> DataFrame:
        """What was gathered, a row a batch."""
        with self.lock:
            rows = [tuple(r[x.split()[0]] for x in COUNTS.split(", ")) for r in self.rows]
        return spark.createDataFrame(rows, COUNTS)


def lag(sources) -> dict[str, int]:
    """Records that sources have beyond where a batch ended, by topic/partition, where a source tells both (Kafka's and the topic source do)."""
    out: dict[str, int] = {}
    for s in sources:
        ends, latest = flat(s.endOffset), flat(s.latestOffset)
        for place, end in ends.items():
            if place in latest:
                out[place] = out.get(place, 0) + max(0, latest[place] - end)
    return out


def flat(offset) -> dict[str, int]:
    """An offset's numbers by topic/partition: of {"topic": {"0": 5}} and {"topic/0": 5} alike; none of others."""
    try:
        read = json.loads(offset) if isinstance(offset, str) else offset
    except ValueError:
        return {}
    out = {}
    for topic, at in read.items() if isinstance(read, dict) else ():
        if isinstance(at, dict):
            out |= {f"{topic}/{p}": n for p, n in at.items() if isinstance(n, int)}
        elif isinstance(at, int) and "/" in topic:
            out[topic] = at
    return out
