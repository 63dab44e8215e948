"""Present state of a changelog, kept: a snapshot and the changes after it, merged on read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mutaspark.sinks.commits import Commits


@dataclass(frozen=True)
class Snapshots:
    """Snapshots of a changelog that is itself published in batches. changes: the changelog's commits, its output `name` with key, value (null deletes), partition and offset. at: commits of the snapshots, whose fact `upto` is the changelog's last batch that went in.

    Offsets order a key's changes; a key stays in one partition.
    """

    changes: Commits
    at: Commits
    name: str = "changes"

    def tail(self) -> tuple[DataFrame | None, DataFrame | None]:
        """(the last snapshot, the changes after it)."""
        last = self.at.last()
        if last is None:
            return None, self.changes.read(self.name)
        snapshot = self.at.read("snapshot").where(F.col("batch") == last[0]).drop("batch")
        return snapshot, self.changes.read(self.name, int(last[1]["upto"]))

    def state(self) -> DataFrame | None:
        """Each key's last value, from the snapshot and the changes after it; None where nothing was ever published. Partial aggregation, no sort; older changes' files aren't opened."""
        snapshot, changes = self.tail()
        rows = [df.select("key", "value", "offset") for df in (snapshot, changes) if df is not None]
        if not rows:
            return None
        both = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
        last = both.groupBy("key").agg(F.max_by(F.struct("value", "offset"), "offset").alias("last"))
        return last.select("key", "last.value", "last.offset").where(F.col("value").isNotNull())

    def compact(self) -> bool:
        """Publishes a new snapshot of all that is published; False where nothing came since the last."""
        newest, last = self.changes.last(), self.at.last()
        if newest is None or (last and int(last[1]["upto"]) >= newest[0]):
            return False
        return self.at.publish(last[0] + 1 if last else 0, {"snapshot": self.state()}, {"upto": newest[0]})
