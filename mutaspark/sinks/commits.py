"""Several outputs that appear together: batches are written aside, and one manifest publishes all of a batch's outputs at once."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A manifest: the batch, the attempt whose files count, its outputs and what the writer notes beside them.
MANIFEST = "batch long, attempt string, outputs array<string>, facts map<string,string>"
FOLDER = "_commits"


@dataclass(frozen=True)
class Commits:
    """A folder of outputs. Each attempt at a batch writes to a place of its own; readers see only what a manifest names, so a writer that dies between two outputs leaves nothing to see.

    One writer at a time publishes a batch; of two that try, the second finds the manifest there and gives way.
    """

    spark: SparkSession
    path: str

    def _fs(self):
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{FOLDER}")
        return jvm, jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), self.spark._jsc.hadoopConfiguration()), place

    def _manifest(self, batch: int):
        jvm, files, folder = self._fs()
        return jvm.org.apache.hadoop.fs.Path(folder, f"{batch:020d}.json")

    def has(self, batch: int) -> bool:
        return self._fs()[1].util().exists(self._manifest(batch))

    def publish(self, batch: int, outputs: dict[str, Callable[[], DataFrame] | DataFrame], facts: dict[str, str] | Callable[[], dict[str, str]] | None = None, attempt: str | None = None) -> bool:
        """Writes a batch's outputs and publishes them with one rename. A batch that is there already is left as it is: False. facts: may be told after the outputs are written."""
        if self.has(batch):
            return False
        attempt = attempt or uuid.uuid4().hex
        for name, df in outputs.items():
            (df() if callable(df) else df).write.mode("overwrite").parquet(self.place(name, batch, attempt))
        told = facts() if callable(facts) else facts or {}
        text = json.dumps({"batch": batch, "attempt": attempt, "outputs": list(outputs), "facts": {k: str(v) for k, v in told.items()}})
        jvm, files, folder = self._fs()
        files.mkdir(folder, None, True)
        aside = jvm.org.apache.hadoop.fs.Path(folder, f".{attempt}")
        flags = jvm.java.util.EnumSet.of(jvm.org.apache.hadoop.fs.CreateFlag.CREATE, jvm.org.apache.hadoop.fs.CreateFlag.OVERWRITE)
        stream = files.create(aside, flags, self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.CreateOpts, 0))
        try:
            stream.write(text.encode())
        finally:
            stream.close()
        how = self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE  # never over another manifest
        try:
            files.rename(aside, self._manifest(batch), how)
        except Exception:
            if self.has(batch):
                return False
            raise
        return True

    def place(self, name: str, batch: int, attempt: str) -> str:
        return f"{self.path}/{name}/batch={batch}/attempt={attempt}"

    def published(self) -> DataFrame:
        """The manifests, one row a batch."""
        _, files, folder = self._fs()
        if not files.util().exists(folder):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).json(f"{self.path}/{FOLDER}")

    def last(self) -> tuple[int, dict[str, str]] | None:
        """The newest published batch and its facts."""
        r = self.published().agg(F.max_by(F.struct("batch", "facts"), "batch").alias("last")).first().last
        return None if r is None else (r.batch, dict(r.facts or {}))

    def read(self, name: str, after: int | None = None) -> DataFrame | None:
        """An output of all published batches, with `batch`; of those after one, files of others aren't opened. None before anything of that name is published.

        The manifests' attempts are joined with the folders' own, so that unpublished files are pruned with them.
        """
        known = self.published().where(F.array_contains("outputs", name)).select("batch", "attempt")
        if after is not None:
            known = known.where(F.col("batch") > after)
        if known.isEmpty():
            return None
        rows = self.spark.read.option("basePath", f"{self.path}/{name}").option("mergeSchema", "false").parquet(f"{self.path}/{name}")
        rows = rows.withColumns({"batch": F.col("batch").cast("long"), "attempt": F.col("attempt").cast("string")})
        if after is not None:
            rows = rows.where(F.col("batch") > after)
        return rows.join(known, ["batch", "attempt"], "left_semi").drop("attempt")


def publish_outputs(path: str, split: Callable[[DataFrame], dict[str, DataFrame]]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that publishes all outputs of a batch at once (see `Commits`). A batch that runs again after it was published does nothing; one that died before is written anew."""

    def write(batch: DataFrame, number: int) -> None:
        commits = Commits(batch.sparkSession, path)
        if commits.has(number):
            return
        rows = batch.persist()
        try:
            commits.publish(number, split(rows))
        finally:
            rows.unpersist()

    return write


def numbered(commits: Commits, batch: int, records: DataFrame, by: list[str], name: str = "feed") -> bool:
    """Appends records to a feed that numbers them for good: `seq` goes on from the last published batch without a gap, in the order of `by` within the batch. False if that batch is there already.

    Records are range-partitioned by `by`, sorted and set aside with their place; a count a partition, summed up
    to each, gives every partition its first number. No task sees all records, and the numbers follow from what was
    set aside, so a task that runs again gives the same ones. Equal records in `by` are in an order of their own
    that, once published, stays.
    """
    if commits.has(batch):
        return False
    spark, before = commits.spark, commits.last()
    if before and batch <= before[0]:
        raise ValueError(f"batch {batch} comes after {before[0]}")
    start = int(before[1]["last_seq"]) if before else 0
    aside = f"{commits.path}/_aside/{uuid.uuid4().hex}"
    place = F.monotonically_increasing_id()
    ordered = records.repartitionByRange(*by).sortWithinPartitions(*by)
    ordered.select(F.struct(*records.columns).alias("record"), place.alias("place")).write.parquet(aside)
    rows = spark.read.parquet(aside).withColumn("part", F.shiftright("place", 33))
    counts = rows.groupBy("part").agg(F.count("*").alias("n"))
    first = counts.selectExpr("part", f"{start}L + coalesce(sum(n) over (order by part rows between unbounded preceding and 1 preceding), 0L) as first")
    seq = F.col("first") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    out = rows.join(first, "part").select(seq.alias("seq"), "record.*")
    try:
        return commits.publish(batch, {name: out}, lambda: {"last_seq": start + spark.read.parquet(aside).count()})
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(aside)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def feed_after(commits: Commits, seq: int, most: int = 500, name: str = "feed") -> DataFrame | None:
    """What a reader that has seen everything up to `seq` gets next, in order. Batches whose last number it has seen aren't opened."""
    behind = commits.published().where(F.col("facts")["last_seq"].cast("long") <= seq).agg(F.max("batch")).first()[0]
    rows = commits.read(name, behind)
    return None if rows is None else rows.where(F.col("seq") > seq).orderBy("seq").limit(most)
