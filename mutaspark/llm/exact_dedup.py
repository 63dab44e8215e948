"""Exact deduplication as a stateful stream: disk-backed state keyed by digest, without expiry, and full bytes compared on hits."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Scratch, fresh, table, utf8_lower

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: State in RocksDB, whose changes alone are uploaded; a task closes its store when done, so stores take no disk or memory between batches.
STORES = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
#: A row of the stream: the stable identifier, the digest of the normalised text, and where the content lies: its file and its place there.
ROWS = "doc_id long, digest binary, file string, place long"


@contextmanager
def _stores(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in STORES}
    for k, v in STORES.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def located(docs: DataFrame, content: str, file: str, place: str) -> DataFrame:
    """docs with the file of each row and its place in it. Rows that aren't read from Parquet files are written to the folder `content` first."""

    def of(df: DataFrame) -> DataFrame:
        meta = df.metadataColumn("_metadata")
        return df.select("*", meta["file_path"].alias(file), meta["row_index"].alias(place))

    try:
        return of(docs)
    except AnalysisException:
        docs.write.mode("overwrite").parquet(content)
        return of(docs.sparkSession.read.schema(docs.schema).parquet(content))


def norm_digest(text: Column) -> Column:
    return F.unhex(F.sha2(utf8_lower(text), 256))


def digest_state(store: str, spark: SparkSession) -> DataFrame:
    """Streams the rows under `store`/rows that no earlier run has seen into the state at `store`/state; digest, keep_id, keep_file, keep_place, group_size: one row a digest.

    State is keyed by digest and lives in RocksDB on the executors' disks, its changes under `store`; nothing
    expires. A key holds the largest doc_id, where that row's content lies, and the number of rows.
    """
    stream = spark.readStream.schema(f"{ROWS}, run string").parquet(f"{store}/rows")
    state = stream.groupBy("digest").agg(F.max(F.struct("doc_id", "file", "place")).alias("keep"), F.count("*").alias("n"))
    with _stores(spark):
        run = state.writeStream.format("noop").outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{store}/state").start()
        run.awaitTermination()
        read = spark.read.format("statestore").load(f"{store}/state")
        (keep,) = [f.name for f in read.schema["value"].dataType.fields if isinstance(f.dataType, T.StructType)]
        (count,) = [f.name for f in read.schema["value"].dataType.fields if isinstance(f.dataType, T.LongType)]
        kept = F.col("value")[keep]
    return read.select(F.col("key.digest").alias("digest"), kept["doc_id"].alias("keep_id"), kept["file"].alias("keep_file"), kept["place"].alias("keep_place"), F.col("value")[count].alias("group_size"))


def exact_duplicates(docs: DataFrame, scratch: Scratch, store: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256; and stays, whether the row is the one of its group that stays, with file and place, where its content lies.

    docs has doc_id and text. Texts are equal when identical after lower-casing A-Z; null counts as empty, so null
    and empty texts are one group. The row with the largest doc_id stays; null doc_ids are smallest. Rows repeated
    with one doc_id count in group_size and share their answer, but one of them alone stays. An empty table gives
    no rows. Other columns are ignored.

    Each text is digested once; digests, identifiers and locators are written, streamed into the state, and looked
    up in it. With a `store`, a folder that outlives the call, later calls with further rows go on from its state,
    and their answers count all rows so far; the files of earlier calls' documents must still be there. On a hit,
    the row's full text is read where its locator says and compared with that of the row that stays. Should texts
    differ under one digest, all of docs' rows of that digest are grouped again by digest and full text.
    """
    spark, own = scratch.spark, store or scratch.path("store")
    run = uuid.uuid4().hex
    content = f"{own}/content/{run}"
    file, place = fresh(docs, "file", "place")
    lying = located(docs, content, file, place)
    rows = lying.select("doc_id", norm_digest(F.col("text")).alias("digest"), F.col(file).alias("file"), F.col(place).alias("place"))
    rows.write.parquet(f"{own}/rows/run={run}")
    rows = spark.read.schema(ROWS).parquet(f"{own}/rows/run={run}")
    if rows.isEmpty():
        return rows.selectExpr("doc_id", "doc_id as keep_id", "1L as group_size", "true as kept", "'' as text_sha256", "true as stays", "file", "place")
    found = rows.join(digest_state(own, spark), "digest", "left").withColumn("stays", F.expr("file = keep_file and place = keep_place"))
    with _stores(spark):
        found = scratch.keep(found, "looked")
    if not (differ := _differing(lying.select(F.col(file).alias("at_file"), F.col(place).alias("at_place"), "text"), found, scratch, bool(store))).isEmpty():
        found = scratch.keep(_apart(lying.select(F.col(file).alias("at_file"), F.col(place).alias("at_place"), "text"), found, differ), "apart")
    scratch.drop("differ", "store/rows", "store/state")
    return found.select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "stays", "file", "place")


def _texts_of(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """wanted (digest, file, place) with the normalised text that lies there."""
    return texts.join(wanted, F.expr("at_file = file and at_place = place")).select("digest", utf8_lower(F.col("text")).alias("norm"))


def _differing(texts: DataFrame, found: DataFrame, scratch: Scratch, earlier_calls: bool) -> DataFrame:
    """Digests under which a text differs from another. Texts of one digest are compared in each task before any of them move on."""
    hits = found.where("group_size > 1")
    every = _texts_of(hits.select("digest", "file", "place"), texts)
    if earlier_calls and (before := _earlier(found, hits)) is not None:
        every = every.union(before)
    ends = every.groupBy("digest").agg(F.min("norm").alias("least"), F.max("norm").alias("most"))
    return scratch.keep(ends.where("least <> most").select("digest"), "differ")


def _earlier(found: DataFrame, hits: DataFrame) -> DataFrame | None:
    """The texts of earlier calls' rows that stay beside the hits."""
    earlier = hits.select("digest", F.col("keep_file").alias("file"), F.col("keep_place").alias("place")).join(found.select("file").distinct(), "file", "left_anti").distinct()
    files = [r.file for r in earlier.select("file").distinct().collect()]  # names of earlier calls' files, which any reading lists
    if not files:
        return None
    before = found.sparkSession.read.schema("text string").parquet(*files)
    meta = before.metadataColumn("_metadata")
    return _texts_of(earlier.select("digest", "file", "place"), before.select(meta["file_path"].alias("at_file"), meta["row_index"].alias("at_place"), "text"))


def _apart(texts: DataFrame, found: DataFrame, differ: DataFrame) -> DataFrame:
    """found, with the rows of the digests in `differ` grouped by digest and full text."""
    doubtful = texts.join(found.join(differ, "digest", "left_semi"), F.expr("at_file = file and at_place = place")).withColumn("norm", utf8_lower(F.col("text")))
    groups = doubtful.groupBy("digest", "norm").agg(F.max(F.struct("doc_id", "file", "place")).alias("keep"), F.count("*").alias("n"))
    fixed = doubtful.drop("keep_id", "group_size", "keep_file", "keep_place", "stays").join(groups, ["digest", "norm"])
    fixed = fixed.selectExpr("digest", "doc_id", "file", "place", "keep.doc_id as keep_id", "keep.file as keep_file", "keep.place as keep_place", "n as group_size").withColumn("stays", F.expr("file = keep_file and place = keep_place"))
    return found.join(differ, "digest", "left_anti").select(*fixed.columns).union(fixed)


def without_copies(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of docs, with all their columns, that stay: one of each group of equal texts, also where whole rows repeat."""
    file, place, at_file, at_place = fresh(docs, "file", "place", "at_file", "at_place")
    lying = located(docs, scratch.path("content"), file, place)
    source = docs.sparkSession.read.schema(docs.schema).parquet(scratch.path("content")) if scratch.has("content") else docs
    stays = exact_duplicates(source, scratch).where("stays").select(F.col("file").alias(at_file), F.col("place").alias(at_place))
    return lying.join(stays, (F.col(file) == F.col(at_file)) & (F.col(place) == F.col(at_place)), "left_semi").drop(file, place)


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document, the one that stays of its equals, and the digest of its normalised text."""
    found = exact_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "exact"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP5_SQL = """
with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm from documents)
select doc_id, max(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
  doc_id = max(doc_id) over (partition by norm) as kept, sha256(norm) as text_sha256
from d
"""
