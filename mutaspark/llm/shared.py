"""What the operators share: tables in the cluster's shared folder, connected components, distributed ranks."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of two numbers that are worth a file.
FILE_ROWS = 500_000
#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a warehouse that isn't on a machine's own disk. Only a local session without one gets a temporary folder, and keeps it for its other queries."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        folder = tempfile.mkdtemp(prefix="mutaspark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", f"file://{folder}")
        return f"file://{folder}"
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if warehouse.startswith(("file:", "/")):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    return warehouse


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df doesn't have."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


class Scratch:
    """Tables that cut the lineage, in a folder of their own under the shared one.

    A written table survives the loss of an executor, is read by column, and tells the planner its size. What isn't
    dropped before goes when the application ends.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.folder, self.passing = spark, f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}", False

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def keep(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        """Writes df and returns it as read again."""
        df.write.mode("overwrite").option("compression", compression).parquet(self.path(name))
        if not self.passing:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
            self.passing = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def has(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    @contextlib.contextmanager
    def small_batches(self, most: int = 4 << 20):
        """While tables are written inside, tasks hand Python so many bytes at once: for rows that may be large."""
        key = "spark.sql.execution.arrow.maxBytesPerBatch"
        before = self.spark.conf.get(key)
        self.spark.conf.set(key, str(most))
        try:
            yield
        finally:
            self.spark.conf.set(key, before)

    def drop(self, *names: str) -> None:
        """Removes tables that no plan still reads."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], Iterable[dict]], schema: str, rows: int = 256, **how) -> DataFrame:
    """mapInArrow over slices of at most `rows` rows. f takes a slice and yields dicts of equally long columns."""
    kinds = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                for columns in f(batch.slice(start, rows)):
                    yield pa.RecordBatch.from_arrays([pa.array(columns[x.name], x.type) for x in kinds], schema=kinds)

    return df.mapInArrow(run, schema, **how)


def arrow_schema(schema: str | T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """Connected components of edges (a long, b long): rows (node, label), label the smallest node reachable.

    Contracts the graph again and again: every node points at its smallest neighbour, pointers are shortened,
    and the edges are drawn between what they point at, until none is left. Only tables of edges and pointers
    move; neither comes to the driver. Nodes are those of the edges.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, maps, k = scratch.keep(edges, f"{name}-e0"), [], 0
    while n := edges.count():
        few = lambda df, rows: df.coalesce(-(-rows // FILE_ROWS))  # noqa: E731  # such tables shrink fast: no more files than their rows need
        both = edges.union(edges.select("b", "a"))
        point = both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("node"), F.least("a", "p").alias("p"))
        point = scratch.keep(few(point, 2 * n), f"{name}-p{k}a")
        for hop in "bc":
            up = point.select(F.col("node").alias("p"), F.col("p").alias("q"))
            point = scratch.keep(few(point.join(up, "p").select("node", F.col("q").alias("p")), 2 * n), f"{name}-p{k}{hop}")
        of = lambda end, to: point.select(F.col("node").alias(end), F.col("p").alias(to))
        nxt = edges.join(of("a", "x"), "a").join(of("b", "y"), "b").where("x <> y")
        nxt = nxt.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
        maps.append(point)
        edges = scratch.keep(few(nxt, n), f"{name}-e{k + 1}")
        k += 1
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    found = maps[0].select("node", F.col("p").alias("label"))
    for point in maps[1:]:
        up = point.select(F.col("node").alias("label"), F.col("p").alias("to"))
        found = found.join(up, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    found = scratch.keep(found, f"{name}-found")
    scratch.drop(*[f"{name}-e{i}" for i in range(k + 1)], *[f"{name}-p{i}{h}" for i in range(k) for h in "abc"])
    return found


def ranked(df: DataFrame, by: list[str], scratch: Scratch, name: str, partitions: int | None = None) -> DataFrame:
    """df with `rank`, its place from 0 in the order of `by`, and `n_rows`, without bringing rows to one task.

    Rows are range-partitioned, sorted and numbered within each partition; the partitions' counts (one row each)
    give every partition its first number.
    """
    spark = scratch.spark
    df = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    schema = T.StructType([*df.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType())])
    kinds = arrow_schema(schema)

    def number(batches):
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * n, pa.int32()), pa.array(range(at, at + n), pa.int64())], schema=kinds)
            at += n

    rows = scratch.keep(df.sortWithinPartitions(*by).mapInArrow(number, schema), name)
    counts = rows.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.selectExpr("part", "coalesce(sum(n) over (order by part rows between unbounded preceding and 1 preceding), 0) as first", "sum(n) over () as n_rows")
    before = spark.read.schema(before.schema).parquet(_written(before, scratch, f"{name}-parts"))
    return rows.join(before, "part").withColumn("rank", F.col("first") + F.col("at")).drop("part", "at", "first")


def _written(df: DataFrame, scratch: Scratch, name: str) -> str:
    scratch.keep(df, name)
    return scratch.path(name)


def utf8_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
