"""Topic logs as tables and streams, in the columns of Spark's Kafka source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mutaspark.schema import LOG


def read_log(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A log kept as files, in Parquet or JSON lines. Filters on topic, partition, offset and time reach the files."""
    return spark.read.format(fmt).schema(LOG).load(path)


def stream_log(spark: SparkSession, path: str, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(LOG)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(path)


def kafka_log(spark: SparkSession, servers: str, pattern: str | None = None, topics: list[str] | None = None, assign: str | None = None, starting: str = "earliest", stream: bool = True, **options) -> DataFrame:
    """A log in Kafka: committed records only, headers included. Needs Spark's Kafka package on the class path."""
    reader = (spark.readStream if stream else spark.read).format("kafka")
    chosen = {"subscribePattern": pattern, "subscribe": ",".join(topics) if topics else None, "assign": assign}
    base = {"kafka.bootstrap.servers": servers, "kafka.isolation.level": "read_committed", "includeHeaders": "true", "startingOffsets": starting}
    for key, value in {**base, **chosen, **options}.items():
        if value is not None:
            reader = reader.option(key, value)
    return reader.load()


def of_topics(log: DataFrame, pattern: str) -> DataFrame:
    """Records of topics that a pattern matches from start to end."""
    return log.where(F.col("topic").rlike(f"^(?:{pattern})\\z"))


def stream_topics(event_topics: list[str] = ()) -> str:
    """The pattern of all topics of the stream, and of event topics by name."""
    import re

    return "|".join([r"http\.requests\..*", r"http\.responses\..*", r"http\.results\..*", *map(re.escape, sorted(event_topics))])


def since(log: DataFrame, start: Column) -> DataFrame:
    """Records from a time on, in whole milliseconds, as logs keep time."""
    return log.where(F.col("timestamp") >= F.date_trunc("MILLISECOND", start))


def between(log: DataFrame, topic: str, partition: int, first: int, end: int | None = None) -> DataFrame:
    """One partition's records from an offset on, before an end."""
    rows = log.where((F.col("topic") == topic) & (F.col("partition") == partition) & (F.col("offset") >= first))
    return rows if end is None else rows.where(F.col("offset") < end)


def end_offsets(log: DataFrame) -> DataFrame:
    return log.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("end_offset"))
