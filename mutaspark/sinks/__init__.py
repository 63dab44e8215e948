"""Where results go: idempotent writes of several outputs, JSON lines, reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_outputs(path: str, split: Callable[[DataFrame], dict[str, DataFrame]], fmt: str = "parquet") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes several outputs of a batch, each to a folder of the batch's number. A batch that runs again overwrites its own folders, so each output has every batch once."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        try:
            for name, out in split(rows).items():
                out.write.mode("overwrite").format(fmt).save(f"{path}/{name}/batch={number}")
        finally:
            rows.unpersist()

    return write


def json_lines(df: DataFrame, path: str) -> None:
    """One JSON document a row. Rows written twice after a failure are told by their identity."""
    df.write.mode("append").json(path)


def latency_report(rows: DataFrame) -> str:
    """Text of a small table of quantiles: a line for each target."""
    names = ["p50", "p95", "p99", "max", "mean"]
    lines = [f"{'':<10}" + "".join(f"{n:>12}" for n in names)]
    for r in rows.limit(100).collect():
        lines.append(f"{r[0]:<10}" + "".join(f"{r[n]:>12.2f}" for n in names))
    return "\n".join(lines)


def topic_table(spark, services: dict[str, int], naming) -> DataFrame:
    """`topics_needed` of services by name, with their partitions."""
    return topics_needed(spark.createDataFrame([*services.items()], "service string, partitions int"), naming).orderBy("topic")


def topics_needed(services: DataFrame, naming) -> DataFrame:
    """The topics that services (service, partitions) need: name, partitions, cleanup policy, retention and size limit."""
    topic = lambda prefix, n, cleanup, kept: F.struct(F.concat(F.lit(prefix), "service").alias("topic"), n.cast("int").alias("partitions"), F.lit(cleanup).alias("cleanup"), F.lit(kept).cast("long").alias("retention_ms"), F.lit(8 << 20).cast("long").alias("max_message_bytes"))
    n = F.col("partitions")
    each = [topic(naming.command_topics, n, "delete", None), topic(naming.reply_topics, F.lit(1), "delete", 3_600_000), topic(naming.result_topics, n, "delete", None), topic("state.", n, "compact", None)]
    return services.select(F.explode(F.array(*each)).alias("t")).select("t.*")
