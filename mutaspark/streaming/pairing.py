"""Replies paired with waiting requests while both stream in: in time, late, or none by the end of the wait."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What `delivered_stream` takes of either side.
COMMANDS, REPLIES = ("request_id", "issued_at", "deadline"), ("request_id", "replied_at")


def paired_stream(commands: DataFrame, replies: DataFrame, grace_s: int = 60, lateness_s: int = 30) -> DataFrame:
    """Every command (request_id, issued_at, deadline) of a stream with each of its replies (request_id, replied_at) until `grace_s` after its deadline, and alone where none came by then.

    A stream-stream left outer join on the request, bounded in time on both sides: a reply is at most lateness_s
    older than its request and at most as much younger as the wait is long, so both sides' state goes when the
    watermark has passed it, whatever never gets its match. Replies to requests that nobody sent are dropped.
    """
    left = commands.select("request_id", "issued_at", "deadline", (F.col("deadline") + F.expr(f"interval {grace_s} seconds")).alias("closes")).withWatermark("closes", f"{lateness_s} seconds")
    right = replies.select(F.col("request_id").alias("replied_to"), "replied_at").withWatermark("replied_at", f"{lateness_s} seconds")
    near = (F.col("request_id") == F.col("replied_to")) & (F.col("replied_at") <= F.col("closes")) & (F.col("replied_at") >= F.col("closes") - F.expr(f"interval {3600 + grace_s + lateness_s} seconds"))
    return left.join(right, near, "left_outer").drop("replied_to")


def delivered_stream(commands: DataFrame, replies: DataFrame, grace_s: int = 60, lateness_s: int = 30) -> DataFrame:
    """`flows.delivered` while it streams: a row for each command when its wait is over, with its first reply, `delivery` (in_time, late, none) and how many more replies were dropped.

    Late is a reply after the deadline and within `grace_s`; what comes later finds no one waiting. Commands live
    at most an hour. The join's rows are counted by command, under the time its wait closes.
    """
    rows = paired_stream(commands, replies, grace_s, lateness_s).groupBy("request_id", "deadline", "closes")
    first = rows.agg(F.min("replied_at").alias("replied_at"), F.count("replied_at").alias("replies"))
    delivery = F.when(F.col("replied_at").isNull(), "none").when(F.col("replied_at") > F.col("deadline"), "late").otherwise("in_time")
    return first.select("request_id", "deadline", "replied_at", delivery.alias("delivery"), F.greatest(F.col("replies") - 1, F.lit(0)).cast("long").alias("dropped"))
