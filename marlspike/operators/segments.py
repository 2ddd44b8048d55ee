"""Messages of chats in numbered segments, so that a chat of any length is many rows.

``sessions`` nests all messages of a chat in one row, which suits what a page shows; for
whole tables a chat may hold a third of all messages.  Here messages are dealt into
ranges of (chat, time), a message's number is its place in its range and chat plus the
chat's messages in the ranges before, and a segment is ``size`` messages with consecutive
numbers.  No task sees more of a chat than a range or a segment.

Null chats are a chat of their own; equal times go by history row, user before bot.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_filled
from ..sources.collection import scratch_dir
from .sessions import WELCOME, history_messages

SEGMENT = 500
RANGE_ROWS = 200_000


def numbered(rows: DataFrame, group: str, order: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` with ``seq``: 0, 1, ... within each ``group`` by ``order``.

    The ranges are written once, because their bounds are drawn anew by each run of a plan.
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // range_rows))
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    rows.repartitionByRange(parts, *keys).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("_range", group).agg(F.count("*").alias("_c"))  # a row for each range of a group
    starts = counts.select(F.col("_range").alias("_r"), F.col(group).alias("_g"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range", group).orderBy(*keys[1:]))
    joined = dealt.join(starts, (F.col("_range") == F.col("_r")) & F.col(group).eqNullSafe(F.col("_g")))
    return joined.withColumn("seq", (F.col("_before") + place - 1).cast("long")).drop("_range", "_r", "_g", "_before")


def session_segments(history: DataFrame, size: int = SEGMENT, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(chat_id, segment, messages): the messages of history rows in time order, ``size`` in a row."""
    rows = numbered(history_messages(history), "chat_id", ["ts", "history_id", "side"], range_rows)
    one = F.struct("seq", "id", "content", "is_bot", "ts")
    nested = rows.groupBy("chat_id", F.expr(f"seq div {size}").alias("segment")).agg(F.array_sort(F.collect_list(one)).alias("messages"))
    return nested.select("chat_id", "segment", "messages")


def sidebar_rollup(chats: DataFrame, history: DataFrame, welcome: str = WELCOME) -> DataFrame:
    """What ``sidebar`` shows of each chat, from sums and last values alone; a hot chat is added up in parts before it is shuffled."""
    order = F.struct("ts", "history_id", "side")
    rows = history_messages(history)
    last = lambda bot: F.max_by("content", F.when(F.col("is_bot") == bot, order))
    found = rows.groupBy(F.col("chat_id").alias("_chat")).agg(F.count("*").alias("n"), last(False).alias("input"), last(True).alias("output"))
    joined = chats.join(found, chats["id"] == found["_chat"], "left")
    return joined.select(
        F.col("id").cast("string").alias("id"), F.coalesce(first_filled(F.col("chat_name")), F.lit("New Chat")).alias("title"), F.col("created_at").alias("timestamp"),
        F.coalesce("n", F.lit(1)).alias("message_count"), F.col("input").alias("latest_input"), F.when(F.col("n").isNull(), welcome).otherwise(F.col("output")).alias("latest_output"),
    )
