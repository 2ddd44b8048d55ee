"""Queries over roll-ups of chats that are kept or cut in segments; their SQL is that of the plain roll-ups."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import segments
from ..sources.collection import scratch_dir
from ..streaming.rollup import Rollup, keep_rollup
from .registry import _MESSAGES, ORACLES, chat_tables, register, table


@register("session_segments", _MESSAGES + """, n as (select *, row_number() over (partition by chat_id order by turn, id, side) - 1 as seq from m)
select chat_id, (seq // 3)::bigint as segment, string_agg(mid, ',' order by seq) as ids, string_agg(content, '|' order by seq) as contents from n group by chat_id, seq // 3""")
def session_segments(spark, d):
    """Messages of all chats, three in a row."""
    rows = segments.session_segments(chat_tables(spark, d)[1], 3)
    joined = lambda c, by: F.array_join(F.transform("messages", lambda m: m[c]), by)
    return rows.select("chat_id", "segment", joined("id", ",").alias("ids"), joined("content", "|").alias("contents"))


@register("sidebar_rollup", ORACLES["session_sidebar"])
def sidebar_rollup(spark, d):
    """The sidebar from sums and last values, without nesting."""
    return segments.sidebar_rollup(*chat_tables(spark, d)).select("id", "message_count", "latest_input", "latest_output")


@register("kept_rollup", ORACLES["session_rollup"])
def kept_rollup(spark, d):
    """The roll-up of all conversations, kept by a stream that takes their messages in files, one batch each; then run again."""
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    talk = table(spark, d, "conversations").select(F.col("conv_id").alias("chat"), F.col("turn").alias("at"), "role", "text")
    talk.repartition(3, F.col("at") % 3).write.parquet(f"{path}/in")
    kept = Rollup(spark, f"{path}/kept")
    for _ in range(2):
        keep_rollup(spark, f"{path}/in", kept, f"{path}/at", 1).awaitTermination()
    return kept.rows().withColumnRenamed("id", "conv_id")
