"""Kept roll-ups of chats: counts, first and last messages, brought up to date by a stream.

A batch of new messages is summed by chat, joined with the kept rows of those chats, and
put in place as one version together with the batch's number, so a batch that is
delivered again changes nothing, and a crash leaves the roll-up of the last whole batch.
"""

from __future__ import annotations

import hashlib
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import not_blank, session_title
from ..sources.keyed import KeyedStore, Table

KEPT = "id bigint, message_count bigint, first_input string, first_input_at bigint, latest_input string, latest_input_at bigint, latest_output string, latest_output_at bigint"


class Rollup(KeyedStore):
    """One row for each chat; batches entered are remembered by stream."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, {"chats": Table(KEPT)}, "rollup")

    def state(self) -> dict[str, Any]:
        return self._state({"tables": {}, "batches": {}})

    def enter(self, messages: DataFrame, stream: str, number: int) -> bool:
        """Add messages (chat, at, role, text) of a batch; False if it was entered before."""
        state = self.state()
        if state["batches"].get(stream, -1) >= number:
            return False
        rows = messages.where(F.col("role").isin("user", "assistant") & not_blank(F.col("text")))
        at = lambda who: F.when(F.col("role") == who, F.col("at"))
        new = rows.groupBy(F.col("chat").alias("id")).agg(
            F.count("*").alias("n"), F.min_by("text", at("user")).alias("first"), F.min(at("user")).alias("first_at"),
            F.max_by("text", at("user")).alias("input"), F.max(at("user")).alias("input_at"), F.max_by("text", at("assistant")).alias("output"), F.max(at("assistant")).alias("output_at"),
        )
        joined = new.join(self.read("chats", state), "id", "left")
        newer = lambda at_, kept: F.col(kept).isNull() | (F.col(at_) > F.col(kept))
        merged = joined.select(
            "id", (F.coalesce("message_count", F.lit(0)) + F.col("n")).alias("message_count"),
            *_pick("first", "first_at", "first_input", "first_input_at", F.col("first_input_at").isNull() | (F.col("first_at") < F.col("first_input_at"))),
            *_pick("input", "input_at", "latest_input", "latest_input_at", newer("input_at", "latest_input_at")),
            *_pick("output", "output_at", "latest_output", "latest_output_at", newer("output_at", "latest_output_at")),
        )
        self.change({"chats": merged}, state=state | {"batches": state["batches"] | {stream: number}})
        return True

    def rows(self) -> DataFrame:
        """The kept rows with titles, as ``message_rollup`` gives them for all messages at once."""
        return self.read("chats").select("id", "message_count", "latest_input", "latest_output", session_title(F.col("first_input"), F.lit("New Chat")).alias("title"))


def _pick(text: str, at: str, kept: str, kept_at: str, wins):
    """The new text and its time where there is one that wins, else what is kept."""
    new = F.col(at).isNotNull() & wins
    return F.when(new, F.col(text)).otherwise(F.col(kept)).alias(kept), F.when(new, F.col(at)).otherwise(F.col(kept_at)).alias(kept_at)


def keep_rollup(spark: SparkSession, folder: str, rollup: Rollup, checkpoint: str, files: int = 100) -> StreamingQuery:
    """Start a run over the message files (Parquet: chat, at, role, text) that are new; wait for it with ``awaitTermination``."""
    messages = spark.readStream.schema("chat bigint, at bigint, role string, text string").option("maxFilesPerTrigger", files).parquet(folder)
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def enter(batch: DataFrame, number: int) -> None:
        rollup.enter(batch, stream, number)

    return messages.writeStream.foreachBatch(enter).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
