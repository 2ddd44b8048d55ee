"""Chats, their history, files and users: roll-ups and changes as DataFrame -> DataFrame.

A change returns the new version of a table; nothing is updated in place.
"""

from __future__ import annotations

import functools
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_filled, not_blank, session_title

# Fixed value: a message that callers compare.
NO_CHANGES = "No data to update"
WELCOME = "This chat is empty. Add files, then ask about what they say."


def history_messages(history: DataFrame) -> DataFrame:
    """Messages of history rows (user before bot), blank ones left out: chat_id, id, content, is_bot, ts, seq."""
    both = F.array(
        F.struct(F.concat(F.lit("user_"), F.col("id").cast("string")).alias("id"), F.col("input_data").alias("content"), F.lit(False).alias("is_bot"), F.lit(0).alias("side")),
        F.struct(F.concat(F.lit("bot_"), F.col("id").cast("string")).alias("id"), F.col("output_data").alias("content"), F.lit(True).alias("is_bot"), F.lit(1).alias("side")),
    )
    rows = history.select("chat_id", F.col("created_at").alias("ts"), F.col("id").alias("history_id"), F.explode(both).alias("m"))
    return rows.where(not_blank(F.col("m.content"))).select("chat_id", "m.id", "m.content", "m.is_bot", "ts", "history_id", "m.side")


def sessions(chats: DataFrame, history: DataFrame, welcome: str = WELCOME) -> DataFrame:
    """Each chat with its messages in time order; a chat without messages has the welcome message."""
    one = F.struct("ts", "history_id", "side", "id", "content", "is_bot")
    nested = history_messages(history).groupBy("chat_id").agg(F.array_sort(F.collect_list(one)).alias("found"))
    kept = F.transform("found", lambda m: F.struct(m["id"].alias("id"), m["content"].alias("content"), m["is_bot"].alias("is_bot"), m["ts"].alias("ts")))
    empty = F.array(F.struct(F.lit("1").alias("id"), F.lit(welcome).alias("content"), F.lit(True).alias("is_bot"), F.col("created_at").alias("ts")))
    joined = chats.join(nested, chats["id"] == nested["chat_id"], "left")
    return joined.select(F.col("id").cast("string").alias("id"), F.coalesce(first_filled(F.col("chat_name")), F.lit("New Chat")).alias("title"), F.coalesce(kept, empty).alias("messages"), F.col("created_at"), F.col("created_at").alias("updated_at"), F.lit(False).alias("is_active"))


def sidebar(session_rows: DataFrame, active_id: str | None = None) -> DataFrame:
    """One line for each session, newest first: counts, last input and last output."""
    last = lambda bot: F.element_at(F.filter("messages", lambda m: m["is_bot"] == bot), -1)["content"]
    some = lambda bot: F.when(F.exists("messages", lambda m: m["is_bot"] == bot), last(bot))
    rows = session_rows.select("id", "title", F.col("updated_at").alias("timestamp"), F.size("messages").alias("message_count"), some(False).alias("latest_input"), some(True).alias("latest_output"), F.coalesce(F.col("id") == F.lit(active_id), F.lit(False)).alias("is_active"))
    return rows.orderBy(F.col("timestamp").desc(), "id")


def message_rollup(messages: DataFrame, key: str, order: str, role: str, text: str) -> DataFrame:
    """Counts, last input, last output and title of conversations given as one row for each message."""
    when = lambda who: F.when(F.col(role) == who, F.col(order))
    rows = messages.where(F.col(role).isin("user", "assistant") & not_blank(F.col(text)))
    grouped = rows.groupBy(key).agg(
        F.count("*").alias("message_count"), F.max_by(text, when("user")).alias("latest_input"), F.max_by(text, when("assistant")).alias("latest_output"), F.min_by(text, when("user")).alias("first_input")
    )
    return grouped.withColumn("title", session_title(F.col("first_input"), F.lit("New Chat"))).drop("first_input")


def of_user(chats: DataFrame, history: DataFrame, user_id: int) -> DataFrame:
    """History rows of a user's chats only."""
    mine = chats.where(F.col("user_id") == user_id).select(F.col("id").alias("chat_id"))
    return history.join(mine, "chat_id", "left_semi")


# changes


def broken_keys(chats: DataFrame, history: DataFrame, files: DataFrame, users: DataFrame) -> DataFrame:
    """Rows whose key names no row: table, id, column and the key; nothing where all keys hold."""
    owners, talks = users.select(F.col("id").alias("_key")), chats.select(F.col("id").alias("_key"))
    checks = [("chats", chats, "user_id", owners), ("chat_history", history, "chat_id", talks), ("chat_history", history, "user_id", owners), ("uploaded_files", files, "chat_session_id", talks), ("uploaded_files", files, "user_id", owners)]
    found = [
        rows.where(F.col(c).isNotNull()).join(known, F.col(c) == F.col("_key"), "left_anti").select(F.lit(name).alias("table"), F.col("id").cast("long").alias("id"), F.lit(c).alias("column"), F.col(c).cast("long").alias("key"))
        for name, rows, c, known in checks
    ]
    return functools.reduce(DataFrame.unionByName, found)


def appended(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows.select(*[F.col(c).cast(t) for c, t in table.dtypes]))


def message_added(history: DataFrame, row_id: int, chat_id: int, user_id: int, input_data: str | None, output_data: str | None, at: Column | None = None) -> DataFrame:
    """History with one more row: active, without title, missing texts empty."""
    now = F.current_timestamp() if at is None else at
    new = history.sparkSession.range(1).select(
        F.lit(row_id).alias("id"), F.lit(chat_id).alias("chat_id"), F.lit(user_id).alias("user_id"), F.lit(input_data or "").alias("input_data"), F.lit(output_data or "").alias("output_data"),
        now.alias("created_at"), now.alias("updated_at"), F.lit(True).alias("is_active"), F.lit(None).cast("string").alias("title"),
    )
    return appended(history, new)


def chat_created(chats: DataFrame, history: DataFrame, chat_id: int, user_id: int, name: str | None, first_bot_message: str | None, history_id: int, at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Both tables with a new chat, and its first bot message if there is one."""
    now = F.current_timestamp() if at is None else at
    row = chats.sparkSession.range(1).select(F.lit(chat_id).alias("id"), F.lit(user_id).alias("user_id"), F.lit(name).cast("string").alias("chat_name"), now.alias("created_at"))
    more = history if first_bot_message is None else message_added(history, history_id, chat_id, user_id, "", first_bot_message, at)
    return appended(chats, row), more


def chat_deleted(chats: DataFrame, history: DataFrame, chat_id: int, user_id: int) -> tuple[DataFrame, DataFrame]:
    """Both tables without a user's chat and its history."""
    gone = lambda c: ~F.coalesce((F.col(c) == chat_id) & (F.col("user_id") == user_id), F.lit(False))
    return chats.where(gone("id")), history.where(gone("chat_id"))


def chats_cleared(chats: DataFrame, history: DataFrame, user_id: int) -> tuple[DataFrame, DataFrame]:
    keep = ~F.coalesce(F.col("user_id") == user_id, F.lit(False))
    return chats.where(keep), history.where(keep)


def chat_renamed(chats: DataFrame, chat_id: int, user_id: int, name: str) -> DataFrame:
    return chats.withColumn("chat_name", F.when((F.col("id") == chat_id) & (F.col("user_id") == user_id), F.lit(name)).otherwise(F.col("chat_name")))


def row_updated(table: DataFrame, row_id: int, changes: dict[str, Any]) -> DataFrame:
    """The row with the values that are not None; an update without any is an error."""
    given = {k: v for k, v in changes.items() if v is not None}
    if not given:
        raise ValueError(NO_CHANGES)
    kinds = dict(table.dtypes)
    return table.withColumns({k: F.when(F.col("id") == row_id, F.lit(v).cast(kinds[k])).otherwise(F.col(k)) for k, v in given.items()})


def row_deleted(table: DataFrame, row_id: int) -> DataFrame:
    return table.where(~F.coalesce(F.col("id") == row_id, F.lit(False)))


def row_by_id(table: DataFrame, row_id: int) -> DataFrame:
    return table.where(F.col("id") == row_id).limit(1)


def public_users(users: DataFrame) -> DataFrame:
    return users.drop("password")


def file_added(files: DataFrame, row_id: int, chat_id: int, user_id: int, name: str, size: int, kind: str = "pdf", at: Column | None = None) -> DataFrame:
    now = F.current_timestamp() if at is None else at
    return appended(files, files.sparkSession.range(1).select(F.lit(row_id).alias("id"), F.lit(chat_id).alias("chat_session_id"), F.lit(name).alias("file_name"), F.lit(size).alias("file_size"), F.lit(kind).alias("file_type"), now.alias("upload_timestamp"), F.lit(user_id).alias("user_id")))


def files_of_chat(files: DataFrame, chat_id: int) -> DataFrame:
    """A chat's files in upload order, with the names the interface uses."""
    rows = files.where(F.col("chat_session_id") == chat_id).orderBy("upload_timestamp", "id")
    return rows.select("id", F.col("file_name").alias("fileName"), F.col("file_size").alias("fileSize"), F.col("file_type").alias("fileType"), F.col("upload_timestamp").alias("uploadTimestamp"))


def files_with_results(files: DataFrame, results: DataFrame) -> DataFrame:
    """Each uploaded file with the first result of its name."""
    first = results.withColumn("_n", F.row_number().over(Window.partitionBy("file_name").orderBy("seq"))).where("_n = 1").drop("_n", "seq")
    return files.join(first, "file_name", "left")
