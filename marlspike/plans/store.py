"""Users, chats, their history and files as tables that persist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import accounts, sessions
from ..sources.keyed import KeyedStore, Table
from ..sources.tables import CHAT_HISTORY, CHATS, UPLOADED_FILES, USERS
from .requests import Registration

TABLES = {
    "users": Table(USERS, unique=("email",)),
    "chats": Table(CHATS, references={"user_id": "users"}),
    "chat_history": Table(CHAT_HISTORY, references={"chat_id": "chats", "user_id": "users"}),
    "uploaded_files": Table(UPLOADED_FILES, references={"chat_session_id": "chats", "user_id": "users"}),
}


class ChatStore(KeyedStore):
    """The changes of users, chats and files; each is one version of all tables, or none."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, TABLES, "chats")

    def _none(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([], self.tables[name].schema)

    def register(self, request: Registration, row_id: int, salt: str | None = None, at: Column | None = None) -> int:
        """A new user; an email that is taken is refused."""
        return self.change({"users": accounts.registered(self._none("users"), request, row_id, salt, at)})

    def update_user(self, row_id: int, **fields: str | None) -> int:
        state = self.state()
        return self.change({"users": accounts.profile_updated(sessions.row_by_id(self.read("users", state), row_id), row_id, **fields)}, state=state)

    def remove_user(self, row_id: int) -> int:
        """A user goes; one who still has chats or files is refused."""
        state = self.state()
        return self.change(delete={"users": sessions.row_by_id(self.read("users", state), row_id).select("id")}, state=state)

    def create_chat(self, chat_id: int, user_id: int, name: str | None = None, first_bot_message: str | None = None, history_id: int = 0, at: Column | None = None) -> int:
        chats, history = sessions.chat_created(self._none("chats"), self._none("chat_history"), chat_id, user_id, name, first_bot_message, history_id, at)
        return self.change({"chats": chats, "chat_history": history} if first_bot_message is not None else {"chats": chats})

    def add_message(self, row_id: int, chat_id: int, user_id: int, input_data: str | None, output_data: str | None, at: Column | None = None) -> int:
        return self.change({"chat_history": sessions.message_added(self._none("chat_history"), row_id, chat_id, user_id, input_data, output_data, at)})

    def rename_chat(self, chat_id: int, user_id: int, name: str) -> int:
        state = self.state()
        own = self.read("chats", state).where((F.col("id") == chat_id) & (F.col("user_id") == user_id))
        return self.change({"chats": sessions.chat_renamed(own, chat_id, user_id, name)}, state=state)

    def _without(self, gone: DataFrame, state: dict) -> int:
        """Chats go with their history and files."""
        keys = gone.select(F.col("id").alias("_chat"))
        of = lambda name, c: self.read(name, state).join(keys, F.col(c) == F.col("_chat"), "left_semi").select("id")
        return self.change(delete={"chats": gone.select("id"), "chat_history": of("chat_history", "chat_id"), "uploaded_files": of("uploaded_files", "chat_session_id")}, state=state)

    def delete_chat(self, chat_id: int, user_id: int) -> int:
        state = self.state()
        return self._without(self.read("chats", state).where((F.col("id") == chat_id) & (F.col("user_id") == user_id)), state)

    def clear_chats(self, user_id: int) -> int:
        state = self.state()
        return self._without(self.read("chats", state).where(F.col("user_id") == user_id), state)

    def add_file(self, row_id: int, chat_id: int, user_id: int, name: str, size: int, kind: str = "pdf", at: Column | None = None) -> int:
        return self.change({"uploaded_files": sessions.file_added(self._none("uploaded_files"), row_id, chat_id, user_id, name, size, kind, at)})

    def delete_file(self, row_id: int) -> int:
        state = self.state()
        return self.change(delete={"uploaded_files": sessions.row_by_id(self.read("uploaded_files", state), row_id).select("id")}, state=state)
