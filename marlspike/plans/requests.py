"""Requests with checked bounds: objects for one request, columns for tables of them."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import first_filled, not_blank

EMAIL = re.compile(r"[^@\s]+@[^@\s]+\.[^@\s]+")


def _within(name: str, value, low, high) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must be from {low} to {high}")


@dataclass(frozen=True)
class QueryRequest:
    query: str
    top_k: int = 5
    threshold: float = 0.7
    boosted: bool = True

    def __post_init__(self):
        _within("length of query", len(self.query), 1, 1000)
        if not self.query.strip():
            raise ValueError("query is blank")
        _within("top_k", self.top_k, 1, 20)
        _within("threshold", self.threshold, 0.0, 1.0)


@dataclass(frozen=True)
class ChatRequest:
    message: str
    session_id: str | None = None
    chat_id: int | str | None = None
    user_id: int | None = None
    max_context_results: int = 3
    temperature: float = 0.7

    def __post_init__(self):
        _within("length of message", len(self.message), 1, 2000)
        _within("max_context_results", self.max_context_results, 1, 10)
        _within("temperature", self.temperature, 0.0, 1.0)

    @property
    def scope(self) -> str | None:
        """The session that passages may come from; None means that nothing is retrieved."""
        return self.session_id or (None if self.chat_id is None else str(self.chat_id))


@dataclass(frozen=True)
class Registration:
    full_name: str
    email: str
    password: str
    phone_number: str | None = None

    def __post_init__(self):
        _within("length of full_name", len(self.full_name), 1, 100)
        if not EMAIL.fullmatch(self.email):
            raise ValueError("email is not valid")
        _within("length of password", len(self.password), 6, 100)
        if self.phone_number is not None:
            _within("length of phone_number", len(self.phone_number), 0, 20)


@dataclass(frozen=True)
class SimilarRequest:
    document_id: str
    top_k: int = 5

    def __post_init__(self):
        _within("top_k", self.top_k, 1, 10)


# Messages that callers compare.
NAME_MISSING, EMAIL_MISSING, EMAIL_WRONG = "Full name is required", "Email is required", "Email is invalid"
PASSWORD_MISSING, PASSWORD_SHORT, PASSWORDS_DIFFER = "Password is required", "Password must be at least 8 characters", "Passwords do not match"


def signup_errors(full_name: str, email: str, password: str, again: str) -> dict[str, str]:
    """Messages by field of a sign-up form; empty if it is in order."""
    out = {}
    if not full_name.strip():
        out["full_name"] = NAME_MISSING
    if not email.strip():
        out["email"] = EMAIL_MISSING
    elif not re.search(r"\S+@\S+\.\S+", email):
        out["email"] = EMAIL_WRONG
    if not password:
        out["password"] = PASSWORD_MISSING
    elif len(password) < 8:
        out["password"] = PASSWORD_SHORT
    if password != again:
        out["again"] = PASSWORDS_DIFFER
    return out


# the same rules as columns; null breaks a bound


def _holds(*tests: Column) -> Column:
    out = F.lit(True)
    for test in tests:
        out &= F.coalesce(test, F.lit(False))
    return out


def query_in_bounds(query: Column, top_k: Column, threshold: Column) -> Column:
    """Whether a ``QueryRequest`` can be made."""
    return _holds(F.length(query).between(1, 1000), not_blank(query), top_k.between(1, 20), threshold.between(0.0, 1.0))


def chat_in_bounds(message: Column, max_context_results: Column, temperature: Column) -> Column:
    """Whether a ``ChatRequest`` can be made."""
    return _holds(F.length(message).between(1, 2000), max_context_results.between(1, 10), temperature.between(0.0, 1.0))


def similar_in_bounds(top_k: Column) -> Column:
    """Whether a ``SimilarRequest`` can be made."""
    return _holds(top_k.between(1, 10))


def registration_in_bounds(full_name: Column, email: Column, password: Column, phone_number: Column) -> Column:
    """Whether a ``Registration`` can be made; a phone number may be missing."""
    phone = phone_number.isNull() | (F.length(phone_number) <= 20)
    return _holds(F.length(full_name).between(1, 100), email.rlike(rf"(?U)\A(?:{EMAIL.pattern})\z"), F.length(password).between(6, 100), phone)


def signup_messages(full_name: Column, email: Column, password: Column, again: Column) -> dict[str, Column]:
    """The messages of ``signup_errors`` by field, null where a field is in order; a missing value is empty."""
    given = [F.coalesce(c, F.lit("")) for c in (full_name, email, password, again)]
    name, mail, word, second = given
    return {
        "full_name": F.when(~not_blank(name), NAME_MISSING),
        "email": F.when(~not_blank(mail), EMAIL_MISSING).when(~mail.rlike(r"(?U)\S+@\S+\.\S+"), EMAIL_WRONG),
        "password": F.when(word == "", PASSWORD_MISSING).when(F.length(word) < 8, PASSWORD_SHORT),
        "again": F.when(word != second, PASSWORDS_DIFFER),
    }


def scope(session_id: Column, chat_id: Column) -> Column:
    """``ChatRequest.scope``: the session, else the chat, else null."""
    return F.coalesce(first_filled(session_id), chat_id.cast("string"))
