"""Users: registration, login and profile, as DataFrame -> DataFrame.

The stored form ``salt:sha256(password + salt)`` is kept for compatibility; it is a weak
scheme and not meant for new systems.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import hash_matches, salted_hash
from ..plans.requests import Registration
from .sessions import appended, public_users, row_by_id, row_deleted, row_updated


# Messages that callers compare.
EMAIL_TAKEN, USER_MISSING = "Email already registered", "User not found"


def user_by_email(users: DataFrame, email: str) -> DataFrame:
    return users.where(F.col("email") == email).limit(1)


def registered(users: DataFrame, request: Registration, row_id: int, salt: str | None = None, at: Column | None = None) -> DataFrame:
    """Users with one more; an email that is taken is an error."""
    if user_by_email(users, request.email).count():
        raise ValueError(EMAIL_TAKEN)
    salt = secrets.token_hex(16) if salt is None else salt
    new = users.sparkSession.range(1).select(
        F.lit(row_id).alias("id"), F.lit(request.full_name).alias("full_name"), F.lit(request.email).alias("email"), F.lit(request.phone_number).cast("string").alias("phone_number"),
        salted_hash(F.lit(request.password), F.lit(salt)).alias("password"), (F.current_timestamp() if at is None else at).alias("created_at"),
    )
    return appended(users, new)


def logged_in(users: DataFrame, email: str, password: str) -> DataFrame:
    """The user's public row if the password is right, else no row."""
    return public_users(user_by_email(users, email).where(hash_matches(F.lit(password), F.col("password"))))


def profile(users: DataFrame, row_id: int) -> DataFrame:
    return public_users(row_by_id(users, row_id))


def profile_updated(users: DataFrame, row_id: int, full_name: str | None = None, email: str | None = None, phone_number: str | None = None) -> DataFrame:
    """Users with the given fields changed; a user that is not there or nothing to change is an error."""
    if not row_by_id(users, row_id).count():
        raise ValueError(USER_MISSING)
    return row_updated(users, row_id, {"full_name": full_name, "email": email, "phone_number": phone_number})


def removed(users: DataFrame, row_id: int) -> DataFrame:
    return row_deleted(users, row_id)
