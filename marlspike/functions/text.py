"""Text rules as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns and lengths of the rules below.
WHITE = r"[\s\p{Z}\x1c-\x1f\x85\x0b]"
PAGE_MARK = r"(?iU)\A[\s\p{Z}\x1c-\x1f\x85\x0b]*-+\s*page\s*\d+\s*-+[\s\p{Z}\x1c-\x1f\x85\x0b]*\z"
LEAST_ALPHANUMERICS = 20
EMAIL = r"\S+@\S+\.\S+"


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends (``trim`` removes spaces only)."""
    return F.regexp_replace(text, f"^{WHITE}+|{WHITE}+$", "")


def alphanumerics(text: Column) -> Column:
    """Number of letters and digits of any script."""
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def low_information(text: Column) -> Column:
    """Empty, only a page mark, or fewer than 20 letters and digits; null is low.

    The test stops at the twentieth letter or digit and writes no text anew.
    """
    enough = text.rlike(rf"\A(?:[^\p{{L}}\p{{N}}]*+[\p{{L}}\p{{N}}]){{{LEAST_ALPHANUMERICS}}}")
    return F.coalesce(~enough | text.rlike(PAGE_MARK), F.lit(True))


def not_blank(text: Column) -> Column:
    return F.coalesce(strip(text) != "", F.lit(False))


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def shortened(text: Column, length: int) -> Column:
    """The first characters, with ``...`` if there are more."""
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text)


def session_title(first_message: Column, title: Column, default: str = "New Chat", length: int = 50) -> Column:
    """A chat's title: the first user message, shortened, while the title is the default."""
    return F.when(F.coalesce(title, F.lit(default)) == default, F.coalesce(shortened(first_message, length), F.lit(default))).otherwise(title)


def password_points(password: Column) -> Column:
    """One point each for 8 characters, a lower-case letter, an upper-case letter, a digit, anything else."""
    tests = [F.length(password) >= 8, password.rlike("[a-z]"), password.rlike("[A-Z]"), password.rlike("[0-9]"), password.rlike("[^A-Za-z0-9]")]
    return sum((F.coalesce(t, F.lit(False)).cast("int") for t in tests[1:]), F.coalesce(tests[0], F.lit(False)).cast("int"))


def password_strength(password: Column) -> Column:
    points = password_points(password)
    return F.when(points <= 2, "Weak").when(points == 3, "Medium").otherwise("Strong")


def salted_hash(password: Column, salt: Column) -> Column:
    """``salt:sha256(password + salt)``."""
    return F.concat(salt, F.lit(":"), F.sha2(F.concat(password, salt), 256))


def hash_matches(password: Column, stored: Column) -> Column:
    """Whether a password has the stored salted hash; false unless the hash has exactly two parts."""
    parts = F.split(stored, ":")
    return F.coalesce((F.size(parts) == 2) & (F.sha2(F.concat(password, F.get(parts, F.lit(0))), 256) == F.get(parts, F.lit(1))), F.lit(False))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def as_mebibytes(size: Column) -> Column:
    """Bytes (whole ones) as megabytes with two decimals, halves to the even one, as ``printf`` does."""
    hundredths = F.bround(size.cast("decimal(20,0)") * F.lit(100) / F.lit(1024 * 1024), 0)
    return F.concat((hundredths / F.lit(100)).cast("decimal(22,2)").cast("string"), F.lit(" MB"))


def parsed_time(value: Column) -> Column:
    """A time from ISO text with or without ``T``, fractions and zone; null if it is none."""
    return F.coalesce(F.try_to_timestamp(value), F.try_to_timestamp(value, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")), F.try_to_timestamp(value, F.lit("yyyy-MM-dd")))


def long_date(at: Column) -> Column:
    """``March 5, 2024``."""
    return F.date_format(at, "MMMM d, yyyy")


def clock(at: Column) -> Column:
    """``09:05 PM``."""
    return F.date_format(at, "hh:mm a")


def unquoted(text: Column) -> Column:
    """Without quotes and then spaces at both ends."""
    return F.trim(F.regexp_replace(F.trim(text), "^[\"']+|[\"']+$", ""))


# Words that stand for true and for false.
TRUE_WORDS = ("1", "true", "yes", "on", "debug", "dev", "development")
FALSE_WORDS = ("0", "false", "no", "off", "release", "prod", "production")


def truthy(text: Column) -> Column:
    """Words for true and false; null for anything else."""
    word = F.lower(strip(text))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def origin_list(text: Column) -> Column:
    """Origins from a JSON array, or else from a comma list; quotes and trailing slashes go."""
    listed = F.coalesce(F.from_json(text, "array<string>"), F.split(text, ","))
    clean = F.transform(listed, lambda x: F.rtrim(unquoted(x), F.lit("/")))
    return F.filter(clean, lambda x: x != "")


def origins(configured: Column, required: Column) -> Column:
    """Distinct union of both lists, sorted."""
    return F.array_sort(F.array_union(configured, required))
