"""Filters over string metadata, as columns.

Metadata is ``map<string,string>``; keys promoted to columns of the same name are read
there, so that their predicates reach the Parquet scan.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def where_clause(metadata: dict[str, Any] | None = None, session_id: Any = None, user_id: Any = None) -> dict[str, Any] | None:
    """The filter of a request: metadata pairs, then session, user, then an operator clause.

    None values drop out and other values become strings.  A dict with any key that
    begins with ``$`` is one operator clause and is kept as it is.
    """
    given = {k: v for k, v in (metadata or {}).items() if v is not None}
    operator = any(k.startswith("$") for k in given)
    clauses: list[dict[str, Any]] = [] if operator else [{k: str(v)} for k, v in given.items()]
    clauses += [{k: str(v)} for k, v in (("session_id", session_id), ("user_id", user_id)) if v is not None]
    if operator:
        clauses.append(given)
    if not clauses:
        return None
    return clauses[0] if len(clauses) == 1 else {"$and": clauses}


_COMPARE = {
    "$eq": lambda c, v: c == v,
    "$ne": lambda c, v: c != v,
    "$gt": lambda c, v: c > v,
    "$gte": lambda c, v: c >= v,
    "$lt": lambda c, v: c < v,
    "$lte": lambda c, v: c <= v,
    "$in": lambda c, v: c.isin([_text(x) for x in v]),
    "$nin": lambda c, v: ~c.isin([_text(x) for x in v]),
}


def _text(value: Any) -> str:
    return value if isinstance(value, str) else str(value)


def _field(key: str, columns: list[str]) -> Column:
    return F.col(f"`{key}`").cast("string") if key in columns else F.try_element_at("metadata", F.lit(key))


def _is_number(value: Any) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def compiled(where: dict[str, Any] | None, columns: list[str]) -> Column:
    """A filter as a boolean column for ``where``; a missing key matches nothing but ``$ne`` and ``$nin``.

    Order comparisons with a number compare as numbers.
    """
    if not where:
        return F.lit(True)
    parts: list[Column] = []
    for key, value in where.items():
        if key in ("$and", "$or"):
            both = (lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b)
            parts.append(reduce(both, [compiled(x, columns) for x in value], F.lit(key == "$and")))
            continue
        tests = value if isinstance(value, dict) else {"$eq": value}
        for name, v in tests.items():
            if name not in _COMPARE:
                raise ValueError(f"unknown filter operator {name}")
            c = _field(key, columns)
            if name in ("$gt", "$gte", "$lt", "$lte") and _is_number(v):
                test = _COMPARE[name](c.try_cast("double"), F.lit(float(v)))
            else:
                test = _COMPARE[name](c, v if name in ("$in", "$nin") else F.lit(_text(v)))
            parts.append(F.coalesce(test, F.lit(True)) if name in ("$ne", "$nin") else test)  # bare tests reach the Parquet scan
    return reduce(lambda a, b: a & b, parts)


def same_metadata(wanted: dict[str, Any] | None, columns: list[str] = ()) -> Column:
    """All pairs equal without regard to case; a missing key is the empty string."""
    tests = [F.lower(F.coalesce(_field(k, list(columns)), F.lit(""))) == F.lower(F.lit(_text(v))) for k, v in (wanted or {}).items()]
    return reduce(lambda a, b: a & b, tests, F.lit(True))
