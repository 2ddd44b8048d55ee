"""Keyed tables that persist: a base and ordered changes for each, merged by key when they are read.

A change is a folder of rows to put and of keys to delete; a version names, for each
table, its base and the changes after it in order, so a commit over several tables is one
step.  Before a commit, keys must be unique within the change, unique columns among
all rows that will be live, and references must name a live row (null names none); a
row that others refer to cannot go before them.  The checks read the version that the commit
follows, and a commit after another writer's fails, so they hold for every version.

Reading streams the base past the keys that were changed since, and takes the last
change of each of those; ``compact`` writes bases anew.
"""

from __future__ import annotations

import functools
import uuid
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .versions import Versioned


@dataclass(frozen=True)
class Table:
    """A table's schema (DDL), its key, columns without repeats, and columns that name rows of other tables."""

    schema: str
    key: str = "id"
    unique: tuple[str, ...] = ()
    references: dict[str, str] = field(default_factory=dict)


class Refused(ValueError):
    """A change that a key, a unique column or a reference forbids."""


class KeyedStore(Versioned):
    """Tables under one path that change together."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, Table], name: str = "store"):
        super().__init__(spark, path, name)
        self.tables = tables

    def state(self) -> dict[str, Any]:
        """The last version: number, and base and changes of each table."""
        return self._state({"tables": {}})

    def _folder(self, name: str, folder: str) -> DataFrame:
        return self.spark.read.schema(f"{self.tables[name].schema}, _gone boolean").parquet(f"{self.path}/data/{folder}")

    def _changes(self, name: str, held: dict[str, Any]) -> DataFrame | None:
        """The last change of each key since the base."""
        if not held["changes"]:
            return None
        rows = functools.reduce(DataFrame.unionAll, [self._folder(name, f).withColumn("_nth", F.lit(k)) for k, f in enumerate(held["changes"])])
        last = Window.partitionBy(self.tables[name].key).orderBy(F.col("_nth").desc())
        return rows.withColumn("_rank", F.row_number().over(last)).where("_rank = 1").drop("_nth", "_rank")

    def read(self, name: str, state: dict[str, Any] | None = None) -> DataFrame:
        """The live rows of a table."""
        held = (state or self.state())["tables"].get(name, {"base": None, "changes": []})
        schema, key = self.tables[name].schema, self.tables[name].key
        base = self._folder(name, held["base"]).drop("_gone") if held["base"] else self.spark.createDataFrame([], schema)
        changes = self._changes(name, held)
        if changes is None:
            return base
        touched = changes.select(F.col(key).alias("_key"))
        return base.join(touched, F.col(key) == F.col("_key"), "left_anti").unionByName(changes.where("not _gone").drop("_gone"))

    def change(self, put: dict[str, DataFrame] | None = None, delete: dict[str, DataFrame] | None = None, state: dict[str, Any] | None = None) -> int:
        """Commit rows to put and keys (a column of the key's name) to delete; the new version's number."""
        state = state or self.state()
        put, delete = put or {}, delete or {}
        written: dict[str, str] = {}
        for name in {*put, *delete}:
            table = self.tables[name]
            columns = self.spark.createDataFrame([], table.schema).dtypes
            parts = []
            if name in put:
                parts.append(put[name].select(*[F.col(c).cast(t).alias(c) for c, t in columns], F.lit(False).alias("_gone")))
            if name in delete:
                parts.append(delete[name].select(*[(F.col(c) if c == table.key else F.lit(None)).cast(t).alias(c) for c, t in columns], F.lit(True).alias("_gone")))
            folder = uuid.uuid4().hex
            functools.reduce(DataFrame.unionAll, parts).write.parquet(f"{self.path}/data/{folder}")
            written[name] = folder
        tables = {n: state["tables"].get(n, {"base": None, "changes": []}) for n in self.tables}
        rest = {k: v for k, v in state.items() if k not in ("number", "tables")}
        after = rest | {"tables": {n: h | {"changes": [*h["changes"], written[n]]} if n in written else h for n, h in tables.items()}}
        try:
            self._checked(written, after)
        except Refused:
            self._drop([f"data/{f}" for f in written.values()])
            raise
        self._put(state["number"], after)
        return state["number"] + 1

    def _checked(self, written: dict[str, str], after: dict[str, Any]) -> None:
        """Raise ``Refused`` where the change breaks a rule in the version that it makes."""
        for name, folder in written.items():
            table, new = self.tables[name], self._folder(name, folder)
            if new.where(F.col(table.key).isNull()).head(1) or new.groupBy(table.key).count().where("count > 1").head(1):
                raise Refused(f"{name}: a key is missing or comes twice")
            fresh, live = new.where("not _gone"), self.read(name, after)
            for c in table.unique:
                values = fresh.where(F.col(c).isNotNull()).select(F.col(c).alias("_value")).distinct()
                if live.join(values, F.col(c) == F.col("_value"), "left_semi").groupBy(c).count().where("count > 1").head(1):
                    raise Refused(f"{name}: {c} is taken")
            for c, other in table.references.items():
                known = self.read(other, after).select(F.col(self.tables[other].key).alias("_known"))
                if fresh.where(F.col(c).isNotNull()).join(known, F.col(c) == F.col("_known"), "left_anti").head(1):
                    raise Refused(f"{name}: {c} names no row of {other}")
            gone = new.where("_gone").select(F.col(table.key).alias("_lost"))
            for user, u in self.tables.items():
                for c, other in u.references.items():
                    if other == name and self.read(user, after).join(gone, F.col(c) == F.col("_lost"), "left_semi").head(1):
                        raise Refused(f"{name}: a row is still named by {c} of {user}")

    def compact(self) -> int:
        """Bases with all changes in them."""
        state = self.state()
        tables = {}
        for name, held in state["tables"].items():
            if held["changes"]:
                folder = uuid.uuid4().hex
                self.read(name, state).withColumn("_gone", F.lit(False)).write.parquet(f"{self.path}/data/{folder}")
                held = {"base": folder, "changes": []}
            tables[name] = held
        self._put(state["number"], {k: v for k, v in state.items() if k != "number"} | {"tables": tables})
        return state["number"] + 1

    def vacuum(self) -> int:
        """Delete what the last version does not name, when nobody reads older ones."""
        state = self.state()
        used = {f for h in state["tables"].values() for f in (h["base"], *h["changes"])}
        gone = [f"data/{f}" for f in self._listed("data") if f not in used]
        return self._drop(gone + [f"versions/{n:012d}" for n in self._numbers() if n != state["number"]])
