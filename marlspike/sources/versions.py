"""Numbered versions of a store: small JSON files that are put in place whole, one after the other."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer made a version meanwhile."""


class Versioned:
    """A path whose last file under ``versions/`` says what the store consists of.

    A change writes its data first and then puts the next version in place under its
    number, so a crash leaves the last version as it was, readers see whole versions only,
    and of two writers at once one fails.
    """

    def __init__(self, spark: SparkSession, path: str, name: str):
        self.spark, self.path, self.name = spark, path.rstrip("/"), name

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _listed(self, folder: str) -> list[str]:
        p, fs = self._fs(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _numbers(self) -> list[int]:
        return sorted(int(n) for n in self._listed("versions") if n.isdigit())

    def _state(self, first: dict[str, Any]) -> dict[str, Any]:
        """The last version with its number; ``first`` as version -1 if there is none."""
        numbers = self._numbers()
        if not numbers:
            return first | {"number": -1}
        p, fs = self._fs(f"{self.path}/versions/{numbers[-1]:012d}")
        stream = fs.open(p)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return first | json.loads(text) | {"number": numbers[-1]}

    def _put(self, after: int, state: dict[str, Any]) -> None:
        """Put the version after ``after`` in place; the file is whole before it has its name."""
        target, fs = self._fs(f"{self.path}/versions/{after + 1:012d}")
        aside, _ = self._fs(f"{self.path}/versions/.{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if fs.exists(target) or not fs.rename(aside, target):
            fs.delete(aside, False)
            raise Conflict(f"version {after + 1} of {self.name} is already there")

    def _drop(self, paths: list[str]) -> int:
        return sum(bool(self._fs(f"{self.path}/{g}")[1].delete(self._fs(f"{self.path}/{g}")[0], True)) for g in paths)
