"""A vector collection in Parquet: append, insert if absent, delete, reset, scan, stats.

Rows lie in folders that are written once (``data/``); a version names the folders it
consists of, and the bitmaps of deleted rows (``deletes/``: one bit for each sequence number,
in buckets of 32,768, written anew by a delete and applied by a scan; rows are written again
by ``compact`` only).  Opening writes nothing.

Rows are clustered by session and user when they are written, and a manifest beside each
folder (``manifests/``) has the least and greatest session and user of each file, and
the sessions themselves where a file has ``LISTED`` at most.  A scan of a session or user opens
only files that may hold it.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.filters import compiled
from ..functions.text import first_filled
from ..settings import DEFAULTS
from .tables import CHUNKS, DELETES, MANIFEST
from .versions import Conflict, Versioned

__all__ = ["Collection", "Conflict", "collection_stats", "insert_absent", "scratch_dir", "stamped", "usable_path", "without_ids"]

# Metadata keys that hold a file's name, the first one first.
NAME_KEYS = ["source_file_name", "original_file_name", "file_name", "filename"]

#: The most sessions of a file that its manifest lists.
LISTED = 64


def stamped(rows: DataFrame, added_at=None) -> DataFrame:
    """Metadata as it is stored: nulls dropped, names filled in, source and time of entry set."""
    at = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") if added_at is None else F.lit(added_at)
    kept = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda _, v: v.isNotNull())
    name = first_filled(*[F.try_element_at("metadata", F.lit(k)) for k in NAME_KEYS])
    names = F.map_filter(F.create_map(*[x for k in NAME_KEYS for x in (F.lit(k), first_filled(F.try_element_at("metadata", F.lit(k)), name))]), lambda _, v: v.isNotNull())
    source = F.coalesce(first_filled(F.try_element_at("metadata", F.lit("title")), name), F.lit("Unknown"))
    more = F.map_concat(names, F.create_map(F.lit("source"), source, F.lit("added_at"), at))
    rest = F.map_filter("metadata", lambda k, _: ~F.array_contains(F.map_keys(more), k))
    out = rows.withColumn("metadata", kept)
    return out.withColumn("metadata", F.map_concat(rest, more)).withColumns({k: F.try_element_at("metadata", F.lit(k)) for k in ("session_id", "user_id", "source_file_name")})


def insert_absent(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The new rows whose id is not stored yet; of equal new ids one row stays."""
    return new.dropDuplicates(["id"]).join(stored.select("id"), "id", "left_anti")


def without_marked(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows whose sequence number has no bit in the bitmaps (bucket, bitmap)."""
    at = F.bitmap_bit_position("ingest_seq")
    byte = F.conv(F.hex(F.substring(F.col("_bitmap"), F.expr("cast(bitmap_bit_position(ingest_seq) div 8 + 1 as int)"), F.lit(1))), 16, 10).cast("long")
    joined = rows.join(marks.select(F.col("bucket").alias("_bucket"), F.col("bitmap").alias("_bitmap")), F.bitmap_bucket_number("ingest_seq") == F.col("_bucket"), "left")
    return joined.where(F.coalesce(F.getbit(byte, (at % 8).cast("int")), F.lit(0)) == 0).select(*rows.columns)


def without_ids(stored: DataFrame, ids: DataFrame) -> DataFrame:
    return stored.join(ids.select("id").distinct(), "id", "left_anti")


def usable_path(preferred: str, fallback: str) -> str:
    """The preferred local folder, or the fallback if it cannot be made or written."""
    try:
        os.makedirs(preferred, exist_ok=True)
        if os.access(preferred, os.W_OK):
            return preferred
    except PermissionError:
        pass
    os.makedirs(fallback, exist_ok=True)
    return fallback


def scratch_dir(spark: SparkSession) -> str:
    """A folder that all machines share: under ``spark.checkpoint.dir``; on one machine without it, a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        where = _LOCAL[0] if _LOCAL else tempfile.mkdtemp(prefix="marlspike-")
        _LOCAL[:] = [where]
    return where.rstrip("/") + "/scratch"


_LOCAL: list[str] = []


def equals(where: dict[str, Any] | None, column: str) -> str | None:
    """The value that a filter asks a column to have, if it does so in a clause that must hold."""
    for key, value in (where or {}).items():
        if key == "$and":
            found = [v for v in (equals(w, column) for w in value) if v is not None]
            if found:
                return found[0]
        elif key == column:
            value = value.get("$eq") if isinstance(value, dict) else value
            return None if value is None else str(value)
    return None


class Collection(Versioned):
    """Vectors with text and metadata under one path."""

    def __init__(self, spark: SparkSession, path: str, name: str = DEFAULTS.collection):
        super().__init__(spark, path, name)

    def _version(self) -> dict[str, Any]:
        """The last version: its number, folders, deleted rows, live rows and next sequence number."""
        return self._state({"folders": [], "deletes": None, "rows": 0, "next": 0})

    def _commit(self, after: int, folders: list[str], rows: int, next_: int, deletes: str | None = None) -> None:
        self._put(after, {"folders": folders, "deletes": deletes, "rows": rows, "next": next_})

    def _write(self, rows: DataFrame) -> str:
        """Rows, clustered by session and user, and their manifest in new folders, which no version names yet."""
        folder = uuid.uuid4().hex
        path = f"{self.path}/data/{folder}"
        rows.repartitionByRange("session_id", "user_id").sortWithinPartitions("session_id", "user_id", "ingest_seq").write.parquet(path)
        span = lambda c, name: [F.min(c).alias(f"{name}_min"), F.max(c).alias(f"{name}_max")]
        file = F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file")
        keys = self.spark.read.schema(CHUNKS).parquet(path).select(file, "session_id", "user_id").groupBy("file", "session_id").agg(F.min("user_id").alias("low"), F.max("user_id").alias("high"))
        found = keys.groupBy("file").agg(*span("session_id", "session"), F.min("low").alias("user_min"), F.max("high").alias("user_max"), F.when(F.count("session_id") <= LISTED, F.collect_set("session_id")).alias("sessions"))
        found.coalesce(1).write.parquet(f"{self.path}/manifests/{folder}")
        return folder

    def _read(self, folders: list[str], deletes: str | None = None, where: dict[str, Any] | None = None) -> DataFrame:
        """Rows of folders without deleted ones, from files that may hold what ``where`` asks of session and user."""
        paths = [f"{self.path}/data/{f}" for f in folders]
        session, user = equals(where, "session_id"), equals(where, "user_id")
        if folders and (session is not None or user is not None):
            may = F.lit(True)
            if session is not None:
                may &= F.coalesce(F.array_contains("sessions", session), F.lit(session).between(F.col("session_min"), F.col("session_max")))
            if user is not None:
                may &= F.lit(user).between(F.col("user_min"), F.col("user_max"))
            kept = self.spark.read.schema(MANIFEST).parquet(*[f"{self.path}/manifests/{f}" for f in folders]).withColumn("folder", F.element_at(F.split(F.input_file_name(), "/"), -2))
            paths = [f"{self.path}/data/{r['folder']}/{r['file']}" for r in kept.where(may).select("folder", "file").collect()]
        if not paths:
            return self.spark.createDataFrame([], CHUNKS)
        rows = self.spark.read.schema(CHUNKS).parquet(*paths)
        return rows if deletes is None else without_marked(rows, self._deleted(deletes))

    def _deleted(self, deletes: str) -> DataFrame:
        return self.spark.read.schema(DELETES).parquet(f"{self.path}/deletes/{deletes}")

    def create(self) -> DataFrame:
        """All rows; an absent collection gets an empty first version."""
        if not self._numbers():
            self._commit(-1, [], 0, 0)
        return self.open()

    def open(self) -> DataFrame:
        """All rows of the last version; none if there is no collection."""
        now = self._version()
        return self._read(now["folders"], now["deletes"])

    def add(self, rows: DataFrame, added_at: str | None = None) -> dict[str, Any]:
        """Enter rows (id, document, embedding, metadata) that are not there yet; errors of the data are in the answer."""
        now = self._version()
        try:
            fresh = insert_absent(self._read(now["folders"], now["deletes"]), stamped(rows, added_at))
            fields = [f.split()[0] for f in CHUNKS.split(", ")]
            folder = self._write(fresh.withColumn("ingest_seq", F.lit(now["next"]) + F.monotonically_increasing_id()).select(*fields))
        except (PySparkException, Py4JJavaError) as e:
            return {"success": False, "error": str(e), "added_count": 0}
        count, last = self._read([folder]).agg(F.count("*"), F.max("ingest_seq")).first()  # of the new rows only
        if count:
            self._commit(now["number"], [*now["folders"], folder], now["rows"] + count, last + 1, now["deletes"])
        elif now["number"] < 0:
            self._commit(-1, [], 0, 0)
        return {"success": True, "added_count": count, "total_documents": now["rows"] + count, "collection_name": self.name}

    def scan(self, where: dict[str, Any] | None = None, limit: int | None = None, embeddings: bool = True) -> DataFrame:
        """Rows that match a filter; without embeddings their column is not read."""
        now = self._version()
        rows = self._read(now["folders"], now["deletes"], where)
        found = rows.where(compiled(where, [c for c in rows.columns if c in ("session_id", "user_id", "source_file_name")]))
        if not embeddings:
            found = found.drop("embedding")
        return found if limit is None else found.orderBy("ingest_seq", "id").limit(limit)

    def delete(self, ids: DataFrame | list[str]) -> dict[str, Any]:
        """Delete by id (a frame with column ``id``, or a list); only bitmaps are written.  The count is the number of ids asked for, found or not."""
        now = self._version()
        if isinstance(ids, list):
            ids = self.spark.createDataFrame([(i,) for i in ids], "id string")
        hit = self._read(now["folders"], now["deletes"]).select("id", "ingest_seq").join(ids.select("id").distinct(), "id", "left_semi")
        marks = hit.groupBy(F.bitmap_bucket_number("ingest_seq").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("ingest_seq")).alias("bitmap"))
        if now["deletes"] is not None:
            marks = marks.union(self._deleted(now["deletes"])).groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
        name = uuid.uuid4().hex
        marks.write.parquet(f"{self.path}/deletes/{name}")
        count = lambda n: 0 if n is None else self._deleted(n).agg(F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0))).first()[0]
        self._commit(now["number"], now["folders"], now["rows"] - (count(name) - count(now["deletes"])), now["next"], name)
        return {"success": True, "deleted_count": ids.count()}

    def compact(self) -> None:
        """The same rows in one folder, without the deleted ones."""
        now = self._version()
        if len(now["folders"]) > 1 or now["deletes"] is not None:
            self._commit(now["number"], [self._write(self._read(now["folders"], now["deletes"]))], now["rows"], now["next"])

    def reset(self) -> None:
        """An empty collection."""
        now = self._version()
        self._commit(now["number"], [], 0, 0)

    def clear(self) -> dict[str, int]:
        """Maintenance: documents before, reset, documents after."""
        before = self.open().count()
        self.reset()
        return {"before": before, "after": self.open().count()}

    def vacuum(self) -> int:
        """Delete folders and versions that the last version does not need, when no reader of older ones is left."""
        now = self._version()
        gone = [f"versions/{n:012d}" for n in self._numbers() if n != now["number"]]
        gone += [f"{kind}/{n}" for kind in ("data", "manifests") for n in self._listed(kind) if n not in now["folders"]]
        gone += [f"deletes/{n}" for n in self._listed("deletes") if n != now["deletes"]]
        return self._drop(gone)

    def peek(self) -> DataFrame:
        """Any one row."""
        return self.open().limit(1)

    def stats(self) -> DataFrame:
        return collection_stats(self.open(), self.name, self.path)


def collection_stats(rows: DataFrame, name: str, path: str) -> DataFrame:
    """One row: name, number of documents, path, whether there are any, keys of a sample's metadata."""
    keys = F.min_by(F.array_sort(F.map_keys("metadata")), "id")
    return rows.agg(F.lit(name).alias("collection_name"), F.count("*").alias("total_documents"), F.lit(path).alias("db_path"), (F.count("*") > 0).alias("has_data"), keys.alias("sample_metadata_keys"))
