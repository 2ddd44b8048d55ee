"""What the corpus operators share: cut lineage, sizes, byte helpers.

Nothing here is tied to one operator.  Tables that cut lineage are Parquet files
under ``spark.checkpoint.dir`` (read from the session; a temporary folder is set
only where the session has none, as in tests on one machine).
"""

from __future__ import annotations

import ctypes
import inspect
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.  Off one machine it must be set; a local folder would be another one on each."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            where = held.get()
        elif spark.sparkContext.master.startswith("local"):
            where = tempfile.mkdtemp(prefix="marlspike-")
            spark.sparkContext.setCheckpointDir(where)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return where.rstrip("/") + "/tables"


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, which ``drop_written`` knows of."""
    path = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def written(df: DataFrame, label: str = "t") -> DataFrame:
    """``df`` written to the shared folder and read back, so its lineage ends there."""
    path = scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._written = path
    return found


_MADE: list[str] = []


def _delete(spark: SparkSession, name: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))


def drop(df: DataFrame) -> None:
    """Delete a table that ``written`` made and that nothing reads any more."""
    if path := getattr(df, "_written", None):
        _delete(df.sparkSession, path)
        if path in _MADE:
            _MADE.remove(path)


def made() -> int:
    """How many tables there are by now, for ``drop_written``."""
    return len(_MADE)


def drop_written(spark: SparkSession, since: int = 0, but: DataFrame | None = None) -> int:
    """Delete the intermediate tables made since then, except one, once no result reads them any more."""
    keep = [getattr(but, "_written", None)]
    gone = [p for p in _MADE[since:] if p not in keep]
    _MADE[since:] = [p for p in _MADE[since:] if p in keep]
    return sum(_delete(spark, p) for p in gone)


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _TRIM = None


def give_back() -> None:
    """Return what a group's arrays took to the system.  Workers live on for later stages and share an executor's memory with them."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def tidy(work: Callable) -> Callable:
    """A worker's function over groups or batches, which gives memory back when it is done."""
    if inspect.isgeneratorfunction(work):

        def read(*args):
            yield from work(*args)
            give_back()

        return read

    def done(out):
        give_back()
        return out

    # groups come with or without their key by the number of parameters
    return {1: lambda a: done(work(a)), 2: lambda a, b: done(work(a, b)), 3: lambda a, b, c: done(work(a, b, c))}[len(inspect.getfullargspec(work).args)]


def quoted(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever their names hold."""
    return [column(c) for c in df.columns]


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def free(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def unpacked(df: DataFrame, struct: str, columns: list[str]) -> DataFrame:
    """The fields of a struct column as columns, in order."""
    return df.select(*[F.col(struct).getField(c).alias(c) for c in columns])


def filtered(docs: DataFrame, keep: Callable[[list[bytes]], list[bool]], text_col: str = "text") -> DataFrame:
    """The rows whose text (UTF-8; null: empty) is to be kept; each row goes to Python once."""
    packed = docs.select(F.struct(*quoted(docs)).alias("row"))
    at = docs.columns.index(text_col)

    def read(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column(0).field(at).cast(pa.binary()).to_pylist()]
            yield batch.filter(pa.array(keep(texts), pa.bool_()))

    return unpacked(packed.mapInArrow(tidy(read), packed.schema), "row", docs.columns)


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts together (null counts as none)."""
    row = docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()
    return int(row[0] or 0)


def tasks(spark: SparkSession, n: int) -> int:
    """``n`` partitions, but no fewer than the session shuffles into."""
    return max(n, int(spark.conf.get("spark.sql.shuffle.partitions")))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (Stafford's variant 13), element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def as_bytes(value) -> bytes:
    """UTF-8 of a text; null is empty."""
    if value is None:
        return b""
    return value if isinstance(value, bytes) else value.encode("utf-8")


#: The most ranges of ids, so the list of bounds stays a few MB; beyond it a range holds several batches.
MAX_RANGES = 200_000


def ranges_for(size: int, batch_bytes: int, least: int, most: int = MAX_RANGES) -> int:
    """How many ranges a corpus of ``size`` bytes is dealt into."""
    return min(most, max(least, -(-size // batch_bytes)))


#: Keys fetched for each range; a range then has its bytes up to a third or so.
KEYS_PER_RANGE = 8


def order_key(id_col: str, text_col: str):
    """The place of a row in the corpus: its id of any type that has an order (null first), then a hash of its text."""
    return F.struct(column(id_col).alias("a"), F.xxhash64(F.coalesce(column(text_col).cast("string"), F.lit(""))).alias("b"))


class Ranges:
    """Ranges of a corpus in order, of similar numbers of bytes; their bounds are keys of rows, the least key first."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, parts: int, size: int):
        kind = docs.schema[id_col].dataType.simpleString()
        self.key = order_key(id_col, text_col)
        found = docs.select(self.key.alias("k"), F.coalesce(F.octet_length(column(text_col).cast("string")), F.lit(0)).alias("n"))
        # a row is drawn in proportion to its bytes, by a hash of its key, so drawn keys stand for equal shares (long rows for more)
        rate = KEYS_PER_RANGE * parts / max(1, size)
        chance = F.pmod(F.xxhash64(F.lit(7), "k.a", "k.b"), F.lit(1 << 52)) / F.lit(float(1 << 52))
        drawn = found.where(chance < F.col("n") * F.lit(rate)).groupBy("k").agg(F.sum("n").alias("n")).orderBy("k").select(F.to_json("k"), "n")
        cuts, held = [], 0.0
        for key, n in drawn.collect():
            if held >= KEYS_PER_RANGE:
                cuts.append(key)
                held = 0.0
            held += max(1.0, n * rate)
        least = found.agg(F.to_json(F.min("k"))).first()[0]
        bounds = list(dict.fromkeys([*([least] if least is not None else []), *cuts]))
        self.count = len(bounds)
        self.bounds = F.from_json(F.lit("[" + ",".join(bounds) + "]"), f"array<struct<a:{kind},b:bigint>>")

    def number(self, key=None):
        """1 to ``count``: how many bounds are at or below the key, by binary search."""
        key = self.key if key is None else key
        if not self.count:
            return F.lit(1)
        steps = [1 << k for k in reversed(range(self.count.bit_length()))]
        found = F.aggregate(
            F.array(*[F.lit(s) for s in steps]),
            F.lit(0),
            lambda at, step: F.when((at + step <= self.count) & (F.get(self.bounds, F.least(at + step, F.lit(self.count)) - 1) <= key), at + step).otherwise(at),
        )
        return F.greatest(F.lit(1), found)

    def begins(self, number, key=None):
        """Whether the key is the first of its range."""
        return F.coalesce(F.get(self.bounds, number - 1) == (self.key if key is None else key), F.lit(False)) if self.count else F.lit(False)


_TILE_BITS = 17
_PLACE = np.uint32((1 << _TILE_BITS) - 1)


def least_runs(keys, starts: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that share their least position, over texts laid end to end.

    ``keys(a, b)`` gives 32-bit values of positions a to b - 1 (their high 15 bits
    count); text k has ``counts[k]`` windows of ``width`` positions from
    ``starts[k]`` on (``starts`` also has the end of all).  Of equal values the
    leftmost is least.  Returns for each run the position and the first and last
    window start, in order; runs do not cross texts.  Work goes in tiles that fit a
    processor cache.
    """
    total = int(starts[-1])
    some = counts > 0
    step = np.zeros(total + 1, np.int8)
    step[starts[:-1][some]] += 1
    np.add.at(step, (starts[:-1] + counts)[some], -1)
    valid = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
    breaks = np.zeros(total + 1, bool)
    breaks[starts] = True
    end = int((starts[:-1] + counts)[some].max()) if some.any() else 0
    found = []
    span = (1 << _TILE_BITS) - width
    for t in range(0, end, span):
        upto = min(t + span, end)
        ok = valid[t:upto]
        if not ok.any():
            continue
        key = keys(t, upto + width - 1)
        key = (key & ~_PLACE) | np.arange(len(key), dtype=np.uint32)
        d = 1
        while d < width:
            more = min(d, width - d)
            key = np.minimum(key[: len(key) - more], key[more:])
            d += more
        place = (key & _PLACE).astype(np.int64) + t
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1]) | ~ok[:-1] | breaks[t + 1 : upto]
        new &= ok
        first = np.flatnonzero(new)
        stop = np.ones(len(place), bool)
        stop[:-1] = new[1:] | ~ok[1:]
        last = np.flatnonzero(stop & ok)
        found.append((place[first], t + first, t + last))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    place, lo, hi = (np.concatenate(x) for x in zip(*found))
    same = np.zeros(len(place), bool)  # a run cut by a tile's end goes on
    same[1:] = (place[1:] == place[:-1]) & (lo[1:] == hi[:-1] + 1) & ~breaks[lo[1:]]
    head = np.flatnonzero(~same)
    return place[head], lo[head], hi[np.append(head[1:], len(place)) - 1]


def output(df: DataFrame, columns: dict[str, str], ddl: str) -> T.StructType:
    """A schema: columns of ``df`` under new names (name: column), then fields in DDL."""
    kept = [T.StructField(name, df.schema[column].dataType, True) for name, column in columns.items()]
    return T.StructType(kept + T.StructType.fromDDL(ddl).fields)
