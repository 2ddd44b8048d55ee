"""Embeddings learned from the corpus: latent semantic vectors by a randomised SVD.

A text is a row of hashed word counts, weighted 1 + log(count) times the word's inverse document
frequency and scaled to unit length.  The leading right singular vectors of the matrix of
all texts are found by block passes over it: each task multiplies its rows with a block of
directions and back, the products are summed by blocks of features, and the driver
orthogonalises a matrix of ``features`` x (``dimension`` + ``OVERSAMPLE``) numbers, however many texts
there are.  A text's vector is its row times these directions, scaled to unit length, so
texts that share no word are near if their words occur in the same texts.

Defined results: null, empty and wordless texts have the zero vector; words are runs of
letters, digits and underscores, in lower case; a table without texts gives zero vectors.
Directions have their largest entry positive, and sums go in the order of the parts, so
reruns agree.

Scale: texts are read and their words counted once; passes, and the vectors of ``fit_embedded``,
read their sparse rows from a table in the shared folder.  Rows with more than one word for
``SPARSE`` features are multiplied as dense ones, which is faster although most of it is zero.
``max_parts`` bounds the partial products that are summed.
"""

from __future__ import annotations

import functools
import json
import re
import sys
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.collection import scratch_dir
from .batches import parts

FEATURES = 8192
DIMENSION = 64
OVERSAMPLE = 16
PASSES = 3
MAX_PARTS = 1000
BLOCK = 128
CHUNK = 50_000
SPARSE = 160
DENSE_ROWS = 256
LONG = 64
_WORD = re.compile(r"\w+")


def counted(text: str | None, features: int) -> tuple[list[int], list[int]]:
    """Hashed words of a text, in order, and their counts."""
    found = Counter(zlib.crc32(w.encode()) % features for w in _WORD.findall((text or "").lower()))
    at = sorted(found)
    return at, [found[k] for k in at]


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Which code points words are made of, and the steps of CRC-32 by byte."""
    word = np.zeros(sys.maxunicode + 1, bool)
    for m in _WORD.finditer("".join(map(chr, range(sys.maxunicode + 1)))):
        word[m.start() : m.end()] = True
    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = np.where(steps & 1, (steps >> 1) ^ np.uint32(0xEDB88320), steps >> 1).astype(np.uint32)
    return word, steps


def _hashes(data: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of the words at these places: byte by byte, of all words that are as long."""
    order = np.argsort(-np.minimum(size, LONG + 1).astype(np.int16), kind="stable")
    start, size = start[order], size[order]
    _, steps = _tables()
    octets = np.frombuffer(data, np.uint8)
    crc = np.full(len(start), 0xFFFFFFFF, np.uint32)
    long = int((size > LONG).sum())
    more = np.bincount(size[long:], minlength=LONG + 1)[::-1].cumsum()[::-1]  # words of at least so many bytes
    for k in range(LONG):
        end = long + int(more[k + 1])
        if end == long:
            break
        now = crc[long:end]
        crc[long:end] = steps[(now ^ octets[start[long:end] + k]) & 255] ^ (now >> 8)
    crc ^= np.uint32(0xFFFFFFFF)
    for k in range(long):
        crc[k] = zlib.crc32(data[start[k] : start[k] + size[k]])
    out = np.empty_like(crc)
    out[order] = crc
    return out


def counted_all(texts: Sequence[str | None], features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``counted`` of every text, one behind the other: (places, counts, number of places of each text)."""
    lower = [(t or "").lower() for t in texts]
    whole = "\n".join(lower)
    data = whole.encode()
    word, _ = _tables()
    if len(data) == len(whole):
        within, ends = word[np.frombuffer(data, np.uint8)], np.cumsum([len(t) + 1 for t in lower])
    else:
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        within = np.repeat(word[points], 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF))
        ends = np.cumsum([len(t.encode()) + 1 for t in lower])
    edges = np.flatnonzero(np.diff(within, prepend=False, append=False))
    start, stop = edges[::2], edges[1::2]
    place = _hashes(data, start, stop - start).astype(np.int64) % features
    key, n = np.unique(np.searchsorted(ends, start, "right") * features + place, return_counts=True)
    return key % features, n, np.bincount(key // features, minlength=len(texts))


class Rows:
    """Weighted rows of unit length in sparse form: places, values, and the row of each."""

    def __init__(self, at: np.ndarray, n: np.ndarray, sizes: np.ndarray, idf: np.ndarray, work: list[np.ndarray]):
        self.at, self.count, self.sizes, self.work = at, len(sizes), sizes, work
        self.row = np.repeat(np.arange(len(sizes)), sizes)
        value = (1.0 + np.log(n)) * idf[at] if len(at) else np.zeros(0)
        norm = np.sqrt(np.bincount(self.row, value * value, minlength=len(sizes)))
        self.value = value / np.where(norm > 0, norm, 1.0)[self.row]

    def _dense(self, features: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, their matrix) of all rows with many places, ``DENSE_ROWS`` at a time."""
        many = np.flatnonzero(self.sizes * SPARSE >= features)
        ends = np.cumsum(self.sizes)
        for rows in (many[k : k + DENSE_ROWS] for k in range(0, len(many), DENSE_ROWS)):
            sizes = self.sizes[rows]
            own = np.repeat(ends[rows] - np.cumsum(sizes), sizes) + np.arange(sizes.sum())
            if not self.work:
                self.work.append(np.zeros((DENSE_ROWS, features)))
            place = np.repeat(np.arange(len(rows)), sizes), self.at[own]
            self.work[0][place] = self.value[own]
            yield rows, self.work[0][: len(rows)]
            self.work[0][place] = 0.0

    def _sparse(self, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, values and rows of all rows with few places."""
        few = (self.sizes * SPARSE < features)[self.row]
        return self.at[few], self.value[few], self.row[few]

    def times(self, directions: np.ndarray) -> np.ndarray:
        """The rows times ``directions`` (features x k)."""
        out = np.zeros((self.count, directions.shape[1]))
        for rows, matrix in self._dense(len(directions)):
            out[rows] = matrix @ directions
        at, value, row = self._sparse(len(directions))
        if len(at):
            head = np.flatnonzero(np.diff(row, prepend=-1))
            out[row[head]] = np.add.reduceat(value[:, None] * directions[at], head)
        return out

    def twice(self, directions: np.ndarray, out: np.ndarray) -> None:
        """Add the transposed rows times the rows times ``directions`` to ``out`` (features x k)."""
        for _, matrix in self._dense(len(out)):
            out += matrix.T @ (matrix @ directions)
        at, value, row = self._sparse(len(out))
        if len(at):
            head = np.flatnonzero(np.diff(row, prepend=-1))
            products = np.add.reduceat(value[:, None] * directions[at], head)[np.cumsum(np.diff(row, prepend=row[0]) != 0)]
            order = np.argsort(at, kind="stable")
            at = at[order]
            head = np.flatnonzero(np.diff(at, prepend=-1))
            out[at[head]] += np.add.reduceat(value[order][:, None] * products[order], head)


def _chunks(at: np.ndarray, n: np.ndarray, sizes: np.ndarray, idf: np.ndarray) -> Iterator[Rows]:
    """Rows of ``sizes`` places and counts each, about ``CHUNK`` values at a time."""
    ends = np.cumsum(sizes)
    work: list[np.ndarray] = []  # zeros that dense rows are put in, one matrix for all
    a = 0
    while a < len(sizes):
        start = ends[a] - sizes[a]
        b = max(a + 1, int(np.searchsorted(ends, start + CHUNK, "right")))
        yield Rows(*(x[start : ends[b - 1]].astype(np.int64) for x in (at, n)), sizes[a:b], idf, work)
        a = b


class LatentEmbedder:
    """Texts to latent vectors; ``directions`` (features x dimension), ``idf`` and ``singular`` values."""

    def __init__(self, directions: np.ndarray, idf: np.ndarray, singular: np.ndarray):
        self.directions, self.idf, self.singular = directions, idf, singular

    @property
    def dimension(self) -> int:
        return self.directions.shape[1]

    def embed(self, texts: list[str]) -> list[list[float]]:
        return self.vectors(*counted_all(texts, len(self.idf))).tolist()

    def vectors(self, at: np.ndarray, n: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The vectors of texts with these counts, one behind the other."""
        out = np.concatenate([np.zeros((0, self.dimension)), *(rows.times(self.directions) for rows in _chunks(at, n, sizes, self.idf))])
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, size, out=np.zeros_like(out), where=size > 1e-12)

    @classmethod
    def fit(cls, texts: DataFrame, text_col: str = "document", dimension: int = DIMENSION, features: int = FEATURES, passes: int = PASSES, seed: int = 5, max_parts: int = MAX_PARTS) -> LatentEmbedder:
        """Learn directions from all texts of a column."""
        path, rows = _counts(texts.select(text_col), text_col, features)
        model = cls._learned(rows, dimension, features, passes, seed, max_parts)
        _delete(texts.sparkSession, path)
        return model

    @classmethod
    def fit_embedded(cls, rows: DataFrame, text_col: str = "document", dimension: int = DIMENSION, features: int = FEATURES, passes: int = PASSES, seed: int = 5, max_parts: int = MAX_PARTS) -> tuple[LatentEmbedder, DataFrame]:
        """``fit``, and the rows with ``embedding`` in place of the text, written once from the same counts."""
        spark = rows.sparkSession
        path, counts = _counts(rows, text_col, features)
        model = cls._learned(counts, dimension, features, passes, seed, max_parts)
        kept = [f for f in counts.schema if f.name not in COUNTS]
        schema = T.StructType([*kept, T.StructField("embedding", T.ArrayType(T.FloatType()))])
        shared = spark.sparkContext.broadcast(model)

        def embed(batches):
            model = shared.value
            for batch in batches:
                made = model.vectors(*_read(batch.column(COUNTS[0]), batch.column(COUNTS[1]), features)).astype(np.float32)
                ends = pa.array(np.arange(len(made) + 1) * model.dimension, pa.int32())
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.ListArray.from_arrays(ends, pa.array(made.ravel()))], names=schema.names)

        out = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
        counts.mapInArrow(embed, schema).write.parquet(out)
        _delete(spark, path)
        return model, spark.read.schema(schema).parquet(out)

    @classmethod
    def _learned(cls, rows: DataFrame, dimension: int, features: int, passes: int, seed: int, max_parts: int) -> LatentEmbedder:
        held = rows.select(*COUNTS).coalesce(max_parts)
        total, df = _frequencies(held, features)
        idf = np.where(df > 0, np.log((1.0 + total) / (1.0 + df)) + 1.0, 0.0)
        width = min(features, dimension + OVERSAMPLE)
        basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(features, width)))[0]
        for _ in range(passes):
            basis = np.linalg.qr(_product(held, basis, idf))[0]
        product = _product(held, basis, idf)
        inner = basis.T @ product
        values, vectors = np.linalg.eigh((inner + inner.T) / 2)
        top = np.argsort(-values)[:dimension]
        directions = basis @ vectors[:, top]
        directions *= np.where(directions[np.abs(directions).argmax(axis=0), np.arange(len(top))] < 0, -1.0, 1.0)
        return cls(directions.astype(np.float32).astype(np.float64), idf, np.sqrt(np.maximum(values[top], 0.0)))

    def save(self, spark: SparkSession, path: str) -> None:
        state = json.dumps({"directions": self.directions.tolist(), "idf": self.idf.tolist(), "singular": self.singular.tolist()})
        spark.createDataFrame([(state,)], "state string").coalesce(1).write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LatentEmbedder:
        state = json.loads(spark.read.parquet(path).first()[0])
        return cls(*(np.array(state[k]) for k in ("directions", "idf", "singular")))


#: Columns of a table of counts: a text's places and how often each occurs, as bytes.
COUNTS = ("_places", "_counts")


def _counts(rows: DataFrame, text_col: str, features: int) -> tuple[str, DataFrame]:
    """The counted words of every text with the other columns, written to the shared folder: (its path, the table)."""
    spark = rows.sparkSession
    kept = [f for f in rows.schema if f.name != text_col]
    schema = T.StructType([*kept, *(T.StructField(c, T.BinaryType()) for c in COUNTS)])
    small = _place_type(features)

    def count(batches):
        for batch in batches:
            texts, start = batch.column("_text"), 0
            for part in parts(texts):
                at, n, sizes = counted_all(part.to_pylist(), features)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                made = [_as_binary(x, ends) for x in (at.astype(small), n.astype(np.uint32))]
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name).slice(start, len(part)) for f in kept), *made], names=schema.names)
                start += len(part)

    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    rows.select(*[f.name for f in kept], F.col(text_col).cast("string").alias("_text")).mapInArrow(count, schema).write.option("compression", "zstd").parquet(path)
    return path, spark.read.schema(schema).parquet(path)


def _place_type(features: int) -> type:
    return np.uint16 if features <= 1 << 16 else np.uint32


def _as_binary(x: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = (ends * x.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x))])


def _read(places: pa.Array, counts: pa.Array, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stored counts as ``counted_all`` gives them."""
    at, n = (np.frombuffer(b"".join(c.to_pylist()), t) for c, t in ((places, _place_type(features)), (counts, np.uint32)))
    return at, n, pc.binary_length(counts).to_numpy(zero_copy_only=False).astype(np.int64) // 4


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _frequencies(rows: DataFrame, features: int) -> tuple[int, np.ndarray]:
    """The number of texts, and of those that each feature occurs in."""

    def sums(batches):
        total, df = 0, np.zeros(features, np.int64)
        for batch in batches:
            df += np.bincount(_read(*batch.columns, features)[0], minlength=features)
            total += batch.num_rows
        hit = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *hit.tolist()], pa.int32()), pa.array([total, *df[hit].tolist()], pa.int64())], names=["at", "n"])

    df, total = np.zeros(features), 0
    for k, n in rows.mapInArrow(sums, "at int, n long").groupBy("at").agg(F.sum("n")).collect():  # at most ``features`` rows, and one
        if k < 0:
            total = n
        else:
            df[k] = n
    return total, df


def _product(rows: DataFrame, basis: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The transposed matrix times the matrix times ``basis``, in one pass over its rows."""
    shared = rows.sparkSession.sparkContext.broadcast((basis, idf))  # features x width numbers
    features, width = basis.shape

    def multiply(batches):
        from pyspark import TaskContext

        basis, idf = shared.value
        out = np.zeros((features, width))
        for batch in batches:
            for part in _chunks(*_read(*batch.columns, features), idf):
                part.twice(basis, out)
        blocks = range(0, features, BLOCK)
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([b // BLOCK for b in blocks], pa.int32()), pa.array([task] * len(blocks), pa.int32()), pa.array([out[b : b + BLOCK].tobytes() for b in blocks], pa.binary())], names=["block", "task", "data"])

    def add(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("task").to_numpy(), kind="stable").tolist()
        total = np.frombuffer(table.column("data")[order[0]].as_py()).copy()
        for i in order[1:]:
            total += np.frombuffer(table.column("data")[i].as_py())
        return pa.table({"block": table.column("block").slice(0, 1), "data": pa.array([total.tobytes()], pa.binary())})

    found = rows.mapInArrow(multiply, "block int, task int, data binary").groupBy("block").applyInArrow(add, "block int, data binary").collect()
    if not found:
        return np.zeros_like(basis)
    return np.concatenate([np.frombuffer(r["data"]).reshape(-1, width) for r in sorted(found, key=lambda r: r["block"])])
