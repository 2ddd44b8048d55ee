"""Approximate nearest neighbours: an inverted file of cells with product-quantised codes.

Every vector is stored in the cell of its nearest centre, as a partition of a Parquet
table, beside a code of one byte for every few dimensions.  A query is routed to the
``probes`` nearest cells by a join on the cell; there it meets codes only, and the
``rerank`` rows that look best among all its cells are compared exactly.  So what is
read, sent and computed falls with the cells looked into, and exact distances are made
for ``rerank`` rows of each query.

Centres and code books are fitted to at most ``sample`` vectors (those with the least
hash); the number of probes and of rows to compare follow from the recall that they have
within that sample.  Every row is indexed.  Vectors that are null or of another length
are in the cell -1, which no query looks into; such queries find nothing.

Scale: the driver holds the sample, centres, books and the number of rows of each cell
(``MAX_CELLS`` at most where they are fitted).  Cells are split into blocks of rows and queries, so neither a cell
with a third of all rows nor one that all queries look into is one task.  Distances are
held ``HELD`` at a time, however many rows a batch and cells an index has.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import squared_distance
from .ranking import ROWS_BLOCK, nearest

MAX_CELLS = 16_384
SAMPLE = 20_000
BOOK = 256
GROUP = 4
NOWHERE = -1
#: Distances that are held at once.
HELD = 1 << 20
#: The most cells that are put in order by distances taken term by term, as SQL takes them.
EXACT = 64


def _parts(rows: int, columns: int) -> Iterator[slice]:
    """Slices of ``rows`` with at most ``HELD`` distances to ``columns`` others, a row at least."""
    step = max(1, HELD // max(1, columns))
    return (slice(a, min(a + step, rows)) for a in range(0, rows, step))


def _gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``x`` and ``y``."""
    return np.maximum(0.0, (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2.0 * (x @ y.T))


def _closest(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each row of ``x`` the number of the nearest row of ``y``; of equal ones the lower."""
    return np.concatenate([np.zeros(0, np.int64), *(_gaps(x[s], y).argmin(axis=1) for s in _parts(len(x), len(y)))])


def _means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """``k`` centres of ``x`` by Lloyd's rounds; a centre without rows stays where it is."""
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]]
    for _ in range(rounds):
        near = _closest(x, centres)
        centres = np.array([x[near == j].mean(axis=0) if (near == j).any() else c for j, c in enumerate(centres)])
    return centres


@dataclass
class CellIndex:
    """Centres (cells x dimensions), code books, and how far a query looks; ``path`` once it is written."""

    centres: np.ndarray
    books: list[np.ndarray]
    probes: int
    rerank: int
    path: str = ""
    schema: T.StructType | None = None
    rows: dict[int, int] = field(default_factory=dict)

    @classmethod
    def fit(cls, rows: DataFrame, cells: int | None = None, sample: int = SAMPLE, recall: float = 0.97, top_k: int = 10, rounds: int = 8, seed: int = 11) -> CellIndex:
        """Centres, books, probes and rows to compare from a sample of ``rows`` (column ``embedding``)."""
        held = rows.where("embedding is not null").select(F.col("embedding").cast("array<double>").alias("e")).orderBy(F.xxhash64("e"), "e").limit(sample).collect()
        size = max((len(r[0]) for r in held), default=0)
        x = np.array([r[0] for r in held if len(r[0]) == size and None not in r[0]], np.float64).reshape(-1, max(size, 1))
        x = x[np.isfinite(x).all(axis=1)]
        if not len(x):
            return cls(np.zeros((1, size)), [], 1, 0)
        total = rows.count()
        centres = _means(x, min(len(x), MAX_CELLS, cells or max(1, int(total**0.5))), rounds, seed)
        index = cls(centres, [_means(x[:, k : k + GROUP], min(BOOK, len(x)), rounds, seed + k) for k in range(0, size, GROUP)], len(centres), 1)
        asked = x[:200]
        gap = _gaps(asked, x)
        exact = np.argsort(gap, axis=1, kind="stable")[:, :top_k]
        own = _closest(x, centres)
        depth = (index.nearest_cells(asked)[:, None, :] == own[exact][:, :, None]).argmax(axis=2)  # how far down a query's cells each neighbour's cell is
        index.probes = int(np.quantile(depth, recall, method="higher")) + 1
        looks = index.looks(asked, index.codes(x))
        worse = (looks[:, None, :] < np.take_along_axis(looks, exact, 1)[:, :, None]).sum(axis=2)  # rows whose code looks better than a neighbour's
        # codes mislead among more rows; measured from 2,000 to 50,000 rows, as the root of their number
        index.rerank = int((int(np.quantile(worse, recall, method="higher")) + top_k) * max(1.0, total / len(x)) ** 0.5) + 1
        return index

    @classmethod
    def of(cls, centres: np.ndarray, probes: int) -> CellIndex:
        """An index with given centres that compares all rows of the cells it looks into."""
        return cls(np.asarray(centres, np.float64), [], probes, 0)

    def nearest_cells(self, x: np.ndarray) -> np.ndarray:
        """The cells to look into, nearest first; of equal ones the lower number."""
        n = min(self.probes, len(self.centres))
        out = np.zeros((len(x), n), np.int64)
        size = (self.centres * self.centres).sum(axis=1).max(initial=0.0)
        for s in _parts(len(x), len(self.centres)):
            gap = _gaps(x[s], self.centres)
            if n > EXACT:
                out[s] = np.argsort(gap, axis=1, kind="stable")[:, :n]
                continue
            # matrix products round equal distances apart, so all that may be among the n are taken term by term
            last = gap.min(axis=1, keepdims=True) if n == 1 else np.partition(gap, n - 1, axis=1)[:, n - 1 : n]
            who, what = np.nonzero(gap <= last + 1e-12 * (size + (x[s] * x[s]).sum(axis=1, keepdims=True)))
            how = np.concatenate([((x[s][who[p]] - self.centres[what[p]]) ** 2).sum(axis=1) for p in _parts(len(who), x.shape[1])])
            order = np.lexsort((what, how, who))
            out[s] = what[order][np.searchsorted(who[order], np.arange(len(gap)))[:, None] + np.arange(n)]
        return out

    def codes(self, x: np.ndarray) -> np.ndarray:
        """One byte for each ``GROUP`` dimensions."""
        parts = [_closest(x[:, GROUP * k : GROUP * k + GROUP], book) for k, book in enumerate(self.books)]
        return np.array(parts, np.uint8).T.reshape(len(x), len(self.books))

    def looks(self, asked: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Distances of queries to what the codes stand for."""
        out = np.zeros((len(asked), len(codes)))
        for k, book in enumerate(self.books):
            out += _gaps(asked[:, GROUP * k : GROUP * k + GROUP], book)[:, codes[:, k]]
        return out

    def write(self, rows: DataFrame, path: str) -> CellIndex:
        """Store ``rows`` by cell under ``path`` (columns stay; ``cell``, ``place`` and ``code`` are added)."""
        spark = rows.sparkSession
        size = self.centres.shape[1]

        def place(batches):
            for batch in batches:
                vectors = batch.column("_vector")
                fits = (vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == size) if len(vectors) else np.zeros(0, bool)
                cell, code = np.full(len(vectors), NOWHERE, np.int32), [b""] * len(vectors)
                if fits.any():
                    at = np.flatnonzero(fits)
                    x = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), size)
                    found = np.isfinite(x).all(axis=1)
                    at, x = at[found], x[found]
                    cell[at] = CellIndex(self.centres, [], 1, 0).nearest_cells(x)[:, 0]
                    for i, c in zip(at.tolist(), self.codes(x)):
                        code[i] = c.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(cell), pa.array(code, pa.binary())], names=["_row", "cell", "code"])

        packed = rows.select(F.struct(*rows.columns).alias("_row"), F.col("embedding").cast("array<double>").alias("_vector"))
        placed = packed.mapInArrow(place, T.StructType([packed.schema["_row"], *T.StructType.fromDDL("cell int, code binary").fields]))
        spread = F.pmod(F.xxhash64("code"), F.lit(max(1, rows.count() // (len(self.centres) * 4 * ROWS_BLOCK))))
        stored = placed.repartition("cell", spread).select("_row.*", "cell", "code", F.monotonically_increasing_id().alias("place"))
        stored.write.partitionBy("cell").parquet(f"{path}/vectors")
        found = CellIndex(self.centres, self.books, self.probes, self.rerank, path, stored.schema)
        found.rows = {r[0]: r[1] for r in found.stored(spark).groupBy("cell").count().collect()}
        state = {"schema": stored.schema.json(), "centres": self.centres.tolist(), "books": [b.tolist() for b in self.books], "probes": self.probes, "rerank": self.rerank, "rows": found.rows}
        spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.parquet(f"{path}/index")
        return found

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> CellIndex:
        state = json.loads(spark.read.parquet(f"{path}/index").first()[0])
        return cls(np.array(state["centres"]), [np.array(b) for b in state["books"]], state["probes"], state["rerank"], path, T.StructType.fromJson(json.loads(state["schema"])), {int(k): v for k, v in state["rows"].items()})

    def stored(self, spark: SparkSession, cells: Sequence[int] | None = None) -> DataFrame:
        """The stored rows, of some cells only if they are given: other folders are not opened."""
        rows = spark.read.schema(self.schema).parquet(f"{self.path}/vectors")
        return rows if cells is None else rows.where(F.col("cell").isin([int(c) for c in cells]))

    def routed(self, queries: DataFrame, query_id: str) -> DataFrame:
        """(query_id, query, cell): each query once for each cell that it looks into."""
        centres, probes, size = self.centres, self.probes, self.centres.shape[1]

        @F.pandas_udf("array<int>")
        def cells(vectors: pd.Series) -> pd.Series:
            fits = [v is not None and len(v) == size and bool(np.isfinite(np.asarray(v, np.float64)).all()) for v in vectors]
            out = pd.Series([[]] * len(vectors), dtype=object)
            if any(fits):
                found = CellIndex(centres, [], probes, 0).nearest_cells(np.stack([np.asarray(v, np.float64) for v, fit in zip(vectors, fits) if fit]))
                out[np.flatnonzero(fits)] = [row.tolist() for row in found]
            return out

        vector = F.col("query").cast("array<double>")
        return queries.select(query_id, vector.alias("query"), F.explode(cells(vector)).alias("cell"))

    def shortlisted(self, routed: DataFrame, n: int, query_id: str, block: int = 4096) -> DataFrame:
        """(query_id, cell, place): the ``rerank`` rows of each query whose codes look best.

        A cell's codes are dealt into blocks of about ``ROWS_BLOCK`` and its queries into blocks of about ``block``, and each pair of blocks meets in one group.
        """
        spark = routed.sparkSession
        parts = [(c, max(1, -(-k // ROWS_BLOCK))) for c, k in self.rows.items()] or [(NOWHERE, 1)]  # at most MAX_CELLS rows
        known = lambda: F.broadcast(spark.createDataFrame(parts, "cell int, parts int"))
        asked = [r[0] for r in routed.select("cell").distinct().collect()]  # the same
        blocks = F.lit(max(1, -(-n // block)))
        left = routed.join(known(), "cell").withColumn("_q", F.pmod(F.xxhash64(query_id), blocks).cast("int")).withColumn("_r", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).groupBy("cell", "_q", "_r")
        codes = self.stored(spark, asked).select("cell", "place", "code").join(known(), "cell").withColumn("_r", F.pmod(F.xxhash64("place"), "parts").cast("int"))
        right = codes.withColumn("_q", F.explode(F.sequence(F.lit(0), blocks - 1))).groupBy("cell", "_q", "_r")
        schema = T.StructType([routed.schema[query_id], *T.StructType.fromDDL("cell int, place bigint, looks double").fields])

        def look(asked: pa.Table, table: pa.Table) -> pa.Table:
            query = np.array(asked.column("query").to_pylist(), np.float64)
            codes = np.array([np.frombuffer(c, np.uint8) for c in table.column("code").to_pylist()]).reshape(len(table), len(self.books))
            ids, places = asked.column(query_id).combine_chunks(), table.column("place").to_numpy()
            who, what, how = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
            for k in range(0, len(query) if len(table) else 0, 64):
                found = self.looks(query[k : k + 64], codes)
                most = min(self.rerank, len(codes))
                best = np.argpartition(found, most - 1, axis=1)[:, :most]
                who.append(np.repeat(np.arange(k, k + len(found)), most))
                what.append(places[best].reshape(-1))
                how.append(np.take_along_axis(found, best, 1).reshape(-1))
            who_ = np.concatenate(who)
            cell = (table if len(table) else asked).column("cell")[0].as_py()
            return pa.table({query_id: ids.take(pa.array(who_)), "cell": pa.array([cell] * len(who_), pa.int32()), "place": np.concatenate(what), "looks": np.concatenate(how)})

        found = left.cogroup(right).applyInArrow(look, schema)
        nth = F.row_number().over(Window.partitionBy(query_id).orderBy("looks", "cell", "place"))
        return found.withColumn("_nth", nth).where(F.col("_nth") <= self.rerank).drop("_nth", "looks")

    def search(self, queries: DataFrame, top_k: int, query_id: str, order: Sequence[str], digits: int | None = None) -> DataFrame:
        """The ``top_k`` nearest of each query (columns ``query_id``, ``query``) among the rows that it is compared with: stored columns but the vector, distance, similarity_score, rank."""
        spark = queries.sparkSession
        routed = self.routed(queries, query_id)
        if self.rerank:
            picked = self.shortlisted(routed, queries.count(), query_id).join(queries.select(query_id, F.col("query").cast("array<double>").alias("query")), query_id)
            pairs = picked.join(self.stored(spark), ["cell", "place"])
        else:
            pairs = routed.join(self.stored(spark), "cell")
        distance = squared_distance(F.col("embedding"), F.col("query"))
        found = pairs.withColumn("distance", distance if digits is None else F.round(distance, digits)).drop("embedding", "query", "code", "cell", "place")
        by = Window.partitionBy(query_id).orderBy(F.col("distance").asc(), *[F.col(c).asc() for c in order])
        return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top_k).withColumn("similarity_score", F.lit(1.0) - F.col("distance"))

    def nearest(self, spark: SparkSession, query: Sequence[float], top_k: int, order: Sequence[str], digits: int | None = None) -> DataFrame:
        """The nearest of one query: only the folders of its cells are opened."""
        x = np.asarray(query, np.float64)
        fits = len(x) == self.centres.shape[1] and bool(np.isfinite(x).all())
        cells = self.nearest_cells(x[None, :])[0].tolist() if fits else []
        return nearest(self.stored(spark, cells).drop("cell", "place", "code"), query, top_k, order, digits)
