"""Scoring and ranking: cosine top-k, boosted top-k with its fallbacks, nearest, similar.

Candidates are rows (id, document, embedding, metadata, pos...); ``pos`` columns give
the candidates' order and break ties.  A single query is a literal in the plan, so a
top-k is one scan and ``TakeOrderedAndProject``.  The boost depends on positions
among at most ``2^max_qubits`` candidates: one aggregate row decides the path first,
and only on the boosted path are those rows numbered, in one task up to ``ROWS_BLOCK``
and by ranges of their order beyond.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.group import GroupedData
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.amplify import Amplification, boosted, target
from ..functions.text import low_information
from ..functions.vectors import cosine_to, literal, squared_distance
from ..settings import DEFAULTS, Settings
from ..sources.collection import scratch_dir

# Method and reason labels of a ranked result.
CLASSICAL, FALLBACK, BOOSTED, NONE = "classical", "classical_fallback", "quantum_enhanced", "none"
NO_MARKED, TOO_MANY, NO_CANDIDATES, FAILED = "no_marked_items", "too_many_documents", "no_candidates", "retrieval_error"

#: Rows of a block of candidates that one task ranks.
ROWS_BLOCK = 50_000
#: Rows and queries that are scored at once within it.
ROWS_PART, QUERIES_PART = 1024, 2048


def scored(candidates: DataFrame, query: Sequence[float], digits: int | None = None, strict: bool = True) -> DataFrame:
    """``similarity_score`` and ``low_information`` for each candidate.

    ``strict=False`` gives every candidate 0 if any vector has another length.
    """
    if not strict and candidates.where(misfit(query)).limit(1).count():
        return unscored(candidates)
    score = cosine_to(F.col("embedding"), query)
    if digits is not None:
        score = F.round(score, digits)
    return candidates.withColumns({"similarity_score": score, "low_information": low(candidates)})


def misfit(query: Sequence[float]) -> Column:
    """Whether a candidate's vector is missing or of another length than the query's."""
    return F.coalesce(F.size("embedding"), F.lit(-1)) != len(query)


def unscored(candidates: DataFrame) -> DataFrame:
    """All candidates with score 0."""
    return candidates.withColumns({"similarity_score": F.lit(0.0), "low_information": low(candidates)})


def low(candidates: DataFrame) -> Column:
    """The stored ``low_information`` flag (null: low), or else the rule over ``document``."""
    if "low_information" in candidates.columns:
        return F.coalesce("low_information", F.lit(True))
    return low_information(F.col("document"))


def informative_first(ranked: DataFrame, top_k: int, order: Sequence[str], score: str = "similarity_score") -> DataFrame:
    """The best ``top_k``: informative rows first, then low-information ones, each by score and position."""
    return ranked.orderBy(F.col("low_information").asc(), F.col(score).desc(), *[F.col(c).asc() for c in order]).limit(top_k)


def classical(candidates: DataFrame, query: Sequence[float], top_k: int = 5, order: Sequence[str] = ("ingest_seq", "id"), method: str = CLASSICAL, digits: int | None = None, strict: bool = True) -> DataFrame:
    """Top-k by cosine."""
    return informative_first(scored(candidates, query, digits, strict), top_k, order).withColumn("search_method", F.lit(method))


def numbered(rows: DataFrame, count: int, order: Sequence[str]) -> DataFrame:
    """``rows`` with their place in ``order``, from 0, as ``pos``.

    More than ``ROWS_BLOCK`` rows are stored in ranges of their order first, so that none of
    them is numbered apart from the range it was counted in; a place is that in its
    range after the sizes of the ranges before.
    """
    by = [F.col(c).asc() for c in order]
    if count <= ROWS_BLOCK:
        return rows.withColumn("pos", (F.row_number().over(Window.orderBy(*by)) - 1).cast("long"))
    spark = rows.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    dealt = rows.repartitionByRange(-(-count // ROWS_BLOCK) * 4, *by).sortWithinPartitions(*by)
    dealt.withColumns({"_part": F.spark_partition_id(), "pos": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}).write.parquet(path)
    held = spark.read.parquet(path)
    before, starts = 0, []
    for part, n in held.groupBy("_part").count().orderBy("_part").collect():  # one row for each range
        starts.append((part, before))
        before += n
    known = F.broadcast(spark.createDataFrame(starts, "_part int, _start long"))
    return held.join(known, "_part").withColumn("pos", F.col("pos") + F.col("_start")).drop("_part", "_start")


def amplified(rows: DataFrame, amp: Amplification, order: Sequence[str], boost: float, bit_order: str = "reference") -> DataFrame:
    """Positions, probabilities and enhanced scores of at most 2^qubits rows with column ``marked``."""
    placed = numbered(rows, amp.count, order)
    hit = placed.where("marked").select(target(F.col("pos"), amp.qubits, bit_order).alias("_hit"))
    joined = placed.join(F.broadcast(hit) if amp.marked <= ROWS_BLOCK else hit, placed["pos"] == hit["_hit"], "left")
    p = F.when(F.col("_hit").isNotNull(), F.lit(amp.on_marked)).otherwise(F.lit(amp.on_others))
    return joined.withColumn("quantum_probability", p).withColumn("enhanced_score", boosted(F.col("similarity_score"), F.col("quantum_probability"), boost)).drop("_hit")


def boosted_search(candidates: DataFrame, query: Sequence[float], threshold: float = 0.7, top_k: int | None = 5, order: Sequence[str] = ("ingest_seq", "id"), settings: Settings = DEFAULTS, bit_order: str = "reference", digits: int | None = None, strict: bool = True) -> tuple[DataFrame, str, str | None, Amplification]:
    """Top-k by boosted score, or by cosine where boosting does not apply: rows, method, reason, parameters.

    ``strict=False`` gives every candidate the score 0 if any vector has another length.

    ``top_k=None`` gives all rows of the boosted path, or all candidates.
    """
    rows = scored(candidates, query, digits).withColumn("marked", F.col("similarity_score") >= threshold)
    count, marked, misfits = rows.agg(F.count("*"), F.count_if("marked"), F.count_if(misfit(query))).first()
    if misfits and not strict:
        rows = unscored(candidates).withColumn("marked", F.lit(threshold <= 0))
        marked = count if threshold <= 0 else 0
    amp = Amplification.of(count, marked, settings)
    method, reason = BOOSTED, None
    if not count:
        method, reason = NONE, NO_CANDIDATES
    elif not marked:
        method, reason = FALLBACK, NO_MARKED
    elif count > settings.max_boosted:
        method, reason = FALLBACK, TOO_MANY
    if method == BOOSTED:
        found = amplified(rows, amp, order, settings.boost, bit_order).withColumn("classical_similarity", F.col("similarity_score"))
        if digits is not None:
            found = found.withColumn("enhanced_score", F.round("enhanced_score", digits))
        found = found.withColumn("similarity_score", F.col("enhanced_score"))
    else:
        nothing = F.lit(None).cast("double")
        found = rows.withColumns({"pos": nothing.cast("long"), "classical_similarity": nothing, "quantum_probability": nothing, "enhanced_score": nothing})
    found = found.withColumn("search_method", F.lit(method))
    return (found if top_k is None else informative_first(found, top_k, order)), method, reason, amp


def nearest(candidates: DataFrame, query: Sequence[float], n: int = 5, order: Sequence[str] = ("ingest_seq", "id"), digits: int | None = None) -> DataFrame:
    """The ``n`` nearest by squared L2 distance, exactly; the score is 1 - distance."""
    distance = squared_distance(F.col("embedding"), literal(query))
    distance = distance if digits is None else F.round(distance, digits)
    rows = candidates.withColumn("distance", distance).orderBy(F.col("distance").asc_nulls_last(), *[F.col(c).asc() for c in order]).limit(n)
    return rows.withColumn("similarity_score", F.lit(1.0) - F.col("distance"))


def similar(candidates: DataFrame, id_value, top_k: int = 5, id_col: str = "id", order: Sequence[str] = ("ingest_seq", "id"), digits: int | None = None) -> DataFrame:
    """The nearest rows of a stored one, itself left out; no rows if the id is not stored."""
    own = candidates.where(F.col(id_col) == F.lit(id_value)).select("embedding").first()
    if own is None:
        return nearest(candidates.limit(0), [], top_k, order)
    return nearest(candidates.where(F.col(id_col) != F.lit(id_value)), own[0], top_k, order, digits)


def _rounded(x: np.ndarray, digits: int | None) -> np.ndarray:
    """Half up in decimal, as SQL rounds doubles."""
    if digits is None:
        return x
    unit = 10.0**digits
    scaled = x * unit
    out = np.floor(scaled + 0.5) / unit
    for k in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6):
        out[k] = float(Decimal(repr(float(x[k]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


def grid(queries: DataFrame, n: int, rows: DataFrame, spread: Sequence[str], query_id: str, block: int, rows_block: int) -> tuple[GroupedData, GroupedData]:
    """Queries and rows dealt into blocks of which each pair meets in one group, for ``cogroup``.

    Queries go to blocks of about ``block`` by a hash of their id and rows to blocks of about
    ``rows_block`` by a hash of ``spread``; a block travels once for each block of the
    other side, and no pairs are built.
    """
    asked = max(1, -(-n // block))
    held = max(-(-rows.count() // rows_block), 1 if asked > 1 else int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    of = lambda names, parts: F.pmod(F.xxhash64(*names), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = queries.withColumn("_q", of([query_id], asked)).withColumn("_r", every(held))
    right = rows.withColumn("_r", of(spread, held)).withColumn("_q", every(asked))
    return left.groupBy("_q", "_r"), right.groupBy("_q", "_r")


def _vectors(rows: DataFrame, name: str) -> Column:
    """Vectors as they are if of floats or doubles, so that floats travel as floats, or else as doubles."""
    kept = rows.schema[name].dataType.simpleString() in ("array<float>", "array<double>")
    return F.col(name) if kept else F.col(name).cast("array<double>")


def _best_rows(queries: DataFrame, n: int, candidates: DataFrame, low_: Column, top_k: int, query_id: str, order: Sequence[str], digits: int | None, block: int, scores: Callable[[pa.ListArray, _Queries], np.ndarray], sign: int = 1) -> DataFrame:
    """(query_id, the candidates' columns, low, score): the ``top_k`` best rows of each query in each block of candidates.

    A group has a block of queries and a block of candidates, scores them by matrix
    products and keeps ``top_k`` rows for each query; neither side meets on the driver or in one task.
    """
    kept = [c for c in candidates.columns if c not in ("embedding", "document", "low_information")]
    rows = candidates.select(F.struct(*kept).alias("row"), low_.alias("low"), _vectors(candidates, "embedding").alias("embedding"))
    schema = T.StructType([queries.schema[query_id], T.StructField("row", rows.schema["row"].dataType), T.StructField("low", T.BooleanType()), T.StructField("score", T.DoubleType())])
    id_type = to_arrow_type(schema[0].dataType)
    margin = 0.0 if digits is None else 10.0**-digits
    asked, held = grid(queries.select(query_id, _vectors(queries, "query").alias("query")), n, rows, [*[f"row.{c}" for c in order], "embedding"], query_id, block, ROWS_BLOCK)

    def rank(asked: pa.Table, table: pa.Table) -> pa.Table:
        row = table.column("row").combine_chunks()
        embeddings, lows = table.column("embedding").combine_chunks(), np.array(table.column("low").to_pylist(), bool)
        place = _places([row.field(kept.index(c)) for c in order], len(table))
        queries = asked.column("query").combine_chunks()
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]  # query, row and exact score
        for first in range(0, len(asked) if len(table) else 0, QUERIES_PART):
            best = _best(embeddings, lows, place, _Queries(queries.slice(first, QUERIES_PART)), top_k, margin, lambda x: np.sign(sign) * _rounded(sign * x, digits), scores)
            found = [np.concatenate(x) for x in zip(found, (best[0] + first, *best[1:]))]
        ids = asked.column(query_id).combine_chunks().take(pa.array(found[0])).cast(id_type)
        return pa.table({query_id: ids, "row": row.take(pa.array(found[1])), "low": pa.array(lows[found[1]]), "score": pa.array(found[2])})

    return asked.cogroup(held).applyInArrow(rank, schema).select(query_id, "row.*", "low", "score")


def _places(columns: list[pa.Array], count: int) -> np.ndarray:
    """Each row's place in the order of these columns, nulls first; equal rows as they come."""
    if not columns:
        return np.arange(count)
    names = [str(k) for k in range(len(columns))]
    sorted_ = pc.sort_indices(pa.table(columns, names=names), sort_keys=[(k, "ascending") for k in names], null_placement="at_start")
    out = np.empty(count, np.int64)
    out[sorted_.to_numpy()] = np.arange(count)
    return out


def _best(vectors: pa.ListArray, lows: np.ndarray, place: np.ndarray, queries: _Queries, top_k: int, margin: float, exact: Callable[[np.ndarray], np.ndarray], scores: Callable[[pa.ListArray, _Queries], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, exact score) of the ``top_k`` rows of each query, by low, score and place; a part of the rows at a time."""
    query, row, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    least = np.full(queries.count, -np.inf)  # what a row must reach, with 10 less for low information
    for start in range(0, len(vectors), ROWS_PART):
        part = scores(vectors.slice(start, ROWS_PART), queries)
        flags = lows[start : start + ROWS_PART]
        value = part - 10.0 * flags[:, None] if flags.any() else part
        hit = value >= least - margin
        if len(value) > top_k and np.count_nonzero(hit) > 4 * top_k * queries.count:  # what is below its own top_k cannot stay either
            least = np.maximum(least, _reached(value, top_k) - margin)
            hit = value >= least - margin
        i, q = np.divmod(np.flatnonzero(hit), queries.count)
        some = value[i, q] > -np.inf
        i, q = i[some], q[some]
        if not len(q):
            continue
        again = np.zeros(queries.count, bool)
        again[q] = True
        old = again[query]
        qs, rows, s = np.concatenate([query[old], q]), np.concatenate([row[old], i + start]), np.concatenate([score[old], exact(part[i, q])])
        by = np.lexsort((place[rows], -s, lows[rows], qs))
        qs, rows, s = qs[by], rows[by], s[by]
        nth = np.arange(len(qs)) - np.searchsorted(qs, qs)
        stay = nth < top_k
        last = nth == top_k - 1
        least[qs[last]] = s[last] - 10.0 * lows[rows[last]]
        query, row, score = (np.concatenate([a[~old], b[stay]]) for a, b in ((query, qs), (row, rows), (score, s)))
    return query, row, score


def _reached(value: np.ndarray, top_k: int) -> np.ndarray:
    """What ``top_k`` rows of each column reach: the ``top_k``-th best of the maxima of groups of rows, which is close to that of all."""
    groups = 8 * top_k
    if len(value) >= 2 * groups:
        value = value[: len(value) // groups * groups].reshape(-1, groups, value.shape[1]).max(axis=0)
    return np.partition(value, -top_k, axis=0)[-top_k]


class _Queries:
    """Vectors of queries by length: (their places, the matrix, their norms)."""

    def __init__(self, vectors: pa.ListArray):
        self.count = len(vectors)
        self.of = {n: (at, m, np.sqrt((m * m).sum(axis=1))) for n, at, m in _by_size(vectors)}


def _by_size(vectors: pa.ListArray):
    """(length, places, matrix) of vectors of each length."""
    sizes = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    for n in np.unique(sizes).tolist():
        if n >= 0:
            at = np.flatnonzero(sizes == n)
            own = vectors if len(at) == len(sizes) else vectors.take(pa.array(at))
            yield n, at, own.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), n)


def _pairs(vectors: pa.ListArray, queries: _Queries, others: float, score: Callable[..., np.ndarray]) -> np.ndarray:
    """``score`` of the matrices and norms of every length that both have, ``others`` elsewhere."""
    out = None
    for n, rows, a in _by_size(vectors):
        if n in queries.of:
            columns, b, size = queries.of[n]
            with np.errstate(all="ignore"):
                found = score(a, np.sqrt((a * a).sum(axis=1)), b, size)
            if found.shape == (len(vectors), queries.count):
                return found
            out = np.full((len(vectors), queries.count), others) if out is None else out
            out[np.ix_(rows, columns)] = found
    return np.full((len(vectors), queries.count), others) if out is None else out


def _cosines(vectors: pa.ListArray, queries: _Queries) -> np.ndarray:
    """Cosine of every vector with every query, 0 to 1; 0 where one is zero, not a number, missing or of another length."""

    def score(a, size, b, sizes):
        found = a @ b.T
        found /= size[:, None] * sizes
        if not all(((x > 1e-100) & (x < 1e100)).all() for x in (size, sizes)):
            found[~np.isfinite(found)] = 0.0
        return np.maximum(found, 0.0, out=found)

    return _pairs(vectors, queries, 0.0, score)


def _nearness(vectors: pa.ListArray, queries: _Queries) -> np.ndarray:
    """Minus the squared L2 distance of every vector and every query; below everything where one is missing or of another length."""

    def score(a, _, b, __):
        found = -np.maximum(0.0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T))
        found[~np.isfinite(found)] = -np.inf
        return found

    return _pairs(vectors, queries, -np.inf, score)


def batch_top_k(queries: DataFrame, candidates: DataFrame, top_k: int, query_id: str, order: Sequence[str], digits: int | None = None, max_queries: int | None = None, block: int = 4096) -> DataFrame:
    """Top-k by cosine for each query (columns ``query_id``, ``query``) over all candidates.

    Returns query_id, the candidates' columns without vector and text, low_information,
    similarity_score and rank.  ``max_queries`` refuses more queries than that.
    """
    n = queries.count()
    if max_queries is not None and n > max_queries:
        raise ValueError(f"more than {max_queries} queries")
    found = _best_rows(queries, n, candidates, low(candidates), top_k, query_id, order, digits, block, _cosines)
    found = found.withColumnsRenamed({"low": "low_information", "score": "similarity_score"})
    by = Window.partitionBy(query_id).orderBy(F.col("low_information").asc(), F.col("similarity_score").desc(), *[F.col(c).asc() for c in order])
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top_k)


def _nearest_rows(found: DataFrame, top_k: int, query_id: str, order: Sequence[str]) -> DataFrame:
    found = found.drop("low").withColumn("distance", F.abs("score")).drop("score").withColumn("similarity_score", F.lit(1.0) - F.col("distance"))
    by = Window.partitionBy(query_id).orderBy(F.col("distance").asc(), *[F.col(c).asc() for c in order])
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top_k)


def batch_nearest(queries: DataFrame, candidates: DataFrame, top_k: int, query_id: str, order: Sequence[str], digits: int | None = None, block: int = 4096) -> DataFrame:
    """The ``top_k`` nearest by squared L2 distance for each query, exactly; candidates without a vector of that length are left out."""
    found = _best_rows(queries, queries.count(), candidates, F.lit(False), top_k, query_id, order, digits, block, _nearness, -1)
    return _nearest_rows(found, top_k, query_id, order)


def random_projection_index(vectors: DataFrame, bucket_length: float = 0.5, tables: int = 8, seed: int = 11):
    """Approximate variant of ``nearest``: a fitted random-projection LSH model and its indexed rows.

    Use ``model.approxNearestNeighbors(indexed, Vectors.dense(query), n)``.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    rows = vectors.withColumn("_vector", array_to_vector(F.col("embedding").cast("array<double>")))
    model = BucketedRandomProjectionLSH(inputCol="_vector", outputCol="_hashes", bucketLength=bucket_length, numHashTables=tables, seed=seed).fit(rows)
    return model, model.transform(rows)
