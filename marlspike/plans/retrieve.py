"""Retrieval: filter, rank, envelope; and the answers of the search interface."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.filters import compiled, same_metadata, where_clause
from ..operators import ranking
from ..operators.context import FALLBACK_ANSWER, context_text, prompt
from ..settings import DEFAULTS, Settings
from ..sources.collection import collection_stats
from .requests import ChatRequest

PROMOTED = ("session_id", "user_id", "source_file_name")


@dataclass
class Envelope:
    results: DataFrame | None
    search_method: str
    requested_search_method: str
    fallback_reason: str | None
    candidate_count: int
    retrieval_time_ms: float


def retrieve(rows: DataFrame, query: Sequence[float], top_k: int = 5, threshold: float = DEFAULTS.default_threshold, boosted: bool = True, metadata: dict[str, Any] | None = None, session_id: Any = None, user_id: Any = None, order: Sequence[str] = ("ingest_seq", "id"), settings: Settings = DEFAULTS, digits: int | None = None, strict: bool = False) -> Envelope:
    """Ranked passages within a scope.

    The ``top_k`` rows are ranked and fetched here, so the time covers the ranking and an
    error in it becomes an empty envelope with reason ``retrieval_error``, unless ``strict``.
    """
    began = time.perf_counter()
    wanted = ranking.BOOSTED if boosted else ranking.CLASSICAL

    def envelope(found, method, reason, count):
        return Envelope(found, method, wanted, reason, count, round((time.perf_counter() - began) * 1000, 2))

    try:
        columns = [c for c in rows.columns if c in PROMOTED]
        held = rows.where(compiled(where_clause(None, session_id, user_id), columns) & same_metadata(metadata, columns))
        if boosted:
            found, method, reason, amp = ranking.boosted_search(held, query, threshold, top_k, order, settings, digits=digits, strict=strict)
            count = amp.count
        else:
            count, misfits = held.agg(F.count("*"), F.count_if(ranking.misfit(query))).first()
            method, reason = (ranking.CLASSICAL, None) if count else (ranking.NONE, ranking.NO_CANDIDATES)
            rows_ = ranking.unscored(held) if misfits and not strict else ranking.scored(held, query, digits)
            found = ranking.informative_first(rows_, top_k, order).withColumn("search_method", F.lit(method))
        found = rows.sparkSession.createDataFrame(found.collect(), found.schema)  # top_k rows
        return envelope(found, method, reason, count)
    except Exception:
        if strict:
            raise
        return envelope(None, ranking.NONE, ranking.FAILED, 0)


def envelope_row(spark, e: Envelope, top_k: int) -> DataFrame:
    """The envelope as one row, without the timer."""
    results = min(e.candidate_count, top_k)
    return spark.range(1).select(F.lit(e.search_method).alias("search_method"), F.lit(e.requested_search_method).alias("requested_search_method"), F.lit(e.fallback_reason).cast("string").alias("fallback_reason"), F.lit(e.candidate_count).cast("long").alias("candidate_count"), F.lit(results).cast("long").alias("result_count"))


def search_stats(rows: DataFrame, path: str, settings: Settings = DEFAULTS) -> DataFrame:
    """One row: collection, ranking limits and chunk settings."""
    base = collection_stats(rows, settings.collection, path)
    return base.select("*", F.lit(settings.max_qubits).alias("max_qubits"), F.lit(settings.shots).alias("shots"), F.lit(settings.max_boosted).alias("max_searchable_items"), F.lit(settings.boost).alias("boost_factor"), F.lit(settings.chunk_size).alias("chunk_size"), F.lit(settings.chunk_overlap).alias("chunk_overlap"), F.lit(settings.embedding_model).alias("embedding_model"), F.lit(20).alias("max_results_per_query"))


def file_stats(rows: DataFrame, path: str, settings: Settings = DEFAULTS) -> DataFrame:
    """One row: collection, chunk settings and upload limit."""
    base = collection_stats(rows, settings.collection, path)
    return base.select("*", F.lit(settings.chunk_size).alias("chunk_size"), F.lit(settings.chunk_overlap).alias("chunk_overlap"), F.lit(settings.max_upload_bytes // (1024 * 1024)).alias("max_file_size_mb"))


def chat(rows: DataFrame, request: ChatRequest, embed: Callable[[str], Sequence[float]], generate: Callable[[str], str], settings: Settings = DEFAULTS, digits: int | None = None) -> dict[str, Any]:
    """An answer with the passages of the request's session; retrieval errors leave it without context."""
    scope = request.scope
    context, envelope = "", None
    if scope is not None:
        envelope = retrieve(rows, embed(request.message), request.max_context_results, settings.chat_threshold, True, None, scope, request.user_id, settings=settings, digits=digits)
        if envelope.results is not None:
            ranked = _numbered(envelope.results, request.max_context_results)
            context = context_text(ranked, request.max_context_results).first()[0] or ""
    try:
        answer = generate(prompt(request.message, context))
    except Exception:
        answer = FALLBACK_ANSWER
    return {
        "response": answer, "context_used": bool(context), "search_method": envelope.search_method if envelope else ranking.NONE,
        "fallback_reason": envelope.fallback_reason if envelope else "missing_session_scope", "candidate_count": envelope.candidate_count if envelope else 0, "retrieval_time_ms": envelope.retrieval_time_ms if envelope else 0.0,
    }


def _numbered(results: DataFrame, most: int) -> DataFrame:
    """At most ``most`` ranked rows with their rank."""
    return results.limit(most).withColumn("rank", F.row_number().over(Window.orderBy("low_information", F.col("similarity_score").desc(), "ingest_seq", "id")))
