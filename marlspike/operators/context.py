"""Context and prompts for an answer over ranked passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_filled

FALLBACK_ANSWER = "No answer could be written this time. The passages are found, so asking again may help."


def source_label(metadata: Column) -> Column:
    """Title, file name or ``Unknown``."""
    return F.coalesce(first_filled(*[F.try_element_at(metadata, F.lit(k)) for k in ("title", "file_name", "filename")]), F.lit("Unknown"))


def passage(metadata: Column, document: Column) -> Column:
    return F.concat(F.lit("Source: "), source_label(metadata), F.lit("\n"), F.coalesce(document, F.lit("")))


def context_text(ranked: DataFrame, top_k: int, rank: str = "rank") -> DataFrame:
    """One row: the first passages in rank order, a blank line between them."""
    rows = ranked.where(F.col(rank) <= top_k).select(rank, passage(F.col("metadata"), F.col("document")).alias("p"))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank, "p"))), lambda x: x["p"]), "\n\n").alias("context"))


def prompt(question: str, context: str = "", name: str = "an assistant for documents") -> str:
    """The prompt with or without context; generation itself is a pluggable callable."""
    if context:
        return f"You are {name}.\n\nContext from documents:\n{context}\n\nUser question: {question}\n\nUse the context and name its source where it answers the question; answer other questions from general knowledge."
    return f"You are {name}.\n\nUser question: {question}\n\nAnswer helpfully; documents can be uploaded for answers about them."
