"""Ingest: files to pages, text, chunks, vectors and stamped rows."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_filled
from ..operators.chunking import chunk_ids, chunks
from ..operators.embedding import Embedder, embedded
from ..settings import DEFAULTS, Settings
from ..sources.collection import Collection
from ..sources.files import Extractor, extracted, pdf_pages, upload_error


def vectors(files: DataFrame, embedder: Embedder, extractor: Extractor = pdf_pages, session_id: Any = None, user_id: Any = None, processed_at: str | None = None, settings: Settings = DEFAULTS, info=None, delivery: str | None = None) -> DataFrame:
    """Rows (id, document, embedding, metadata) of all chunks of readable files.

    ``delivery`` stands for the time in ids, so that what is delivered again has its ids again.
    """
    at = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") if processed_at is None else F.lit(processed_at)
    texts = extracted(files, extractor, info).where("error is null").withColumns({"processed_at": at, "delivery": at if delivery is None else F.lit(delivery)})
    rows = chunk_ids(chunks(texts.drop("page_texts"), "full_text", settings.chunk_size, settings.chunk_overlap, settings.separators), "delivery")
    name = F.col("file_name")
    pairs: dict[str, Any] = {
        "file_path": F.col("path"), "num_pages": F.col("num_pages"), "processed_at": F.col("processed_at"), "file_size": F.col("file_size"), "file_hash": F.col("file_hash"), "chunk_id": F.col("chunk_id"), "chunk_size": F.col("chunk_size"), "total_chunks": F.col("total_chunks"),
        "original_file_name": name, "source_file_name": name, "file_name": name, "filename": name, "source": F.coalesce(first_filled(F.try_element_at("info", F.lit("title")), name), F.lit("Unknown")),
    }
    pairs |= {k: F.lit(str(v)) for k, v in (("session_id", session_id), ("user_id", user_id)) if v}
    own = F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v.cast("string"))])
    info = F.map_filter("info", lambda k, _: ~k.isin(list(pairs)))
    return embedded(rows.select("id", F.col("chunk").alias("document"), F.map_concat(info, own).alias("metadata")), embedder)


def ingest(files: DataFrame, collection: Collection, embedder: Embedder, extractor: Extractor = pdf_pages, session_id: Any = None, user_id: Any = None, settings: Settings = DEFAULTS, info=None, processed_at: str | None = None, delivery: str | None = None) -> dict[str, Any]:
    """Check, read, cut, embed and store files; refused ones are counted.

    Ids hold the time, so a plain second ingest keeps a copy; with a ``processed_at`` or
    ``delivery`` that comes back the same, rows that are there already are not entered again.
    """
    checked = files.withColumn("error", upload_error(F.col("file_name"), F.col("file_size"), settings.max_upload_bytes, settings.max_name_length))
    good = checked.where("error is null").drop("error")
    added = collection.add(vectors(good, embedder, extractor, session_id, user_id, processed_at, settings, info, delivery))
    return added | {"refused": checked.where("error is not null").count()}


def split_results(files: DataFrame, extractor: Extractor = pdf_pages) -> tuple[DataFrame, DataFrame]:
    """(readable, failed) files; failed ones with path and error."""
    found = extracted(files, extractor)
    return found.where("error is null"), found.where("error is not null").select("path", "error")


def counters(rows: DataFrame) -> DataFrame:
    """One row over stored chunks: chunks, vectors, files and their pages."""
    key = lambda k: F.try_element_at("metadata", F.lit(k))
    files = rows.groupBy(key("file_hash").alias("file_hash")).agg(F.count("*").alias("chunks"), F.count("embedding").alias("vectors"), F.max(key("num_pages").try_cast("long")).alias("pages"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return files.agg(zero("chunks").alias("chunks_created"), zero("vectors").alias("embeddings_stored"), F.count("*").alias("files"), zero("pages").alias("pages_processed"))


def unique_files(files: DataFrame) -> DataFrame:
    """One file of each content (an extension: a plain ingest keeps copies)."""
    return files.dropDuplicates(["file_hash"])
