"""Splitting texts into chunks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..settings import DEFAULTS
from .batches import parts


def _pieces(text: str, separator: str) -> list[str]:
    """The text cut before each separator, which stays with what follows; no empty pieces."""
    if not separator:
        return list(text)
    head, *rest = text.split(separator)
    return [p for p in [head, *(separator + r for r in rest)] if p]


def _joined(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Pieces joined up to ``size``; each chunk starts with what fits of the last one's end."""
    out: list[str] = []
    held: list[str] = []
    total = 0
    for piece in pieces:
        if held and total + len(piece) > size:
            out.append("".join(held))
            drop = 0
            while total > overlap or (total and total + len(piece) > size):
                total -= len(held[drop])
                drop += 1
            held = held[drop:]
        held.append(piece)
        total += len(piece)
    out.append("".join(held))
    return [c for c in (x.strip() for x in out) if c]


def split_text(text: str | None, size: int = DEFAULTS.chunk_size, overlap: int = DEFAULTS.chunk_overlap, separators: Sequence[str] = DEFAULTS.separators) -> list[str]:
    """Chunks of at most ``size`` characters, cut at the coarsest separator that works.

    The first separator that occurs is used; pieces that are not shorter than ``size``
    are split again with the finer ones.
    """
    if not text:
        return []
    at = next((k for k, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    finer = separators[at + 1 :]
    out: list[str] = []
    short: list[str] = []
    for piece in _pieces(text, separators[at]):
        if len(piece) < size:
            short.append(piece)
            continue
        if short:
            out += _joined(short, size, overlap)
            short = []
        out += split_text(piece, size, overlap, finer) if finer else [piece]
    if short:
        out += _joined(short, size, overlap)
    return out


def cut(batches: Iterator[pa.Array], size: int, overlap: int, separators: Sequence[str]) -> Iterator[pa.Array]:
    """The chunks of each text, for a part of a batch at a time."""
    for batch in batches:
        for part in parts(batch):
            yield pa.array([split_text(t, size, overlap, separators) for t in part.to_pylist()], pa.list_(pa.string()))


def chunks(texts: DataFrame, text_col: str = "text", size: int = DEFAULTS.chunk_size, overlap: int = DEFAULTS.chunk_overlap, separators: Sequence[str] = DEFAULTS.separators) -> DataFrame:
    """One row for each chunk: the other columns, chunk, chunk_id (from 0), chunk_size, total_chunks."""
    separators = tuple(separators)

    @F.arrow_udf("array<string>")
    def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return cut(batches, size, overlap, separators)

    rest = [c for c in texts.columns if c != text_col]
    held = texts.select(*rest, split(F.col(text_col)).alias("_chunks"))
    # posexplode would put a filter on the size below the Python step, which then runs twice
    rows = held.select(*rest, F.size("_chunks").alias("total_chunks"), F.posexplode_outer("_chunks").alias("chunk_id", "chunk")).where(F.col("chunk_id").isNotNull())
    return rows.select(*rest, "chunk_id", F.length("chunk").alias("chunk_size"), "total_chunks", "chunk")


def fixed_windows(texts: DataFrame, text_col: str = "text", size: int = DEFAULTS.chunk_size, overlap: int = DEFAULTS.chunk_overlap) -> DataFrame:
    """Plain windows of ``size`` characters, ``overlap`` shared, without Python."""
    rest = [c for c in texts.columns if c != text_col]
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.length(text_col) - overlap) / F.lit(step)).cast("int"))
    rows = texts.where(F.length(text_col) > 0).withColumn("_k", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.select(*rest, F.col("_k").alias("chunk_id"), F.expr(f"substring({text_col}, _k * {step} + 1, {size})").alias("chunk"))


def chunk_ids(rows: DataFrame, at: str = "processed_at") -> DataFrame:
    """``id`` = hash_name_time_number, blanks to ``_`` and colons to ``-``; missing parts are ``unknown``.  Another column than the time may tell one entry from the next."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    raw = F.concat_ws("_", part("file_hash"), part("file_name"), part(at), F.col("chunk_id").cast("string"))
    return rows.withColumn("id", F.replace(F.replace(raw, F.lit(" "), F.lit("_")), F.lit(":"), F.lit("-")))
