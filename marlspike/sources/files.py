"""File sources: binary files to pages of text.

The extractor is pluggable: a function from bytes to a list of page texts.  PDF is read
by ``pypdf`` where it is installed, else by this package's own reader; in plain text,
form feeds part the pages.
"""

from __future__ import annotations

import io
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import file_name
from ..operators.batches import parts
from . import pdf

try:
    from pypdf import PdfReader
except ImportError:
    PdfReader = None

# Messages that callers compare.
NOT_PDF = "File must be a PDF (.pdf extension required)"
TOO_LARGE = "File size exceeds maximum limit of {}MB"
LONG_NAME = "Filename too long (maximum {} characters)"
NO_TEXT = "No text content found in PDF"

Extractor = Callable[[bytes], list[str | None]]


def text_pages(data: bytes) -> list[str | None]:
    """Pages of a plain-text file."""
    return list(data.decode("utf-8", "replace").split("\f"))


def pdf_pages(data: bytes) -> list[str | None]:
    """Pages of a PDF; a page that cannot be read is None."""
    if PdfReader is None:
        return pdf.page_texts(data)
    out: list[str | None] = []
    for page in PdfReader(io.BytesIO(data)).pages:
        try:
            out.append(page.extract_text() or "")
        except Exception:  # one bad page does not lose the others
            out.append(None)
    return out


def pdf_info(data: bytes) -> dict[str, str]:
    """Title, author, subject and creator of a PDF that has an info dictionary, else nothing."""
    if PdfReader is None:
        return pdf.info(data)
    info = PdfReader(io.BytesIO(data)).metadata
    return {k: str(info.get(f"/{k.capitalize()}") or "") for k in ("title", "author", "subject", "creator")} if info else {}


def read_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """Files with path, name, size, content and SHA-256 of the content."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return with_hash(found)


def with_hash(files: DataFrame) -> DataFrame:
    return files.select("path", file_name(F.col("path")).alias("file_name"), F.col("length").alias("file_size"), F.sha2("content", 256).alias("file_hash"), "content")


def extracted(files: DataFrame, extractor: Extractor = pdf_pages, info: Callable[[bytes], dict[str, str]] | None = None) -> DataFrame:
    """One row for each file: page texts, full text, number of pages, info, or an error."""
    schema = T.StructType.fromDDL("path string, file_name string, file_size bigint, file_hash string, num_pages int, page_texts array<struct<page_number: int, text: string>>, full_text string, info map<string,string>, error string")
    fields = to_arrow_schema(schema)

    def read(batches):
        for batch in batches:
            at = 0
            for part in parts(batch.column("content")):
                rows = []
                for r in batch.slice(at, len(part)).to_pylist():
                    pages, found, error = [], {}, None
                    count = 0
                    try:
                        texts = extractor(bytes(r["content"]))
                        count = len(texts)
                        pages = [{"page_number": k, "text": t.strip()} for k, t in enumerate(texts, 1) if t and t.strip()]
                        found = info(bytes(r["content"])) if info else {}
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                    whole = "".join(f"\n\n--- Page {p['page_number']} ---\n\n{p['text']}" for p in pages).strip()
                    rows.append((r["path"], r["file_name"], r["file_size"], r["file_hash"], count, pages, whole, list(found.items()), error if error or whole else NO_TEXT))
                at += len(part)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), fields)], schema=fields)

    return files.mapInArrow(read, schema)


def upload_error(name, size, max_bytes: int, max_name: int):
    """Why an upload is refused, or null; a size of null or 0 is unknown and passes."""
    return (
        F.when(F.coalesce(name, F.lit("")) == "", F.lit(NOT_PDF))
        .when(~F.lower(name).endswith(".pdf"), F.lit(NOT_PDF))
        .when(F.coalesce(size, F.lit(0)) > max_bytes, F.lit(TOO_LARGE.format(max_bytes // (1024 * 1024))))
        .when(F.length(name) > max_name, F.lit(LONG_NAME.format(max_name)))
    )
