"""Incremental ingest: new files of a folder into a collection.

An extension; each run takes the files that no earlier run has taken (Structured
Streaming's checkpoint remembers them) and then ends.
"""

from __future__ import annotations

import hashlib
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.embedding import Embedder
from ..plans.ingest import ingest
from ..sources.collection import Collection
from ..sources.files import Extractor, pdf_pages, with_hash

BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def ingest_new(spark: SparkSession, folder: str, glob: str, collection: Collection, embedder: Embedder, checkpoint: str, extractor: Extractor = pdf_pages, session_id: Any = None, user_id: Any = None) -> StreamingQuery:
    """Start a run over the files that are new; wait for it with ``awaitTermination``."""
    files = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", glob).load(folder)

    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def enter(batch, number: int) -> None:
        # a batch of this stream that is delivered again has its number again, so its rows have their ids again
        ingest(with_hash(batch), collection, embedder, extractor, session_id, user_id, delivery=f"stream {stream} batch {number}")

    return files.writeStream.foreachBatch(enter).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
