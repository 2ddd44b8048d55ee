"""The corpus pipeline: five stages over ``documents``, each written and read again.

``run(spark, sf_dir)`` applies ``STAGES`` in order.  Every stage works on all that the
stage before it kept, and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlspike.llm import decontaminate, mixing, simhash, suffixes, toxicity
from marlspike.llm.shared import drop_written, made, written

STAGES = [
    ("toxicity", toxicity.stage),
    ("near duplicates", simhash.stage),
    ("repeated passages", suffixes.stage),
    ("benchmark contamination", decontaminate.stage),
    ("source mix", mixing.stage),
]

#: A trained classifier and XXH64 fingerprints are beyond SQL; the tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all of ``documents``; rows are those of the last stage.

    A stage's intermediate tables, and what the stage before it wrote, go once its own result is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = made()
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop_written(spark, since, docs)
    return docs
