"""Indexes that Spark keeps in the folder all executors share."""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession

from parlance.operators import index
from parlance.sources.scratch import scratch_dir, written  # noqa: F401
from parlance.sources.tables import read


def passage_index(spark: SparkSession, sf_dir: str) -> index.Index:
    """The index of the table documents; made at the first call of the application for just these files."""
    docs = read(spark, sf_dir, "documents")
    files = hashlib.sha256("\n".join(sorted(docs.inputFiles())).encode()).hexdigest()[:16]
    found = index.Index(f"{scratch_dir(spark)}/passages-{files}")
    if not index.segments(spark, found):
        index.add_segment(found, docs.select("doc_id", "text"))
    return found
