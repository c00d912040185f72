"""The core queries and their SQL, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..frames import table
from ..operators import retrieval
from . import chain_queries, convert_queries, leaf_sql, store_queries  # noqa: F401  (they register their queries)
from .queries import QUERIES, SQL, leaves

__all__ = ["QUERIES", "SQL", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse search of the question set over all leaves."""
    asked = table(spark, sf_dir, "requesta_items").select("qid", "question").distinct()
    return retrieval.sparse_search(asked, "qid", "question", leaves(spark, sf_dir), "chunk_id", "source_text", 10)
