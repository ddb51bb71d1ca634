"""Query of near-duplicate classes over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brainstate.llm.common import table
from brainstate.llm.near_dup import classes

NAME = "op8_near_dup"
SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
