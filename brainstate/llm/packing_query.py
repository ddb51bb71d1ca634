"""Query of packing all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brainstate.llm.common import table
from brainstate.llm.packing import pack_documents

NAME = "op2_best_fit_packing"
SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
