"""Query of language-model scores over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brainstate.llm.common import table
from brainstate.llm.lm_scoring import score

NAME = "op1_lm_scoring"
SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"))
