"""Query of toxicity scores over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brainstate.llm.common import fold, table
from brainstate.llm.toxicity import learn, with_scores

NAME = "op4_toxicity"
SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = learn(docs, labels.filter(fold(F.col("doc_id"), 4) != 2))
    return with_scores(docs, model).select(
        "doc_id",
        (fold(F.col("doc_id"), 4) == 2).alias("held_out"),
        "toxicity.score",
        "toxicity.predicted",
        "toxicity.hits",
    )
