"""Query of the media round trip over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brainstate.llm.common import table
from brainstate.llm.media import features, with_media

NAME = "op5_media_jpeg"
SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(with_media(table(spark, sf_dir, "documents").select("doc_id", "text")))
