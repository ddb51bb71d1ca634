"""Query of n-best pieces over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brainstate.llm.common import table
from brainstate.llm.pieces import with_round_trip

NAME = "op6_sentencepiece_nbest"
SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    whole = F.coalesce("text", F.lit(""))
    return with_round_trip(docs).select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_pieces"),
        F.crc32("ids").alias("ids_crc32"),
        F.get("scores", F.lit(0)).alias("best_score"),
        "scores",
        F.md5("decoded").alias("decoded_md5"),
        (F.col("decoded") == whole).alias("round_trip"),
        F.transform("n_ids", F.crc32).alias("n_ids_crc32"),
        F.transform("n_decoded", lambda x: x == whole).alias("n_round_trip"),
    )
