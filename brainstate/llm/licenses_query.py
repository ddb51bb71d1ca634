"""Query of license matches over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brainstate.llm.common import table
from brainstate.llm.licenses import with_licenses

NAME = "op10_license_scan"
SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # The match with the most words of its template; of equals the first by place.
    most = F.array_max(F.col("licenses")["coverage"])
    best = F.get(F.filter("licenses", lambda x: x["coverage"] == most), F.lit(0))
    return with_licenses(docs).select(
        "doc_id",
        F.size("licenses").cast("long").alias("n_matches"),
        best["license"].alias("license"),
        F.coalesce(most, F.lit(0.0)).alias("coverage"),
        "licenses",
    )
