"""Query of the main text of all pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brainstate.llm.common import table
from brainstate.llm.html_extract import extract

NAME = "op3_html_text"
SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
