"""Query of the WARC round trip over all pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brainstate.llm.common import table
from brainstate.llm.warc import MIN_REVISIT, round_trip

NAME = "op9_warc"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


SQL = f"""
with p as (
  select page_id, strlen(coalesce(html, '')) as payload_bytes,
         sha256(coalesce(html, '')) as payload_digest
  from pages),
f as (
  select *, case when payload_bytes >= {MIN_REVISIT}
                 then min(page_id) over (partition by payload_digest) end as first_id
  from p)
select page_id, payload_bytes, payload_digest,
       case when first_id <> page_id then 'revisit' else 'response' end as record_type,
       case when first_id <> page_id then first_id end as refers_to
from f
"""
