"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brainstate.llm import (
    html_query,
    licenses_query,
    lm_query,
    media_query,
    merkle_query,
    near_dup_query,
    negatives_query,
    packing_query,
    pieces_query,
    quality_query,
    ring_query,
    toxicity_query,
    warc_query,
)

_MODULES = (
    lm_query,
    packing_query,
    html_query,
    toxicity_query,
    media_query,
    pieces_query,
    quality_query,
    near_dup_query,
    warc_query,
    licenses_query,
    merkle_query,
    ring_query,
    negatives_query,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {m.NAME: m.query for m in _MODULES}
SQL: dict[str, str] = {m.NAME: m.SQL for m in _MODULES if m.SQL}
