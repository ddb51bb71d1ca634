"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brainstate.sources.shared import new_folder, shared_dir, stored

__all__ = ["BLANKS", "GAP", "WORD", "fold", "new_folder", "numbered", "shared_dir", "slices", "stored", "table"]

#: White space of the word rule: space and the controls from tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo folds; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def slices(batches: Iterator[pa.RecordBatch], column: str | int, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of batches in slices whose texts in a column have about `size` bytes; a longer text is alone."""
    for batch in batches:
        texts = batch.column(column)
        wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
        ends = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, int(ends[at]) + size, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def numbered(df: DataFrame) -> DataFrame:
    """df with the column names c0, c1 and so on: maps over batches fail on names with dots."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))
