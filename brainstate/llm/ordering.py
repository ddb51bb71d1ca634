"""Numbers of rows in an order, without a task that holds a whole group.

Rows are dealt to ranges of the order and sorted there; a row's number is its place in its range and the rows
of its group in the ranges before. Equal rows may stand in any order; all else is fixed by the columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brainstate.llm.common import stored

_IN_RANGE = (1 << 33) - 1


def ranked(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """rows, stored in ranges of an order: with range, the number of a row's range, and place, its place there from 0.

    rows should be stored already: their order is sampled first, which reads them twice.
    """
    at = F.monotonically_increasing_id()
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(
        ordered.withColumn("range", F.shiftright(at, 33).cast("int")).withColumn("place", at.bitwiseAND(F.lit(_IN_RANGE))), name
    )


def offsets(ordered: DataFrame, *group: str) -> DataFrame:
    """(group, range, first, before, n): for each range that holds rows of a group the first one's place, the group's rows
    in earlier ranges, and in all. As many rows as ranges and groups, of which no group has more than there are ranges."""
    parts = ordered.groupBy(*group, "range").agg(F.min("place").alias("first"), F.count("*").alias("here"))
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(
        *group, "range", "first",
        F.coalesce(F.sum("here").over(earlier), F.lit(0)).alias("before"), F.sum("here").over(whole).alias("n"),
    )


def md5_number(text: Column) -> Column:
    """The first 60 bits of a text's MD5."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
