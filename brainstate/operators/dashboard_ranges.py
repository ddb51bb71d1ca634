"""Dashboard series (DW1 to DW4) of long sessions: the same rows as operators.dashboard, by ranges of their order.

Rows are sorted in ranges of (session, time), which a session of any length spreads over. What a range passes to
the later ones of its session (rows so far, last values, greatest stamp) or to the one before (its first time) is one summary row,
so no task sorts a session, only a range of it or its summaries. Rows of equal session and time are in one range;
their order among each other is open, as it is in the window forms. Rows without a session count as those of one session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brainstate.operators.dashboard import ticks_of
from brainstate.sources.ranges import offsets, ranked

#: Rows of a session that one task averages; it has the n - 1 before them too.
BLOCK = 65_536


def _dealt(rows: DataFrame, order: str, ranges: int | None) -> DataFrame:
    """(session_id, row, range, place): rows as structs, so that no column of theirs clashes."""
    packed = rows.select("session_id", F.struct("*").alias("row"))
    return ranked(packed, "dashboard", "session_id", f"row.`{order}`", ranges=ranges)


def _in_range():
    return Window.partitionBy("session_id", "range").orderBy("place")


def _joined(dealt: DataFrame, sums: DataFrame, *names: str) -> DataFrame:
    """dealt with the named columns of its ranges' summaries."""
    sums = sums.select(F.col("session_id").alias("_session"), F.col("range").alias("_range"), *names)
    same = dealt["session_id"].eqNullSafe(sums["_session"]) & (dealt["range"] == sums["_range"])
    return dealt.join(sums, same, "left").drop("_session", "_range")


def _of(column: str) -> Column:
    return F.col(f"row.`{column}`")


def _last(columns: list[str]) -> list[Column]:
    """The last value of each column that isn't null, of a range."""
    return [F.max_by(_of(c), F.when(_of(c).isNotNull(), F.col("place"))).alias(f"_last{i}") for i, c in enumerate(columns)]


def _earlier() -> Window:
    return Window.partitionBy("session_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)


def _carried(columns: list[str]) -> list[Column]:
    """The last value of each column in the ranges before, from summaries with _last."""
    return [F.last(f"_last{i}", ignorenulls=True).over(_earlier()).alias(f"_before{i}") for i in range(len(columns))]


def _so_far(columns: list[str]) -> list[Column]:
    w = _in_range().rowsBetween(Window.unboundedPreceding, 0)
    return [F.coalesce(F.last(_of(c), ignorenulls=True).over(w), f"_before{i}") for i, c in enumerate(columns)]


def rolling_mean(metrics: DataFrame, column: str, n: int = 60, order: str = "ts", block: int = BLOCK, ranges: int | None = None) -> DataFrame:
    """DW1 for each hop: mean and number of the n latest points up to it.

    Hops are numbered in their session and dealt anew by blocks of numbers; the last n - 1 of a block go to the next one as well.
    """
    block = max(block, n)
    dealt = _dealt(metrics, order, ranges)
    rows = _joined(dealt, offsets(dealt, "session_id"), "before", "first")
    rows = rows.select("session_id", "row", (F.col("before") + F.col("place") - F.col("first")).alias("number"))
    own = F.floor(F.col("number") / F.lit(block))
    late = F.col("number") % block > block - n
    rows = rows.withColumn("block", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))))
    w = Window.partitionBy("session_id", "block").orderBy("number").rowsBetween(1 - n, 0)
    value = _of(column)
    out = rows.select("row", "number", "block", F.count(value).over(w).alias("points"), F.avg(value).over(w).alias("mean"))
    return out.filter(F.col("block") == own).select("row.*", "points", "mean")


def poll_metrics(metrics: DataFrame, columns: list[str], seconds: int = 1, ranges: int | None = None) -> DataFrame:
    """DW2: ticks of each session from its first whole tick on, with the latest values at or before each."""
    dealt = _dealt(metrics.select("session_id", F.unix_micros("ts").alias("us"), *columns), "us", ranges)
    sums = dealt.groupBy("session_id", "range").agg(F.min("row.us").alias("start"), *_last(columns))
    following = F.lead("start").over(Window.partitionBy("session_id").orderBy("range")).alias("_next")
    sums = sums.select("session_id", "range", following, *_carried(columns))
    rows = _joined(dealt, sums, "_next", *[f"_before{i}" for i in range(len(columns))])
    rows = rows.select(
        "session_id", F.col("row.us").alias("us"), F.coalesce(F.lead("row.us").over(_in_range()), "_next").alias("next_us"),
        *[x.alias(c) for x, c in zip(_so_far(columns), columns)],
    )
    return ticks_of(rows, columns, seconds)


def carry_forward(polls: DataFrame, columns: list[str], order: str = "ts", ranges: int | None = None) -> DataFrame:
    """DW3: a poll that failed, with nulls, keeps the last good values; before the first there are none."""
    dealt = _dealt(polls, order, ranges)
    sums = dealt.groupBy("session_id", "range").agg(*_last(columns)).select("session_id", "range", *_carried(columns))
    rows = _joined(dealt, sums, *[f"_before{i}" for i in range(len(columns))])
    good = dict(zip(columns, _so_far(columns)))
    return rows.select(*[(good[c] if c in good else _of(c)).alias(c) for c in polls.columns])


def new_events_only(polled: DataFrame, order: str = "poll_no", stamp: str = "event_ts", ranges: int | None = None) -> DataFrame:
    """DW4: polled events whose stamp is over all that were seen before; a missing stamp is 0."""
    zero = F.lit(0).cast(polled.schema[stamp].dataType)
    own = F.coalesce(_of(stamp), zero)
    dealt = _dealt(polled, order, ranges)
    sums = dealt.groupBy("session_id", "range").agg(F.max(own).alias("top"))
    sums = sums.select("session_id", "range", F.max("top").over(_earlier()).alias("_before"))
    here = F.max(own).over(_in_range().rowsBetween(Window.unboundedPreceding, -1))
    rows = _joined(dealt, sums, "_before").select("row", own.alias("own"), F.coalesce(F.greatest(here, "_before"), zero).alias("seen"))
    return rows.filter("own > seen").select("row.*")
